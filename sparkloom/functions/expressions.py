"""Expressions held in a column, one for each row: cut into tokens, put into postfix order by a fold with a stack of operators, and
evaluated by a fold with a stack of values. Everything is array functions of Spark, so nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import C, col

TEXTS = "array<string>"


def _last(a: Column, holds) -> Column:
    """The place, counted from 1, of the last element for which a condition holds, or 0."""
    return F.coalesce(F.array_max(F.transform(a, lambda x, i: F.when(holds(x), i + 1).otherwise(0))), F.lit(0))


def postfix(tokens: Column, ranks: dict[str, int], prefixes: tuple[str, ...] = ()) -> Column:
    """Tokens in postfix order. ranks: binary operators, which group from the left, the higher the tighter; prefixes: operators before their operand, tighter than any.

    Below each bracket the waiting operators rise in rank, so what an operator displaces is the end of the stack after the last lower one."""
    table = F.create_map(*(F.lit(v) for kv in (ranks | dict.fromkeys(prefixes, 99)).items() for v in kv))
    rank = lambda o: F.coalesce(table[o], F.lit(0))  # noqa: E731  (an opening bracket holds what lies below it)

    def step(state: Column, t: Column) -> Column:
        ops = state["ops"]
        size = F.size(ops)
        kept = F.when((t == "(") | t.isin(*prefixes) if prefixes else t == "(", size).when(t == ")", _last(ops, lambda o: o == "(")).otherwise(_last(ops, lambda o: rank(o) < rank(t)))
        moved = F.reverse(F.slice(ops, kept + 1, F.greatest(size - kept, F.lit(0))))
        left = F.when(t == ")", F.slice(ops, 1, F.greatest(kept - 1, F.lit(0)))).otherwise(F.concat(F.slice(ops, 1, kept), F.array(t)))
        operator = t.isin("(", ")", *ranks, *prefixes)
        return F.when(operator, F.struct(F.concat(state["out"], moved).alias("out"), left.alias("ops"))).otherwise(F.struct(F.concat(state["out"], F.array(t)).alias("out"), ops.alias("ops")))

    none = F.array().cast(TEXTS)
    return F.aggregate(tokens, F.struct(none.alias("out"), none.alias("ops")), step, lambda s: F.concat(s["out"], F.filter(F.reverse(s["ops"]), lambda o: o != "(")))


def evaluate(ordered: Column, kind: str, value, binary: dict[str, object], unary: dict[str, object] | None = None) -> Column:
    """The value of tokens in postfix order; null where operands are missing or left over. value: of an operand's token; binary, unary: functions of Columns."""
    unary = unary or {}

    def step(stack: Column, t: Column) -> Column:
        size = F.size(stack)
        last, before = F.get(stack, size - 1), F.get(stack, size - 2)
        out = F.concat(stack, F.array(value(t)))
        for name, f in unary.items():
            out = F.when(t == name, F.concat(F.slice(stack, 1, F.greatest(size - 1, F.lit(0))), F.array(f(last)))).otherwise(out)
        for name, f in binary.items():
            out = F.when(t == name, F.concat(F.slice(stack, 1, F.greatest(size - 2, F.lit(0))), F.array(F.when(size > 1, f(before, last))))).otherwise(out)
        return out

    return F.aggregate(ordered, F.array().cast(f"array<{kind}>"), step, lambda s: F.when(F.size(s) == 1, s[0]))


# arithmetic ----------------------------------------------------------------------------------------------------------------------

#: Milliseconds of each suffix of a duration.
DURATIONS = {"ms": 1, "s": 1000, "min": 60_000, "h": 3_600_000, "d": 86_400_000}
_NUMBER = r"\d+(?:\.\d+)?"
_TOKEN = rf"{_NUMBER}\w*|[A-Za-z_][\w.]*(?:::[A-Za-z_][\w.]*)*|[-+*/()]|\S"
RANKS = {"+": 1, "-": 1, "*": 2, "/": 2}
#: What stands for a minus before an operand.
NEGATIVE = "neg"


def arithmetic_tokens(c: C) -> Column:
    """Tokens of an arithmetic expression in postfix order."""
    found = F.regexp_extract_all(col(c), F.lit(_TOKEN), F.lit(0))
    before = lambda i: F.coalesce(F.get(found, i - 1), F.lit("("))
    signed = F.transform(found, lambda t, i: F.when((t == "-") & before(i).isin("(", *RANKS), F.lit(NEGATIVE)).otherwise(t))
    return postfix(signed, RANKS, (NEGATIVE,))


def names_in(tokens: Column) -> Column:
    """The distinct names among tokens in postfix order."""
    return F.array_distinct(F.filter(tokens, lambda t: t.rlike(r"^[A-Za-z_]") & (t != NEGATIVE)))


def arithmetic_value(tokens: Column, values: Column | None = None) -> Column:
    """The value of arithmetic_tokens(): numbers, numbers with the suffix of a duration in milliseconds, and names by a map of values. Null where a name or a token is unknown, and on division by zero."""
    units = F.create_map(*(F.lit(v) for kv in DURATIONS.items() for v in (kv[0], float(kv[1]))))
    pattern = f"^({_NUMBER})({'|'.join(DURATIONS)})?$"

    def value(t: Column) -> Column:
        number = F.regexp_extract(t, pattern, 1).try_cast("double") * F.coalesce(units[F.regexp_extract(t, pattern, 2)], F.lit(1.0))
        return number if values is None else F.coalesce(number, values[t])

    binary = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b)}
    return evaluate(tokens, "double", value, binary, {NEGATIVE: lambda a: -a})


def calculate(c: C) -> Column:
    """The value of an arithmetic expression with brackets, precedence and durations, which count in milliseconds [SC-D3, SC-M1]; null for anything else."""
    return arithmetic_value(arithmetic_tokens(c))


def duration(c: C, kind: C) -> Column:
    """A default such as 24h * 365 as a whole number in the unit of its C++ type: seconds, minutes or hours by std::chrono, milliseconds otherwise [SC-D3].

    The value is cut towards zero. Plain numbers count as milliseconds too, so 5000 of type seconds is 5."""
    return in_unit(calculate(c), kind)


def in_unit(milliseconds: Column, kind: C) -> Column:
    """Milliseconds in the unit of a C++ type, cut towards zero."""
    k = col(kind)
    unit = F.when(k.contains("std::chrono::milliseconds"), 1.0)
    for name, suffix in (("seconds", "s"), ("minutes", "min"), ("hours", "h")):
        unit = unit.when(k.contains(f"std::chrono::{name}"), float(DURATIONS[suffix]))
    return (milliseconds / unit.otherwise(1.0)).cast("bigint")


# build constraints -----------------------------------------------------------------------------------------------------------------

#: Systems and machines that a file's name or constraint may name, and the systems that are a `unix`.
SYSTEMS = "aix android darwin dragonfly freebsd hurd illumos ios js linux nacl netbsd openbsd plan9 solaris wasip1 windows zos".split()
UNIX = "aix android darwin dragonfly freebsd hurd illumos ios linux netbsd openbsd solaris".split()
MACHINES = "386 amd64 amd64p32 arm arm64 arm64be armbe loong64 mips mips64 mips64le mips64p32 mips64p32le mipsle ppc ppc64 ppc64le riscv riscv64 s390 s390x sparc sparc64 wasm".split()


def tag_holds(t: Column, system: C) -> Column:
    """Whether a build tag holds for a system: systems by name, `unix` by kind, machines and cgo always, others never."""
    s = F.lit(system) if isinstance(system, str) else system
    return F.when(t.isin(SYSTEMS), t == s).when(t == "unix", s.isin(UNIX)).otherwise(t.isin(*MACHINES, "cgo"))


def builds(c: C, system: C) -> Column:
    """Whether a constraint of names, !, &&, || and brackets holds for a system [F27]. An operand that is missing counts as false."""
    found = F.regexp_extract_all(col(c), F.lit(r"[A-Za-z0-9_.]+|&&|\|\||!|\(|\)"), F.lit(0))
    ordered = postfix(found, {"||": 1, "&&": 2}, ("!",))
    return F.coalesce(evaluate(ordered, "boolean", lambda t: tag_holds(t, system), {"&&": lambda a, b: a & b, "||": lambda a, b: a | b}, {"!": lambda a: ~a}), F.lit(False))


def builds_lines(lines: Column, system: C) -> Column:
    """Whether legacy lines hold for a system: all lines must, of a line's options one, of an option's terms all; each ! before a term turns it [F27]."""

    def term(x: Column) -> Column:
        marks = F.length(F.regexp_extract(x, "^(!*)", 1))
        return tag_holds(F.substr(x, marks + 1), system) == (marks % 2 == 0)

    options = lambda line: F.filter(F.split(F.trim(line), r"\s+"), lambda o: o != "")
    return F.forall(lines, lambda line: (F.size(options(line)) == 0) | F.exists(options(line), lambda o: F.forall(F.split(o, ","), term)))


def system_of_file(name: C) -> Column:
    """The system that a Go file's name asks for: its last part, or the part before a machine; null if none."""
    parts = F.split(F.regexp_replace(col(name), r"\.go$", ""), "_")
    n = F.size(parts)
    last, before = F.get(parts, n - 1), F.get(parts, n - 2)
    return F.when((n >= 2) & last.isin(SYSTEMS), last).when((n >= 3) & last.isin(MACHINES) & before.isin(SYSTEMS), before)


def file_builds(name: C, contents: C, system: C) -> Column:
    """Whether a Go file builds for a system, by its name and by the constraint above its package clause; a new-style line counts before legacy ones [F27]."""
    s = F.lit(system) if isinstance(system, str) else system
    header = F.split(F.coalesce(col(contents), F.lit("")), r"(?m)^package\s", 2)[0]
    modern = F.trim(F.regexp_extract(header, r"(?m)^//go:build[^\S\n]+(\S.*)$", 1))
    legacy = F.regexp_extract_all(header, F.lit(r"(?m)^//[^\S\n]*\+build[^\S\n]+(\S.*)$"), F.lit(1))
    by_name = F.coalesce(system_of_file(name) == s, F.lit(True))
    return by_name & F.when(modern != "", builds(modern, s)).otherwise(builds_lines(legacy, s))
