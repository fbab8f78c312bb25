"""Settings declared in C++ sources: member declarations, constructor arguments, and the chain of transformers that makes rows of a registry of them.

Declarations and argument lists nest without bound, so two scanners of one text find them (readers.scan_rows runs them over Arrow
batches). All that follows is Column expressions over their rows: one row for each setting, with its arguments as an array."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import C, col
from .brackets import arguments, closing
from .readers import scan_rows

# scanners ----------------------------------------------------------------------------------------------------------------------


def _bare(text: str) -> str:
    """The text without comments; quoted text stays."""
    return re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", text, flags=re.S)


def header_settings(text: str) -> list[tuple]:
    """(name, type, declaration) of members whose type is some property<...> or enterprise<...>; each name of a declaration of several counts, with or without an initialiser [SRC15]."""
    out, text = [], _bare(text)
    for m in re.finditer(r"(?<![\w:<])(?:\w+::)*\w*(?:property|enterprise)<", text):
        end = closing(text, m.end() - 1) + 1
        rest, names, at = text[end:], [], 0
        while name := re.compile(r"\s*(\w+)\s*").match(rest, at):
            names.append(name[1])
            at = name.end()
            if rest[at : at + 1] == "{":
                at = closing(rest, at) + 1
            elif rest[at : at + 1] == "=":
                at += len(re.match(r"=[^,;]*", rest[at:])[0])
            at += len(re.match(r"\s*", rest[at:])[0])
            if rest[at : at + 1] != ",":
                break
            at += 1
        if names and rest[at : at + 1] == ";":
            declared = " ".join(text[m.start() : end + at + 1].split())
            out += [(name, " ".join(text[m.start() : end].split()), declared) for name in names]
    return out


SETTINGS = ("name string, type string, declaration string", [pa.string()] * 3)


def _kind(value: str) -> str:
    for pattern, kind in (
        (r'R?"', "string_literal"), (r"\[", "lambda_expression"), (r"(meta\s*)?\{", "initializer_list"), (r"true$", "true"), (r"false$", "false"),
        (r"-?[\d'.]+\w*$", "number_literal"), (r"\w+$", "identifier"), (r"(?:\w+(?:<[^()]*>)?::)+\w+$", "qualified_identifier"),
    ):
        if re.match(pattern, value):
            return kind
    return "call_expression"


def _literal(value: str) -> str:
    """Text of neighbouring string literals, put together."""
    raw = re.fullmatch(r'R"([^(]*)\((.*)\)\1"', value, re.S)
    if raw:
        return raw[2]
    return "".join(re.sub(r'\\(["\\])', r"\1", x) for x in re.findall(r'"((?:[^"\\]|\\.)*)"', value))


def source_arguments(text: str) -> list[tuple]:
    """(name, ordinal, kind, value) of the arguments in constructor initialisers whose first one is *this, which is left out [SRC16]."""
    out, text = [], _bare(text)
    for m in re.finditer(r"(\w+)\s*([({])\s*\*this\s*,", text):
        body = text[m.start(2) + 1 : closing(text, m.start(2))]
        for n, value in enumerate(arguments(body)[1:]):
            kind = _kind(value)
            out.append((m[1], n, kind, _literal(value) if kind == "string_literal" else " ".join(value.split())))
    return out


ARGUMENTS = ("name string, ordinal int, kind string, value string", [pa.string(), pa.int32(), pa.string(), pa.string()])


def settings(headers: DataFrame, sources: DataFrame) -> DataFrame:
    """(name_in_file, type, declaration, params, defined_in) of headers and sources (path, contents); a declaration without arguments has none [SRC15, SRC16]."""
    declared = scan_rows(headers.select("contents"), "contents", header_settings, *SETTINGS)
    given = scan_rows(sources.select("path", "contents"), "contents", source_arguments, *ARGUMENTS)
    params = given.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "value", "kind"))), lambda p: F.struct(p["value"].alias("value"), p["kind"].alias("kind"))).alias("params"), F.min("path").alias("path"))
    none = F.array().cast("array<struct<value:string,kind:string>>")
    return declared.join(params, "name", "left").select(F.col("name").alias("name_in_file"), "type", "declaration", F.coalesce("params", none).alias("params"), F.regexp_replace("path", r"^.*src/", "src/").alias("defined_in"))


# transformers ------------------------------------------------------------------------------------------------------------------


def _at(n: int) -> Column:
    return F.get("params", n)


def _last() -> Column:
    return F.element_at("params", -1)


def _rest(first: int, cut: int = 0) -> Column:
    return F.slice("params", F.lit(first + 1), F.size("params") - first - cut)


def _vector(p: Column) -> Column:
    return F.coalesce(F.contains(p["value"], F.lit("std::vector")), F.lit(False))


def _clean(value: Column) -> Column:
    """A value without quotes and namespaces."""
    return F.regexp_replace(F.regexp_replace(F.trim(value), r'^"|"$', ""), r"^(?:\w+::)+", "")


def _items(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_extract(value, r"(?s)\{(.*)\}", 1), ","), _clean), lambda x: x != "")


#: Kinds of arguments that may stand for a restricted value. A list of the same kinds elsewhere names numbers by a kind that no
#: parser gives, so that there they never count; here they do.
_SCALAR = ["true", "false", "number_literal", "string_literal", "qualified_identifier"]


def enterprise(df: DataFrame) -> DataFrame:
    """Whether a setting is licensed, by which constructor, its restricted and sanctioned values; these leave params. Must be the first."""
    n, first, second, last = F.size("params"), _at(0), _at(1), _last()
    licensed = F.contains("type", F.lit("enterprise<"))
    low, high = _items(first["value"]), _items(last["value"])
    enum_last = (F.size(F.array_except(low, high)) == 0) & (F.size(high) > F.size(low))
    scalar = lambda p: F.coalesce(p["kind"].isin(_SCALAR), F.lit(False))
    one = lambda p: F.array(_clean(p["value"]))
    none = F.lit(None).cast("array<string>")
    case = lambda how, restricted, sanctioned, params: F.struct(F.lit(how).alias("how"), restricted.alias("restricted"), sanctioned.alias("sanctioned"), params.alias("params"))
    found = (
        F.when(~licensed | (n < 3), F.lit(None))
        .when((n >= 6) & _vector(first) & _vector(last), F.when(enum_last, case("restricted_only", low, none, _rest(1, 1))).otherwise(case("restricted_with_sanctioned", low, high, _rest(1, 1))))
        .when((n >= 5) & _vector(first), case("restricted_only", low, none, _rest(1)))
        .when((n >= 5) & _vector(last), case("sanctioned_only", none, high, _rest(0, 1)))
        .when((n >= 6) & scalar(first) & scalar(second) & (_clean(second["value"]) != F.col("name_in_file")), case("restricted_with_sanctioned", one(first), one(second), _rest(2)))
        .when((n >= 5) & scalar(first), case("restricted_only", one(first), none, _rest(1)))
        .when(first["kind"].isin("lambda_expression", "identifier", "qualified_identifier") & (second["kind"] == "string_literal"), case("simple", none, none, _rest(1)))
    )
    df = df.withColumn("__e", found)
    return df.withColumns({"is_enterprise": licensed & ((n < 3) | F.col("__e").isNotNull()), "enterprise_constructor": F.col("__e.how"), "enterprise_restricted": F.col("__e.restricted"), "enterprise_sanctioned": F.col("__e.sanctioned"), "params": F.coalesce("__e.params", "params")}).drop("__e")


def normal_params(df: DataFrame) -> DataFrame:
    """Licensed settings without a vector of restricted values before the name or after it."""
    plain = F.coalesce(_at(0)["value"].rlike(r"^(true|false|-?\d+(\.\d+)?)$"), F.lit(True))
    shifted = F.when(plain | ~F.contains("type", F.lit("enterprise")), F.col("params")).when((F.size("params") >= 4) & _vector(_at(0)), _rest(1)).when((F.size("params") >= 5) & _vector(_at(1)), _rest(2)).otherwise(F.col("params"))
    return df.withColumn("params", shifted)


#: Patterns of C++ types and the types that documents show, in order.
SHOWN_TYPES = [
    ("^u(nsigned|int)", "integer"), ("^(int|(std::)?size_t)", "integer"), ("data_directory_path", "string"), ("filesystem::path", "string"), ("(double|float)", "number"),
    ("string", "string"), ("bool", "boolean"), ("std::chrono", "integer"), ("^config::sasl_mechanisms_override$", "object"),
]


def inner_type(declaration: C) -> Column:
    """The type inside property<...>, std::optional<...>, std::vector<...> and one_or_many_property<...> [SC-S41]."""
    d = F.regexp_replace(col(declaration), r"\s+", " ")
    wrapped = F.length(F.regexp_replace(F.substring_index(d, "property<", 1), "[^<]", ""))
    body = F.regexp_extract(d, r"property<(.+)>", 1)
    x = F.regexp_replace(F.element_at(F.split(F.left(body, F.length(body) - wrapped), " "), 1), ",", "")
    for w in ("std::optional", "std::vector", "one_or_many_property"):
        x = F.regexp_replace(x, f"^.*{w}<(.+)>.*$", "$1")
    return x


def types(df: DataFrame) -> DataFrame:
    """Type to show, inner C++ type, and whether the declaration deprecates."""
    shown = F.col("c_type")
    for pattern, kind in reversed(SHOWN_TYPES):
        shown = F.when(F.col("c_type").rlike(pattern), kind).otherwise(shown)
    return df.withColumn("c_type", inner_type("declaration")).withColumns({"shown_type": shown, "is_deprecated": F.contains("declaration", F.lit("deprecated_property"))})


def meta(df: DataFrame) -> DataFrame:
    """The initialiser .key = value, ... as a map, without namespaces of its values."""
    pattern = r'\.(\w+)\s*=\s*(\{[^}]*\}|"[^"]*"|[\w:]+)'
    text = F.coalesce(F.get(F.filter("params", lambda p: (p["kind"] == "initializer_list") & p["value"].rlike(r"\.\w+\s*=")), 0)["value"], F.lit(""))
    value = lambda v: F.when(v.rlike(r'^["{]'), v).otherwise(F.regexp_replace(v, r"^.*::", ""))
    return df.withColumn("meta", F.map_from_arrays(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), value)))


def basic_info(df: DataFrame) -> DataFrame:
    """Name: the first string argument if it is one word, else the member's; description: the string after it, or itself, if over ten characters with a space."""
    texts = F.filter("params", lambda p: p["kind"] == "string_literal")
    first, after = F.get(texts, 0)["value"], F.get(texts, 1)["value"]
    prose = lambda x: (F.length(x) > 10) & F.contains(x, F.lit(" "))
    return df.withColumns({"name": F.when((first != "") & ~first.rlike(r"\s"), first).otherwise(F.col("name_in_file")), "description": F.when(prose(after), after).when(prose(first), first)})


def nullable(df: DataFrame) -> DataFrame:
    need = F.col("meta")["required"]
    return df.withColumn("nullable", F.when(need.isNotNull(), need != "yes").otherwise(F.contains("declaration", F.lit("std::optional"))))


def arrays(df: DataFrame) -> DataFrame:
    many = F.col("declaration").rlike("std::vector|one_or_many_property")
    return df.withColumns({"items_type": F.when(many, F.col("shown_type")), "shown_type": F.when(many, "array").otherwise(F.col("shown_type"))})


def _flag(key: str, out: str, value: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        return df.withColumn(out, value(F.col("meta")[key]))

    run.__name__ = out
    return run


#: A missing needs_restart means yes; the other flags stay unset where they are missing.
needs_restart = _flag("needs_restart", "needs_restart", lambda v: F.coalesce(v != "no", F.lit(True)))
gets_restored = _flag("gets_restored", "gets_restored", lambda v: v != "no")
is_secret = _flag("secret", "is_secret", lambda v: v == "yes")
example = _flag("example", "example", lambda v: F.concat(F.lit("`"), F.regexp_replace(v, r'^"|"$', ""), F.lit("`")))


def visibility(df: DataFrame) -> DataFrame:
    v = F.col("meta")["visibility"]
    return df.withColumns({"visibility": v, "is_deprecated": F.col("is_deprecated") | F.coalesce(v == "deprecated", F.lit(False))})


def deprecated(df: DataFrame) -> DataFrame:
    v = F.regexp_replace(F.col("meta")["deprecated"], r'^"|"$', "")
    return df.withColumns({"is_deprecated": F.col("is_deprecated") | v.isNotNull(), "deprecated_reason": F.when(~v.isin("yes", "true"), v)})


#: Bits of integer types, signed or not, and of durations.
INTEGER_BITS = {"unsigned": (32, False), "uint8_t": (8, False), "uint16_t": (16, False), "uint32_t": (32, False), "uint64_t": (64, False), "int": (32, True), "int8_t": (8, True), "int16_t": (16, True), "int32_t": (32, True), "int64_t": (64, True)}
DURATION_BITS = {"nanoseconds": 64, "microseconds": 55, "milliseconds": 45, "seconds": 35, "minutes": 29, "hours": 23, "days": 25, "weeks": 22, "months": 20, "years": 17}


def _bounds(df: DataFrame, key: Column, table: dict[str, tuple[int, int]]) -> DataFrame:
    number = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    for c, side in (("minimum", 0), ("maximum", 1)):
        out = F.col(c) if c in df.columns else F.lit(None).cast("decimal(20,0)")
        for k, b in table.items():
            out = F.when(key == k, number(b[side])).otherwise(out)
        df = df.withColumn(c, out)
    return df


def numeric_bounds(df: DataFrame) -> DataFrame:
    return _bounds(df, F.col("c_type"), {k: ((-(2 ** (b - 1)), 2 ** (b - 1) - 1) if s else (0, 2**b - 1)) for k, (b, s) in INTEGER_BITS.items()})


def duration_bounds(df: DataFrame) -> DataFrame:
    return _bounds(df, F.regexp_extract("c_type", r"^std::chrono::(\w+)$", 1), {k: (-(2 ** (b - 1)), 2 ** (b - 1) - 1) for k, b in DURATION_BITS.items()})


def default_argument(df: DataFrame) -> DataFrame:
    """The last argument after the description that is neither the meta initialiser nor a validator; of legacy_default<T>(value, ...) the value."""
    text = F.array_position(F.transform("params", lambda p: p["kind"] == "string_literal"), True)
    after = F.slice("params", text + 2, F.greatest(F.lit(0), F.size("params") - text - 1).cast("int"))
    usable = F.filter(after, lambda p: ~(p["value"].rlike(r"validat|checker") & (p["kind"] != "string_literal")) & (p["kind"] != "lambda_expression") & ~((p["kind"] == "initializer_list") & p["value"].rlike(r"\.\w+\s*=")))
    p = F.element_at(F.when(F.size(usable) > 0, usable), -1)
    legacy = F.regexp_extract(p["value"], r"legacy_default<[^>]+>[({]([^,]+)", 1)
    return df.withColumns({"default_value": F.when(legacy != "", F.trim(legacy)).otherwise(p["value"]), "default_kind": p["kind"]})


#: Binary sizes, and units of time as documents name them.
SIZE_STEP = {"K": 1, "M": 2, "G": 3, "T": 4, "P": 5}


def friendly_default(df: DataFrame) -> DataFrame:
    """Default as JSON text: nullopt is null, lists are arrays, sizes are bytes, durations have their unit, names lose std:: and namespaces."""
    x = F.col("default_value")
    size = F.regexp_extract(x, r"^(\d+)_([KMGTP])iB$", 1).try_cast("bigint")
    step = F.create_map(*(F.lit(v) for k, n in SIZE_STEP.items() for v in (k, 1024**n)))[F.regexp_extract(x, r"^(\d+)_([KMGTP])iB$", 2)]
    time = r"^(?:std::)?chrono::(\w+)[({]\s*(\d+)\s*[)}]$"
    quoted = lambda v: F.to_json(F.array(v))
    text = lambda v: F.substring(quoted(v), F.lit(2), F.length(quoted(v)) - 2)
    out = (
        F.when(x.isNull() | F.contains(x, F.lit("std::nullopt")), "null")
        .when(F.col("default_kind") == "string_literal", text(x))
        .when(x.isin("true", "false") | x.rlike(r"^-?\d+(\.\d+)?$"), x)
        .when(size.isNotNull(), (size * step).cast("string"))
        .when(x.rlike(time), text(F.concat(F.regexp_extract(x, time, 2), F.lit(" "), F.regexp_extract(x, time, 1))))
        .when(x.rlike(r"^\{.*\}$"), F.to_json(_items(x)))
        .otherwise(text(F.regexp_replace(x, r"^(?:\w+::)+", "")))
    )
    return df.withColumn("default_json", F.when(F.size("params") > 0, out))


def experimental(df: DataFrame) -> DataFrame:
    return df.withColumn("is_experimental", F.coalesce(F.col("meta")["experimental"] != "no", F.col("type").rlike("^(development_|hidden_when_default_)")))


def aliases(df: DataFrame) -> DataFrame:
    return df.withColumn("aliases", _items(F.coalesce(F.col("meta")["aliases"], F.lit("{}"))))


#: The transformers in the order in which they must run: the first one changes the arguments that the others read.
TRANSFORMERS = [
    enterprise, normal_params, types, meta, basic_info, nullable, arrays, needs_restart, gets_restored, visibility, deprecated, is_secret, example,
    numeric_bounds, duration_bounds, default_argument, friendly_default, experimental, aliases,
]


def registry(df: DataFrame) -> DataFrame:
    """All transformers over settings(); private and experimental settings go [U3]."""
    for f in TRANSFORMERS:
        df = df.transform(f)
    return df.filter(~F.col("name_in_file").startswith("_") & ~F.col("is_experimental")).drop("params", "default_value", "default_kind")


# constants and topic settings --------------------------------------------------------------------------------------------------

#: Spellings of named constants; name, then value. A partition's topic is filed under name.topic.
NAMED = [
    r'constexpr\s+(?:std::string_view|auto|const\s+char\s*\*)\s+(\w+)\s*(?:=\s*|\{\s*)"([^"]+)"',
    r'std::string_view\s+(\w+)\s*\(\s*\)\s*\{\s*return\s*"([^"]+)"',
    r'const\s+model::(?:topic|ns)\s+(\w+)\s*\(\s*"([^"]+)"\s*\)',
]
PARTITION = r'const\s+(?:model::)?topic_partition\s+(\w+)\s*\{\s*(?:model::)?topic\s*\{\s*"([^"]+)"'


def named_constants(text: str) -> list[tuple]:
    """(name, value) in order of place: string constants, functions that return a string, topics and namespaces, each by its own name and with the namespace it is in [SRC18]."""
    found = [(m.start(), m[1], m[2]) for p in NAMED for m in re.finditer(p, text)] + [(m.start(), f"{m[1]}.topic", m[2]) for m in re.finditer(PARTITION, text)]
    spaces = [(m.start(), closing(text, m.end() - 1), m[1]) for m in re.finditer(r"\bnamespace\s+([\w:]+)\s*\{", text)]
    out = []
    for at, name, value in sorted(set(found)):
        inside = "::".join(n for a, z, n in spaces if a < at < z)
        out += [(name, value)] + ([(f"{inside}::{name}", value)] if inside else [])
    return out


CONSTANTS = ("name string, value string", [pa.string()] * 2)

#: Spellings of constants that name topic settings, and first words of such settings in plain strings.
TOPIC_SPELLINGS = [
    r'(?:inline\s+)?constexpr\s+(?:std::)?string_view\s+(topic_property_\w+)\s*(?:=\s*|\{\s*)"([^"]+)"',
    r'const\s+std::string\s+(topic_property_\w+)\s*=\s*"([^"]+)"',
    r'static\s+const\s+char\s*\*\s*(topic_property_\w+)\s*=\s*"([^"]+)"',
    r'\b(topic_property_\w+)\s*=\s*"([^"]+)"',
]
TOPIC_WORDS = ["cleanup", "compression", "segment", "flush", "delete", "replication", "write", "min", "max", "confluent"]


def topic_settings(text: str) -> list[tuple]:
    """(constant, name): constants in any of the spellings, then plain strings that look like a topic setting; the first of a name counts [SRC20]."""
    out: dict[str, str] = {}
    for p in TOPIC_SPELLINGS:
        for m in re.finditer(p, text):
            out.setdefault(m[2], m[1])
    for m in re.finditer(rf'"((?:{"|".join(TOPIC_WORDS)})\.[a-z0-9_.]+)"', text):
        out.setdefault(m[1], "topic_property_" + re.sub(r"\W+", "_", m[1]).strip("_"))
    return [(c, n) for n, c in out.items()]


def ignored_settings(text: str) -> list[tuple]:
    """(name): settings that are accepted and do nothing, from the list of such [SRC20]."""
    m = re.search(r"allowlist_topic_noop_confs\s*=\s*\{([^}]+)\}", text)
    return [(x,) for x in re.findall(r'"([^"]+)"', m[1])] if m else []


def topic_defaults(text: str) -> list[tuple]:
    """(constant, cluster setting, ordinal): cluster settings that a topic setting takes its default from; the first is the primary one [SRC20]."""
    out = []
    for m in re.finditer(r"add_topic_config_if_requested\s*\(", text):
        call = text[m.end() - 1 : closing(text, m.end() - 1)]
        constant = re.search(r"topic_property_\w+", call)
        names = list(dict.fromkeys(re.findall(r"shard_local_cfg\(\)\s*\.\s*(\w+)\s*\.\s*(?:name|desc)\s*\(\)", call)))
        out += [(constant[0], x, i) for i, x in enumerate(names)] if constant else []
    return out


#: Categories of topic settings; {p} stands for the product's prefix.
CATEGORIES = {
    "retention-compaction": ["cleanup.policy", "compaction.strategy", "delete.retention.ms", "max.compaction.lag.ms", "min.cleanable.dirty.ratio", "min.compaction.lag.ms", "retention.bytes", "retention.ms"],
    "segment-message": ["compression.type", "max.message.bytes", "message.timestamp.type", "segment.bytes", "segment.ms"],
    "performance-cluster": ["flush.bytes", "flush.ms", "{p}.leaders.preference", "replication.factor", "write.caching"],
    "tiered-storage": ["initial.retention.local.target.bytes", "initial.retention.local.target.ms", "{p}.remote.delete", "{p}.remote.read", "{p}.remote.recovery", "{p}.remote.write", "retention.local.target.bytes", "retention.local.target.ms"],
    "remote-read-replica": ["{p}.remote.readreplica"],
    "iceberg-integration": ["{p}.iceberg.delete", "{p}.iceberg.invalid.record.action", "{p}.iceberg.mode", "{p}.iceberg.partition.spec", "{p}.iceberg.target.lag.ms"],
    "schema-registry": ["{p}.key.schema.id.validation", "{p}.key.subject.name.strategy", "{p}.value.schema.id.validation", "{p}.value.subject.name.strategy", "confluent.key.schema.validation", "confluent.key.subject.name.strategy", "confluent.value.schema.validation", "confluent.value.subject.name.strategy"],
}


def category(name: C, prefix: str) -> Column:
    """[SC-S33]"""
    out = F.lit("other")
    for k, names in CATEGORIES.items():
        out = F.when(col(name).isin([n.replace("{p}", prefix) for n in names]), k).otherwise(out)
    return out


def topic_type(name: C, prefix: str) -> Column:
    """Type of a topic setting by its name [SC-S34]."""
    x = col(name)
    known = ["write.caching", *(f"{prefix}.remote.{k}" for k in ("recovery", "write", "read", "delete"))]
    return (
        F.when(x == f"{prefix}.remote.readreplica", "string").when(x == f"{prefix}.iceberg.delete", "boolean")
        .when(x.rlike("caching|recovery|read|write|delete"), F.when(x.isin(known), "boolean").otherwise("string"))
        .when(x.rlike(r"\.bytes|\.ms|\.factor"), "integer").when(F.contains(x, F.lit("ratio")), "number").otherwise("string")
    )


def acceptable_values(name: C, kind: C, compression: list[str], policies: list[str]) -> Column:
    """What a topic setting takes, as documents show it [SC-S34]. compression and policies: values of the enumerations, none if unknown."""
    x, k = col(name), col(kind)
    shown = lambda v: f"[`{'`, `'.join(v)}`]" if v else ""
    codecs = [c for c in compression if c != "count"]
    codecs = [c for c in codecs if c == "producer"] + [c for c in codecs if c != "producer"]
    names = [{"deletion": "delete", "compaction": "compact"}[p] for p in policies if p in ("deletion", "compaction")]
    return (
        F.when(F.contains(x, F.lit("compression")), shown(codecs)).when(F.contains(x, F.lit("cleanup.policy")), shown([*names, "compact,delete"] if names else []))
        .when(F.contains(x, F.lit("timestamp.type")), "[`CreateTime`, `LogAppendTime`]").when(k == "boolean", "")
        .when((k == "number") & F.contains(x, F.lit("ratio")), "[`0`, `1.0`]")
        .when(k == "integer", F.when(F.contains(x, F.lit(".factor")), "integer (1 or greater)").when(F.contains(x, F.lit(".bytes")), "bytes (integer)").when(F.contains(x, F.lit(".ms")), "milliseconds (integer)").otherwise("integer"))
        .otherwise("")
    )
