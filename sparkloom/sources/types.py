"""Types and symbols of C++ sources with their scopes, as rows of files, and what joins make of them: aliases followed to their ends, defaults
expanded by position, and enumerations that validators imply. Scanners of one text find the rows; all that relates rows is joins."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cpp_default
from ..operators.joins import follow_aliases
from ..session import ship, stored
from .brackets import arguments, closing, inside, literal_end
from .readers import scan_rows
from .scanners import text_udf

# scopes --------------------------------------------------------------------------------------------------------------------------


def _blank(text: str) -> str:
    """The text with comments blanked out and literals filled with a sign that no source has, place by place."""
    out, i = [], 0
    while i < len(text):
        end = literal_end(text, i)
        if end > i and not text[i].isdigit():
            out.append(re.sub(r"[^\n]", " " if text[i] == "/" else "\x01", text[i:end]))
            i = end
        else:
            out.append(text[i : max(end, i + 1)])
            i = max(end, i + 1)
    return "".join(out)


_OPENING = re.compile(r"\bnamespace\s+([\w:]*)\s*\{|\b(struct|class)\s+(\w+)(?:\s+final)?\s*(?::[^;{()]*)?\{|\benum\s+(?:class\s+|struct\s+)?(\w+)\s*(?::\s*[\w:]+)?\s*\{|\busing\s+(\w+)\s*=\s*([^;]+);|\btypedef\s+([^;{}]+?)\s+(\w+)\s*;")
_FIELD = re.compile(r"(?:^|(?<=[;{}]))\s*((?:(?:const|static|inline|mutable|constexpr)\s+)*[\w:]+(?:<[^;=(){}]*>)?[\s&*]+)(\w+)\s*(?:=\s*([^;]+)|\{([^;]*)\})?;")


def _strings(text: str, enum: str, values: list[str]) -> dict[str, str]:
    """Texts of an enumeration's values: by a switch that returns or prints them, or by matches."""
    case = rf"case\s+(?:[\w:]+::)?(\w+)\s*:\s*(?:return\s+|[^;{{}}]*?<<\s*)(?:[\w:]+\s*\{{\s*)?\"([^\"]+)\""
    out: dict[str, str] = {}
    for m in re.finditer(rf"(?:\b{enum}_to_string|\bto_string(?:_view)?|operator<<)\s*\(([^)]*)\)\s*\{{", text):
        if m[0].startswith(f"{enum}_to_string") or re.search(rf"\b{enum}\b", m[1]):
            out |= {v: s for v, s in re.findall(case, inside(text, m.end() - 1)) if v in values}
    for m in re.finditer(rf"string_switch<(?:[\w:]+::)?{enum}>", text):
        out |= {v: s for s, v in re.findall(r"\.match\s*\(\s*\"([^\"]+)\"\s*,\s*(?:[\w:]+::)?(\w+)\s*\)", text[m.end() : text.find(";", m.end()) + 1 or len(text)]) if v in values}
    return out


def type_definitions(text: str) -> list[tuple]:
    """(kind, name, ordinal, item, type, detail) of structs, enumerations and aliases; names carry the namespaces and types around them [SRC19].

    A struct has a row for each field, with its type and default; an enumeration one for each value, with its text if some function or
    switch of the file gives one; an alias one with the type it stands for."""
    bare, out, scopes = _blank(text), [], []
    for m in _OPENING.finditer(bare):
        scopes = [s for s in scopes if s[1] > m.start()]
        scope = [s[0] for s in scopes if s[0]]
        own = lambda n, scope=scope: "::".join([*scope, n])
        if m[5] or m[8]:
            out.append(("alias", own(m[5] or m[8]), 0, None, " ".join((m[6] or m[7]).split()), None))
            continue
        end = closing(bare, m.end() - 1)
        if m[4]:
            values = [v for x in bare[m.end() : end].split(",") if (v := re.sub(r"=.*", "", x, flags=re.S).strip())]
            strings = _strings(text, m[4], values)
            out += [("enum", own(m[4]), i, v, None, strings.get(v)) for i, v in enumerate(values)]
            continue
        scopes.append((m[1] if m[2] is None else m[3], end))
        if m[2]:
            out += [("struct", own(m[3]), i, f, kind, default) for i, (kind, f, default) in enumerate(_fields(bare, text, m.end(), end))]
    return out


def _fields(bare: str, text: str, at: int, end: int) -> list[tuple]:
    """Fields of a body; what lies in braces that hold statements or types is left out. They are found in the bare text and read from the text itself."""
    shape, i = list(bare[at:end]), at
    while i < end:
        if bare[i] == "{":
            stop = closing(bare, i)
            if ";" in bare[i:stop] or re.search(r"\)\s*(?:const|noexcept|override|\s)*$|\b(?:struct|class|enum|union)\b[^;{}]*$", bare[at:i]):
                shape[i - at : stop + 1 - at] = ";" + " " * (stop - i)
            i = stop
        i += 1
    shape = re.sub(r"\b(?:public|private|protected)\s*:", lambda m: " " * (len(m[0]) - 1) + ";", ";" + "".join(shape)[: end - at])
    skipped = ("return", "using", "typedef", "friend", "struct", "class", "enum")
    out = []
    for f in _FIELD.finditer(shape):
        k = 3 if f[3] else 4
        default = text[at + f.start(k) - 1 : at + f.end(k) - 1].strip() if f[3] or f[4] else ""
        if f[1].split()[0] not in skipped:
            out.append((" ".join(f[1].split()), f[2], default or None))
    return out


DEFINITIONS = ("kind string, name string, ordinal int, item string, type string, detail string", [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()])


def definitions(files: DataFrame) -> DataFrame:
    """type_definitions() of files (path, contents)."""
    ship(files.sparkSession)
    return scan_rows(files.select("path", "contents"), "contents", type_definitions, *DEFINITIONS)


def alias_ends(found: DataFrame, hops: int = 8) -> DataFrame:
    """(name, type): each alias and the type at the end of its chain, by at most `hops` further aliases; an alias in a namespace is looked up there first [SRC19]."""
    edges = found.filter("kind = 'alias'").select("name", "type").distinct()
    home = F.concat(F.regexp_extract("name", r"^(.*::)?\w+$", 1), F.col("type"))
    known = edges.select(F.col("name").alias("there"), F.lit(True).alias("hit"))
    near = edges.join(known, home == F.col("there"), "left").select(F.col("name").alias("id"), F.when(F.col("hit"), home).otherwise(F.col("type")).alias("target"))
    return follow_aliases(near, hops=hops).select(F.col("id").alias("name"), F.col("at").alias("type"))


# defaults by position ---------------------------------------------------------------------------------------------------------------

#: Namespaces in which a type is looked for, in order, after the name as it stands; a product's own may be added by parameter.
NAMESPACES = ("config", "model", "security", "net", "kafka")
_CALL = "struct<name:string,args:array<string>>"


def _call(text: str) -> str:
    """A constructor call or braced initialiser as JSON of its type and arguments; null type for anything else."""
    import json

    x = text.strip()
    if x.startswith("{") and closing(x, 0) == len(x) - 1:
        x = x[1:-1].strip()
    m = re.match(r"[A-Za-z_][\w:]*(?:<[^(){}]*>)?\s*(?=[({])", x)
    if m and closing(x, m.end()) == len(x) - 1:
        return json.dumps({"name": m[0].strip(), "args": arguments(x[m.end() + 1 : -1])})
    return json.dumps({"name": None, "args": []})


def simple_value(text: Column) -> Column:
    """A literal without quotes, separators and scopes; null for nullopt [SRC35]."""
    x = F.trim(text)
    plain = F.when(x.rlike(r'^".*"$'), F.regexp_extract(x, r'(?s)^"(.*)"$', 1)).when(x.rlike(r"^(?:\w+::)+\w+$"), F.substring_index(x, "::", -1)).otherwise(cpp_default(x))
    return F.when(~x.isin("std::nullopt", "nullopt", ""), plain)


def expand_defaults(defaults: DataFrame, fields: DataFrame, namespaces: tuple[str, ...] = NAMESPACES, most: int = 20) -> DataFrame:
    """(id, path, value) of defaults (id, type, text) by the fields (type, ordinal, field, kind) of their types [SRC35, SRC36].

    A constructor's arguments are the values of its type's fields in order; a field without one is null, and leading underscores of names
    go. A type is looked for as it stands, then in the namespaces. An argument that is a constructor of the field's type, or of a type that is
    known, is expanded in turn, level by level. A call whose only argument is a constructor of another known type takes that one's fields
    for its own; its further fields are null. A value of any other type stays as it is written, but for quotes and the like. Types are
    joined at each level, so one type that all defaults have is a key with a row for each field and is not gathered."""
    ship(defaults.sparkSession)
    fields = fields.select("type", "ordinal", F.regexp_replace("field", "^_+", "").alias("field"), "kind")
    types = stored(fields.groupBy("type").agg(F.count("*").alias("n")))
    call = text_udf(_call)

    def resolved(rows: DataFrame) -> DataFrame:
        """Adds `at`, the known type of a row, and its call."""
        rows = rows.withColumn("call", F.from_json(call("text"), _CALL))
        names = F.concat(F.array("type"), F.array(*(F.concat(F.lit(f"{n}::"), F.col("type")) for n in namespaces)))
        tried = rows.select("id", "path", F.posexplode(F.when(F.col("type").isNotNull() & F.col("call.name").isNotNull(), names)).alias("rank", "name")).join(types.select(F.col("type").alias("name")), "name")
        found = tried.groupBy("id", "path").agg(F.min_by("name", "rank").alias("at"))
        return rows.join(found, ["id", "path"], "left")

    level = stored(resolved(defaults.select("id", F.array().cast("array<string>").alias("path"), "type", "text")))
    out = None
    for _ in range(most):
        leaves = level.filter("at is null").select("id", "path", simple_value(F.col("text")).alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        open_ = level.filter("at is not null")
        if open_.isEmpty():
            return out
        # a single argument that is a constructor of another known type takes the place of its parent
        alone = open_.filter(F.size("call.args") == 1).select("id", "path", F.col("at").alias("parent"), F.get("call.args", F.lit(0)).alias("text"))
        alone = alone.withColumn("type", F.from_json(call("text"), _CALL)["name"]).join(types.select("type"), "type").filter(F.col("type") != F.col("parent"))
        first = fields.filter("ordinal = 0").select(F.col("type").alias("parent"), F.col("kind").alias("k0"))
        alone = alone.join(first, "parent", "left").filter(~F.col("type").eqNullSafe(F.col("k0")) & ~F.exists(F.array(*(F.concat(F.lit(f"{n}::"), F.col("k0")) for n in namespaces)), lambda k: k.eqNullSafe(F.col("type"))))
        alone = stored(alone.select("id", "path", "parent", "type", "text"))
        taken = alone.join(fields.select("type", "field"), "type").select("id", "path", "field")
        bare = alone.join(fields.filter("ordinal > 0").withColumnRenamed("type", "parent").select("parent", "field"), "parent").join(taken, ["id", "path", "field"], "left_anti")
        out = out.unionByName(bare.select("id", F.concat("path", F.array("field")).alias("path"), F.lit(None).cast("string").alias("value")))
        rest = open_.join(alone.select("id", "path"), ["id", "path"], "left_anti")
        inner = rest.select("id", "path", F.col("at").alias("of"), "call").join(fields.withColumnRenamed("type", "of"), "of")
        child = inner.select("id", F.concat("path", F.array("field")).alias("path"), F.col("kind").alias("type"), F.coalesce(F.get("call.args", F.col("ordinal")), F.lit("nullopt")).alias("text"))
        level = stored(resolved(child.unionByName(alone.select("id", "path", "type", "text"))))
    raise ValueError(f"a default is deeper than {most} levels")


# enumerations from validators -------------------------------------------------------------------------------------------------------

_CHECKED = re.compile(r"std::ranges::contains\s*\(\s*([\w:]+)\s*,|std::(?:find|count)\w*(?:::\w+)?\s*\(\s*([\w:]+)\.begin\(\)")


def symbols(text: str) -> list[tuple]:
    """(kind, name, ordinal, value): what validators check against, elements of constant arrays, constants of text, what functions compare with and are called with, and the names of classes [U3]."""
    out = []
    for m in re.finditer(r"\b(\w+)\s*\([^(){};]*(?:\([^()]*\)[^(){};]*)*\)\s*(?:const\s*|noexcept\s*)*\{", text):
        if m[1] in ("if", "for", "while", "switch", "catch"):
            continue
        body = inside(text, m.end() - 1)
        if hit := _CHECKED.search(body):
            out.append(("checks", m[1], 0, (hit[1] or hit[2]).rpartition("::")[2]))
        if re.search(r"validat|check", m[1]):
            out += [("compares", m[1], i, c.removesuffix("::name").rpartition("::")[2]) for i, (_, c) in enumerate(re.findall(r"(\w+)\s*!=\s*([\w:]+::name)\b", body))]
        for call in re.finditer(r"\b(\w*(?:validat|check)\w*)\s*\(", body):
            out += [("called", call[1], 0, p) for p in re.findall(r"\b(\w+)\s*\(", inside(body, call.end() - 1))]
    for m in re.finditer(r"\bconstexpr\s+(?:auto|[\w:]+<[^;={]*>)\s+(\w+)\s*(?:=\s*(?:std::to_array(?:<[^;({]*>)?\s*\(\s*)?)?\{", text):
        out += [("element", m[1], i, e) for i, e in enumerate(arguments(inside(text, m.end() - 1).strip().removeprefix("{").removesuffix("}")))]
    for m in re.finditer(r'\b(\w+)\s*(?:=\s*|\{\s*|\(\s*)"([^"]*)"\s*[})]?\s*;', text):
        out.append(("text", m[1], 0, m[2]))
    for m in re.finditer(r"\b(?:struct|class)\s+(\w+)[^;{]*\{", text):
        if hit := re.search(r'\bname\s*(?:=\s*|\{\s*)"([^"]+)"', inside(text, m.end() - 1)):
            out.append(("class", m[1], 0, hit[1]))
    return out


#: A join whose sides both meet by shuffle, whatever size the planner guesses for them.
_MERGE = "merge"
SYMBOLS = ("kind string, name string, ordinal int, value string", [pa.string(), pa.string(), pa.int32(), pa.string()])


def validator_enums(settings: DataFrame, files: DataFrame) -> DataFrame:
    """(name, ordinal, value, licensed) of settings (name, base_type, params) [U3's last two transformers].

    A list setting whose argument from the fifth on names a validator takes the elements of the array that this function checks against;
    elements of the array of the same name with enterprise_ for supported_ are licensed. A text setting without a validator takes the
    names of the classes that a function compares with which some file calls with the setting's value. An element that is a name is a
    constant of the array's own file, else it stays. Functions, arrays, constants and classes are a table of symbols over all files; each
    step is a join by name. Rows exploded from a table and rows of one kind count as the whole table or less in the planner's guess, so all
    joins are merges: else the names of all settings would pass through the driver as a broadcast."""
    ship(files.sparkSession)
    table = stored(scan_rows(files.select("path", "contents"), "contents", symbols, *SYMBOLS))
    of = lambda kind: table.filter(F.col("kind") == kind)
    like = lambda p: p["value"].rlike("validate|validator")
    late = F.slice("params", 5, F.greatest(F.size("params") - 4, F.lit(0)))
    named = F.get(F.filter(late, lambda p: like(p) & p["kind"].isin("identifier", "qualified_identifier", "call_expression")), F.lit(0))["value"]
    lists = settings.filter(F.col("base_type").contains("vector") & (F.size("params") >= 5)).select("name", F.regexp_replace(F.regexp_replace(named, r"[&\s]|\(.*", ""), r"^.*::", "").alias("validator")).filter("validator is not null")
    arrays = lists.hint(_MERGE).join(of("checks").groupBy(F.col("name").alias("validator")).agg(F.min_by("value", "path").alias("array")), "validator").select("name", "array")
    first = of("element").groupBy(F.col("name").alias("array")).agg(F.min("path").alias("path"))
    texts = of("text").groupBy("path", F.col("name").alias("key")).agg(F.min("value").alias("text"))
    elements = of("element").withColumnRenamed("name", "array").join(first.hint(_MERGE), ["array", "path"]).withColumn("key", F.substring_index("value", "::", -1)).join(texts.hint(_MERGE), ["path", "key"], "left")
    quoted = F.when(F.col("value").startswith('"'), F.regexp_replace("value", '^"|"$', ""))
    elements = stored(elements.select("array", "ordinal", F.coalesce(quoted, "text", "value").alias("value")))
    licensed = elements.filter(F.col("array").contains("enterprise_")).select(F.replace("array", F.lit("enterprise_"), F.lit("supported_")).alias("array"), "value", F.lit(True).alias("licensed")).distinct()
    by_list = arrays.join(elements.hint(_MERGE), "array").join(licensed.hint(_MERGE), ["array", "value"], "left").select("name", "ordinal", "value", F.coalesce("licensed", F.lit(False)).alias("licensed"))

    plain = settings.filter(F.col("base_type").contains("string") & ~F.col("base_type").rlike("vector|array") & (F.size("params") > 0) & ~F.exists(late, like)).select("name")
    calls = of("called").select(F.col("value").alias("name"), F.col("name").alias("function"), "path").distinct()
    compared = of("compares").select("path", F.col("name").alias("function"), "ordinal", F.col("value").alias("class"))
    names = of("class").groupBy(F.col("name").alias("class")).agg(F.min_by("value", "path").alias("value"))
    found = plain.join(calls.hint(_MERGE), "name").join(compared.hint(_MERGE), ["path", "function"]).join(names.hint(_MERGE), "class")
    return by_list.unionByName(found.groupBy("name", "value").agg(F.min("ordinal").alias("ordinal")).select("name", "ordinal", "value", F.lit(False).alias("licensed")))
