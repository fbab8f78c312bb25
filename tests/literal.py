"""Literal inputs with the values expected of them: functions, scans, sinks and small operators.

The SQL of each is the list of the values expected, written out; it says nothing of how they come about. Rows are (op, item, got): the
operator's id in the survey, what it was given or which row, and what came out, as text."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import scalars as S
from sparkloom.functions import text as T
from sparkloom.operators import aggregates as A
from sparkloom.operators import diffs as D
from sparkloom.operators import filters as FL
from sparkloom.operators import joins as J
from sparkloom.operators import ordered as O
from sparkloom.operators import sets as SETS
from sparkloom.operators import trees as TR
from sparkloom.session import own_folder, ship
from sparkloom.sources import cpp, scanners, sinks
from sparkloom.sources import readers as R
from sparkloom.streaming import records

QUERIES: dict = {}
SQL: dict = {}


def text_of(v) -> str | None:
    return None if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v)


def quoted(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def values(rows: Iterable[tuple]) -> str:
    return 'SELECT CAST(op AS VARCHAR) AS op, CAST(item AS VARCHAR) AS item, CAST(got AS VARCHAR) AS got FROM (VALUES\n' + ",\n".join("(" + ", ".join(quoted(text_of(v)) for v in r) + ")" for r in rows) + ") t(op, item, got)"


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def told(op: str, df: DataFrame, item: str | Column, *got: str | Column) -> DataFrame:
    """Rows of df as (op, item, got); several values are put apart by a bar, null is a tilde."""
    one = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    shown = one(got[0]) if len(got) == 1 else F.concat_ws("|", *(F.coalesce(one(c), F.lit("~")) for c in got))
    return df.select(F.lit(op).alias("op"), one(item).alias("item"), shown.alias("got"))


# functions of one text: id -> (function, input -> output) -----------------------------------------------------------------------

FUNCTIONS: list[tuple[str, Callable, dict]] = [
    ("SC-S1", T.decode_entities, {"&#233;&#x41;": "éA", "&amp;lt;": "<", "&lt;b&gt; &quot;&apos;": "<b> \"'", "&#8364;x&#65": "€x&#65", "": "", "a&nbsp;": "a&nbsp;"}),
    ("SC-S2", T.collapse_space, {" a \n\t b ": "a b"}),
    ("SC-S4", lambda c: T.strip_metadata(c, "See (all)."), {"<!-- Source: x -->\ntext\n> See (all). more\n<!-- mine -->": "text\n\n<!-- mine -->"}),
    ("SC-S5", lambda c: T.truncate_at_newline(c, 5), {"abc": "abc", "ab\ncdef": "ab", "abcdefg": "abcde"}),
    ("T12", lambda c: T.truncate_at_newline(c, 8), {"one\ntwo\nthree": "one\ntwo"}),
    ("SC-S7", T.cap_sentences, {"One, e.g. this. Two 1.5. Three.": "One, e.g. this. Two 1.5.", "See http://a.b/c. End": "See http://a.b/c. End"}),
    ("SC-S8", T.first_sentence, {"Use 1.5 of it. Then": "Use 1.5 of it.", "No end\n\nSecond. x": "No end", "Line\n  two. x": "Line two.", "v1.2": "v1.2"}),
    ("SC-S8 list", T.truncate_sentences, {"A [b](c). *D*! E?": "A b.  D!", "none": "none"}),
    ("SC-S10", lambda c: T.sentence_case(c, ("API",)), {"The Big api Guide": "The big API guide"}),
    ("SC-S12", T.property_anchor, {"a.b.c": "a-b-c"}),
    ("SC-S14", T.link_text, {"xref:a.adoc[b] [c]  d": "b c d"}),
    ("SC-S15", T.escape_html, {"<a&'\">": "&lt;a&amp;&#39;&quot;&gt;"}),
    ("SC-S16", T.dashify, {"tool a b": "tool-a-b"}),
    ("SC-S16 up", T.parent_path, {"a b c": "a b", "a": ""}),
    ("SC-S17", T.capitalize, {"abc dEf": "Abc dEf", "": ""}),
    ("SC-S19", T.unit_of, {"retention_ms": "milliseconds", "x_partitions": "number of partitions per topic", "plain": "", "": ""}),
    ("SC-S20", T.format_default, {"null": "`null`", "3600000": "`3600000` (1h)", "90000": "`90000` (1.5m)", "999": "`999`", '"a"': '`"a"`', "[]": "`[]`", "[1,2]": "`[2 items]`", "true": "`true`"}),
    ("SC-S21", lambda c: T.replace_all(c, [("a+", "b"), ("bb", "c")]), {"aab": "c", "xab": "xc"}),
    ("U5", lambda c: T.replace_all(c, [(r"\s+$", "")]), {"x  ": "x"}),
    ("U6", lambda c: T.replace_all(c, [("{v}", "1.2")], regex=False), {"v{v}": "v1.2"}),
    ("SC-J attributes", lambda c: T.expand_attributes(c, {"a": "1", "b": "{a}"}), {"{b}{a}{c}": "{a}1{c}"}),
    ("SC-J pointer", T.pointer_unescape, {"a~1b~0c": "a/b~c", "~01": "~1"}),
    ("SC-S27", lambda c: T.alias_spec(c, F.lit("c"), F.lit("1.0"), F.lit("M")).cast("string"), {"a.adoc": "{M, a.adoc}", "m:a": "{m, a.adoc}", "c:m:a.adoc": "{m, a.adoc}", "x:m:a.adoc": None, "2.0@a": None, "": None, "a:b:c:d": None, ":a": "{M, a.adoc}"}),
    ("SC-S28", lambda c: T.resource_id(c).cast("string"), {"1.0@c:m:partial$a.adoc": "{1.0, c, m, partial, a.adoc}", "a.adoc": "{null, null, null, null, a.adoc}"}),
    ("SC-S29", lambda c: T.commercial_names(c, {"x": "Ex"}, [("aws_", "AWS")]), {"aws_s3": "AWS", "x": "Ex", "y": "y"}),
    ("SC-S30", lambda c: T.first_reference_only(c, "a", "prop:a[]"), {"`a` and `a`": "prop:a[] and `a`", "none": "none"}),
    ("SC-S32", lambda c: T.helm_path(F.lit("n"), c), {"broker": "config.node.n", "cluster": "config.cluster.n", "topic": None}),
    ("SC-S35", T.collapse_blank_lines, {"a\n\n\n\nb": "a\n\nb"}),
    ("SC-S36", T.sanitize_version, {"v1.2.3 (x)": "v1.2.3x"}),
    ("SC-S38", T.clean_url_breaks, {"x​ https://a​b–c y–z": "x​ https://ab-c y–z"}),
    ("SC-S40", T.cpp_default, {"1'024ULL": "1024", "std::nullopt": "null", "{5}": "5"}),
    ("SC-S41", T.json_type, {"std::optional<int32_t>": "integer", "ss::sstring": "string", "std::vector<x>": "array", "bool": "boolean", "double": "number", "std::chrono::milliseconds": "integer", "x::y": "object"}),
    ("SC-S42", lambda c: T.badge(c, F.lit('a "tip"')), {"New": '<span class="badge badge--medium" title="a &quot;tip&quot;">New</span>'}),
    ("U2", lambda c: T.badge(c, F.lit("t"), "large"), {"<b>": '<span class="badge badge--large" title="t">&lt;b&gt;</span>'}),
    ("SC-V4", S.normal_tag, {"1.2.3": "v1.2.3", " v4.5.6": "v4.5.6"}),
    ("SC-V5", S.removes_deprecated, {"v26.1.0": True, "25.3.9": False, "dev": True, "27": True, "26.0": False}),
    ("SC-V6", lambda c: S.version_at_least(c, F.lit("1.10")), {"1.9": False, "1.10.0": True, "v2": True}),
    ("SC-D2", lambda c: S.epoch_date(c.cast("long") if isinstance(c, Column) else F.col(c).cast("long")), {"0": "1970-01-01", "86400": "1970-01-02"}),
    ("SC-D5", lambda c: S.uptime(F.col(c)), {"3661": "1h 1m", "59": "0h 0m"}),
    ("SC-M4", lambda c: S.int_bounds(c).cast("string"), {"uint64_t": "{0, 18446744073709551615}", "int8_t": "{-128, 127}", "x": None}),
    ("SC-M6", lambda c: S.retry_delay(F.col(c).cast("int"), jitter=F.lit(0.5)), {"0": "1150", "1": "2300", "9": "11500"}),
    ("T10", S.canonical, {'{"b":1,"a":{"d":1,"c":2}}': '{"a":{"c":2,"d":1},"b":1}', "1": "1.0", "1e0": "1.0", '"1"': '"1"', "1d": "1d", "NaN": "NaN"}),
    ("DIFF6", lambda c: S.json_equal(c, F.lit("1")), {"1.0": True, "1d": False, '"1"': False, "01": False}),
    ("F6", lambda c: FL.unpublished(F.create_map(F.col(c), F.lit("y")), F.lit(False)), {"page-unpublish": True, "page-publish-only-during-beta": True, "other": False}),
    ("F16", lambda c: FL.under_any(c, ["a b"]), {"a b": True, "a b c": True, "a bc": False}),
    ("F34", lambda c: FL.under_any(c, ["x"], "/"), {"x/y": True, "xy": False}),
    ("F15", lambda c: FL.public_property(c, F.lit(False)), {"_x": False, "x": True}),
    ("F21", FL.problematic, {"a TODO b": True, "{{x}}": True, "todos": False}),
    ("F23", lambda c: FL.listed_page(c, F.lit("/u"), ["/d"]), {"404.adoc": False, "a/index.adoc": False, "b.adoc": True}),
    ("F26", lambda c: FL.retryable(F.col(c).cast("int"), F.lit("x")), {"403": True, "429": True, "500": True, "404": False}),
    ("F30", FL.truthy_flag, {"Yes": True, "ok": True, "1": True, "on": False}),
    ("F35", FL.override_action, {"short": "replace", "x" * 60 + "\n\n" + "y" * 60: "append"}),
    ("F36", lambda c: FL.drop_examples(c, ["secret"]), {"# set secret\nrun --x\n\n\n\n# other\nrun secret\nkeep": "\n\nkeep"}),
    ("F11", lambda c: FL.expired(F.col(c).cast("timestamp"), F.lit("2024-01-02").cast("timestamp")), {"2024-01-01": True, "2024-01-02": False, "2024-01-03": False}),
    ("F5", lambda c: FL.external(c, ["docs.x.y"]), {"Docs.X.y": False, "other": True}),
    ("SC-S33", lambda c: cpp.category(c, "acme"), {"retention.ms": "retention-compaction", "segment.ms": "segment-message", "write.caching": "performance-cluster", "acme.remote.read": "tiered-storage", "acme.remote.readreplica": "remote-read-replica", "acme.iceberg.mode": "iceberg-integration", "confluent.key.schema.validation": "schema-registry", "x": "other"}),
    ("SC-S34", lambda c: cpp.topic_type(c, "acme"), {"acme.remote.readreplica": "string", "acme.iceberg.delete": "boolean", "acme.remote.write": "boolean", "delete.retention.ms": "string", "retention.ms": "integer", "replication.factor": "integer", "min.cleanable.dirty.ratio": "number", "cleanup.policy": "string"}),
    ("SC-S34 values", lambda c: cpp.acceptable_values(c, cpp.topic_type(c, "acme"), ["none", "gzip", "count", "producer"], ["none", "deletion", "compaction"]), {"compression.type": "[`producer`, `none`, `gzip`]", "cleanup.policy": "[`delete`, `compact`, `compact,delete`]", "message.timestamp.type": "[`CreateTime`, `LogAppendTime`]", "write.caching": "", "min.cleanable.dirty.ratio": "[`0`, `1.0`]", "replication.factor": "integer (1 or greater)", "retention.bytes": "bytes (integer)", "segment.ms": "milliseconds (integer)", "x": ""}),
    ("SC-S25 path", T.url_path, {"https://a.b/c?d#e": "/c", "https://a.b/": "", "/x?y": "/x?y", "nonsense": ""}),
]


def function_values(spark: SparkSession, d: str) -> DataFrame:
    """Functions of one text [see FUNCTIONS]."""
    parts = []
    for op, f, table in FUNCTIONS:
        df = spark.createDataFrame([(k,) for k in table], "x string")
        parts.append(told(op, df, "x", f("x")))
    return union(parts)


QUERIES["function_values"] = function_values
SQL["function_values"] = values((op, k, v) for op, _, table in FUNCTIONS for k, v in table.items())


# scanners of one text: id -> (function, text, rows) -----------------------------------------------------------------------------

_GO = 'a := &cobra.Command{ Use: "x [flags]", Run: func() { a("}") }, Hidden: true }\nb := &cobra.Command{Use: "y", Deprecated: "use z"}\nc := &cobra.Command{Use: "ok"}\ncmd.AddCommand(out.DeprecateCmd(newOld(fs), "tool new"))'
_URLS = "**https://a.b/c**, and `https://code` or link:https://l.m[two\nlines].\n----\nhttps://in.block\n....\n----\n:url: https://attr.x\nimage:d.png[link=https://v.w]"
_TOPICS = 'inline constexpr std::string_view topic_property_a = "ret.ms";\nconstexpr string_view topic_property_b{"ret.ms"};\nconst std::string topic_property_c = "c.ms";\nstatic const char* topic_property_d = "d.ms";\nx("segment.size")'
_HEADER = 'struct conf : store {\n  // property<int> not_this;\n  property<std::optional<int32_t>> a;\n  enterprise<property<bool>> b;\n  bounded_property<std::chrono::milliseconds,\n    numeric> c;\n  int other;\n};'
_SOURCE = 'conf::conf() : a(*this, "a_name", "What a is for, with \\"quotes\\".", {.needs_restart = needs_restart::no, .visibility = visibility::tunable}, std::nullopt)\n, b(*this, true, "b", "Text in " "two parts here.", meta{.aliases = {"b_old", "b_older"}}, false)\n, c(*this, "c", "How long it may take.", {}, 30s, [](auto v) { return f(v, 1); }) {}'

SCANS: list[tuple[str, Callable, str, list[tuple]]] = [
    ("SRC22", scanners.hidden_commands, _GO, [("x", True, None), ("y", False, "use z"), ("newOld", False, "tool new")]),
    ("SRC20", cpp.topic_settings, _TOPICS, [("topic_property_a", "ret.ms"), ("topic_property_c", "c.ms"), ("topic_property_d", "d.ms"), ("topic_property_segment_size", "segment.size")]),
    ("SRC20 ignored", cpp.ignored_settings, 'allowlist_topic_noop_confs = {\n"a.b", // x\n"c"}', [("a.b",), ("c",)]),
    ("SRC20 defaults", cpp.topic_defaults, 'add_topic_config_if_requested(k, config::shard_local_cfg().log_ms.name(), x, topic_property_ms, config::shard_local_cfg().log_ms.desc()); add_topic_config_if_requested(k, topic_property_b, f(config::shard_local_cfg() .one.name(), config::shard_local_cfg().two.name()));', [("topic_property_ms", "log_ms", 0), ("topic_property_b", "one", 0), ("topic_property_b", "two", 1)]),
    ("SRC15", cpp.header_settings, _HEADER, [("a", "property<std::optional<int32_t>>", "property<std::optional<int32_t>> a;"), ("b", "enterprise<property<bool>>", "enterprise<property<bool>> b;"), ("c", "bounded_property<std::chrono::milliseconds, numeric>", "bounded_property<std::chrono::milliseconds, numeric> c;")]),
    ("SRC16", cpp.source_arguments, 'x(*this, "n", R"(raw "text")", ns::f<int>(1, 2), {.a = b::c}, model::mode::fast, -5)', [("x", 0, "string_literal", "n"), ("x", 1, "string_literal", 'raw "text"'), ("x", 2, "call_expression", "ns::f<int>(1, 2)"), ("x", 3, "initializer_list", "{.a = b::c}"), ("x", 4, "qualified_identifier", "model::mode::fast"), ("x", 5, "number_literal", "-5")]),
    ("SRC18", cpp.named_constants, 'namespace kafka {\nconstexpr std::string_view a{"x"};\nstd::string_view b() { return "y"; }\n}\ninline const model::topic c("z");\nconst model::ns d("w");\nconst model::topic_partition e{model::topic{"t"}, p};', [("a", "x"), ("kafka::a", "x"), ("b", "y"), ("kafka::b", "y"), ("c", "z"), ("d", "w"), ("e.topic", "t")]),
    ("SRC19", scanners.struct_fields, "struct conf { int a = 5; // x\n std::optional<int> b; };", [("conf", 0, "int", "a", "5"), ("conf", 1, "std::optional<int>", "b", None)]),
    ("SRC23", R.help_flags, "Usage:\n\nFlags:\n  -h, --help            Help text\n      --size int        The size\n                        of it (default 10)\nGlobal Flags:\n      --verbose\n", [("help", "h", "bool", None, "Help text"), ("size", "", "int", "10", "The size of it"), ("verbose", "", "bool", None, "")]),
    ("SRC24", scanners.document, "= Title\n:attr: v\nintro\n\n== One\nx\n----\n== not\n----\n", [("attribute", 0, "attr", "v"), ("title", 0, "Title", "intro"), ("section", 1, "One", "x\n----\n== not\n----")]),
    ("SC-S31", scanners.document, "== Only\nbody", [("section", 1, "Only", "body")]),
    ("SRC27", R.commented_values, "# top\na:\n  # -- inner\n  b: 1\nc: 2\n", [("a", "top"), ("a.b", "inner")]),
    ("SRC38", R.sections, "intro\nUSAGE\nbody\n$ RUN THIS\nNOTES:\nx", [("", "intro"), ("USAGE", "body\n$ RUN THIS"), ("NOTES", "x")]),
    ("SC-S24", R.content_urls, _URLS, [("https://a.b/c", None, 2, 15, False, False, False), ("https://l.m", "two lines", 41, 68, True, False, False), ("https://attr.x", None, 108, 122, False, True, False), ("https://v.w", None, 140, 151, False, False, True)]),
    ("SC-S22 numbered", lambda x: [(scanners.numbered_lists(x),)], "  1. a\n  2. b\n  4. c\nx", [(". a\n. b\n  4. c\nx",)]),
    ("SC-S22 tables", lambda x: [(scanners.indented_tables(x),)], "  a  b\n  c  d\n  alone here", [("|===\n|a |b\n|c |d\n|===\n  alone here",)]),
    ("SC-S22 code", lambda x: [(scanners.code_blocks(x),)], "t\n\n    run x\n    y\nz", [("t\n\n----\nrun x\ny\n----\nz",)]),
    ("SC-S22 definitions", lambda x: [(scanners.definition_lists(x),)], "all:\n  every one\n  of them\nnone\n  not any\nend", [("all:: every one of them\nnone:: not any\nend",)]),
    ("SC-S22", lambda x: [(scanners.description(x),)], "Text.\n\n  1. a\n  2. b\n\n\n\n    run x\n", [("Text.\n\n. a\n. b\n\n----\nrun x\n----",)]),
    ("SC-S23", lambda x: [(scanners.markdown(x),)], "<article><h1>T</h1><p>a <b>b</b> <code>c</code> <a href='/x'>l</a></p><ul><li>i</li><li>j</li></ul><pre>x  y</pre></article>", [("# T\n\na **b** `c` [l](/x)\n- i\n- j\n\n```\nx  y\n```",)]),
    ("SC-S30", lambda x: [(scanners.first_mentions(x, {"a": "prop:a[]"}),)], "`a` and `a`\n`a`\n\n`a`\n* `a`", [("prop:a[] and `a`\n`a`\n\nprop:a[]\n* prop:a[]",)]),
    ("SRC35", lambda x: [(v,) for v in scanners.arguments(x)], 'a, f(b, c), "x,y", {1, 2}', [("a",), ("f(b, c)",), ('"x,y"',), ("{1, 2}",)]),
    ("SRC35 values", lambda x: [(scanners.cpp_value(v),) for v in x.split("\n")], 'std::nullopt\nss::sstring("q")\nstd::chrono::seconds{30}\nmodel::mode::fast\n1\'000u\n{1, 2}', [(None,), ("q",), ("30 seconds",), ("fast",), ("1000",), ("[1, 2]",)]),
    ("SRC36", lambda x: [(json.dumps(scanners.resolve_type(x, {"model::mode": {"$ref": "#/definitions/config::real"}, "config::real": {"type": "string"}})),)], "mode", [('{"type": "string"}',)]),
    ("F20", lambda x: [(p, scanners.schema_allows(json.loads(x), p)) for p in ("a.b", "a.c", "r.any", "x-1", "q")], '{"properties": {"a": {"properties": {"b": {}}, "additionalProperties": false}, "r": {"$ref": "x"}}, "patternProperties": {"^x-": {}}, "additionalProperties": false}', [("a.b", True), ("a.c", False), ("r.any", True), ("x-1", True), ("q", False)]),
    ("REC2", lambda x: TR.dotted_fields(json.loads(x)), '[{"name": "a", "kind": "array", "children": [{"name": "b", "type": "int"}, {"name": "c", "is_deprecated": true}]}]', [("a[]", ""), ("a[].b", "int")]),
    ("REC3", lambda x: [(json.dumps(TR.resolve(json.loads(x), json.loads(x))["use"], sort_keys=True),)], '{"d": {"a": {"x": 1, "y": 2}}, "use": {"$ref": "#/d/a", "y": 3}}', [('{"x": 1, "y": 3}',)]),
    ("REC6", lambda x: [(json.dumps(TR.deep_merge(*json.loads(x))),)], '[[{"name": "a", "v": 1}], [{"name": "a", "w": 2}]]', [('[{"name": "a", "v": 1, "w": 2}]',)]),
    ("REC8", lambda x: [(json.dumps(TR.rewrite_strings(json.loads(x), str.upper)),)], '{"a": ["b", 1]}', [('{"a": ["B", 1]}',)]),
    ("REC9", lambda x: [(json.dumps(TR.wrap_ref_siblings(json.loads(x))),)], '{"$ref": "x", "d": 1}', [('{"allOf": [{"$ref": "x"}], "d": 1}',)]),
    ("SNK13", lambda x: [(sinks.insert_version(x, "p", "v1"),), (sinks.insert_version(x, "q", "v1"),)], '{\n  "properties": {\n    "p": {\n      "type": 1\n    }\n  }\n}', [('{\n  "properties": {\n    "p": {\n      "version": "v1",\n      "type": 1\n    }\n  }\n}',), (None,)]),
]


def _row(x: tuple) -> str:
    return "|".join("~" if v is None else text_of(v) for v in x)


def scanner_values(spark: SparkSession, d: str) -> DataFrame:
    """Scanners and walks of one text, run over Arrow batches [see SCANS]."""
    import pyarrow as pa

    ship(spark)
    kinds = [pa.string(), pa.string(), pa.string()]
    parts = []
    for op, f, text, _ in SCANS:
        df = spark.createDataFrame([(text,)], "contents string")
        one = lambda x, f=f, op=op: [(op, str(i), _row(r)) for i, r in enumerate(f(x))]
        parts.append(R.scan_rows(df, "contents", one, "op string, item string, got string", kinds))
    return union(parts)


QUERIES["scanner_values"] = scanner_values
SQL["scanner_values"] = values((op, i, _row(r)) for op, _, _, rows in SCANS for i, r in enumerate(rows))


# settings declared in C++ -------------------------------------------------------------------------------------------------------

_REGISTRY = [
    ("a", "a_name", "What a is for, with \"quotes\".", "integer", "int32_t", True, False, "tunable", "-2147483648", "2147483647", "null", "", False),
    ("b", "b", "Text in two parts here.", "boolean", "bool", False, True, None, None, None, "false", "b_old,b_older", True),
    ("c", "c", "How long it may take.", "integer", "std::chrono::milliseconds", False, True, None, "-17592186044416", "17592186044415", '"30s"', "", False),
]


def cpp_registry(spark: SparkSession, d: str) -> DataFrame:
    """Declarations and arguments of C++ sources through all transformers [U3, SRC15, SRC16]."""
    ship(spark)
    found = cpp.settings(spark.createDataFrame([("h", _HEADER)], "path string, contents string"), spark.createDataFrame([("/x/src/c.cc", _SOURCE)], "path string, contents string"))
    got = cpp.registry(found)
    return got.select("name_in_file", "name", "description", F.col("shown_type").alias("type"), "c_type", "nullable", "needs_restart", "visibility", F.col("minimum").cast("string").alias("minimum"), F.col("maximum").cast("string").alias("maximum"), "default_json", F.array_join("aliases", ",").alias("aliases"), "is_enterprise")


QUERIES["cpp_registry"] = cpp_registry
SQL["cpp_registry"] = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(("true" if v else "false") if isinstance(v, bool) else quoted(v) for v in r) + ")" for r in _REGISTRY) + ") t(name_in_file, name, description, type, c_type, nullable, needs_restart, visibility, minimum, maximum, default_json, aliases, is_enterprise)"


# scans of files -----------------------------------------------------------------------------------------------------------------


def file_scans(spark: SparkSession, d: str) -> DataFrame:
    """Inputs written as files in the shared folder and read back by the scans [SRC1 to SRC11, SRC17, SRC18, SRC21, SRC25, SRC28, SRC29, SRC33, SRC34, SRC37]."""
    ship(spark)
    folder = own_folder(spark)

    def file(name: str, text: str) -> str:
        spark.createDataFrame([(x,) for x in text.split("\n")], "value string").coalesce(1).write.text(f"{folder}/{name}")
        return f"{folder}/{name}"

    frame = spark.createDataFrame
    csv = file("csv", 'name, type, commercial_name, support, cloud\nkafka, input, "Kafka, x", enterprise, y\n\n , input, z, , n\nfile, output, , , ')
    a = file("a", json.dumps({"properties": {"p": {"type": "integer", "default": None}, "q": {"description": "d"}}, "definitions": {"x": {"type": "object"}}}))
    b = file("b", json.dumps({"p": {"type": "integer"}, "other": {"z": 1}, "definitions": {"type": "object"}}))
    c = file("c", json.dumps({"inputs": [{"name": "a"}, {"name": "b"}], "version": "1", "outputs": []}))
    sinks.write_versions(frame([("x", "v1"), ("y", "v2")], "name string, version string"), f"{folder}/versions")
    sources = frame([("p", "constexpr int limit{7};\nconstexpr std::string_view n{\"v\"};", 0), ("q", "constexpr int limit = 8;", 1)], "path string, contents string, ordinal int")
    files = frame([("a/x.h",), ("a/x.cc",), ("b.hpp",), ("c.cc",)], "path string")
    page = lambda loc, title, no: (f"playground/{loc}", title, "in", "map", no)
    samples = frame([page("a", "T", 1), page("b", "T", 0), page("c", None, 2), ("other/d", "U", "in", "map", 3), page("e", "S", 4)], "path string, title string, input string, mapping string, ordinal int")
    tables = [frame([("u", "page", 0)], "key string, v string, ordinal int"), frame([("u", "alias", 0), ("w", "late", 1), ("w", "early", 0)], "key string, v string, ordinal int")]
    parts = [
        told("SRC1", R.connectors_csv(spark, csv), "name", "type", "commercial_name", "support", "cloud"),
        told("SRC4", R.enterprise_plugins(spark, csv), "name", F.lit("enterprise")),
        told("SRC5", R.properties(R.json_documents(spark, a)), "name", "type", "description", "default_json"),
        told("SRC5 root", R.properties(R.json_documents(spark, b)), "name", "type"),
        told("SRC6", R.connector_index(R.json_documents(spark, c)), "name", "type"),
        told("SRC7", spark.read.json(f"{folder}/versions").filter("version = 'v2'"), "name", "version"),
        told("SRC9", R.samples(samples), "title", "path"),
        told("SRC10", J.precedence(tables, "key"), "key", "v"),
        told("SRC11", R.sitemap(frame([('<?xml version="1.0"?><urlset><url><loc>https://a</loc><lastmod>2024</lastmod></url><url><loc> https://b </loc></url></urlset>',)], "contents string")), "ordinal", "loc", "lastmod"),
        told("SRC17", R.file_pairs(files), "stem", "header", "source"),
        told("SRC18", R.constants(sources), "name", "value"),
        told("SRC26", R.enums(frame([("enum class color : uint8_t { red = 0, // x\n green, blue };",)], "contents string")), "ordinal", "enum", "value"),
        told("SRC21", R.go_commands(frame([("f", 'func newX(p P) *cobra.Command {\n c := &cobra.Command{\n Use: "x [y]",')], "path string, contents string")), "path", "constructor", "use"),
        told("SRC25", R.alternating_table(frame([("t", "|===\n| F one\n| S one\n\n| F two\n| S two\n|===")], "path string, contents string")), "ordinal", "feature", "setting"),
        told("SRC28", R.nav(frame([("n", "* Section\n** xref:a.adoc[A]\n* xref:b.adoc[B]")], "path string, contents string")), "line", "level", "target", "label", "section"),
        told("SRC29", R.commit_changes(frame([("p", 0, "d0", "o2", "o1"), ("p", 1, "d1", "o1", "o1"), ("p", 2, "d2", "o1", None)], "path string, pos int, date string, oid string, parent_oid string")), "pos", "path", "date"),
        told("SRC33", R.env_options(frame([("a=1, b=x=y\nnoise",)], "contents string")), "name", "value"),
        told("SRC34", R.duplicate_aliases(frame([("a", ["x"]), ("b", ["x"]), ("c", None)], "name string, aliases array<string>")), "claim", "owners"),
        told("SRC37", R.mark_beta(frame([("x", " beta: new"), ("y", "not BETA: x"), ("z", None)], "name string, description string")), "name", "is_beta"),
        told("REC12", R.page_headings(frame([("p", "= Page\n[[own]]\n== One\ninclude::part.adoc[]\ninclude::none.adoc[]")], "path string, contents string"), frame([("part.adoc", "== Two & `x`\n== Page")], "path string, contents string")), "id", "path", "title"),
    ]
    return union(parts)


QUERIES["file_scans"] = file_scans
SQL["file_scans"] = values([
    ("SRC1", "kafka", "input|Kafka, x|enterprise|y"), ("SRC1", "file", "output|~|community|n"), ("SRC4", "kafka", "enterprise"),
    ("SRC5", "p", "integer|~|null"), ("SRC5", "q", "~|d|~"), ("SRC5 root", "p", "integer"), ("SRC6", "a", "inputs"), ("SRC6", "b", "inputs"), ("SRC7", "y", "v2"),
    ("SRC9", "S", "playground/e"), ("SRC9", "T", "playground/b"), ("SRC10", "u", "page"), ("SRC10", "w", "early"), ("SRC11", "0", "https://a|2024"), ("SRC11", "1", "https://b|~"),
    ("SRC17", "a/x", "a/x.h|a/x.cc"), ("SRC17", "b", "b.hpp|~"), ("SRC18", "limit", "8"), ("SRC18", "n", "v"), ("SRC26", "0", "color|red"), ("SRC26", "1", "color|green"), ("SRC26", "2", "color|blue"),
    ("SRC21", "f", "newX|x"), ("SRC25", "0", "F one|S one"), ("SRC25", "1", "F two|S two"),
    ("SRC28", "1", "1||Section|Section"), ("SRC28", "2", "2|a.adoc|A|Section"), ("SRC28", "3", "1|b.adoc|B|Section"), ("SRC29", "0", "p|d0"), ("SRC29", "2", "p|d2"),
    ("SRC33", "a", "1"), ("SRC33", "b", "x=y"), ("SRC34", "x", "2"), ("SRC37", "x", True), ("SRC37", "y", False), ("SRC37", "z", False),
    ("REC12", "page", "p|Page"), ("REC12", "own", "p|One"), ("REC12", "two-x", "p|Two & `x`"),
])


# sinks, filters, joins, groupings, diffs and trees -------------------------------------------------------------------------------


def small_operators(spark: SparkSession, d: str) -> DataFrame:
    """Operators over literal rows [F1, F3, F9, F13, F14, F22, F31, F32, J1, J2, J18 to J23, J39 to J47, AGG3 to AGG31, T4, T9, DIFF3, DIFF4, DIFF9, REC7, REC10, SNK2 to SNK14, ST2 to ST4]."""
    ship(spark)
    frame, folder = spark.createDataFrame, own_folder(spark)
    attrs = frame([("a", {"noindex": "y"}), ("b", {"page-x": "1", "learning-objective-1": "l"}), ("c", {})], "id string, a map<string,string>")
    fields = frame([("r", [("_p", False, False), ("q", True, False), ("s", False, True), ("t", False, False)]), ("e", [("_z", False, False)])], "id string, fields array<struct<name:string,is_deprecated:boolean,is_advanced:boolean>>")
    jobs = frame([("1", "completed", "t", 1), ("2", "failed", "t", 2), ("3", "completed", "u", 3)], "job_id string, status string, tool string, created_at int")
    items = frame([("/labs/x", "Docker"), ("/labs/y", "Linux"), ("/docs/x", "Docker")], "url string, deployment string")
    lint = "see https://x.y/z now\nlink https://x.y/z[ok]\nA **b** c\nComing soon\nwait!!\n" + "long line of more than forty characters, twice\n" * 2 + "xref:a b.adoc[c]\ncut off...\nSOME SHOUTED WORDS"
    base, over = frame([("a", "one"), ("b", "two")], "k string, v string"), frame([("a", None, "ONE"), ("x", "b", "TWO"), ("y", None, "new")], "k string, name string, v string")
    keyed = frame([("i", "p"), ("j", "q")], "i string, c string")
    look = frame([("q", 5), ("d", 9)], "key string, v int")
    pages = frame([("s", "26.2", False), ("s", "25.1", False), ("cloud", "", True)], "component string, version string, cloud boolean")
    sets = frame([("d1", "v26.2.1", True), ("d2", "v26.2.2-rc1", False), ("d3", "v26.3.1", True)], "dataset string, tag string, released boolean")
    nav = frame([("a", 1), ("b", 2), ("c", 3)], "name string, position int")
    faq = frame([("p", {"page-faq-2-question": "q2", "page-faq-2-answer": "a2", "page-faq-10-question": "q", "page-faq-1-question": "q1", "page-faq-1-answer": "a1"})], "page string, attributes map<string,string>")
    feats = frame([("Éa", "s", "ga"), ("eb", "s", "ga"), ("Zc", "s", "ga"), ("x", "s", "unreleased")], "name string, scope string, status string")
    flags = "path string, flag string, type string, default_json string, description string, required boolean"
    commands = frame([("r p x",), ("r q y",), ("r p install",)], "path string")
    old = frame([("r q y", "f", "int", "1", "d", None), ("r q y", "gone", "s", None, None, None), ("r p install", "v", "s", None, None, None)], flags)
    new = frame([("r p x", "n", "s", None, None, None), ("r q y", "f", "int32", "1.0", "d ", True), ("r q y", "h", "s", None, None, None), ("r p install", "v", "s", None, None, None)], flags)
    tree = frame([("p", '{"a": 1}'), ("q", "{}")], "path string, body string")
    two = frame([("g", "u2", "b"), ("g", "u1", "a")], "g string, u string, t string")
    table, head, foot = sinks.asciidoc_table(frame([("a|b", 1), ("c", None)], "x string, y int"), ["x", "y"], ["x"])
    sinks.write_text(two.select("t"), f"{folder}/text")
    tar = sinks.tar_members(frame([("a.txt", b"hello"), ("b", None)], "path string, content binary"))
    data = frame([(b"k1", b"error x"), (None, b"fine"), (b"error", None)], "key binary, value binary")
    data.write.parquet(f"{folder}/in")
    records.run_filter(spark.readStream.schema(data.schema).parquet(f"{folder}/in"), {"PATTERN": "error", "MATCH_VALUE": "yes"}, lambda b, _: b.write.mode("append").parquet(f"{folder}/out"), f"{folder}/cp").awaitTermination(120)
    stamped = frame([("a", 1), ("a", 1), ("b", 2)], "k string, s int").withColumn("at", F.timestamp_seconds("s"))
    stamped.write.parquet(f"{folder}/in2")
    once = records.dedupe_within(spark.readStream.schema(stamped.schema).parquet(f"{folder}/in2"), ["k"], "at", "1 hour")
    once.writeStream.format("parquet").option("checkpointLocation", f"{folder}/cp2").trigger(availableNow=True).start(f"{folder}/out2").awaitTermination(120)
    chunks = frame([("1", "Progress: 45%"), ("2", "step 3/4"), ("3", "Cloning x"), ("4", "nothing")], "id string, value string")
    claims = frame([("n", "v1"), ("m", "v1"), ("o", "v2")], "name string, value string")
    parts = [
        told("F1", attrs.filter(FL.indexable(F.lit("out"), "a")), "id", F.lit("indexed")),
        told("F3", FL.gather_items(items, "url", "/labs/", "Docker"), "url", "deployment"),
        told("F9", FL.jobs(jobs, status="completed"), "job_id", "tool"),
        told("F13", attrs.filter("id = 'b'"), "id", F.array_join(F.array_sort(F.map_keys(FL.keep_attributes("a", ["page-x"]))), ",")),
        told("F14", FL.drop_empty_definitions(fields), "id", F.array_join(F.transform("fields", lambda x: x["name"]), ",")),
        told("F22", fields.filter("id = 'r'"), "id", F.array_join(F.transform(FL.split_fields("fields")["common"], lambda x: x["name"]), ","), F.array_join(F.transform(FL.split_fields("fields")["advanced"], lambda x: x["name"]), ",")),
        told("F31", FL.invalid_values(jobs, "job_id", {"status": ["completed"], "tool": ["t"]}), "job_id", "field", "value"),
        told("F32", FL.lint(frame([("p", lint)], "path string, contents string")), "line", "rule"),
        told("J2", frame([(["a"], ["b", "a"])], "x array<string>, y array<string>"), F.lit("names"), F.array_join(J.union_of_names("x", "y"), ",")),
        told("J19", J.left_lookup(keyed.withColumnRenamed("c", "key"), look.withColumn("v", F.col("v").cast("string")), ["key"], {"v": ""}), "i", "v"),
        told("J18", J.first_candidate(keyed, look, "i", [F.col("c"), F.lit("d")], "key", ["v"]), "i", "candidate", "matched_key", "v"),
        told("J22", J.upsert(base, over, "k", ["v"], "name"), "k", "v", "origin"),
        told("J39", J.split_sides(frame([("a",), ("b",)], "k string"), frame([("b",), ("c",)], "k string"), ["k"]), "k", "side"),
        told("J41", O.dataset_for(pages, sets), F.concat_ws(" ", "component", "version"), "dataset"),
        told("J44", TR.apply_overrides(tree, frame([("p", '{"b": 2}')], "path string, body string")), "path", "body"),
        told("J45", J.anchored_insert(nav, frame([("k", "b"), ("l", "gone"), ("c", "a")], "name string, anchor string")), "name", "position"),
        told("AGG3", A.references(frame([("p", ["x", "y"]), ("q", ["x"])], "owner string, items array<string>"), "items", "owner"), "item", F.array_join("owners", ",")),
        told("AGG4", A.verdict_counts(frame([("ok",), ("ok",), ("bad",)], "v string"), "v", ["ok", "bad"]), F.lit("all"), "ok", "bad"),
        told("AGG11", D.summary(frame([("new",), ("new",)], "change string"), ["new", "removed"]), F.lit("all"), "new", "removed"),
        told("AGG20", A.most_recent(frame([("a", "1"), ("a", "3"), ("b", "2")], "g string, date string"), "g", "date"), F.coalesce("g", F.lit("all")), "latest"),
        told("AGG23", A.mapping_by_source(claims, frame([("v2", 0), ("v1", 1)], "value string, ordinal int")), "value", "ordinal", F.array_join("names", ",")),
        told("AGG24", A.duplicate_texts(frame([("a", "The same long text, said here twice."), ("b", "the same long text, said here twice. ")], "k string, t string"), "t", "k"), "first_owner", "n"),
        told("AGG26", A.faq_pivot(faq), "n", "question", "answer"),
        told("AGG29", A.feature_table(feats, "s", ["ga"]).withColumn("n", F.monotonically_increasing_id()), "n", "name"),
        told("AGG31", frame([(0, 0, 1), (0, 0, 0)], "r int, d int, t int"), "t", A.breaking("r", "d", "t")),
        told("SET6", frame([(["a", "b", "a"],)], "x array<string>"), F.lit("x"), F.array_join(SETS.distinct_in_order("x"), ",")),
        told("T3", O.minor_order(frame([("v24.1.9", 0), ("v24.2.1", 1), ("v24.2.5", 2)], "tag string, ordinal int"), "tag", "ordinal").withColumn("n", F.monotonically_increasing_id()), "n", "tag"),
        told("T4", O.newest_tag(frame([("v1.2.3-beta1",), ("v1.2.2",), ("v1.10.0-rc1",)], "tag string"), "tag", O.stable_image("tag")), F.lit("image"), "newest"),
        told("DIFF3", D.compare_flags(old, new, commands, commands), F.concat_ws(" ", "path", "flag"), "change", "old", "new"),
        told("DIFF9", D.baseline(None, lambda: frame([("rebuilt",)], "x string")), F.lit("none"), "x"),
        told("DIFF9", D.baseline(frame([("kept",)], "x string"), lambda: None), F.lit("some"), "x"),
        told("REC7", TR.subtree(frame([("a b",), ("a b c",), ("a bc",)], "path string"), "a b"), "path", F.lit("under")),
        told("SNK2", sinks.as_json(frame([("a", 1)], "x string, y int")), F.lit("row"), "value"),
        told("SNK3", sinks.attach(two, frame([("v9",)], "version string")), "u", "version"),
        told("SNK4", sinks.markdown(frame([("T", "<p>a <b>b</b></p>")], "title string, body string"), "title", "body"), "title", "value"),
        told("SNK9", table.withColumn("n", F.monotonically_increasing_id()), "n", "value"),
        told("SNK9 frame", frame([(head, foot)], "a string, b string"), F.lit("frame"), "a", "b"),
        told("SNK10", tar, "path", F.length("member"), F.decode(F.substring("member", 258, 5), "UTF-8"), F.decode(F.substring("member", 513, 5), "UTF-8")),
        told("SNK12", spark.read.text(f"{folder}/text"), "value", F.lit("written")),
        told("ST2", spark.read.schema(data.schema).parquet(f"{folder}/out"), F.decode("key", "UTF-8"), F.decode("value", "UTF-8")),
        told("ST3", records.progress_events(chunks), "id", "percent", "phase"),
        told("ST4", spark.read.schema(stamped.schema).parquet(f"{folder}/out2"), "k", "s"),
    ]
    return union(parts)


QUERIES["small_operators"] = small_operators
SQL["small_operators"] = values([
    ("F1", "b", "indexed"), ("F1", "c", "indexed"), ("F3", "/labs/x", "Docker"), ("F9", "1", "t"), ("F9", "3", "u"), ("F13", "b", "learning-objective-1,page-x"), ("F14", "r", "q,s,t"), ("F22", "r", "_p,t|s"),
    ("F31", "2", "status|failed"), ("F31", "3", "tool|u"),
    ("F32", "1", "raw-url"), ("F32", "3", "markdown-emphasis"), ("F32", "4", "coming-soon"), ("F32", "5", "bang-bang"), ("F32", "7", "duplicate-content"), ("F32", "8", "invalid-xref"), ("F32", "9", "truncated"), ("F32", "10", "inline-caps"),
    ("J2", "names", "a,b"), ("J19", "i", ""), ("J19", "j", "5"), ("J18", "i", "1|d|9"), ("J18", "j", "0|q|5"), ("J22", "a", "ONE|both"), ("J22", "b", "TWO|both"), ("J22", "y", "new|stub"),
    ("J39", "a", "left"), ("J39", "b", "both"), ("J39", "c", "right"), ("J41", "cloud ", "d3"), ("J41", "s 25.1", None), ("J41", "s 26.2", "d2"), ("J44", "p", '{"a": 1, "b": 2}'), ("J44", "q", "{}"),
    ("J45", "a", "1.0"), ("J45", "b", "2.0"), ("J45", "c", "3.0"), ("J45", "k", "2.5"), ("J45", "l", "1.0E9"),
    ("AGG3", "x", "p,q"), ("AGG3", "y", "p"), ("AGG4", "all", "2|1"), ("AGG11", "all", "2|0"), ("AGG20", "a", "3"), ("AGG20", "b", "2"), ("AGG20", "all", "3"), ("AGG23", "v1", "1|m,n"), ("AGG23", "v2", "0|o"), ("AGG24", "a", "2"),
    ("AGG26", "1", "q1|a1"), ("AGG26", "2", "q2|a2"), ("AGG29", "0", "Éa"), ("AGG29", "1", "eb"), ("AGG29", "2", "Zc"), ("AGG31", "1", True), ("AGG31", "0", False), ("SET6", "x", "a,b"),
    ("T3", "0", "v24.2.1"), ("T3", "1", "v24.2.5"), ("T3", "2", "v24.1.9"), ("T4", "image", "v1.10.0-rc1"),
    ("DIFF3", "r p x", "flagDataBackfilled|~|1"), ("DIFF3", "r q y f", "changedFlagTypes|int|int32"), ("DIFF3", "r q y f", "changedFlagRequirements|~|true"), ("DIFF3", "r q y f", "changedFlagDescriptions|d|d "), ("DIFF3", "r q y gone", "removedFlags|s|~"), ("DIFF3", "r q y h", "newFlags|~|s"),
    ("DIFF9", "none", "rebuilt"), ("DIFF9", "some", "kept"), ("REC7", "a b", "under"), ("REC7", "a b c", "under"),
    ("SNK2", "row", '{"x":"a","y":1}'), ("SNK3", "u1", "v9"), ("SNK3", "u2", "v9"), ("SNK4", "T", "# T\n\na b"), ("SNK9", "0", "|a\\|b |1 "), ("SNK9", "1", "|c | "), ("SNK9 frame", "frame", "|===\n|x |y ||==="),
    ("SNK10", "a.txt", "1024|ustar|hello"), ("SNK10", "b", "512|ustar|"), ("SNK12", "a", "written"), ("SNK12", "b", "written"), ("ST2", "k1", "error x"),
    ("ST3", "1", "45|~"), ("ST3", "2", "75|~"), ("ST3", "3", "~|fetching"), ("ST4", "a", "1"), ("ST4", "b", "2"),
])
