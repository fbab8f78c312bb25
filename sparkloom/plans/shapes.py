"""Functions and scanners over texts that Spark makes of the rows of part, and the answers that the same columns give.

A shape is a pair of texts in which §k, §n, §m, §t and §z stand for a row's key, name, name with dashes, type and size: what a function is
given, and what it must give. A row takes the shape that its key falls on, so each function runs over the whole table; the SQL builds the
answers from the columns and knows nothing of the function."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import filters as FL
from ..operators import trees as TR
from ..session import ship
from ..sources import cpp, scanners, sinks
from ..sources import readers as R
from .catalogue import QUERIES, SQL, t

_COLUMNS = {"k": "p_partkey", "n": "p_name", "t": "p_type", "z": "p_size"}
Shape = str | bool | None


def given(shape: str) -> Column:
    """The text of a shape as a Column."""
    parts = [F.lit(p) if i % 2 == 0 else F.replace("p_name", F.lit(" "), F.lit("-")) if p == "m" else F.col(_COLUMNS[p]).cast("string") for i, p in enumerate(re.split("§([kntzm])", shape))]
    return F.concat(*parts)


def told(shape: Shape) -> str:
    """The text of a shape in SQL."""
    if shape is None or isinstance(shape, bool):
        return "NULL" if shape is None else f"'{str(shape).lower()}'"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return " || ".join(quoted(p) if i % 2 == 0 else "replace(p_name, ' ', '-')" if p == "m" else f"CAST({_COLUMNS[p]} AS VARCHAR)" for i, p in enumerate(re.split("§([kntzm])", shape)) if p or i % 2 == 0 and not shape)


def chosen(shapes: list, make) -> Column:
    """Of several, the one on which a row's key falls."""
    out = None
    for i, s in enumerate(shapes[:-1]):
        out = (F.when if out is None else out.when)(F.col("p_partkey") % len(shapes) == i, make(s))
    return make(shapes[0]) if out is None else out.otherwise(make(shapes[-1]))


def _case(answers: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN p_partkey % {len(answers)} = {i} THEN {a}" for i, a in enumerate(answers)) + " END"


def _add(name: str, doc: str, table: list[tuple[str, Callable[[Column], Column], dict[str, Shape]]]) -> None:
    """A query of rows (op, p_partkey, got), one for each function and row of part, all out of one scan."""

    def run(spark, d) -> DataFrame:
        rows = t(spark, d, "part")
        # inputs are columns of their own first, since functions read them many times
        rows = rows.select("p_partkey", *(chosen(list(shapes), given).alias(f"x{i}") for i, (_, _, shapes) in enumerate(table)))
        got = [F.struct(F.lit(op).alias("op"), f(F.col(f"x{i}")).cast("string").alias("got")) for i, (op, f, _) in enumerate(table)]
        return rows.select("p_partkey", F.explode(F.array(*got)).alias("r")).select("r.op", "p_partkey", "r.got")

    run.__doc__ = f"{doc} [{', '.join(dict.fromkeys(op.split()[0] for op, _, _ in table))}]."
    QUERIES[name] = run
    SQL[name] = " UNION ALL ".join(f"SELECT '{op}' AS op, p_partkey, {_case([told(a) for a in shapes.values()])} AS got FROM part" for op, _, shapes in table)


_add("text_shapes", "Functions of prose", [
    ("SC-S1", T.decode_entities, {"&#233;§k&#x41;&amp;lt;§n": "é§kA<§n", "&lt;b&gt;§n&quot;": '<b>§n"', "§n&nbsp;&#65": "§n&nbsp;&#65"}),
    ("SC-S2", T.collapse_space, {" §n \n\t §k ": "§n §k", "§t": "§t"}),
    ("SC-S4", lambda c: T.strip_metadata(c, "See (all)."), {"<!-- Source: §n -->\n§k\n> See (all). more\n<!-- mine -->": "§k\n\n<!-- mine -->", "plain §n": "plain §n"}),
    ("SC-S5", lambda c: T.truncate_at_newline(c, 12), {"§t": "§t", "ab§k\n§n and more text": "ab§k"}),
    ("T12", lambda c: T.truncate_at_newline(c, 20), {"one\n§k\nthree and far beyond it": "one\n§k", "§k": "§k"}),
    ("SC-S7", T.cap_sentences, {"One §n, e.g. this. Two 1.§k. Three §t.": "One §n, e.g. this. Two 1.§k.", "See http://a.b/§k. End": "See http://a.b/§k. End"}),
    ("SC-S8", T.first_sentence, {"Use 1.§k of §n. Then": "Use 1.§k of §n.", "No §n\n\nSecond. x": "No §n", "Line\n  §k. x": "Line §k."}),
    ("SC-S8 list", T.truncate_sentences, {"A [§n](c). *§t*! E?": "A §n.  §t!", "none §k": "none §k"}),
    ("SC-S10", lambda c: T.sentence_case(c, ("API",)), {"The Big api §t": "The big API §t", "Two §n Guide": "Two §n guide"}),
    ("SC-S14", T.link_text, {"xref:a.adoc[§n] [§k]  d": "§n §k d"}),
    ("SC-S15", T.escape_html, {"<§n&'\">": "&lt;§n&amp;&#39;&quot;&gt;"}),
    ("SC-S21", lambda c: T.replace_all(c, [("a+", "b"), ("bb", "c")]), {"aa§kab": "b§kc", "x§z": "x§z"}),
    ("U5", lambda c: T.replace_all(c, [(r"\s+$", "")]), {"§n  ": "§n"}),
    ("U6", lambda c: T.replace_all(c, [("{v}", "1.2")], regex=False), {"v{v}§k": "v1.2§k"}),
    ("SC-S30", lambda c: T.first_reference_only(c, "a", "prop:a[]"), {"§n `a` and `a`": "§n prop:a[] and `a`", "none §k": "none §k"}),
    ("SC-S35", T.collapse_blank_lines, {"§n\n\n\n\n§k": "§n\n\n§k"}),
    ("SC-S38", T.clean_url_breaks, {"§n​ https://a​b–§k y–z": "§n​ https://ab-§k y–z"}),
    ("F21", FL.problematic, {"§n TODO §k": True, "{{§k}}": True, "todos§k": False}),
    ("F35", FL.override_action, {"short §n": "replace", "x" * 60 + "\n\n" + "y" * 60 + "§k": "append"}),
    ("F36", lambda c: FL.drop_examples(c, ["secret"]), {"# set secret §k\nrun --x\n\n\n\n# other\nrun secret\nkeep §n": "\n\nkeep §n"}),
])

_add("name_shapes", "Functions of names, paths and addresses", [
    ("SC-S12", T.property_anchor, {"a.§k.§t": "a-§k-§t"}),
    ("SC-S16", T.dashify, {"tool §n": "tool-§m"}),
    ("SC-S16 up", T.parent_path, {"a §k §t": "a §k", "§t": ""}),
    ("SC-S17", T.capitalize, {"x§n": "X§n"}),
    ("SC-S19", T.unit_of, {"§t_ms": "milliseconds", "r_§k_bytes": "bytes", "§t_x_partitions": "number of partitions per topic", "plain§k": ""}),
    ("SC-S20", T.format_default, {'"§n"': '`"§n"`', "§z": "`§z`", "§z000": "`§z000` (§zs)", "[1,§k]": "`[2 items]`", '{"a":§k}': '`{"a":§k}`', "null": "`null`"}),
    ("SC-J attributes", lambda c: T.expand_attributes(c, {"a": "1", "b": "{a}"}), {"{b}{a}{c}§k": "{a}1{c}§k"}),
    ("SC-J pointer", T.pointer_unescape, {"a~1b~0§k": "a/b~§k", "~01§t": "~1§t"}),
    ("SC-S25", T.url_path, {"https://a.b/c§k?d#e": "/c§k", "/x§k?y": "/x§k?y", "nonsense": "", "https://a§k.b/": ""}),
    ("SC-S27", lambda c: T.alias_spec(c, F.lit("c"), F.lit("1.0"), F.lit("M")).cast("string"), {"§t.adoc": "{M, §t.adoc}", "m§k:a": "{m§k, a.adoc}", "c:m§k:a.adoc": "{m§k, a.adoc}", "x:m:§k.adoc": None, "2.0@§k": None, "1.0@§k": "{M, §k.adoc}"}),
    ("SC-S28", lambda c: T.resource_id(c).cast("string"), {"1.§z@c:m§k:partial$§t.adoc": "{1.§z, c, m§k, partial, §t.adoc}", "§k.adoc": "{null, null, null, null, §k.adoc}"}),
    ("SC-S29", lambda c: T.commercial_names(c, {"x": "Ex"}, [("aws_", "AWS")]), {"aws_§k": "AWS", "x": "Ex", "y§k": "y§k"}),
    ("SC-S32", lambda c: T.helm_path(c, F.lit("cluster")), {"p§k": "config.cluster.p§k"}),
    ("SC-S32 broker", lambda c: T.helm_path(c, F.lit("broker")), {"p§k": "config.node.p§k"}),
    ("SC-S36", T.sanitize_version, {"v1.§z.3 (§k)": "v1.§z.3§k"}),
    ("SC-S40", T.cpp_default, {"1§z'024ULL": "1§z024", "{§k}": "§k", "std::nullopt": "null"}),
    ("SC-S41", T.json_type, {"std::vector<x§k>": "array", "std::optional<int32_t>": "integer", "x::y§k": "object", "ss::sstring": "string", "bool": "boolean", "std::chrono::seconds": "integer"}),
    ("SC-S42", lambda c: T.badge(c, F.lit('a "tip"')), {"New §k": '<span class="badge badge--medium" title="a &quot;tip&quot;">New §k</span>'}),
    ("U2", lambda c: T.badge(c, F.lit("t"), "large"), {"<§n>": '<span class="badge badge--large" title="t">&lt;§n&gt;</span>'}),
    ("SC-V4", S.normal_tag, {"1.§z.3": "v1.§z.3", " v4.§k.6": "v4.§k.6"}),
    ("SC-V5", S.removes_deprecated, {"v26.§z.0": True, "25.§z.9": False, "dev§t": True}),
    ("SC-V6", lambda c: S.version_at_least(c, F.lit("1.10")), {"1.9.§k": False, "1.10.§k": True, "v2.§z.1": True}),
    ("T10", S.canonical, {'{"b":§k,"a":{"d":"§n","c":2}}': '{"a":{"c":2,"d":"§n"},"b":§k}', '"§k"': '"§k"', "§k.0": "§k.0", "§kd": "§kd"}),
    ("DIFF6", lambda c: S.json_equal(c, F.lit('{"a":[1],"b":2}')), {'{"b":2,"a":[1]}': True, '{"b":"2","a":[§k]}': False, "§kd": False}),
])

_add("predicate_shapes", "Predicates of one text", [
    ("F5", lambda c: FL.external(c, ["docs.x.y"]), {"Docs.X.y": False, "other§k": True}),
    ("F6", lambda c: FL.unpublished(F.create_map(c, F.lit("y")), F.lit(False)), {"page-unpublish": True, "page-publish-only-during-beta": True, "other§k": False}),
    ("F15", lambda c: FL.public_property(c, F.lit(False)), {"_§k": False, "x§k": True}),
    ("F16", lambda c: FL.under_any(c, ["a b"]), {"a b §k": True, "a b§k": False, "a b": True}),
    ("F23", lambda c: FL.listed_page(c, F.lit("/u"), ["/d"]), {"a§k/index.adoc": False, "§k.adoc": True, "404.adoc": False}),
    ("F30", FL.truthy_flag, {"Yes": True, "on§k": False, "1": True}),
    ("F34", lambda c: FL.under_any(c, ["x"], "/"), {"x/§k": True, "x§k": False}),
    ("SC-S33", lambda c: cpp.category(c, "acme"), {"retention.ms": "retention-compaction", "segment.ms": "segment-message", "write.caching": "performance-cluster", "acme.remote.read": "tiered-storage", "acme.iceberg.mode": "iceberg-integration", "confluent.key.schema.validation": "schema-registry", "x§t": "other"}),
    ("SC-S34", lambda c: cpp.topic_type(c, "acme"), {"acme.remote.readreplica": "string", "acme.iceberg.delete": "boolean", "delete.retention.ms": "string", "retention.ms": "integer", "replication.factor": "integer", "min.cleanable.dirty.ratio": "number", "x.§k": "string"}),
])


# numbers: the answers are worked out ----------------------------------------------------------------------------------------------


def number_shapes(spark, d):
    """Functions of numbers and times [SC-D2, SC-D5, SC-M4, SC-M6, F11, F26, F10]."""
    k, z = F.col("p_partkey"), F.col("p_size")
    kinds = F.element_at(F.array(*(F.lit(f"{s}int{b}_t") for b in (8, 16, 32, 64) for s in ("", "u"))), (k % 8 + 1).cast("int"))
    at = F.timestamp_seconds(k * 3600)
    return t(spark, d, "part").select(
        "p_partkey", S.epoch_date(k * 40000).alias("epoch"), S.uptime(k * 61).alias("uptime"), S.int_bounds(kinds)["minimum"].cast("string").alias("least"), S.int_bounds(kinds)["maximum"].cast("string").alias("most"),
        S.retry_delay(z % 6, jitter=(k % 4) / 4).alias("delay"), FL.expired(F.when(k % 5 > 0, at), F.lit("1970-01-03 12:00:00").cast("timestamp")).alias("expired"), FL.retryable((z * 20).cast("int"), F.when(k % 3 == 0, "ETIMEDOUT").otherwise("E")).alias("again"),
    )


QUERIES["number_shapes"] = number_shapes
SQL["number_shapes"] = """
WITH p AS (SELECT *, p_partkey % 8 AS i, CAST(8 * (1 << CAST((p_partkey % 8) // 2 AS INTEGER)) AS INTEGER) AS bits, CASE p_size % 6 WHEN 0 THEN 1000 WHEN 1 THEN 2000 WHEN 2 THEN 4000 WHEN 3 THEN 8000 ELSE 10000 END AS base FROM part)
SELECT p_partkey, strftime(to_timestamp(p_partkey * 40000) AT TIME ZONE 'UTC', '%Y-%m-%d') AS epoch, (p_partkey * 61 // 3600) || 'h ' || (p_partkey * 61 % 3600 // 60) || 'm' AS uptime,
  CASE WHEN i % 2 = 1 THEN '0' WHEN bits = 8 THEN '-128' WHEN bits = 16 THEN '-32768' WHEN bits = 32 THEN '-2147483648' ELSE '-9223372036854775808' END AS least,
  CASE i WHEN 0 THEN '127' WHEN 1 THEN '255' WHEN 2 THEN '32767' WHEN 3 THEN '65535' WHEN 4 THEN '2147483647' WHEN 5 THEN '4294967295' WHEN 6 THEN '9223372036854775807' ELSE '18446744073709551615' END AS most,
  CAST(floor(base + p_partkey % 4 / 4.0 * 0.3 * base) AS BIGINT) AS delay, p_partkey % 5 > 0 AND p_partkey < 60 AS expired, p_size * 20 >= 500 OR p_partkey % 3 = 0 AS again FROM p
"""


# scanners: texts in, rows out ------------------------------------------------------------------------------------------------------

_GO = 'a := &cobra.Command{ Use: "x§k [flags]", Run: func() { a("}") }, Hidden: true }\nb := &cobra.Command{Use: "y", Deprecated: "use §n"}\nc := &cobra.Command{Use: "ok"}\ncmd.AddCommand(out.DeprecateCmd(newOld(fs), "tool §t"))'
_URLS = "**https://a.b/§k**, and `https://code` or link:https://l.m[§n\nlines].\n----\nhttps://in.block\n....\n----\n:url: https://attr.§t\nimage:d.png[link=https://v.w]"
_TOPICS = 'inline constexpr std::string_view topic_property_a = "ret.§k";\nconstexpr string_view topic_property_b{"ret.§k"};\nconst std::string topic_property_c = "c.ms";\nstatic const char* topic_property_d = "d.§z";\nx("segment.size")'
_HEADER = "struct conf : store {\n  // property<int> not_this;\n  property<std::optional<int32_t>> a§k, e{1};\n  enterprise<property<bool>> b§z;\n  bounded_property<std::chrono::milliseconds,\n    numeric> c;\n  int other;\n};"

#: id, function of a text, then for each shape of a text the rows that come out, their values apart by bars, null as a tilde.
SCANS: list[tuple[str, Callable, dict[str, list[str]]]] = [
    ("SRC15", cpp.header_settings, {_HEADER: ["a§k|property<std::optional<int32_t>>|property<std::optional<int32_t>> a§k, e{1};", "e|property<std::optional<int32_t>>|property<std::optional<int32_t>> a§k, e{1};", "b§z|enterprise<property<bool>>|enterprise<property<bool>> b§z;", "c|bounded_property<std::chrono::milliseconds, numeric>|bounded_property<std::chrono::milliseconds, numeric> c;"]}),
    ("SRC16", cpp.source_arguments, {
        'x(*this, "n§k", R"(raw "§n")", ns::f<int>(1, 2), {.a = b::c}, model::mode::fast, -§z), y(*this, 1\'0§z, v)': ["x|0|string_literal|n§k", 'x|1|string_literal|raw "§n"', "x|2|call_expression|ns::f<int>(1, 2)", "x|3|initializer_list|{.a = b::c}", "x|4|qualified_identifier|model::mode::fast", "x|5|number_literal|-§z", "y|0|number_literal|1'0§z", "y|1|identifier|v"],
        "x(*this, a->b, §k)": ["x|0|call_expression|a->b", "x|1|number_literal|§k"],
    }),
    ("SRC18", cpp.named_constants, {'namespace kafka {\nconstexpr std::string_view a{"x§k"};\nstd::string_view b() { return "§n"; }\n}\ninline const model::topic c("§t");\nconst model::ns d("w");\nconst model::topic_partition e{model::topic{"t§z"}, p};': ["a|x§k", "kafka::a|x§k", "b|§n", "kafka::b|§n", "c|§t", "d|w", "e.topic|t§z"]}),
    ("SRC19", scanners.struct_fields, {"struct conf§k { int a = §z; // x\n std::optional<int> b; };": ["conf§k|0|int|a|§z", "conf§k|1|std::optional<int>|b|~"]}),
    ("SRC20", cpp.topic_settings, {_TOPICS: ["topic_property_a|ret.§k", "topic_property_c|c.ms", "topic_property_d|d.§z", "topic_property_segment_size|segment.size"]}),
    ("SRC20 ignored", cpp.ignored_settings, {'allowlist_topic_noop_confs = {\n"a.§k", // x\n"c"}': ["a.§k", "c"]}),
    ("SRC20 defaults", cpp.topic_defaults, {"add_topic_config_if_requested(k, config::shard_local_cfg().log_§k.name(), x, topic_property_ms, config::shard_local_cfg().log_§k.desc()); add_topic_config_if_requested(k, topic_property_b, f(config::shard_local_cfg() .one.name(), config::shard_local_cfg().two§z.name()));": ["topic_property_ms|log_§k|0", "topic_property_b|one|0", "topic_property_b|two§z|1"]}),
    ("SRC22", scanners.hidden_commands, {_GO: ["x§k|true|~", "y|false|use §n", "newOld|false|tool §t"]}),
    ("SRC23", R.help_flags, {"Usage:\n\nFlags:\n  -h, --help            Help §n\n      --size int        The size\n                        of §t (default §z)\nGlobal Flags:\n      --verbose§k\n": ["help|h|bool|~|Help §n", "size||int|§z|The size of §t", "verbose§k||bool|~|"]}),
    ("SRC24", scanners.document, {"= Title §k\n:attr: §n\nintro\n\n== One\nx\n----\n== not\n----\n": ["attribute|0|attr|§n", "title|0|Title §k|intro", "section|1|One|x\n----\n== not\n----"]}),
    ("SC-S31", scanners.document, {"== Only §t\nbody §k": ["section|1|Only §t|body §k"]}),
    ("SRC27", R.commented_values, {"# top §k\na:\n  # -- inner §n\n  b: 1\nc: 2\n": ["a|top §k", "a.b|inner §n"]}),
    ("SRC38", R.sections, {"intro §k\nUSAGE\nbody §n\n$ RUN THIS\nNOTES:\nx": ["|intro §k", "USAGE|body §n\n$ RUN THIS", "NOTES|x"]}),
    ("SC-S24", lambda x: [r[:2] for r in R.content_urls(x)], {_URLS: ["https://a.b/§k|~", "https://l.m|§n lines", "https://attr.§t|~", "https://v.w|~"]}),
    ("SC-S22 numbered", lambda x: [(scanners.numbered_lists(x),)], {"  1. a§k\n  2. b\n  4. c\nx": [". a§k\n. b\n  4. c\nx"]}),
    ("SC-S22 tables", lambda x: [(scanners.indented_tables(x),)], {"  a§k  b\n  c  d\n  alone here": ["|===\n|a§k |b\n|c |d\n|===\n  alone here"]}),
    ("SC-S22 code", lambda x: [(scanners.code_blocks(x),)], {"t\n\n    run §n\n    y\nz": ["t\n\n----\nrun §n\ny\n----\nz"]}),
    ("SC-S22 definitions", lambda x: [(scanners.definition_lists(x),)], {"all:\n  every §k\n  of them\nnone:\n  not any\nend": ["all:: every §k of them\nnone:: not any\nend"]}),
    ("SC-S22", lambda x: [(scanners.description(x),)], {"Text §n.\n\n  1. a\n  2. b\n\n\n\n    run §k\n": ["Text §n.\n\n. a\n. b\n\n----\nrun §k\n----"]}),
    ("SC-S23", lambda x: [(scanners.markdown(x),)], {"<article><h1>T§k</h1><p>a <b>§n</b> <code>c</code> <a href='/x'>l</a></p><ul><li>i</li><li>j</li></ul><pre>x  y</pre></article>": ["# T§k\n\na **§n** `c` [l](/x)\n- i\n- j\n\n```\nx  y\n```"]}),
    ("SC-S30", lambda x: [(scanners.first_mentions(x, {"a": "prop:a[]"}),)], {"`a` §n `a`\n`a`\n\n`a`\n* `a` §k": ["prop:a[] §n `a`\n`a`\n\nprop:a[]\n* prop:a[] §k"]}),
    ("SRC35", lambda x: [(v,) for v in scanners.arguments(x)], {'a§k, f(b, c), "x,§n", {1, 2}': ["a§k", "f(b, c)", '"x,§n"', "{1, 2}"], "a -> b, x << §z, 1'0§k, i < §z, p<q, r>{}": ["a -> b", "x << §z", "1'0§k", "i < §z", "p<q, r>{}"]}),
    ("SRC35 values", lambda x: [(scanners.cpp_value(v),) for v in x.split("\n")], {'std::nullopt\nss::sstring("§n")\nstd::chrono::seconds{§z}\nmodel::mode::fast\n1\'0§zu\n{1, §k}': ["~", "§n", "§z seconds", "fast", "10§z", "[1, §k]"]}),
    ("SRC36", lambda x: [(json.dumps(scanners.resolve_type(x, {f"model::{x}": {"$ref": "#/definitions/config::real"}, "config::real": {"type": "string"}})),)], {"mode§k": ['{"type": "string"}']}),
    ("F20", lambda x: [(p, scanners.schema_allows(json.loads(x), p)) for p in ("a.b", "a.c", "r.any", "x-1", "q")], {'{"title": "§n", "properties": {"a": {"properties": {"b": {}}, "additionalProperties": false}, "r": {"$ref": "x§k"}}, "patternProperties": {"^x-": {}}, "additionalProperties": false}': ["a.b|true", "a.c|false", "r.any|true", "x-1|true", "q|false"]}),
    ("REC2", lambda x: TR.dotted_fields(json.loads(x)), {'[{"name": "a§k", "kind": "array", "children": [{"name": "b", "type": "§t"}, {"name": "c", "is_deprecated": true}]}]': ["a§k[]|", "a§k[].b|§t"]}),
    ("REC3", lambda x: [(json.dumps(TR.resolve(json.loads(x), json.loads(x))["use"], sort_keys=True),)], {'{"d": {"a": {"x": §k, "y": 2}}, "use": {"$ref": "#/d/a", "y": §z}}': ['{"x": §k, "y": §z}']}),
    ("REC6", lambda x: [(json.dumps(TR.deep_merge(*json.loads(x))),)], {'[[{"name": "a", "v": §k}], [{"name": "a", "w": "§n"}, {"name": "b"}]]': ['[{"name": "a", "v": §k, "w": "§n"}, {"name": "b"}]']}),
    ("REC8", lambda x: [(json.dumps(TR.rewrite_strings(json.loads(x), lambda s: s + "!")),)], {'{"a": ["§n", §k]}': ['{"a": ["§n!", §k]}']}),
    ("REC9", lambda x: [(json.dumps(TR.wrap_ref_siblings(json.loads(x))),)], {'{"$ref": "§n", "d": §k}': ['{"allOf": [{"$ref": "§n"}], "d": §k}'], '{"$ref": "§t"}': ['{"$ref": "§t"}']}),
    ("SNK13", lambda x: [(sinks.insert_version(x, "p", "v1"),)], {'{\n  "properties": {\n    "p": {\n      "type": §k\n    }\n  }\n}': ['{\n  "properties": {\n    "p": {\n      "version": "v1",\n      "type": §k\n    }\n  }\n}'], '{\n  "properties": {\n    "q": {\n      "type": §k\n    }\n  }\n}': ["~"]}),
]


def _shown(row: tuple) -> str:
    return "|".join([v if type(v) is str else "~" if v is None else str(v).lower() if type(v) is bool else str(v) for v in row])


def scanner_shapes(spark, d):
    """Scanners and walks of one text, over texts made of the rows of part, in Arrow batches [see SCANS].

    A row of part is small and its texts take long, so rows are dealt out first: a file of few row groups would else be few tasks."""
    ship(spark)
    functions = {op: f for op, f, _ in SCANS}
    pairs = F.array(*(F.struct(F.lit(op).alias("op"), chosen(list(shapes), given).alias("text")) for op, _, shapes in SCANS))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = t(spark, d, "part").select(*_COLUMNS.values()).repartition(tasks).select("p_partkey", F.explode(pairs).alias("x")).select("p_partkey", F.col("x.op").alias("op"), F.concat_ws("\u0001", "x.op", "x.text").alias("contents"))

    def scan(contents: str) -> list[tuple]:
        op, _, text = contents.partition("\u0001")
        return [(i, _shown(r)) for i, r in enumerate(functions[op](text))]

    return R.scan_rows(rows, "contents", scan, "item int, got string", [pa.int32(), pa.string()]).select("op", "p_partkey", "item", "got")


QUERIES["scanner_shapes"] = scanner_shapes
SQL["scanner_shapes"] = " UNION ALL ".join(f"SELECT '{op}' AS op, p_partkey, CAST({i} AS INTEGER) AS item, {told(row)} AS got FROM part WHERE p_partkey % {len(shapes)} = {n}" for op, _, shapes in SCANS for n, rows in enumerate(shapes.values()) for i, row in enumerate(rows))
