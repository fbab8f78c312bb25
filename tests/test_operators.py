"""Literal cases of filters, joins, groupings, ordered operators, diffs, trees, sources, sinks and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import aggregates as A
from sparkloom.operators import diffs as D
from sparkloom.operators import filters as FL
from sparkloom.operators import joins as J
from sparkloom.operators import ordered as O
from sparkloom.operators import sets as SETS
from sparkloom.operators import trees as TR
from sparkloom.sources import readers as R
from sparkloom.sources import sinks
from sparkloom.streaming import records


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_filters(spark):
    df = spark.createDataFrame([("a b", ["x"]), ("a b c", ["y"]), ("ab", [])], "path string, tags array<string>")
    assert {r[0] for r in rows(df.filter(FL.under_any("path", ["a b"])), "path")} == {"a b", "a b c"}
    assert [r[0] for r in rows(df.filter(FL.tag_selected("tags", "x;y,!y")), "path")] == ["a b"]
    assert [r[0] for r in rows(df.filter(FL.build_constraint("tags", "!(x || y) && !z")), "path")] == ["ab"]
    assert {r[0] for r in rows(FL.under_flagged(df, spark.createDataFrame([("a b",)], "path string")), "path")} == {"a b", "a b c"}
    assert df.filter(FL.matches("path", [], ["c$"])).count() == 2 and df.filter(FL.matches("path", ["^ab"], [])).count() == 1


def test_feature_status(spark):
    df = spark.createDataFrame([("ga", None), ("bogus", None), ("", None), (None, "true"), (None, None)], "s string, b string")
    assert [r.x for r in df.select(FL.feature_status("s", "b").alias("x")).collect()] == ["ga", "unreleased", "unreleased", "beta", "ga"]


def test_lint(spark):
    text = "see https://x.y/z now\nlink https://x.y/z[ok]\nA **b** c\nComing soon\nwait!!\n" + "long line of more than forty characters, twice\n" * 2
    assert {(r.line, r.rule) for r in FL.lint(spark.createDataFrame([("p", text)], "path string, contents string")).collect()} == {(1, "raw-url"), (3, "markdown-emphasis"), (4, "coming-soon"), (5, "bang-bang"), (7, "duplicate-content")}


def test_drop_examples(spark):
    text = "# set secret\nrun --x\n\n\n\n# other\nrun secret\nkeep"
    assert spark.range(1).select(FL.drop_examples(F.lit(text), ["secret"]).alias("x")).first().x == "\n\nkeep"


def test_division(spark):
    df = spark.createDataFrame([("a", "x", ""), ("b", "x", "Docker"), ("b", "y", "Docker"), ("c", "y", "Cloud"), ("d", "x", "Cloud"), ("d", "y", "Cloud")], "id string, c string, deployment string")
    assert rows(J.divides(df, df, "id", "id", "c"), "id", "related_id") == [("a", "b"), ("a", "d"), ("b", "d"), ("c", "b"), ("c", "d"), ("d", "b")]
    assert rows(J.divides(df, df, "id", "id", "c", J.labs_compatible(), ("deployment",)), "id", "related_id") == [("a", "b"), ("c", "d")]
    assert rows(J.divides(df, df, "id", "id", "c", J.docs_compatible(), ("deployment",)), "id", "related_id") == [("c", "d")]


def test_as_of_is_inclusive(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 1), (3, "k", 9), (4, "z", 5)], "id long, k string, ts long")
    right = spark.createDataFrame([("k", 5, 50), ("k", 5, 51), ("k", 2, 20)], "k string, rts long, rid long")
    got = {r.id: (r.rid, r.matched_rts) for r in J.as_of(left, right, ["k"], "ts", "rts", "rid", ["rid"]).collect()}
    assert got == {1: (51, 5), 2: (None, None), 3: (51, 5), 4: (None, None)}


def test_upsert_by_name(spark):
    base = spark.createDataFrame([("a", "one"), ("b", "two")], "k string, v string")
    over = spark.createDataFrame([("a", None, "ONE"), ("x", "b", "TWO"), ("y", None, "new")], "k string, name string, v string")
    assert rows(J.upsert(base, over, "k", ["v"], "name"), "k", "v", "origin") == [("a", "ONE", "both"), ("b", "TWO", "both"), ("y", "new", "stub")]


def test_alias_precedence(spark):
    found = spark.createDataFrame([("n", 1, "ro"), ("al", 0, "rw")], "name string, rank int, v string")
    df = spark.createDataFrame([("n", ["al"]), ("q", None)], "k string, aliases array<string>")
    assert rows(J.by_name_or_alias(df, found, "k", "aliases", "name", "rank"), "k", "v") == [("n", "rw"), ("q", None)]
    t = spark.createDataFrame([("u", "page", 0)], "key string, v string, ordinal int")
    assert rows(J.precedence([t, t.select("key", F.lit("alias").alias("v"), "ordinal")], "key"), "key", "v") == [("u", "page")]


def test_sync_protects(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, h string")
    old = spark.createDataFrame([(2, "x", "Doc", False), (3, "y", "Doc", False), (4, "z", "Lab", True), (5, "z", "Lab", False), (6, "q", None, None)], "k long, h string, type string, interactive boolean")
    assert rows(sinks.index_actions(new, old, "k", ["h"]), "k", "action") == [(1, "add"), (2, "update"), (3, "delete"), (5, "delete"), (6, "delete")]


def test_metrics_text(spark):
    lines = ["# TYPE a histogram", "# HELP a About a", 'a_bucket{le="1",x="2"} 3', "a_count{} 4", 'b{y="1"} 2', "lone 1", "# HELP b Late", "# UNIT b s"]
    got = {r.name: r for r in A.metrics(spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "line string, ordinal int")).collect()}
    assert set(got) == {"a", "a_bucket", "a_count", "b", "lone"}
    assert (got["a_bucket"].description, got["a_bucket"].type, got["a_bucket"].labels) == ("About a", "histogram", ["le", "x"])
    assert (got["b"].description, got["b"].unit, got["b"].type) == ("Late", "s", None) and got["lone"].description == "" and got["a_count"].labels == []


def test_budget_stops_at_first_overflow(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(["aa", "bbbb", "c"])], "k int, i int, x string")
    assert [r.x for r in O.byte_budget(df, ["k"], "i", "x", 5).collect()] == ["aa"]
    assert spark.range(1).select(O.text_budget(F.array(*map(F.lit, ["aa", "bbbb", "c"])), 5).alias("x")).first().x == "aa"


def test_title_chunks(spark):
    df = spark.createDataFrame([([{"t": "a b"}, {"t": "c"}, {"t": "d e f"}],), ([],)], "titles array<struct<t:string>>")
    got = [[[e.t for e in c] for c in r.x] for r in df.select(O.chunk_titles("titles", 3).alias("x")).collect()]
    assert got == [[["a b", "c"], ["d e f"]], [[]]]


def test_chunks_of_keys_that_span_tasks(spark):
    """The same numbers as chunk_titles(), with few and with many texts of a key, dealt out by ranges."""
    df = spark.range(3000).selectExpr("if(id % 10 = 0, 'few', if(id % 50 = 1, null, 'many')) as k", "id as i", "repeat('w ', cast(hash(id) % 7 as int) + if(id % 97 = 0, 30, 0)) as t")
    want = df.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "t"))).alias("x")).select("k", F.size(O.chunk_titles("x", 20)).alias("n"), F.size("x").alias("m"))
    got = O.chunk_counts(df.repartition(7), ["k"], ["i"], "t", 20)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    same = O.chunk_counts(spark.range(500).selectExpr("1 as k", "id as i", "'five words are in here' as t"), ["k"], ["i"], "t", 21).first()
    assert tuple(same) == (1, 125, 500)
    plan = O.chunk_counts(df, ["k"], ["i"], "t", 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "rangepartitioning" in plan.lower() or "RepartitionByExpression" in plan


def test_weak_claims_do_not_rise(spark):
    c = spark.createDataFrame([("n", "weak", False, 1, 0), ("n", "strong", True, 1, 1), ("n", "weak", True, 2, 2)], "name string, page string, declared boolean, strength int, ordinal int")
    assert rows(O.claims(c), "name", "page") == [("n", "strong")]


def test_datasets_keep_series(spark):
    pages = spark.createDataFrame([("s", "26.2", False), ("s", "25.1", False), ("cloud", "", True)], "component string, version string, cloud boolean")
    ds = spark.createDataFrame([("d1", "v26.2.1", True), ("d2", "v26.2.2-rc1", False), ("d3", "v26.3.1", True)], "dataset string, tag string, released boolean")
    assert rows(O.dataset_for(pages, ds), "component", "version", "dataset") == [("cloud", "", "d3"), ("s", "25.1", None), ("s", "26.2", "d2")]


def test_image_tags_ignore_patch(spark):
    df = spark.createDataFrame([("v24.1.9", 0), ("v24.2.1", 1), ("v24.2.5", 2)], "tag string, ordinal int")
    assert [r.tag for r in O.minor_order(df, "tag", "ordinal").collect()] == ["v24.2.1", "v24.2.5", "v24.1.9"]


PROPS = "name string, type string, description string, default_json string, is_deprecated boolean, is_experimental boolean"


def test_compare_properties(spark):
    old = spark.createDataFrame([("same", "t", "d", "1", False, False), ("dep", "t", "d", "1", False, False), ("gone", "t", "d", "1", False, False), ("development_x", "t", "d", "1", False, False), ("absent", "t", "d", None, False, False), ("keys", "t", "d", '{"a":1,"b":2}', False, False)], PROPS)
    new = spark.createDataFrame([("same", "t", "d", "1.0", False, False), ("dep", "u", "e", "2", True, False), ("absent", "t", "d", "null", False, False), ("keys", "t", "d", '{"b":2,"a":1}', False, False), ("added", "t", "  ", None, False, False)], PROPS)
    want = {("added", "newProperties"), ("added", "emptyDescriptions"), ("dep", "deprecatedProperties"), ("absent", "changedDefaults")}
    assert set(rows(D.compare_properties(old, new, "v25.3.1"), "name", "change")) == want | {("gone", "removedProperties")}
    assert set(rows(D.compare_properties(old, new, "dev"), "name", "change")) == want | {("gone", "removedDeprecatedProperties")}


def test_compare_fields_sees_key_order(spark):
    kind = "type string, name string, field string, default_json string, status string, is_deprecated boolean"
    old = spark.createDataFrame([("in", "a", "f", '{"a":1,"b":2}', None, None), ("in", "z", "f", "1", None, None)], kind)
    new = spark.createDataFrame([("in", "a", "f", '{"b":2,"a":1}', "Deprecated", None), ("in", "a", "g", None, None, None)], kind)
    assert set(rows(D.compare_fields(old, new, old, new), "field", "change")) == {("f", "changedDefaults"), ("f", "deprecatedFields"), ("g", "newFields")}


def test_compare_components(spark):
    kind = "type string, name string, status string, requires_cgo boolean, cloud_supported boolean, cloud_only boolean"
    old = spark.createDataFrame([("in", "a", "stable", True, False, None), ("in", "b", "stable", None, None, None)], kind)
    new = spark.createDataFrame([("in", "a", "DEPRECATED", None, True, None), ("out", "c", None, None, None, None)], kind)
    assert set(rows(D.compare_components(old, new), "name", "change")) == {("a", "deprecatedComponents"), ("a", "no_longer_cgo_only"), ("a", "added_cloud_support"), ("b", "removedComponents"), ("c", "newComponents")}


def test_compare_commands_rolls_up(spark):
    old = spark.createDataFrame([("r", "d"), ("r a", "d"), ("r a b", "d"), ("r c", "d")], "path string, description string")
    new = spark.createDataFrame([("r", "D"), ("r a", "d"), ("r n", "x")], "path string, description string")
    got = {(r.path, r.change, r.new) for r in D.compare_commands(old, new, spark.createDataFrame([("r a",)], "path string")).collect()}
    assert got == {("r", "descriptionChanges", "D"), ("r n", "newCommands", "x"), ("r c", "removedCommands", None), ("r a", "deprecatedCommands", "r a b")}


FLAGS = "path string, flag string, type string, default_json string, description string, required boolean"


def test_compare_flags_backfill(spark):
    commands = spark.createDataFrame([("r p x",), ("r q y",), ("r p install",)], "path string")
    old = spark.createDataFrame([("r q y", "f", "int", "1", "d", None), ("r p install", "v", "s", None, None, None)], FLAGS)
    new = spark.createDataFrame([("r p x", "n", "s", None, None, None), ("r q y", "f", "int32", "1.0", "d ", True), ("r p install", "v", "s", None, None, None)], FLAGS)
    got = set(rows(D.compare_flags(old, new, commands, commands), "path", "flag", "change"))
    assert got == {("r p x", None, "flagDataBackfilled"), ("r q y", "f", "changedFlagTypes"), ("r q y", "f", "changedFlagRequirements"), ("r q y", "f", "changedFlagDescriptions")}


def test_tree_without_names(spark):
    nodes = spark.createDataFrame([(1, None, "r"), (2, 1, " "), (3, 2, "x"), (4, None, None), (5, 4, "y")], "id long, parent long, name string")
    assert {(r.id, r.path) for r in TR.flatten(nodes).collect()} >= {(1, "r"), (3, "r x"), (5, "y")}
    with pytest.raises(ValueError, match="deeper"):
        TR.flatten(nodes, most=1)


def test_closure_ends_in_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "source string, target string")
    assert rows(TR.closure(e, spark.createDataFrame([("a",)], "id string")), "id") == [("a",), ("b",), ("c",)]


def test_json_walks(spark):
    doc = {"d": {"a": {"x": 1, "y": 2}, "loop": {"$ref": "#/d/loop", "k": 1}}, "use": {"$ref": "#/d/a", "y": 3}, "many": {"$refs": ["#/d/a", "#/d/loop"]}}
    out = TR.resolve(doc, doc)
    assert out["use"] == {"x": 1, "y": 3} and out["d"]["loop"] == {"k": 1} and out["many"] == {"x": 1, "y": 2, "k": 1}
    assert TR.deep_merge({"f": [{"name": "a", "v": 1}], "s": [1], "q": 1}, {"f": [{"name": "a", "v": 2}, {"name": "b"}], "s": [1, 2]}) == {"f": [{"name": "a", "v": 2}, {"name": "b"}], "s": [1, 2], "q": 1}
    assert TR.wrap_ref_siblings({"$ref": "x", "d": 1}) == {"allOf": [{"$ref": "x"}], "d": 1} and TR.wrap_ref_siblings({"$ref": "x"}) == {"$ref": "x"}
    assert TR.rewrite_strings({"a": ["b", 1]}, str.upper) == {"a": ["B", 1]}
    assert TR.dotted_fields([{"name": "a", "kind": "array", "children": [{"name": "b"}, {"name": "c", "is_deprecated": True}]}]) == [("a[]", ""), ("a[].b", "")]
    tree = spark.createDataFrame([("p", '{"a": 1}'), ("q", "{}")], "path string, body string")
    over = spark.createDataFrame([("p", '{"b": 2}')], "path string, body string")
    assert {r.path: json.loads(r.body) for r in TR.apply_overrides(tree, over).collect()} == {"p": {"a": 1, "b": 2}, "q": {}}


def test_merge_by_name(spark):
    kind = "array<struct<name:string,v:int>>"
    df = spark.createDataFrame([([("a", 1), ("b", 1)], [("b", 2), ("c", 2)])], f"x {kind}, y {kind}")
    assert [tuple(e) for e in df.select(SETS.merge_by_name("x", "y").alias("m")).first().m] == [("a", 1), ("b", 2), ("c", 2)]


def test_connector_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('name, type, commercial_name, support, cloud\nkafka, input, "Kafka, x", enterprise, y\n\n , input, z, , n\nfile, output, , , \n')
    got = R.connectors_csv(spark, str(tmp_path / "c.csv"))
    assert rows(got, "name", "type", "commercial_name", "support", "cloud") == [("file", "output", None, "community", "n"), ("kafka", "input", "Kafka, x", "enterprise", "y")]
    assert rows(R.enterprise_plugins(spark, str(tmp_path / "c.csv")), "name") == [("kafka",)]


def test_json_registry(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"properties": {"p": {"type": "integer", "default": None}, "q": {"description": "d"}}, "definitions": {"x": {"type": "object"}}}))
    got = {r.name: r for r in R.properties(R.json_documents(spark, str(tmp_path / "a.json"))).collect()}
    assert set(got) == {"p", "q"} and got["p"].default_json == "null" and got["q"].default_json is None
    (tmp_path / "b.json").write_text(json.dumps({"p": {"type": "integer"}, "other": {"z": 1}, "definitions": {"type": "object"}}))
    assert [r.name for r in R.properties(R.json_documents(spark, str(tmp_path / "b.json"))).collect()] == ["p"]
    (tmp_path / "c.json").write_text(json.dumps({"inputs": [{"name": "a"}, {"name": "b"}], "version": "1", "outputs": []}))
    assert rows(R.connector_index(R.json_documents(spark, str(tmp_path / "c.json"))), "type", "name") == [("inputs", "a"), ("inputs", "b")]


def test_pages(spark):
    html = '<html><nav><a href="/n">n</a></nav><article class="doc"><h1 id="t">Title &amp; x</h1><p>One <b>two<p>three</p><h2>Sub</h2><ul><li>item</ul><a href="/x">x</a></article><p>out</p>'
    r = R.parse_pages(spark.createDataFrame([(1, html), (2, None), (3, "<p>no article</p>")], "id int, html string")).orderBy("id").collect()
    assert r[0].title == "Title & x" and [h.text for h in r[0].headings] == ["Title & x", "Sub"] and r[0].texts == ["One two", "three", "item"] and r[0].links == ["/x"]
    assert not r[1].has_article and r[2].texts == []


def test_line_scanners(spark):
    text = "**https://a.b/c**, and `https://code` or link:https://l.m[two\nlines].\n----\nhttps://in.block\n....\n----\n:url: https://attr.x\nimage:d.png[link=https://v.w]"
    got = [(x[0], x[1], x[4], x[5], x[6]) for x in R.content_urls(text)]
    assert got == [("https://a.b/c", None, False, False, False), ("https://l.m", "two lines", True, False, False), ("https://attr.x", None, False, True, False), ("https://v.w", None, False, False, True)]
    df = R.scan_rows(spark.createDataFrame([("p", text), ("q", None)], "path string, contents string"), "contents", R.content_urls, *R.URLS)
    assert df.count() == 4
    flags = R.help_flags("Usage:\n\nFlags:\n  -h, --help            Help text\n      --size int        The size\n                        of it (default 10)\nGlobal Flags:\n      --verbose\n")
    assert flags == [("help", "h", "bool", None, "Help text"), ("size", "", "int", "10", "The size of it"), ("verbose", "", "bool", None, "")]
    assert R.sections("intro\nUSAGE\nbody\n$ RUN THIS\nNOTES:\nx") == [("", "intro"), ("USAGE", "body\n$ RUN THIS"), ("NOTES", "x")]
    assert R.commented_values("# top\na:\n  # -- inner\n  b: 1\nc: 2\n") == [("a", "top"), ("a.b", "inner")]


def test_source_scans(spark):
    cpp = "enum class color : uint8_t { red = 0, // x\n green, blue };\nstatic constexpr size_t limit = 5_MiB;\nconstexpr int limit{7};"
    df = spark.createDataFrame([("p", cpp, 0)], "path string, contents string, ordinal int")
    assert [r.value for r in R.enums(df).orderBy("ordinal").collect()] == ["red", "green", "blue"]
    assert rows(R.constants(df), "name", "value") == [("limit", "7")]
    nav = spark.createDataFrame([("n", "* Section\n** xref:a.adoc[A]\n* xref:b.adoc[B]")], "path string, contents string")
    assert [(r.label, r.section) for r in R.nav(nav).orderBy("line").collect()] == [("Section", "Section"), ("A", "Section"), ("B", "Section")]
    xml = '<?xml version="1.0"?><urlset><url><loc>https://a</loc><lastmod>2024</lastmod></url><url><loc> https://b </loc></url></urlset>'
    assert [(r["loc"], r.lastmod) for r in R.sitemap(spark.createDataFrame([(xml,)], "contents string")).orderBy("ordinal").collect()] == [("https://a", "2024"), ("https://b", None)]
    reg = spark.createDataFrame([("a", ["x"]), ("b", ["x"]), ("c", None)], "name string, aliases array<string>")
    assert rows(R.duplicate_aliases(reg), "claim", "owners") == [("x", 2)]


def test_faq_and_groups(spark):
    df = spark.createDataFrame([("p", {"page-faq-2-question": "q2", "page-faq-2-answer": "a2", "page-faq-10-question": "q", "other": "x", "page-faq-1-question": "q1", "page-faq-1-answer": "a1"})], "page string, attributes map<string,string>")
    assert [(r.n, r.question) for r in A.faq_pivot(df).collect()] == [(1, "q1"), (2, "q2")]
    reg = spark.createDataFrame([("Azure", "r3", "z", "p", "t"), ("GCP", "r1", "z", "p", "b"), ("GCP", "r1", "z", "p", "a"), ("Other", "r", "z", "p", "t"), ("AWS", "r2", "z", None, "t")], "provider string, region string, zones string, product string, cluster_type string")
    assert [(r.provider, r.tiers) for r in A.regions(reg).collect()] == [("GCP", ["p: a, b"]), ("Azure", ["p: t"])]
    feats = spark.createDataFrame([("Éa", "s", "ga"), ("eb", "s", "ga"), ("Zc", "s", "ga"), ("x", "s", "unreleased")], "name string, scope string, status string")
    assert [r.name for r in A.feature_table(feats, "s", ["ga"]).collect()] == ["Éa", "eb", "Zc"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("g", "u2", "b"), ("g", "u1", "a")], "g string, u string, t string")
    assert sinks.corpus_text(df, "g", "u", "t").first().value == "# Page 1: u1\n\na\n\n---\n\n# Page 2: u2\n\nb"
    sinks.write_versions(df.withColumn("version", F.lit("v1")), str(tmp_path / "v"))
    assert spark.read.json(str(tmp_path / "v")).filter("version = 'v1'").count() == 2
    with pytest.raises(ValueError):
        sinks.attach(df, df)
    assert T is not None


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    data = spark.createDataFrame([(b"k1", b"error x"), (None, b"fine"), (b"error", None), (b"k2", b"an error")], "key binary, value binary")
    data.write.parquet(src)
    got = []
    env = {"PATTERN": "error", "MATCH_VALUE": "yes"}
    q = records.run_filter(spark.readStream.schema(data.schema).parquet(src), env, lambda b, _: got.extend(bytes(r.value) for r in b.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(got) == sorted(bytes(r.value) for r in records.regex_filter(data, "error").collect()) == [b"an error", b"error x"]
    assert records.regex_filter(data, "error", "key").count() == 1
    with pytest.raises(ValueError):
        records.options({})


def test_lint_and_entities_against_python(spark, sf):
    """The queries without SQL, over all rows."""
    import hashlib
    import html
    import re

    from sparkloom.plans import catalogue

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = set()
    for i, text in texts.items():
        seen = set()
        for n, line in enumerate((text or "").split("\n"), 1):
            want |= {(i, n, rule) for rule, p in FL.LINT.items() if re.search(p, line)}
            if len(line.strip(" ")) > 40:
                want |= {(i, n, "duplicate-content")} if line in seen else set()
                seen.add(line)
    assert {tuple(r) for r in catalogue.queries()["content_lint"](spark, sf).collect()} == want
    got = {r.page_id: r.decoded_md5 for r in catalogue.queries()["html_entity_decode"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        a = re.search(r"(?s)<article[^>]*>(.*?)</article>", r.html or "")
        a = re.sub(r"&#(\d+);|&#x([0-9a-fA-F]+);", lambda m: chr(int(m[1]) if m[1] else int(m[2], 16)), a[1] if a else "")
        for name, sign in T.NAMED:
            a = a.replace(name, sign)
        assert got[r.page_id] == hashlib.md5(a.encode()).hexdigest()
