from pyspark.sql import functions as F

from sparkloom.sources import readers as R
from sparkloom.sources import scanners as S


def test_go_and_cpp():
    go = 'a := &cobra.Command{ Use: "x [flags]", Run: func() { a("}") }, Hidden: true }\nb := &cobra.Command{Use: "y", Deprecated: "use \\"z\\""}\nc := &cobra.Command{Use: "ok"}'
    assert S.hidden_commands(go) == [("x", True, None), ("y", False, 'use \\"z\\"')]
    cpp = "struct conf { int a = 5; // x\n std::optional<int> b; };"
    assert S.struct_fields(cpp) == [("conf", 0, "int", "a", "5"), ("conf", 1, "std::optional<int>", "b", None)]
    assert S.arguments('a, f(b, c), "x,y", {1, 2}') == ["a", "f(b, c)", '"x,y"', "{1, 2}"]
    assert [S.cpp_value(x) for x in ("std::nullopt", 'ss::sstring("q")', "std::chrono::seconds{30}", "model::mode::fast", "1'000u", "{1, 2}")] == [None, "q", "30 seconds", "fast", "1000", "[1, 2]"]


def test_asciidoc():
    doc = "= Title\n:attr: v\nintro\n\n== One\nx\n----\n== not\n----\n"
    assert S.document(doc) == [("attribute", 0, "attr", "v"), ("title", 0, "Title", "intro"), ("section", 1, "One", "x\n----\n== not\n----")]
    assert S.numbered_lists("  1. a\n  2. b\n  4. c\nx") == ". a\n. b\n  4. c\nx"
    assert S.indented_tables("  a  b\n  c  d\n  alone here") == "|===\n|a |b\n|c |d\n|===\n  alone here"
    assert S.code_blocks("t\n\n    run x\n    y\nz") == "t\n\n----\nrun x\ny\n----\nz"
    assert S.first_mentions("`a` and `a`\n`a`\n\n`a`\n* `a`", {"a": "prop:a[]"}) == "prop:a[] and `a`\n`a`\n\nprop:a[]\n* prop:a[]"


def test_markdown():
    html = "<article><h1>T</h1><p>a <b>b</b> <code>c</code> <a href='/x'>l</a></p><ul><li>i</li><li>j</li></ul><pre>x  y</pre></article>"
    assert S.markdown(html) == "# T\n\na **b** `c` [l](/x)\n- i\n- j\n\n```\nx  y\n```"


def test_schema_and_types():
    schema = {"properties": {"a": {"properties": {"b": {}}, "additionalProperties": False}, "r": {"$ref": "x"}}, "patternProperties": {"^x-": {}}, "additionalProperties": False}
    assert [S.schema_allows(schema, p) for p in ("a.b", "a.c", "r.any", "x-1", "q")] == [True, False, True, True, False]
    defs = {"model::mode": {"$ref": "#/definitions/config::real"}, "config::real": {"type": "string"}}
    assert S.resolve_type("mode", defs) == {"type": "string"} and S.resolve_type("none", defs) is None


def test_over_batches(spark):
    df = spark.createDataFrame([("p", "= T\nx"), ("q", None)], "path string, contents string")
    assert R.scan_rows(df, "contents", S.document, *S.DOCUMENT).count() == 1
    assert [r.x for r in df.select(S.text_udf(S.numbered_lists)(F.col("contents")).alias("x")).collect()] == ["= T\nx", None]
