"""Literal edge cases of the scalar functions, one for each rule that a plain translation gets wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import scalars as S
from sparkloom.functions import text as T
from sparkloom.sources import readers as R


@pytest.fixture(scope="module")
def apply(spark):
    def run(f, *values):
        """f(column) over the values in order."""
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
        return [r.y for r in rows.select("i", f("x").alias("y")).orderBy("i").collect()]

    return run


CASES = [
    (T.decode_entities, {"&#233;&#x41;": "éA", "&amp;lt;": "<", "&lt;b&gt; &quot;&apos;": "<b> \"'", "&#8364;x&#65": "€x&#65", "": "", "a&nbsp;": "a&nbsp;"}),
    (T.collapse_space, {" a \n\t b ": "a b"}),
    (T.markdown_url, {"": "", "/": "/index.md", "/index.html": "/index.md", "/a/": "/a.md", "/a/index.html": "/a.md", "/a.html": "/a.md", "/a.md": "/a.md", "/a": "/a.md"}),
    (lambda c: T.strip_metadata(c, "See (all)."), {"<!-- Source: x -->\ntext\n> See (all). more\n<!-- mine -->": "text\n\n<!-- mine -->"}),
    (lambda c: T.truncate_at_newline(c, 5), {"abc": "abc", "ab\ncdef": "ab", "abcdefg": "abcde"}),
    (lambda c: T.truncate_words(c, 10), {"": "*No description*", "short": "short", "abcdefgh ij kl": "abcdefgh i...", "abcdefghi j kl": "abcdefghi...", "ab cdefghijkl": "ab cdefghi..."}),
    (T.first_sentence, {"Use 1.5 of it. Then": "Use 1.5 of it.", "No end\n\nSecond. x": "No end", "Line\n  two. x": "Line two.", "": "", "v1.2": "v1.2"}),
    (T.truncate_sentences, {"A [b](c). *D*! E?": "A b.  D!", "none": "none"}),
    (T.cap_sentences, {"One, e.g. this. Two 1.5. Three.": "One, e.g. this. Two 1.5.", "See http://a.b/c. End": "See http://a.b/c. End"}),
    (T.ensure_period, {"a": "a.", " a ": "a.", "a!": "a!", " a. ": " a. ", "": "", "  ": "  "}),
    (T.anchor_name, {"cloud.Storage_x": "cloud-storage_x", "--A b--": "a-b"}),
    (T.property_anchor, {"a.b.c": "a-b-c"}),
    (T.heading_id, {"What's `new` in v1.2?": "whats-new-in-v1-2", "--A  B--": "a-b", "a_b": "a_b"}),
    (T.link_text, {"xref:a.adoc[b] [c]  d": "b c d"}),
    (T.escape_html, {"<a&'\">": "&lt;a&amp;&#39;&quot;&gt;"}),
    (T.escape_pipes, {"a|b": "a\\|b"}),
    (T.escape_regex, {"a.b(c)": "a\\.b\\(c\\)"}),
    (T.parent_path, {"a b c": "a b", "a": ""}),
    (T.capitalize, {"abc dEf": "Abc dEf", "": ""}),
    (T.unit_of, {"retention_ms": "milliseconds", "x_partitions": "number of partitions per topic", "plain": "", "": ""}),
    (T.format_default, {"null": "`null`", "3600000": "`3600000` (1h)", "90000": "`90000` (1.5m)", "1000": "`1000` (1s)", "999": "`999`", '"a"': '`"a"`', "[]": "`[]`", "[1,2]": "`[2 items]`", "true": "`true`", '{"a":1}': '`{"a":1}`'}),
    (T.url_path, {"https://a.b/c?d#e": "/c", "https://a.b/": "", "/x?y": "/x?y", "nonsense": "", "": "", "https://a.b": ""}),
    (T.normal_path, {"/a/index.html?x": "/a", "/a.html": "/a", "/a/": "/a", "/": "/", "": "/", "/index.html": "/"}),
    (T.page_title, {"https://a.b/": "Home", "https://a.b/x/my-page.html": "My Page"}),
    (T.token_count, {"a_b.c/d:e-f g": 7, "": 1, "...": 1}),
    (T.collapse_blank_lines, {"a\n\n\n\nb": "a\n\nb"}),
    (T.clean_url_breaks, {"x​ https://a​b–c y–z": "x​ https://ab-c y–z"}),
    (T.pointer_unescape, {"a~1b~0c": "a/b~c", "~01": "~1"}),
    (T.json_type, {"std::optional<int32_t>": "integer", "ss::sstring": "string", "std::vector<x>": "array", "bool": "boolean", "double": "number", "std::chrono::milliseconds": "integer", "x::y": "object"}),
    (T.cpp_default, {"1'024ULL": "1024", "std::nullopt": "null", "{5}": "5"}),
    (S.is_prerelease, {"v1.2.3-rc1": True, "1.2.3": False, "x-y": True, "x": False}),
    (S.series, {"v26.2.1": "26.2", "25.3.1-rc1": "25.3", "dev": None}),
    (lambda c: S.removes_deprecated(c), {"v26.1.0": True, "25.3.9": False, "dev": True, "27": True, "26.0": False}),
    (S.parse_size, {"256_MiB": 268435456, "1'024_KiB": 1048576, "1048576ULL": 1048576, "5_GB": 5000000000, "x_MiB": None, "": None, "x": None}),
    (lambda c: S.friendly_size(S.parse_size(c)), {"256_MiB": "256 MiB (268435456)", "1000": "1000", "1_GiB": "1 GiB (1073741824)", "1536": "1536"}),
    (S.arithmetic, {"7 / 2": 3, "-7/2": -3, "2*3": 6, "5 - 8": -3, "1/0": None, "12": 12, "a+b": None}),
    (S.chrono_ms, {"24h * 365": 31536000000, "30min": 1800000, "5ms": 5, "x": None}),
    (lambda c: S.canonical(c), {'{"b":1,"a":{"d":1,"c":2}}': '{"a":{"c":2,"d":1},"b":1}', "1.0": "1.0", "1": "1.0", "1e0": "1.0", '"1"': '"1"'}),
    (lambda c: S.truthy(c), {"": False, "0": False, "false": False, "x": True}),
    (lambda c: R.price(c)["amount"].cast("string"), {"USD 10.50": "10.50", "USD 7": "7.00", "usd 7": None, "USD 7.5": None}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_case(apply, case):
    f, table = CASES[case]
    assert apply(f, *table) == list(table.values())


def test_nulls_do_not_fail(apply):
    for f, _ in CASES:
        apply(f, None)


def test_anchor_of_nothing_is_an_error(apply):
    with pytest.raises(Exception, match="Invalid property name"):
        apply(T.anchor_name, "---")


def test_versions_sort(spark):
    tags = ["v1.2.3", "v1.2.3-rc10", "v1.2.3-rc9", "v1.10.0", "v1.2.3-beta.1", "1.2.4"]
    rows = spark.createDataFrame([(x,) for x in [*tags, "dev"]], "t string").withColumn("k", S.version_key("t"))
    assert [r.t for r in rows.filter("k is not null").orderBy("k").collect()] == ["v1.2.3-beta.1", "v1.2.3-rc9", "v1.2.3-rc10", "v1.2.3", "1.2.4", "v1.10.0"]
    assert [r.t for r in rows.filter("k is null").collect()] == ["dev"]
    assert rows.filter(S.is_stable("t", F.lit(False))).count() == 3


def test_months_overflow(spark):
    """Jan 31 and a month is Mar 2 or 3, not the end of February."""
    rows = spark.createDataFrame([(dt.date(2024, 1, 31),), (dt.date(2023, 1, 31),), (dt.date(2024, 1, 15),)], "d date")
    assert [str(r.x) for r in rows.select(S.add_months_overflow("d", 1).alias("x")).collect()] == ["2024-03-02", "2023-03-03", "2024-02-15"]


def test_end_of_life_moment(spark):
    row = lambda now, d="2024-01-31": spark.range(1).select(S.end_of_life(F.lit(d), F.lit(now).cast("timestamp"), 1, 6).alias("e")).first().e
    assert (row("2024-03-02 00:00:00").is_near, row("2024-03-02 00:00:00").is_past, row("2024-03-02").label) == (False, False, "March 2, 2024")
    assert row("2024-03-01").is_near and row("2024-03-03").is_past and not row("2024-01-01").is_near
    assert row("2024-01-01", "soon") is None


def test_human_time(spark):
    rows = [(604_800_000, "ms", "1 week"), (604_800, "s", "1 week"), (86_400_000, "ms", "1 day"), (5400, "s", "90 minutes"), (31_536_000_000, "ms", "1 year"), (0, "ms", "0 milliseconds"), (0, "s", "0 seconds"), (60, "min", "60 milliseconds"), (1, "ms", "1 millisecond")]
    df = spark.createDataFrame(rows, "v long, u string, want string").withColumn("got", S.human_time("v", "u"))
    assert df.filter("got != want or got is null").collect() == []


def test_json_equality(spark):
    rows = [('{"a":1,"b":2}', '{"b":2,"a":1}', True), (None, "null", False), (None, None, True), ("null", "null", True), ("1", "1.0", True), ('"1"', "1", False), ("[1,2]", "[2,1]", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean").withColumn("got", S.json_equal("a", "b"))
    assert df.filter("got != want or got is null").collect() == []


def test_bounds(spark):
    got = spark.createDataFrame([("uint64_t",), ("int8_t",), ("x",)], "k string").select(S.int_bounds("k").alias("b")).collect()
    assert (int(got[0].b.maximum), int(got[0].b.minimum)) == (2**64 - 1, 0) and (int(got[1].b.minimum), int(got[1].b.maximum)) == (-128, 127) and got[2].b is None


def test_deployment_differs_by_caller(spark):
    df = spark.createDataFrame([({"cloud": "y"},), ({"page-cloud": "y"},), ({"env-cloud": "y"},), ({"env-linux": "", "env-docker": "y"},)], "a map<string,string>")
    got = {c: [r.x for r in df.select(T.deployment_type("a", c).alias("x")).collect()] for c in T.CLOUD_KEYS}
    assert got["docs"] == ["Cloud", "", "", "Docker"] and got["labs"] == ["", "Cloud", "Cloud", "Docker"] and got["search"] == ["", "Cloud", "", "Docker"]


def test_alias_spec(spark):
    specs = ["a.adoc", "m:a", "c:m:a.adoc", "x:m:a.adoc", "2.0@a", "1.0@c:m:a", "", "a:b:c:d", ":a"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(specs)], "i int, s string").select("i", T.alias_spec("s", F.lit("c"), F.lit("1.0"), F.lit("M")).alias("r")).orderBy("i")
    assert [None if r.r is None else tuple(r.r) for r in df.collect()] == [("M", "a.adoc"), ("m", "a.adoc"), ("m", "a.adoc"), None, None, ("m", "a.adoc"), None, None, ("M", "a.adoc")]


def test_resource_id(spark):
    r = spark.range(1).select(T.resource_id(F.lit("1.0@c:m:partial$a.adoc")).alias("r"), T.resource_id(F.lit("a.adoc")).alias("s")).first()
    assert tuple(r.r) == ("1.0", "c", "m", "partial", "a.adoc") and r.s.relative == "a.adoc" and r.s.module is None
