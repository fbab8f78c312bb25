"""Queries of scans, sinks, joins, groupings and streams whose inputs Spark makes of the given tables, some of them as files that the scan then reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import diffs as D
from ..operators import filters as FL
from ..operators import joins as J
from ..operators import ordered as O
from ..operators import trees as TR
from ..session import own_folder, ship
from ..sources import readers as R
from ..sources import sinks
from ..streaming import records, state
from .catalogue import query, t
from .more import cat, key


def _part(spark, d, **columns):
    """Rows of part with columns of their own."""
    return t(spark, d, "part").select(*(c.alias(n) for n, c in columns.items()))


def name():
    return F.col("p_name")


def kind():
    return F.col("p_type")


def size():
    return F.col("p_size")


def _pick(n, *values):
    """One of the values by the row's key."""
    out = F.when(key() % n == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(key() % n == i, v)
    return out


# files ---------------------------------------------------------------------------------------------------------------------------


def _csv(spark, d):
    path = f"{own_folder(spark)}/csv"
    rows = t(spark, d, "part").select(cat("c", key()).alias("name"), F.when(key() % 7 > 0, kind()).alias(" type"), cat(name(), ", ", key()).alias(" commercial_name"), _pick(3, F.lit("Enterprise"), F.lit(" "), F.lit("certified ")).alias(" support"), _pick(4, F.lit("y"), F.lit("Yes"), F.lit("n"), F.lit(None)).alias(" cloud"))
    rows.write.csv(path, header=True)
    return path


@query("""
SELECT 'c' || p_partkey AS name, p_type AS type, p_name || ', ' || p_partkey AS commercial_name, CASE p_partkey % 3 WHEN 0 THEN 'Enterprise' WHEN 1 THEN 'community' ELSE 'certified' END AS support, CASE WHEN p_partkey % 4 < 2 THEN 'y' ELSE 'n' END AS cloud FROM part WHERE p_partkey % 7 > 0
""")
def connector_table(spark, d):
    """A table of connectors, written and read with its odd headers and cells [SRC1, SRC2]."""
    return R.connectors_csv(spark, _csv(spark, d)).select("name", "type", "commercial_name", "support", "cloud")


@query("SELECT 'c' || p_partkey AS name FROM part WHERE p_partkey % 7 > 0 AND p_partkey % 3 = 0")
def enterprise_plugins(spark, d):
    """[SRC4]"""
    return R.enterprise_plugins(spark, _csv(spark, d))


def _documents(spark, d, entry, body):
    """A JSON file for each 50 parts: entries (name, value) put into a text."""
    path = f"{own_folder(spark)}/json"
    rows = t(spark, d, "part").groupBy(F.floor(key() / 50).alias("g")).agg(F.array_join(F.collect_list(entry), ",").alias("e"))
    rows.select(F.format_string(body, "e").alias("value"), "g").write.partitionBy("g").text(path)
    return R.json_documents(spark, f"{path}/*")


@query("""
SELECT 'p' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS type, CASE WHEN p_partkey % 5 > 0 THEN p_name END AS description,
  CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN 'null' END AS default_json, CASE WHEN p_partkey % 4 = 0 THEN true END AS is_deprecated FROM part
""")
def registry_properties(spark, d):
    """Properties of JSON registries; a default that is null is not a missing one [SRC5]."""
    parts = F.concat_ws(", ", F.when(key() % 2 == 0, cat('"type": "', kind(), '"')), F.when(key() % 5 > 0, cat('"description": "', name(), '"')), F.when(key() % 3 < 2, F.concat(F.lit('"default": '), F.when(key() % 3 == 0, size().cast("string")).otherwise("null"))), F.when(key() % 4 == 0, F.lit('"is_deprecated": true')))
    docs = _documents(spark, d, F.concat(cat('"p', key(), '": {'), parts, F.lit("}")), '{"properties": {%s}, "definitions": {"x": {"type": "object"}}}')
    return R.properties(docs).select("name", "type", "description", "default_json", "is_deprecated")


@query("SELECT 'c' || p_partkey AS name, 'inputs' AS type, CAST(row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) - 1 AS INTEGER) AS ordinal FROM part UNION ALL SELECT DISTINCT 'o' || (p_partkey // 50), 'outputs', 0 FROM part")
def connector_entries(spark, d):
    """Entries of every list of a connector index [SRC6]."""
    path = f"{own_folder(spark)}/index"
    rows = t(spark, d, "part").groupBy(F.floor(key() / 50).alias("g")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("p_partkey")), lambda k: F.concat(F.lit('{"name": "c'), k, F.lit('"}'))), ",").alias("e"))
    rows.select(F.concat(F.lit('{"version": "1", "inputs": ['), "e", F.lit('], "outputs": [{"name": "o'), "g", F.lit('"}, {"x": 1}]}')).alias("value"), "g").write.partitionBy("g").text(path)
    return R.connector_index(R.json_documents(spark, f"{path}/*")).select("name", "type", "ordinal")


@query("SELECT p_partkey, p_name FROM part WHERE p_size = 7")
def version_folder(spark, d):
    """Versions in folders of their own, of which one is read [SRC7]."""
    path = f"{own_folder(spark)}/versions"
    sinks.write_versions(_part(spark, d, p_partkey=key(), p_name=name(), version=cat("v", size())), path)
    return spark.read.schema("p_partkey long, p_name string, version string").json(path).filter("version = 'v7'").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS size FROM part WHERE p_partkey % 4 > 0 UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_partkey % 4 = 0")
def yaml_fields(spark, d):
    """YAML texts; what cannot be read is null [SRC8]."""
    ship(spark)
    text = F.when(key() % 4 == 0, F.lit("a: [b")).otherwise(F.concat(cat("name: ", name()), F.when(key() % 3 == 0, cat("\nsize: ", size())).otherwise("")))
    docs = R.yaml_documents(_part(spark, d, p_partkey=key(), contents=text))
    return docs.select("p_partkey", F.try_variant_get("doc", "$.name", "string").alias("name"), F.try_variant_get("doc", "$.size", "int").alias("size"))


@query("""
WITH s AS (SELECT p_name AS title, 'playground/' || p_partkey AS path, p_partkey FROM part WHERE p_partkey % 5 > 0 AND p_partkey % 7 > 0) SELECT title, arg_min(path, p_partkey) AS path FROM s GROUP BY title
""")
def playground_samples(spark, d):
    """Samples of a folder, the first of each title [SRC9]."""
    rows = _part(spark, d, path=F.when(key() % 5 > 0, cat("playground/", key())).otherwise(cat("other/", key())), title=name(), input=F.when(key() % 7 > 0, "in"), mapping=F.lit("map"), ordinal=key())
    return R.samples(rows).select("title", "path")


@query("""
WITH a AS (SELECT 's' || s_suppkey AS key, 'supplier' AS source, 'S' || s_suppkey AS v FROM supplier), p AS (SELECT 's' || (p_partkey % 150) AS key, 'part' AS source, 'P' || min(p_partkey) AS v FROM part WHERE p_partkey % 150 <= 149 GROUP BY ALL)
SELECT * FROM a UNION ALL SELECT * FROM p WHERE key NOT IN (SELECT key FROM a)
""")
def source_precedence(spark, d):
    """The first of two sources with a key wins, in it the first row [SRC10, J15]."""
    a = t(spark, d, "supplier").select(cat("s", F.col("s_suppkey")).alias("key"), F.lit("supplier").alias("source"), cat("S", F.col("s_suppkey")).alias("v"), F.col("s_suppkey").alias("ordinal"))
    b = _part(spark, d, key=cat("s", key() % 150), source=F.lit("part"), v=cat("P", key()), ordinal=key())
    return J.precedence([a, b], "key")


@query("SELECT p_partkey // 20 AS g, 'https://a/' || p_partkey AS loc, CASE WHEN p_partkey % 3 = 0 THEN '2024-01-' || (10 + p_size % 10) END AS lastmod FROM part")
def sitemap_entries(spark, d):
    """Entries of sitemaps in XML [SRC11]."""
    entry = F.concat(cat("<url><loc> https://a/", key(), " </loc>"), F.when(key() % 3 == 0, cat("<lastmod>2024-01-", 10 + size() % 10, "</lastmod>")).otherwise(""), F.lit("</url>"))
    rows = t(spark, d, "part").groupBy(F.floor(key() / 20).alias("g")).agg(F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="x">'), F.array_join(F.collect_list(entry), "\n"), F.lit("</urlset>")).alias("contents"))
    return R.sitemap(rows).select("loc", "lastmod").withColumn("g", F.floor(F.regexp_extract("loc", r"(\d+)$", 1).cast("long") / 20))


@query("SELECT 'a/x' || p_partkey AS stem, 'a/x' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.h' ELSE '.hpp' END AS header, CASE WHEN p_partkey % 3 = 0 THEN 'a/x' || p_partkey || '.cc' END AS source FROM part WHERE p_partkey % 5 > 0")
def header_pairs(spark, d):
    """[SRC17]"""
    files = t(spark, d, "part").select(F.explode(F.array_compact(F.array(F.when(key() % 5 > 0, F.concat(cat("a/x", key()), F.when(key() % 2 == 0, ".h").otherwise(".hpp"))), F.when(key() % 3 == 0, cat("a/x", key(), ".cc")), cat("a/y", key(), ".cc")))).alias("path"))
    return R.file_pairs(files)


@query("""
WITH c AS (SELECT 'limit' || (p_partkey % 500) AS name, CAST(p_size AS VARCHAR) AS value, p_partkey FROM part UNION ALL SELECT 'name' || p_partkey, p_name, p_partkey FROM part) SELECT name, arg_max(value, p_partkey) AS value FROM c GROUP BY name
""")
def source_constants(spark, d):
    """Constants of sources; of a name the last file's counts [SRC18]."""
    ship(spark)
    text = cat("static constexpr int limit", key() % 500, "{", size(), '};\nconstexpr std::string_view name', key(), '{"', name(), '"};')
    return R.constants(_part(spark, d, contents=text, ordinal=key().cast("int")))


@query("SELECT p_partkey, 'color' || p_partkey AS enum, CAST(i AS INTEGER) AS ordinal, CASE i WHEN 0 THEN 'red' WHEN 1 THEN 'v' || p_size ELSE 'blue' END AS value FROM part, (SELECT unnest([0, 1, 2]) AS i)")
def enum_values(spark, d):
    """[SRC26]"""
    rows = R.enums(_part(spark, d, contents=cat("enum class color", key(), " : uint8_t { red = 0, // x, y\n v", size(), " /* c */, blue };")))
    return rows.withColumn("p_partkey", F.regexp_extract("enum", r"(\d+)$", 1).cast("long"))


@query("SELECT p_partkey, 'newX' || p_partkey AS constructor, 'x' || p_size AS use FROM part")
def go_constructors(spark, d):
    """[SRC21]"""
    return R.go_commands(_part(spark, d, p_partkey=key(), contents=cat("func newX", key(), '(p P) *cobra.Command {\n c := &cobra.Command{\n Use: "x', size(), ' [y]",')), keys=("p_partkey",))


@query("SELECT p_partkey, i AS ordinal, 'F ' || p_name || i AS feature, 'S ' || (p_size + i) AS setting FROM part, (SELECT unnest([0, 1]) AS i)")
def feature_settings(spark, d):
    """[SRC25]"""
    body = cat("|===\n| F ", name(), "0\n| S ", size(), "\n\n| F ", name(), "1\n| S ", size() + 1, "\n|===")
    return R.alternating_table(_part(spark, d, p_partkey=key(), contents=body), keys=("p_partkey",))


@query("""
SELECT p_partkey, CAST(i AS INTEGER) AS line, CAST(CASE i WHEN 2 THEN 2 ELSE 1 END AS INTEGER) AS level, CASE i WHEN 1 THEN '' WHEN 2 THEN 'a' || p_partkey || '.adoc' ELSE 'b.adoc' END AS target, CASE i WHEN 1 THEN p_name WHEN 2 THEN 'A' ELSE p_type END AS label, p_name AS section FROM part, (SELECT unnest([1, 2, 3]) AS i)
""")
def navigation_entries(spark, d):
    """[SRC28, W8]"""
    text = cat("* ", name(), "\n** xref:a", key(), ".adoc[A]\n* xref:b.adoc[", kind(), "]\nother")
    return R.nav(_part(spark, d, p_partkey=key(), contents=text), keys=("p_partkey",)).select("p_partkey", "line", "level", "target", "label", "section")


@query("SELECT 'p' || (p_partkey % 100) AS path, p_partkey AS pos, p_name AS date FROM part WHERE p_partkey % 3 > 0 OR p_size > 25")
def changed_files(spark, d):
    """Commits that changed a file, first ones too [SRC29]."""
    rows = _part(spark, d, path=cat("p", key() % 100), pos=key(), date=name(), oid=F.when(key() % 3 > 0, cat("o", key())).otherwise("same"), parent_oid=F.when((key() % 3 == 0) & (size() <= 25), "same"))
    return R.commit_changes(rows)


@query("SELECT p_partkey, 'a' || p_partkey AS name, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'b' || p_partkey, 'x=' || p_name FROM part")
def environment_options(spark, d):
    """[SRC33]"""
    rows = R.env_options(_part(spark, d, contents=cat("a", key(), "=", size(), ", b", key(), " = x=", name(), "\nnoise")))
    return rows.withColumn("p_partkey", F.regexp_extract("name", r"(\d+)", 1).cast("long"))


@query("WITH c AS (SELECT p_partkey, 'n' || p_partkey AS claim FROM part UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'n' || (p_partkey + 1) FROM part WHERE p_partkey % 3 = 0) SELECT claim, count(DISTINCT p_partkey) AS owners FROM c GROUP BY claim HAVING owners > 1")
def claimed_twice(spark, d):
    """[SRC34]"""
    return R.duplicate_aliases(_part(spark, d, name=cat("n", key()), aliases=F.when(key() % 3 == 0, F.array(name(), cat("n", key() + 1)))))


@query("SELECT p_partkey, p_partkey % 3 < 2 AS is_beta FROM part")
def beta_fields(spark, d):
    """[SRC37]"""
    return R.mark_beta(_part(spark, d, p_partkey=key(), description=_pick(3, cat("BETA: ", name()), cat("\n beta: ", size()), cat("not BETA: ", name())))).select("p_partkey", "is_beta")


@query("""
WITH h AS (SELECT p_partkey, 'p' || p_partkey AS path, 'page' AS id, 'Page' AS title FROM part UNION ALL SELECT p_partkey, 'p' || p_partkey, 'own' || p_size, 'One' FROM part UNION ALL SELECT p_partkey, 'p' || p_partkey, 'two-' || (p_partkey % 10), 'Two ' || (p_partkey % 10) FROM part)
SELECT path, id, title FROM h
""")
def included_headings(spark, d):
    """Ids of headings, own and included; of an id the page's own counts [REC12]."""
    ship(spark)
    pages = _part(spark, d, path=cat("p", key()), contents=cat("= Page\n[[own", size(), "]]\n== One\ninclude::part", key() % 10, ".adoc[]\ninclude::none.adoc[]"))
    partials = t(spark, d, "part").filter("p_partkey < 10").select(cat("part", key(), ".adoc").alias("path"), cat("== Two ", key(), "\n== Page").alias("contents"))
    return R.page_headings(pages, partials)


# filters -------------------------------------------------------------------------------------------------------------------------


def _attributes(*pairs):
    return F.map_from_entries(F.array_compact(F.array(*pairs)))


def _entry(k, v, when=None):
    e = F.struct(k if not isinstance(k, str) else F.lit(k), v if not isinstance(v, str) else F.lit(v))
    return e if when is None else F.when(when, e)


@query("SELECT p_partkey FROM part WHERE p_partkey % 4 > 0 AND p_partkey % 3 > 0 AND (p_partkey % 5 > 0 OR p_size % 2 = 0)")
def indexable_pages(spark, d):
    """Pages with output and without marks that keep them from the index [F1]."""
    marks = _attributes(_entry("noindex", "y", key() % 3 == 0), _entry("fields-only", F.when(size() % 2 == 0, "false").otherwise("yes"), key() % 5 == 0), _entry("x", "y"))
    return _part(spark, d, p_partkey=key(), out=F.when(key() % 4 > 0, "o"), a=marks).filter(FL.indexable("out", "a")).select("p_partkey")


@query("SELECT '/labs/' || p_partkey AS url, 'Docker' AS deployment FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 = 0")
def lab_items(spark, d):
    """[F3]"""
    return FL.gather_items(_part(spark, d, url=F.when(key() % 2 == 0, cat("/labs/", key())).otherwise(cat("/docs/", key())), deployment=F.when(key() % 3 == 0, "Docker").otherwise("Linux")), "url", "/labs/", "Docker")


@query("SELECT o_orderkey AS job_id, o_orderpriority AS tool FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = (SELECT min(o_orderpriority) FROM orders)")
def completed_jobs(spark, d):
    """Jobs of a status and a tool [F9]."""
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("tool"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return FL.jobs(rows, "F", rows.agg(F.min("tool")).first()[0]).select("job_id", "tool")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'learning-objective-' || p_size || ',page-x' ELSE 'learning-objective-' || p_size END AS kept FROM part")
def kept_attributes(spark, d):
    """[F13]"""
    a = _attributes(_entry("page-x", "1", key() % 2 == 0), _entry(cat("learning-objective-", size()), "l"), _entry("other", "o"))
    return _part(spark, d, p_partkey=key(), kept=F.array_join(F.array_sort(F.map_keys(FL.keep_attributes(a, ["page-x"]))), ","))


def _field(name, deprecated, advanced):
    return F.struct(name.alias("name"), deprecated.alias("is_deprecated"), advanced.alias("is_advanced"))


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 3 > 0 THEN 'a' || p_partkey END, CASE WHEN p_partkey % 2 > 0 THEN 'b' || p_size END) AS fields FROM part WHERE p_partkey % 6 > 0")
def public_definitions(spark, d):
    """Definitions without private fields, and none that is left empty [F14, F15]."""
    no = F.lit(False)
    rows = _part(spark, d, p_partkey=key(), fields=F.array(_field(F.when(key() % 3 > 0, cat("a", key())).otherwise("_a"), no, no), _field(F.when(key() % 2 > 0, cat("b", size())).otherwise("_b"), no, no)))
    return FL.drop_empty_definitions(rows).select("p_partkey", F.array_join(F.transform("fields", lambda x: x["name"]), ",").alias("fields"))


@query("SELECT p_partkey, concat_ws(',', 'p', CASE WHEN p_partkey % 2 = 0 THEN 'b' || p_size END) AS common, CASE WHEN p_partkey % 2 = 1 THEN 'b' || p_size ELSE '' END AS advanced FROM part")
def split_fields(spark, d):
    """Fields without deprecated ones, apart by whether they are advanced [F22]."""
    fields = F.array(_field(F.lit("p"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean")), _field(F.lit("q"), F.lit(True), F.lit(False)), _field(cat("b", size()), F.lit(False), key() % 2 == 1))
    names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ",")
    return t(spark, d, "part").select("p_partkey", FL.split_fields(fields).alias("s")).select("p_partkey", names("s.common").alias("common"), names("s.advanced").alias("advanced"))


@query("SELECT o_orderkey AS key, 'status' AS field, o_orderstatus AS value FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders WHERE o_orderpriority NOT LIKE '1%' AND o_orderkey % 2 = 0")
def values_outside_lists(spark, d):
    """[F31]"""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("priority"))
    return FL.invalid_values(o, "key", {"status": ["F", "O"], "priority": [r[0] for r in o.select("priority").filter("priority like '1%'").distinct().collect()]})


# joins ---------------------------------------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND s_suppkey IS NOT NULL THEN 0 ELSE 1 END AS candidate, CASE WHEN p_partkey % 3 = 0 AND s_suppkey IS NOT NULL THEN s_name ELSE 'fallback' END AS v FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 200
""")
def candidate_or_default(spark, d):
    """The first candidate that a table has, with a fixed key behind it [J18, J23]."""
    look = t(spark, d, "supplier").select(cat("s", F.col("s_suppkey")).alias("key"), F.col("s_name").alias("v"))
    look = look.unionByName(look.select(F.lit("default").alias("key"), F.lit("fallback").alias("v")).distinct())
    return J.first_candidate(_part(spark, d, p_partkey=key(), c=F.when(key() % 3 == 0, cat("s", key() % 200))), look, "p_partkey", [F.col("c"), F.lit("default")], "key", ["v"]).select("p_partkey", "candidate", "v")


@query("SELECT p_partkey, coalesce(s_name, 'none') AS name, coalesce(n_name, '') AS nation FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 300 LEFT JOIN nation ON n_nationkey = s_nationkey")
def inherited_values(spark, d):
    """Values by key, and by the key that came with them, with what stands for missing ones [J19, J20, J28, J31, J33]."""
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("n"))
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("nation"))
    named = J.left_lookup(_part(spark, d, p_partkey=key(), key=key() % 300), s, ["key"], {"name": "none"})
    return J.left_lookup(named, n, ["n"], {"nation": ""}).select("p_partkey", "name", "nation")


@query("SELECT DISTINCT 'k' || (p_partkey % 700) AS key FROM part WHERE p_partkey % 700 NOT IN (SELECT s_suppkey FROM supplier)")
def missing_sections(spark, d):
    """Entries that a file lacks [J39, J40]."""
    a, b = _part(spark, d, key=cat("k", key() % 700)).distinct(), t(spark, d, "supplier").select(cat("k", F.col("s_suppkey")).alias("key"))
    return J.split_sides(a, b, ["key"]).filter("side = 'left'").select("key")


@query("""
WITH d AS (SELECT p_partkey, p_partkey % 5 AS s, p_partkey % 4 = 0 AS released FROM part),
newest AS (SELECT arg_max(p_partkey, (s, p_partkey)) AS k FROM d WHERE released)
SELECT 'c' || n_nationkey AS component, CASE WHEN n_nationkey % 3 = 0 THEN (SELECT 'd' || k FROM newest) ELSE (SELECT 'd' || max(p_partkey) FROM d WHERE s = n_nationkey % 7) END AS dataset FROM nation
""")
def page_datasets(spark, d):
    """Datasets of pages by series; cloud pages take the newest that is out [J41]."""
    pages = t(spark, d, "nation").select(cat("c", F.col("n_nationkey")).alias("component"), cat("26.", F.col("n_nationkey") % 7).alias("version"), (F.col("n_nationkey") % 3 == 0).alias("cloud"))
    return O.dataset_for(pages, _part(spark, d, dataset=cat("d", key()), tag=cat("v26.", key() % 5, ".", key() + 1000), released=key() % 4 == 0)).select("component", "dataset")


@query("SELECT p_partkey AS path, CAST(p_size AS VARCHAR) AS a, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS b, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'old' END AS c, CASE WHEN p_partkey % 3 = 0 THEN '[{\"name\": \"f\", \"v\": 1, \"w\": 2}, {\"name\": \"g\"}]' ELSE '[{\"name\": \"f\", \"v\": 1}]' END AS flags FROM part".replace("\\", ""))
def command_overrides(spark, d):
    """Overrides merged into commands by path, flags by name [J44, REC10]."""
    tree = _part(spark, d, path=key(), body=cat('{"a": ', size(), ', "c": "old", "flags": [{"name": "f", "v": 1}]}'))
    over = t(spark, d, "part").filter("p_partkey % 3 = 0").select(key().alias("path"), cat('{"b": "', name(), '", "c": "new", "flags": [{"name": "f", "w": 2}, {"name": "g"}]}').alias("body"))
    ship(spark)
    out, at = TR.apply_overrides(tree, over), lambda p: F.get_json_object("body", p)
    flags = F.regexp_replace(F.regexp_replace(at("$.flags"), r'":', '": '), ',"', ', "')
    return out.select("path", at("$.a").alias("a"), at("$.b").alias("b"), at("$.c").alias("c"), F.regexp_replace(flags, r"\},\{", "}, {").alias("flags"))


@query("SELECT 'n' || p_partkey AS name, CAST(p_partkey AS DOUBLE) AS position FROM part UNION ALL SELECT 'kept' || s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey + 0.5 ELSE 1e9 END FROM supplier WHERE s_suppkey < (SELECT count(*) FROM part)")
def kept_blocks(spark, d):
    """Protected blocks put back behind their anchors [J45]."""
    n = t(spark, d, "part").count()
    kept = t(spark, d, "supplier").filter(F.col("s_suppkey") < n).select(cat("kept", F.col("s_suppkey")).alias("name"), F.when(F.col("s_suppkey") % 3 > 0, cat("n", F.col("s_suppkey"))).otherwise("gone").alias("anchor"))
    return J.anchored_insert(_part(spark, d, name=cat("n", key()), position=key()), kept)


# groupings -----------------------------------------------------------------------------------------------------------------------


@query("SELECT 's' || l_suppkey AS item, string_agg(DISTINCT 'm' || l_linenumber, ',' ORDER BY 'm' || l_linenumber) AS owners FROM lineitem GROUP BY l_suppkey")
def referenced_by(spark, d):
    """Who refers to an item [AGG3, AGG25]."""
    rows = t(spark, d, "lineitem").select(F.array(cat("s", F.col("l_suppkey"))).alias("items"), cat("m", F.col("l_linenumber")).alias("owner"))
    return A.references(rows, "items", "owner").select("item", F.array_join("owners", ",").alias("owners"))


@query("SELECT count(*) FILTER (l_returnflag = 'R') AS R, count(*) FILTER (l_returnflag = 'A') AS A, count(*) FILTER (l_returnflag = 'x') AS x FROM lineitem")
def verdict_totals(spark, d):
    """[AGG4, AGG27, AGG30]"""
    return A.verdict_counts(t(spark, d, "lineitem"), "l_returnflag", ["R", "A", "x"])


@query("SELECT count(*) FILTER (l_linestatus = 'O') AS O, count(*) FILTER (l_linestatus = 'gone') AS gone FROM lineitem")
def change_counts(spark, d):
    """[AGG11]"""
    return D.summary(t(spark, d, "lineitem"), ["O", "gone"], "l_linestatus")


@query("SELECT p_type AS value, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS names, CAST(CASE p_type WHEN 'SMALL' THEN 0 WHEN 'LARGE' THEN 1 END AS INTEGER) AS ordinal FROM part GROUP BY p_type")
def names_by_value(spark, d):
    """[AGG23]"""
    order = spark.createDataFrame([("SMALL", 0), ("LARGE", 1)], "value string, ordinal int")
    return A.mapping_by_source(_part(spark, d, value=kind(), name=F.col("p_brand")), order).select("value", F.array_join("names", ",").alias("names"), "ordinal")


@query("SELECT lower('The long text of ' || p_type || ' and ' || p_brand) AS text_key, count(*) AS n, min(p_partkey) AS first_owner FROM part GROUP BY p_type, p_brand HAVING n > 1 AND length(text_key) >= 30 AND length(text_key) + 2 > 30")
def repeated_texts(spark, d):
    """[AGG24, AGG19]"""
    text = F.concat(F.lit("The long text of "), F.when(key() % 2 == 0, F.lower(kind())).otherwise(kind()), F.lit(" and "), "p_brand", F.lit("  "))
    return A.duplicate_texts(_part(spark, d, text=text, owner=key()), "text", "owner").filter(F.length("text_key") >= 30)


@query("SELECT 'x' || p_partkey AS name, p_type AS scope, 'ga' AS status FROM part WHERE p_type = 'SMALL' AND p_partkey % 2 = 0")
def features_of_scope(spark, d):
    """[AGG29, T9]"""
    return A.feature_table(_part(spark, d, name=cat("x", key()), scope=kind(), status=F.when(key() % 2 == 0, "ga").otherwise("unreleased")), "SMALL", ["ga"])


@query("SELECT p_partkey, p_partkey % 2 > 0 OR p_partkey % 3 > 0 OR p_size > 48 AS breaking FROM part")
def breaking_changes(spark, d):
    """[AGG31]"""
    return _part(spark, d, p_partkey=key(), breaking=A.breaking(key() % 2, key() % 3, F.greatest(size() - 48, F.lit(0))))


@query("SELECT tag, CAST(row_number() OVER (ORDER BY minor DESC, k) AS INTEGER) AS n FROM (SELECT p_partkey AS k, p_size AS minor, 'v24.' || p_size || '.' || (p_partkey % 7) AS tag FROM part)")
def minor_ranks(spark, d):
    """Tags in order of major and minor; the patch does not count and ties keep their order [T3]."""
    from pyspark.sql import Window

    rows = O.minor_order(_part(spark, d, tag=cat("v24.", size(), ".", key() % 7), ordinal=key()), "tag", "ordinal")
    # monotonic ids follow the order of the sort, so ranks show it
    return rows.withColumn("__i", F.monotonically_increasing_id()).withColumn("n", F.row_number().over(Window.orderBy("__i"))).select("tag", "n")


@query("SELECT p_type, 'v1.' || max(p_partkey) || '.0' || CASE WHEN max(p_partkey) % 3 = 0 THEN '-rc1' ELSE '' END AS newest FROM part WHERE p_partkey % 3 <> 1 GROUP BY p_type")
def newest_images(spark, d):
    """Newest tag of each kind but betas [T4]."""
    suffix = _pick(3, F.lit("-rc1"), F.lit("-beta1"), F.lit(""))
    return O.newest_tag(_part(spark, d, p_type=kind(), tag=F.concat(cat("v1.", key(), ".0"), suffix)), "tag", O.stable_image("tag"), ["p_type"])


_OLD, _NEW = "p_partkey % 7 > 0", "p_partkey % 5 > 0"


@query(f"""
WITH f AS (SELECT *, 't c' || (p_partkey % 50) AS path, 'f' || p_partkey AS flag FROM part)
SELECT path, flag, 'newFlags' AS change, NULL AS old, p_type AS new FROM f WHERE {_NEW} AND NOT ({_OLD})
UNION ALL SELECT path, flag, 'removedFlags', 'old', NULL FROM f WHERE {_OLD} AND NOT ({_NEW})
UNION ALL SELECT path, flag, 'changedFlagTypes', 'old', p_type FROM f WHERE {_OLD} AND {_NEW}
UNION ALL SELECT path, flag, 'changedDefaults', CAST(p_size AS VARCHAR), CAST(p_size + 1 AS VARCHAR) FROM f WHERE {_OLD} AND {_NEW} AND p_partkey % 2 = 0
UNION ALL SELECT path, flag, 'changedFlagRequirements', 'false', 'true' FROM f WHERE {_OLD} AND {_NEW} AND p_partkey % 3 = 0
""")
def flag_changes(spark, d):
    """Flags of commands in two snapshots [DIFF3, DIFF4]."""
    keys = {"path": cat("t c", key() % 50), "flag": cat("f", key())}
    new = t(spark, d, "part").filter(_NEW).select(*(c.alias(n) for n, c in (keys | {"type": kind(), "default_json": cat(size() + F.when(key() % 2 == 0, 1).otherwise(0), F.when(key() % 2 == 0, "").otherwise(".0")), "description": name(), "required": key() % 3 == 0}).items()))
    old = t(spark, d, "part").filter(_OLD).select(*(c.alias(n) for n, c in (keys | {"type": F.lit("old"), "default_json": cat(size()), "description": name(), "required": F.lit(False)}).items()))
    commands = _part(spark, d, path=cat("t c", key() % 50)).distinct()
    return D.compare_flags(old, new, commands, commands)


@query("SELECT p_partkey FROM part WHERE p_size > 10")
def committed_baseline(spark, d):
    """The committed snapshot, made anew only where there is none or it is asked for [DIFF9]."""
    made = lambda: _part(spark, d, p_partkey=key(), p_size=size()).filter("p_size > 10").select("p_partkey")
    return D.baseline(D.baseline(None, made), lambda: made().limit(0)).intersect(D.baseline(made().limit(0), made, regenerate=True))


# sinks and streams ---------------------------------------------------------------------------------------------------------------


@query("SELECT '{\"p_partkey\":' || p_partkey || ',\"p_name\":\"' || p_name || '\"}' AS value FROM part".replace("\\", ""))
def json_lines(spark, d):
    """[SNK2, SNK14]"""
    return sinks.as_json(_part(spark, d, p_partkey=key(), p_name=name()))


@query("SELECT p_partkey, (SELECT max(p_size) FROM part) AS most FROM part")
def attached_value(spark, d):
    """[SNK3]"""
    rows = _part(spark, d, p_partkey=key(), p_size=size())
    return sinks.attach(rows.select("p_partkey"), rows.agg(F.max("p_size").alias("most")))


@query("SELECT p_partkey, '# ' || p_name || chr(10) || chr(10) || 'a ' || p_type || ' b' || p_size AS value FROM part")
def markdown_pages(spark, d):
    """[SNK4]"""
    return sinks.markdown(_part(spark, d, p_partkey=key(), title=name(), body=cat("<p>a <b>", kind(), "</b>\n b", size(), "</p>")), "title", "body").select("p_partkey", "value")


@query(r"SELECT '|' || p_partkey || ' |' || replace(p_name, ' ', '\|') || ' |' || CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END || ' ' AS value FROM part")
def table_lines(spark, d):
    """[SNK9]"""
    return sinks.asciidoc_table(_part(spark, d, k=key(), n=F.replace("p_name", F.lit(" "), F.lit("|")), z=F.when(size() % 2 == 0, size())), ["k", "n", "z"], ["k"])[0]


@query("SELECT 'f' || p_partkey AS path, CAST(512 + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 512 END AS INTEGER) AS size, 'ustar' AS magic, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS content FROM part")
def tar_archive(spark, d):
    """[SNK10]"""
    ship(spark)
    rows = sinks.tar_members(_part(spark, d, path=cat("f", key()), content=F.when(key() % 3 > 0, name().cast("binary"))))
    text = lambda a, n: F.decode(F.substring("member", a, n), "UTF-8")
    return rows.select("path", F.octet_length("member").alias("size"), text(258, 5).alias("magic"), F.regexp_replace(text(513, 512), "\u0000+$", "").alias("content"))


@query("SELECT p_type, p_name AS value FROM part")
def written_texts(spark, d):
    """Texts written in folders by kind and read back [SNK12, SNK4]."""
    path = f"{own_folder(spark)}/texts"
    sinks.write_text(_part(spark, d, p_type=kind(), value=name()), path, ["p_type"])
    return spark.read.schema("value string, p_type string").text(path)


def _stream(spark, df, name):
    """df as a stream of files, and the folder for what becomes of it."""
    folder = own_folder(spark)
    df.write.parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).parquet(f"{folder}/in"), f"{folder}/{name}", f"{folder}/checkpoint"


@query("SELECT event_id, event_type, props FROM events WHERE event_type IN ('click', 'purchase') OR event_type LIKE '%view%'")
def filtered_stream(spark, d):
    """Events as a stream through the record filter [ST2, SNK12, SRC32]."""
    rows = t(spark, d, "events").select("event_id", F.col("event_type").cast("binary").alias("key"), F.col("props").cast("binary").alias("value"))
    source, out, checkpoint = _stream(spark, rows, "out")
    records.run_filter(source, {"PATTERN": "^(click|purchase)$|view"}, lambda b, _: b.write.mode("append").parquet(out), checkpoint).awaitTermination(600)
    return spark.read.schema(rows.schema).parquet(out).select("event_id", F.decode("key", "UTF-8").alias("event_type"), F.decode("value", "UTF-8").alias("props"))


@query("""
SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN user_id % 101 WHEN 1 THEN round(100.0 * (event_id % 7) / 7) END AS INTEGER) AS percent, CASE event_id % 4 WHEN 2 THEN 'fetching' END AS phase FROM events WHERE event_id % 4 < 3
""")
def progress_of_output(spark, d):
    """Chunks of output that tell of progress [ST3]."""
    i = F.col("event_id")
    text = F.when(i % 4 == 0, cat("Progress: ", F.col("user_id") % 101, "%")).when(i % 4 == 1, cat("step ", i % 7, "/7")).when(i % 4 == 2, cat("Cloning ", F.col("event_type"))).otherwise("nothing")
    return records.progress_events(t(spark, d, "events").select("event_id", text.alias("value"))).select("event_id", "percent", "phase")


@query("SELECT DISTINCT user_id, event_type FROM events")
def first_of_stream(spark, d):
    """One event for each key of a stream, within a time to live longer than the stream [ST4]."""
    rows = t(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    source, out, checkpoint = _stream(spark, rows, "out")
    once = records.dedupe_within(source, ["user_id", "event_type"], "at", "1000 days")
    once.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination(600)
    return spark.read.schema(rows.schema).parquet(out).select("user_id", "event_type")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS i FROM events),
r AS (
  SELECT user_id, event_id, i, false AS hit, ms + 86400000 AS expires FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, e.ms <= r.expires, CASE WHEN e.ms <= r.expires THEN r.expires ELSE e.ms + 86400000 END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1
)
SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id, hit FROM r
""")
def cached_requests(spark, d):
    """Requests of a stream that a cache with a day's life could answer [ST4]."""
    rows = t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    source, out, checkpoint = _stream(spark, rows, "out")
    found = state.cache_requests(source, 86_400_000, "36500 days")
    found.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination(1200)
    return spark.read.schema("key string, id long, hit boolean").parquet(out)


@query("""
WITH e AS (SELECT *, event_id % 4 AS c, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS i FROM events WHERE event_id % 4 < 3),
p AS (SELECT *, CASE c WHEN 0 THEN event_id % 101 WHEN 1 THEN CAST(round(100.0 * (event_id % 7) / 7) AS BIGINT) END AS percent FROM e)
SELECT CAST(user_id AS VARCHAR) AS job, CAST(arg_max(percent, i) FILTER (percent IS NOT NULL) AS INTEGER) AS percent, CASE WHEN count(*) FILTER (c = 2) > 0 THEN 'fetching' END AS phase, count(*) AS chunks,
  CASE WHEN coalesce(arg_max(percent, i) FILTER (percent IS NOT NULL), 0) < 100 THEN 'running' ELSE 'completed' END AS status FROM p GROUP BY user_id
""")
def last_progress(spark, d):
    """The last progress of each job of a stream of output [ST3]."""
    i = F.col("event_id")
    text = F.when(i % 4 == 0, cat("Progress: ", i % 101, "%")).when(i % 4 == 1, cat("step ", i % 7, "/7")).when(i % 4 == 2, cat("Cloning ", F.col("event_type"))).otherwise("nothing")
    rows = t(spark, d, "events").select(F.col("user_id").alias("job"), i.alias("id"), F.col("ts").cast("timestamp").alias("at"), text.alias("value"))
    source, out, checkpoint = _stream(spark, rows, "out")

    def write(batch, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)

    found = state.job_progress(source, 1 << 50, "36500 days")
    found.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(1200)
    every = spark.read.schema("job string, percent int, phase string, chunks long, status string, batch int").parquet(out)
    return every.groupBy("job").agg(F.max_by(F.struct("percent", "phase", "chunks", "status"), "batch").alias("r")).select("job", "r.*")
