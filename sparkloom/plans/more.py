"""More queries of the catalogue: predicates, the smaller joins and groupings, and the other grains of the snapshot diff."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import diffs as D
from ..operators import filters as FL
from ..operators import joins as J
from ..operators import ordered as O
from ..operators import sets as SETS
from ..operators import trees as TR
from ..sources import readers as R
from ..sources import sinks
from .catalogue import _COUNTED, _RELATED, _SETS, by_sets_and_ids, query, t


def s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def cat(*parts: Column | str) -> Column:
    """Parts joined: Columns as text, strings as they are."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else s(p) for p in parts))


def key() -> Column:
    return F.col("p_partkey")


_TAG = "'v' || (p_partkey % 30) || '.' || (p_size % 12) || '.' || (p_partkey % 7) || CASE WHEN p_partkey % 4 = 0 THEN '-rc' || (p_partkey % 15) ELSE '' END"


def tag() -> Column:
    return cat("v", key() % 30, ".", F.col("p_size") % 12, ".", key() % 7, F.when(key() % 4 == 0, cat("-rc", key() % 15)).otherwise(""))


# predicates --------------------------------------------------------------------------------------------------------------------


@query(f"""
SELECT p_partkey, tag FROM (SELECT p_partkey, {_TAG} AS tag, (p_partkey % 30) * 1000 + p_size % 12 AS k, p_partkey % 9 = 0 AS draft FROM part) WHERE NOT draft AND tag NOT LIKE '%-%' AND k * 1000 + p_partkey % 7 BETWEEN 5002001 AND 20003004
""")
def stable_range(spark, d):
    """Stable releases in a closed range [F7, F8]."""
    p = t(spark, d, "part").select("p_partkey", tag().alias("tag"), (key() % 9 == 0).alias("draft"))
    at = lambda v: S.version_key(F.lit(v))
    return p.filter(S.is_stable("tag", "draft") & FL.in_range(S.version_key("tag"), at("5.2.1"), at("20.3.4"))).select("p_partkey", "tag")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'Kubernetes' WHEN p_partkey % 6 = 1 THEN 'Linux' WHEN p_partkey % 6 = 2 THEN 'Docker' WHEN p_partkey % 6 = 3 THEN 'Cloud' ELSE '' END AS docs,
  CASE WHEN p_partkey % 6 = 0 THEN 'Kubernetes' WHEN p_partkey % 6 = 1 THEN 'Linux' WHEN p_partkey % 6 = 2 THEN 'Docker' WHEN p_partkey % 6 = 4 THEN 'Cloud' ELSE '' END AS search FROM part
""")
def deployment_types(spark, d):
    """[SC-S39, N8, N25]"""
    names = F.array(*map(F.lit, ["env-kubernetes", "env-linux", "env-docker", "cloud", "page-cloud", "other"]))
    a = F.create_map(F.element_at(names, (key() % 6 + 1).cast("int")), F.lit("y"))
    return t(spark, d, "part").select("p_partkey", a.alias("a")).select("p_partkey", T.deployment_type("a", "docs").alias("docs"), T.deployment_type("a", "search").alias("search"))


@query("""
SELECT p_partkey FROM part WHERE contains(lower(p_name), 'a') AND string_split(p_type, ' ')[1] IN ('STANDARD', 'SMALL', 'ECONOMY') AND p_size % 2 = 0
""")
def component_filter(spark, d):
    """[F12]"""
    p = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.split("p_type", " ").alias("types"), F.array().cast("array<string>").alias("supports"), (F.col("p_size") % 2 == 0).alias("cloud"), F.lit(False).alias("enterprise"))
    return p.withColumn("types", F.slice("types", 1, 1)).filter(FL.component_filter("A", ["STANDARD", "SMALL", "ECONOMY"], cloud=True)).select("p_partkey")


@query("""
SELECT p_partkey, p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AS selected, (p_partkey % 2 = 0 OR p_partkey % 3 = 0) AND p_partkey % 5 <> 0 AS built FROM part
""")
def tag_expressions(spark, d):
    """[F27, F28]"""
    tags = F.array_compact(F.array(*(F.when(key() % n == 0, F.lit(x)) for n, x in ((2, "two"), (3, "three"), (5, "five")))))
    return t(spark, d, "part").select("p_partkey", tags.alias("tags")).select("p_partkey", FL.tag_selected("tags", "two;!three").alias("selected"), FL.build_constraint("tags", "(two || three) && !five").alias("built"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'ga' WHEN 1 THEN 'unreleased' WHEN 2 THEN 'unreleased' WHEN 3 THEN 'beta' ELSE 'ga' END AS status FROM part
""")
def feature_status(spark, d):
    """[F33, N31]"""
    status = F.when(key() % 5 == 0, "ga").when(key() % 5 == 1, "bogus").when(key() % 5 == 2, "")
    return t(spark, d, "part").select("p_partkey", FL.feature_status(status, F.when(key() % 5 == 3, "true")).alias("status"))


@query(r"""
SELECT p_partkey, regexp_matches(n, '^[a-z][a-z0-9]*([._-][a-z0-9]+)*$') AND length(n) BETWEEN 3 AND 100 AS valid, regexp_matches(n, 'cloud_storage|s3_|azure_|gcs_|archival_|remote_|tiered_') AS stored
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 's3_x' WHEN 1 THEN '_a' WHEN 2 THEN 'log.' || p_partkey ELSE 'Upper' END AS n FROM part)
""")
def name_predicates(spark, d):
    """[F18, F19]"""
    n = F.when(key() % 4 == 0, "s3_x").when(key() % 4 == 1, "_a").when(key() % 4 == 2, cat("log.", key())).otherwise("Upper")
    return t(spark, d, "part").select("p_partkey", FL.valid_property_name(n).alias("valid"), FL.object_storage(n).alias("stored"))


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem JOIN (SELECT l_orderkey, max(l_linenumber) AS m FROM lineitem GROUP BY 1) USING (l_orderkey) WHERE l_linenumber = m
""")
def latest_only(spark, d):
    """[F2]"""
    li = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("component"), F.col("l_linenumber").alias("version"))
    return FL.latest_only(li, li.groupBy("component").agg(F.max("version").alias("version"))).select(F.col("component").alias("l_orderkey"), F.col("version").alias("l_linenumber"))


# joins -------------------------------------------------------------------------------------------------------------------------


@query(f"""
WITH c AS (SELECT o_custkey AS id, o_orderpriority AS c, CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Docker' WHEN 2 THEN 'Cloud' ELSE 'Linux' END AS dep FROM orders), {_COUNTED}, {_SETS.format(row="{'c': c, 'dep': dep}")}
UNION ALL SELECT 'pair', a.of, b.of FROM r a JOIN r b ON list_has_all(list_transform(b.s, lambda x: x.c), list_transform(a.s, lambda x: x.c)) AND (b.s[1].dep = '' OR (a.s[1].dep = 'Cloud' AND b.s[1].dep = 'Cloud') OR (a.s[1].dep <> 'Cloud' AND b.s[1].dep IN ('Docker', 'Kubernetes')))
UNION ALL {_RELATED.format(fits="WHERE b.dep = '' OR (a.dep = 'Cloud' AND b.dep = 'Cloud') OR (a.dep <> 'Cloud' AND b.dep IN ('Docker', 'Kubernetes'))")}
""")
def related_labs(spark, d):
    """All customers by all their orders and their deployment: all pairs of customers that fit, and members and pairs of sets [J6]."""
    c = t(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("c"))
    c = c.withColumn("deployment", F.when(F.col("id") % 4 == 0, "").when(F.col("id") % 4 == 1, "Docker").when(F.col("id") % 4 == 2, "Cloud").otherwise("Linux"))
    members, _, pairs = J.division_sets(c, c, "id", "id", "c", J.labs_compatible(), ("deployment",))
    return by_sets_and_ids(members, pairs)


@query("""
SELECT p_partkey, p_partkey % 4 = 0 AS flag FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, true FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 3 = 0
""")
def augment(spark, d):
    """[J9, J38]"""
    p = t(spark, d, "part").select("p_partkey")
    return J.augment(p.filter("p_partkey % 3 <> 0"), p.filter("p_partkey % 4 = 0"), ["p_partkey"], "flag")


@query("""
WITH r AS (SELECT c_custkey, unnest([c_name, n_name, r_name]) AS k, unnest([0, 1, 2]) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT n_name AS k, 1 AS rank, 'ro' AS v FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT r_name, 0, 'rw' FROM region WHERE r_regionkey % 2 = 0)
SELECT c_custkey, max(v) AS v FROM (SELECT c_custkey, arg_min(v, rank * 10 + n) AS v FROM r JOIN f USING (k) GROUP BY 1 UNION ALL SELECT c_custkey, NULL FROM customer) GROUP BY 1
""")
def by_name_or_alias(spark, d):
    """[J10]"""
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    found = n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.lit(1).alias("rank"), F.lit("ro").alias("v")).unionByName(r.filter("r_regionkey % 2 = 0").select(F.col("r_name").alias("name"), F.lit(0).alias("rank"), F.lit("rw").alias("v")))
    c = t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return J.by_name_or_alias(c.select("c_custkey", "c_name", F.array("n_name", "r_name").alias("aliases")), found, "c_name", "aliases", "name", "rank").select("c_custkey", "v")


@query("""
SELECT page, string_agg(c, ',' ORDER BY c) AS categories FROM (SELECT DISTINCT o_custkey AS page, unnest([n_name, r_name]) AS c FROM orders JOIN nation ON o_orderkey % 30 = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY page
""")
def validate_categories(spark, d):
    """Categories of orders: unknown ones go, parents come in [J32]."""
    pages = t(spark, d, "orders").select(F.col("o_custkey").alias("page"), (F.col("o_orderkey") % 30).alias("k")).join(t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("category")), "k", "left").select("page", F.coalesce("category", F.lit("unknown")).alias("category"))
    tax = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("category"), F.col("r_name").alias("parent"))
    return J.validate_categories(pages, tax).select("page", F.array_join("categories", ",").alias("categories"))


@query("""
WITH n AS (SELECT r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name || '/' || n_name || '/' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT path FROM n WHERE NOT EXISTS (SELECT 1 FROM n m WHERE length(m.path) % 7 = 0 AND (n.path = m.path OR n.path LIKE m.path || '/%'))
""")
def unpublish_tree(spark, d):
    """[J30]"""
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    paths = t(spark, d, "region").select(F.col("r_name").alias("path")).unionByName(n.select(F.concat_ws("/", "r_name", "n_name").alias("path"))).unionByName(t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", "r_name", "n_name", "c_name").alias("path")))
    nav = paths.withColumn("url", F.col("path"))
    return J.unpublish_tree(nav, nav.filter(F.length("path") % 7 == 0)).select("path")


@query("""
SELECT p_partkey, gap FROM (SELECT p_partkey, length(repeat(p_name, 1 + p_size % 5)) - length(p_name) AS gap FROM part) WHERE gap > 40
""")
def description_gaps(spark, d):
    """[J35]"""
    p = t(spark, d, "part")
    tree = p.select(key().alias("path"), F.col("p_name").alias("description"))
    over = p.select(key().alias("path"), F.repeat("p_name", (1 + F.col("p_size") % 5).cast("int")).alias("override"))
    return J.description_gaps(tree, over, 40).select(F.col("path").alias("p_partkey"), F.col("gap").cast("long").alias("gap"))


@query("""
SELECT p_partkey AS file, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 9 <> 0 THEN 'keep' WHEN p_partkey % 3 = 0 AND p_partkey % 2 <> 0 THEN 'delete' WHEN p_partkey % 3 = 0 THEN 'upgrade' WHEN p_partkey % 5 = 0 THEN 'skip' ELSE 'create' END AS action FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 0
""")
def stub_plan(spark, d):
    """[J43]"""
    p = t(spark, d, "part").select(key().alias("file"))
    return J.stub_plan(p.filter("file % 3 = 0").withColumn("managed", F.col("file") % 9 == 0), p.filter("file % 2 = 0"), p.filter("file % 5 = 0"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'old' WHEN p_partkey % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'plugin-2' ELSE '26.1' END END AS introduced FROM part
""")
def stamp_versions(spark, d):
    """[J46, DIFF8]"""
    p = t(spark, d, "part").withColumns({"introduced": F.when(key() % 7 == 0, "old"), "plugin": F.when(F.col("p_size") % 2 == 0, "two").otherwise("none")})
    return J.stamp_versions(p, p.filter("p_partkey % 3 <> 0"), ["p_partkey"], "26.1", spark.createDataFrame([("two", "plugin-2")], "plugin string, version string")).select("p_partkey", "introduced")


# groupings ---------------------------------------------------------------------------------------------------------------------


@query("""
SELECT p_brand AS connector, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types, bool_or(p_size > 45) AS cloud, arg_min(p_name, p_partkey) AS license FROM part GROUP BY p_brand
""")
def connector_rollup(spark, d):
    """[AGG5, AGG9]"""
    p = t(spark, d, "part").select(F.col("p_brand").alias("connector"), F.col("p_type").alias("type"), F.col("p_name").alias("commercial_name"), (F.col("p_size") > 45).alias("cloud"), F.col("p_name").alias("license"), key().alias("ordinal"))
    return A.connector_rollup(p).select("connector", F.array_join("types", ",").alias("types"), "cloud", "license")


@query("""
SELECT p_brand, p_size % 3 AS level, string_agg(DISTINCT p_name, ', ' ORDER BY p_name) AS names FROM part GROUP BY ALL
""")
def names_by_support(spark, d):
    """[AGG6, AGG7]"""
    return A.by_support(t(spark, d, "part").withColumn("level", F.col("p_size") % 3), "p_brand", "level", "p_name")


@query("""
WITH r AS (SELECT DISTINCT ['GCP', 'AWS', 'Azure', 'Other'][1 + s_nationkey % 4] AS provider, 'r' || s_nationkey AS region, CASE WHEN s_suppkey % 3 < 2 THEN 'p' || (s_suppkey % 3) END AS product, 't' || (s_suppkey % 5) AS ct FROM supplier),
k AS (SELECT provider, region, product, string_agg(ct, ', ' ORDER BY ct) AS types FROM r WHERE provider <> 'Other' AND product IS NOT NULL GROUP BY ALL)
SELECT provider, region, string_agg(product || ': ' || types, ';' ORDER BY product || ': ' || types) AS tiers FROM k GROUP BY ALL
""")
def cloud_regions(spark, d):
    """[AGG10, F25, J25, N14]"""
    k = F.col("s_suppkey")
    r = t(spark, d, "supplier").select(F.element_at(F.array(*map(F.lit, ["GCP", "AWS", "Azure", "Other"])), (F.col("s_nationkey") % 4 + 1).cast("int")).alias("provider"), cat("r", F.col("s_nationkey")).alias("region"), F.lit("z").alias("zones"), F.when(k % 3 < 2, cat("p", k % 3)).alias("product"), cat("t", k % 5).alias("cluster_type"))
    return A.regions(r).select("provider", "region", F.array_join("tiers", ";").alias("tiers"))


@query("""
WITH o AS (SELECT event_type AS k, count(*) AS calls FROM events GROUP BY 1) SELECT k, calls, 1 AS keys FROM o UNION ALL SELECT NULL, sum(calls)::BIGINT, count(*) FROM o
""")
def usage_totals(spark, d):
    """[AGG14]"""
    return A.usage(t(spark, d, "events").select(F.col("event_type").alias("k")), "k")


@query("""
SELECT l_returnflag AS field, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS components, arg_min(l_shipdate, l_orderkey * 10 + l_linenumber) AS description FROM lineitem GROUP BY 1
""")
def fields_by_name(spark, d):
    """[AGG16]"""
    li = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("field"), F.col("l_linestatus").alias("component"), F.col("l_shipdate").alias("description"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return A.fields_by_name(li).select("field", F.array_join("components", ",").alias("components"), "description")


@query("""
SELECT count(*) AS "releaseCount", arg_min('v' || o_orderkey, o_orderkey) AS "startVersion", arg_max('w' || o_orderkey, o_orderkey) AS "endVersion", sum(o_custkey % 2)::BIGINT AS "newComponents", sum(o_custkey % 3)::BIGINT AS "newFields", sum(o_custkey % 5)::BIGINT AS "removedComponents", sum(o_custkey % 7)::BIGINT AS "removedFields", sum(o_custkey % 11)::BIGINT AS "deprecatedComponents", sum(o_custkey % 13)::BIGINT AS "deprecatedFields", sum(CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey % 17 END)::BIGINT AS "changedDefaults" FROM orders
""")
def release_summary(spark, d):
    """[AGG13, N26]"""
    c = F.col("o_custkey")
    o = t(spark, d, "orders").select(cat("v", F.col("o_orderkey")).alias("fromVersion"), cat("w", F.col("o_orderkey")).alias("toVersion"), F.col("o_orderkey").alias("ordinal"), *((c % n).alias(k) for k, n in zip(A.SUMMED, (2, 3, 5, 7, 11, 13), strict=False)), F.when(c % 4 != 0, c % 17).alias("changedDefaults"))
    return A.master_summary(o)


@query("""
SELECT '- ' || o_orderstatus || ': ' || n || ' (' || array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN ', ...' ELSE '' END || ')' AS line FROM (SELECT o_orderstatus, count(*) AS n, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS names FROM orders GROUP BY 1)
""")
def summary_lines(spark, d):
    """[AGG28]"""
    return A.summary_text(t(spark, d, "orders"), "o_orderstatus", "o_orderpriority", 3).select("line")


@query("""
SELECT n_regionkey AS grp, string_agg('# Page ' || i || ': ' || n_name || chr(10) || chr(10) || 'about ' || n_name, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n_name) AS value FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation) GROUP BY 1
""")
def corpus_export(spark, d):
    """[SNK5, W10]"""
    n = t(spark, d, "nation").select(F.col("n_regionkey").alias("grp"), F.col("n_name").alias("u"), cat("about ", F.col("n_name")).alias("t"))
    return sinks.corpus_text(n, "grp", "u", "t")


@query("""
SELECT '<url><loc>' || replace(url, '&', '&amp;') || '</loc>' || CASE WHEN page_id % 2 = 0 THEN '<lastmod>2024-01-01</lastmod>' ELSE '' END || '</url>' AS value FROM pages
""")
def sitemap_lines(spark, d):
    """[SNK6]"""
    return sinks.sitemap_xml(t(spark, d, "pages").withColumn("m", F.when(F.col("page_id") % 2 == 0, "2024-01-01")), "url", "m")


# diffs, order, sets, trees -----------------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT p_partkey AS k, p_partkey % 3 = 0 AS oc, p_partkey % 4 = 0 AS nc, p_partkey % 5 = 0 AS os, p_partkey % 10 = 0 AS ns, p_partkey % 6 = 0 AS dep, p_partkey % 12 = 0 AS odep, p_partkey % 7 <> 0 AS ho, p_partkey % 11 <> 0 AS hn FROM part)
SELECT k, 'newComponents' AS change FROM p WHERE NOT ho AND hn UNION ALL SELECT k, 'removedComponents' FROM p WHERE ho AND NOT hn UNION ALL SELECT k, 'deprecatedComponents' FROM p WHERE ho AND hn AND dep AND NOT odep
UNION ALL SELECT k, 'became_cgo_only' FROM p WHERE ho AND hn AND nc AND NOT oc UNION ALL SELECT k, 'no_longer_cgo_only' FROM p WHERE ho AND hn AND oc AND NOT nc UNION ALL SELECT k, 'removed_cloud_support' FROM p WHERE ho AND hn AND os AND NOT ns
""")
def snapshot_diff_components(spark, d):
    """[DIFF2]"""
    p = t(spark, d, "part").select(F.lit("in").alias("type"), key().alias("name"))
    n = F.col("name")
    side = lambda dep, cgo, cloud: p.select("type", "name", F.when(n % dep == 0, "Deprecated").otherwise("stable").alias("status"), (n % cgo == 0).alias("requires_cgo"), (n % cloud == 0).alias("cloud_supported"), F.lit(None).cast("boolean").alias("cloud_only"))
    return D.compare_components(side(12, 3, 5).filter("name % 7 <> 0"), side(6, 4, 10).filter("name % 11 <> 0")).select(n.alias("k"), "change")


@query("""
WITH p AS (SELECT p_partkey AS k, 'tool g' || (p_partkey % 9) || ' c' || p_partkey AS path, 'tool g' || (p_partkey % 9) AS root, p_partkey % 9 = 4 AS under FROM part)
SELECT path, 'newCommands' AS change FROM p WHERE k % 5 = 0 AND k % 7 <> 0 UNION ALL SELECT path, 'removedCommands' FROM p WHERE k % 7 = 0 AND k % 5 <> 0 AND NOT under UNION ALL SELECT path, 'descriptionChanges' FROM p WHERE k % 5 <> 0 AND k % 7 <> 0 AND k % 13 = 0 UNION ALL SELECT 'tool g4', 'deprecatedCommands'
""")
def snapshot_diff_commands(spark, d):
    """[DIFF3, J27]"""
    p = t(spark, d, "part").select(key().alias("k"), cat("tool g", key() % 9, " c", key()).alias("path"))
    old = p.filter("k % 5 <> 0").select("path", F.lit("a").alias("description"))
    new = p.filter("k % 7 <> 0").select("path", F.when(F.col("k") % 13 == 0, "b").otherwise("a").alias("description"))
    return D.compare_commands(old, new, spark.createDataFrame([("tool g4",)], "path string")).select("path", "change")


@query("""
SELECT doc_id AS path, CASE WHEN doc_id % 6 = 0 THEN 'added' WHEN doc_id % 5 = 0 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE (doc_id % 6 = 0) <> (doc_id % 5 = 0) OR (doc_id % 6 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 = 0)
""")
def snapshot_diff_files(spark, d):
    """[DIFF7]"""
    x = t(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return D.compare_files(x.filter("path % 6 <> 0"), x.filter("path % 5 <> 0").withColumn("content", F.when(F.col("path") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))))


@query("""
SELECT k, 'newFunctions' AS change FROM (SELECT p_partkey AS k FROM part) WHERE k % 4 = 0 AND k % 6 <> 0 UNION ALL SELECT p_partkey, 'removedFunctions' FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 6 = 0 UNION ALL SELECT p_partkey, 'deprecatedFunctions' FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 6 <> 0 AND p_partkey % 5 = 0
""")
def snapshot_diff_names(spark, d):
    """[DIFF2, SET1]"""
    p = t(spark, d, "part").select(key().alias("k"))
    return D.compare_names(p.filter("k % 4 <> 0").withColumn("status", F.lit("stable")), p.filter("k % 6 <> 0").withColumn("status", F.when(F.col("k") % 5 == 0, "deprecated").otherwise("stable")), "k", "Functions").select("k", "change")


@query(f"""
SELECT p_brand, string_agg(tag, ',' ORDER BY maj DESC, min DESC, p_partkey) AS tags FROM (SELECT p_brand, p_partkey, p_partkey % 30 AS maj, p_size % 12 AS min, {_TAG} AS tag FROM part) GROUP BY p_brand
""")
def minor_order(spark, d):
    """All parts by brand, in the order of minor versions [N16]."""
    return _minor_order(t(spark, d, "part"))


def _minor_order(parts):
    p = parts.select("p_brand", "p_partkey", tag().alias("tag"))
    part = lambda i: F.regexp_extract("tag", r"^v?(\d+)\.(\d+)", i).cast("int")
    return p.groupBy("p_brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-part(1)).alias("a"), (-part(2)).alias("b"), "p_partkey", "tag"))), lambda x: x["tag"]), ",").alias("tags"))


@query("""
SELECT p_brand, coalesce(max(CASE WHEN p_partkey = b THEN n END) - max(CASE WHEN p_partkey = a THEN n END) = 1, false) AS attributable FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, min(p_partkey) OVER (PARTITION BY p_brand) AS a, nth_value(p_partkey, 2) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) + p_size * 0 AS b FROM part) GROUP BY p_brand
""")
def immediate_successor(spark, d):
    """[W6]"""
    p = t(spark, d, "part").select("p_brand", "p_partkey")
    first = O.first_n(p, ["p_brand"], ["p_partkey"], 2).groupBy("p_brand").agg(F.min("p_partkey").alias("a"), F.max("p_partkey").alias("b"))
    return O.immediate_successor(p.join(first, "p_brand"), "p_partkey", "p_partkey", F.col("a"), F.col("b"), ["p_brand"])


@query("""
SELECT doc_id, count(*) AS n FROM (SELECT doc_id, trim(x) AS x, lag(trim(x)) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) WHERE NOT (x = '' AND coalesce(p, 'x') = '') GROUP BY doc_id
""")
def fold_blank_lines(spark, d):
    """[W9]"""
    rows = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "x"))
    return O.fold_blank_lines(rows, ["doc_id"], "i", "x").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT o_orderstatus AS a, o_orderpriority AS b FROM orders")
def distinct_rows(spark, d):
    """[SET5]"""
    return SETS.distinct_rows(t(spark, d, "orders").select(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b")))


@query("""
SELECT p_partkey // 20 AS g, 'n' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS v FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey // 20, 'n' || p_partkey, 2 FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 = 0
""")
def merge_by_name(spark, d):
    """Lists of named items of each group of 20 parts, the second over the first [SET4]."""
    pick = lambda c, v: F.collect_list(F.when(c, F.struct(cat("n", key()).alias("name"), F.lit(v).alias("v"))))
    rows = t(spark, d, "part").groupBy(F.floor(key() / 20).alias("g")).agg(pick(key() % 3 != 0, 1).alias("x"), pick(key() % 2 == 0, 2).alias("y"))
    return rows.select("g", F.inline(SETS.merge_by_name("x", "y")))


@query("""
WITH p AS (SELECT n_name || ' ' || c_name AS path, 'old' AS v FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT * FROM p WHERE path NOT LIKE 'NATION_3 %' UNION ALL SELECT 'NATION_3 ' || s_name, 'new' FROM supplier WHERE s_nationkey = 3
""")
def splice_subtree(spark, d):
    """[REC7, REC11]"""
    n = t(spark, d, "nation")
    tree = t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws(" ", "n_name", "c_name").alias("path"), F.lit("old").alias("v"))
    return TR.splice(tree, t(spark, d, "supplier").filter("s_nationkey = 3").select(cat("NATION_3 ", F.col("s_name")).alias("path"), F.lit("new").alias("v")), "NATION_3")


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size * 3600000 WHEN 1 THEN p_size * 60000 ELSE NULL END::BIGINT AS ms, CASE WHEN p_partkey % 2 = 0 THEN trunc(-(p_partkey / 7))::BIGINT ELSE p_partkey * p_size END AS value, greatest(0, least(100, round(p_size / 40 * 100)))::INT AS progress FROM part
""")
def numbers(spark, d):
    """[SC-D3, SC-M1, SC-M5]"""
    lit = F.when(key() % 3 == 0, cat(F.col("p_size"), "h")).when(key() % 3 == 1, cat(F.col("p_size"), "min")).otherwise("soon")
    return t(spark, d, "part").select("p_partkey", S.chrono_ms(lit).alias("ms"), S.arithmetic(F.when(key() % 2 == 0, cat("-", key(), " / 7")).otherwise(cat(key(), " * ", F.col("p_size")))).alias("value"), S.progress("p_size", F.lit(40)).alias("progress"))


@query(r"""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST('12.50' AS DECIMAL(18,2)) WHEN c_custkey % 3 = 1 THEN CAST(c_custkey AS DECIMAL(18,2)) END AS amount, regexp_replace(trim(c_name), '$', CASE WHEN regexp_matches(trim(c_name), '[.!?]$') THEN '' ELSE '.' END) AS sentence FROM customer
""")
def prices_and_periods(spark, d):
    """[D15, SC-S9]"""
    k = F.col("c_custkey")
    return t(spark, d, "customer").select("c_custkey", R.price(F.when(k % 3 == 0, "USD 12.50").when(k % 3 == 1, cat("EUR ", k)).otherwise("free"))["amount"].alias("amount"), T.ensure_period("c_name").alias("sentence"))
