"""Queries of the operators that fold, iterate or follow: expressions, constants, config trees, chains of releases, JSON documents, build constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import builds, constants, documents, ownership, releases
from ..sources import types
from .catalogue import query, t
from .more import cat, key

_DURATION = """CASE l_linenumber % 5
  WHEN 0 THEN q * 3600000.0 * l_linenumber
  WHEN 1 THEN l_linenumber * (q * 60000.0) + p * 1000.0
  WHEN 2 THEN (q + p) * (l_linenumber * 1000.0)
  WHEN 3 THEN (q + 0.5) * 3600000.0 - l_linenumber * 86400000.0 / p
  ELSE -q * -CAST(l_linenumber AS DOUBLE) END"""
_KINDS = ["std::chrono::milliseconds", "std::optional<std::chrono::seconds>", "std::chrono::minutes", "std::chrono::hours", "int64_t"]


@query(f"""
WITH l AS (SELECT *, CAST(l_quantity AS DOUBLE) AS q, CAST(l_partkey % 7 + 1 AS DOUBLE) AS p FROM lineitem),
v AS (SELECT l_orderkey, l_linenumber, l_partkey, {_DURATION} AS ms FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(trunc(ms / CASE l_partkey % 5 WHEN 1 THEN 1000.0 WHEN 2 THEN 60000.0 WHEN 3 THEN 3600000.0 ELSE 1.0 END) AS BIGINT) AS value FROM v
""")
def duration_defaults(spark, d):
    """Expressions of durations in the unit of their types [SC-D3, SC-M1]."""
    q, n, p = F.col("l_quantity").cast("int"), F.col("l_linenumber"), F.col("l_partkey") % 7 + 1
    text = (
        F.when(n % 5 == 0, cat(q, "h * ", n)).when(n % 5 == 1, cat(n, " * ", q, "min + ", p, "s")).when(n % 5 == 2, cat("(", q, " + ", p, ") * ", n, "s"))
        .when(n % 5 == 3, cat(q, ".5h - ", n, "d / ", p)).otherwise(cat("-", q, "ms * -", n))
    )
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("l_partkey") % 5 + 1).cast("int"))
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.alias("default"), kind.alias("c_type"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", X.duration("default", "c_type").alias("value"))


_CONSTANTS = """
RECURSIVE k AS (
  SELECT p_partkey, CAST(p_size * 1000 AS DOUBLE) AS value FROM part WHERE p_partkey < 4
  UNION ALL SELECT p.p_partkey, k.value * (p.p_partkey % 3 + 1) - p.p_size FROM part p JOIN k ON k.p_partkey = p.p_partkey // 4 WHERE p.p_partkey >= 4 AND p.p_partkey % 50 NOT IN (7, 9)
)"""


def _constants(spark, d):
    k = F.col("p_partkey")
    up = cat("k", F.floor(k / 4))
    text = F.when(k < 4, cat(F.col("p_size"), "s")).when(k % 50 == 7, cat(up, " + missing::name")).when(k % 50 == 9, cat("k", k, " + 1")).otherwise(cat(up, " * ", k % 3 + 1, " - ", F.col("p_size"), "ms"))
    return t(spark, d, "part").select(cat("k", k).alias("name"), text.alias("expression"))


@query(f"WITH {_CONSTANTS} SELECT 'k' || part.p_partkey AS name, k.value FROM part LEFT JOIN k ON k.p_partkey = part.p_partkey")
def constant_chain(spark, d):
    """Constants that use one another, with unknown names and cycles [SC-D3, SC-M1, SRC18]."""
    return constants.resolve_constants(_constants(spark, d))


@query(f"""
WITH {_CONSTANTS}
SELECT o_orderkey, CAST(trunc((2 * k.value + 3600000) / CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 1000.0 END) AS BIGINT) AS value FROM orders LEFT JOIN k ON k.p_partkey = o_custkey
""")
def constant_defaults(spark, d):
    """Defaults that use constants, in the unit of their types [SC-D3, SRC18]."""
    kind = F.when(F.col("o_orderkey") % 2 == 0, "std::chrono::milliseconds").otherwise("std::chrono::seconds")
    rows = t(spark, d, "orders").select("o_orderkey", cat("2 * k", F.col("o_custkey"), " + 1h").alias("default"), kind.alias("c_type"))
    return constants.evaluate_defaults(rows, constants.resolve_constants(_constants(spark, d)), "o_orderkey").select("o_orderkey", "value")


# config trees ----------------------------------------------------------------------------------------------------------------------

#: Each order is a config whose tree has one to seven nodes; node k hangs below node k div 2.
_NODES = "SELECT o_orderkey AS config, unnest(range(1, o_orderkey % 7 + 2)) AS k, o_custkey FROM orders"


def _nodes(spark, d, name):
    k = F.col("k")
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("config"), F.explode(F.sequence(F.lit(1), (F.col("o_orderkey") % 7 + 1).cast("int"))).alias("k"), "o_custkey")
    return ownership.placed(rows.select("config", k.alias("id"), F.when(k > 1, F.floor(k / 2).cast("int")).alias("parent"), k.alias("position"), name.alias("name")))


@query(f"""
WITH RECURSIVE n AS (SELECT config, k, 's' || ((o_custkey * 7 + k * k * 31) % 1000) AS component, CASE k WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 3 WHEN 3 THEN 4 WHEN 6 THEN 5 ELSE 6 END AS walk, CAST(floor(log2(k)) AS INTEGER) AS depth FROM ({_NODES})),
f AS (SELECT config, component, arg_min(depth, walk) AS depth FROM n GROUP BY ALL),
c AS (SELECT o_orderkey AS config, 's' || (o_orderkey * 17 % 1000) AS owner FROM orders),
v AS (
  SELECT f.component, c.config, owner, depth, false AS own FROM f JOIN c USING (config) WHERE f.component <> owner
  UNION ALL SELECT owner, c.config, owner, coalesce(depth, -1), true FROM c LEFT JOIN f ON f.config = c.config AND f.component = owner
), e AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY config) AS i FROM v),
r AS (
  SELECT component, i, config, owner, depth, own FROM e WHERE i = 1
  UNION ALL
  SELECT e.component, e.i, if(x, e.config, r.config), if(x, e.owner, r.owner), if(x, e.depth, r.depth), if(x, e.own, r.own)
  FROM (SELECT e.*, r.config AS rc, r.owner AS ro, r.depth AS rd, r.own AS rw, CASE WHEN e.own THEN NOT r.own OR e.depth >= r.depth ELSE e.depth > r.depth END AS x FROM r JOIN e ON e.component = r.component AND e.i = r.i + 1) e, LATERAL (SELECT e.rc AS config, e.ro AS owner, e.rd AS depth, e.rw AS own) r
)
SELECT component, CAST(arg_max(config, i) AS VARCHAR) AS config, arg_max(owner, i) AS owner, arg_max(depth, i) AS depth FROM r GROUP BY component
""")
def config_owners(spark, d):
    """Whose config a component's pages use, out of configs in order [J42]."""
    places = _nodes(spark, d, cat("s", (F.col("o_custkey") * 7 + F.col("k") * F.col("k") * 31) % 1000))
    configs = t(spark, d, "orders").select(F.col("o_orderkey").alias("config"), F.col("o_orderkey").alias("ordinal"), cat("s", F.col("o_orderkey") * 17 % 1000).alias("owner"))
    return ownership.config_owners(configs, places)


@query(f"""
WITH c AS (SELECT config, k, config % 7 + 1 AS n FROM ({_NODES})),
r AS (
  SELECT config, k, 0 AS position, k AS entry, n > 1 AS items_only FROM c WHERE k = 1 OR 2 * k <= n
  UNION ALL SELECT config, 1, x, x + 1, false FROM c, (SELECT unnest([1, 2]) AS x) WHERE k = 1 AND x < n
  UNION ALL SELECT config, k, x, if(x = 0, k // 2, k // 2 * 2 + x - 1), x = 0 FROM c, (SELECT unnest([0, 1, 2]) AS x) WHERE k > 1 AND 2 * k > n AND xor(k, 1) <= n AND xor(k, 1) * 2 > n
)
SELECT config, 'c' || k AS component, CAST(position AS INTEGER) AS position, 'c' || entry AS entry, items_only AND k = 1 OR items_only AND 2 * k > n AS items_only FROM r JOIN (SELECT DISTINCT config, n FROM c) USING (config)
""")
def config_entries(spark, d):
    """What a component's pages show of its config's tree [REC7]."""
    return ownership.shown_entries(_nodes(spark, d, cat("c", F.col("k"))))


@query(f"""
SELECT config, 'c' || k AS component, CAST(floor(log2(k)) AS INTEGER) AS depth, CASE WHEN k = 1 THEN 'c1' WHEN k < 4 THEN 'c1/c' || k ELSE 'c1/c' || (k // 2) || '/c' || k END AS crumbs FROM ({_NODES})
""")
def config_breadcrumbs(spark, d):
    """[REC7]"""
    return ownership.breadcrumbs(_nodes(spark, d, cat("c", F.col("k")))).select("config", "component", "depth", F.array_join("crumbs", "/").alias("crumbs"))


# releases --------------------------------------------------------------------------------------------------------------------------

_MONTH = "year(l_shipdate) * 12 + month(l_shipdate)"
_COMPONENTS = f"""
SELECT {_MONTH} AS release, l_returnflag AS type, 's' || (l_suppkey % 40) AS name, CASE WHEN count(*) % 3 = 0 THEN 'Deprecated' ELSE 'stable' END AS status,
  count(*) % 2 = 0 AS requires_cgo, max(l_linenumber) > 5 AS cloud_supported, min(l_linenumber) > 2 AS cloud_only FROM lineitem GROUP BY ALL"""
_FIELDS = f"""
SELECT {_MONTH} AS release, l_returnflag AS type, 's' || (l_suppkey % 40) AS name, 'f' || (l_partkey % 10) AS field, CAST(CAST(max(l_quantity) AS INTEGER) AS VARCHAR) AS default_json,
  CASE WHEN count(*) % 4 = 0 THEN 'deprecated' END AS status, min(l_linenumber) = 7 AS is_deprecated FROM lineitem GROUP BY ALL"""
_STEPS = "s AS (SELECT release, row_number() OVER (ORDER BY release) AS step FROM (SELECT DISTINCT release FROM c)), cs AS (SELECT c.*, step FROM c JOIN s USING (release))"


def _month():
    return (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("release")


def _components(spark, d):
    rows = t(spark, d, "lineitem").groupBy(_month(), F.col("l_returnflag").alias("type"), cat("s", F.col("l_suppkey") % 40).alias("name"))
    return rows.agg(F.when(F.count("*") % 3 == 0, "Deprecated").otherwise("stable").alias("status"), (F.count("*") % 2 == 0).alias("requires_cgo"), (F.max("l_linenumber") > 5).alias("cloud_supported"), (F.min("l_linenumber") > 2).alias("cloud_only"))


def _fields(spark, d):
    rows = t(spark, d, "lineitem").groupBy(_month(), F.col("l_returnflag").alias("type"), cat("s", F.col("l_suppkey") % 40).alias("name"), cat("f", F.col("l_partkey") % 10).alias("field"))
    return rows.agg(F.max("l_quantity").cast("int").cast("string").alias("default_json"), F.when(F.count("*") % 4 == 0, "deprecated").alias("status"), (F.min("l_linenumber") == 7).alias("is_deprecated"))


_FLAGS = [("requires_cgo", "became_cgo_only", "no_longer_cgo_only"), ("cloud_supported", "added_cloud_support", "removed_cloud_support"), ("cloud_only", "became_cloud_only", "no_longer_cloud_only")]


@query(f"""
WITH c AS ({_COMPONENTS}), {_STEPS},
p AS (SELECT coalesce(n.step, o.step + 1) AS step, coalesce(n.type, o.type) AS type, coalesce(n.name, o.name) AS name, o.name IS NOT NULL AS old, n.name IS NOT NULL AS new, o.status AS os, n.status AS ns, {", ".join(f"o.{f} AS o_{f}, n.{f} AS n_{f}" for f, _, _ in _FLAGS)} FROM cs n FULL JOIN cs o ON o.type = n.type AND o.name = n.name AND o.step = n.step - 1),
x AS (
  SELECT step, type, name, 'newComponents' AS change, NULL AS old, ns AS new FROM p WHERE NOT old
  UNION ALL SELECT step, type, name, 'removedComponents', os, NULL FROM p WHERE NOT new
  UNION ALL SELECT step, type, name, 'deprecatedComponents', os, ns FROM p WHERE old AND new AND os = 'stable' AND ns = 'Deprecated'
  {"".join(f"UNION ALL SELECT step, type, name, '{up}', NULL, NULL FROM p WHERE old AND new AND NOT o_{f} AND n_{f} UNION ALL SELECT step, type, name, '{down}', NULL, NULL FROM p WHERE old AND new AND o_{f} AND NOT n_{f} " for f, up, down in _FLAGS)}
)
SELECT release, type, name, change, old, new FROM x JOIN s USING (step) WHERE step > 1
""")
def release_chain_components(spark, d):
    """Months as releases: what changes among components from each to the next [DIFF10, DIFF2]."""
    return releases.chain_components(_components(spark, d))


@query(f"""
WITH k AS ({_COMPONENTS}), c AS ({_FIELDS}), s AS (SELECT release, row_number() OVER (ORDER BY release) AS step FROM (SELECT DISTINCT release FROM k)), cs AS (SELECT c.*, step FROM c JOIN s USING (release)), ks AS (SELECT type, name, step FROM k JOIN s USING (release)),
b AS (SELECT n.* FROM ks n JOIN ks o ON o.type = n.type AND o.name = n.name AND o.step = n.step - 1),
p AS (SELECT coalesce(n.step, o.step + 1) AS step, coalesce(n.type, o.type) AS type, coalesce(n.name, o.name) AS name, coalesce(n.field, o.field) AS field, o.name IS NOT NULL AS old, n.name IS NOT NULL AS new, o.default_json AS od, n.default_json AS nd,
  o.is_deprecated OR coalesce(o.status = 'deprecated', false) AS ox, n.is_deprecated OR coalesce(n.status = 'deprecated', false) AS nx FROM cs n FULL JOIN cs o ON o.type = n.type AND o.name = n.name AND o.field = n.field AND o.step = n.step - 1),
x AS (
  SELECT step, type, name, field, 'newFields' AS change, NULL AS old, nd AS new FROM p WHERE NOT old
  UNION ALL SELECT step, type, name, field, 'removedFields', od, NULL FROM p WHERE NOT new
  UNION ALL SELECT step, type, name, field, 'deprecatedFields', NULL, NULL FROM p WHERE old AND new AND NOT ox AND nx
  UNION ALL SELECT step, type, name, field, 'changedDefaults', od, nd FROM p WHERE old AND new AND od <> nd
)
SELECT release, type, name, field, change, old, new FROM x JOIN b USING (step, type, name) JOIN s USING (step)
""")
def release_chain_fields(spark, d):
    """Months as releases: what changes among fields of components that both have [DIFF10, DIFF2]."""
    return releases.chain_fields(_fields(spark, d), _components(spark, d))


@query(f"""
WITH c AS ({_COMPONENTS}), {_STEPS},
m AS (SELECT *, NOT coalesce(lag(step) OVER w = step - 1 AND lag(status) OVER w = status AND lag(cloud_only) OVER w = cloud_only, false) AS fresh FROM cs WINDOW w AS (PARTITION BY type, name ORDER BY step)),
r AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY type, name ORDER BY step) AS run FROM m)
SELECT type, name, any_value(status) AS status, any_value(cloud_only) AS cloud_only, min(release) AS first, max(release) AS last FROM r GROUP BY type, name, run
""")
def release_intervals(spark, d):
    """From which release to which a component had its values [DIFF10]."""
    return releases.intervals(_components(spark, d), ["type", "name"], ["status", "cloud_only"])


# JSON documents --------------------------------------------------------------------------------------------------------------------


def _json(**fields):
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


@query("""
WITH p AS (SELECT p_partkey AS k, p_name AS n, p_type AS y, p_size AS z FROM part)
SELECT k AS doc, CASE WHEN k % 3 = 0 THEN 'new ' || k ELSE n END AS description, CASE WHEN k % 3 = 0 THEN 'int' ELSE y END AS type, CASE WHEN k % 4 = 0 AND k % 6 > 0 THEN 'a of ' || k ELSE 'a' END AS a, 'b' AS b,
  CAST(CASE WHEN k % 4 = 0 AND k % 6 > 0 THEN 2 * z ELSE z END AS VARCHAR) AS a_version, CAST(z AS VARCHAR) AS a_other, 2 AS n_fields, CASE WHEN k % 4 = 0 AND k % 6 > 0 THEN 'true' END AS only,
  CASE WHEN k % 6 = 0 THEN '[["o1","first"],["o2","second"]]' WHEN k % 5 = 0 THEN '[["o1","first"],["o2","text ' || k || '"],["o3","more"]]' ELSE '[["o1","first"],["o2","second"]]' END AS options,
  CASE WHEN k % 6 = 0 OR k % 7 > 0 THEN 'sum' ELSE 'better' END AS summary, CASE WHEN k % 6 > 0 AND k % 7 = 0 THEN 2 ELSE 1 END AS n_examples, CASE WHEN k % 3 = 0 THEN CAST(z AS VARCHAR) END AS inner_version, NULL AS unknown FROM p
""")
def override_merge(spark, d):
    """Overrides over documents by rule: keys that may change, items by name, options and examples that are added [REC5]."""
    k, z = F.col("p_partkey"), F.col("p_size")
    part = t(spark, d, "part")
    item = lambda name, text: F.struct(F.lit(name).alias("name"), F.lit(text).alias("description"), z.alias("version"), z.alias("other"))
    pairs = lambda *x: F.array(*(F.array(F.lit(a), b if not isinstance(b, str) else F.lit(b)) for a, b in x))
    example = lambda title, **f: F.struct(F.lit(title).alias("title"), *(F.lit(v).alias(n) for n, v in f.items()))
    docs = part.select(k.alias("doc"), _json(description=F.col("p_name"), type=F.col("p_type"), fields=F.array(item("a", "a"), item("b", "b")), annotated_options=pairs(("o1", "first"), ("o2", "second")), examples=F.array(example("e1", summary="sum")), config=F.struct(F.lit(1).alias("x"))).alias("json"))
    own = k % 6 > 0
    changes = _json(
        description=F.when(k % 3 == 0, cat("new ", k)), type=F.when(k % 3 == 0, "int"),
        fields=F.when(own & (k % 4 == 0), F.array(F.struct(F.lit("a").alias("name"), cat("a of ", k).alias("description"), (2 * z).alias("version"), F.lit(9).alias("other"), F.lit(True).alias("selfManagedOnly")), F.struct(F.lit("c").alias("name"), F.lit("never added").alias("description"), z.alias("version"), F.lit(9).alias("other"), F.lit(True).alias("selfManagedOnly")))),
        annotated_options=F.when(own & (k % 5 == 0), pairs(("o2", cat("text ", k)), ("o3", F.lit("more")))),
        examples=F.when(own & (k % 7 == 0), F.array(example("e1", summary="better"), example("e2", summary="new"))),
        config=F.when(k % 3 == 0, F.struct(z.alias("version"), F.lit(2).alias("x"))), unknown=F.lit("never"),
    )
    out = documents.merge_overrides(docs, part.select(k.alias("doc"), changes.alias("json")))
    at = lambda path: F.get_json_object("json", path)
    return out.select("doc", at("$.description").alias("description"), at("$.type").alias("type"), at("$.fields[0].description").alias("a"), at("$.fields[1].description").alias("b"), at("$.fields[0].version").alias("a_version"), at("$.fields[0].other").alias("a_other"), F.json_array_length(at("$.fields")).alias("n_fields"), at("$.fields[0].selfManagedOnly").alias("only"), at("$.annotated_options").alias("options"), at("$.examples[0].summary").alias("summary"), F.json_array_length(at("$.examples")).alias("n_examples"), at("$.config.version").alias("inner_version"), at("$.unknown").alias("unknown"))


@query("""
WITH RECURSIVE n AS (SELECT p_partkey // 10 AS doc, p_partkey % 10 AS i, (p_partkey * 3 + p_size) % 12 AS j FROM part),
size AS (SELECT doc, count(*) AS size FROM n GROUP BY doc),
r AS (
  SELECT doc, 'n' || i AS context, j, CAST([] AS BIGINT[]) AS chain FROM n
  UNION ALL SELECT r.doc, r.context || ' -> #/n' || r.j, n.j, list_append(r.chain, r.j) FROM r JOIN n ON n.doc = r.doc AND n.i = r.j WHERE NOT list_contains(r.chain, r.j)
)
SELECT r.doc, context, '#/n' || j AS ref, CAST(len(chain) AS INTEGER) AS hops, CASE WHEN list_contains(chain, j) THEN 'circular: #/n' || j WHEN j >= size THEN 'does not exist: #/n' || j END AS error FROM r JOIN size USING (doc)
""")
def reference_chains(spark, d):
    """References of JSON documents, each node to another, followed to their ends [REC3, REC13]."""
    k = F.col("p_partkey")
    entry = F.struct(cat("n", k % 10).alias("name"), F.struct(cat("#/n", (k * 3 + F.col("p_size")) % 12).alias("$ref"), F.col("p_size").alias("x")).alias("node"))
    docs = t(spark, d, "part").groupBy(F.floor(k / 10).alias("doc")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("json"))
    return documents.reference_chains(docs).select("doc", "context", "ref", F.size("chain").alias("hops"), "error")


# build constraints -------------------------------------------------------------------------------------------------------------------

_FILES = ["a.go", "a_linux.go", "a_darwin_arm64.go", "linux.go", "a_amd64.go", "a_windows.go"]
_HEADERS = ["", "//go:build linux && !cgo || darwin", "//go:build !(windows || plan9) && unix", "// +build linux,custom darwin\n// +build !windows", "//go:build (linux || freebsd) && amd64\n// +build windows", "//go:build custom || !unix", "// +build !!linux"]


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 6 AS f, p_partkey % 7 AS h FROM part), s AS (SELECT unnest(['linux', 'darwin', 'windows']) AS system),
x AS (SELECT p_partkey, system, CASE f WHEN 1 THEN system = 'linux' WHEN 2 THEN system = 'darwin' WHEN 5 THEN system = 'windows' ELSE true END
  AND CASE h WHEN 1 THEN system = 'darwin' WHEN 2 THEN system <> 'windows' WHEN 3 THEN system = 'darwin' WHEN 4 THEN system = 'linux' WHEN 5 THEN system = 'windows' WHEN 6 THEN system = 'linux' ELSE true END AS builds FROM p, s)
SELECT p_partkey, max(builds) FILTER (system = 'linux') AS linux, max(builds) FILTER (system = 'darwin') AS darwin, max(builds) FILTER (system = 'windows') AS windows FROM x GROUP BY p_partkey
""")
def build_constraints(spark, d):
    """Whether a source file builds, by its name and its constraint, of which each row has its own [F27]."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (key() % n + 1).cast("int"))
    files = t(spark, d, "part").select("p_partkey", pick(_FILES, 6).alias("name"), F.concat(F.lit("// Notes\n"), pick(_HEADERS, 7), F.lit("\n\npackage x\n//go:build windows\n")).alias("contents"))
    return files.select("p_partkey", *(X.file_builds("name", "contents", s).alias(s) for s in ("linux", "darwin", "windows")))


@query("""
WITH p AS (SELECT p_partkey AS k, p_partkey // 4 AS g, p_partkey % 4 AS i FROM part)
SELECT DISTINCT CASE WHEN g % 3 = 0 THEN 'tool g' || g ELSE 'tool g' || g || ' c' || k END AS command FROM p WHERE i < 3 AND CASE WHEN g % 3 = 0 THEN i = 0 WHEN g % 3 = 1 THEN i = 1 AND g % 2 = 0 ELSE false END
""")
def linux_only(spark, d):
    """Commands that only one system's files register: whole folders, and names that the other system lacks [J47, SRC21, F27].

    A folder has four parts. In each third folder all files are for Linux; in the next its first file is for macOS, the second for Linux,
    and both add the first command; elsewhere files build everywhere. The second file's own command is hidden in odd folders."""
    k = key()
    g, i = F.floor(k / 4), k % 4
    only = g % 3 == 0
    suffix = F.when(only, "_linux.go").when((g % 3 == 1) & (i == 0), "_darwin.go").when((g % 3 == 1) & (i == 1), "_linux.go").otherwise(".go")
    adds = F.when(i == 2, "").otherwise(F.concat(F.lit("  root.AddCommand(New"), cat(F.floor(k / 4) * 4), F.lit("Cmd(), wrap(New"), cat(k), F.lit("Cmd(x.NewLauncher()))\n")))
    hidden = F.when((i == 1) & (g % 2 == 1), ", Hidden: true").otherwise("")
    text = F.concat(F.lit("package p\nfunc New"), cat(k), F.lit('Cmd() *cobra.Command {\n  c := &cobra.Command{ Use: "c'), cat(k), F.lit(' [flags]"'), hidden, F.lit(" }\n"), adds, F.lit("}\n"))
    return builds.only_on(t(spark, d, "part").select(cat("g", g).alias("folder"), cat("f", k, suffix).alias("name"), text.alias("contents")))


# C++ types and symbols ---------------------------------------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT p_partkey AS k, p_size AS z, p_name AS n FROM part)
SELECT k AS p_partkey, 'struct' AS kind, 'a' || k || '::conf' AS name, 0 AS ordinal, 'x' || z AS item, 'int' AS type, CAST(z AS VARCHAR) AS detail FROM s
UNION ALL SELECT k, 'struct', 'a' || k || '::conf', 1, 'y', 'std::optional<b>', NULL FROM s
UNION ALL SELECT k, 'struct', 'a' || k || '::conf::inner', 0, 'flag', 'bool', NULL FROM s
UNION ALL SELECT k, 'struct', 'conf', 0, 'text', 'std::string', '"' || n || '; {"' FROM s
UNION ALL SELECT k, 'enum', 'a' || k || '::kind', 0, 'first', NULL, n FROM s
UNION ALL SELECT k, 'enum', 'a' || k || '::kind', 1, 'second' || z, NULL, NULL FROM s
UNION ALL SELECT k, 'alias', 'a' || k || '::id', 0, NULL, 'kind', NULL FROM s
""")
def scoped_types(spark, d):
    """Structs, enumerations and aliases by their full names; two structs of one name in two scopes stay apart [SRC19, SRC26]."""
    k, z, n = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    text = cat("namespace a", k, " { // namespace no {\nstruct conf { int x", z, " = ", z, "; std::optional<b> y; struct inner { bool flag; }; void f() { int no = 1; } };\nenum class kind : uint8_t { first = 0, /* x, y */ second", z, ' };\nusing id = kind;\n}\nstruct conf { std::string text = "', n, '; {"; };\nstd::string_view to_string(kind v) { switch (v) { case kind::first: return "', n, '"; default: return "none"; } }')
    rows = types.definitions(t(spark, d, "part").select(k.alias("path"), text.alias("contents")))
    return rows.select(F.col("path").alias("p_partkey"), "kind", "name", "ordinal", "item", "type", "detail")


@query("""
WITH RECURSIVE a AS (SELECT p_partkey AS k, 'n::t' || p_partkey AS name, CASE WHEN p_partkey % 5 = 0 THEN 'base' || p_size ELSE 'n::t' || (p_partkey - 1) END AS type FROM part),
r AS (SELECT k, name, type FROM a UNION ALL SELECT r.k, r.name, a.type FROM r JOIN a ON a.name = r.type)
SELECT name, type FROM r WHERE type LIKE 'base%'
""")
def alias_ends(spark, d):
    """Aliases of aliases, each name looked up in its own namespace first [SRC19, J16]."""
    k = F.col("p_partkey")
    text = cat("namespace n { using t", k, " = ", F.when(k % 5 == 0, cat("base", F.col("p_size"))).otherwise(cat("t", k - 1)), "; }")
    return types.alias_ends(types.definitions(t(spark, d, "part").select(k.alias("path"), text.alias("contents"))))


@query("""
WITH f AS (SELECT n_regionkey AS r, n_name AS field, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS o FROM nation),
p AS (SELECT p_partkey AS k, p_partkey % 5 AS r, p_name AS n, p_size AS z FROM part)
SELECT k AS id, field || '/x' AS path, '1' || z || '00' AS value FROM p JOIN f USING (r) WHERE o = 0
UNION ALL SELECT k, field || '/y', CASE WHEN k % 3 > 0 THEN n || ', b' END FROM p JOIN f USING (r) WHERE o = 0
UNION ALL SELECT k, field, CASE o WHEN 1 THEN 'fast' || z WHEN 2 THEN CAST(k AS VARCHAR) END FROM p JOIN f USING (r) WHERE o > 0
""")
def expanded_defaults(spark, d):
    """Defaults whose arguments are the fields of their types in order, to any depth; types are found in namespaces [SRC35, SRC36]."""
    from pyspark.sql import Window

    n = t(spark, d, "nation").withColumn("ordinal", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1)
    fields = n.select(cat("model::r", F.col("n_regionkey")).alias("type"), "ordinal", cat("_", F.col("n_name")).alias("field"), F.when(F.col("ordinal") == 0, "s").otherwise("string").alias("kind"))
    fields = fields.unionByName(spark.createDataFrame([("config::s", 0, "x", "integer"), ("config::s", 1, "_y", "string")], fields.schema))
    k, name = F.col("p_partkey"), cat("r", F.col("p_partkey") % 5)
    text = F.concat(name, F.lit("(config::s{1"), F.col("p_size").cast("string"), F.lit("'00"), F.when(k % 3 > 0, cat(', "', F.col("p_name"), ', b"')).otherwise(""), cat("}, mode::fast", F.col("p_size"), ", ", k, ")"))
    return types.expand_defaults(t(spark, d, "part").select(k.alias("id"), name.alias("type"), text.alias("text")), fields).select("id", F.array_join("path", "/").alias("path"), "value")


@query("""
SELECT 'm' || p_partkey AS name, CAST(i AS INTEGER) AS ordinal, CASE i WHEN 0 THEN p_name WHEN 1 THEN 'S' || p_size ELSE 'other::thing' END AS value, i = 0 AND p_partkey % 2 = 0 AS licensed FROM part, (SELECT unnest([0, 1, 2]) AS i)
UNION ALL SELECT 's' || p_partkey, CAST(i AS INTEGER), CASE i WHEN 0 THEN 'A' || p_partkey ELSE 'B' || p_size END, false FROM part, (SELECT unnest([0, 1]) AS i) WHERE p_partkey % 3 = 0
""")
def validator_enums(spark, d):
    """Values that validators allow: arrays that they look into, and classes that they compare with [U3]."""
    k, z, n = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    code = cat("bool validate_m", k, "(const std::vector<x>& ms) { for (auto& m : ms) { if (!std::ranges::contains(supported_m", k, ", m)) { return false; } } }\nvoid check_s", k, "(cfg& c, std::string_view v) { if (v != a::a", k, "::name && v != b", k, "::name) { throw x; } }\nvoid run() { check_s", k, "(c, config::shard().", F.when(k % 3 == 0, cat("s", k)).otherwise("none"), "(), 3); }")
    head = cat("constexpr std::string_view t", k, '{"', n, '"};\ninline constexpr auto supported_m', k, " = std::to_array<std::string_view>({t", k, ', "S', z, '", other::thing});\n', F.when(k % 2 == 0, cat("inline constexpr auto enterprise_m", k, " = std::to_array<std::string_view>({t", k, "});\n")).otherwise(""), "struct a", k, ' { static constexpr const char* name = "A', k, '"; };\nstruct b', k, ' : base { static constexpr const char* name = "B', z, '"; };')
    # a file of part is small and its texts take long: rows are dealt out, or a few tasks would scan them all
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = t(spark, d, "part").select("p_partkey", "p_size", "p_name").repartition(tasks).select(F.explode(F.array(F.struct(cat(k, ".cc").alias("path"), code.alias("contents")), F.struct(cat(k, ".h").alias("path"), head.alias("contents")))).alias("f")).select("f.*")
    param = lambda v, kind: F.struct(v.alias("value"), F.lit(kind).alias("kind"))
    four = [param(F.lit("x"), "string_literal")] * 4
    some = t(spark, d, "part").select(F.explode(F.array(F.struct(cat("m", k).alias("name"), F.lit("std::vector<ss::sstring>").alias("base_type"), F.array(*four, param(cat("&config::validate_m", k), "identifier")).alias("params")), F.struct(cat("s", k).alias("name"), F.lit("ss::sstring").alias("base_type"), F.array(*four).alias("params")))).alias("s")).select("s.*")
    return types.validator_enums(some, files)
