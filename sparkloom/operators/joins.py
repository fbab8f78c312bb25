"""Joins of the inventory, each as equi-joins that shuffle on their keys. Sides are never broadcast by hint; adaptive execution does that
below its size limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import C, col
from .filters import ancestors


def last_wins(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The row of the largest ordinal for each key [N19, J4]. One row per key and task reaches the shuffle."""
    return _wins(df, keys, ordinal, F.max_by)


def first_wins(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The row of the smallest ordinal for each key [N19, J15, W1]."""
    return _wins(df, keys, ordinal, F.min_by)


def _wins(df, keys, ordinal, pick):
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(ordinal)).alias("__r")).select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest))


def left_lookup(left: DataFrame, right: DataFrame, keys: list[str], fill: dict[str, str] | None = None) -> DataFrame:
    """Left outer join; missing text becomes '' or the value given [J1, J2, J3, J19, J20, J28, J31, J33, J35]."""
    out = left.join(right, keys, "left")
    return out.fillna(fill) if fill else out


def union_of_names(existing: C, found: C) -> Column:
    """Names already there, then new ones [J2]."""
    return F.array_union(F.coalesce(col(existing), F.array().cast("array<string>")), F.coalesce(col(found), F.array().cast("array<string>")))


#: Ids of a set of categories that are dealt into one block, on average, when pairs are spelled out.
_BLOCK = 2048


def division_sets(source: DataFrame, target: DataFrame, source_id: str, target_id: str, category: str, compatible: Column | None = None, payload: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Relational division by sets: members (id, of) of each side, and pairs (source, target) of sets where the target has all categories of the source [J5, J6].

    Ids with the same rows (category, payload) form one set, named by its least id. Sets are compared, not ids: pairs of sets are counted on
    shared categories and compared with the source's number. So the result grows with the ids and with the pairs of different sets.
    compatible sees columns s_<payload> and t_<payload>."""

    def sets(df: DataFrame, of: str, side: str) -> DataFrame:
        row = F.struct(F.col(category).alias("c"), *(F.col(c).alias(f"{side}_{c}") for c in payload))
        return df.filter(F.col(category).isNotNull()).groupBy(F.col(of).alias("id")).agg(F.array_sort(F.collect_set(row)).alias("set"))

    def named(members: DataFrame) -> tuple[DataFrame, DataFrame]:
        names = members.groupBy("set").agg(F.min("id").alias("of"))
        return members.join(names, "set").select("id", "of"), names

    (s, s_sets), (t, t_sets) = named(sets(source, source_id, "s")), named(sets(target, target_id, "t"))
    left = s_sets.select(F.col("of").alias("source"), F.size(F.array_distinct(F.transform("set", lambda x: x["c"]))).alias("need"), F.explode("set").alias("x")).select("source", "need", "x.*")
    pairs = left.join(t_sets.select(F.col("of").alias("target"), F.explode("set").alias("x")).select("target", "x.*"), "c")
    if compatible is not None:
        pairs = pairs.filter(compatible)
    return s, t, pairs.groupBy("source", "target", "need").agg(F.countDistinct("c").alias("got")).filter("got = need").select("source", "target")


def spelled_out(s: DataFrame, t: DataFrame, pairs: DataFrame, block: int = _BLOCK) -> DataFrame:
    """Pairs (source, target) of different ids behind the members and pairs of division_sets() [J5, J6].

    The result grows with the square of ids of alike sets. The ids of a set are dealt into blocks by its size, a block is one row, and pairs
    of blocks are dealt evenly over all tasks, so that a task holds two blocks and a hot set is spread. By their bytes, which are few beside
    the rows that follow, adaptive execution would put them into one task."""
    spark = pairs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def dealt(members: DataFrame, of: str) -> tuple[DataFrame, DataFrame]:
        sizes = members.groupBy("of").agg(F.ceil(F.count("*") / block).alias("n"))
        rows = members.join(sizes, "of").groupBy(F.col("of").alias(of), F.pmod(F.xxhash64("id"), F.col("n")).alias(f"{of}_block"))
        return rows.agg(F.sort_array(F.collect_list("id")).alias(f"{of}_ids")), sizes.select(F.col("of").alias(of), F.sequence(F.lit(0).cast("long"), F.col("n") - 1).alias(f"{of}_blocks"))

    (left, s_sizes), (right, t_sizes) = dealt(s, "source"), dealt(t, "target")
    found = pairs.join(s_sizes, "source").join(t_sizes, "target").withColumn("source_block", F.explode("source_blocks")).drop("source_blocks").join(left, ["source", "source_block"])
    found = found.withColumn("target_block", F.explode("target_blocks")).join(right, ["target", "target_block"]).select("source_ids", "target_ids").repartition(tasks)
    # coalesce() to the number there is moves no row; it keeps the two explodes apart, as one piece of generated code would hold all rows of a pair of blocks at once
    rows = found.select(F.explode("source_ids").alias("source"), "target_ids").coalesce(tasks).select("source", F.explode("target_ids").alias("target"))
    return rows.filter("source != target")


def divides(source: DataFrame, target: DataFrame, source_id: str, target_id: str, category: str, compatible: Column | None = None, payload: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (source_id, target_id) of division_sets() spelled out, without those of an id with itself [J5, J6]."""
    out = spelled_out(*division_sets(source, target, source_id, target_id, category, compatible, payload))
    return out.select(F.col("source").alias(source_id), F.col("target").alias(f"related_{target_id}"))


def docs_compatible(s: C = "s_deployment", t: C = "t_deployment") -> Column:
    """Targets without a deployment fit all, others the same one [J5]."""
    return F.coalesce(col(t), F.lit("")).isin("") | (col(s) == col(t))


def labs_compatible(s: C = "s_deployment", t: C = "t_deployment", cloud: str = "Cloud") -> Column:
    """Cloud pages take cloud labs only; all others take Docker and Kubernetes ones [J6]."""
    x, y = F.coalesce(col(s), F.lit("")), F.coalesce(col(t), F.lit(""))
    return (y == "") | ((x == cloud) & (y == cloud)) | ((x != cloud) & y.isin("Docker", "Kubernetes"))


def split_sides(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with `side`: both, left, right [J7, J8, J34, J37, J39, J40, J47, SET7]."""
    a, b = left.select(*keys).distinct().withColumn("__l", F.lit(1)), right.select(*keys).distinct().withColumn("__r", F.lit(1))
    return a.join(b, keys, "full_outer").select(*keys, F.when(F.col("__l").isNull(), "right").when(F.col("__r").isNull(), "left").otherwise("both").alias("side"))


def augment(base: DataFrame, more: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Rows of base flagged by whether more has their key, and the rows of more that base lacks [J9, J38]."""
    marked = base.join(more.select(*keys).distinct().withColumn(flag, F.lit(True)), keys, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return marked.unionByName(more.join(base.select(*keys), keys, "left_anti").withColumn(flag, F.lit(True)), allowMissingColumns=True)


def by_name_or_alias(rows: DataFrame, found: DataFrame, key: str, aliases: str, name: str, rank: str) -> DataFrame:
    """Left join by name or any alias; of several hits that of the least rank wins, a name before an alias [J10]."""
    keyed = rows.select(key, F.posexplode(F.concat(F.array(F.col(key)), F.coalesce(aliases, F.array().cast("array<string>")))).alias("__k", "__n"))
    rest = [c for c in found.columns if c not in (name, rank)]
    hits = keyed.join(found.withColumnRenamed(name, "__n"), "__n").groupBy(key).agg(F.min_by(F.struct(rank, *rest), F.struct(rank, "__k")).alias("__hit"))
    return rows.join(hits, key, "left").select(*rows.columns, *(F.col(f"__hit.{c}").alias(c) for c in [rank, *rest]))


def sync_actions(new: DataFrame, old: DataFrame, key: str, compare: list[str], keep: Column | None = None) -> DataFrame:
    """(key, action): add, update or delete; rows that `keep` protects, judged on the old row's columns o_*, are not deleted [J12, N24].

    compare lists the columns that count, so a column that changes on each run can be left out [N23]."""
    n = new.select(F.col(key), *(F.col(c).alias(f"n_{c}") for c in compare), F.lit(1).alias("__n"))
    o = old.select(F.col(key), *(F.col(c).alias(f"o_{c}") for c in old.columns if c != key), F.lit(1).alias("__o"))
    differs = F.lit(False)
    for c in compare:
        differs = differs | ~F.col(f"n_{c}").eqNullSafe(F.col(f"o_{c}"))
    protected = F.lit(False) if keep is None else F.coalesce(keep, F.lit(False))
    action = F.when(F.col("__o").isNull(), "add").when(F.col("__n").isNull() & ~protected, "delete").when(F.col("__n").isNotNull() & differs, "update")
    return n.join(o, key, "full_outer").select(key, action.alias("action")).filter("action is not null")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, right_id: str, values: list[str]) -> DataFrame:
    """Backward, inclusive as-of join: the last right row at or before each left row [J13].

    Both sides are sorted once by key and time, and the last right row is carried forward; no pair is formed. Of right rows at one
    time that with the largest id counts. With no equal keys, pass a bucket column in keys or expect one sorted run per key."""
    kind = right.schema[right_id].dataType
    rows_l = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__id"), F.struct(*left.columns).alias("__left"))
    r = F.struct(F.col(right_time), *(F.col(c) for c in values))
    rows_r = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.col(right_id).alias("__id"), r.alias("__right"))
    order = Window.partitionBy(*keys).orderBy("__t", "__side", "__id").rowsBetween(Window.unboundedPreceding, 0)
    both = rows_l.unionByName(rows_r, allowMissingColumns=True).withColumn("__hit", F.last("__right", ignorenulls=True).over(order))
    return both.filter("__side = 1").select("__left.*", F.col(f"__hit.{right_time}").alias(f"matched_{right_time}"), *(F.col(f"__hit.{c}").alias(c) for c in values))


def first_candidate(rows: DataFrame, lookup: DataFrame, row_id: str, candidates: list[Column], key: str, values: list[str]) -> DataFrame:
    """The value of the first candidate key that the lookup has [J14, J17, J18, J23, J36, J41, J42]."""
    keyed = rows.select(row_id, F.posexplode(F.array(*candidates)).alias("__rank", "__key")).filter("__key is not null")
    hits = keyed.join(lookup.select(F.col(key).alias("__key"), *values), "__key").groupBy(row_id).agg(F.min_by(F.struct("__key", *values), "__rank").alias("__hit"), F.min("__rank").alias("candidate"))
    return rows.join(hits, row_id, "left").select(*rows.columns, "candidate", F.col("__hit.__key").alias("matched_key"), *(F.col(f"__hit.{v}").alias(v) for v in values))


def precedence(tables: list[DataFrame], key: str) -> DataFrame:
    """Union in which the first table with a key wins; inside a table the smallest ordinal [J15, SRC10]."""
    out = None
    for rank, t in enumerate(tables):
        t = t.withColumn("__rank", F.struct(F.lit(rank).alias("table"), F.col("ordinal").alias("ordinal")))
        out = t if out is None else out.unionByName(t)
    return first_wins(out, [key], "__rank").drop("__rank", "ordinal")


def follow_aliases(edges: DataFrame, start: str = "id", target: str = "target", hops: int = 5) -> DataFrame:
    """Each id's last target after at most `hops` further steps [J16]."""
    now = edges.select(F.col(start).alias("id"), F.col(target).alias("at"), F.lit(0).alias("hops"))
    step = edges.select(F.col(start).alias("at"), F.col(target).alias("next"))
    for _ in range(hops):
        now = now.join(step, "at", "left").select("id", F.coalesce("next", "at").alias("at"), (F.col("hops") + F.col("next").isNotNull().cast("int")).alias("hops"))
    return now


def upsert(base: DataFrame, over: DataFrame, key: str, values: list[str], name: str | None = None) -> DataFrame:
    """Values of `over` replace those of base where not null; keys that base lacks are inserted as stubs [J21, J22, J44, DIFF11].

    With `name`, a row of over whose key is unknown is matched through that column first. `origin` tells base, both or stub."""
    if name:
        known = base.select(F.col(key).alias("__known"))
        over = over.join(known, F.col(key) == F.col("__known"), "left").withColumn(key, F.when(F.col("__known").isNotNull(), F.col(key)).otherwise(F.coalesce(F.col(name), F.col(key)))).drop("__known")
    o = over.select(F.col(key), *(F.col(v).alias(f"__o_{v}") for v in values), F.lit(1).alias("__o"))
    b = base.withColumn("__b", F.lit(1))
    out = b.join(o, key, "full_outer")
    origin = F.when(F.col("__b").isNull(), "stub").when(F.col("__o").isNull(), "base").otherwise("both")
    return out.select(key, *(F.coalesce(F.col(f"__o_{c}"), F.col(c)).alias(c) if c in values else F.col(c) for c in base.columns if c != key), origin.alias("origin"))


def findings(registry: DataFrame, source: DataFrame, key: str, unmapped: str = "error", dangling: str = "warning") -> DataFrame:
    """(key, problem, severity): source values that the registry lacks and registry entries that point at nothing [J11, J24, J26, J29]."""
    a = source.join(registry, key, "left_anti").select(key, F.lit("unmapped").alias("problem"), F.lit(unmapped).alias("severity"))
    b = registry.join(source, key, "left_anti").select(key, F.lit("dangling").alias("problem"), F.lit(dangling).alias("severity"))
    return a.unionByName(b)


def prefix_join(rows: DataFrame, roots: DataFrame, path: str, root: str, sep: str = " ", longest: bool = True) -> DataFrame:
    """Rows with a root that is the path or lies above it, the nearest one or (longest=False) the topmost [J27]. Ancestors are exploded, so this is an equi-join."""
    rows_a = rows.select(path, F.posexplode(ancestors(path, sep)).alias("__n", root))
    hit = rows_a.join(roots.select(root).distinct(), root)
    pick = F.max_by if longest else F.min_by
    return rows.join(hit.groupBy(path).agg(pick(root, "__n").alias(root)), path)


def validate_categories(pages: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(page, categories): known categories with missing parents added, unknown ones dropped, in order of name [J32]. pages: (page, category); taxonomy: (category, parent)."""
    known = pages.join(taxonomy, "category").select("page", F.explode(F.array_compact(F.array("category", "parent"))).alias("category"))
    return known.groupBy("page").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def unpublish_tree(nav: DataFrame, unpublished: DataFrame) -> DataFrame:
    """Navigation items (path, url) without those whose page is unpublished, and without what hangs below them [J30]."""
    bad = nav.join(unpublished.select("url"), "url", "left_semi").select(F.col("path").alias("root"))
    return nav.join(prefix_join(nav, bad, "path", "root", "/").select("path"), "path", "left_anti")


def description_gaps(tree: DataFrame, overrides: DataFrame, least: int = 500) -> DataFrame:
    """Commands whose override is longer than their text by more than `least`, largest gap first [J35]."""
    gap = F.length("override") - F.length(F.coalesce("description", F.lit("")))
    return tree.join(overrides, "path").withColumn("gap", gap).filter(F.col("gap") > least).orderBy(F.desc("gap"), "path")


def stub_plan(stubs: DataFrame, partials: DataFrame, aliases: DataFrame) -> DataFrame:
    """(file, action) delete, keep, skip, create for managed and unmanaged stub files [J43]."""
    joined = stubs.withColumn("__s", F.lit(1)).join(partials.select("file").withColumn("__p", F.lit(1)), "file", "full_outer").join(aliases.select("file").distinct().withColumn("__a", F.lit(1)), "file", "left")
    action = F.when(F.col("__s").isNotNull() & ~F.coalesce("managed", F.lit(False)), "keep").when(F.col("__s").isNotNull() & F.col("__p").isNull(), "delete").when(F.col("__s").isNotNull(), "upgrade").when(F.col("__a").isNotNull(), "skip").otherwise("create")
    return joined.select("file", action.alias("action"))


def stamp_versions(new: DataFrame, old: DataFrame, keys: list[str], version: str, by_plugin: DataFrame | None = None) -> DataFrame:
    """Rows of new with `introduced`: as it was if set, else, for rows that old lacks, the plugin's version before the product's [J46, DIFF8]."""
    fresh = new.join(old.select(*keys).withColumn("__old", F.lit(1)), keys, "left")
    stamp = F.lit(version)
    if by_plugin is not None:
        fresh = fresh.join(by_plugin.select("plugin", F.col("version").alias("__pv")), "plugin", "left")
        stamp = F.coalesce("__pv", stamp)
    return fresh.withColumn("introduced", F.coalesce("introduced", F.when(F.col("__old").isNull(), stamp))).drop("__old", "__pv")


def anchored_insert(nav: DataFrame, kept: DataFrame) -> DataFrame:
    """Rebuilt items (name, position) with protected blocks put back after their earlier anchor, or at the end [J45]. kept: (name, anchor)."""
    spots = kept.join(nav.select(F.col("name").alias("anchor"), F.col("position").alias("__at")), "anchor", "left").join(nav.select("name"), "name", "left_anti")
    back = spots.select("name", F.coalesce(F.col("__at") + 0.5, F.lit(1e9)).alias("position"))
    return nav.select("name", F.col("position").cast("double").alias("position")).unionByName(back).orderBy("position", "name")
