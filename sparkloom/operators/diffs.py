"""Comparing two snapshots of a catalog. All change types of a grain come from one full outer join on its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import json_equal, removes_deprecated
from ..functions.text import C, col
from .joins import prefix_join


def full_outer(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, structs o and n of the other columns (null where a side lacks the key)."""
    side = lambda df, name: df.select(*keys, F.struct(*(c for c in df.columns if c not in keys), F.lit(1).alias("__here")).alias(name))
    return side(old, "o").join(side(new, "n"), keys, "full_outer")


def changes(df: DataFrame, keys: list[str], tests: list[tuple[str, Column, Column | None, Column | None]]) -> DataFrame:
    """(keys, change, old, new): a row for each test (name, condition, old value, new value) that holds."""
    none = F.lit(None).cast("string")
    rows = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("change"), (none if a is None else a.cast("string")).alias("old"), (none if b is None else b.cast("string")).alias("new"))) for n, c, a, b in tests))
    return df.select(*keys, F.explode(F.array_compact(rows)).alias("c")).select(*keys, "c.*")


def compare_properties(old: DataFrame, new: DataFrame, new_version: str) -> DataFrame:
    """DIFF1 over (name, type, description, default_json, is_deprecated, is_experimental).

    A newly deprecated property has no other change [N11]; defaults are compared deeply and missing is not null [N4]; a removed one counts
    as removed deprecated from the version on that deletes those [N13], and experimental ones do not count."""
    d = full_outer(old, new, ["name"])
    o, n = F.col("o"), F.col("n")
    both, added, removed = o.isNotNull() & n.isNotNull(), o.isNull(), n.isNull()
    deprecated = both & F.coalesce(n["is_deprecated"], F.lit(False)) & ~F.coalesce(o["is_deprecated"], F.lit(False))
    kept = both & ~deprecated
    gone = removed & ~(F.coalesce(o["is_experimental"], F.lit(False)) | F.col("name").startswith("development_"))
    boundary = removes_deprecated(F.lit(new_version))
    empty = F.coalesce(F.trim(n["description"]) == "", F.lit(True)) | (n["description"] == "No description")
    text = lambda s: F.when(F.coalesce(s["description"], F.lit("")) == "", "No description").otherwise(s["description"])
    tests = [
        ("newProperties", added, None, n["type"]),
        ("deprecatedProperties", deprecated, None, None),
        ("changedDefaults", kept & ~json_equal(o["default_json"], n["default_json"]), o["default_json"], n["default_json"]),
        ("changedDescriptions", kept & ~o["description"].eqNullSafe(n["description"]), text(o), text(n)),
        ("changedTypes", kept & ~o["type"].eqNullSafe(n["type"]), o["type"], n["type"]),
        ("removedDeprecatedProperties", gone & boundary, o["type"], None),
        ("removedProperties", gone & ~boundary, o["type"], None),
        ("emptyDescriptions", n.isNotNull() & empty & ~F.coalesce(n["is_deprecated"], F.lit(False)), None, n["type"]),
    ]
    return changes(d, ["name"], tests)


def _deprecated(s: Column) -> Column:
    return F.coalesce(s["is_deprecated"], F.lit(False)) | (F.lower(F.coalesce(s["status"], F.lit(""))) == "deprecated")


#: Platform flags and the names of their changes.
PLATFORM = [("requires_cgo", "became_cgo_only", "no_longer_cgo_only"), ("cloud_supported", "added_cloud_support", "removed_cloud_support"), ("cloud_only", "became_cloud_only", "no_longer_cloud_only")]


def component_tests() -> list:
    """What changes() looks for in the sides o and n of a component."""
    o, n = F.col("o"), F.col("n")
    both = o.isNotNull() & n.isNotNull()
    low = lambda s: F.lower(F.coalesce(s["status"], F.lit("")))
    flag = lambda s, f: F.coalesce(s[f], F.lit(False))
    tests = [("newComponents", o.isNull(), None, n["status"]), ("removedComponents", n.isNull(), o["status"], None), ("deprecatedComponents", both & (low(o) != "deprecated") & (low(n) == "deprecated"), o["status"], n["status"])]
    for f, up, down in PLATFORM:
        tests += [(up, both & ~flag(o, f) & flag(n, f), None, None), (down, both & flag(o, f) & ~flag(n, f), None, None)]
    return tests


def compare_components(old: DataFrame, new: DataFrame) -> DataFrame:
    """DIFF2 at the grain of components (type, name, status, requires_cgo, cloud_supported, cloud_only)."""
    return changes(full_outer(old, new, ["type", "name"]), ["type", "name"], component_tests())


def field_tests() -> list:
    """What changes() looks for in the sides o and n of a field."""
    o, n = F.col("o"), F.col("n")
    both = o.isNotNull() & n.isNotNull()
    return [("newFields", o.isNull(), None, n["default_json"]), ("removedFields", n.isNull(), o["default_json"], None), ("deprecatedFields", both & ~_deprecated(o) & _deprecated(n), None, None), ("changedDefaults", both & ~o["default_json"].eqNullSafe(n["default_json"]), o["default_json"], n["default_json"])]


def compare_fields(old: DataFrame, new: DataFrame, old_components: DataFrame, new_components: DataFrame) -> DataFrame:
    """DIFF2 at the grain of fields (type, name, field, default_json, status, is_deprecated), of components in both snapshots only.

    Defaults are compared as they are written, so the order of keys counts [N3]."""
    common = old_components.select("type", "name").join(new_components.select("type", "name"), ["type", "name"], "left_semi")
    d = full_outer(old.join(common, ["type", "name"], "left_semi"), new.join(common, ["type", "name"], "left_semi"), ["type", "name", "field"])
    return changes(d, ["type", "name", "field"], field_tests())


#: Native helper commands of a plugin, whose flags say nothing about the plugin's baseline.
SHIMS = r"^\S+ \S+ (install|uninstall|upgrade)$"


def flag_backfill(old: DataFrame, new: DataFrame, old_commands: DataFrame) -> DataFrame:
    """(path, n): commands without flags before, in a top-level group that had none at all, which have some now [DIFF5]."""
    group = F.get(F.split("path", " "), 1)
    based = old.filter(~F.col("path").rlike(SHIMS)).select(group.alias("g")).filter("g is not null").distinct()
    bare = old_commands.select("path").join(old, "path", "left_anti").withColumn("g", group).filter("g is not null").join(based, "g", "left_anti")
    return new.join(bare.select("path"), "path").groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def compare_flags(old: DataFrame, new: DataFrame, old_commands: DataFrame, new_commands: DataFrame) -> DataFrame:
    """DIFF3, DIFF4 over flags (path, flag, type, default_json, description, required) of commands in both trees."""
    common = old_commands.select("path").join(new_commands.select("path"), "path", "left_semi")
    back = flag_backfill(old, new, old_commands)
    d = full_outer(old.join(common, "path", "left_semi"), new.join(common, "path", "left_semi"), ["path", "flag"]).join(back.select("path", F.lit(1).alias("__b")), "path", "left")
    o, n = F.col("o"), F.col("n")
    both = o.isNotNull() & n.isNotNull()
    tests = [("newFlags", o.isNull() & F.col("__b").isNull(), None, n["type"]), ("removedFlags", n.isNull(), o["type"], None), ("changedDefaults", both & ~json_equal(o["default_json"], n["default_json"]), o["default_json"], n["default_json"])]
    tests += [(f"changedFlag{w}", both & ~o[c].eqNullSafe(n[c]), o[c], n[c]) for w, c in (("Types", "type"), ("Requirements", "required"), ("Descriptions", "description"))]
    backfilled = back.select("path", F.lit(None).cast("string").alias("flag"), F.lit("flagDataBackfilled").alias("change"), F.lit(None).cast("string").alias("old"), F.col("n").cast("string").alias("new"))
    return changes(d, ["path", "flag"], tests).unionByName(backfilled)


def compare_commands(old: DataFrame, new: DataFrame, newly_deprecated: DataFrame) -> DataFrame:
    """DIFF3 over commands (path, description): new, removed, changed descriptions, and deprecations.

    Deprecated commands under a deprecated one, and commands that vanished under one, count as its subcommands and not by themselves [J27]."""
    d = full_outer(old, new, ["path"])
    o, n = F.col("o"), F.col("n")
    tests = [("newCommands", o.isNull(), None, n["description"]), ("removedCommands", n.isNull(), o["description"], None), ("descriptionChanges", o.isNotNull() & n.isNotNull() & ~o["description"].eqNullSafe(n["description"]), o["description"], n["description"])]
    found = changes(d, ["path"], tests)
    top = prefix_join(newly_deprecated.select("path"), newly_deprecated.select(F.col("path").alias("root")), "path", "root", longest=False)
    gone = prefix_join(found.filter("change = 'removedCommands'").select("path"), newly_deprecated.select(F.col("path").alias("root")), "path", "root", longest=False)
    under = top.unionByName(gone).filter("path != root").groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("path")), ", ").alias("subs"))
    roots = top.filter("path = root").select(F.col("path").alias("root")).join(under, "root", "left").select(F.col("root").alias("path"), F.lit("deprecatedCommands").alias("change"), F.lit(None).cast("string").alias("old"), F.col("subs").alias("new"))
    kept = found.join(gone.select("path", F.lit("removedCommands").alias("change")), ["path", "change"], "left_anti")
    return kept.unionByName(roots)


def compare_names(old: DataFrame, new: DataFrame, name: str, what: str) -> DataFrame:
    """New, removed and newly deprecated names, such as functions and methods [DIFF2, SET1]. Columns name, status."""
    d = full_outer(old, new, [name])
    o, n = F.col("o"), F.col("n")
    low = lambda s: F.lower(F.coalesce(s["status"], F.lit("")))
    return changes(d, [name], [(f"new{what}", o.isNull(), None, None), (f"removed{what}", n.isNull(), None, None), (f"deprecated{what}", o.isNotNull() & n.isNotNull() & (low(o) != "deprecated") & (low(n) == "deprecated"), None, None)])


def compare_files(old: DataFrame, new: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, change): added, removed, changed by digest [DIFF7]."""
    side = lambda df: df.select(path, F.sha2(F.col(content).cast("binary"), 256).alias("digest"))
    d = full_outer(side(old), side(new), [path])
    o, n = F.col("o"), F.col("n")
    return changes(d, [path], [("added", o.isNull(), None, None), ("removed", n.isNull(), None, None), ("changed", o["digest"] != n["digest"], None, None)]).select(path, "change")


def summary(df: DataFrame, names: list[str], change: str = "change") -> DataFrame:
    """One row of counts [AGG11, D8]."""
    return df.agg(*(F.count_if(F.col(change) == n).alias(n) for n in names))


def baseline(snapshot: DataFrame | None, rebuild, regenerate: bool = False) -> DataFrame:
    """The committed snapshot unless there is none or it is to be made anew [DIFF9]."""
    return rebuild() if snapshot is None or regenerate else snapshot


def changed(old: C, new: C) -> Column:
    return ~col(old).eqNullSafe(col(new))
