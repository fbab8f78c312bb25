"""Chains of snapshots: all steps from one release to the next out of one sort of the rows by key and release."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import diffs


def numbered_releases(snapshots: DataFrame, release: str = "release") -> DataFrame:
    """(release, step): the releases in order, numbered from 1. There is a row for each release, so the one task that numbers them has little to do."""
    return snapshots.select(release).distinct().withColumn("step", F.row_number().over(Window.orderBy(release)))


def intervals(snapshots: DataFrame, keys: list[str], values: list[str], release: str = "release") -> DataFrame:
    """(keys, values, first, last): the releases from and to which a key had its values without a break [DIFF10]; a key has no two rows in one release."""
    rows = snapshots.join(numbered_releases(snapshots, release), release).select(*keys, *values, "step", release)
    order = Window.partitionBy(*keys).orderBy("step")
    goes_on = F.lag("step").over(order).eqNullSafe(F.col("step") - 1)
    for v in values:
        goes_on = goes_on & F.lag(v).over(order).eqNullSafe(F.col(v))
    runs = rows.withColumn("__new", (~goes_on).cast("int")).withColumn("__run", F.sum("__new").over(order))
    picked = [F.min_by(v, "step").alias(v) for v in values]
    return runs.groupBy(*keys, "__run").agg(*picked, F.min_by(release, "step").alias("first"), F.max_by(release, "step").alias("last")).drop("__run")


def steps(snapshots: DataFrame, keys: list[str], release: str = "release") -> DataFrame:
    """(release, keys, o, n): for each release but the first the full outer join with the one before, as diffs.full_outer makes of two [DIFF10].

    A row is the new side of its own release, beside the key's row of the release before if there is one; where the next release lacks the
    key, it is the old side there. So each row is sorted once and gives at most two."""
    releases = numbered_releases(snapshots, release).withColumnRenamed(release, "__release")
    body = F.struct(*(c for c in snapshots.columns if c not in [*keys, release]), F.lit(1).alias("__here"))
    rows = snapshots.withColumnRenamed(release, "__release").join(releases, "__release").select(*keys, "step", body.alias("__body"))
    order = Window.partitionBy(*keys).orderBy("step")
    near = rows.withColumns({"__before": F.when(F.lag("step").over(order) == F.col("step") - 1, F.lag("__body").over(order)), "__stays": F.lead("step").over(order).eqNullSafe(F.col("step") + 1)})
    none = F.lit(None).cast(near.schema["__body"].dataType)
    side = lambda at, o, n: F.struct(at.alias("at"), o.alias("o"), n.alias("n"))
    own = F.when(F.col("step") > 1, side(F.col("step"), F.col("__before"), F.col("__body")))
    gone = F.when(~F.col("__stays"), side(F.col("step") + 1, F.col("__body"), none))
    both = near.select(*keys, F.explode(F.array_compact(F.array(own, gone))).alias("__s")).select(*keys, "__s.*")
    # the step after the last release does not exist, so the join ends it
    return both.join(releases.select(F.col("step").alias("at"), F.col("__release").alias(release)), "at").drop("at")


def chain_components(components: DataFrame, release: str = "release") -> DataFrame:
    """diffs.compare_components() of each release with the one before (release, type, name, status, requires_cgo, cloud_supported, cloud_only) [DIFF10]."""
    return diffs.changes(steps(components, ["type", "name"], release), [release, "type", "name"], diffs.component_tests())


def chain_fields(fields: DataFrame, components: DataFrame, release: str = "release") -> DataFrame:
    """diffs.compare_fields() of each release with the one before (release, type, name, field, default_json, status, is_deprecated): of components in both releases only [DIFF10]."""
    both = steps(components, ["type", "name"], release).filter("o is not null and n is not null").select(release, "type", "name")
    found = diffs.changes(steps(fields, ["type", "name", "field"], release), [release, "type", "name", "field"], diffs.field_tests())
    return found.join(both, [release, "type", "name"], "left_semi")
