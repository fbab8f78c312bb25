"""Set operations of the inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import C, col


def minus(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of a that b lacks [SET1, SET7]."""
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti")


def common(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """[SET2]"""
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_semi")


def either(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """[SET3, SET8]"""
    return a.select(*keys).unionByName(b.select(*keys)).distinct()


def merge_by_name(a: C, b: C) -> Column:
    """Arrays of structs with a name: entries of b replace those of a in place, new ones follow [SET4]."""
    x, y = col(a), col(b)
    replaced = F.transform(x, lambda p: F.coalesce(F.get(F.filter(y, lambda q: q["name"] == p["name"]), 0), p))
    return F.concat(replaced, F.filter(y, lambda q: ~F.exists(x, lambda p: p["name"] == q["name"])))


def distinct_rows(df: DataFrame) -> DataFrame:
    """Rows that differ in some value, by their JSON text, as columns may be nested [SET5]."""
    return df.withColumn("__j", F.to_json(F.struct(*df.columns))).dropDuplicates(["__j"]).drop("__j")


def distinct_in_order(c: C) -> Column:
    """[SET6]"""
    return F.array_distinct(col(c))
