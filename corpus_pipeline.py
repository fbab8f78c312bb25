"""A corpus pipeline of five stages over documents: quality rules, line dedup, near-duplicate join, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. The last keeps the
documents that the mix takes at least once, with their size, their source's target and how often they are taken, in columns named
mix_*; where docs have such names, the new ones get more underscores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontam, jaccard, linedup, mixing, quality
from sparkloom.llm.common import MERGE, Scratch, free, numbered, scratches, ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules reject go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents that keep no word."""
    ship(spark)
    return linedup.drop_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    ship(spark)
    return jaccard.keep_representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    ship(spark)
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken; documents taken no time go."""
    ship(spark)
    scratch, inner = Scratch(spark, "mixing"), Scratch(spark, "mixing")
    table, rid = numbered(docs, scratch)
    values = ["size", "source_size", "target", "copies", "taken"]
    names = free(table.columns, *(f"mix_{c}" for c in values))
    taken = mixing.mix(table, rid, inner).filter("copies > 0").select(F.col("rid").alias(rid), *(F.col(c).alias(n) for c, n in zip(values, names, strict=True)))
    taken = scratch.save(taken, "taken")
    inner.close()
    return table.join(taken.hint(MERGE), rid).drop(rid)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: No stage is expressible in SQL as a whole: each depends on learned rules or random rounding. A test holds run() against brute force, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a table in the shared folder, which the next one reads. A stage's other tables go when its result is written."""
    own = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        with scratches():
            docs = own.save(stage(spark, docs, sf_dir), f"{k}_{name}")
        if k:
            own.drop(f"{k - 1}_{STAGES[k - 1][0]}")
    return docs
