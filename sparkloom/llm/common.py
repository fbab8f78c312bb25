"""What the operators of this package share: scratch tables, row ids, free column names, and how workers find the package."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder as shared_dir
from ..session import ship

#: No join hint but this: texts meet their verdicts by row id in a sort-merge join, at every size.
MERGE = "merge"

__all__ = ["MERGE", "WORD", "Scratch", "barrier", "free", "named", "numbered", "remove", "scratches", "shared_dir", "ship", "tidy"]

#: Words are runs of characters other than the six ASCII white-space characters; bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # a session that has ended cannot delete; its folder is the cluster's to clear
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_open: list[Scratch] = []


class Scratch:
    """Tables written to the shared folder. They cut lineage, survive lost executors, and go when the driver ends or drop() is called."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.dir = spark, f"{shared_dir(spark)}/sparkloom/{tag}-{uuid.uuid4().hex}"
        atexit.register(remove, spark, self.dir)
        _open.append(self)

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))

    def close(self) -> None:
        remove(self.spark, self.dir)


@contextlib.contextmanager
def scratches() -> Iterator[None]:
    """Removes, at its end, the tables of all operators that began inside; what they returned must be written by then."""
    before = len(_open)
    try:
        yield
    finally:
        for s in _open[before:]:
            s.close()
        del _open[before:]


#: Shuffle files otherwise stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each job that begins inside go when it ends."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def free(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores as no taken name has; Spark's names are the same in either case."""
    used, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def named(column: str) -> Column:
    """The column of that name, which may hold dots and backticks."""
    return F.col("`" + column.replace("`", "``") + "`")


def numbered(docs: DataFrame, scratch: Scratch, name: str = "__rid") -> tuple[DataFrame, str]:
    """docs with an id for each row that is the same in every job, and the id's column.

    An id counted along a scan depends on how files are split, which changes with the number of executors. A plain scan of files with row
    numbers of their own (Parquet) is numbered by a hash of its file's path and the row's number in it: the low bits hold the largest row
    number, the rest the hash, with the first of SEEDS under which no two files share it, so ids are an expression and nothing is joined.
    Anything else, and a scan for which no seed will do, is written once with its ids beside the rows."""
    (rid,) = free(docs.columns, name)
    if _plain_scan(docs) and (found := _file_seed(docs, scratch)):
        return docs.select(*(named(c) for c in docs.columns), _file_number(*found).alias(rid)), rid
    return scratch.save(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered"), rid


SEEDS = 4


def _file_hash(path: Column, seed: int, width: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), path), F.lit(1 << width))


def _file_number(seed: int, width: int, bits: int) -> Column:
    return F.shiftleft(_file_hash(F.col("_metadata.file_path"), seed, width), bits) + F.col("_metadata.row_index")


def _file_seed(docs: DataFrame, scratch: Scratch) -> tuple[int, int, int] | None:
    """A seed that gives each file a hash of its own, the bits of a hash, and those of a row number. Hashes are no wider than so many files need, so that ids compress well."""
    files = docs.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row")).groupBy("path").agg(F.max("row").alias("most"))
    files = scratch.save(files, "files")
    most, n = files.agg(F.max("most"), F.count("*")).first()
    bits = max(1, (most or 0).bit_length())
    width = min(63 - bits, 2 * n.bit_length() + 6)
    distinct = files.agg(*(F.count_distinct(_file_hash(F.col("path"), s, width)) for s in range(SEEDS))).first()
    return next(((s, width, bits) for s, d in enumerate(distinct) if d == n), None)


def _plain_scan(docs: DataFrame) -> bool:
    if {"_metadata", "row_index_of_file"} & {c.lower() for c in docs.columns}:
        return False
    try:
        plan = docs._jdf.queryExecution().analyzed()
        docs.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018
    except Exception:  # no file source, one without row numbers, or no JVM here
        return False
    return plan.getClass().getSimpleName() == "LogicalRelation"


def barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions read as values: without it the optimizer copies a costly expression into each place that uses it."""
    fields = F.struct(*(c.alias(k) for k, c in columns.items()))
    return df.select("*", F.inline(F.array(fields)))
