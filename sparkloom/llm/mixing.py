"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source should be taken (target / source size) times on average: a whole number of times for sure, and once more
with a fractional probability. Probabilities are rounded in pairs: two open documents of a source exchange expected words, in a random
direction with odds that keep each one's expectation, until one of them is at 0 or 1; the other stays open and meets the next. The sum
of expected words never changes, so a source's taken words differ from its target by less than one document. Pairs are formed within
buckets of a source; each bucket leaves at most one open document, and these are combined in rounds of FAN buckets, as a reduction
tree, until each source has one, which is rounded by itself.

Random numbers come from a hash of the document's place in its source (id and text) and the round, and buckets from a hash of the
same, so reruns agree whatever the partitioning.

Defined cases: null text has size 0 and is taken 0 words; an unnamed (null) source is a source, last in order; sources of no words
have target 0; repeated rows are taken each by its own (equal rows of one bucket are interchangeable); empty tables give empty ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, ship

CAP, FAN, BUCKET_ROWS, CYCLE = 3.0, 64, 1_000, 3
EPS = 1e-9


def weights(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds `weight` to rows (source, source_size): 1, 2, 3, repeating, in order of code points, null last. Places come from a distributed sort and the sizes of its partitions; only these sizes travel to the driver."""
    ordered = scratch.save(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "ordered")
    part, before = F.shiftright("at", 33).cast("int"), [(0, 0)]
    for r in ordered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():
        before.append((r["p"], before[-1][1]) if before[-1][0] != r["p"] else before[-1])
        before.append((r["p"] + 1, before[-1][1] + r["n"]))
    starts = dict(before)
    first = F.element_at(F.create_map(*(F.lit(x) for k, v in starts.items() for x in (k, v))), part)
    return ordered.select("source", "source_size", ((first + F.col("at").bitwiseAND((1 << 33) - 1)) % CYCLE + 1).cast("double").alias("weight"))


def targets(sources: DataFrame, cap: float = CAP) -> DataFrame:
    """Adds `target` to rows (source, source_size, weight): shares of the whole by weight, at most cap times the size, excess reshared by weight.

    The level (words per unit of weight) rises until no source is above its cap; only sums travel to the driver."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") >= cap * F.col("source_size") if level else F.lit(False)
        held, open_weight, n = sources.agg(F.coalesce(F.sum(F.when(over, cap * F.col("source_size"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.count_if(over)).first()
        if n == capped or not open_weight:
            break
        capped, level = n, (total - held) / open_weight
    return sources.withColumn("target", F.when(F.lit(level) * F.col("weight") >= cap * F.col("source_size"), cap * F.col("source_size")).otherwise(F.lit(level) * F.col("weight")).cast("double"))


class Pivot:
    """Rounds open documents of one group as they come; keeps one open."""

    def __init__(self, seed: str):
        self.seed, self.open = seed, None

    def add(self, item: list, out: list) -> None:
        """item: [key, size, p, copies, ...]; decided items go to out."""
        if item[1] == 0 or item[2] <= EPS or item[2] >= 1 - EPS:
            item[3] += item[2] >= 0.5
            out.append(item)
            return
        if self.open is None:
            self.open = item
            return
        a, b = self.open, item
        up = min((1 - a[2]) * a[1], b[2] * b[1])
        down = min(a[2] * a[1], (1 - b[2]) * b[1])
        u = xxhash.xxh64_intdigest(f"{self.seed}:{a[0]}:{b[0]}") / 2**64
        move = up if u < down / (up + down) else -down
        a[2] += move / a[1]
        b[2] -= move / b[1]
        self.open = None
        for x in (a, b):
            if x[2] <= EPS or x[2] >= 1 - EPS:
                x[3] += x[2] >= 0.5
                out.append(x)
            elif self.open is None:
                self.open = x
            else:  # rounding errors left both open by a hair: the later one goes to the nearer side
                x[3] += x[2] >= 0.5
                out.append(x)


COLUMNS = [("rid", pa.int64()), ("source", pa.string()), ("bucket", pa.int64()), ("key", pa.int64()), ("size", pa.int64()), ("p", pa.float64()), ("copies", pa.int64()), ("decided", pa.bool_())]
KIND = "rid long, source string, bucket long, key long, size long, p double, copies long, decided boolean"


def _round(number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pivot = None, None

        def table(rows):
            cols = list(zip(*rows, strict=True)) or [()] * len(COLUMNS)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, COLUMNS, strict=True)], names=[n for n, _ in COLUMNS])

        def row(x, decided):
            return (x[4], group[0], group[1], x[0], x[1], 0.0 if decided else x[2], x[3], decided)

        for b in batches:
            c = {n: b.column(n).to_pylist() for n, _ in COLUMNS}
            rows: list[tuple] = []
            for i in range(b.num_rows):
                g = (c["source"][i], c["bucket"][i])
                if pivot is None or g != group:
                    if pivot is not None and pivot.open:
                        rows.append(row(pivot.open, False))
                    group, pivot = g, Pivot(f"{number}:{g}")
                out: list = []
                pivot.add([c["key"][i], c["size"][i], c["p"][i], c["copies"][i], c["rid"][i]], out)
                rows += [row(x, True) for x in out]
            yield table(rows)
        if pivot is not None and pivot.open:
            yield table([row(pivot.open, False)])

    return run


def sizes(docs: DataFrame, rid: str | None = None) -> DataFrame:
    """(rid, doc_id, source, size, key) of each row; key depends on id and text alone. rid: the column that has the rows' ids, where the caller joins with it."""
    rows = docs.select((F.col(rid) if rid else F.monotonically_increasing_id()).alias("rid"), "doc_id", F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    return rows.select("rid", "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("key"))


def mix(docs: DataFrame, rid: str | None = None, scratch: Scratch | None = None, cap: float = CAP, bucket_rows: int = BUCKET_ROWS, fan: int = FAN) -> DataFrame:
    """(rid, doc_id, size, source_size, target, copies, taken): how often each row of docs is taken."""
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "mix")
    measured = scratch.save(sizes(docs, rid), "sizes")
    per_source = scratch.save(targets(weights(scratch.save(measured.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).drop("n"), "sources"), scratch), cap), "targets")
    buckets = max(1, math.ceil(measured.count() / bucket_rows))
    # the source table is small unless there are very many sources; adaptive execution broadcasts it only below its size limit and splits hot sources else
    t = per_source.select(F.col("source").alias("__s"), "source_size", "target")
    rows = measured.join(t, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate + EPS).cast("long")
    rows = rows.select("*", whole.alias("copies"), F.greatest(F.lit(0.0), rate - whole).alias("p"))
    started = scratch.save(rows, "rates")
    bucket = F.pmod(F.col("key"), F.lit(buckets)).cast("long")
    open_rows = started.select("rid", "source", bucket.alias("bucket"), "key", "size", "p", "copies", F.lit(False).alias("decided"))
    done, number = [], 0
    while True:
        dealt = open_rows.repartition("source", "bucket").sortWithinPartitions("source", "bucket", "size", "key", "rid")
        result = scratch.save(dealt.mapInArrow(_round(number), KIND), f"round{number}")
        done.append(result.filter("decided"))
        rest = result.filter("not decided")
        if buckets == 1:
            break
        # next level of the tree: FAN buckets' open documents meet
        buckets, number = math.ceil(buckets / fan), number + 1
        open_rows = rest.withColumn("bucket", F.floor(F.col("bucket") / fan).cast("long"))
    u = F.pmod(F.xxhash64("key", F.lit("last")), F.lit(1 << 30)) / float(1 << 30)
    last = rest.withColumn("copies", F.col("copies") + F.when(u < F.col("p"), 1).otherwise(0))
    copies = last.select("rid", "copies")
    for d in done:
        copies = copies.unionByName(d.select("rid", "copies"))
    out = started.drop("copies", "p").join(copies, "rid")
    return out.select("rid", "doc_id", "size", F.coalesce("source_size", F.lit(0).cast("long")).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"))
