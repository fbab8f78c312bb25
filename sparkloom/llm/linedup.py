"""Line de-duplication by distributed prefix doubling over line ids: the rank classes that a suffix array's intervals have, up to the length needed.

The texts are sequences of lines (lines without a word are left out). Level 0 ranks the repeated lines by their 128-bit digest; level
k + 1 sorts the pairs (rank of the first 2^k lines, rank of the next 2^k) and ranks those that occur more than once, so rank classes of
level k are the intervals of the suffix array whose common prefix is at least 2^k lines, in the array's order. Suffixes whose prefix
occurs once leave the work at once, which on real text leaves few rows after level 0. Ranks come from a distributed sort.

A run of lines is a repeat if it has at least MIN_WORDS words and occurs more than once. Every maximal repeated run is the union of
runs that reach MIN_WORDS just with their last line (going forward) or just with their first (going backward); such a run of m lines is
the interval of common prefix m, named by the ranks of the two overlapping 2^k-line pieces that cover it. So only log2(MIN_WORDS) levels
are ever needed, since a line kept has a word, and neither the full order of suffixes nor their whole common-prefix lengths are built; the
deletions are the same (tests hold them against all runs by brute force). In each such interval the first occurrence (by doc_id, row,
line) stays; the lines of later ones are deleted. Repeated runs of fewer words stay; min_words is a parameter of each function.

Defined cases: null text has no lines; blank lines are neither counted nor deleted; rows with a null doc_id come first in order;
repeated rows are documents of their own, so all but the first lose their lines; equal runs that overlap inside a text count as later
copies from the second place on; a document that loses all its words is dropped by drop_repeats; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MERGE, WORD, Scratch, free, named, numbered, ship
from .shingles import chunks

MIN_WORDS = 50

LINES = "rid long, doc_id long, idx int, pos int, hi long, lo long, forward int, backward int"


def line_rows(text: bytes, min_words: int) -> tuple[list[int], list[bytes], np.ndarray, np.ndarray]:
    """(line number, digest, lines of the shortest forward run, of the shortest backward run; 0: none) of each line with a word."""
    pos, digests, words = [], [], []
    for i, line in enumerate(text.split(b"\n")):
        n = len(line.split())
        if n:
            pos.append(i)
            digests.append(xxhash.xxh3_128_digest(line))
            words.append(n)
    total = np.zeros(len(words) + 1, np.int64)
    np.cumsum(words, out=total[1:])
    at = np.arange(len(words))
    end = np.searchsorted(total, total[:-1] + min_words, "left")
    begin = np.searchsorted(total, total[1:] - min_words, "right") - 1
    return pos, digests, np.where(end < len(total), end - at, 0), np.where(begin >= 0, at + 1 - begin, 0)


def _lines(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, texts in chunks(b, "text"):
                rid, doc = piece.column("rid").to_pylist(), piece.column("doc_id").to_pylist()
                parts = [line_rows(t, min_words) for t in texts]
                n = [len(p[0]) for p in parts]
                keys = np.frombuffer(b"".join(d for p in parts for d in p[1]), np.int64).reshape(-1, 2)
                cat = lambda k: np.concatenate([p[k] for p in parts]).astype(np.int32) if parts else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, k in zip(rid, n, strict=True) for _ in range(k)], pa.int64()), pa.array([r for r, k in zip(doc, n, strict=True) for _ in range(k)], pa.int64()), pa.array([i for k in n for i in range(k)], pa.int32()), pa.array([i for p in parts for i in p[0]], pa.int32()), pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1])), pa.array(cat(2)), pa.array(cat(3))],
                    names=["rid", "doc_id", "idx", "pos", "hi", "lo", "forward", "backward"],
                )

    return run


def _ranked(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Ranks (a, b) of the pairs that occur more than once, in sorted order. The count is aggregated before the shuffle; ids grow along the sort."""
    repeated = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(a, b)
    return repeated.orderBy(a, b).select(a, b, F.monotonically_increasing_id().alias("rank"))


def find_repeats(rows: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """(rid, doc_id, idx, pos, first_doc_id): the lines to delete from rows (rid, doc_id, text)."""
    ship(rows.sparkSession)
    lines = scratch.save(rows.mapInArrow(_lines(min_words), LINES), "lines")
    first = scratch.save(_ranked(lines, "hi", "lo"), "ranks0")
    level = scratch.save(lines.join(first, ["hi", "lo"]).select("rid", "doc_id", "idx", "pos", "forward", "backward", "rank"), "level0")
    windows = scratch.save(
        level.select("rid", "doc_id", F.explode(F.array(F.struct(F.col("idx").alias("start"), F.col("forward").alias("m")), F.struct((F.col("idx") + 1 - F.col("backward")).alias("start"), F.col("backward").alias("m")))).alias("w"))
        .select("rid", "doc_id", "w.start", "w.m").filter("m > 0").distinct()
        .withColumn("k", F.floor(F.log2(F.col("m") + F.lit(0.5))).cast("int")), "windows",
    )
    longest = windows.agg(F.max("k")).first()[0]
    levels, found = [level.select("rid", "idx", "rank", F.lit(0).alias("k"))], [level]
    for k in range(longest or 0):
        h = 1 << k
        nxt = found[-1].select("rid", (F.col("idx") - h).alias("idx"), F.col("rank").alias("rank2"))
        pairs = scratch.save(found[-1].select("rid", "idx", F.col("rank").alias("rank1")).join(nxt, ["rid", "idx"]), f"pairs{k}")
        ranks = scratch.save(_ranked(pairs, "rank1", "rank2"), f"ranks{k + 1}")
        found.append(scratch.save(pairs.join(ranks, ["rank1", "rank2"]).select("rid", "idx", "rank"), f"level{k + 1}"))
        levels.append(found[-1].select("rid", "idx", "rank", F.lit(k + 1).alias("k")))
        scratch.drop(f"pairs{k}", f"ranks{k + 1}")
    table = levels[0]
    for x in levels[1:]:
        table = table.unionByName(x)
    head = table.select("rid", "k", F.col("idx").alias("start"), F.col("rank").alias("head"))
    tail = table.select("rid", "k", F.col("idx").alias("last"), F.col("rank").alias("tail"))
    named = windows.withColumn("last", F.col("start") + F.col("m") - F.expr("shiftleft(1, k)")).join(head, ["rid", "k", "start"]).join(tail, ["rid", "k", "last"])
    named = scratch.save(named.select("rid", "doc_id", "start", "m", "head", "tail"), "named")
    place = F.struct("doc_id", "rid", "start")
    # a table of its own, so that the join has a plain exchange on either side and adaptive execution can split a hot interval
    intervals = scratch.save(named.groupBy("m", "head", "tail").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "intervals")
    later = named.join(intervals, ["m", "head", "tail"]).filter(~place.eqNullSafe(F.col("first")))
    covered = later.select("rid", F.explode(F.sequence("start", F.col("start") + F.col("m") - 1)).alias("idx"), F.col("first.doc_id").alias("first_doc_id")).groupBy("rid", "idx").agg(F.min("first_doc_id").alias("first_doc_id"))
    return covered.join(level.select("rid", "idx", "doc_id", "pos"), ["rid", "idx"])


def _rows(table: DataFrame, rid: str) -> DataFrame:
    return table.select(F.col(rid).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each document that loses lines: doc_id, n_removed, runs (first and last+1 line number of each stretch), first_doc_ids."""
    scratch = Scratch(docs.sparkSession, "lines")
    found = find_repeats(_rows(*numbered(docs, scratch)), scratch, min_words)
    rows = found.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("idx", "pos"))).alias("p"), F.sort_array(F.collect_set("first_doc_id")).alias("first_doc_ids"))
    breaks = F.expr("filter(sequence(0, size(p) - 1), i -> i = 0 or p[i].idx != p[i - 1].idx + 1)")
    rows = rows.withColumn("b", breaks)
    runs = F.expr("array_join(transform(b, (s, j) -> concat(p[s].pos, ':', p[if(j + 1 < size(b), b[j + 1], size(p)) - 1].pos + 1)), ',')")
    return rows.select("doc_id", F.size("p").cast("long").alias("n_removed"), runs.alias("runs"), "first_doc_ids")


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the later copies of repeated runs; documents that had words and keep none go."""
    scratch, inner = Scratch(docs.sparkSession, "lines"), Scratch(docs.sparkSession, "lines")
    table, rid = numbered(docs, scratch)
    gone, lines = free(table.columns, "__gone", "__lines")
    found = scratch.save(find_repeats(_rows(table, rid), inner, min_words).groupBy(F.col("rid").alias(rid)).agg(F.collect_set("pos").alias(gone)), "gone")
    inner.close()
    joined = table.join(found.hint(MERGE), rid, "left").withColumn(lines, F.when(F.col(gone).isNotNull(), F.split(F.col("text").cast("string"), "\n", -1)))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.col(lines)[i]), "\n"))
    joined = joined.withColumn(lines, text)
    return joined.filter(F.col(gone).isNull() | F.col(lines).rlike(WORD)).select(*(F.col(lines).alias(c) if c == "text" else named(c) for c in docs.columns))
