"""Audit of how sources of a language diverge in their words.

Terms are maximal runs of ASCII letters and non-ASCII characters, only A-Z lower-cased. Tasks find them in the UTF-8 buffers of their
batches with a byte table, group equal slices by xxhash with every byte verified, and hold a block of documents as a sparse matrix
(rows: documents, columns: terms), whose rows of one (language, source) are added up before anything is sent. Spark adds the blocks'
counts. A language keeps the terms that at least MIN_DOCS of its documents hold, V of them; each group then gives a kept term

    p = 1 + floor(10^9 * (count + 2) / (N + 2 V)),    N: the group's occurrences of kept terms,

the same for the language as a whole, and two shares diverge by floor((p - q)^2 / (p + q)).

Pairs of sources sum this over all V terms, though most counts are 0. With z the share of a count of 0, and d the divergence,

    sum d(p, q) = V d(z, z') + sum over a's terms [d(p, z') - d(z, z')] + sum over b's terms [d(z, q) - d(z, z')]
                + sum over common terms [d(p, q) - d(p, z') - d(z, q) + d(z, z')].

The second and third sum depend on counts alone and are taken over each source's histogram of counts. The last is taken over sparse
matrices (rows: terms, columns: sources) in tasks, blocks of terms at a time, summed with reduceat by pair, so no pair leaves a task
more often than once for each block. All arithmetic is exact: decimals of 38 digits, or 64 bits where a bound is known.

Defined cases: null text, lang and source count as ''; each row is a document, repeated rows too; a group without terms has V zeros;
if V is 0 all pairs have the value 0; a language with one source has no pairs; ties go to the item that is lower in UTF-8; an empty
table gives an empty result; texts of any length are read whole, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import terms
from .common import Scratch, ship

MIN_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
#: Entries of a sparse matrix of terms by sources, and partial sums of pairs, held by a task.
ENTRIES, HELD = 1 << 18, 1 << 20


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the sums of values by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.empty(0, np.int64)
    return keys[at], *(np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, count, docs) of each block; a group's term '' counts its documents."""
    for b in batches:
        pairs = list(zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True))
        index = {p: k for k, p in enumerate(dict.fromkeys(pairs))}
        groups, of = list(index), np.array([index[p] for p in pairs], np.int64)
        for m in terms.counted(b.column("text"), terms.LETTERS, 2 * terms.BLOCK):
            rows = of[m.first : m.first + len(m.indptr) - 1]
            n = max(1, len(m.terms))
            keys, count, docs = _summed(rows[m.row] * n + m.term, m.count, np.ones(len(m.term), np.int64))
            group, term = np.divmod(keys, n)
            here, size = np.unique(rows, return_counts=True)
            words = pa.array([*m.terms, b""], pa.binary()).cast(pa.string())
            at = pa.array(np.concatenate([group, here]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g[0] for g in groups], pa.string()).take(at),
                    pa.array([g[1] for g in groups], pa.string()).take(at),
                    words.take(pa.array(np.concatenate([term, np.full(len(here), len(m.terms))]))),
                    pa.array(np.concatenate([count, np.zeros(len(here), np.int64)])),
                    pa.array(np.concatenate([docs, size])),
                ],
                names=["lang", "source", "term", "count", "docs"],
            )


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) over all documents; term '' holds the documents of a group, with or without terms."""
    ship(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    found = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_counted, "lang string, source string, term string, count long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, v: Column) -> Column:
    wide = lambda c: c.cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(count + 2) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + 2 * v))


def _apart(p: Column, q: Column) -> Column:
    """Shares are at most 10^9 + 1, so the square has 61 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class _Common:
    """Sums over common terms, by pair of sources, of one task."""

    def __init__(self):
        self.ids: dict[tuple[str, str], int] = {}
        self.keys, self.sums, self.held = [], [], 0

    def number(self, lang: list[str], source: list[str]) -> np.ndarray:
        return np.array([self.ids.setdefault(x, len(self.ids)) for x in zip(lang, source, strict=True)], np.int64)

    def add(self, term: np.ndarray, source: np.ndarray, p: np.ndarray, zero: np.ndarray) -> None:
        """Entries of a sparse matrix in order of terms: each entry meets those at a distance of 1, 2, ... in its row."""
        for d in range(1, len(term)):
            a = np.flatnonzero(term[d:] == term[:-d])
            if not len(a):
                break
            b = a + d
            value = _differences(p[a], p[b]) - _differences(p[a], zero[b]) - _differences(zero[a], p[b]) + _differences(zero[a], zero[b])
            low, high = np.minimum(source[a], source[b]), np.maximum(source[a], source[b])
            keys, sums = _summed(low << 32 | high, value)
            self.keys.append(keys)
            self.sums.append(sums)
            self.held += len(keys)
            if self.held > HELD:
                self.compact()

    def compact(self) -> None:
        if self.keys:
            keys, sums = _summed(np.concatenate(self.keys), np.concatenate(self.sums))
            self.keys, self.sums, self.held = [keys], [sums], len(keys)

    def rows(self) -> pa.RecordBatch:
        self.compact()
        keys = self.keys[0] if self.keys else np.empty(0, np.int64)
        names = list(self.ids)
        a, b = [names[k] for k in (keys >> 32).tolist()], [names[k] for k in (keys & 0xFFFFFFFF).tolist()]
        out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in a], pa.string()), pa.array([x[1] for x in a], pa.string()), pa.array([x[1] for x in b], pa.string()), pa.array(self.sums[0] if self.sums else keys, pa.int64())], names=["lang", "source", "item", "value"])
        self.keys, self.sums, self.held = [], [], 0
        return out


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, term, source, p, zero) in order of lang and term."""
    found, left = _Common(), None
    for b in batches:
        part = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
        lang, word = part.column("lang").to_pylist(), part.column("term").to_pylist()
        new = np.array([True, *(x != y or u != v for x, y, u, v in zip(lang, lang[1:], word, word[1:], strict=False))][: len(lang)], bool)
        last = int(np.flatnonzero(new)[-1]) if len(new) else 0  # the last term may go on in the next batch
        found.add(*_entries(found, part.slice(0, last), lang[:last], new[:last]))
        left = part.slice(last).combine_chunks()
        if found.held > HELD // 2:
            yield found.rows()
    if left is not None and left.num_rows:
        n = left.num_rows
        found.add(*_entries(found, left, left.column("lang").to_pylist(), np.arange(n) == 0))
    yield found.rows()


def _entries(found: _Common, part: pa.Table, lang: list[str], new: np.ndarray) -> tuple[np.ndarray, ...]:
    number = lambda c: part.column(c).to_numpy()
    return np.cumsum(new), found.number(lang, part.column("source").to_pylist()), number("p"), number("zero")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has each other source of the language, part `term` the `top` kept terms that the source has in excess of its language."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    counts = scratch.save(term_counts(docs), "counts")
    # a term has at most one row for each source here
    over = Window.partitionBy("lang", "term")
    kept = counts.filter("term <> ''").withColumns({"held": F.sum("docs").over(over), "total": F.sum("count").over(over)}).filter(F.col("held") >= min_docs)
    kept = scratch.save(kept.select("lang", "source", "term", "count", "total"), "kept")
    # sums by source, and by language from those: a language's kept terms are counted at the source of each with the lowest name
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("held"))
    sizes = kept.groupBy("lang", "term").agg(F.max("total").alias("total")).groupBy("lang").agg(F.sum("total").alias("n_lang"), F.count("*").alias("v"))
    groups = counts.filter("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["n", "held", "n_lang", "v"])
    groups = groups.withColumn("zero", F.when(F.col("v") > 0, _share(F.lit(0), F.col("n"), F.col("v"))))
    groups = scratch.save(groups, "groups")
    shares = kept.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("count"), F.col("n"), F.col("v")))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    words = shares.withColumn("q", _share(F.col("total"), F.col("n_lang"), F.col("v"))).filter("p > q")
    words = words.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    words = words.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero_item"))
    base = groups.join(other, "lang").filter("source <> item")
    base = base.select("lang", "source", "item", F.coalesce(F.col("v") * _apart(F.col("zero"), F.col("zero_item")), F.lit(0).cast("long")).alias("value"))
    histogram = kept.groupBy("lang", "source", "count").agg(F.count("*").alias("often")).join(groups, ["lang", "source"]).withColumn("p", _share(F.col("count"), F.col("n"), F.col("v")))
    side = histogram.join(other, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("often") * (_apart(F.col("p"), F.col("zero_item")) - _apart(F.col("zero"), F.col("zero_item")))).alias("value"))
    common = shares.select("lang", "term", "source", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_common, "lang string, source string, item string, value long")
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = base.unionByName(side).unionByName(turned(side)).unionByName(common).unionByName(turned(common)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(best)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.unionByName(words)
