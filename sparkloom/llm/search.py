"""Ranked lexical search with variable blocks of postings whose bounds let a search skip them (block-max WAND), exact for every query.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters, only A-Z lower-cased. With N documents that have a term, L
terms in all, n of one document, df documents that hold a term and tf occurrences in a document, a term weighs
floor(1000 ln((2N + 2) / (2df + 1))), a document has m = 25 + (75 n N) div L, and its score is the sum over the query's terms, repeats
included, of weight * ((10^9 tf) div (1000 tf + 8 m)), in whole numbers.

Index: tasks read whole texts and write shards, each a row with at most DOCS documents or about POSTINGS postings, sorted by term and
document. Where the queries are known, a bit map of BITS hashes of their terms (its size is fixed; a false hit only costs room) leaves
out what no query asks for. N, L and df are sums over the shards.

Blocks: a posting list is cut where a dynamic program says, which minimises the bounds' total error (a block's length times its highest
impact, less the impacts) plus a charge for each block, such that blocks have about AVERAGE postings. It runs over cells of CELL
postings, at most WINDOW cells for a block, and over all lists of a shard at once.

Search: in each shard, for each query, the bounds of the blocks over each document are added up. Documents with the highest sums are
scored first, which sets the threshold; of the rest only those whose bound reaches it stay, and only blocks that hold such a document are
opened. A task keeps the best k of each query over all of its shards, so later shards start from a high threshold. Queries travel to
tasks in blocks of at most ENTRIES terms; more of them take more passes over the shards, none over the texts.

Defined cases: null text has no terms; a query without terms, or whose terms no document holds, has no rows; equal scores go by ascending
document id, null last; each row is a document and each item row a query, so repeated ones appear repeatedly; empty tables give empty
results; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import terms
from .common import Scratch, ship

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOCS, POSTINGS = 1 << 14, 1 << 20
#: Spark's bit maps have 32,768 bits; so many of them.
BITMAP, BITMAPS = 1 << 15, 1 << 7
BITS = BITMAP * BITMAPS
CELL, WINDOW, AVERAGE = 8, 32, 40
ENTRIES = 1 << 18
#: Documents scored before a threshold is set.
FIRST = 64

SHARD = "doc_ids array<long>, sizes array<long>, terms array<string>, dfs array<long>, ords array<int>, tfs array<int>, n_docs long, n_terms long"


def query_terms(items: DataFrame) -> DataFrame:
    """(query, item_id, term, often) of items (item_id, text), a query for each row."""
    found = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(TERM), F.lit(0))
    rows = items.select(F.monotonically_increasing_id().alias("query"), F.col("item_id").cast("long").alias("item_id"), "text")
    rows = rows.select("query", "item_id", F.explode(found).alias("term"))
    return rows.groupBy("query", "item_id", "term").agg(F.count("*").alias("often"))


def wanted_bits(queries: DataFrame) -> np.ndarray:
    """A bit for each hash of a term; BITS / 8 bytes whatever the queries."""
    place = F.pmod(F.xxhash64("term"), F.lit(BITS))
    rows = queries.groupBy((F.floor(place / BITMAP)).cast("int").alias("k")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(BITMAP))).alias("bits")).collect()
    out = np.zeros(BITS, bool)
    for r in rows:
        out[r["k"] * BITMAP : (r["k"] + 1) * BITMAP] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
    return out


class _Shard:
    """Documents and postings gathered by a task."""

    def __init__(self):
        self.ids, self.sizes, self.index = [], [], {}
        self.parts, self.held, self.docs, self.n_docs, self.n_terms = [], 0, 0, 0, 0

    def add(self, ids: pa.Array, m: terms.Counts, bits: np.ndarray | None) -> None:
        rows = len(m.indptr) - 1
        row = m.row
        size = np.bincount(row, m.count, rows).astype(np.int64)
        self.n_docs += int((size > 0).sum())
        self.n_terms += int(size.sum())
        if bits is None:
            kept = np.ones(len(m.terms), bool)
        else:
            kept = bits[np.array([xxhash.xxh64_intdigest(t, terms.SEED) for t in m.terms], np.uint64) % np.uint64(BITS)] if m.terms else np.zeros(0, bool)
        number = np.zeros(len(m.terms), np.int64)
        for k in np.flatnonzero(kept).tolist():
            number[k] = self.index.setdefault(m.terms[k], len(self.index))
        some = kept[m.term]
        row, term, count = row[some], number[m.term[some]], m.count[some]
        here, at = np.unique(row, return_inverse=True)
        self.parts.append((term, at + self.docs, count))
        self.ids.append(ids.take(pa.array(here + m.first)))
        self.sizes.append(size[here])
        self.docs += len(here)
        self.held += len(term)

    def row(self) -> pa.RecordBatch:
        words = sorted(self.index)
        order = np.empty(len(words), np.int64)
        order[[self.index[w] for w in words]] = np.arange(len(words))
        term, doc, count = (np.concatenate([p[i] for p in self.parts]) if self.parts else np.empty(0, np.int64) for i in range(3))
        term = order[term] if len(term) else term
        by = np.lexsort((doc, term))
        many = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))
        ids = pa.concat_arrays(self.ids) if self.ids else pa.array([], pa.int64())
        columns = [
            many(ids, None), many(np.concatenate([*self.sizes, np.empty(0, np.int64)]), pa.int64()), many(pa.array(words, pa.binary()).cast(pa.string()), None),
            many(np.bincount(term, minlength=len(words)), pa.int64()), many(doc[by].astype(np.int32), pa.int32()), many(count[by].astype(np.int32), pa.int32()),
            pa.array([self.n_docs], pa.int64()), pa.array([self.n_terms], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_ids", "sizes", "terms", "dfs", "ords", "tfs", "n_docs", "n_terms"])


def _indexed(bits_ref):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bits_ref is None else np.unpackbits(np.frombuffer(bits_ref.value, np.uint8)).astype(bool)
        shard = _Shard()
        for b in batches:
            for m in terms.counted(b.column("text"), terms.WORDS):
                shard.add(b.column("doc_id"), m, bits)
                if shard.docs >= DOCS or shard.held >= POSTINGS:
                    yield shard.row()
                    shard = _Shard()
        if shard.n_docs:
            yield shard.row()

    return run


def index(docs: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Shards of docs (doc_id, text). With query_terms() output only postings that these may ask for, without it all."""
    spark = docs.sparkSession
    ship(spark)
    bits = None if queries is None else spark.sparkContext.broadcast(np.packbits(wanted_bits(queries)).tobytes())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_indexed(bits), SHARD)


def weigh(queries: DataFrame, shards: DataFrame, n: int) -> DataFrame:
    """query_terms() output with each term's weight; terms that no document holds go."""
    df = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1).cast("double")))
    return queries.join(df, "term").select("query", "item_id", "term", (F.col("often") * weight).cast("long").alias("weight"))


def cut(impact: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Starts of blocks, of all lists in order; starts: those of the lists, which are not empty."""
    sizes = np.diff(starts, append=len(impact))
    cells = -(-sizes // CELL)
    borders = [starts[cells == 1]]
    many = np.flatnonzero(cells > 1)
    if not len(many):
        return np.sort(np.concatenate(borders))
    many = many[np.argsort(-cells[many], kind="stable")]
    cells, sizes = cells[many], sizes[many]
    total = int(cells.sum())
    first = np.cumsum(cells) - cells  # of each list, among all cells
    owner = np.repeat(np.arange(len(many)), cells)
    nth = np.arange(total) - first[owner]
    cell_at = starts[many][owner] + nth * CELL
    size = np.minimum(CELL, sizes[owner] - nth * CELL)
    flat = np.repeat(cell_at - (np.cumsum(size) - size), size) + np.arange(size.sum())
    values = impact[flat]
    at = np.cumsum(size) - size
    high, summed = np.maximum.reduceat(values, at), np.add.reduceat(values, at)
    whole = np.maximum.reduceat(high, first) * sizes - np.add.reduceat(summed, first)
    charge = whole * AVERAGE // sizes
    # of the blocks that end with the cell looked at, by their number of cells: highest impact, error so far, best of what lies before
    shape = (len(many), WINDOW)
    top, number, mass, before = (np.zeros(shape, np.int64) for _ in range(4))
    before[:, 1:] = np.iinfo(np.int64).max // 4
    taken = np.empty(total, np.int64)
    for j in range(int(cells[0])):
        n = int(np.searchsorted(-cells, -j, "left"))  # lists with more than j cells
        here = first[:n] + j
        for x, new in ((number, size), (mass, summed)):
            x[:n, 1:] = x[:n, :-1]
            x[:n, 0] = 0
            x[:n] += new[here][:, None]
        top[:n, 1:] = top[:n, :-1]
        top[:n, 0] = 0
        np.maximum(top[:n], high[here][:, None], out=top[:n])
        cost = before[:n] + top[:n] * number[:n] - mass[:n]
        best = cost.argmin(1)
        taken[here] = best + 1
        before[:n, 1:] = before[:n, :-1]
        before[:n, 0] = cost[np.arange(n), best] + charge[:n]
    end, lists = cells.copy(), np.arange(len(many))
    while len(lists):
        end[lists] -= taken[first[lists] + end[lists] - 1]
        borders.append(starts[many[lists]] + end[lists] * CELL)
        lists = lists[end[lists] > 0]
    return np.sort(np.concatenate(borders))


@dataclass
class Postings:
    """A shard ready to be searched: lists by term, and blocks with their first and last document and highest impact."""

    ids: pa.Array
    index: dict[str, int]
    docs: int
    doc: np.ndarray
    impact: np.ndarray
    block: np.ndarray
    of_term: np.ndarray
    low: np.ndarray
    high: np.ndarray
    most: np.ndarray
    opened: int = 0


def prepare(row: dict, n: int, total: int) -> Postings:
    doc, tf, dfs = row["ords"].astype(np.int64), row["tfs"].astype(np.int64), row["dfs"]
    m = np.array([25 + 75 * x * n // total for x in row["sizes"].tolist()], np.int64)  # whole numbers of any size
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
    starts = np.cumsum(dfs) - dfs
    block = cut(impact, starts) if len(impact) else np.empty(0, np.int64)
    last = np.append(block[1:], len(impact)) - 1
    most = np.maximum.reduceat(impact, block) if len(block) else block
    return Postings(row["ids"], {t: k for k, t in enumerate(row["terms"])}, len(m), doc, impact, np.append(block, len(impact)), np.searchsorted(block, np.append(starts, len(impact))), doc[block], doc[last], most)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def search(p: Postings, words: list[str], weights: np.ndarray, k: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard and their scores, among them all of its best k that reach the threshold and score above 0."""
    known = [(p.index[t], w) for t, w in zip(words, weights.tolist(), strict=True) if w > 0 and t in p.index]
    if not known:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    term, weight = np.array(known, np.int64).T
    sizes = p.of_term[term + 1] - p.of_term[term]
    blocks, weight = _ragged(p.of_term[term], sizes), np.repeat(weight, sizes)
    bound = np.zeros(p.docs + 1, np.int64)
    np.add.at(bound, p.low[blocks], weight * p.most[blocks])
    np.add.at(bound, p.high[blocks] + 1, -weight * p.most[blocks])
    bound = np.cumsum(bound)[:-1]
    left = np.flatnonzero(bound >= max(1, threshold))
    docs, scores, ready = [], [], np.empty(0, np.int64)
    while len(left):
        some = left
        if len(left) > 2 * FIRST and len(ready) < k:
            some = left[np.argpartition(-bound[left], FIRST)[:FIRST]]
        found = _scores(p, blocks, weight, some)
        docs.append(some)
        scores.append(found)
        ready = np.sort(np.concatenate([ready, found[found > 0]]))[-k:]
        if some is left:
            break
        if len(ready) == k:
            threshold = max(threshold, int(ready[0]))
        open_ = np.ones(p.docs, bool)
        open_[some] = False
        left = left[open_[left] & (bound[left] >= max(1, threshold))]
    docs, scores = np.concatenate([*docs, np.empty(0, np.int64)]), np.concatenate([*scores, np.empty(0, np.int64)])
    kept = scores >= max(1, threshold)
    return docs[kept], scores[kept]


def _scores(p: Postings, blocks: np.ndarray, weight: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Scores of some documents; blocks that hold none of them stay closed."""
    wanted = np.zeros(p.docs + 1, np.int64)
    wanted[docs + 1] = 1
    before = np.cumsum(wanted)
    hit = before[p.high[blocks] + 1] > before[p.low[blocks]]
    blocks, weight = blocks[hit], weight[hit]
    sizes = p.block[blocks + 1] - p.block[blocks]
    at = _ragged(p.block[blocks], sizes)
    p.opened += len(at)
    doc = p.doc[at]
    some = wanted[doc + 1] > 0
    out = np.zeros(p.docs, np.int64)
    np.add.at(out, doc[some], np.repeat(weight, sizes)[some] * p.impact[at[some]])
    return out[docs]


class _Best:
    """The best k of a query so far."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.none = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def threshold(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: pa.Array) -> None:
        none = np.asarray(ids.is_null())
        score, own, none = np.concatenate([self.score, score]), np.concatenate([self.id, ids.fill_null(0).to_numpy()]), np.concatenate([self.none, none])
        order = np.lexsort((own, none, -score))[: self.k]
        self.score, self.id, self.none = score[order], own[order], none[order]


def _searched(queries_ref, n: int, total: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = queries_ref.value
        best = {q: _Best(k) for q, _, _ in queries}
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].values for c in ("doc_ids", "sizes", "terms", "dfs", "ords", "tfs")}
                p = prepare({"ids": row["doc_ids"], "terms": row["terms"].to_pylist()} | {c: row[c].to_numpy() for c in ("sizes", "dfs", "ords", "tfs")}, n, total)
                for q, words, weights in queries:
                    docs, scores = search(p, words, weights, k, best[q].threshold)
                    if len(docs):
                        best[q].add(scores, p.ids.take(pa.array(docs)))
        found = [(q, x) for q, x in best.items() if len(x.score)]
        many = lambda name: np.concatenate([getattr(x, name) for _, x in found]) if found else np.empty(0, np.int64)
        ids = pa.array(many("id"), pa.int64(), mask=many("none").astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([q for q, _ in found], np.int64), [len(x.score) for _, x in found])), ids, pa.array(many("score"))], names=["query", "doc_id", "score"])

    return run


def _blocks(weighed: DataFrame, most: int) -> Iterator[list[tuple[int, list[str], np.ndarray]]]:
    """Queries in blocks of at most so many terms, or one query; the driver holds one block at a time."""
    rows = weighed.groupBy("query").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    block, held = [], 0
    for r in rows.toLocalIterator():
        if block and held + len(r["terms"]) > most:
            yield block
            block, held = [], 0
        block.append((r["query"], [t["term"] for t in r["terms"]], np.array([t["weight"] for t in r["terms"]], np.int64)))
        held += len(r["terms"])
    if block:
        yield block


def rank(docs: DataFrame, items: DataFrame, k: int = 10, entries: int = ENTRIES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of docs (doc_id, text) for each row of items (item_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    queries = scratch.save(query_terms(items), "queries")
    shards = scratch.save(index(docs, queries), "shards")
    sums = shards.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("total")).first()
    n, total = sums["n"] or 0, sums["total"] or 0
    weighed = scratch.save(weigh(queries, shards, n), "weighed")
    scratch.save(spark.createDataFrame([], "query long, doc_id long, score long"), "found/none")
    for i, block in enumerate(_blocks(weighed, entries)):
        ref = spark.sparkContext.broadcast(block)
        scratch.save(shards.mapInArrow(_searched(ref, n, total, k), "query long, doc_id long, score long"), f"found/{i}")
        ref.unpersist()
    found = spark.read.schema("query long, doc_id long, score long").parquet(f"{scratch.path('found')}/*")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return top.join(queries.select("query", "item_id").distinct(), "query").select("item_id", "rank", "doc_id", "score")
