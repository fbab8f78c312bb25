"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item of 30 shingles in a document of 20,000 has a Jaccard similarity of 0.001 with it, which no sketch of usable size finds. So
items are partitioned by size, Q = 16, 32, 64, ... shingles, and for each partition every document, whole, is cut into windows of 2 Q
shingles that start every Q, so an item's passage lies in one of them and has a similarity of at least 0.8 (Q / 2) / (2.1 Q) = 0.19 with
it. Windows and items are compared by ROWS MinHash values, any one equal being enough: the partition's longest odds of a miss are
0.81^ROWS = 4e-5. Items of at most SMALL = 8 shingles are too small for the least partition's bound; they are found by any of
their shingles, exactly. The windows' minima are put together from those of blocks of 16 shingles, so all partitions cost one pass. Each found
(document, item) is then verified on the whole document: the share of the item's distinct shingles that the document has, at least 0.8.

What is searched are passages: an item is found for sure only where one window holds enough of it. An item whose shingles lie scattered
over a document, so that no window of 2 Q has a share of them worth a MinHash match, may be missed although the whole document has 0.8
of them; the chance of a find falls with the share in the best window.

The items' signatures and shingles travel to the tasks, BLOCK_SHINGLES at most at a time; a larger benchmark is taken in several passes
over the documents, and its items pass the driver one block at a time. Nothing is shuffled.

Words are compared in lower case and without ASCII punctuation at their ends; five words make a shingle. An item of one to four words is
one shingle of that many words, and is found wherever these stand next to each other, in a text of any length.

Defined cases: a null text or item, or one without words, has no shingles and matches nothing; repeated items and rows give repeated
results; other columns are ignored; empty tables give empty results; ids may be null. Texts of any length are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import ship
from .shingles import WIDTH, chunks, grams, shingles, words

CONTAINMENT, ROWS, UNIT, BLOCK_SHINGLES = 0.8, 48, 16, 1 << 20
SMALL = UNIT // 2  # items of so many shingles at most are looked up, not sketched
MULTIPLIERS = np.array([xxhash.xxh64_intdigest(b"window", j) | 1 for j in range(ROWS)], np.uint64)

@dataclass
class Items:
    ids: list
    sets: list[np.ndarray]
    partitions: dict[int, list[tuple[np.ndarray, np.ndarray]]]  # Q -> for each hash function the sorted minima of its items, and their numbers
    small: tuple[np.ndarray, np.ndarray]  # sorted shingles of the items of at most SMALL, and the items' numbers
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # words of items of fewer than WIDTH -> the same for these


def index(items: list[tuple[object, str | None]]) -> Items:
    hashed, at = words([(t or "").encode() for _, t in items], normal=True)
    tokens, offsets = shingles(hashed, at)
    sets = [np.unique(tokens[a:z]) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    n_words = np.diff(at)
    by_size: dict[int, list[int]] = {}
    for k, s in enumerate(sets):
        if len(s) > SMALL and n_words[k] >= WIDTH:
            by_size.setdefault(max(UNIT, 1 << (len(s) - 1).bit_length()), []).append(k)
    partitions = {}
    for q, members in by_size.items():
        minima = np.array([[(sets[k] * m).min() for m in MULTIPLIERS] for k in members], np.uint64)
        partitions[q] = [(np.sort(minima[:, j]), np.array(members)[np.argsort(minima[:, j], kind="stable")]) for j in range(ROWS)]
    short = {w: _sorted(sets, np.flatnonzero(n_words == w)) for w in range(1, WIDTH) if (n_words == w).any()}
    return Items([i for i, _ in items], sets, partitions, _sorted(sets, [k for k, s in enumerate(sets) if n_words[k] >= WIDTH and len(s) <= SMALL]), short)


def _sorted(sets: list[np.ndarray], members) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of these items in order, and the item of each."""
    tokens = np.concatenate([sets[k] for k in members]) if len(members) else np.empty(0, np.uint64)
    order = np.argsort(tokens, kind="stable")
    return tokens[order], np.repeat(np.array(members, np.int64), [len(sets[k]) for k in members])[order]


def _lookup(keys: np.ndarray, members: np.ndarray, tokens: np.ndarray, owner: np.ndarray) -> set[tuple[int, int]]:
    """(text number, item number) of all items of which the text has a shingle."""
    if not len(keys) or not len(tokens):
        return set()
    low = np.searchsorted(keys, tokens)
    hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == tokens)
    # a text has each shingle once here, however often it says it
    seen = np.unique(np.stack([owner[hit], low[hit]], 1), axis=0)
    often = np.searchsorted(keys, keys[seen[:, 1]], "right") - seen[:, 1]
    at = np.repeat(seen[:, 1], often) + np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often)
    return set(zip(np.repeat(seen[:, 0], often).tolist(), members[at].tolist(), strict=True))


def found_in(items: Items, texts: list[bytes]) -> dict[int, list[tuple[int, float]]]:
    """Text number -> (item number, containment)."""
    hashed, at = words(texts, normal=True)
    out = _found(items, *shingles(hashed, at))
    for width, (keys, members) in items.short.items():
        tokens = grams(hashed, width)
        owner = np.searchsorted(at, np.arange(len(tokens)), "right") - 1
        whole = np.arange(len(tokens)) + width <= at[owner + 1]
        for t, k in sorted(_lookup(keys, members, tokens[whole], owner[whole])):
            out.setdefault(t, []).append((k, 1.0))
    return out


def _found(items: Items, tokens: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, float]]]:
    """The items of at least WIDTH words, for texts given as consecutive shingles."""
    lengths = np.diff(offsets)
    blocks = -(-lengths // UNIT)
    first = np.zeros(len(blocks) + 1, np.int64)
    np.cumsum(blocks, out=first[1:])
    if not first[-1]:
        return {}
    owner = np.repeat(np.arange(len(blocks)), blocks)
    within = np.arange(first[-1]) - first[owner]
    starts = offsets[owner] + within * UNIT
    # super-blocks of Q shingles, by partition: where they start among the blocks, and whether the next one is of the same text
    shapes = {}
    for q in items.partitions:
        s = np.flatnonzero(within % (q // UNIT) == 0)
        shapes[q] = (s, owner[s], np.append(owner[s][1:] == owner[s][:-1], False))
    pairs = _lookup(*items.small, tokens, np.repeat(np.arange(len(lengths)), lengths))
    buffer = np.empty_like(tokens)
    for j in range(ROWS if items.partitions else 0):
        least = np.minimum.reduceat(np.multiply(tokens, MULTIPLIERS[j], out=buffer), starts)
        for q, parts in items.partitions.items():
            s, who, more = shapes[q]
            part = np.minimum.reduceat(least, s) if q > UNIT else least
            # a window of two super-blocks has the lesser of their minima, and whatever is least in it is least in its super-block
            window = part.copy()
            window[:-1] = np.where(more[:-1], np.minimum(part[:-1], part[1:]), part[:-1])
            keys, members = parts[j]
            at = np.searchsorted(keys, window)
            hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == window)
            for h in hit.tolist():
                k = int(at[h])
                while k < len(keys) and keys[k] == window[h]:
                    pairs.add((int(who[h]), int(members[k])))
                    k += 1
    out: dict[int, list[tuple[int, float]]] = {}
    last, have = -1, None
    for t, k in sorted(pairs):
        if t != last:
            last, have = t, np.unique(tokens[offsets[t] : offsets[t + 1]])
        want = items.sets[k]
        place = np.minimum(np.searchsorted(have, want), len(have) - 1)
        share = float((have[place] == want).mean())
        if share >= CONTAINMENT:
            out.setdefault(t, []).append((k, share))
    return out


def _blocks(benchmark: DataFrame):
    """Items in blocks of at most about BLOCK_SHINGLES words (or one item), streamed to the driver one block at a time."""
    block, held = [], 0
    for r in benchmark.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        n = len((r["text"] or "").split())
        if block and held + n > BLOCK_SHINGLES:
            yield block
            block, held = [], 0
        block.append((r["item_id"], r["text"]))
        held += n
    if block:
        yield block


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, containment, n_shingles) of all items that a document contains to at least 0.8."""
    spark, out = docs.sparkSession, None
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    schema = "doc_id long, item_id long, containment double, n_shingles long"
    for block in _blocks(benchmark):
        ref = spark.sparkContext.broadcast(index(block))

        def run(batches: Iterator[pa.RecordBatch], ref=ref) -> Iterator[pa.RecordBatch]:
            items = ref.value
            for b in batches:
                got: list[tuple] = []
                for piece, texts in chunks(b, "text"):
                    ids = piece.column("doc_id").to_pylist()
                    for t, found in found_in(items, texts).items():
                        got += [(ids[t], items.ids[k], share, len(items.sets[k])) for k, share in found]
                cols = list(zip(*got, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "containment", "n_shingles"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that contain an item; only the text goes to Python, and other columns stay as they are."""
    ship(docs.sparkSession)
    for block in _blocks(benchmark):
        ref = docs.sparkSession.sparkContext.broadcast(index(block))

        def hit(series: Iterator, ref=ref) -> Iterator:
            import pandas as pd

            items = ref.value
            for s in series:
                out = np.zeros(len(s), bool)
                texts = [(x or "").encode() for x in s]
                at = 0
                while at < len(texts):
                    to, size = at, 0
                    while to < len(texts) and (to == at or size + len(texts[to]) <= 1 << 20):
                        size += len(texts[to])
                        to += 1
                    for t in found_in(items, texts[at:to]):
                        out[at + t] = True
                    at = to
                yield pd.Series(out)

        # annotations are strings here, so the kind of function is named
        from pyspark.sql.functions import PandasUDFType, pandas_udf

        udf = pandas_udf(hit, BooleanType(), PandasUDFType.SCALAR_ITER)
        docs = docs.filter(~F.coalesce(udf(F.col("text").cast("string")), F.lit(False)))
    return docs
