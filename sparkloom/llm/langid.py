"""Language identification by prediction by partial matching (PPM) over bytes.

A context tree of depth ORDER is counted for each language on a bounded, stratified sample of labelled texts and then frozen. A byte
that was seen in its longest known context costs its share there; otherwise it costs an escape (method C: distinct followers against
all) and is looked for in the next shorter context, down to a uniform share of all 256 bytes. Because statistics are frozen, the exact
code length of each (context, byte) in each language is worked out once where it occurs, and a text's code length is their sum. The
language with the shortest code wins. The order is the same for any number of languages: trees are kept sparse, as sorted codes of the
contexts seen and their counts, and what a task has worked out is kept in a table of at most MEMO bytes, which is only a cache.

Trees are counted in tasks, one language each, and written as a table; the driver never holds a text. It hands the trees to the tasks in
blocks of languages of at most BLOCK_BYTES (or one language), so its memory and theirs do not grow with the number of languages: a block
is one pass over the texts, and for more than one a row's best languages of all blocks are put together by row id.

The sample: labelled texts, whole, are cut into pieces of at most PIECE code points, and of each language the PER_LANGUAGE distinct
pieces whose hashes are lowest are taken. A threshold on the hash, from an approximate count of the language's distinct pieces, works
where the rows lie, so at most some OVER * PER_LANGUAGE short hashes for a language meet in one task, however large the corpus.

Defined cases: null text, or one without a letter (general category L), is `und` with score 0; so is every text if nothing could be
learned; ties go to the first language in order of code points; texts of any length are scored whole, in blocks; repeated rows are
scored one by one; other columns are ignored. Score is the posterior share of the winner under equal priors.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, numbered, ship
from .shingles import chunks

ORDER, PER_LANGUAGE, PIECE, OVER, MEMO, BLOCK_BYTES = 3, 300, 16_384, 4, 32 << 20, 128 << 20
#: Symbols are the 256 bytes and one for the place before a text; a code is that of a context with its follower last.
SYMBOLS, PAD = 257, 256


@dataclass
class Tree:
    """Counts of one language: for each k the sorted codes of k symbols and a follower with how often they were seen, and the sorted codes of the k symbols with the sum and the number of their followers."""

    followers: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass
class Model:
    languages: list[str]
    trees: list[Tree]
    order: int = ORDER


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE, piece: int = PIECE) -> DataFrame:
    """(lang, text): at most per_language distinct pieces of each language's texts (lang, text)."""
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and length(text) > 0")
    pieces = rows.select("lang", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / piece).cast("int")), lambda k: F.substring(F.col("text"), k * piece + 1, F.lit(piece)))).alias("text"))
    hashed = pieces.withColumn("h", F.xxhash64("text"))
    # one row for each language, of which the model that is broadcast later has a whole tree; the threshold is in units of 2^-32 of the range of hashes
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).select("lang", F.least(F.lit(1 << 32), F.ceil(F.lit(float(OVER * per_language << 32)) / F.col("n"))).alias("most"))
    low = hashed.join(F.broadcast(sizes), "lang").filter(F.shiftrightunsigned("h", 32) < F.col("most")).groupBy("lang", "h").agg(F.first("text").alias("text"))
    first = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 32), "h")
    return low.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= per_language).select("lang", "text")


def _symbols(text: bytes, order: int) -> np.ndarray:
    out = np.full(len(text) + order, PAD, np.int64)
    out[order:] = np.frombuffer(text, np.uint8)
    return out


def _codes(symbols: np.ndarray, k: int, order: int) -> np.ndarray:
    """Codes of each symbol after the first `order`, with the k symbols before it."""
    n = len(symbols) - order
    out = np.zeros(n, np.int64)
    for back in range(k, -1, -1):
        out = out * SYMBOLS + symbols[order - back : order - back + n]
    return out


def train_one(texts: list[bytes], order: int = ORDER) -> Tree:
    runs = [_symbols(t, order) for t in texts]
    followers, contexts = [], []
    for k in range(order + 1):
        codes, often = np.unique(np.concatenate([_codes(r, k, order) for r in runs]), return_counts=True)
        owner, at = np.unique(codes // SYMBOLS, return_index=True)
        followers.append((codes, often.astype(np.int32)))
        contexts.append((owner, np.add.reduceat(often, at).astype(np.int32) if len(at) else often, np.diff([*at, len(codes)]).astype(np.int32)))
    return Tree(followers, contexts)


def train(texts: list[tuple[str, bytes]], order: int = ORDER) -> Model | None:
    languages = sorted({lang for lang, _ in texts})
    return Model(languages, [train_one([t for lang, t in texts if lang == name], order) for name in languages], order) if languages else None


def packed(tree: Tree) -> bytes:
    """A tree as bytes."""
    out = io.BytesIO()
    np.savez(out, **{f"f{k}_{i}": x for k, pair in enumerate(tree.followers) for i, x in enumerate(pair)}, **{f"c{k}_{i}": x for k, row in enumerate(tree.contexts) for i, x in enumerate(row)})
    return out.getvalue()


def unpacked(data: bytes) -> Tree:
    with np.load(io.BytesIO(data)) as x:
        depth = sum(n.startswith("f") for n in x.files) // 2
        return Tree([(x[f"f{k}_0"], x[f"f{k}_1"]) for k in range(depth)], [(x[f"c{k}_0"], x[f"c{k}_1"], x[f"c{k}_2"]) for k in range(depth)])


def _grown(table: pa.Table) -> pa.Table:
    """The tree of one language; its pieces are at most PER_LANGUAGE."""
    tree = train_one([t.encode() for t in table.column("text").to_pylist()])
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()], pa.string()), "tree": pa.array([packed(tree)], pa.binary())})


def grow(labelled: DataFrame) -> DataFrame:
    """(lang, tree) learned from labelled (text, lang)."""
    return sample(labelled).groupBy("lang").applyInArrow(_grown, "lang string, tree binary")


def models(trees: DataFrame, most: int) -> Iterator[Model]:
    """The languages of trees in order, in blocks of at most so many bytes; the driver holds one block at a time."""
    names, held, size = [], [], 0
    for r in trees.orderBy("lang").toLocalIterator():
        if names and size + len(r["tree"]) > most:
            yield Model(names, held)
            names, held, size = [], [], 0
        names.append(r["lang"])
        held.append(unpacked(bytes(r["tree"])))
        size += len(r["tree"])
    if names:
        yield Model(names, held)


def _find(keys: np.ndarray, wanted: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The values of the wanted keys, 0 where there is none."""
    if not len(keys):
        return [np.zeros(len(wanted)) for _ in values]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return [np.where(hit, v[at], 0).astype(float) for v in values]


def cost(tree: Tree, codes: np.ndarray, order: int) -> np.ndarray:
    """Bits of the followers of codes (order symbols and a follower)."""
    bits = np.full(len(codes), 8.0)
    for k in range(order + 1):
        here = codes % SYMBOLS ** (k + 1)
        (n,) = _find(*(tree.followers[k][0], here), tree.followers[k][1])
        total, kinds = _find(tree.contexts[k][0], here // SYMBOLS, tree.contexts[k][1], tree.contexts[k][2])
        with np.errstate(divide="ignore", invalid="ignore"):
            all_ = np.log2(total + kinds)
            bits = np.where(total == 0, bits, np.where(n > 0, all_ - np.log2(n), all_ - np.log2(kinds) + bits))
    return bits


class Scorer:
    """Code lengths of texts; remembers the costs of the codes met so far, up to MEMO bytes of them."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.codes, self.bits = np.empty(0, np.int64), np.empty((0, len(self.model.languages)), np.float32)

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        """The costs of sorted distinct codes in each language."""
        at = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        new = codes[self.codes[at] != codes] if len(self.codes) else codes
        if len(new):
            if self.bits.nbytes > MEMO:
                self._clear()
                return self._rows(codes)
            found = np.stack([cost(t, new, self.model.order) for t in self.model.trees], 1).astype(np.float32)
            every = np.concatenate([self.codes, new])
            order = np.argsort(every, kind="stable")
            self.codes, self.bits = every[order], np.concatenate([self.bits, found])[order]
            at = np.searchsorted(self.codes, codes)
        return self.bits[at]

    def _block(self, codes: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
        known, at = np.unique(codes, return_inverse=True)
        rows = self._rows(known)
        for j in range(rows.shape[1]):
            out[:, j] += np.bincount(owner, rows[:, j][at], len(out))

    def lengths(self, texts: list[bytes], block: int = 1 << 19) -> np.ndarray:
        """Bits of each text in each language, of all its bytes."""
        out = np.zeros((len(texts), len(self.model.languages)))
        order, held, codes, owner = self.model.order, 0, [], []
        for i, t in enumerate(texts):
            for a in range(0, len(t), block):
                before = t[max(0, a - order) : a]
                symbols = np.concatenate([np.full(order - len(before), PAD, np.int64), np.frombuffer(before + t[a : a + block], np.uint8).astype(np.int64)])
                codes.append(_codes(symbols, order, order))
                owner.append(np.full(len(codes[-1]), i))
                held += len(codes[-1])
                if held >= block:
                    self._block(np.concatenate(codes), np.concatenate(owner), out)
                    held, codes, owner = 0, [], []
        if held:
            self._block(np.concatenate(codes), np.concatenate(owner), out)
        return out


def _scored(model_ref):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_ref.value
        scorer = Scorer(model)
        names = np.array(model.languages, object)
        for b in batches:
            for piece, texts in chunks(b, "text"):
                bits = scorer.lengths(texts)
                low = bits.min(1)
                weight = np.exp2(-np.minimum(bits - low[:, None], 1000)).sum(1)
                kept = [c for c in piece.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), pa.array(names[bits.argmin(1)], pa.string()), pa.array(low), pa.array(weight)], names=[*kept, "lang", "bits", "weight"])

    return run


def identify(texts: DataFrame, labelled: DataFrame, id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, lang_pred, score) of each row of texts (id, text), learned from labelled (text, lang)."""
    spark = texts.sparkSession
    ship(spark)
    scratch = Scratch(spark, "langid")
    trees = scratch.save(grow(labelled), "trees")
    given = texts.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    blocks = trees.agg(F.sum(F.octet_length("tree"))).first()[0] or 0
    rid = None
    if blocks > block_bytes:  # else all trees are one block and rows need no id
        given, rid = numbered(given, scratch)
    given = given.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    keys, kinds = (["id", "letters"], "id long, letters boolean") if rid is None else ([rid, "id", "letters"], f"{rid} long, id long, letters boolean")
    found = None
    for i, model in enumerate(models(trees, block_bytes)):
        ref = spark.sparkContext.broadcast(model)
        part = given.select(*keys, "text").mapInArrow(_scored(ref), f"{kinds}, lang string, bits double, weight double")
        if rid is not None:
            part = scratch.save(part, f"block{i}")
            ref.unpersist()
        found = part if found is None else found.unionByName(part)
    und = lambda df, lang, score: df.select(F.col("id").alias(id_col), F.when(F.col("letters"), lang).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), score).otherwise(0.0).alias("score"))
    if found is None:
        return und(given, F.lit("und"), F.lit(0.0))
    if rid is not None:  # a row has as many results as there are blocks
        best = F.struct("bits", "lang")
        rows = found.groupBy(*keys).agg(F.min(best).alias("best"), F.collect_list(F.struct("bits", "weight")).alias("all"))
        total = F.aggregate("all", F.lit(0.0), lambda s, x: s + x["weight"] * F.pow(F.lit(2.0), -F.least(x["bits"] - F.col("best.bits"), F.lit(1000.0))))
        found = rows.select("id", "letters", F.col("best.lang").alias("lang"), total.alias("weight"))
    return und(found, F.col("lang"), 1 / F.col("weight"))
