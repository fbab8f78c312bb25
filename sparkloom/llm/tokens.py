"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Texts are cut into pre-tokens (contractions, letters, digits, other signs, white space) by runs of character classes over arrays of code
points; the classes are those of the tokenizer's own splitter, which is asked about each code point the first time it is met, so both
agree on every version of Unicode. Equal pre-tokens of a batch are grouped and merged once. The distinct ones lie one after the other in
one array of symbols; in each round every pre-token applies its lowest-ranked pair at all its places at once, from the left where they
overlap, and those without a known pair are done. What counts are the symbols that survive.

A merge only makes pairs of higher rank, since a symbol is made by one merge and used by later ones only (checked when the file is read),
so a round's lowest pair cannot be undercut and the result is that of merging one pair at a time.

Strings of the vocabulary's added tokens inside a text are one token each, as the library takes them by default; adding begin or end
tokens, truncation and padding do not exist here. A long text is taken in pieces cut before single spaces between letters or digits,
where pre-tokens end as well; a text without such a place is taken as a whole.

Defined cases: null text counts as empty, with 0 tokens; repeated rows are counted one by one; an empty table gives an empty one; other
columns are ignored; nothing is dealt out, so there are no hot keys. The vocabulary is a file of the driver's, broadcast to the workers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat import pieces
from .common import ship
from .shingles import chunks
from .terms import grouped

LIMIT = 1024
LETTER, DIGIT, OTHER, SPACE, UNKNOWN = range(5)
#: No pair of this rank exists.
NEVER = np.int32(2**31 - 1)
BATCH = 1 << 20


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_signs() -> dict[int, str]:
    """The printable sign that stands for each byte in vocabularies of this kind: itself where Latin-1 prints it, else one from U+0100 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}


@dataclass
class Merges:
    """Symbols of the bytes, the pairs with a rank as sorted codes, and by rank what a pair becomes."""

    first: np.ndarray
    codes: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    size: int

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.codes, wanted), len(self.codes) - 1)
        return np.where(self.codes[at] == wanted, self.ranks[at], NEVER) if len(self.codes) else np.full(len(wanted), NEVER)


def read_merges(spec: dict) -> Merges:
    """The merges of a tokenizer file; ValueError where it is no byte-level BPE whose merges build on earlier ones."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec.get("normalizer") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        raise ValueError("not a plain byte-level BPE")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
        raise ValueError("added tokens that take their surroundings are not supported")
    ids, signs = model["vocab"], byte_signs()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    known = set(signs.values())
    for a, b in pairs:
        if a not in known or b not in known or a + b in known:
            raise ValueError(f"the merge of {a!r} and {b!r} does not build on earlier ones")
        known.add(a + b)
    size = max(ids.values(), default=0) + 1
    codes = np.array([ids[a] * size + ids[b] for a, b in pairs], np.int64)
    order = np.argsort(codes)
    return Merges(np.array([ids[signs[b]] for b in range(256)], np.int32), codes[order], order.astype(np.int32), np.array([ids[a + b] for a, b in pairs], np.int32), size)


def merged(symbols: np.ndarray, sizes: np.ndarray, merges: Merges) -> np.ndarray:
    """How many symbols each sequence keeps; the sequences lie one after the other and are not empty."""
    out, alive = np.zeros(len(sizes), np.int64), np.arange(len(sizes))
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(sizes) - 1] = True
    rank = np.full(len(symbols), NEVER, np.int32)
    if len(symbols) > 1:
        rank[:-1] = np.where(last[:-1], NEVER, merges.rank(symbols[:-1], symbols[1:]))
    while len(alive):
        starts = np.cumsum(sizes) - sizes
        low = np.minimum.reduceat(rank, starts)
        done = low == NEVER
        if done.any():
            out[alive[done]] = sizes[done]
            keep = np.repeat(~done, sizes)
            symbols, rank, last = symbols[keep], rank[keep], last[keep]
            alive, sizes, low = alive[~done], sizes[~done], low[~done]
            if not len(alive):
                break
            starts = np.cumsum(sizes) - sizes
        hit = rank == np.repeat(low, sizes)
        # neighbours that hit are one pair of equal symbols again and again: every second one counts
        at = np.flatnonzero(hit)
        new = np.diff(at, prepend=-2) != 1
        begun = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        at = at[(at - begun) & 1 == 0]
        symbols[at] = merges.made[rank[at]]
        last[at] = last[at + 1]
        gone = np.zeros(len(symbols), bool)
        gone[at + 1] = True
        keep = ~gone
        sizes = sizes - np.add.reduceat(gone, starts, dtype=np.int64)
        at = at - np.arange(len(at))  # each merge before a place takes one symbol
        symbols, rank, last = symbols[keep], rank[keep], last[keep]
        before = at[at > 0] - 1
        changed = np.concatenate([at, before[~last[before]]])
        ends = last[changed]
        rank[changed[ends]] = NEVER
        inner = changed[~ends]
        rank[inner] = merges.rank(symbols[inner], symbols[inner + 1])
    return out


class Splitter:
    """Pre-token borders; the class of a code point is asked of the tokenizer's splitter when it is first met."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.split = Tokenizer.from_str(spec).pre_tokenizer
        self.table = np.full(0x110000, UNKNOWN, np.uint8)

    def _together(self, a: str, b: str) -> bool:
        return len(self.split.pre_tokenize_str(a + b)) == 1

    def classes(self, codes: np.ndarray) -> np.ndarray:
        out = self.table[codes]
        if (out == UNKNOWN).any():
            for c in np.unique(codes[out == UNKNOWN]).tolist():
                sign = chr(c)
                self.table[c] = LETTER if self._together("a", sign) else DIGIT if self._together("1", sign) else OTHER if self._together("!", sign) else SPACE
            out = self.table[codes]
        return out

    def starts(self, codes: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Where pre-tokens start; texts: where texts do. A single space before another sign goes with it; of more white space the last sign stands apart."""
        n = len(codes)
        kind = self.classes(codes)
        edge = np.zeros(n + 1, bool)
        edge[texts] = edge[n] = True
        cut = edge[:-1].copy()
        cut[1:] |= kind[1:] != kind[:-1]
        space = kind == SPACE
        # the last sign of white space that another sign follows in the same text
        tail = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:-1])
        cut[tail] = True
        cut[tail[codes[tail] == 0x20] + 1] = False
        self._contractions(codes, kind, edge, cut)
        return np.flatnonzero(cut)

    @staticmethod
    def _contractions(codes: np.ndarray, kind: np.ndarray, edge: np.ndarray, cut: np.ndarray) -> None:
        """Splits 's 't 'm 'd 're 've 'll where a pre-token starts at a quote that letters follow."""
        at = np.flatnonzero((codes[:-1] == ord("'")) & cut[:-1] & (kind[1:] == LETTER) & ~edge[1:-1])
        one = np.append(codes[1:], 0)[at]
        two = np.where(edge[np.minimum(at + 2, len(codes))], 0, np.append(codes[2:], [0, 0])[at])
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for some, size in ((short, 2), (pair & ~short, 3)):
            start = at[some]
            cut[start + 1] = False
            after = start + size
            cut[after[after < len(codes)]] = True


class Counter:
    """Counts tokens of texts with one vocabulary."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        self.merges, self.splitter = read_merges(parsed), Splitter(spec)
        added = sorted((t["content"] for t in parsed.get("added_tokens", [])), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def _parts(self, texts: list[bytes]) -> tuple[list[str], list[int], np.ndarray]:
        """The texts without added tokens in pieces, whose each is, and the number of added tokens of each text."""
        parts, owner, special = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            text = t.decode()
            runs = [text]
            if self.added is not None and self.added.search(text):
                runs = self.added.split(text)
                special[i] = len(runs) - 1
            for run in runs:
                for piece in pieces(run) if len(run) > BATCH // 4 else [run]:
                    if piece:
                        parts.append(piece)
                        owner.append(i)
        return parts, owner, special

    def counts(self, texts: list[bytes]) -> np.ndarray:
        parts, owner, out = self._parts(texts)
        at = 0
        while at < len(parts):
            to, size = at + 1, len(parts[at])
            while to < len(parts) and size + len(parts[to]) <= BATCH:
                size += len(parts[to])
                to += 1
            np.add.at(out, np.array(owner[at:to]), self._block(parts[at:to]))
            at = to
        return out

    def _block(self, texts: list[str]) -> np.ndarray:
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        raw = np.frombuffer(joined.encode(), np.uint8)
        begins = np.cumsum([0, *map(len, texts)])
        starts = self.splitter.starts(codes, begins[:-1])
        width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        places = np.cumsum(width) - width
        a = places[starts]
        z = np.append(a[1:], len(raw))
        group, first = grouped(raw, a, z)
        sizes = (z - a)[first]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        symbols = self.merges.first[raw[np.repeat(a[first], sizes) + inside]]
        tokens = merged(symbols, sizes, self.merges)[group]
        return np.add.reduceat(tokens, np.searchsorted(starts, begins[:-1]))


_made: dict[str, Counter] = {}


def _counting(spec_ref, id_col: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec = spec_ref.value
        counter = _made.get(spec) or _made.setdefault(spec, Counter(spec))
        for b in batches:
            for part, texts in chunks(b, "text", BATCH):
                n = counter.counts(texts)
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row of docs (id, text) under a tokenizer file (.json, byte-level BPE)."""
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary or vocabulary_path(), encoding="utf-8") as f:
        spec = f.read()
    read_merges(json.loads(spec))
    given = docs.select(F.col(id_col).cast("long").alias(id_col), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(_counting(spark.sparkContext.broadcast(spec), id_col, limit), f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean")
