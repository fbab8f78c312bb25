"""Terms of many UTF-8 texts at once: a numpy lookup table over the concatenated bytes finds their borders, xxhash groups equal slices, and the grouping is verified byte by byte.

A table has a byte's value inside a term and 0 outside. Bytes of code points above U+007F are all inside, so a term is whole UTF-8.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: The seed with which Spark's xxhash64() gives the same values.
SEED = 42
#: Bytes looked at together; a longer text is taken in parts of this size, cut between terms.
BLOCK = 1 << 21
#: Bytes compared at a time.
VERIFIED = 1 << 18


def table(digits: bool) -> np.ndarray:
    """ASCII letters in lower case, all bytes from 0x80 on, and the ten digits if wanted."""
    out = np.zeros(256, np.uint8)
    out[128:] = np.arange(128, 256)
    for a in b"abcdefghijklmnopqrstuvwxyz":
        out[a] = out[a - 32] = a
    if digits:
        out[48:58] = np.arange(48, 58)
    return out


LETTERS, WORDS = table(False), table(True)


def borders(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms in bytes that went through a table; rows: the offsets of rows, where a term ends too."""
    inside = data != 0
    new = np.zeros(len(data) + 1, bool)
    new[rows] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | new[1:-1]
    end[:-1] &= ~inside[1:] | new[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """For each slice of data its group, and for each group one of its slices. Slices of one group are equal in all bytes, whatever the hash says."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = data.tobytes()
    hashes = np.fromiter((digest(text[a:z], SEED) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends - starts
    like = first[group]
    differs = size != size[like]
    same = np.flatnonzero(~differs)
    filled, at = np.cumsum(size[same]), 0
    while at < len(same):  # some bytes at a time
        to = max(at + 1, int(np.searchsorted(filled, (filled[at - 1] if at else 0) + VERIFIED, "right")))
        part, n = same[at:to], size[same[at:to]]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        unequal = data[np.repeat(starts[part], n) + within] != data[np.repeat(starts[like[part]], n) + within]
        if unequal.any():
            differs[np.unique(np.repeat(part, n)[unequal])] = True
        at = to
    if differs.any():  # two texts of one hash: those that differ from the first get groups by their bytes
        own: dict[bytes, int] = {}
        more = []
        for k in np.flatnonzero(differs).tolist():
            slice_ = text[starts[k] : ends[k]]
            if slice_ not in own:
                own[slice_] = len(first) + len(more)
                more.append(k)
            group[k] = own[slice_]
        first = np.concatenate([first, np.array(more, first.dtype)])
    return group, first


@dataclass
class Counts:
    """Occurrences of terms in rows as a sparse matrix by rows: entries[indptr[i]:indptr[i + 1]] are those of row `first` + i, each term once."""

    first: int
    indptr: np.ndarray
    term: np.ndarray
    count: np.ndarray
    terms: list[bytes]

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; a null is empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)), at - at[0]


def _long(raw: np.ndarray, signs: np.ndarray) -> Counter:
    """Terms of one text, in parts that end between terms."""
    found, at = Counter(), 0
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        part = signs[raw[at:end]]
        outside = np.flatnonzero(part == 0)
        while end < len(raw) and not len(outside):  # a term of more than a block
            end = min(end + BLOCK, len(raw))
            part = signs[raw[at:end]]
            outside = np.flatnonzero(part == 0)
        if end < len(raw):
            end = at + int(outside[-1]) + 1
            part = part[: end - at]
        starts, ends = borders(part, np.zeros(1, np.int64))
        group, first = grouped(part, starts, ends)
        text = part.tobytes()
        for k, n in zip(first.tolist(), np.bincount(group, minlength=len(first)).tolist(), strict=True):
            found[text[starts[k] : ends[k]]] += n
        at = end
    return found


def counted(texts: pa.Array, signs: np.ndarray, block: int = BLOCK) -> Iterator[Counts]:
    """The terms of a string column, in blocks of rows of about so many bytes."""
    raw, rows = buffers(texts)
    at = 0
    while at < len(rows) - 1:
        to = max(at + 1, int(np.searchsorted(rows, rows[at] + block, "right")) - 1)
        part, offsets = raw[rows[at] : rows[to]], rows[at : to + 1] - rows[at]
        if to == at + 1 and len(part) > block:
            found = _long(part, signs)
            yield Counts(at, np.array([0, len(found)]), np.arange(len(found)), np.fromiter(found.values(), np.int64, len(found)), list(found))
            at = to
            continue
        data = signs[part]
        starts, ends = borders(data, offsets)
        group, first = grouped(data, starts, ends)
        owner = np.searchsorted(offsets, starts, "right") - 1
        entries, count = np.unique(owner * max(1, len(first)) + group, return_counts=True)
        row, term = np.divmod(entries, max(1, len(first)))
        text = data.tobytes()
        yield Counts(at, np.searchsorted(row, np.arange(to - at + 1)), term, count, [text[a:z] for a, z in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        at = to
