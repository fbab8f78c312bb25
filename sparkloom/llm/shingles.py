"""Hashes of words and of five-word shingles for many texts at once, with numpy; no memory is held from one batch to the next."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

WIDTH = 5
_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at a time, and the length from which a word is hashed by itself.
BLOCK, LONG = 1 << 18, 1 << 12

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(string.punctuation.encode())] = True
#: A 64-bit value for each byte, from a rule, and powers of an odd base and of its inverse: a word's hash is sum(VALUE[byte k] * BASE^k).
_VALUE = np.array([xxhash.xxh64_intdigest(bytes([b]), 5) for b in range(256)], np.uint64)
_BASE = 0x5851F42D4C957F2D | 3


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words at [starts, ends) of at most BLOCK bytes; each depends on the word's bytes alone."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * _POWERS[: len(raw)], out=sums[1:])
    size = (ends - starts).astype(np.uint64)
    out = mix((sums[ends] - sums[starts]) * _INVERSE[starts] + size * _MUL)
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = xxhash.xxh64_intdigest(raw[starts[k] : ends[k]].tobytes())
    return out


def words(texts: list[bytes], normal: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the offsets of each text's words. normal: in lower case and without ASCII punctuation at their ends; words of punctuation alone are left out."""
    if normal:
        texts = [t.decode("utf-8", "replace").lower().encode() for t in texts]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    data = b" ".join([*texts, b""])
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    found, at = [np.empty(0, np.uint64)], 0
    places = [np.empty(0, np.int64)]
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        gaps = np.flatnonzero(space[at:end])
        if end < len(raw) and not len(gaps):  # a word of over BLOCK bytes
            more = end
            while more < len(raw) and not len(hit := np.flatnonzero(space[more : more + BLOCK])):
                more += BLOCK
            end = more + int(hit[0])
            word, here = data[at:end], at
            if normal:
                word = word.strip(string.punctuation.encode())
            if word:
                found.append(_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)])) if len(word) <= LONG else np.array([xxhash.xxh64_intdigest(word)], np.uint64))
                places.append(np.array([here], np.int64))
            at = end
            continue
        if end < len(raw):
            end = at + int(gaps[-1]) + 1
        part, gap = raw[at:end], space[at:end]
        step = np.diff(gap.view(np.int8), prepend=np.int8(1), append=np.int8(1))
        starts, ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
        if normal:
            solid = np.flatnonzero(~(gap | _PUNCTUATION[part]))
            a, z = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
            some = z > a
            starts, ends = solid[a[some]], solid[z[some] - 1] + 1
        found.append(_hashes(part, starts, ends))
        places.append(starts + at)
        at = end
    borders = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=borders[1:])
    return np.concatenate(found), np.searchsorted(np.concatenate(places), borders)


def grams(hashed: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of so many words."""
    n = len(hashed) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashed[:n].copy()
    for j in range(1, width):
        out = out * _MUL + hashed[j : n + j]
    return mix(out + np.uint64(width))


def shingles(hashed: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of texts given as consecutive words, in order, and their offsets; a text of one to four words has one, a text without words none."""
    n = np.diff(offsets)
    count = np.where(n >= WIDTH, n - WIDTH + 1, n > 0)
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    at = np.repeat(offsets[:-1] - out[:-1], count) + np.arange(out[-1])
    every = grams(hashed, WIDTH)
    tokens = every[np.minimum(at, len(every) - 1)] if len(every) else np.zeros(len(at), np.uint64)
    for k in np.flatnonzero((n > 0) & (n < WIDTH)).tolist():
        tokens[out[k]] = grams(hashed[offsets[k] : offsets[k + 1]], int(n[k]))[0]
    return tokens, out


def sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    tokens, offsets = shingles(*words(texts))
    return [np.unique(tokens[a:z]) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def binary(column: pa.Array) -> pa.Array:
    """The UTF-8 bytes of a string column, not copied."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def views(column: pa.Array | pa.ChunkedArray, kind) -> list[np.ndarray]:
    """The values of a binary column as arrays, not copied."""
    out = []
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        wide = pa.types.is_large_binary(c.type)
        at = np.frombuffer(c.buffers()[1], np.int64 if wide else np.int32)[c.offset : c.offset + len(c) + 1].tolist() if len(c) else []
        data = c.buffers()[2]
        out += [np.frombuffer(data, np.uint8, z - a, a).view(kind) if z > a else np.empty(0, kind) for a, z in zip(at, at[1:])]
    return out


def chunks(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch in pieces whose texts come to about `most` bytes (or one text), with the texts as bytes (null: empty)."""
    texts = binary(batch.column(column))
    wide = pa.types.is_large_binary(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset + 1 : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.empty(0, np.int64)
    first = int(np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset]) if len(texts) else 0
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else first
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at), [x.as_py() or b"" for x in texts.slice(at, to - at)]
        at = to
