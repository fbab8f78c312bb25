"""Substring de-duplication by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of each text; a chunk ends where the hash is the least within REACH places on both sides (ties
too). WINDOW + REACH bytes before a border and REACH after it decide, whatever went before, so two copies of a passage have the same
borders from there on, and an insertion moves only the chunks around it. Chunks are MIN to MAX bytes, about 32 on average, and end between
code points; in a stretch of a short period, as a word said over and over, they are a period long (TIE bytes at least).

Chunks of a few words recur by chance, so what is de-duplicated by digest is the shortest run of whole chunks from each chunk on that has
MIN_WORDS words. A run whose 128-bit digest occurs twice is thus the same text in both places, from end to end. The occurrence in the
first place by (doc_id, row, start) stays, later ones are repeats; repeats of one row that overlap or touch and lie at one distance from
one first row join into a passage. In a stretch of equal runs each counts with its place in the stretch, so that a long stretch is no
copy of a short one. A passage of 50 words is some 300 bytes, of which about 80 at its two ends may be lost, since chunks are whole.

Cost: the text is chunked twice, as a table of all runs takes more disk than the texts in Parquet. Digests alone are counted first, aggregated
before the shuffle; those that occur twice are a table of their own, as are their first places, so joins with them have a plain exchange
on either side, which adaptive execution can split where a digest is hot. No task gathers the runs of a digest. Each table's shuffle files
go as soon as it is written, so the disk needed at a time is that of the largest shuffle, of all runs, and of the runs that occur twice.

Defined cases: null and empty texts have no chunks; each row is a document of its own, also where ids repeat or are null (null ids come
first in order), so a repeated row is a later copy of the first one, whose text stays; what repeats inside a row counts as a repeat of
its first place; other columns pass through; empty tables give empty results. Texts of any length are cut whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import MERGE, Scratch, free, named, numbered, ship, tidy
from .shingles import chunks

WINDOW, MIN, MAX, MIN_WORDS = 16, 16, 256, 30
#: A border's hash is the least within REACH places, so borders are farther apart than MIN but for ties, as in a word said over and over; these
#: are TIE apart. A stretch of equal runs starts anew after STRETCH words.
REACH, TIE, STRETCH = MIN, 3, 50
#: The gear table, from a rule: a 16-bit hash of each byte value.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 16) & 0xFFFF for b in range(256)], np.uint16)

RUNS = "hi long, lo long, rid long, doc_id long, start int, end int, word int, words int"


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash h = 2 h + GEAR[byte] (mod 2^16) after each byte, in log2(WINDOW) doubling steps."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step].copy() << np.uint16(step)
        step *= 2
    return h


def borders(h: np.ndarray, first: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Ends of chunks that the bytes nearby decide: places between code points whose hash is the least within REACH places on both sides.
    Places that would see another text, or a hash of fewer than WINDOW bytes, are none. first: where the texts start, and the end."""
    n = len(h)
    if n <= 2 * REACH:
        return np.empty(0, np.int64)
    h = np.where(begins[1:], h, np.uint32(1 << 16)).astype(np.uint32)
    least, width, span = h, 1, 2 * REACH + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - span + 1], least[span - width :])
    at = np.flatnonzero((h[REACH : n - REACH] == least) & (least < 1 << 16)) + REACH
    text = np.searchsorted(first, at, "right") - 1
    return at[(at - first[text] >= WINDOW - 1 + REACH) & (at + REACH < first[text + 1])] + 1


def cuts(size: int, candidates: list[int], starts_char) -> list[int]:
    """Ends of the chunks of a text: candidate places at least TIE from the last end; MAX bytes at most, then at the last start of a code point."""
    out, last = [], 0
    for c in [*candidates, size]:
        while c - last > MAX:
            at = last + MAX
            while at > last + 1 and not starts_char(at):
                at -= 1
            out.append(at)
            last = at
        if c - last >= TIE or (c == size and c > last):
            out.append(c)
            last = c
    return out


def chunk_texts(texts: list[bytes]) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """(ends of the chunks of each text, words begun before each byte of all texts, where the texts start)."""
    data = b"".join(texts)
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=first[1:])
    raw = np.frombuffer(data, np.uint8)
    begins = np.ones(len(raw) + 1, bool)
    begins[:-1] = (raw & 0xC0) != 0x80
    candidate = borders(gear_hashes(raw), first, begins)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    word_start = ~space
    word_start[1:] &= space[:-1]
    some = first[:-1][np.diff(first) > 0]
    word_start[some] = ~space[some]
    sums = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(word_start, out=sums[1:])
    ends = []
    for i, t in enumerate(texts):
        base = int(first[i])
        a, z = np.searchsorted(candidate, (base + MIN, base + len(t)))
        ends.append(cuts(len(t), (candidate[a:z] - base).tolist(), lambda at, base=base: begins[base + at]))
    return ends, sums, first


def runs(text: bytes, ends: list[int], sums: np.ndarray, min_words: int) -> Iterator[tuple[bytes, int, int, int, int]]:
    """(digest, start, end, words before it, words in it) of the shortest run of chunks from each chunk on that has min_words words. sums: words begun before each byte of the text."""
    at = np.array([0, *ends])
    begun = sums[at] - sums[0]
    last = np.searchsorted(begun, begun[:-1] + min_words, "left")
    before, place, since = b"", 0, 0
    for k in np.flatnonzero(last < len(at)).tolist():
        a, z, w, v = int(at[k]), int(at[last[k]]), int(begun[k]), int(begun[last[k]])
        piece = text[a:z]
        digest = xxhash.xxh3_128_digest(piece)
        # in a stretch of equal runs each counts with its place, which starts anew after STRETCH words
        place = place + 1 if digest == before and w - since < STRETCH else 0
        if not place:
            since = w
        before = digest
        yield xxhash.xxh3_128_digest(piece, place) if place else digest, a, z, w, v - w


def _runs(min_words: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, texts in chunks(b, "text"):
                rid, doc = piece.column("rid").to_pylist(), piece.column("doc_id").to_pylist()
                ends, sums, first = chunk_texts(texts)
                digests, rows, rids, docs = [], [], [], []
                for i, t in enumerate(texts):
                    before = len(rows)
                    for d, *row in runs(t, ends[i], sums[first[i] : first[i + 1] + 1], min_words):
                        digests.append(d)
                        rows.append(row)
                    rids += [rid[i]] * (len(rows) - before)
                    docs += [doc[i]] * (len(rows) - before)
                keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                cols = np.array(rows, np.int32).reshape(-1, 4)
                out = pa.RecordBatch.from_arrays(
                    [*(pa.array(np.ascontiguousarray(keys[:, k])) for k in range(2)), pa.array(rids, pa.int64()), pa.array(docs, pa.int64()), *(pa.array(np.ascontiguousarray(cols[:, k])) for k in range(4))],
                    names=["hi", "lo", "rid", "doc_id", "start", "end", "word", "words"],
                )
                yield out.select(names)

    return run


def _found(rows: DataFrame, min_words: int, schema: str = RUNS) -> DataFrame:
    return rows.mapInArrow(_runs(min_words, [c.split()[0] for c in schema.split(", ")]), schema)


def find_repeats(rows: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """(rid, doc_id, start, end, words, first_rid, first_doc_id, first_start) of the later copies in rows (rid, doc_id, text): passages in bytes, each the same text as that from first_start on in the first row, but that the passages of a row's own repeats join whatever their distance. rows are read twice and must be the same each time, as numbered() has them."""
    ship(rows.sparkSession)
    place = F.struct("doc_id", "rid", "start")
    with tidy(rows.sparkSession):
        repeated = scratch.save(_found(rows, min_words, "hi long").groupBy("hi").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hi"), "repeated")
        some = scratch.save(_found(rows, min_words).join(repeated, "hi"), "some")
        scratch.drop("repeated")
        firsts = scratch.save(some.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "firsts")
    later = some.join(firsts, ["hi", "lo"]).filter(~place.eqNullSafe(F.col("first")))
    later = later.select("rid", "doc_id", "start", "end", "word", "words", F.col("first.rid").alias("first_rid"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"))
    later = later.withColumn("off", F.when(F.col("rid") != F.col("first_rid"), F.col("start") - F.col("first_start")))
    order = Window.partitionBy("rid", "first_rid", "off").orderBy("start")
    fresh = F.coalesce((F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    joined = later.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = joined.groupBy("rid", "first_rid", "off", "run").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), (F.max(F.col("word") + F.col("words")) - F.min("word")).alias("words"), F.first("first_doc_id").alias("first_doc_id"), F.min("first_start").alias("first_start"))
    return merged.drop("off", "run")


def _rows(table: DataFrame, rid: str) -> DataFrame:
    return table.select(F.col(rid).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start, end, words, first_doc_id, first_start) of the later copies in docs."""
    scratch = Scratch(docs.sparkSession, "cdc")
    table, rid = numbered(docs, scratch)
    found = find_repeats(_rows(table, rid), scratch, min_words).drop("rid", "first_rid")
    scratch.drop("numbered", "files")  # the result reads other tables only
    return found


def _without(text: bytes, spans: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for a, z in sorted(spans):
        parts.append(text[at:max(at, a)])
        at = max(at, z)
    return b"".join([*parts, text[at:]]).decode()


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later copies cut out of text."""
    scratch, inner = Scratch(docs.sparkSession, "cdc"), Scratch(docs.sparkSession, "cdc")
    table, rid = numbered(docs, scratch)
    cut, names = free(table.columns, "__spans")[0], docs.columns
    plain = [f"c{i}" for i in range(len(names))]  # names that hold dots cannot go to Python
    spans = scratch.save(find_repeats(_rows(table, rid), inner, min_words).groupBy(F.col("rid").alias(rid)).agg(F.collect_list(F.struct("start", "end")).alias(cut)), "spans")
    inner.close()
    text = plain[names.index("text")]

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [t if not s else _without(t.encode(), [(x["start"], x["end"]) for x in s]) for t, s in zip(b.column(text).to_pylist(), b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == text else b.column(c) for c in plain], names=plain)

    schema = StructType([StructField(p, f.dataType) for p, f in zip(plain, docs.schema, strict=True)])
    cut_out = table.join(spans.hint(MERGE), rid, "left").select(*(named(c).alias(p) for c, p in zip(names, plain, strict=True)), named(cut).alias("spans")).mapInArrow(without, schema)
    return cut_out.select(*(F.col(p).alias(c) for c, p in zip(names, plain, strict=True)))
