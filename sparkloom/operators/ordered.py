"""Operators that depend on order: windows, budgets, chunks, top-k, versions. Order always comes from a column, never from the DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import version_key
from ..functions.text import C, col, token_count
from ..session import ship
from .joins import first_wins


def dedupe_first(df: DataFrame, keys: list[str], ordinal: str, title: str) -> DataFrame:
    """First row of each key, in order of lower-case title [W1]."""
    return first_wins(df, keys, ordinal).orderBy(F.lower(title), *keys)


def byte_budget(df: DataFrame, keys: list[str], ordinal: str, text: str, most: int = 50_000) -> DataFrame:
    """Elements while their running UTF-8 size is within `most`; the first that overflows and all after it go [W2, N21, N28].

    Sizes are not negative, so the running sum alone tells: once above, it stays above."""
    run = F.sum(F.octet_length(text)).over(Window.partitionBy(*keys).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running_bytes", run).filter(F.col("running_bytes") <= most)


def text_budget(parts: C, most: int = 50_000) -> Column:
    """The same over an array of texts in a row, joined [W2]."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("size"), F.lit(False).alias("full"))

    def step(a, x):
        fits = ~a["full"] & (a["size"] + F.octet_length(x) <= most)
        return F.struct(F.when(fits, F.concat(a["text"], x)).otherwise(a["text"]).alias("text"), F.when(fits, a["size"] + F.octet_length(x)).otherwise(a["size"]).alias("size"), (a["full"] | ~fits).alias("full"))

    return F.aggregate(col(parts), start, step, lambda a: a["text"])


def claims(df: DataFrame) -> DataFrame:
    """Winner of each name among claims (name, page, declared, strength, ordinal): rank is 3 if declared plus strength; the higher rank
    wins, a tie keeps the earlier; a page's later claims never raise its first one [W3, N12, J36, T11]."""
    first = first_wins(df, ["name", "page"], "ordinal_in_page") if "ordinal_in_page" in df.columns else df.groupBy("name", "page").agg(F.min_by(F.struct("declared", "strength", "ordinal"), "ordinal").alias("__r")).select("name", "page", "__r.*")
    rank = F.col("declared").cast("int") * 3 + F.col("strength")
    return first.groupBy("name").agg(F.max_by(F.struct("page", rank.alias("rank")), F.struct(rank, -F.col("ordinal"))).alias("w")).select("name", "w.*")


def chunk_titles(titles: C, budget: int = 180) -> Column:
    """Greedy chunks of an array of structs with a text field t, by token count; an entry that overflows starts the next chunk; no entries give one empty chunk [W4]."""
    x = col(titles)
    entry = F.struct(F.lit(0).alias("tokens"), F.slice(F.array(x), 1, 0).alias("done"), F.slice(x, 1, 0).alias("now"))

    def step(a, t):
        n = token_count(t["t"])
        over = (F.size(a["now"]) > 0) & (a["tokens"] + n > budget)
        return F.struct(F.when(over, n).otherwise(a["tokens"] + n).alias("tokens"), F.when(over, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"), F.when(over, F.array(t)).otherwise(F.concat(a["now"], F.array(t))).alias("now"))

    return F.when(F.size(x) == 0, F.array(x)).otherwise(F.aggregate(x, entry, step, lambda a: F.concat(a["done"], F.array(a["now"]))))


def _chunk_tables(keys: list[str], order: list[str], budget: int):
    """For each run of equal keys in a sorted partition, what its entries do: from each number of tokens in the open chunk (0: none is open; a full one is as good as any above) to the number after them, and the chunks that they open."""

    def fold(states: dict[int, list], counts: list[int]) -> dict[int, list]:
        # states that have met go on as one: tokens -> [chunks opened, [(start, chunks more than that)]]
        for n in counts:
            after: dict[int, list] = {}
            for tokens, (chunks, starts) in states.items():
                opens = not tokens or tokens + n > budget
                tokens, chunks = min(n, budget) if opens else tokens + n, chunks + opens
                if tokens in after:
                    first, met = after[tokens]
                    met += [(start, more + chunks - first) for start, more in starts]
                else:
                    after[tokens] = [chunks, starts]
            states = after
        return states

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, key, states, titles = None, None, {}, 0

        def closed() -> pa.RecordBatch:
            ends, opened = [0] * (budget + 1), [0] * (budget + 1)
            for tokens, (chunks, starts) in states.items():
                for start, more in starts:
                    ends[start], opened[start] = tokens, chunks + more
            made = [pa.array([ends], pa.list_(pa.int32())), pa.array([opened], pa.list_(pa.int64())), pa.array([titles], pa.int64())]
            return pa.RecordBatch.from_arrays([*head.columns, *made], names=[*keys, *order, "ends", "opened", "titles"])

        for b in batches:
            counts = b.column("__n").to_pylist()
            of = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
            at = 0
            while at < len(of):
                if head is None or of[at] != key:
                    if head is not None:
                        yield closed()
                    head, key, titles = b.select([*keys, *order]).slice(at, 1), of[at], 0
                    states = {tokens: [0, [(tokens, 0)]] for tokens in range(budget + 1)}
                end = at
                while end < len(of) and of[end] == key:
                    end += 1
                states, titles, at = fold(states, counts[at:end]), titles + end - at, end
        if head is not None:
            yield closed()

    return run


def chunk_counts(df: DataFrame, keys: list[str], order: list[str], text: str, budget: int = 180) -> DataFrame:
    """(keys, n_chunks, n_titles): how many chunks chunk_titles() makes of each key's texts in the given order, for keys with any number of texts [W4].

    Rows are sorted once over all tasks. What a task's run of a key does is a table from the tokens in the open chunk before it to those after
    it, so a key may span tasks, no task holds a key's texts, and a key has one small table for each task that it spans."""
    ship(df.sparkSession)
    rows = df.select(*keys, *order, token_count(text).alias("__n")).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.drop("__n").schema)
    tables = rows.mapInArrow(_chunk_tables(keys, order, budget), f"{schema}, ends array<int>, opened array<long>, titles long")
    runs = tables.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "ends", "opened"))).alias("runs"), F.sum("titles").alias("n_titles"))
    start = F.struct(F.lit(0).alias("tokens"), F.lit(0).cast("long").alias("chunks"))
    step = lambda a, r: F.struct(F.get(r["ends"], a["tokens"]).alias("tokens"), (a["chunks"] + F.get(r["opened"], a["tokens"])).alias("chunks"))
    return runs.select(*keys, F.aggregate("runs", start, step, lambda a: a["chunks"]).cast("int").alias("n_chunks"), "n_titles")


def adjacent_pairs(df: DataFrame, key: str, value: str, partition: list[str] = ()) -> DataFrame:
    """(value, next) in order of key, the last without next left out [W5, DIFF10]. Without partition columns all rows of this per-release table sort in one task."""
    return df.withColumn("next", F.lead(value).over(Window.partitionBy(*partition).orderBy(key))).filter("next is not null")


def immediate_successor(df: DataFrame, key: str, version: str, old: C, new: C, partition: list[str]) -> DataFrame:
    """Whether `new` directly follows `old` in the manifest's order [W6]."""
    n = df.withColumn("__n", F.row_number().over(Window.partitionBy(*partition).orderBy(key)))
    at = lambda v: F.max(F.when(F.col(version) == v, F.col("__n")))
    return n.groupBy(*partition).agg(F.coalesce(at(new) - at(old) == 1, F.lit(False)).alias("attributable"))


def carry_forward(df: DataFrame, keys: list[str], ordinal: str, value: str, out: str) -> DataFrame:
    """Last value that is not null, up to each row [W8, SRC28]."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)))


def in_block(df: DataFrame, keys: list[str], ordinal: str, toggles: Column, out: str = "in_block") -> DataFrame:
    """Inside a delimited block where any delimiter toggles [W7, N9]; delimiters themselves count as inside."""
    order = Window.partitionBy(*keys).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, (F.sum(toggles.cast("int")).over(order) % 2 == 1) | toggles)


def fold_blank_lines(df: DataFrame, keys: list[str], ordinal: str, line: str) -> DataFrame:
    """Drops a blank line after a blank line [W9]."""
    prev = F.lag(line).over(Window.partitionBy(*keys).orderBy(ordinal))
    return df.withColumn("__p", prev).filter(~((F.trim(line) == "") & (F.trim(F.coalesce("__p", F.lit("x"))) == ""))).drop("__p")


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str = "n") -> DataFrame:
    """1, 2, ... within keys [W10]."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_n(df: DataFrame, count: str, ordinal: str, n: int = 5) -> DataFrame:
    """Largest counts, ties in order of ordinal [T1]. Each task keeps n rows."""
    return df.orderBy(F.desc(count), ordinal).limit(n)


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """First n of each key [T7, T8]; the limit works before the shuffle too."""
    return numbered(df, keys, order, "__n").filter(F.col("__n") <= n).drop("__n")


def all_but_newest(df: DataFrame, keys: list[str], order: list[Column], keep: int = 2) -> DataFrame:
    """What a retention rule deletes [SNK11]."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") > keep).drop("__n")


def newest_tag(df: DataFrame, tag: str, allow: Column, keys: list[str] = ()) -> DataFrame:
    """Newest tag by version key among rows that `allow` passes, by key [T2, T4, T5, T6]."""
    k = version_key(tag)
    return df.filter(allow & k.isNotNull()).groupBy(*keys).agg(F.max_by(tag, F.struct(k, F.col(tag))).alias("newest"))


def minor_order(df: DataFrame, tag: str, ordinal: str) -> DataFrame:
    """Tags by major and minor, newest first; the patch is ignored and ties keep their order [T3, N16]."""
    part = lambda i: F.regexp_extract(tag, r"^v?(\d+)\.(\d+)", i).try_cast("int")
    return df.orderBy(F.desc(part(1)), F.desc(part(2)), ordinal)


#: What each source of versions calls unstable; the two differ [N17].
def stable_image(tag: C) -> Column:
    return ~F.contains(col(tag), F.lit("-beta"))


def stable_release(tag: C) -> Column:
    return ~F.contains(col(tag), F.lit("-rc"))


def dataset_for(pages: DataFrame, datasets: DataFrame) -> DataFrame:
    """Dataset of each page (component, version): cloud pages take the newest released one, others one of their own major.minor series,
    the exact version first, never another series [J41, N32]. datasets: (dataset, tag, released)."""
    from ..functions.scalars import series

    d = datasets.select("dataset", F.col("tag").alias("dtag"), "released", series("tag").alias("s"), version_key("tag").alias("vk"))
    newest = d.filter("released").agg(F.max_by("dataset", F.struct("vk", "dtag")).alias("newest"))
    own = pages.withColumn("s", series("version")).join(d, "s").withColumn("exact", (F.regexp_replace("dtag", "^v", "") == F.regexp_replace("version", "^v", "")).cast("int"))
    best = own.groupBy("component", "version").agg(F.max_by("dataset", F.struct("exact", "vk", "dtag")).alias("own"))
    # newest is one row
    return pages.join(best, ["component", "version"], "left").join(newest, F.lit(True), "left").select("component", "version", F.when(F.col("cloud"), F.col("newest")).otherwise(F.col("own")).alias("dataset"))
