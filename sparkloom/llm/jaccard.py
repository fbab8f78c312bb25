"""N-gram Jaccard join by chosen paths: pairs of texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Texts with equal shingle sets are one node, whatever their number. Each node has COORDS sampled tokens: the shingle that is least under
each of COORDS hash functions, which two sets share with probability equal to their similarity. One of them is the first step of each
independent run: nodes that share it fall into one bucket. A bucket of at most SMALL nodes is compared by brute force; a larger one is
split again: from its path each coordinate is chosen with probability 1 / (0.8 COORDS), and nodes go on to one bucket for each chosen
coordinate's token. Splitting goes on until buckets are small. It ends early only where it does not help: where a bucket keeps over
DENSE of its parent's nodes, or after DEPTH steps, its nodes are one family that shares all those sampled shingles; such a bucket is
compared by brute force too, in pairs of blocks, however large it is.

A pair at the threshold survives k steps of one run with probability p(1) = 0.8, p(k) = 0.8 q(k - 1), where q(0) = 1 and
q(k) = 1 - exp(-q(k - 1)). Runs are repeated until (1 - p(k))^runs is at most 1 - RECALL: 10 runs for two steps, 15 for three, 20 for
four. Only the nodes of buckets that take k steps need the runs for k: all nodes get those for two, and those in a bucket that takes a
third step get the runs for DEPTH, so that each step adds at most 1 - RECALL to the chance of a miss.

Before the runs, FIRST of the coordinates are used to join what is plainly alike: a bucket is dealt into blocks at random and only nodes
of one block are compared, so this costs a constant for each node; large families of near copies come out connected. As edges need only
span, a bucket whose nodes are already connected has no new one to give and is left out of the runs, at each step; so is one that was
compared as a single block.

Comparison in buckets is by the sketch (COORDS 16-bit pieces of the tokens), with a margin of over four standard deviations
(LEAST_SHARE), and yields spanning edges, not pairs. What their components hold is then compared exactly: sets of a component that can
reach 0.8 by their sizes (ratio of at most 1.25) meet in blocks of at most BLOCK sets or BLOCK_TOKENS shingles, so that nothing depends
on the sketch but which nodes are looked at. The exact links are counted for each node, and their components are the classes. No pair
is ever a row. Counting all links of a family of m different near copies means m^2 / 2 comparisons, spread over block pairs. Where only
the classes are wanted (keep_representatives), a group of several blocks is first compared inside the blocks of SHUFFLES random deals,
which costs a constant for each node and connects a family of near copies; only groups that this leaves in pieces meet in all block pairs.

Defined cases: null texts, and texts without words, are classes of their own with no links; texts of one to four words have one
shingle; equal rows are copies of one node; the first row of a class by (doc_id, place) is its representative; null ids come first;
other columns are ignored, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MERGE, Scratch, named, numbered, ship
from .graph import components
from .shingles import chunks, mix, sets, views

SIMILARITY, RECALL, COORDS, SMALL, LEAST_SHARE, SKETCH_BLOCK = 0.8, 0.999, 128, 512, 0.64, 2048
DEPTH, DENSE, BLOCK, BLOCK_TOKENS, FIRST, SHUFFLES = 4, 0.8, 512, 1 << 18, 2, 2
#: Odd multipliers of the hash functions, from a rule.
MULTIPLIERS = np.array([xxhash.xxh64_intdigest(b"coordinate", j) | 1 for j in range(COORDS)], np.uint64)

NODES = "rid long, doc_id long, n long, hi long, lo long, roots array<long>, sketch binary"


def survival(depth: int, similarity: float = SIMILARITY) -> float:
    """The probability that a pair at the threshold is still together after so many steps of a run."""
    q = 1.0
    for _ in range(depth - 1):
        q = 1 - math.exp(-q)
    return similarity * q


def runs_needed(depth: int, recall: float | None = None) -> int:
    return math.ceil(math.log(1 - (recall or RECALL)) / math.log(1 - survival(depth)))


def sketch(tokens: np.ndarray, offsets: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """Path keys of the first `runs` coordinates and 16-bit pieces of all coordinates for consecutive, non-empty sets of tokens."""
    starts = offsets[:-1]
    roots = np.empty((len(starts), runs), np.uint64)
    pieces = np.empty((len(starts), COORDS), np.uint16)
    buffer = np.empty_like(tokens)
    for j in range(COORDS):
        least = np.minimum.reduceat(np.multiply(tokens, MULTIPLIERS[j], out=buffer), starts)
        pieces[:, j] = (least >> np.uint64(24)) & np.uint64(0xFFFF)
        if j < runs:
            roots[:, j] = mix(least + np.uint64(j))
    return roots, pieces


def _nodes(runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, texts in chunks(b, "text"):
                found = sets(texts)
                some = [k for k, s in enumerate(found) if len(s)]
                n = np.array([len(s) for s in found], np.int64)
                hi, lo = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
                roots: list = [None] * len(found)
                sketches: list = [None] * len(found)
                if some:
                    offsets = np.zeros(len(some) + 1, np.int64)
                    np.cumsum(n[some], out=offsets[1:])
                    r, p = sketch(np.concatenate([found[k] for k in some]), offsets, runs)
                    for i, k in enumerate(some):
                        hi[k], lo[k] = np.frombuffer(xxhash.xxh3_128_digest(found[k]), np.int64)
                        roots[k], sketches[k] = r[i].view(np.int64), p[i].tobytes()
                yield pa.RecordBatch.from_arrays([piece.column("rid"), piece.column("doc_id"), pa.array(n), pa.array(hi), pa.array(lo), pa.array(roots, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["rid", "doc_id", "n", "hi", "lo", "roots", "sketch"])

    return run


def matrix(column) -> np.ndarray:
    """The sketches of a column, one in each row."""
    got = views(column, np.uint16)
    return np.stack(got) if got else np.empty((0, COORDS), np.uint16)


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of the next step for rows (key, rid, known, n, sketch)."""
    limit = np.uint64(int(2**64 / (SIMILARITY * COORDS)))
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            part = b.slice(at, 4096)
            key = part.column("key").to_numpy().view(np.uint64)
            sk = matrix(part.column("sketch"))
            draw = mix(key[:, None] * np.uint64(3) + np.arange(COORDS, dtype=np.uint64)[None, :])
            row, coord = np.nonzero(draw < limit)
            child = mix(draw[row, coord] ^ (sk[row, coord].astype(np.uint64) + np.uint64(1)))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *(part.column(c).take(take) for c in ("rid", "known", "n", "sketch"))], names=["key", "rid", "known", "parent", "sketch"])


def spanning(alike, n: int) -> list[tuple[int, int]]:
    """(member, first of its component) under `alike(i, others) -> mask`, looking at each node once and only at nodes not yet reached."""
    left, out = np.arange(n), []
    while len(left):
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            i = queue.pop()
            hit = alike(i, left)
            reached, left = left[hit], left[~hit]
            out += [(int(x), int(root)) for x in reached]
            queue += reached.tolist()
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows of equal keys, put together across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        borders = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for a, z in zip(borders, borders[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of the likely links within each block pair of a bucket."""
    least = LEAST_SHARE * COORDS
    u: list[int] = []
    v: list[int] = []
    for t in grouped(batches, ["key", "bi", "bj"]):
        if len(t) > 1:
            rid, sk = t.column("rid").to_numpy(), matrix(t.column("sketch"))
            for a, z in spanning(lambda i, others, sk=sk: (sk[others] == sk[i]).sum(1) >= least, len(rid)):
                u.append(int(rid[a]))
                v.append(int(rid[z]))
        if len(u) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
            u, v = [], []
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def blocked(rows: DataFrame, keys: list[str], pairs: bool = True) -> DataFrame:
    """Adds block pairs (bi <= bj) to rows with the number nb of blocks of their key: each pair of a key's rows meets in at least one block pair. Rows of keys with one block are not repeated. pairs=False: blocks by themselves, and no row is repeated."""
    rows = rows.withColumn("b", F.pmod(F.xxhash64("rid", *keys), "nb").cast("int") if not pairs else F.pmod(F.xxhash64("rid", F.lit(11)), "nb").cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb").cast("int") - 1)) if pairs else F.col("b"))
    rows = rows.withColumns({"bi": F.least("b", "o"), "bj": F.greatest("b", "o")})
    return rows.drop("o", "nb").repartition(*keys, "bi", "bj").sortWithinPartitions(*keys, "bi", "bj", "rid")


def _compared(rows: DataFrame, block: int, pairs: bool = True) -> DataFrame:
    """Spanning edges within the buckets of rows (key, rid, n, sketch)."""
    rows = rows.withColumn("nb", F.ceil(F.col("n") / F.lit(block)))
    return blocked(rows, ["key"], pairs).select("key", "bi", "bj", "rid", "sketch").mapInArrow(_edges, "u long, v long")


def _first_edges(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges of FIRST coordinates, each bucket in blocks of SMALL by themselves."""
    rows = reps.select(F.explode(F.slice("roots", 1, FIRST)).alias("key"), "rid")
    count = scratch.save(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "count")
    return scratch.save(_compared(rows.join(count, "key").join(reps.select("rid", "sketch"), "rid"), SMALL, False), "edges")


def _paths(reps: DataFrame, scratch: Scratch, first: int, last: int) -> tuple[DataFrame, dict[int, DataFrame]]:
    """Likely links as spanning edges (u, v) of the runs from `first` to before `last`, and, where more runs may follow, by step the nodes (rid) of the buckets that take it. What all steps leave to be compared is compared at once."""
    rows = reps.select(F.posexplode(F.slice("roots", first + 1, last - first)).alias("run", "key"), "rid", "known", F.lit(0).cast("long").alias("parent"))
    # buckets of the first coordinates that were one block have been compared
    rows = rows.select("key", "rid", "known", "parent", (F.col("run") + first < FIRST).alias("again"))
    final, went = [], []
    for depth in range(1, DEPTH + 1):
        tag = f"{first}-{depth}"
        # a table of its own, so that the join has a plain exchange on either side and adaptive execution can split a hot bucket
        count = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("known").alias("least"), F.max("known").alias("most"), F.bool_or("again").alias("again"))
        count = scratch.save(count.filter((F.col("n") > F.when(F.col("again"), SMALL).otherwise(1)) & (F.col("least") != F.col("most"))).select("key", "n"), f"count{tag}")
        shared = rows.drop("again").join(count, "key")
        if depth == 1:
            shared = shared.join(reps.select("rid", "sketch"), "rid")
        split = (F.col("n") > SMALL) & ((F.col("parent") == 0) | (F.col("n") <= DENSE * F.col("parent"))) & F.lit(depth < DEPTH)
        shared = scratch.save(shared.select("key", "rid", "known", "n", "sketch", split.alias("split")), f"shared{tag}")
        final.append(shared.filter("not split").select("key", "rid", "n", "sketch"))
        if depth == DEPTH or shared.filter("split").isEmpty():
            break
        went.append(shared.filter("split").select("rid", F.lit(depth + 1).alias("step")))
        rows = scratch.save(shared.filter("split").select("key", "rid", "known", "n", "sketch").mapInArrow(_children, "key long, rid long, known long, parent long, sketch binary"), f"rows{tag}").withColumn("again", F.lit(False))
        scratch.drop(f"count{tag}", f"rows{first}-{depth - 1}")
    edges = scratch.save(_compared(_union(final), SKETCH_BLOCK), f"edges{first}")
    deep = {}
    if went and last < runs_needed(DEPTH):  # beyond these there are no runs to choose nodes for
        steps = scratch.save(_union(went).groupBy("rid").agg(F.max("step").alias("step")), f"steps{first}")
        deep = {k: steps.filter(F.col("step") >= k).select("rid") for k in range(2, len(went) + 2)}
    scratch.drop(*(f"shared{first}-{k + 1}" for k in range(len(final))))
    return edges, deep


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def candidates(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root): components of the likely links of nodes (rid, roots, sketch), of as many runs as the steps taken call for."""
    own = Scratch(reps.sparkSession, "paths")
    found = [_first_edges(reps, own)]
    known = components(found[0], own, "known").select(F.col("id").alias("rid"), "root")
    reps = own.save(reps.join(known, "rid", "left").select("rid", F.coalesce("root", "rid").alias("known"), "roots", "sketch"), "known")
    edges, deep = _paths(reps, own, 0, runs_needed(2))
    found.append(edges)
    if 3 in deep:
        edges, _ = _paths(own.save(reps.join(deep[3], "rid"), "deep"), own, runs_needed(2), runs_needed(DEPTH))
        found.append(edges)
    out = scratch.save(components(_union(found), own, "likely"), "likely")
    own.close()
    return out


def _with_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for piece, texts in chunks(b, "text"):
            names = [c for c in piece.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array([s.tobytes() for s in sets(texts)], pa.binary())], names=[*names, "tokens"])


def link_counts(sets: list[np.ndarray], side: np.ndarray, upper: np.ndarray, cross: bool, similarity: float = SIMILARITY) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each set and spanning edges, over all pairs by exact similarity, without pairs of two upper ones (cross: only pairs of different sides). Tokens that one set alone has, and those that all have, are left out of the product of the incidence matrix with itself."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.float32)
    token, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    some = (often > 1) & (often < m)
    column = np.cumsum(some) - 1
    owner = np.repeat(np.arange(m), sizes.astype(int))
    held = some[at]
    owner, at = owner[held], column[at[held]]
    common = np.full((m, m), np.count_nonzero(often == m), np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    columns, most = int(some.sum()), 8192
    for a in range(0, columns, most):
        width = min(most, columns - a)
        lo, hi = np.searchsorted(at, (a, a + width))
        x = np.zeros((m, width), np.float32)
        x[owner[lo:hi], at[lo:hi] - a] = 1
        common += x @ x.T
    both = sizes[:, None].astype(np.float64) + sizes[None, :] - common
    alike = common / both >= similarity
    np.fill_diagonal(alike, False)
    alike &= ~(upper[:, None] & upper[None, :])
    counted = alike & (side[:, None] != side[None, :]) if cross else alike
    return counted.sum(1), spanning(lambda i, others: alike[i, others], m)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, links): links of u in this block pair, and the first of its component there, if another."""
    rows: list[tuple] = []
    for t in grouped(batches, ["root", "band", "bi", "bj"]):
        rid = t.column("rid").to_numpy()
        cross = t.column("bi")[0].as_py() != t.column("bj")[0].as_py()
        n, edges = link_counts(views(t.column("tokens"), np.uint64), t.column("b").to_numpy(), t.column("upper").to_numpy(zero_copy_only=False), cross)
        to = dict(edges)
        rows += [(int(r), int(rid[to.get(i, i)]), int(n[i])) for i, r in enumerate(rid)]
        if len(rows) > 50_000:
            yield _links(rows)
            rows = []
    yield _links(rows)


def _links(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["u", "v", "links"])


def _meetings(likely: DataFrame, scratch: Scratch) -> DataFrame:
    """(rid, meet): for each node of a component (id, root, n) the groups (root, band, upper, nb) in which it is compared.

    Band k holds the sizes from 1.25^k to 1.25^(k+1), so linked sets lie in one band or in neighbouring ones: the group of band k holds
    that band and, as upper ones, the next, and all pairs count but those of two upper ones."""
    sized = scratch.save(likely.withColumn("band", F.floor(F.log("n") / math.log(1 / SIMILARITY + 1e-9)).cast("int")), "bands")
    total = scratch.save(sized.groupBy("root", "band").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("t")), "totals")
    upper = total.select("root", (F.col("band") - 1).alias("band"), F.col("m").alias("m2"), F.col("t").alias("t2"))
    none = F.lit(0).cast("long")
    groups = total.join(upper, ["root", "band"], "left").select("root", "band", (F.col("m") + F.coalesce("m2", none)).alias("m"), (F.col("t") + F.coalesce("t2", none)).alias("t")).filter("m > 1")
    nb = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("t") / BLOCK_TOKENS))
    groups = scratch.save(groups.select("root", "band", nb.alias("nb")), "groups")
    one = F.array(F.struct("root", "band", F.lit(False).alias("upper")), F.struct("root", (F.col("band") - 1).alias("band"), F.lit(True).alias("upper")))
    places = sized.select("rid", F.explode(one).alias("g")).select("rid", "g.*").join(groups, ["root", "band"])
    return scratch.save(places.groupBy("rid").agg(F.collect_list(F.struct("root", "band", "upper", "nb")).alias("meet")), "meetings")


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the number nb of blocks of their key in the blocks of SHUFFLES random deals, each block by itself; those of one block are there once."""
    deals = F.when(F.col("nb") > 1, F.sequence(F.lit(0), F.lit(SHUFFLES - 1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("deal", F.explode(deals)).withColumn("b", F.pmod(F.xxhash64("rid", "deal", *keys), "nb").cast("int"))
    rows = rows.withColumns({"bi": F.col("b") * SHUFFLES + F.col("deal"), "bj": F.col("b") * SHUFFLES + F.col("deal")})
    return rows.drop("nb", "deal").repartition(*keys, "bi", "bj").sortWithinPartitions(*keys, "bi", "bj", "rid")


def _compare(meet: DataFrame) -> DataFrame:
    return meet.select("root", "band", "bi", "bj", "b", "upper", "rid", "tokens").mapInArrow(_exact, "u long, v long, links long")


def _places(rows: DataFrame, meetings: DataFrame) -> DataFrame:
    """(rid, root, band, upper, nb, tokens) of the nodes of meetings, whose texts are dealt out once."""
    tokens = rows.select("rid", "text").join(meetings.hint(MERGE), "rid").select("rid", "meet", "text").mapInArrow(_with_tokens, "rid long, meet array<struct<root:long,band:int,upper:boolean,nb:long>>, tokens binary")
    return tokens.select("rid", F.explode("meet").alias("g"), "tokens").select("rid", "g.*", "tokens")


def _edges_of_classes(rows: DataFrame, meetings: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) whose components are the classes, without the counts of links."""
    found = scratch.save(_compare(_dealt(_places(rows, meetings), ["root", "band"])), "exact")
    groups = meetings.select("rid", F.explode("meet").alias("g")).select("rid", "g.*").filter("nb > 1")
    if groups.isEmpty():
        return found
    parts = scratch.save(components(found.select("u", "v"), scratch, "dealt"), "dealt").select(F.col("id").alias("rid"), F.col("root").alias("part"))
    parted = groups.join(parts, "rid", "left").withColumn("part", F.coalesce("part", "rid"))
    left = scratch.save(parted.groupBy("root", "band").agg(F.min("part").alias("a"), F.max("part").alias("z")).filter("a < z").select("root", "band"), "left")
    if left.isEmpty():
        return found
    meet = scratch.save(groups.join(left, ["root", "band"]).groupBy("rid").agg(F.collect_list(F.struct("root", "band", "upper", "nb")).alias("meet")), "left_meetings")
    return found.unionByName(scratch.save(_compare(blocked(_places(rows, meet), ["root", "band"])), "exact_left"))


def _classes(rows: DataFrame, scratch: Scratch, counts: bool = True) -> DataFrame:
    """One row for each of rows (rid, doc_id, text), which must be a table; counts: with the numbers of links, which need all pairs to be compared."""
    ship(rows.sparkSession)
    nodes = scratch.save(rows.mapInArrow(_nodes(runs_needed(DEPTH)), NODES), "nodes")
    copies = nodes.filter("n > 0").groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "rid")).alias("first"), F.count(F.lit(1)).alias("n_copies"))
    copies = scratch.save(copies.select("hi", "lo", F.col("first.rid").alias("rep"), F.col("first.doc_id").alias("rep_doc"), "n_copies"), "copies")
    reps = scratch.save(nodes.join(copies.select(F.col("rep").alias("rid")), "rid").select("rid", "n", "roots", "sketch"), "reps")
    likely = candidates(reps, scratch)
    meetings = _meetings(likely.select(F.col("id").alias("rid"), "root").join(reps.select("rid", "n"), "rid"), scratch)
    exact = scratch.save(_compare(blocked(_places(rows, meetings), ["root", "band"])), "exact") if counts else _edges_of_classes(rows, meetings, scratch)
    links = exact.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("n_links"))
    classes = scratch.save(components(exact.select("u", "v"), scratch, "classes"), "classes").select(F.col("id").alias("rep"), "root")
    labelled = scratch.save(copies.select("rep", "rep_doc").join(classes, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "labelled")
    first = scratch.save(labelled.groupBy("root").agg(F.min(F.struct("rep_doc", "rep")).alias("f")), "first")
    verdict = labelled.join(first, "root").join(links, "rep", "left").select("rep", F.col("f.rep_doc").alias("class_id"), F.col("f.rep").alias("keep"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    verdict = scratch.save(copies.join(verdict, "rep").select("hi", "lo", "class_id", "keep", "n_links", "n_copies"), "verdict")
    worded = nodes.filter("n > 0").select("rid", "doc_id", "hi", "lo").join(verdict, ["hi", "lo"]).select("rid", "doc_id", "class_id", (F.col("rid") == F.col("keep")).alias("representative"), "n_links", "n_copies")
    bare = nodes.filter("n = 0").select("rid", "doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("representative"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return worded.unionByName(bare)


def _rows(docs: DataFrame, rid: str) -> DataFrame:
    return docs.select(F.col(rid).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, class_id (least doc_id of the class), representative, n_links (other shingle sets at 0.8 or more), n_copies (rows with this shingle set)."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    table, rid = numbered(docs, scratch)
    return _classes(_rows(table, rid), scratch).drop("rid")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """docs without the rows that a class's representative stands for."""
    scratch, inner = Scratch(docs.sparkSession, "jaccard"), Scratch(docs.sparkSession, "jaccard")
    table, rid = numbered(docs, scratch)
    gone = scratch.save(_classes(_rows(table, rid), inner, False).filter("not representative").select(F.col("rid").alias(rid)), "gone")
    inner.close()
    return table.join(gone.hint(MERGE), rid, "left_anti").select(*map(named, docs.columns))
