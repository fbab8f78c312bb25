"""Quality rules: a decision list learned by sequential covering, emitted as ordered Spark conditional expressions.

Statistics of each text come from DataFrame functions alone. Learning reads a bounded sample of the labelled documents (MAX_LABELLED
rows, those whose id hashes lowest), which is written once, gathers their statistics, and grows rules on the driver: conjunctions of
thresholds are grown by information gain on two thirds of the sample, pruned on the other third, and kept while they are precise on that
third, which neither the rule nor the lexicon has seen; covered rows are then taken out and the next rule is grown. A label is bad if
quality is 0 or toxic is 1. One statistic counts distinct word beginnings of a lexicon that is itself learned from the first two thirds:
beginnings seen in several toxic documents and in next to no others.

Defined cases: a null text has no words; a text with fewer words than MIN_WORDS fails; null labels count as good; of several labels of
an id the worst counts; with no labels, or no bad ones, the list is empty and keeps all that the base rules keep; repeated rows are
judged one by one; other columns pass through, also where their names are those of the statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, barrier, named

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
MAX_LABELLED, MAX_LEXICON, BEGINNING = 12_000, 400, 5
#: A beginning that is in t toxic documents alone is so by chance with probability share^t; among a million beginnings that must be below 1 %.
CHANCE = math.log(1e6 / 0.01)
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "longest_word", "flagged_words"]


@dataclass(frozen=True)
class Rule:
    """Rejects where all conditions (feature, '<=' or '>=', threshold) hold."""

    conditions: tuple[tuple[str, str, float], ...]


@dataclass(frozen=True)
class RuleList:
    rules: tuple[Rule, ...] = ()
    lexicon: tuple[str, ...] = ()

    def rejects(self) -> Column:
        """The ordered conditional: number of the first rule that holds, null if none does."""
        out = None
        for i, r in enumerate(self.rules):
            test = F.lit(True)
            for f, op, t in r.conditions:
                x = F.col(FEATURE_COLUMNS[f])
                test = test & (x <= F.lit(t) if op == "<=" else x >= F.lit(t))
            out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
        return F.lit(None).cast("int") if out is None else out

    def describe(self) -> list[str]:
        return [f"{i}: reject if " + " and ".join(f"{f} {op} {t:g}" for f, op, t in r.conditions) for i, r in enumerate(self.rules)]


def _beginnings(words: Column) -> Column:
    return F.array_distinct(F.transform(words, lambda w: F.lower(F.substring(w, 1, BEGINNING))))


def text_stats(df: DataFrame, text: str = "text", lexicon: tuple[str, ...] = ()) -> DataFrame:
    """Adds the base statistics as columns __a_* and the features as columns __f_*."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = barrier(df, __w=F.regexp_extract_all(whole, F.lit(f"({WORD})"), F.lit(1)))
    w = F.col("__w")
    n = F.size(w)
    grams = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(w[i + j] for j in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(WORD))
    df = barrier(df, __g=grams, __j=F.array_join(w, ""), __l=lines)
    g = F.col("__g")
    # (hash, place) in order of hash; only where some window is there twice
    pairs = F.when(F.size(F.array_distinct(g)) < F.size(g), F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    df = barrier(df, __s=pairs)
    s = F.col("__s")
    twice = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    # words in the union of windows of five that start at the given places
    places = F.array_sort(F.array_distinct(F.flatten(twice)))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])
    base = {
        "n_words": n.cast("long"),
        "word_chars": F.length("__j").cast("long"),
        "n_symbols": F.regexp_count("__j", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": F.when(s.isNull(), F.lit(0).cast("long")).otherwise(covered),
        "n_lines": F.size("__l"),
        "n_distinct": F.size(F.array_distinct(w)),
        "longest": F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0)),
        "flagged": F.size(F.array_intersect(_beginnings(w), F.array(*map(F.lit, lexicon)))) if lexicon else F.lit(0),
    }
    df = barrier(df, **{f"__a_{k}": c for k, c in base.items()})
    a, share = {k: F.col(f"__a_{k}") for k in base}, lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    features = {
        "n_words": a["n_words"].cast("double"),
        "mean_word_chars": share(a["word_chars"], a["n_words"]),
        "symbol_share": share(a["n_symbols"], a["word_chars"]),
        "dup_line_share": share(a["n_dup_lines"], a["n_lines"]),
        "repeat_share": share(a["n_repeat_words"], a["n_words"]),
        "distinct_share": share(a["n_distinct"], a["n_words"]),
        "longest_word": a["longest"].cast("double"),
        "flagged_words": a["flagged"].cast("double"),
    }
    df = barrier(df, **{f"__f_{k}": c.cast("double") for k, c in features.items()})
    return df.drop("__w", "__g", "__j", "__l", "__s", *(f"__a_{k}" for k in base if k not in BASE))


BASE_COLUMNS = {b: f"__a_{b}" for b in BASE}
FEATURE_COLUMNS = {f: f"__f_{f}" for f in FEATURES}


def base_failed() -> Column:
    n = F.col("__a_n_words")
    return (n < MIN_WORDS) | (100 * F.col("__a_n_repeat_words") > MAX_REPEAT_PERCENT * n)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> RuleList:
    """Learns a list from labels (doc_id, quality, toxic) and docs (doc_id, text)."""
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    low = F.coalesce(F.col("quality") == 0, F.lit(False))
    sample = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(toxic).alias("toxic"), F.max(low).alias("low"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # at most max_labelled rows of 10 bytes: a proven bound
    sample = F.broadcast(sample.withColumn("grow", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) < 2))
    rows = Scratch(docs.sparkSession, "quality").save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id"), "sample")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), F.lit(1))
    seen = rows.filter("grow")
    counts = seen.select("toxic", F.explode(_beginnings(words)).alias("w")).groupBy("w").agg(F.count_if("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    share = seen.agg(F.avg(F.col("toxic").cast("int"))).first()[0]
    support = max(5, CHANCE / -math.log(share)) if share and share < 1 else math.inf
    found = counts.filter((F.col("t") >= support) & (F.col("t") >= 0.98 * F.col("n")) & (F.length("w") >= 4)).orderBy(F.desc("t"), "w").limit(MAX_LEXICON).collect()
    lexicon = tuple(sorted(r["w"] for r in found))
    stats = text_stats(rows, "text", lexicon).select("doc_id", (F.col("toxic") | F.col("low")).alias("bad"), *(F.col(c).alias(f) for f, c in FEATURE_COLUMNS.items()), "grow", base_failed().alias("failed"))
    data = [(tuple(r[f] for f in FEATURES), bool(r["bad"]), bool(r["grow"])) for r in stats.filter("not failed").orderBy("doc_id", *FEATURES).limit(max_labelled).collect()]
    return RuleList(tuple(cover(data)), lexicon)


def _entropy_gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _thresholds(values: list[float], most: int = 40) -> list[float]:
    """Midpoints between neighbouring distinct values, thinned to quantiles of them."""
    v = sorted(set(values))
    mids = [(a + b) / 2 for a, b in zip(v, v[1:])]
    return mids if len(mids) <= most else [mids[i * len(mids) // most] for i in range(most)] + [mids[-1]]


def _holds(x: tuple, c: tuple[str, str, float]) -> bool:
    v = x[FEATURES.index(c[0])]
    return v <= c[2] if c[1] == "<=" else v >= c[2]


def grow(rows: list[tuple[tuple, bool]], most: int = 4) -> list[tuple[str, str, float]]:
    """Adds the threshold of the highest gain until no good row is covered or no threshold gains."""
    rule, left = [], rows
    while len(rule) < most:
        p0 = sum(b for _, b in left)
        n0 = len(left) - p0
        if not p0 or not n0:
            break
        best = (1e-9, None)
        for k, f in enumerate(FEATURES):
            ordered = sorted((x[k], b) for x, b in left)
            values = [v for v, _ in ordered]
            sums = [0]
            for _, b in ordered:
                sums.append(sums[-1] + b)
            at = 0
            for t in _thresholds(values):
                while at < len(values) and values[at] <= t:
                    at += 1
                p, n = sums[at], at - sums[at]
                best = max(best, (_entropy_gain(p, n, p0, n0), (f, "<=", t)), (_entropy_gain(p0 - p, n0 - n, p0, n0), (f, ">=", t)), key=lambda g: g[0])
        if best[1] is None:
            break
        rule.append(best[1])
        left = [r for r in left if _holds(r[0], best[1])]
    return rule


def _worth(rule, rows) -> float:
    p = sum(b for x, b in rows if all(_holds(x, c) for c in rule))
    n = sum(not b for x, b in rows if all(_holds(x, c) for c in rule))
    return (p - n) / (p + n) if p + n else -1.0


def cover(data: list[tuple[tuple, bool, bool]], precision: float = 0.95, most: int = 12) -> list[Rule]:
    """Sequential covering: rows are (features, bad, in the growing part)."""
    growing, pruning = [(x, b) for x, b, g in data if g], [(x, b) for x, b, g in data if not g]
    rules: list[Rule] = []
    while len(rules) < most and any(b for _, b in growing):
        rule = grow(growing)
        if not rule:
            break
        # prune: the shortest beginning of the rule that is worth most on rows it was not grown from
        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (_worth(r, pruning), -len(r)))
        held = [[b for x, b in part if all(_holds(x, c) for c in rule)] for part in (growing, pruning)]
        # precise on rows that it was not grown from, and so on those too
        if sum(map(sum, held)) < 3 or not held[1] or any(sum(h) < precision * len(h) for h in held):
            break
        rules.append(Rule(tuple(rule)))
        growing = [(x, b) for x, b in growing if not all(_holds(x, c) for c in rule)]
        pruning = [(x, b) for x, b in pruning if not all(_holds(x, c) for c in rule)]
    return rules


def apply_rules(docs: DataFrame, rules: RuleList, text: str = "text") -> DataFrame:
    """Adds the base statistics as columns __a_*, __failed, __rule (number of the rule that rejects) and __kept; docs must have no such names."""
    df = text_stats(docs, text, rules.lexicon)
    # the verdict is a generated value, so a filter on it is not pushed into the statistics and computed twice
    df = barrier(df, __failed=base_failed(), __rule=rules.rejects(), __kept=~base_failed() & rules.rejects().isNull())
    return df.drop(*FEATURE_COLUMNS.values())


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the list learned from labels keeps, with their own columns, whatever their names."""
    # the statistics see columns of names that are surely free, and the documents' own get theirs back
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text = own[next(c for c in docs.columns if c.lower() == "text")]
    kept = apply_rules(docs.select(*(named(c).alias(n) for c, n in own.items())), fit(docs, labels), text).filter("__kept")
    return kept.select(*(F.col(n).alias(c) for c, n in own.items()))
