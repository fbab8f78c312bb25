"""Ranked search, divergence audit and token counts against brute force and the library, and the cases of their docstrings."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from sparkloom.llm import divergence, search, terms, tokens

LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
WORDS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOC = "doc_id long, text string, lang string, source string"


def random_text(r, n, pool="ab Cé日1.\n_ÀZ~\x7f"):
    return "".join(r.choice(pool) for _ in range(n))


# terms ---------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [16, 200, 1 << 21])
@pytest.mark.parametrize(("table", "pattern"), [(terms.LETTERS, LETTERS), (terms.WORDS, WORDS)])
def test_terms_of_many_texts(monkeypatch, block, table, pattern):
    monkeypatch.setattr(terms, "BLOCK", 32)
    r = random.Random(1)
    texts = [random_text(r, r.choice([0, 1, 5, 40, 300])) for _ in range(80)] + [None, "", "é" * 200, "x" * 90 + " " + "y" * 90]
    for column in (pa.array(texts), pa.array([*texts, "more"]).slice(0, len(texts)), pa.array(texts, pa.large_string())):
        seen = 0
        for m in terms.counted(column, table, block):
            for i in range(len(m.indptr) - 1):
                got = {m.terms[k].decode(): int(n) for k, n in zip(m.term[m.indptr[i] : m.indptr[i + 1]], m.count[m.indptr[i] : m.indptr[i + 1]], strict=True)}
                assert got == Counter(pattern.findall((texts[m.first + i] or "").translate(LOWER)))
                seen += 1
        assert seen == len(texts)
    assert list(terms.counted(pa.array([], pa.string()), table)) == []


def test_equal_hashes_do_not_join_terms():
    """A hash that is nearly always the same: bytes decide."""
    data = np.frombuffer(b"abcabdabcabxyabc", np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 11, 13]), np.array([3, 6, 9, 11, 13, 16])
    for digest in (xxhash.xxh64_intdigest, lambda x, seed: 7, lambda x, seed: len(x)):
        group, first = terms.grouped(data, starts, ends, digest)
        words = [data[a:z].tobytes() for a, z in zip(starts, ends, strict=True)]
        assert [words[first[g]] for g in group] == words and len(set(group.tolist())) == len(set(words))


# 11 ------------------------------------------------------------------------------------------------------------------------------


def brute_search(docs, items, k=10):
    found = [(i, WORDS.findall((t or "").translate(LOWER))) for i, t in docs]
    n, total = sum(1 for _, w in found if w), sum(len(w) for _, w in found)
    df = Counter(t for _, w in found for t in set(w))
    tfs = [(i, len(w), Counter(w)) for i, w in found]
    out = []
    for item, text in items:
        scores = []
        for i, size, tf in tfs:
            s = 0
            for t in WORDS.findall((text or "").translate(LOWER)):
                if tf[t]:
                    m = 25 + 75 * size * n // total
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus(r, n, vocabulary=300):
    weights = [1 / (k + 1) for k in range(vocabulary)]
    return [" ".join(r.choices([f"W{k}" if k % 3 else f"é{k}" for k in range(vocabulary)], weights, k=r.choice([1, 5, 40, 300]))) for _ in range(n)]


@pytest.mark.parametrize(("docs_in_shard", "entries"), [(16, 40), (1 << 14, 1 << 18)])
def test_search_is_exact(spark, monkeypatch, docs_in_shard, entries):
    r = random.Random(2)
    texts = corpus(r, 240)
    docs = [*enumerate(texts), (500, texts[3]), (400, texts[3]), (None, texts[3]), (7, texts[7]), (600, None), (601, ""), (602, " .\n"), (603, "only here")]
    items = [(k, " ".join(r.choices(texts[k].split(), k=12))) for k in range(20)] + [(50, None), (51, ""), (52, "nowhere at all"), (53, "w0 W0 w0"), (54, "ONLY"), (None, "w1"), (3, "é3")]
    monkeypatch.setattr(search, "DOCS", docs_in_shard)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(3)
    got = search.rank(df, spark.createDataFrame(items, "item_id long, text string"), entries=entries)
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items)


def test_search_of_nothing(spark):
    empty, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.rank(empty, one).collect() == [] and search.rank(one.withColumnRenamed("item_id", "doc_id"), empty.withColumnRenamed("doc_id", "item_id")).collect() == []


def test_blocks_are_the_best_cuts():
    """The dynamic program against all ways to cut, and blocks cover the lists."""
    r = np.random.default_rng(1)
    for _ in range(30):
        sizes = r.integers(1, 120, 6)
        impact, starts = r.integers(0, 1000, sizes.sum()), np.cumsum(sizes) - sizes
        found = search.cut(impact, starts)
        for s, n in zip(starts, sizes, strict=True):
            x, own = impact[s : s + n], [int(b - s) for b in found[(found >= s) & (found < s + n)]] + [int(n)]
            cells = -(-n // search.CELL)
            charge = (x.max() * n - x.sum()) * search.AVERAGE // n
            cost = lambda a, z, x=x, charge=charge: x[a:z].max() * (z - a) - x[a:z].sum() + charge
            best = [0]
            for j in range(1, cells + 1):
                best.append(min(best[i] + cost(i * search.CELL, min(j * search.CELL, n)) for i in range(max(0, j - search.WINDOW), j)))
            assert own[0] == 0 and (cells == 1 or sum(cost(a, z) for a, z in zip(own, own[1:])) == best[-1])


def test_search_opens_few_blocks():
    """Where few documents can reach the threshold, most postings stay closed."""
    n = 16_000
    docs = pa.array(range(n), pa.int64())
    common, rare = np.arange(n), np.arange(100, 140)
    row = {"ids": docs, "sizes": np.full(n, 50), "terms": ["common", "rare"], "dfs": np.array([n, 40]), "ords": np.concatenate([common, rare]).astype(np.int32), "tfs": np.ones(n + 40, np.int32)}
    p = search.prepare(row, n, 50 * n)
    found, scores = search.search(p, ["common", "rare"], np.array([1, 6000]), 10, 1)
    assert set(found[np.argsort(-scores, kind="stable")][:10].tolist()) <= set(rare.tolist()) and p.opened < n // 4


def test_bit_map_has_each_query_term(spark):
    q = search.query_terms(spark.createDataFrame([(1, "Ab é日 ab 9"), (2, None)], "item_id long, text string"))
    assert sorted((x.term, x.often) for x in q.collect()) == [("9", 1), ("ab", 2), ("é日", 1)]
    bits = search.wanted_bits(q)
    assert bits.sum() == 3 and all(bits[xxhash.xxh64_intdigest(t.encode(), terms.SEED) % search.BITS] for t in ("9", "ab", "é日"))


# 12 ------------------------------------------------------------------------------------------------------------------------------


def brute_audit(docs, least, top=10):
    rows = [((lang or ""), (source or ""), Counter(LETTERS.findall((text or "").translate(LOWER)))) for _, text, lang, source in docs]
    out = []
    for lang in {r[0] for r in rows}:
        own = [(s, c) for x, s, c in rows if x == lang]
        df = Counter(t for _, c in own for t in c)
        kept = [t for t in df if df[t] >= least]
        by = defaultdict(Counter)
        for s, c in own:
            by[s].update({t: c[t] for t in kept if t in c})
        share = lambda c, v=len(kept), kept=kept: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v) for t in kept}
        apart = lambda p, q: (p - q) * (p - q) // (p + q)
        p, q = {s: share(c) for s, c in by.items()}, share(sum(by.values(), Counter()))
        for s in by:
            pairs = [(sum(apart(p[s][t], p[o][t]) for t in kept), o) for o in by if o != s]
            words = [(apart(p[s][t], q[t]), t) for t in kept if by[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", words, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("least", [1, 4, 10_000])
def test_audit_is_exact(spark, monkeypatch, least):
    monkeypatch.setattr(divergence, "HELD", 6)
    r = random.Random(3)
    docs = [(k, t, r.choice(["en", "de", None, ""]), r.choice(["hot", "hot", "hot", "a", "b", None, "日"])) for k, t in enumerate(corpus(r, 150, 40))]
    docs += [(900, None, "en", "bare"), (901, "", "fr", "x"), (902, "1 2 3", "fr", "y"), (903, "alone", "it", "one"), docs[0], (None, "w1 W2", "en", "a")]
    df = spark.createDataFrame(docs, DOC).withColumn("count", pa_lit(7)).withColumnRenamed("doc_id", "rank").repartition(4)
    assert sorted(map(tuple, divergence.audit(df, least).collect())) == brute_audit(docs, least)


def pa_lit(v):
    from pyspark.sql import functions as F

    return F.lit(v)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOC)).collect() == []


def test_audit_counts_beyond_64_bits(spark):
    """Shares of counts whose product with the scale is no 64-bit number."""
    from pyspark.sql import functions as F

    big = 4 * 10**15
    row = spark.range(1).select(divergence._share(F.lit(big), F.lit(3 * big + 1), F.lit(7)).alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 2) // (3 * big + 1 + 14)


# 13 ------------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def counter():
    with open(tokens.vocabulary_path(), encoding="utf-8") as f:
        spec = f.read()
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(spec)
    return tokens.Counter(spec), lambda texts: [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


POOL = ["word", "it's", "don't", "'s", "'re", "'ve", "'ll", "'m", "'d", "'S", "''s", "  ", "   x", "\n", "\n\n", "\t", "é日本", "12345", "a1b2", "!?", "...", "q" * 90, " ", "　x", "²", "_", "' s", "   \n  ", "\x1c", "<|endoftext|>", "<|endoftext", "՘", "࢏", "😀", "👩‍👩‍👧", "İ", "ſ", "٣", "Ⅷ", "\x00", "\x85", "'", "l", "t", "aaaaaaa", "ababababab", "'sam", "'ream", "x'll's"]


def test_tokens_as_the_library_counts_them(counter, monkeypatch):
    own, library = counter
    r = random.Random(3)
    texts = ["".join(r.choice(POOL) + r.choice(["", " "]) for _ in range(r.randrange(40))) for _ in range(1500)]
    texts += ["".join(chr(r.choice([r.randrange(1, 128), r.randrange(1, 0x3000), r.randrange(1, 0xD800), r.randrange(0xE000, 0x110000)])) for _ in range(r.randrange(100))) for _ in range(800)]
    texts += ["", "x" * 5000, "".join(r.choice("abcdef") for _ in range(5000)), " " * 5000, "word " * 3000]
    assert own.counts([t.encode() for t in texts]).tolist() == library(texts)
    monkeypatch.setattr(tokens, "BATCH", 64)
    from sparkloom.llm import chat

    monkeypatch.setattr(chat, "PIECE", 20)
    assert own.counts([t.encode() for t in texts[:300]]).tolist() == library(texts[:300])


def test_merging_one_pair_at_a_time_gives_the_same(counter):
    """Rounds that merge all places of each sequence's lowest pair, against a loop that merges one."""
    merges, r = counter[0].merges, random.Random(4)
    rank = {(int(c) // merges.size, int(c) % merges.size): int(k) for c, k in zip(merges.codes, merges.ranks, strict=True)}

    def slow(s):
        s = list(s)
        while True:
            found = min(((rank[p], i) for i, p in enumerate(zip(s, s[1:])) if p in rank), default=None)
            if not found:
                return len(s)
            k, i = found
            s[i : i + 2] = [int(merges.made[k])]

    words = [bytes(r.choice(b"aabcdeth \xc3\xa9") for _ in range(r.randrange(1, 30))) for _ in range(400)]
    symbols = np.concatenate([merges.first[np.frombuffer(w, np.uint8)] for w in words])
    sizes = np.array([len(w) for w in words])
    assert tokens.merged(symbols, sizes, merges).tolist() == [slow(merges.first[np.frombuffer(w, np.uint8)].tolist()) for w in words]


def test_token_counts_of_rows(spark, counter):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x" * 3000 + " <|endoftext|>"), (5, "word " * 1025)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS n_tokens", "1 AS n_bytes")
    want = [(i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(rows, counter[1]([t or "" for _, t in rows]), strict=True)]
    assert sorted(map(tuple, tokens.count_tokens(df).collect()), key=str) == sorted(want, key=str)
    assert tokens.count_tokens(df.limit(0)).collect() == []


def test_other_vocabularies_are_refused():
    plain = {"model": {"type": "BPE", "vocab": {c: i for i, c in enumerate([*tokens.byte_signs().values(), "ab", "abc"])}, "merges": ["a b", "ab c"]}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "added_tokens": []}
    assert tokens.read_merges(plain).made.tolist() == [256, 257]
    for change in ({"model": plain["model"] | {"merges": ["ab c", "a b"]}}, {"model": plain["model"] | {"type": "WordPiece"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"normalizer": {"type": "NFC"}}, {"added_tokens": [{"content": "x", "lstrip": True, "rstrip": False, "single_word": False}]}):
        with pytest.raises(ValueError):
            tokens.read_merges(plain | change)
