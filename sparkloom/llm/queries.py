"""The queries of this subpackage over the given tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cdc, chat, decontam, divergence, jaccard, langid, linedup, mixing, quality, search, secrets, tokens, warc
from .common import Scratch, ship


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: The conversation that the contract adds.
SAMPLE = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", SAMPLE), (-7, 1, "assistant", SAMPLE)], "conv_id long, turn long, role string, text string")
    return chat.digest_chats(chat.format_chats(turns.unionByName(more))).drop("n_tokens")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rules = quality.fit(docs, _read(spark, sf_dir, "labels"))
    judged = quality.apply_rules(docs.select("doc_id", "text"), rules)
    return judged.select("doc_id", *(F.col(c).alias(b) for b, c in quality.BASE_COLUMNS.items()), F.col("__failed").alias("base_failed"), F.col("__rule").alias("rule"), F.col("__kept").alias("kept"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").path("pages")
    warc.write_archive(warc.plan_records(_read(spark, sf_dir, "pages")), path)
    rows = warc.read_archive(spark, path)
    # what was read is measured anew where a payload is there; a revisit's figures are those of its header
    read = F.col("payload").isNotNull()
    return rows.select("page_id", F.when(read, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(read, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.repeats(_read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.repeated_runs(_read(spark, sf_dir, "documents")).withColumn("first_doc_ids", F.array_join(F.col("first_doc_ids").cast("array<string>"), ","))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda s: s["rank"] <= 3)
    return found.select("doc_id", *(count(k) for k in secrets.KINDS[:3]), F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("found")).alias("spans"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_read(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).alias("fold"))
    found = langid.identify(docs.select("doc_id", "text"), docs.filter((F.col("fold") != 2) & F.col("lang").isNotNull()).select("text", "lang"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_read(spark, sf_dir, "documents"))


_QUERIES = [op1_chat_format, op2_quality_rules, op3_warc, op4_substring_dedup, op5_line_dedup, op6_secret_scan, op7_jaccard_join, op8_decontaminate, op9_language_id, op10_source_mix, op11_ranked_search, op12_source_divergence, op13_token_counts]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: shipped(f) for f in _QUERIES}


_OP1 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(role) + length(text)
    + (length(role) - length(replace(role, '\', ''))) + (length(text) - length(replace(text, '\', '')))
    + coalesce(list_sum(list_transform(regexp_extract_all(role, '#{3,}'), lambda x: length(x) - 2)), 0)
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
    + (length(role) - length(replace(role, '</turn>', ''))) // 7 + (length(text) - length(replace(text, '</turn>', ''))) // 7
    + (length(role) - length(replace(role, ': ', ''))) // 2
    + length('### ') + length(': ') + length(' </turn>' || chr(10)) AS chars
  FROM t
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP3 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

_OP8 = r"""
WITH u AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'b', item_id, text FROM benchmark
), w AS (
  SELECT side, id, list_filter(list_transform(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda x: trim(lower(x), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~')), lambda x: x <> '') AS w FROM u
), k AS (SELECT DISTINCT least(len(w), 5) AS k FROM w WHERE side = 'b' AND len(w) > 0),
s AS (
  SELECT DISTINCT side, id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS g FROM w JOIN k ON len(w) >= k AND (side = 'd' OR k = least(len(w), 5))
), n AS (SELECT id, count(*) AS n FROM s WHERE side = 'b' GROUP BY id),
c AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS c FROM s b JOIN s d ON b.g = d.g AND b.k = d.k AND b.side = 'b' AND d.side = 'd' GROUP BY 1, 2)
SELECT doc_id, item_id, c.c / n.n AS containment, n.n AS n_shingles FROM c JOIN n ON n.id = c.item_id WHERE c.c / n.n >= 0.8
"""


_OP5 = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
y AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM l),
z AS (
  SELECT doc_id, pos, line, w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS idx, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS cw
  FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM y) WHERE w > 0
), p AS (SELECT a.doc_id, a.idx AS s, b.idx AS e FROM z a JOIN z b ON a.doc_id = b.doc_id AND b.idx >= a.idx AND b.cw - a.cw + a.w >= 50),
win AS (SELECT doc_id, s, min(e) AS e FROM p GROUP BY doc_id, s UNION SELECT doc_id, max(s), e FROM p GROUP BY doc_id, e),
c AS (SELECT win.doc_id, s, e, string_agg(line, chr(10) ORDER BY idx) AS t FROM win JOIN z ON z.doc_id = win.doc_id AND z.idx BETWEEN s AND e GROUP BY ALL),
f AS (SELECT doc_id, s, e, row_number() OVER o AS n, first_value(doc_id) OVER o AS fd FROM c WINDOW o AS (PARTITION BY t ORDER BY doc_id, s)),
gone AS (SELECT f.doc_id, z.idx, z.pos, min(fd) AS fd FROM f JOIN z ON z.doc_id = f.doc_id AND z.idx BETWEEN s AND e WHERE n > 1 GROUP BY ALL),
g AS (SELECT *, idx - row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM gone),
r AS (SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) + 1 AS b FROM g GROUP BY doc_id, run),
d AS (SELECT doc_id, string_agg(CAST(fd AS VARCHAR), ',' ORDER BY fd) AS first_doc_ids FROM (SELECT DISTINCT doc_id, fd FROM gone) GROUP BY doc_id)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_removed, string_agg(a || ':' || b, ',' ORDER BY a) AS runs, any_value(first_doc_ids) AS first_doc_ids FROM r JOIN d USING (doc_id) GROUP BY doc_id
"""

_OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(1) ORDER BY g)) AS fp FROM s GROUP BY doc_id),
f AS (SELECT fp, min(doc_id) AS rep, count(*) AS n_copies, any_value(n) AS n FROM n GROUP BY fp),
rs AS (SELECT s.doc_id, s.g FROM s JOIN f ON s.doc_id = f.rep),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM rs a JOIN rs b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN f fa ON fa.rep = a JOIN f fb ON fb.rep = b WHERE 5 * c >= 4 * (fa.n + fb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT rep AS id, rep AS root FROM f UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.id),
k AS (SELECT id, min(root) AS class_id FROM reach GROUP BY id),
d AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT n.doc_id, class_id, n.doc_id = class_id AS representative, coalesce(n_links, 0) AS n_links, n_copies FROM n JOIN f USING (fp) JOIN k ON k.id = f.rep LEFT JOIN d ON d.a = f.rep
UNION ALL SELECT doc_id, doc_id, true, 0, 1 FROM w WHERE len(w) = 0
"""


_OP11 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS often FROM q GROUP BY ALL),
x AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM d),
p AS (SELECT doc_id, term, any_value(size) AS size, count(*) AS tf FROM x WHERE term IN (SELECT term FROM qt) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000.0 * ln(CAST(2 * any_value(n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term),
r AS (
  SELECT item_id, doc_id, CAST(sum(often * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * size * n) // l))))) AS BIGINT) AS score
  FROM qt JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id
), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""

_OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), o AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total) AS n_lang FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT s.lang, s.source, kept.term, coalesce(c.n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (s.total + 2 * v.v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (kept.total + 2) // (v.n_lang + 2 * v.v) AS q
  FROM s JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = kept.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
    ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), f AS (
  SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
), k AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": _OP1, "op3_warc": _OP3, "op5_line_dedup": _OP5, "op7_jaccard_join": _OP7, "op8_decontaminate": _OP8, "op11_ranked_search": _OP11, "op12_source_divergence": _OP12}
