"""Secret scans with multipart credential linking, in DataFrame functions alone.

Strong findings stand by themselves: assignments to a secret-like name, access identifiers and long hexadecimal strings. Weak
candidates (an identifier-like or secret-like value, an endpoint) are too common to report alone; the parts of each text are joined
by interval: a weak candidate is reported only where, within SCOPE code points and without overlap, a complementary part occurs: a
secret or an endpoint for an identifier, an identifier or an endpoint for a secret, an identifier or a secret for an endpoint. For the
join each part gives two rows, its start and its end; a start looks back over the ends, and an end ahead over the starts, at most SCOPE
code points away, by range windows, so that no pairs are formed.

Places are code points, end exclusive. A match's place is a running sum of the lengths of the matches and of what lies between them. A
pattern is only tried on texts that hold a sign or run that every match has.

Defined cases: null text counts as empty; repeated rows are scanned one by one; equal spans of two kinds are both reported; empty
tables give empty ones; only the id and text columns are read. A text holds finitely many parts, so a row's parts stay one row's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import barrier

SCOPE = 400

#: The base kinds in their order, then the weak ones; pattern, group, and least length of the group.
_NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
VALUE = rf"""^(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]{24,}"
WEAK_ID = r"\b(?:ASIA|AIDA|AROA|AGPA)[A-Z0-9]{12,}|\b(?:[Cc]lient|[Aa]ccess|[Aa]ccount|[Uu]ser|[Ll]ogin)(?:[_-]?(?:[Ii][Dd]|[Nn]ame|[Kk]ey))?[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{6,}"
WEAK_SECRET = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{32,}(?![A-Za-z0-9+/_-])={0,2}"
ENDPOINT = r"\b(?:https?|ftp|s3|gs|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>|]+"
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]
ROLES = {"access": "id", "weak_id": "id", "assign": "secret", "hex": "secret", "weak_secret": "secret", "endpoint": "endpoint"}


PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "weak_id": WEAK_ID, "weak_secret": WEAK_SECRET, "endpoint": ENDPOINT}
KEEP = {"assign": lambda m: F.length(F.regexp_extract(m, VALUE, 1)) >= 6, "access": lambda m: F.length(m) >= 20}
#: What every match of a kind has, cheaply tested.
MAY = {
    "assign": lambda t: t.contains(":") | t.contains("="),
    "access": lambda t: t.contains("AKIA"),
    "hex": lambda t: t.rlike("[0-9a-f]{24}"),
    "weak_id": lambda t: t.contains(":") | t.contains("=") | t.rlike("A(?:SI|ID|RO|GP)A"),
    "weak_secret": lambda t: t.rlike("[A-Za-z0-9+/_-]{32}"),
    "endpoint": lambda t: t.contains("://"),
}


def _pieces(text: Column, found: Column, pattern: str, kind: str) -> Column:
    """For each of the leftmost matches that do not overlap: its number, the length of the text since the last one, and its own."""
    keep = KEEP.get(kind, lambda m: F.lit(True))
    both = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))
    rows = F.transform(both, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), F.length(x["m"]).alias("n"), keep(x["m"]).alias("ok")))
    return F.when(F.size(found) > 0, rows).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:int,n:int,ok:boolean>>"))


def parts(df: DataFrame, text: str, rid: str) -> DataFrame:
    """(rid, doc_id, kind, start, end): all strong and weak parts of the texts; for a text without any, one row of nulls."""
    t, none = F.col(text), F.array().cast("array<string>")
    df = barrier(df, **{f"__m_{k}": F.when(MAY[k](t), F.regexp_extract_all(t, F.lit(f"({p})"), F.lit(1))).otherwise(none) for k, p in PATTERNS.items()})
    rows = df.select(rid, "doc_id", F.explode_outer(F.concat(*(_pieces(t, F.col(f"__m_{k}"), p, k) for k, p in PATTERNS.items()))).alias("s")).select(rid, "doc_id", "s.*")
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy(rid, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    rows = rows.withColumn("end", end).select(rid, "doc_id", "kind", (F.col("end") - F.col("n")).alias("start"), "end", "ok")
    # a match that is too short is no part, but its text must keep a row
    return rows.select(rid, "doc_id", *(F.when(F.col("ok"), F.col(c)).alias(c) for c in ("kind", "start", "end")))


def link(rows: DataFrame, rid: str, scope: int = SCOPE) -> DataFrame:
    """Interval join within each text: each part (rid, kind, start, end) twice, with `stands`: true for strong ones and for weak ones with a complementary part within `scope` that does not overlap, after it in one of the two rows, before it in the other."""
    role = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))[F.col("kind")]
    rows = rows.withColumn("role", role).withColumn("is_end", F.explode(F.array(F.lit(False), F.lit(True))))
    rows = rows.withColumn("at", F.when(F.col("is_end"), F.col("end")).otherwise(F.col("start")))
    order = Window.partitionBy(rid).orderBy("at")
    back, ahead = order.rangeBetween(-scope, 0), order.rangeBetween(0, scope)
    for r in ("id", "secret", "endpoint"):
        here = F.col("role") == r
        rows = rows.withColumn(f"near_{r}", F.when(F.col("is_end"), F.max((here & ~F.col("is_end")).cast("int")).over(ahead)).otherwise(F.max((here & F.col("is_end")).cast("int")).over(back)) == 1)
    near = {r: F.coalesce(F.col(f"near_{r}"), F.lit(False)) for r in ("id", "secret", "endpoint")}
    linked = F.when(F.col("role") == "id", near["secret"] | near["endpoint"]).when(F.col("role") == "secret", near["id"] | near["endpoint"]).otherwise(near["id"] | near["secret"])
    return rows.withColumn("stands", F.col("kind").isin(KINDS[:3]) | linked).drop("role", "is_end", "at", *(f"near_{r}" for r in near))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of docs: id, and `found`, an array of (start, rank of kind, kind, end) in order, linked weak parts among them."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("rid"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    part = F.when(F.col("kind").isNotNull() & F.col("stands"), F.struct("start", rank.alias("rank"), "kind", "end"))
    return link(parts(df, "text", "rid"), "rid", scope).groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_set(part)).alias("found")).drop("rid")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
