"""Versions, dates, numbers and JSON as Column expressions. Ids in brackets are those of the survey's inventory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import calculate
from .text import C, col

# versions ----------------------------------------------------------------------------------------------------------------------

_SEMVER = r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"


def version_key(c: C) -> Column:
    """Sort key of a tag [SC-V1]: numbers, then 1 for a release and 0 for a prerelease, then the prerelease's parts.

    Letters and digits of a part such as rc10 count as two, so rc9 sorts before rc10; numeric parts sort before words, as numbers.
    Null for what is no full version."""
    x = F.regexp_replace(col(c), r"(?i)-([a-z]+)(\d+)", "-$1.$2")
    pre = F.regexp_extract(x, _SEMVER, 4)
    parts = F.transform(F.filter(F.split(pre, r"\."), lambda p: p != ""), lambda p: F.struct((~p.rlike(r"^\d+$")).cast("int").alias("word"), F.coalesce(p.try_cast("bigint"), F.lit(0)).alias("n"), F.when(p.rlike(r"^\d+$"), "").otherwise(p).alias("s")))
    n = lambda i: F.regexp_extract(x, _SEMVER, i).try_cast("bigint")
    return F.when(x.rlike(_SEMVER), F.struct(n(1).alias("major"), n(2).alias("minor"), n(3).alias("patch"), (pre == "").cast("int").alias("release"), parts.alias("pre")))


def is_prerelease(c: C) -> Column:
    """[SC-V2]: a full version by its prerelease part, anything else by a hyphen."""
    x = F.regexp_replace(col(c), "^v", "")
    return F.when(x.rlike(_SEMVER), F.regexp_extract(x, _SEMVER, 4) != "").otherwise(F.contains(x, F.lit("-")))


def is_stable(tag: C, draft: C) -> Column:
    """[F7]"""
    return ~F.coalesce(col(draft), F.lit(False)) & col(tag).rlike(_SEMVER) & ~is_prerelease(tag)


def series(c: C) -> Column:
    """major.minor, or null [SC-V3]."""
    return F.nullif(F.regexp_extract(F.coalesce(col(c).cast("string"), F.lit("")), r"^v?(\d+\.\d+)", 1), F.lit(""))


def normal_tag(c: C) -> Column:
    """A tag with its v [SC-V4]."""
    return F.concat(F.lit("v"), F.regexp_replace(F.trim(col(c)), "^v", ""))


def removes_deprecated(version: C, major: int = 26, minor: int = 1) -> Column:
    """Whether a version deletes deprecated settings; one without a number does [SC-V5, N13]."""
    found = F.regexp_extract(col(version), r"(\d+)(?:\.(\d+))?", 1)
    low = F.coalesce(F.regexp_extract(col(version), r"(\d+)(?:\.(\d+))?", 2).try_cast("int"), F.lit(0))
    high = found.try_cast("int")
    return F.coalesce(~((high < major) | ((high == major) & (low < minor))), F.lit(True))


def version_at_least(have: C, want: C) -> Column:
    """[SC-V6]"""
    key = lambda c: F.transform(F.split(F.regexp_extract(col(c), r"(\d+(?:\.\d+)*)", 1), r"\."), lambda p: p.try_cast("int"))
    return key(have) >= key(want)


# dates -------------------------------------------------------------------------------------------------------------------------


def add_months_overflow(d: C, months: int | Column) -> Column:
    """A date some months on, where days past a month's end run into the next [N1]."""
    x = col(d)
    return F.date_add(F.add_months(F.trunc(x, "MM"), months), F.dayofmonth(x) - 1)


def end_of_life(release: C, now: C, months: int = 12, weeks: int = 6) -> Column:
    """[SC-D1]: label, whether it is near, whether it is past. At the very moment it is neither [N2]; a date that cannot be read gives null."""
    d = F.to_date(F.try_to_timestamp(col(release).cast("string"), F.lit("yyyy-MM-dd")))
    eol = add_months_overflow(d, months)
    at, warn = eol.cast("timestamp"), F.date_sub(eol, weeks * 7).cast("timestamp")
    t = col(now)
    return F.when(d.isNotNull(), F.struct(F.date_format(eol, "MMMM d, yyyy").alias("label"), ((t >= warn) & (t < at)).alias("is_near"), (t > at).alias("is_past")))


def epoch_date(c: C) -> Column:
    """[SC-D2]"""
    return F.date_format(F.timestamp_seconds(col(c)), "yyyy-MM-dd")


#: Milliseconds of each unit, largest first; weeks are there and months are not [N6].
TIME_UNITS = [(365 * 86_400_000, "year"), (7 * 86_400_000, "week"), (86_400_000, "day"), (3_600_000, "hour"), (60_000, "minute"), (1000, "second"), (1, "millisecond")]


def human_time(value: C, unit: C) -> Column:
    """The largest unit that divides a time; units other than s count as milliseconds [SC-D4, N7]."""
    v, seconds = col(value).cast("bigint"), col(unit) == "s"
    ms = F.when(seconds, v * 1000).otherwise(v)
    out = F.concat(v.cast("string"), F.when(seconds, " seconds").otherwise(" milliseconds"))
    for size, name in reversed(TIME_UNITS):
        n = F.floor(ms / F.lit(size)) if size > 1 else ms
        out = F.when((ms >= size) & (ms % size == 0), F.concat(n.cast("bigint").cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"))).otherwise(out)
    return out


def chrono_ms(c: C) -> Column:
    """24h, 1.5h, 7 * 24h or any other expression of durations, in whole milliseconds [SC-D3]."""
    return calculate(c).cast("bigint")


def uptime(seconds: C) -> Column:
    """[SC-D5]"""
    s = col(seconds).cast("bigint")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor((s % 3600) / 60).cast("string"), F.lit("m"))


# numbers -----------------------------------------------------------------------------------------------------------------------

#: Size suffixes of literals.
SIZES = {"_GiB": 1024**3, "_MiB": 1024**2, "_KiB": 1024, "_GB": 1000**3, "_MB": 1000**2, "_KB": 1000}


def parse_size(c: C) -> Column:
    """256_MiB, 1'024_KiB, 1048576ULL as bytes; null if it is none [SC-M2]."""
    x = F.replace(F.trim(col(c)), F.lit("'"), F.lit(""))
    suffix = F.regexp_extract(x, "(" + "|".join(SIZES) + ")$", 1)
    unit = F.create_map(*(F.lit(v) for k, n in SIZES.items() for v in (k, n)))[suffix]
    number = F.regexp_replace(F.when(suffix == "", F.regexp_replace(x, r"[uUlLzZ]+$", "")).otherwise(F.left(x, F.length(x) - F.length(suffix))), r"^\s+|\s+$", "")
    return F.when(x != "", number.try_cast("bigint") * F.coalesce(unit, F.lit(1)))


def friendly_size(c: C) -> Column:
    """256 MiB (268435456): the largest unit that divides [SC-M3]."""
    v = col(c).cast("bigint")
    out = v.cast("string")
    for name, size in (("KiB", 1024), ("MiB", 1024**2), ("GiB", 1024**3)):
        out = F.when((v >= size) & (v % size == 0), F.concat((v / size).cast("bigint").cast("string"), F.lit(f" {name} ("), v.cast("string"), F.lit(")"))).otherwise(out)
    return out


def arithmetic(c: C) -> Column:
    """One operation on two whole numbers, cut to a whole number; null for anything else or a division by zero [SC-M1]."""
    pattern = r"^\s*(-?\d+)\s*([-+*/])\s*(-?\d+)\s*$"
    x = col(c)
    a, op, b = F.regexp_extract(x, pattern, 1).try_cast("bigint"), F.regexp_extract(x, pattern, 2), F.regexp_extract(x, pattern, 3).try_cast("bigint")
    return F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).when((op == "/") & (b != 0), (a / F.nullif(b, F.lit(0))).cast("bigint")).otherwise(x.try_cast("bigint"))


def int_bounds(kind: C) -> Column:
    """Least and largest value of int8_t .. uint64_t, as decimals since uint64 has no other type [SC-M4]."""
    number = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    out = F.lit(None)
    for bits in (8, 16, 32, 64):
        signed = F.struct(number(-(2 ** (bits - 1))).alias("minimum"), number(2 ** (bits - 1) - 1).alias("maximum"))
        out = F.when(col(kind) == f"int{bits}_t", signed).when(col(kind) == f"uint{bits}_t", F.struct(number(0).alias("minimum"), number(2**bits - 1).alias("maximum"))).otherwise(out)
    return out


def retry_delay(attempt: C, first_ms: int = 1000, most_ms: int = 10_000, jitter: C | None = None) -> Column:
    """Milliseconds to wait after a failed attempt (0, 1, ...): doubled each time up to a limit, and up to 30 % more by `jitter` in [0, 1), random if none is given [SC-M6]."""
    base = F.least(F.lit(float(most_ms)), first_ms * F.pow(F.lit(2.0), col(attempt)))
    return F.floor(base + (F.rand() if jitter is None else col(jitter)) * 0.3 * base).cast("long")


def progress(done: C, total: C) -> Column:
    """Rounded per cent between 0 and 100 [SC-M5]."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(col(done) / col(total) * 100).cast("int")))


# JSON --------------------------------------------------------------------------------------------------------------------------


def canonical(c: C) -> Column:
    """Text that is equal for equal JSON whatever the order of keys [DIFF6, T10]; 1 and 1.0 agree, text that is no JSON stays."""
    x = col(c)
    parsed = F.to_json(F.try_parse_json(x))
    # a cast alone would take 1d, 1f and NaN for numbers
    plain = F.when(x.rlike(r"^\s*-?(0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?\s*$"), x.try_cast("double"))
    return F.when(plain.isNotNull(), plain.cast("string")).otherwise(F.coalesce(parsed, x))


def json_equal(a: C, b: C) -> Column:
    """Deep equality of JSON texts, where a missing value (SQL null) differs from JSON null [N3, N4]."""
    return F.when(col(a).isNull() & col(b).isNull(), True).when(col(a).isNull() | col(b).isNull(), False).otherwise(canonical(a) == canonical(b))


def truthy(c: C) -> Column:
    """Whether a text value counts as set: not null, not empty, not 0, not false [N25]."""
    x = col(c)
    return F.coalesce(~x.isin("", "0", "false"), F.lit(False))
