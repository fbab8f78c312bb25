"""Row predicates as Columns. Ids in brackets are those of the survey's inventory; '' counts as missing where the text says "set" [N25]."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import truthy
from ..functions.text import C, col


def any_of(tests: list[Column], default: bool = False) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(default)


def indexable(out: C, attributes: C) -> Column:
    """Pages with output, not marked noindex or field-only [F1]."""
    a = col(attributes)
    return col(out).isNotNull() & ~truthy(a["noindex"]) & ~truthy(a["fields-only"])


def latest_only(pages: DataFrame, latest: DataFrame) -> DataFrame:
    """Pages of each component's latest version [F2]: a semi-join; latest has (component, version)."""
    return pages.join(latest, ["component", "version"], "left_semi")


def gather_items(pages: DataFrame, url: str, part: str, deployment: str | None = None) -> DataFrame:
    """[F3]"""
    return pages.filter(F.contains(F.col(url), F.lit(part)) & (F.lit(True) if deployment is None else F.col("deployment") == deployment))


def matches(c: C, include: list[str], exclude: list[str]) -> Column:
    """Matches some include pattern, all if there are none, and no exclude pattern [F4]."""
    return any_of([col(c).rlike(p) for p in include], default=True) & ~any_of([col(c).rlike(p) for p in exclude])


def external(host: C, internal: list[str]) -> Column:
    """[F5]"""
    return ~F.coalesce(F.lower(col(host)).isin(internal), F.lit(False))


def unpublished(attributes: C, prerelease: C) -> Column:
    """[F6]"""
    a = col(attributes)
    return truthy(a["page-unpublish"]) | (truthy(a["page-publish-only-during-beta"]) & ~F.coalesce(col(prerelease), F.lit(False)))


def in_range(key: C, low: Column, high: Column) -> Column:
    """Closed range on version keys [F8]."""
    return (col(key) >= low) & (col(key) <= high)


def jobs(df: DataFrame, status: str | None = None, tool: str | None = None) -> DataFrame:
    """Jobs by optional status and tool, newest first [F9]."""
    for c, v in (("status", status), ("tool", tool)):
        df = df if v is None else df.filter(F.col(c) == v)
    return df.orderBy(F.desc("created_at"), "job_id")


#: States that a job does not leave.
TERMINAL = ["completed", "failed"]


def expired_jobs(now: Column, max_age_ms: int) -> Column:
    """Ended jobs strictly older than max_age_ms, by completion or else creation [F10]."""
    age = (F.unix_millis(now) - F.unix_millis(F.coalesce(F.col("completed_at"), F.col("created_at")))) > max_age_ms
    return F.col("status").isin(TERMINAL) & age


def expired(expires_at: C, now: Column) -> Column:
    """Past its time to live; no time means it never is [F11]."""
    return F.coalesce(now > col(expires_at), F.lit(False))


def component_filter(name_part: str = "", types: list[str] = (), supports: list[str] = (), cloud: bool | None = None, enterprise: bool | None = None) -> Column:
    """Table filter in which an empty choice is no constraint [F12]. Columns: name, types, supports (arrays), cloud, enterprise."""
    out = F.contains(F.lower("name"), F.lit(name_part.lower()))
    if types:
        out &= F.arrays_overlap("types", F.array(*map(F.lit, types)))
    if supports:
        out &= F.arrays_overlap("supports", F.array(*map(F.lit, supports)))
    if cloud is not None:
        out &= F.col("cloud") == cloud
    if enterprise is not None:
        out &= F.col("enterprise") == enterprise
    return out


def keep_attributes(attributes: C, allowed: list[str], prefix: str = "learning-objective") -> Column:
    """[F13]"""
    return F.map_filter(col(attributes), lambda k, v: k.isin(allowed) | k.startswith(prefix))


def public_fields(fields: C) -> Column:
    """Fields without a leading underscore [F14, F15]."""
    return F.filter(col(fields), lambda f: ~f["name"].startswith("_"))


def drop_empty_definitions(df: DataFrame, fields: str = "fields") -> DataFrame:
    """[F14]"""
    return df.withColumn(fields, public_fields(fields)).filter(F.size(fields) > 0)


def public_property(name: C, experimental: C) -> Column:
    """[F15]"""
    return ~col(name).startswith("_") & ~F.coalesce(col(experimental), F.lit(False))


def under_any(path: C, roots: list[str], sep: str = " ") -> Column:
    """The path is one of the roots or lies under one [F16, F34]."""
    return any_of([(col(path) == r) | col(path).startswith(r + sep) for r in roots])


def ancestors(path: C, sep: str = " ") -> Column:
    """The path and all paths above it [F17, J27]."""
    parts = F.split(col(path), F.lit(f"\\Q{sep}\\E"))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep))


def under_flagged(df: DataFrame, flagged: DataFrame, path: str = "path", sep: str = " ") -> DataFrame:
    """Rows with some flagged path above them or at them, as a semi-join over exploded ancestors [F17]."""
    rows = df.select(path, F.explode(ancestors(path, sep)).alias("__a")).join(flagged.select(F.col(path).alias("__a")), "__a", "left_semi").select(path).distinct()
    return df.join(rows, path, "left_semi")


def valid_property_name(c: C) -> Column:
    """[F18]"""
    x = col(c)
    return x.rlike(r"^[a-z][a-z0-9]*([._-][a-z0-9]+)*$") & F.length(x).between(3, 100)


#: Parts of a name that mark object storage.
OBJECT_STORAGE = ["cloud_storage", "s3_", "azure_", "gcs_", "archival_", "remote_", "tiered_"]


def object_storage(c: C) -> Column:
    """[F19]"""
    return any_of([F.contains(col(c), F.lit(p)) for p in OBJECT_STORAGE])


def problematic(c: C) -> Column:
    """Content that a writer must look at: placeholders and unresolved markup [F21]."""
    return col(c).rlike(r"(?i)\b(todo|fixme|tbd|xxx)\b|\{\{|\}\}|<<<|>>>")


def split_fields(fields: C) -> Column:
    """Fields without deprecated ones, in common and advanced ones [F22]."""
    live = F.filter(col(fields), lambda f: ~F.coalesce(f["is_deprecated"], F.lit(False)))
    advanced = lambda f: F.coalesce(f["is_advanced"], F.lit(False))
    return F.struct(F.filter(live, lambda f: ~advanced(f)).alias("common"), F.filter(live, advanced).alias("advanced"))


def listed_page(relative: C, url: C, default_urls: list[str] = ()) -> Column:
    """[F23]"""
    return ~col(relative).rlike(r"(^|/)(404|search|index)\.adoc$") & ~col(url).isin(list(default_urls) or [""])


def link_verdict(status: C) -> Column:
    """ok below 400, broken at 404 and 410, else unverifiable; no status is unverifiable [F24]."""
    return F.when(col(status) < 400, "ok").when(col(status).isin(404, 410), "broken").otherwise("unverifiable")


def retryable(status: C, code: C) -> Column:
    """[F26]"""
    return F.coalesce(col(status).isin(403, 429) | (col(status) >= 500), F.lit(False)) | F.coalesce(col(code).isin("ECONNRESET", "ETIMEDOUT", "ENOTFOUND", "EAI_AGAIN"), F.lit(False))


def tag_selected(tags: C, wanted: str) -> Column:
    """Tag expression: parts apart by ; or comma, ! excludes, * is any tag, ** any line [F28]."""
    t = col(tags)
    parts = [p.strip() for p in wanted.replace(";", ",").split(",") if p.strip()]
    has = lambda p: F.lit(True) if p == "**" else F.size(t) > 0 if p == "*" else F.array_contains(t, p)
    positive, negative = [p for p in parts if p[0] != "!"], [p[1:] for p in parts if p[0] == "!"]
    return any_of([has(p) for p in positive], default=True) & ~any_of([has(p) for p in negative])


def build_constraint(tags: C, expression: str) -> Column:
    """A build constraint of names, !, &&, || and brackets over an array of tags [F27]."""
    import re

    tokens = re.findall(r"&&|\|\||[!()]|[\w.]+", expression)

    def either(at):
        left, at = both(at)
        while at < len(tokens) and tokens[at] == "||":
            right, at = both(at + 1)
            left = left | right
        return left, at

    def both(at):
        left, at = one(at)
        while at < len(tokens) and tokens[at] == "&&":
            right, at = one(at + 1)
            left = left & right
        return left, at

    def one(at):
        if tokens[at] == "!":
            inner, at = one(at + 1)
            return ~inner, at
        if tokens[at] == "(":
            inner, at = either(at + 1)
            return inner, at + 1
        return F.array_contains(col(tags), tokens[at]), at + 1

    return either(0)[0]


def truthy_flag(c: C) -> Column:
    """[F30]"""
    return F.coalesce(F.lower(col(c)).isin("yes", "ok", "1", "true"), F.lit(False))


def invalid_values(df: DataFrame, key: str, checks: dict[str, list[str]]) -> DataFrame:
    """Findings (key, field, value) for values outside their lists [F31]."""
    out = None
    for field, allowed in checks.items():
        rows = df.filter(F.col(field).isNotNull() & ~F.col(field).isin(allowed)).select(key, F.lit(field).alias("field"), F.col(field).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


#: Lint rules over lines; the first needs look-behind, which Java has.
LINT = {
    "raw-url": r"(?<![\[:\"'(<`])\bhttps?://[^\s\[\]]+(?!\S*\[)",
    "invalid-xref": r"xref:[^\[]*\s[^\[]*\[",
    "markdown-emphasis": r"\*\*[^*\s][^*]*\*\*",
    "truncated": r"(?:\.\.\.|…)\s*$",
    "inline-caps": r"\b[A-Z]{5,}(?:\s+[A-Z]{4,})+\b",
    "coming-soon": r"(?i)\bcoming soon\b",
    "bang-bang": r"!!",
}


def lint(pages: DataFrame, path: str = "path", contents: str = "contents") -> DataFrame:
    """(path, line, rule, text): lines that break a rule, and lines of over 40 characters that a page has twice [F32]."""
    lines = pages.select(path, F.posexplode(F.split(contents, "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)
    hit = F.filter(F.array(*(F.when(F.col("text").rlike(p), F.lit(r)) for r, p in LINT.items())), lambda r: r.isNotNull())
    broken = lines.select(path, "line", F.explode(hit).alias("rule"), "text")
    firsts = lines.filter(F.length(F.trim("text")) > 40).groupBy(path, "text").agg(F.min("line").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = lines.join(firsts, [path, "text"]).filter("line > first").select(path, "line", F.lit("duplicate-content").alias("rule"), "text")
    return broken.unionByName(again)


def feature_status(status: C, beta: C) -> Column:
    """An explicit valid status wins, an invalid or empty one is unreleased, else beta by flag, else ga [F33, N31]."""
    s = col(status)
    return F.when(s.isin("ga", "beta", "unreleased", "deprecated"), s).when(s.isNotNull(), "unreleased").when(truthy(col(beta).cast("string")), "beta").otherwise("ga")


def override_action(description: C) -> Column:
    """Whether a description is long enough to be appended rather than replaced [F35]."""
    return F.when((F.length(col(description)) > 100) & (F.size(F.split(col(description), r"\n\s*\n")) > 1), "append").otherwise("replace")


def drop_examples(text: C, patterns: list[str]) -> Column:
    """Drops a comment line and the command line after it when either matches, and folds blank lines [F36]."""
    lines = F.split(col(text), "\n", -1)
    hit = lambda x: any_of([x.rlike("(?i)" + p) for p in patterns])
    comment = lambda x: x.rlike(r"^\s*#")
    # a line goes if it matches, if it is a comment before a line that matches, or a command after a comment that matches
    at = lambda i: F.coalesce(F.get(lines, i), F.lit(""))
    kept = F.filter(lines, lambda x, i: ~(hit(x) | (comment(x) & ~comment(at(i + 1)) & hit(at(i + 1))) | (~comment(x) & (F.trim(x) != "") & comment(at(i - 1)) & hit(at(i - 1)))))
    return F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n")
