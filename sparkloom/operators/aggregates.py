"""Groupings of the inventory. All aggregate before the shuffle but for the sorted lists that are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import C, capitalize, col, title_words, url_path


def sorted_groups(df: DataFrame, group: str, member: str, default: str = "Miscellaneous") -> DataFrame:
    """Members of each group in order; no group means `default`, and names start with a capital [AGG1, AGG8]."""
    g = capitalize(F.when(F.col(group).isNull() | (F.col(group) == ""), default).otherwise(F.col(group)))
    return df.groupBy(g.alias("group")).agg(F.array_sort(F.collect_list(member)).alias("members"), F.count(F.lit(1)).alias("n"))


def first_segment(url: C) -> Column:
    """Title of an address's first path part, Root if there is none [AGG2]."""
    part = F.element_at(F.concat(F.filter(F.split(url_path(url), "/"), lambda p: p != ""), F.array(F.lit(None).cast("string"))), 1)
    return F.coalesce(title_words(part), F.lit("Root"))


def references(df: DataFrame, items: C, owner: str) -> DataFrame:
    """item -> sorted distinct owners [AGG3, AGG25]."""
    rows = df.select(F.explode(col(items)).alias("item"), owner)
    return rows.groupBy("item").agg(F.array_sort(F.collect_set(owner)).alias("owners"))


def verdict_counts(df: DataFrame, verdict: str, values: list[str]) -> DataFrame:
    """One row with a count for each value [AGG4, AGG11, AGG27, AGG30]."""
    return df.agg(*(F.count_if(F.col(verdict) == v).alias(v) for v in values))


def connector_rollup(df: DataFrame) -> DataFrame:
    """connector -> types, names, whether any is in the cloud, first licence [AGG5, AGG9]. Columns connector, type, commercial_name, cloud, license, ordinal."""
    return df.groupBy("connector").agg(F.array_sort(F.collect_set("type")).alias("types"), F.array_sort(F.collect_set("commercial_name")).alias("names"), F.bool_or("cloud").alias("cloud"), F.min_by("license", "ordinal").alias("license"))


def by_support(df: DataFrame, group: str, level: str, name: str) -> DataFrame:
    """Distinct names of each group and level, as text [AGG6, AGG7]."""
    return df.groupBy(group, level).agg(F.array_join(F.array_sort(F.collect_set(name)), ", ").alias("names"))


#: Order of providers.
PROVIDERS = ["GCP", "AWS", "Azure"]


def regions(df: DataFrame) -> DataFrame:
    """Regions (provider, region, zones, product, cluster_type) of known providers, with cluster types by product, in order [AGG10, F25, J25, N14, N15]."""
    known = df.filter(F.col("provider").isin(PROVIDERS) & F.col("product").isNotNull())
    tiers = known.groupBy("provider", "region", "zones", "product").agg(F.array_join(F.array_sort(F.collect_set("cluster_type")), ", ").alias("types"))
    rows = tiers.groupBy("provider", "region", "zones").agg(F.array_sort(F.collect_list(F.concat("product", F.lit(": "), "types"))).alias("tiers"))
    rank = F.array_position(F.array(*map(F.lit, PROVIDERS)), F.col("provider"))
    return rows.withColumn("provider_rank", rank).orderBy("provider_rank", "region")


METRIC_SUFFIXES = ("_bucket", "_count", "_sum")


def metrics(lines: DataFrame, line: str = "line", ordinal: str = "ordinal") -> DataFrame:
    """Prometheus text as (name, description, type, unit, labels) [AGG12, SRC13]. HELP, TYPE and UNIT may come in any order, the last one
    counts; a series ending in _bucket, _count or _sum takes what its base has; a name without HELP has an empty description."""
    x = F.col(line)
    meta = lines.filter(x.rlike(r"^# (HELP|TYPE|UNIT)")).select(F.regexp_extract(x, r"^# (\w+)\s+(\S+)\s+(.+)", 1).alias("what"), F.regexp_extract(x, r"^# (\w+)\s+(\S+)\s+(.+)", 2).alias("name"), F.regexp_extract(x, r"^# (\w+)\s+(\S+)\s+(.+)", 3).alias("v"), ordinal).filter("name != ''")
    last = lambda w, v: F.max_by(F.when(F.col("what") == w, v), F.when(F.col("what") == w, F.col(ordinal)))
    meta = meta.groupBy("name").agg(last("HELP", F.col("v")).alias("description"), last("TYPE", F.regexp_extract("v", r"^(\S+)", 1)).alias("type"), last("UNIT", F.col("v")).alias("unit"))
    body = F.regexp_extract(x, r"^(\S+)\{(.+?)\}\s+(.+)", 2)
    name = F.when(body != "", F.regexp_extract(x, r"^(\S+)\{(.+?)\}\s+(.+)", 1)).otherwise(F.regexp_extract(x, r"^(\S+?)(?:\{\})?\s+(.+)", 1))
    keys = F.when(body != "", F.transform(F.split(body, ","), lambda kv: F.element_at(F.split(kv, "=", 2), 1))).otherwise(F.array().cast("array<string>"))
    series = lines.filter(~x.startswith("#")).select(name.alias("name"), F.explode_outer(keys).alias("key")).filter("name != ''").groupBy("name").agg(F.array_sort(F.collect_set("key")).alias("labels"))
    base = series.select("name", F.regexp_replace("name", r"(_bucket|_count|_sum)$", "").alias("base")).filter("base != name").join(meta.withColumnRenamed("name", "base"), "base").select("name", *(F.col(c).alias(f"b_{c}") for c in ("description", "type", "unit")))
    out = series.join(meta, "name", "full_outer").join(base, "name", "left")
    pick = lambda c: F.coalesce(f"b_{c}", c)
    return out.select("name", F.coalesce(pick("description"), F.lit("")).alias("description"), pick("type").alias("type"), pick("unit").alias("unit"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


#: The counters that are added up over releases, seven of fourteen [N26].
SUMMED = ["newComponents", "newFields", "removedComponents", "removedFields", "deprecatedComponents", "deprecatedFields", "changedDefaults"]


def master_summary(releases: DataFrame) -> DataFrame:
    """Sums over releases of the seven counters, number of releases, first and last version by ordinal [AGG13, N26, N34]."""
    return releases.agg(F.count(F.lit(1)).alias("releaseCount"), F.min_by("fromVersion", "ordinal").alias("startVersion"), F.max_by("toVersion", "ordinal").alias("endVersion"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMMED))


def usage(df: DataFrame, key: str) -> DataFrame:
    """Calls by key, and as a row of key null the number of keys and calls [AGG14]."""
    one = df.groupBy(key).agg(F.count(F.lit(1)).alias("calls"))
    return one.withColumn("keys", F.lit(1).cast("long")).unionByName(one.agg(F.lit(None).cast("string").alias(key), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.count(F.lit(1)).alias("keys")))


def changed_defaults(df: DataFrame) -> DataFrame:
    """(field, old, new) -> components by order of name [AGG15, N20]."""
    return df.groupBy("field", "old", "new").agg(F.array_sort(F.collect_set("component")).alias("components"), F.min("ordinal").alias("ordinal"))


def fields_by_name(df: DataFrame) -> DataFrame:
    """field -> components and the first description [AGG16]."""
    return df.groupBy("field").agg(F.array_sort(F.collect_set("component")).alias("components"), F.min_by("description", "ordinal").alias("description"))


def percent(part: C, whole: C) -> Column:
    """Per cent to two places, as text; 0.00 of nothing [AGG17]."""
    return F.when(col(whole) == 0, "0.00").otherwise(F.format_string("%.2f", F.round(100 * col(part) / col(whole), 2)))


def quality_score(errors: C, missing: C, short: C, no_example: C) -> Column:
    """[AGG18]"""
    return F.lit(100) - col(errors) - F.least(F.lit(20), 2 * col(missing)) - F.least(F.lit(10), col(short)) - F.least(F.lit(5), F.floor(col(no_example) / 5))


def duplicate_texts(df: DataFrame, text: str, owner: str, least: int = 30) -> DataFrame:
    """Texts longer than `least` that several rows share but for case and ends; number and smallest owner [AGG19, AGG24]."""
    key = F.lower(F.trim(text))
    return df.filter(F.length(text) > least).groupBy(key.alias("text_key")).agg(F.count(F.lit(1)).alias("n"), F.min(owner).alias("first_owner")).filter("n > 1")


def most_recent(df: DataFrame, group: str, date: str) -> DataFrame:
    """Latest date by group and, with a null group, of all [AGG20]."""
    return df.groupingSets([(group,), ()], group).agg(F.max(date).alias("latest"))


def file_dates(df: DataFrame, path: str, position: str, date: str) -> DataFrame:
    """created: date of the oldest change by place in the log, not the least date; modified: of the newest [AGG21, N22]. Position 0 is newest."""
    return df.groupBy(path).agg(F.max_by(date, position).alias("created"), F.min_by(date, position).alias("modified"))


def faq_pivot(df: DataFrame, page: str = "page", attributes: str = "attributes") -> DataFrame:
    """Attributes page-faq-N-question/answer/anchor as rows in order of N, without incomplete ones [AGG26]."""
    pattern = r"^page-faq-(\d+)-(question|answer|anchor)$"
    rows = df.select(page, F.explode(attributes).alias("k", "v")).filter(F.col("k").rlike(pattern)).select(page, F.regexp_extract("k", pattern, 1).cast("int").alias("n"), F.regexp_extract("k", pattern, 2).alias("part"), "v")
    return rows.groupBy(page, "n").pivot("part", ["question", "answer", "anchor"]).agg(F.first("v")).filter("question is not null and answer is not null").orderBy(page, "n")


def mapping_by_source(df: DataFrame, order: DataFrame) -> DataFrame:
    """source value -> names, in the order of an enumeration (value, ordinal) [AGG23]."""
    return df.groupBy("value").agg(F.array_sort(F.collect_set("name")).alias("names")).join(order, "value", "left").orderBy(F.asc_nulls_last("ordinal"), "value")


def feature_table(df: DataFrame, scope: str, statuses: list[str]) -> DataFrame:
    """Features of a scope by status, in order of name without regard to case and accents [AGG29, T9]."""
    return df.filter((F.col("scope") == scope) & F.col("status").isin(statuses)).orderBy(F.collate("name", "UNICODE_CI_AI"), "name")


def breaking(removed: C, defaults: C, types: C) -> Column:
    """[AGG31]"""
    return (col(removed) > 0) | (col(defaults) > 0) | (col(types) > 0)


def summary_text(df: DataFrame, kind: str, name: str, most: int = 10) -> DataFrame:
    """A line for each kind of change, with the first names [AGG28]."""
    g = df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(name)).alias("names"))
    return g.select(kind, F.concat(F.lit("- "), kind, F.lit(": "), F.col("n").cast("string"), F.lit(" ("), F.array_join(F.slice("names", 1, most), ", "), F.when(F.size("names") > most, ", ...").otherwise(""), F.lit(")")).alias("line"))
