"""Sinks of the inventory: what is to be written, as DataFrames, and the writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_space, escape_pipes
from ..operators.joins import sync_actions


def index_actions(new: DataFrame, old: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """Batch of add, update and delete actions; API pages and interactive labs are not deleted [SNK1, N23, N24]. old has type, interactive."""
    keep = ~((((F.col("o_type") == "Doc") & ~F.contains(F.col(key).cast("string"), F.lit("/api/"))) | F.col("o_type").isNull() | (F.col("o_type") == "")) | ((F.col("o_type") == "Lab") & ~F.coalesce(F.col("o_interactive"), F.lit(False))))
    return sync_actions(new, old, key, compare, keep)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text for each row [SNK2, SNK14]."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """A single row's columns on every row [SNK3]; the single row is checked."""
    if one_row.limit(2).count() != 1:
        raise ValueError("exactly one row can be attached")
    values = one_row.first()
    return df.withColumns({c: F.lit(values[c]) for c in one_row.columns})


def corpus_text(pages: DataFrame, group: str, url: str, text: str) -> DataFrame:
    """One text for each group, pages in order of URL and numbered [SNK5, W10]."""
    rows = pages.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(url).alias("u"), F.col(text).alias("t")))).alias("p"))
    return rows.select(group, F.expr("array_join(transform(p, (x, i) -> concat('# Page ', i + 1, ': ', x.u, '\n\n', x.t)), '\n\n---\n\n')").alias("value"))


def sitemap_xml(urls: DataFrame, loc: str, lastmod: str) -> DataFrame:
    """Entries of a sitemap, one line each [SNK6]."""
    return urls.select(F.concat(F.lit("<url><loc>"), F.replace(F.col(loc), F.lit("&"), F.lit("&amp;")), F.lit("</loc>"), F.when(F.col(lastmod).isNotNull(), F.concat(F.lit("<lastmod>"), lastmod, F.lit("</lastmod>"))).otherwise(""), F.lit("</url>")).alias("value"))


#: Redirect rules of each server; origin, target, status.
REDIRECTS = {
    "httpd": "Redirect %3$s %1$s %2$s",
    "netlify": "%1$s %2$s %3$s",
    "nginx": "location = %1$s { return %3$s %2$s; }",
    "static": '<!DOCTYPE html><link rel="canonical" href="%2$s"><meta http-equiv="refresh" content="0; url=%2$s"><!-- %1$s %3$s -->',
}


def redirects(df: DataFrame, server: str, origin: str, target: str, status: int = 301) -> DataFrame:
    """[SNK7]"""
    return df.select(F.format_string(REDIRECTS[server], F.col(origin), F.col(target), F.lit(str(status))).alias("value"))


def partials(df: DataFrame, group: str, name: str, body: str) -> DataFrame:
    """Bodies of each group in order of name, joined [SNK8]."""
    return df.groupBy(group).agg(F.expr(f"listagg({body}, '\n\n') WITHIN GROUP (ORDER BY {name})").alias("value"))


def asciidoc_table(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Lines of a table (ordinal, value) [SNK9]. The rows are ordered by the writer, not gathered."""
    head = "|===\n" + "".join(f"|{c} " for c in columns)
    row = F.concat(*(F.concat(F.lit("|"), escape_pipes(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(" ")) for c in columns))
    return df.orderBy(*order).select(row.alias("value")), head, "|==="


def markdown(pages: DataFrame, title: str, body: str) -> DataFrame:
    """[SNK4, SC-S23]: title line and text without tags."""
    strip = collapse_space(F.regexp_replace(F.col(body), r"<[^>]*>", " "))
    return pages.withColumn("value", F.concat(F.lit("# "), F.col(title), F.lit("\n\n"), strip))


def write_text(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """[SNK4, SNK7, SNK12]"""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).text(path)


def write_versions(df: DataFrame, path: str, version: str = "version") -> None:
    """A folder for each version, so that reading one prunes the others [SRC7]."""
    df.write.mode("overwrite").partitionBy(version).json(path)


def tar_members(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, member): each file as a member of a tar archive, header and padding included; members one after the other, and TAR_END, are an archive [SNK10].

    A member depends on its own file alone, so no task gathers an archive; the writer appends them."""
    import tarfile

    import pandas as pd
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    def pack(names, contents):
        out = []
        for n, c in zip(names, contents, strict=True):
            info, data = tarfile.TarInfo(n), bytes(c or b"")
            info.size = len(data)
            out.append(info.tobuf(tarfile.GNU_FORMAT) + data + bytes(-len(data) % tarfile.BLOCKSIZE))
        return pd.Series(out, dtype=object)

    return files.select(path, pandas_udf(pack, "binary", PandasUDFType.SCALAR)(F.col(path), F.col(content)).alias("member"))


TAR_END = bytes(1024)


def insert_version(raw: str, name: str, version: str, indent: str = "  ") -> str | None:
    """JSON text with "version" at the top of one entry's object and every other byte as it was; null if there is no such entry or it has a version [SNK13]."""
    import json
    import re

    section = re.search(rf'(?m)^{indent}"properties": \{{', raw)
    start = section.start() if section else 0
    key = re.compile(rf'(?m)^([ \t]+)"{re.escape(name)}": \{{[ \t]*$').search(raw, start)
    if not key:
        return None
    close = re.compile(rf"(?m)^{key[1]}\}}").search(raw, key.end())
    if re.search(rf'(?m)^{key[1]}{indent}"version":', raw[key.end() : close.start() if close else len(raw)]):
        return None
    return f'{raw[: key.end()]}\n{key[1]}{indent}"version": {json.dumps(version)},{raw[key.end() :]}'
