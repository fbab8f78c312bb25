"""Scans of the inventory. Each takes what spark.read gives and yields a DataFrame; line scanners that need a stack run over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import C, col, collapse_space
from ..operators.ordered import carry_forward


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trimmed(df: DataFrame) -> DataFrame:
    return df.select(*(F.trim(F.col(f"`{c}`").cast("string")).alias(c.strip()) for c in df.columns))


def connectors_csv(spark: SparkSession, path: str) -> DataFrame:
    """Connector table: header names and cells trimmed, blank lines and rows without name or type dropped, support `community` by default, cloud as y or n [SRC1, SRC2, D6]."""
    df = _trimmed(spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True))
    missing = {"name", "type"} - set(df.columns)
    if missing:
        raise ValueError(f"the table lacks {sorted(missing)}")
    df = df.filter((F.coalesce("name", F.lit("")) != "") & (F.coalesce("type", F.lit("")) != ""))
    if "support" in df.columns:
        df = df.withColumn("support", F.coalesce(F.nullif("support", F.lit("")), F.lit("community")))
    if "cloud" in df.columns:
        df = df.withColumn("cloud", F.when(F.lower("cloud").isin("y", "yes", "true"), "y").otherwise("n"))
    return df


def enterprise_plugins(spark: SparkSession, path: str) -> DataFrame:
    """[SRC4]"""
    return connectors_csv(spark, path).filter(F.lower(F.trim("support")) == "enterprise").select("name").distinct()


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc): each file a VARIANT [SRC5, SRC6, SRC7]."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("doc"))


def properties(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Property rows of a registry: entries of `properties`, else root entries that look like one (type, description or default) [SRC5, D4].

    default_json keeps the difference between a missing default (null) and JSON null ('null') [N4]."""
    nested = F.expr(f"try_variant_get({doc}, '$.properties', 'variant')")
    rows = docs.withColumn("__p", F.coalesce(nested, F.col(doc))).withColumn("__nested", nested.isNotNull())
    e = rows.select(*[c for c in docs.columns if c != doc], "__nested", F.expr("__p").alias("__p")).lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("__p").outer()))
    v = lambda p, t: F.expr(f"try_variant_get(value, '$.{p}', '{t}')")
    looks = F.expr("value:type").isNotNull() | F.expr("value:description").isNotNull() | F.expr("value:default").isNotNull()
    e = e.filter(F.col("__nested") | ((F.col("key") != "definitions") & looks))
    return e.select(F.col("key").alias("name"), v("type", "string").alias("type"), v("description", "string").alias("description"), F.to_json(F.expr("value:default")).alias("default_json"), v("is_deprecated", "boolean").alias("is_deprecated"), v("is_experimental_property", "boolean").alias("is_experimental"), v("config_scope", "string").alias("config_scope"))


def connector_index(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(type, name, raw JSON, ordinal): entries of every key that holds an array [SRC6, D5]."""
    e = docs.select(doc).lateralJoin(docs.sparkSession.tvf.variant_explode(F.col(doc).outer())).filter(F.expr("schema_of_variant(value) like 'ARRAY%'")).select(F.col("key").alias("type"), F.col("value").alias("items"))
    items = e.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("items").outer()))
    return items.select("type", F.expr("try_variant_get(value, '$.name', 'string')").alias("name"), F.to_json("value").alias("raw"), F.col("pos").alias("ordinal")).filter("name is not null")


def yaml_documents(df: DataFrame, contents: str = "contents") -> DataFrame:
    """Adds `doc`, the YAML text of a row as VARIANT; null where it cannot be read [SRC8, SRC9, SRC34]. PyYAML is needed."""
    import json

    import pandas as pd
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    def load(s):
        import yaml

        def one(x):
            try:
                return None if x is None else json.dumps(yaml.safe_load(x), default=str)
            except yaml.YAMLError:
                return None

        return pd.Series([one(x) for x in s], dtype=object)

    return df.withColumn("doc", F.try_parse_json(pandas_udf(load, "string", PandasUDFType.SCALAR)(F.col(contents))))


def samples(df: DataFrame) -> DataFrame:
    """Samples under playground/ with title, input and mapping; the first of a title counts; in order of title [SRC9]. df: (path, title, input, mapping, ordinal)."""
    from ..operators.joins import first_wins

    ok = df.filter(F.col("path").startswith("playground/") & (F.coalesce("title", F.lit("")) != "") & F.col("input").isNotNull() & F.col("mapping").isNotNull())
    return first_wins(ok, ["title"], "ordinal").orderBy("title")


def sitemap(df: DataFrame, contents: str = "contents") -> DataFrame:
    """(loc, lastmod, ordinal) of urlset or sitemapindex XML [SRC11]."""
    local = "*[local-name()='url' or local-name()='sitemap']"
    get = lambda tag: F.expr(f"xpath({contents}, \"//{local}/*[local-name()='{tag}']/text()\")")
    entry = F.expr(f"regexp_extract_all({contents}, '(?s)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>', 1)")
    rows = df.select(F.size(get("loc")).alias("n"), F.posexplode(entry).alias("ordinal", "e"))
    return rows.select(F.trim(F.regexp_extract("e", r"(?s)<loc>(.*?)</loc>", 1)).alias("loc"), F.nullif(F.trim(F.regexp_extract("e", r"(?s)<lastmod>(.*?)</lastmod>", 1)), F.lit("")).alias("lastmod"), "ordinal")


class _Page(HTMLParser):
    """Headings, paragraphs, list items, table texts and links inside the article."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.headings, self.texts, self.links = "", [], [], []
        self.inside, self.skip, self.open = 0, 0, []
        self.has_article = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "article":
            self.inside += 1
            self.has_article = True
        if tag in ("script", "style", "nav"):
            self.skip += 1
        if self.inside and not self.skip:
            if re.fullmatch(r"h[1-6]", tag) or tag in ("p", "li", "table"):
                if tag in ("p", "li") and self.open and self.open[-1][0] == tag:
                    self._close(tag)
                self.open.append((tag, a.get("id") or "", []))
            if tag == "a" and a.get("href"):
                self.links.append(a["href"])

    def _close(self, tag):
        while any(t == tag for t, *_ in self.open):
            t, ident, parts = self.open.pop()
            text = " ".join("".join(parts).split())
            if t[0] == "h" and t != "html":
                self.headings.append((t, ident, text))
                self.title = self.title or (text if t == "h1" else "")
            elif text:
                self.texts.append(text)
            if t == tag:
                break

    def handle_endtag(self, tag):
        if tag in ("script", "style", "nav") and self.skip:
            self.skip -= 1
        self._close("li" if tag in ("ul", "ol") else tag)
        if tag == "article" and self.inside:
            while self.open:
                self._close(self.open[-1][0])
            self.inside -= 1

    def handle_data(self, data):
        if self.open and not self.skip:
            self.open[-1][2].append(data)


PAGE = "title string, headings array<struct<level:int,id:string,text:string>>, texts array<string>, links array<string>, has_article boolean"


def parse_pages(df: DataFrame, html: str = "html") -> DataFrame:
    """Adds the fields of PAGE, with a real parser that bears with unclosed tags [SRC12]. For flat tags, page_fields() stays in the JVM."""
    keep = [c for c in df.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.list_(pa.struct([("level", pa.int32()), ("id", pa.string()), ("text", pa.string())])), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_()]
        for b in batches:
            rows = []
            for x in b.column(b.schema.get_field_index(html)).to_pylist():
                p = _Page()
                p.feed(x or "")
                p.close()
                while p.open:
                    p._close(p.open[-1][0])
                rows.append((p.title, [{"level": int(t[1]), "id": i, "text": s} for t, i, s in p.headings], p.texts, p.links, p.has_article))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keep] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[*keep, "title", "headings", "texts", "links", "has_article"])

    old = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != html)
    return df.mapInArrow(run, f"{old}, {PAGE}" if old else PAGE)


def article(html: C) -> Column:
    """Inner HTML of the first article."""
    return F.regexp_extract(col(html), r"(?s)<article[^>]*>(.*?)</article>", 1)


def plain(html: C) -> Column:
    """Text without tags, white space folded."""
    return collapse_space(F.regexp_replace(col(html), r"<[^>]*>", " "))


def page_fields(html: C) -> dict[str, Column]:
    """Title, headings, paragraphs and links of flat HTML by pattern, without leaving the JVM [SRC12]."""
    a = article(html)
    return {
        "title": plain(F.regexp_extract(a, r"(?s)<h1[^>]*>(.*?)</h1>", 1)),
        "headings": F.transform(F.regexp_extract_all(a, F.lit(r"(?s)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1)), plain),
        "paragraphs": F.transform(F.regexp_extract_all(a, F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1)), plain),
        "links": F.regexp_extract_all(a, F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1)),
    }


def text_lines(df: DataFrame, contents: str = "contents", keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys, ordinal, line) [D12, SRC13]."""
    return df.select(*keys, F.posexplode(F.split(contents, r"\r?\n", -1)).alias("ordinal", "line"))


def file_pairs(files: DataFrame, path: str = "path") -> DataFrame:
    """(stem, header, source): .h files with their .cc [SRC17]."""
    x = files.select(F.regexp_replace(path, r"\.(h|hpp|cc|cpp)$", "").alias("stem"), F.regexp_extract(path, r"\.(h|hpp|cc|cpp)$", 1).alias("ext"), path)
    return x.filter(F.col("ext").isin("h", "hpp")).select("stem", F.col(path).alias("header")).join(x.filter(F.col("ext").isin("cc", "cpp")).select("stem", F.col(path).alias("source")), "stem", "left")


#: Shapes of numeric constants in C++ sources: name, then value.
CONSTANTS = r"(?m)(?:static\s+)?(?:inline\s+)?constexpr\s+(?:static\s+)?[\w:<>]+\s+(\w+)\s*(?:=\s*|\{\s*)([^;{}]+?)\s*\}?\s*;"


def constants(files: DataFrame, contents: str = "contents", ordinal: str = "ordinal") -> DataFrame:
    """name -> value of constants and of named strings, topics and namespaces (cpp.named_constants); a later place wins, first by file [SRC18, N19]."""
    from .cpp import CONSTANTS as NAMED
    from .cpp import named_constants

    hits = F.expr(f"transform(regexp_extract_all({contents}, r'{CONSTANTS}', 0), x -> struct(regexp_extract(x, r'{CONSTANTS}', 1) as name, regexp_extract(x, r'{CONSTANTS}', 2) as value))")
    rows = files.select(ordinal, F.posexplode(hits).alias("n", "h")).select("h.name", "h.value", F.struct(F.col(ordinal).alias("file"), F.lit(0).alias("named"), "n").alias("at"))
    named = scan_rows(files.select(ordinal, contents), contents, lambda text: [(i, *x) for i, x in enumerate(named_constants(text))], f"n int, {NAMED[0]}", [pa.int32(), *NAMED[1]])
    rows = rows.unionByName(named.select("name", "value", F.struct(F.col(ordinal).alias("file"), F.lit(1).alias("named"), "n").alias("at")))
    return rows.groupBy("name").agg(F.max_by("value", "at").alias("value"))


def enums(files: DataFrame, contents: str = "contents") -> DataFrame:
    """(enum, ordinal, value) of C++ enumerations [SRC19, SRC26]."""
    pattern = r"(?s)enum\s+(?:class\s+|struct\s+)?(\w+)\s*(?::\s*[\w:]+\s*)?\{([^}]*)\}"
    found = files.select(F.explode(F.expr(f"regexp_extract_all({contents}, r'{pattern}', 0)")).alias("x"))
    body = F.regexp_replace(F.regexp_extract("x", pattern, 2), r"//[^\n]*|(?s)/\*.*?\*/", "")
    return found.select(F.regexp_extract("x", pattern, 1).alias("enum"), F.posexplode(F.filter(F.transform(F.split(body, ","), lambda v: F.trim(F.regexp_replace(F.regexp_replace(v, r"=.*", ""), r"\s+", " "))), lambda v: v != "")).alias("ordinal", "value"))


def go_commands(files: DataFrame, contents: str = "contents", keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys, constructor, use): command constructors of Go sources [SRC21]."""
    pattern = r'(?s)func\s+(\w+)\([^)]*\)\s+\*cobra\.Command\s*\{.*?Use:\s*"([^" ]+)'
    return files.select(*keys, F.explode(F.expr(f"regexp_extract_all({contents}, r'{pattern}', 0)")).alias("x")).select(*keys, F.regexp_extract("x", pattern, 1).alias("constructor"), F.regexp_extract("x", pattern, 2).alias("use"))


def scan_rows(df: DataFrame, contents: str, f: Callable[[str], list[tuple]], schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """Rows that a line scanner makes of each text, with the other columns [SRC22 to SRC27]."""
    keep = [c for c in df.columns if c != contents]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column(b.schema.get_field_index(contents)).to_pylist()):
                found = f(text or "")
                at += [i] * len(found)
                rows += found
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)).take(take) for c in keep] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[*keep, *names])

    old = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema if x.name != contents)
    return df.mapInArrow(run, f"{old}, {schema}" if old else schema)


_FLAG = re.compile(r"^\s+(?:-(\w),\s+)?--([\w-]+)(?:\s+([\w.\[\]<>]+))?\s{2,}(.*)$|^\s+(?:-(\w),\s+)?--([\w-]+)()()$")
_DEFAULT = re.compile(r"\s*\(default:?\s+(.*?)\)\s*$")


def help_flags(text: str) -> list[tuple]:
    """(flag, shorthand, type, default, description) of command help; a deeper line without a flag continues the one before [SRC23]."""
    out: list[list] = []
    inside, indent = False, 0
    for line in text.splitlines():
        if re.match(r"^(Global )?(Flags|OPTIONS|Options):?\s*$", line.strip()) or line.strip().upper() in ("FLAGS:", "OPTIONS:", "GLOBAL FLAGS:"):
            inside = True
            continue
        if inside and line and not line[0].isspace():
            inside = False
        m = _FLAG.match(line) if inside else None
        if m:
            g = m.groups()
            short, name, kind, rest = g[:4] if g[1] else g[4:]
            out.append([name, short or "", kind or "bool", None, rest.strip()])
            indent = len(line) - len(line.lstrip())
        elif inside and out and line.strip() and len(line) - len(line.lstrip()) > indent:
            out[-1][4] = f"{out[-1][4]} {line.strip()}".strip()
    for x in out:
        d = _DEFAULT.search(x[4])
        if d:
            x[3], x[4] = d[1].strip('"'), x[4][: d.start()]
    return [tuple(x) for x in out]


HELP = ("flag string, shorthand string, type string, default_value string, description string", [pa.string()] * 5)


def sections(text: str) -> list[tuple]:
    """(section, body): lines in capitals are headings, but not in a shell transcript; what comes before the first is '' [SRC38]."""
    out, name, body = [], "", []
    for line in text.split("\n"):
        if re.fullmatch(r"[A-Z][A-Z0-9 /&-]{2,}:?", line.strip()) and not line.lstrip().startswith(("$", "#")) and not line.startswith("    "):
            out.append((name, "\n".join(body).strip()))
            name, body = line.strip().rstrip(":"), []
        else:
            body.append(line)
    out.append((name, "\n".join(body).strip()))
    return [x for x in out if x[0] or x[1]]


SECTIONS = ("section string, body string", [pa.string()] * 2)


def commented_values(text: str) -> list[tuple]:
    """(path, description) of commented YAML keys, by a stack of indents [SRC27]."""
    out, stack, comment = [], [], []
    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith("#"):
            comment.append(bare.lstrip("# ").removeprefix("-- "))
        elif m := re.match(r"^(\s*)([\w.-]+):(?:\s|$)", line):
            depth = len(m[1])
            while stack and stack[-1][0] >= depth:
                stack.pop()
            stack.append((depth, m[2]))
            if comment:
                out.append((".".join(k for _, k in stack), " ".join(x for x in comment if x)))
            comment = []
        else:
            comment = []
    return out


VALUES = ("value_path string, description string", [pa.string()] * 2)

_URL = re.compile(r"(link:)?(https?://[^\s\][)\"'<>]+)(\[[^\]]*\])?")
_ENTRY = re.compile(r"^:!?[a-zA-Z0-9_][a-zA-Z0-9_-]*!?:(?:\s|$)")
#: Delimiters of blocks in which addresses do not count, and how far a wrapped label may run.
_FENCES = [(re.compile(p), c) for p, c in ((r"-{4,}", "-"), (r"\.{4,}", "."), (r"`{3,}", "`"), (r"\+{4,}", "+"))]
WRAP = 500


def content_urls(text: str) -> list[tuple]:
    """(url, label, start, end, has_link_prefix, in_attribute_entry, in_attribute_value) outside code blocks and code spans [SC-S24, A5, N9].

    A block ends only at its own delimiter. A label may close on a later line, unless a blank line lies between. Without a label,
    trailing punctuation and emphasis is not part of the address."""
    out, at, fence = [], 0, None
    for raw in text.split("\n"):
        line = raw.removesuffix("\r")
        kind = next((c for p, c in _FENCES if p.fullmatch(line)), None)
        if kind:
            fence = None if fence == kind else fence or kind
        elif not fence:
            for m in _URL.finditer(line):
                before = line[: m.start()]
                if before.count("`") % 2:
                    continue
                url, label, start = m[2], m[3] and m[3][1:-1], at + m.start()
                tail = start + len(m[1] or "") + len(url)
                end = tail + len(m[3] or "")
                if label is None:
                    close = text.find("]", tail + 1) if text[tail : tail + 1] == "[" else -1
                    wrapped = text[tail + 1 : close] if 0 <= close <= min(len(text), tail + WRAP) else None
                    if wrapped is not None and not re.search(r"\n[ \t]*\n", wrapped):
                        label, end = re.sub(r"\s*\n\s*", " ", wrapped), close + 1
                    else:
                        url = re.sub(r"[.,;:!?*_]+$", "", url)
                        end = start + len(m[1] or "") + len(url)
                out.append((url, label, start, end, bool(m[1]), bool(_ENTRY.match(line)), bool(re.search(r"[\w-]=[\"']?$", before))))
        at += len(raw) + 1
    return out


URLS = ("url string, label string, start int, end int, has_link_prefix boolean, in_attribute_entry boolean, in_attribute_value boolean", [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_()])


def nav(df: DataFrame, contents: str = "contents", keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Navigation entries (keys, line, level, target, label, section): section is the last entry of level 1 without a link above [SRC28, W8]."""
    lines = df.select(*keys, F.posexplode(F.split(contents, "\n", -1)).alias("line", "text")).filter(F.col("text").rlike(r"^\*+\s"))
    e = lines.select(*keys, (F.col("line") + 1).alias("line"), F.length(F.regexp_extract("text", r"^(\*+)", 1)).alias("level"), F.regexp_extract("text", r"xref:([^\[]+)\[", 1).alias("target"), F.regexp_extract("text", r"xref:[^\[]+\[([^\]]*)\]", 1).alias("linked"), F.regexp_extract("text", r"^\*+\s+(.*)$", 1).alias("plain"))
    e = e.withColumn("label", F.when(F.col("target") != "", F.col("linked")).otherwise(F.col("plain"))).withColumn("__s", F.when((F.col("level") == 1) & (F.col("target") == ""), F.col("label")))
    return carry_forward(e, list(keys), "line", "__s", "section").drop("__s", "linked", "plain")


def page_headings(pages: DataFrame, partials: DataFrame, most: int = 50) -> DataFrame:
    """(path, id, title): heading ids of pages (path, contents) and of the partials (path, contents) that they include, at most the first `most` includes of each; a page's own come first, and the first of an id counts [REC12]."""
    from .scanners import HEADING_IDS, heading_ids

    own = scan_rows(pages.select("path", "contents"), "contents", heading_ids, *HEADING_IDS).withColumn("at", F.lit(-1))
    included = pages.select("path", F.posexplode(F.slice(F.regexp_extract_all("contents", F.lit(r"(?m)^include::([^\[\s]+)\["), F.lit(1)), 1, most)).alias("at", "partial"))
    inside = scan_rows(partials.select(F.col("path").alias("partial"), "contents"), "contents", heading_ids, *HEADING_IDS)
    both = own.unionByName(included.join(inside, "partial").drop("partial"))
    return both.groupBy("path", "id").agg(F.min_by("title", F.struct("at", "ordinal")).alias("title"))


def mark_beta(fields: DataFrame, text: str = "description") -> DataFrame:
    """Adds is_beta: whether a description, of a component or of a field at any depth, starts with BETA: [SRC37]."""
    return fields.withColumn("is_beta", F.coalesce(F.col(text).rlike(r"(?i)^\s*BETA:"), F.lit(False)))


def alternating_table(df: DataFrame, contents: str = "contents", keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys, ordinal, feature, setting) of a two-column AsciiDoc table, whose cells come one after the other [SRC25]."""
    body = F.regexp_extract(contents, r"(?s)\|===\s*\n(.*?)\n\|===", 1)
    cells = F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"(?m)^\|\s*([^|\n]+)"), F.lit(1)), lambda c: F.trim(c)), lambda c: c != "")
    rows = df.select(*keys, F.posexplode(cells).alias("n", "cell"))
    return rows.groupBy(*keys, F.floor(F.col("n") / 2).alias("ordinal")).agg(F.max(F.when(F.col("n") % 2 == 0, F.col("cell"))).alias("feature"), F.max(F.when(F.col("n") % 2 == 1, F.col("cell"))).alias("setting"))


def env_options(df: DataFrame, contents: str = "contents") -> DataFrame:
    """(name, value) of key=value lists [SRC33]."""
    pairs = df.select(F.explode(F.filter(F.split(contents, r"[,\n]"), lambda x: F.contains(x, F.lit("=")))).alias("pair"))
    return pairs.select(F.split("pair", "=", 2).alias("kv")).select(F.trim(F.get("kv", 0)).alias("name"), F.trim(F.get("kv", 1)).alias("value"))


def commit_changes(trees: DataFrame) -> DataFrame:
    """(path, pos, date): commits of (pos, date, path, oid, parent_oid) that changed a file [SRC29, D13]."""
    return trees.filter(~F.col("oid").eqNullSafe(F.col("parent_oid"))).select("path", "pos", "date")


def duplicate_aliases(registry: DataFrame) -> DataFrame:
    """Names and aliases that more than one entry claims [SRC34, AGG24]."""
    claims = registry.select("name", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("claim"))
    return claims.groupBy("claim").agg(F.countDistinct("name").alias("owners")).filter("owners > 1")


#: Pattern of a price.
PRICE = r"^([A-Z]{3}) (\d+(?:\.\d{2})?)$"


def price(c: C) -> Column:
    """Currency and decimal amount of a price text; null if it is none [D15]."""
    x = col(c)
    return F.when(x.rlike(PRICE), F.struct(F.regexp_extract(x, PRICE, 1).alias("currency"), F.regexp_extract(x, PRICE, 2).try_cast("decimal(18,2)").alias("amount")))
