"""String functions as Column expressions. Ids in brackets are those of the survey's inventory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

C = str | Column


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace_all(c: C, pairs: list[tuple[str, str]], regex: bool = True) -> Column:
    """Ordered replacements, each over the result of the one before [SC-S21, U5, U6]."""
    f = (lambda a, p: F.regexp_replace(a, F.lit(p[0]), F.lit(p[1]))) if regex else (lambda a, p: F.replace(a, F.lit(p[0]), F.lit(p[1])))
    return reduce(f, pairs, col(c))


#: Named entities in the order in which they are decoded; &amp; comes before &lt; and so decodes twice.
NAMED = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&apos;", "'")]


def decode_entities(c: C) -> Column:
    """Decimal, then hexadecimal, then named entities [SC-S1]. Numeric ones come from splitting at them, as replacements cannot compute."""

    def numeric(x: Column, pattern: str, code) -> Column:
        found = F.regexp_extract_all(x, F.lit(pattern), F.lit(1))
        between = F.split(x, pattern, -1)
        return F.when(x.rlike(pattern), F.array_join(F.zip_with(between, F.concat(F.transform(found, code), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")).otherwise(x)

    def code_unit(n: Column) -> Column:
        # two bytes in UTF-16, as in the original; surrogate halves come out as replacement characters
        return F.decode(F.unhex(F.lpad(F.hex(n % 65536), 4, "0")), "UTF-16BE")

    decimal = numeric(col(c), r"&#(\d+);", lambda d: code_unit(d.cast("decimal(38,0)").cast("bigint")))
    both = numeric(decimal, r"&#x([0-9a-fA-F]+);", lambda h: code_unit(F.conv(F.right(h, F.lit(15)), 16, 10).cast("bigint")))
    return replace_all(both, NAMED, regex=False)


def collapse_space(c: C) -> Column:
    """Runs of white space become one space; ends are trimmed [SC-S2]."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def markdown_url(c: C) -> Column:
    """[SC-S3]"""
    x = col(c)
    base = replace_all(x, [(r"/$", ""), (r"/index\.html$", ".md"), (r"\.html$", ".md")])
    return F.when(x.isNull() | (x == ""), "").when(x.isin("/", "/index.html"), "/index.md").otherwise(F.when(base.endswith(".md"), base).otherwise(F.concat(base, F.lit(".md"))))


def strip_metadata(c: C, directive: str) -> Column:
    """Drops injected source comments and lines that quote the directive [SC-S4]."""
    quoted = "".join("\\" + ch if ch in ".*+?^${}()|[]\\" else ch for ch in directive)
    return F.regexp_replace(replace_all(c, [(r"(?m)^<!--\s*(?:Source:|Note for AI:)[\s\S]*?-->\s*", ""), (f"(?m)^> {quoted}.*$", "")]), r"^\s+|\s+$", "")


def truncate_at_newline(c: C, most: int) -> Column:
    """At most `most` characters, cut back to the last line end if there is one [SC-S5, T12]."""
    x = col(c)
    head = F.substring(x, 1, most)
    at = F.locate("\n", F.reverse(head))
    return F.when(F.length(x) <= most, x).when(at > 0, F.left(head, F.length(head) - at)).otherwise(head)


def truncate_words(c: C, most: int = 100, empty: str = "*No description*") -> Column:
    """A cap at a word border, if that lies past 80 % of the cap [SC-S6]."""
    x = col(c)
    clean = collapse_space(x)
    head = F.substring(clean, 1, most)
    last = F.length(head) - F.locate(" ", F.reverse(head))
    cut = F.when((F.locate(" ", head) > 0) & (last > 0.8 * most), F.left(head, last)).otherwise(head)
    return F.when(x.isNull() | x.isin("", "No description"), F.lit(empty)).when(F.length(clean) <= most, clean).otherwise(F.concat(cut, F.lit("...")))


def first_sentence(c: C) -> Column:
    """First sentence of the first paragraph; a point between digits ends none [SC-S8]."""
    x = F.coalesce(col(c), F.lit(""))
    para = F.element_at(F.split(x, r"\n\s*\n", 2), 1)
    line = F.trim(F.regexp_replace(para, r"\s*\n+\s*", " "))
    # a sign that no text holds stands for the point of a decimal number
    safe = F.regexp_replace(line, r"(\d)\.(\d)", "$1\u0001$2")
    first = F.regexp_extract(safe, r"^(.*?[.!?])(?=\s|$)", 1)
    return F.trim(F.replace(F.when(first == "", safe).otherwise(first), F.lit("\u0001"), F.lit(".")))


def truncate_sentences(c: C, n: int = 2) -> Column:
    """The first n sentences without links and emphasis, 200 characters at most [SC-S8]."""
    clean = replace_all(F.coalesce(col(c), F.lit("")), [(r"\[([^\]]+)\]\([^\)]+\)", "$1"), (r"[*_`]", ""), (r"\n", " ")])
    found = F.regexp_extract_all(clean, F.lit(r"([^.!?]+[.!?]+)"), F.lit(1))
    cut = F.trim(F.array_join(F.slice(found, 1, n), " "))
    return F.when(F.size(found) == 0, F.substring(clean, 1, 150)).when(F.length(cut) > 200, F.concat(F.left(cut, F.lit(200)), F.lit("..."))).otherwise(cut)


#: Abbreviations whose point ends no sentence.
ABBREVIATIONS = ["e.g.", "i.e.", "etc.", "vs.", "Dr.", "Mr.", "Mrs.", "Ms."]


def cap_sentences(c: C, n: int = 2) -> Column:
    """The first n sentences; abbreviations, decimal points and addresses end none [SC-S7]."""
    dot = "\u0001"
    x = F.coalesce(col(c), F.lit(""))
    for a in ABBREVIATIONS:
        x = F.replace(x, F.lit(a), F.lit(a.replace(".", dot)))
    x = F.regexp_replace(x, r"(\d)\.(\d)", f"$1{dot}$2")
    x = F.regexp_replace(x, r"(?<=\S)\.(?=[A-Za-z0-9_/-])", dot)
    found = F.regexp_extract_all(x, F.lit(r"([^.!?]*[.!?]+(?=\s|$)|[^.!?]+[.!?]*)"), F.lit(1))
    return F.trim(F.replace(F.array_join(F.slice(F.filter(found, lambda s: F.trim(s) != ""), 1, n), ""), F.lit(dot), F.lit(".")))


def ensure_period(c: C) -> Column:
    """[SC-S9]"""
    x = col(c)
    t = F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.when(x.isNull() | (t == "") | t.rlike(r"[.!?]$"), x).otherwise(F.concat(t, F.lit(".")))


def sentence_case(c: C, acronyms: tuple[str, ...] = ()) -> Column:
    """Lower case but for the first letter and acronyms [SC-S10]."""
    words = F.split(col(c), " ")
    known = F.array(*map(F.lit, acronyms)) if acronyms else F.array().cast("array<string>")

    def one(w, i):
        plain = F.when(i == 0, F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))).otherwise(F.lower(w))
        return F.when(F.array_contains(known, F.upper(w)), F.upper(w)).when(F.length(w) > 1, F.when(w.rlike(r"^[A-Z0-9]{2,}$"), w).otherwise(plain)).otherwise(plain)

    return F.array_join(F.transform(words, one), " ")


def anchor_name(c: C) -> Column:
    """Anchor of a name; a name without letters, digits or underscores is an error [SC-S11]."""
    a = replace_all(F.lower(col(c)), [(r"[^a-z0-9_]+", "-"), (r"^-+|-+$", "")])
    return F.when(a == "", F.raise_error(F.concat(F.lit("Invalid property name for anchor generation: "), col(c)))).otherwise(a)


def property_anchor(c: C) -> Column:
    """[SC-S12]"""
    return F.replace(col(c), F.lit("."), F.lit("-"))


def heading_id(c: C) -> Column:
    """Id of a heading [SC-S13]."""
    return replace_all(F.trim(replace_all(F.lower(F.regexp_replace(col(c), r"[`*+#^~]", "")), [(r"[^A-Za-z0-9_\- .]", "")])), [(r"[ .]+", "-"), (r"-{2,}", "-"), (r"^-+|-+$", "")])


def link_text(c: C) -> Column:
    """Text that is safe as a link label [SC-S14]."""
    return collapse_space(replace_all(c, [(r"(?:xref|link|image):[^\[\s]*\[([^\]]*)\]", "$1"), (r"[\[\]]", "")]))


def escape_html(c: C) -> Column:
    """[SC-S15]"""
    return replace_all(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")], regex=False)


def escape_pipes(c: C) -> Column:
    return F.replace(col(c), F.lit("|"), F.lit("\\|"))


def escape_regex(c: C) -> Column:
    return F.regexp_replace(col(c), r"[.*+?^${}()|\[\]\\]", r"\\$0")


def dashify(c: C) -> Column:
    """A command path as a file stem [SC-S16]."""
    return F.replace(col(c), F.lit(" "), F.lit("-"))


def parent_path(c: C) -> Column:
    """The path without its last word; empty at the root [SC-S16]."""
    parts = F.split(col(c), " ")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " ")


def capitalize(c: C) -> Column:
    """First character only, unlike initcap [SC-S17]."""
    x = col(c)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))


def title_words(c: C) -> Column:
    """Dashes become spaces, each word capitalised [AGG2, SC-S26]."""
    return F.array_join(F.transform(F.split(col(c), "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


#: Last part of a name and its unit.
UNITS = {"ms": "milliseconds", "sec": "seconds", "seconds": "seconds", "bytes": "bytes", "buf": "bytes", "partitions": "number of partitions per topic", "percent": "percent", "bps": "bytes per second", "fraction": "fraction"}


def unit_of(c: C) -> Column:
    """[SC-S19]"""
    last = F.element_at(F.split(col(c), "_"), -1)
    out = F.lit("")
    for k, v in UNITS.items():
        out = F.when(last == k, v).otherwise(out)
    return F.coalesce(out, F.lit(""))


def format_default(c: C) -> Column:
    """JSON text of a default for a table: quoted strings, times for large numbers, sizes of arrays [SC-S20]."""
    x = col(c)
    n = x.try_cast("double")
    num = F.when(n == F.floor(n), n.cast("bigint").cast("string")).otherwise(n.cast("string"))

    def ratio(d):
        q = n / d
        return F.when(q == F.floor(q), q.cast("bigint").cast("string")).otherwise(q.cast("string"))

    size = F.json_array_length(x)
    return (
        F.when(x.isNull() | (x == "null"), "`null`")
        .when(x.isin("true", "false"), F.concat(F.lit("`"), x, F.lit("`")))
        .when(x.startswith('"'), F.concat(F.lit("`"), x, F.lit("`")))
        .when(x.startswith("["), F.when(size == 0, "`[]`").otherwise(F.concat(F.lit("`["), size.cast("string"), F.lit(" items]`"))))
        .when(x.startswith("{"), F.concat(F.lit("`"), x, F.lit("`")))
        .when(n >= 3600000, F.concat(F.lit("`"), num, F.lit("` ("), ratio(3600000), F.lit("h)")))
        .when(n >= 60000, F.concat(F.lit("`"), num, F.lit("` ("), ratio(60000), F.lit("m)")))
        .when(n >= 1000, F.concat(F.lit("`"), num, F.lit("` ("), ratio(1000), F.lit("s)")))
        .otherwise(F.concat(F.lit("`"), num, F.lit("`")))
    )


def url_path(c: C) -> Column:
    """Path of an address; a path stays as it is, the root and what is no address become empty [SC-S25]."""
    x = F.coalesce(col(c), F.lit(""))
    p = F.regexp_extract(x, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)
    return F.when(x == "", "").when(x.startswith("/"), x).otherwise(F.when(p == "/", "").otherwise(p))


def normal_path(c: C) -> Column:
    """Path for look-up: no query, index.html, .html, or trailing slash [SC-S25]."""
    x = F.element_at(F.split(col(c), r"\?", 2), 1)
    x = F.when(x.endswith("/index.html"), F.left(x, F.length(x) - 10)).when(x.endswith(".html"), F.left(x, F.length(x) - 5)).otherwise(x)
    x = F.when((F.length(x) > 1) & x.endswith("/"), F.left(x, F.length(x) - 1)).otherwise(x)
    return F.when(x == "", "/").otherwise(x)


def page_suffix(module: C, relative: C) -> Column:
    """Path of a page below its version; module ROOT and index pages add nothing [SC-S25]."""
    stem = F.regexp_replace(col(relative), r"\.adoc$", "")
    stem = F.when(stem == "index", "").when(stem.endswith("/index"), F.left(stem, F.length(stem) - 6)).otherwise(stem)
    return F.concat_ws("/", F.when(~col(module).isin("", "ROOT"), col(module)), F.when(stem != "", stem))


def page_title(c: C) -> Column:
    """Readable title from an address [SC-S26]."""
    parts = F.filter(F.split(url_path(c), "/"), lambda p: p != "")
    return F.when(F.size(parts) == 0, "Home").otherwise(title_words(F.regexp_replace(F.element_at(parts, -1), r"\.html$", "")))


def alias_spec(spec: C, component: C, version: C, module: C) -> Column:
    """[version@][component:][module:]relative as a struct of module and relative; null for another component or version [SC-S27]."""
    x = F.regexp_replace(col(spec), r"^\s+|\s+$", "")
    has_version = F.locate("@", x) > 0
    rest = F.when(has_version, F.substring_index(F.concat(F.lit(""), F.regexp_replace(x, r"^[^@]*@", "")), "\u0000", 1)).otherwise(x)
    parts = F.split(rest, ":", -1)
    n = F.size(parts)
    rel = F.element_at(parts, -1)
    mod = F.when(n >= 2, F.element_at(parts, -2)).otherwise(col(module))
    ok = (x != "") & (~has_version | (F.regexp_extract(x, r"^([^@]*)@", 1) == col(version))) & (n <= 3) & (rel != "") & ((n < 3) | (F.element_at(parts, 1) == col(component)))
    return F.when(ok, F.struct(F.when(mod == "", col(module)).otherwise(mod).alias("module"), F.when(rel.endswith(".adoc"), rel).otherwise(F.concat(rel, F.lit(".adoc"))).alias("relative")))


def resource_id(c: C) -> Column:
    """Parts of version@component:module:family$relative [SC-S28]."""
    x = col(c)
    pattern = r"^(?:([^@]*)@)?(?:([^:$]*):)?(?:([^:$]*):)?(?:([^$]*)\$)?(.*)$"
    names = ["version", "component", "module", "family", "relative"]
    return F.struct(*(F.nullif(F.regexp_extract(x, pattern, i + 1), F.lit("")).alias(n) for i, n in enumerate(names)))


def commercial_names(name: C, overrides: dict[str, str] | None = None, prefixes: list[tuple[str, str]] = ()) -> Column:
    """A name from an override, else from its prefix, else the name itself [SC-S29]."""
    x = col(name)
    out = x
    for p, label in reversed(prefixes):
        out = F.when(x.startswith(p), F.lit(label)).otherwise(out)
    for k, v in (overrides or {}).items():
        out = F.when(x == k, F.lit(v)).otherwise(out)
    return out


def first_reference_only(paragraph: C, name: str, macro: str) -> Column:
    """The first mention of `name` in backticks in a paragraph becomes the macro; later ones stay [SC-S30, N10]."""
    mark = f"`{name}`"
    at = F.locate(mark, col(paragraph))
    return F.when(at > 0, F.concat(F.left(col(paragraph), at - 1), F.lit(macro), F.substring(col(paragraph), at + len(mark), F.lit(1 << 30)))).otherwise(col(paragraph))


def helm_path(name: C, scope: C) -> Column:
    """Path of a setting in a chart's values [SC-S32]."""
    s = col(scope)
    return F.when(s == "broker", F.concat(F.lit("config.node."), col(name))).when(s == "cluster", F.concat(F.lit("config.cluster."), col(name)))


def collapse_blank_lines(c: C) -> Column:
    """[SC-S35, W9]"""
    return F.regexp_replace(col(c), r"\n{3,}", "\n\n")


def sanitize_version(c: C) -> Column:
    """[SC-S36]"""
    return F.regexp_replace(col(c), r"[^0-9A-Za-z._-]", "")


def clean_url_breaks(c: C) -> Column:
    """Zero-width characters go and long dashes become hyphens inside addresses [SC-S38]. Addresses are taken apart and put together again."""
    x = col(c)
    pattern = r"(https?://[^\s)\]>\"]+)"
    found = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), lambda u: replace_all(u, [("[​‌‍﻿]", ""), ("[–—]", "-")]))
    between = F.split(x, pattern, -1)
    return F.when(x.rlike(pattern), F.array_join(F.zip_with(between, F.concat(found, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")).otherwise(x)


#: Which attributes name the cloud, by caller; the four differ.
CLOUD_KEYS = {"docs": ["cloud"], "labs": ["env-cloud", "page-cloud"], "index": ["env-cloud", "page-cloud"], "search": ["page-cloud"]}


def deployment_type(attributes: C, caller: str, cloud_label: str = "Cloud") -> Column:
    """First of Kubernetes, Linux, Docker, cloud whose attribute is set and not empty; callers look at different cloud attributes [SC-S39, N8, N25]."""
    a = col(attributes)
    set_ = lambda k: F.coalesce(a[k] != "", F.lit(False))
    out = F.when(set_("env-kubernetes"), "Kubernetes").when(set_("env-linux"), "Linux").when(set_("env-docker"), "Docker")
    for k in CLOUD_KEYS[caller]:
        out = out.when(set_(k), cloud_label)
    return out.otherwise("")


#: C++ types and the JSON types that stand for them.
CPP_TYPES = [(r"^(u?int(8|16|32|64)?_t|u?int|unsigned|size_t|long.*|short)$", "integer"), (r"^(double|float)$", "number"), (r"^bool$", "boolean"), (r"(string|sstring|path)", "string"), (r"^std::vector|^std::unordered_set|^std::set|^absl::flat_hash_set", "array"), (r"milliseconds|seconds|minutes|hours|chrono", "integer")]


def json_type(c: C) -> Column:
    """[SC-S41]"""
    x = F.regexp_replace(F.trim(col(c)), r"^const\s+|\s*&$", "")
    inner = F.regexp_replace(x, r"^std::optional<(.*)>$", "$1")
    out = F.lit("object")
    for pattern, kind in reversed(CPP_TYPES):
        out = F.when(inner.rlike(pattern), kind).otherwise(out)
    return out


def cpp_default(c: C) -> Column:
    """A C++ literal without suffixes, casts and braces [SC-S40]."""
    return replace_all(F.trim(col(c)), [(r"^std::(?:string|chrono::\w+)\s*[({](.*)[)}]$", "$1"), (r"^[{](.*)[}]$", "$1"), (r"(?<=\d)(?:u|l|ul|ll|ull|U|L|UL|LL|ULL)$", ""), (r"(?<=\d)'(?=\d)", ""), (r"^std::nullopt$", "null")])


def badge(label: C, tooltip: C, size: str = "medium") -> Column:
    """[SC-S42, U2]"""
    return F.format_string('<span class="badge badge--%s" title="%s">%s</span>', F.lit(size), escape_html(tooltip), escape_html(label))


def token_count(c: C) -> Column:
    """Words as a search index sees them, 1 at least [SC-M7]."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(F.coalesce(col(c), F.lit("")), r"[\s_./:-]+"), lambda w: w != "")))


def expand_attributes(c: C, values: dict[str, str]) -> Column:
    """{name} becomes its value, in the order given; unknown names stay [SC-J]."""
    return replace_all(c, [("{" + k + "}", v) for k, v in values.items()], regex=False)


def pointer_unescape(c: C) -> Column:
    """A JSON pointer's part: ~1 is a slash, then ~0 a tilde [SC-J, N30]."""
    return replace_all(c, [("~1", "/"), ("~0", "~")], regex=False)
