"""Scans and converters that follow a nesting no pattern describes: plain functions of one text, run over Arrow batches by readers.scan_rows or text_udf."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa

from .brackets import arguments, inside


def text_udf(f: Callable[[str], str | None]):
    """A function of one text as a function of a column, in Arrow batches; null stays null."""
    import pandas as pd
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    def run(s):
        return pd.Series([None if x is None else f(x) for x in s], dtype=object)

    return pandas_udf(run, "string", PandasUDFType.SCALAR)


# Go and C++ --------------------------------------------------------------------------------------------------------------------


def hidden_commands(text: str) -> list[tuple]:
    """(use, hidden, deprecated message) of command literals that are hidden or deprecated [SRC22]."""
    out = []
    for m in re.finditer(r"&cobra\.Command\{", text):
        block = inside(text, m.end() - 1)
        use = re.search(r'Use:\s*"([^" ]+)', block)
        hidden = bool(re.search(r"Hidden:\s*true", block))
        old = re.search(r'Deprecated:\s*"((?:[^"\\]|\\.)*)"', block)
        if use and (hidden or old):
            out.append((use[1], hidden, old[1] if old else None))
    for m in re.finditer(r"DeprecateCmd\s*\(", text):  # a call that deprecates: the constructor, then the message
        inner = arguments(inside(text, m.end() - 1))
        if len(inner) >= 2 and (old := re.fullmatch(r'"((?:[^"\\]|\\.)*)"', inner[-1])):
            out.append((re.sub(r"\(.*", "", inner[0]), False, old[1]))
    return out


HIDDEN = ("use string, hidden boolean, message string", [pa.string(), pa.bool_(), pa.string()])


def struct_fields(text: str) -> list[tuple]:
    """(struct, ordinal, type, field, default) of C++ structs; functions and nested blocks do not count [SRC19]."""
    out = []
    for m in re.finditer(r"\b(?:struct|class)\s+(\w+)[^;{]*\{", text):
        body = inside(text, m.end() - 1)
        while (inner := re.search(r"\{", body)) and "\n" in inside(body, inner.start()):
            body = body[: inner.start()] + ";" + body[inner.start() + len(inside(body, inner.start())) + 2 :]
        body = re.sub(r"//[^\n]*", "", body)
        for n, f in enumerate(re.finditer(r"(?m)^\s*([\w:]+(?:<[^;=]*>)?[\s&*]+)(\w+)\s*(?:=\s*([^;]+)|\{([^;]*)\})?;", body)):
            if f[1].strip() not in ("return", "using", "typedef", "friend"):
                out.append((m[1], n, f[1].strip(), f[2], (f[3] or f[4] or "").strip() or None))
    return out


FIELDS = ("struct string, ordinal int, type string, field string, default_value string", [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()])


def cpp_value(text: str) -> str | None:
    """JSON-like text of a C++ default: nullopt is null, quotes go, chrono keeps its number, a scoped name its last part [SRC35]."""
    x = text.strip().rstrip(",")
    if x in ("std::nullopt", "nullptr", ""):
        return None
    if m := re.fullmatch(r'(?:\w+::)*\w*string\w*\s*[({]\s*"(.*)"\s*[)}]|"(.*)"', x):
        return m[1] if m[1] is not None else m[2]
    if m := re.fullmatch(r"(?:std::)?chrono::(\w+)\s*[({]\s*(.+?)\s*[)}]", x):
        return f"{m[2]} {m[1]}"
    if m := re.fullmatch(r"[{(](.*)[)}]", x, re.S):
        return "[" + ", ".join(str(cpp_value(a)) for a in arguments(m[1])) + "]"
    if re.fullmatch(r"(?:\w+::)+\w+", x):
        return x.rpartition("::")[2]
    return re.sub(r"(?<=\d)'(?=\d)|(?<=\d)[uUlL]+$", "", x)


# AsciiDoc ----------------------------------------------------------------------------------------------------------------------


def document(text: str) -> list[tuple]:
    """(kind, level, name, body): title, attributes, sections and source blocks of an AsciiDoc text [SRC24, SC-S31]."""
    out, section, body, fence = [], ("section", 0, ""), [], None
    for line in text.split("\n"):
        if re.fullmatch(r"-{4,}|\.{4,}|={4,}|\+{4,}|`{3,}", line):
            fence = None if fence == line else fence or line
        m = None if fence else re.match(r"^(={1,6})\s+(.*)$", line)
        a = None if fence or m else re.match(r"^:([\w-]+):\s*(.*)$", line)
        if m:
            out.append((*section, "\n".join(body).strip()))
            section, body = ("title" if len(m[1]) == 1 else "section", len(m[1]) - 1, m[2].strip()), []
        elif a:
            out.append(("attribute", 0, a[1], a[2].strip()))
        else:
            body.append(line)
    out.append((*section, "\n".join(body).strip()))
    return [x for x in out if x[2] or x[3]]


DOCUMENT = ("kind string, level int, name string, body string", [pa.string(), pa.int32(), pa.string(), pa.string()])


def numbered_lists(text: str) -> str:
    """Indented numbered lines become list items where at least two follow each other by one [SC-S22, N35]."""
    lines = text.split("\n")
    found = [re.match(r"^\s+(\d+)[.)]\s+(.*)$", x) for x in lines]
    out, i = [], 0
    while i < len(lines):
        n = i
        while n < len(lines) and found[n] and (n == i or int(found[n][1]) == int(found[n - 1][1]) + 1):
            n += 1
        if n - i >= 2:
            out += [f". {found[k][2]}" for k in range(i, n)]
            i = n
        else:
            out.append(lines[i])
            i += 1
    return "\n".join(out)


def indented_tables(text: str) -> str:
    """Indented lines with cells two spaces apart become a table where there are at least two rows of at least two columns [SC-S22, N35]."""
    lines, out, i = text.split("\n"), [], 0
    cells = lambda x: re.split(r"\s{2,}", x.strip()) if re.match(r"^\s{2,}\S", x) else []
    while i < len(lines):
        n, width = i, len(cells(lines[i]))
        while n < len(lines) and width >= 2 and len(cells(lines[n])) == width:
            n += 1
        if n - i >= 2:
            out += ["|===", *("".join(f"|{c} " for c in cells(x)).rstrip() for x in lines[i:n]), "|==="]
            i = n
        else:
            out.append(lines[i])
            i += 1
    return "\n".join(out)


def definition_lists(text: str) -> str:
    """A term alone on a line with an indented or dashed explanation below becomes an entry of a description list, where at least two follow each other [SC-S22]."""
    lines, out, i = text.split("\n"), [], 0
    term = lambda n: n + 1 < len(lines) and re.match(r"^[\w`-][^.:]{0,60}:?$", lines[n]) and re.match(r"^\s{2,}\S", lines[n + 1])
    while i < len(lines):
        n, found = i, []
        while term(n):
            body, name = [], lines[n].rstrip(":")
            n += 1
            while n < len(lines) and re.match(r"^\s{2,}\S", lines[n]):
                body.append(lines[n].strip())
                n += 1
            found.append(f"{name}:: {' '.join(body)}")
        if len(found) >= 2:
            out += found
            i = n
        else:
            out.append(lines[i])
            i += 1
    return "\n".join(out)


def description(text: str) -> str:
    """A command's help text as AsciiDoc: numbered lists, description lists, tables, then what is still indented as listings, and blank lines folded [SC-S22]. The order matters: a listing would swallow the other three."""
    for f in (numbered_lists, definition_lists, indented_tables, code_blocks):
        text = f(text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def code_blocks(text: str, indent: int = 4) -> str:
    """Lines that are indented by four or more, after a blank line, become a listing [SC-S22]."""
    out, block = [], []
    for line in [*text.split("\n"), "\0"]:
        deep = line.startswith(" " * indent) and line.strip()
        if deep and (block or not out or not out[-1].strip()):
            block.append(line[indent:])
        else:
            if block:
                out += ["----", *block, "----"]
                block = []
            out.append(line)
    return "\n".join(out[:-1])


def first_mentions(text: str, names: dict[str, str]) -> str:
    """The first mention of each name in backticks in a paragraph becomes its macro; a list item starts a paragraph [SC-S30, N10]."""
    out, seen = [], set()
    for line in text.split("\n"):
        if not line.strip() or re.match(r"^\s*(?:[*.-]+|\d+\.)\s", line):
            seen = set()
        for n, macro in names.items():
            if n not in seen and f"`{n}`" in line:
                line = line.replace(f"`{n}`", macro, 1)
                seen.add(n)
        out.append(line)
    return "\n".join(out)


_ANCHORS = [re.compile(p) for p in (r"\[\[([\w:.-]+)(?:,.*)?\]\]", r"\[#([\w:.-]+)(?:[,.].*)?\]", r'\[id="?([\w:.-]+)"?(?:,.*)?\]')]


def heading_ids(text: str) -> list[tuple]:
    """(ordinal, id, title) of headings: the anchor on the line before, else an id made of the title; the first of an id counts [REC12]."""
    out: dict[str, str] = {}
    anchor = None
    for line in (x.strip() for x in text.split("\n")):
        found = next((m for p in _ANCHORS if (m := p.fullmatch(line))), None)
        if found:
            anchor = found[1]
            continue
        if m := re.match(r"^={1,6}\s+(\S.*)$", line):
            title = " ".join(re.sub(r"[\[\]]", "", re.sub(r"(?:xref|link|image):[^\[\s]*\[([^\]]*)\]", r"\1", m[1])).split())
            made = re.sub(r"[^\w\- .]", "", re.sub(r"[`*+#^~]", "", title).lower()).strip()
            ident = anchor or re.sub(r"^-+|-+$", "", re.sub(r"-{2,}", "-", re.sub(r"[ .]+", "-", made)))
            if ident and title:
                out.setdefault(ident, title)
        if line:
            anchor = None
    return [(n, i, t) for n, (i, t) in enumerate(out.items())]


HEADING_IDS = ("ordinal int, id string, title string", [pa.int32(), pa.string(), pa.string()])


# HTML --------------------------------------------------------------------------------------------------------------------------


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.lists, self.skip, self.pre, self.href, self.row = [], [], 0, 0, [], None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style", "nav"):
            self.skip += 1
        elif re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "table"):
            self.out.append("\n\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            if self.lists:
                self.lists[-1][1] += 1
            mark = "-" if not self.lists or self.lists[-1][0] == "ul" else f"{self.lists[-1][1]}."
            self.out.append("\n" + "  " * (len(self.lists) - 1) + mark + " ")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a":
            self.href.append(a.get("href") or "")
            self.out.append("[")
        elif tag == "tr":
            self.row = 0
            self.out.append("\n|")
        elif tag == "br":
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "nav"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a" and self.href:
            self.out.append(f"]({self.href.pop()})")
        elif tag in ("td", "th"):
            self.row = (self.row or 0) + 1
            self.out.append(" |")
        elif tag == "thead":
            self.out.append("\n|" + " --- |" * (self.row or 0))

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def markdown(html: str) -> str:
    """Markdown of an article, or of the whole where there is none: headings, lists, code, links, emphasis and tables [SC-S23]."""
    m = re.search(r"(?s)<article[^>]*>(.*?)</article>", html)
    p = _Markdown()
    p.feed(m[1] if m else html)
    p.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(p.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


# JSON schema -------------------------------------------------------------------------------------------------------------------


def schema_allows(schema: object, path: str) -> bool:
    """Whether a dotted path is allowed: properties, then patternProperties, then additionalProperties; references and combinations allow all [F20]."""
    at = schema
    for part in path.split("."):
        if not isinstance(at, dict) or any(k in at for k in ("$ref", "allOf", "anyOf", "oneOf")):
            return True
        if part in at.get("properties", {}):
            at = at["properties"][part]
        elif hits := [s for p, s in at.get("patternProperties", {}).items() if re.search(p, part)]:
            at = hits[0]
        elif at.get("additionalProperties", True) is False:
            return False
        else:
            at = at.get("additionalProperties")
    return True


#: Namespaces that are tried, in this order, for a type without one.
NAMESPACES = ["", "config::", "model::", "security::", "net::"]


def resolve_type(name: str, definitions: dict, seen: tuple = ()) -> dict | None:
    """The definition of a type, through references, with namespaces tried in order [SRC36]."""
    for n in NAMESPACES:
        d = definitions.get(n + name)
        if isinstance(d, dict):
            ref = str(d.get("$ref", "")).rpartition("/")[2]
            return resolve_type(ref, definitions, (*seen, name)) if ref and ref not in seen else d
    return None
