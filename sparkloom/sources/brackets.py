"""Brackets, literals and arguments in C-like source text: small scans that the scanners of declarations share."""

from __future__ import annotations

import re

_PAIRS = {"(": ")", "{": "}", "[": "]"}
_RAW = re.compile(r'R"([^(\s]{0,16})\(')
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"?', re.S)
_CHARACTER = re.compile(r"'(?:[^'\\\n]|\\.)+'")
_TICKS = re.compile(r"`[^`]*`?")
_NUMBER = re.compile(r"(?<![\w'])\d(?:[\w.]|'(?=\w))*")
_COMMENT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|$)", re.S)
#: Places at which the scans below have to look; all between them is passed over at once.
_STOP = r"""["'`(){}\[\]]|R"|//|/\*|(?<![\w'])\d"""
_STOPS = re.compile(_STOP)
_ARGUMENT_STOPS = re.compile(f"{_STOP}|[,<]")
_TEMPLATE_STOPS = re.compile(r"""[<>()\[\];{}"'=!|+/%?]|&&|->""")


def literal_end(text: str, at: int) -> int:
    """Where a string, character, number or comment that starts at `at` ends; `at` if none does. A quote between digits belongs to the number."""
    c = text[at]
    if c == "R" and (m := _RAW.match(text, at)) and not (at and (text[at - 1].isalnum() or text[at - 1] == "_")):
        end = text.find(f"){m[1]}\"", m.end())
        return len(text) if end < 0 else end + len(m[1]) + 2
    pattern = _STRING if c == '"' else _CHARACTER if c == "'" else _TICKS if c == "`" else _COMMENT if c == "/" else _NUMBER if c.isdigit() else None
    m = pattern.match(text, at) if pattern else None
    return m.end() if m else at


def template_end(text: str, at: int) -> int:
    """Where the < at `at` closes as a list of template arguments, or -1 where it is an operator: it must follow a name at once, and hold names, numbers and brackets only."""
    if not at or not (text[at - 1].isalnum() or text[at - 1] == "_") or text[at - 1].isdigit() and _is_number_before(text, at):
        return -1
    depth, inner = 0, 0
    for m in _TEMPLATE_STOPS.finditer(text, at):
        c = m[0]
        if c == "<":
            depth += 1
        elif c == ">":
            depth -= 1
            if not depth:
                return m.start()
        elif c in "([":
            inner += 1
        elif c in ")]":
            inner -= 1
            if inner < 0:
                return -1
        else:
            return -1
    return -1


def _is_number_before(text: str, at: int) -> bool:
    return bool(re.search(r"(?<![\w'])\d[\w.']*$", text[max(0, at - 64) : at]))


def closing(text: str, at: int) -> int:
    """Place of the bracket that closes the one at `at`, which may be a < of template arguments; the end of the text if there is none."""
    if text[at] == "<":
        end = template_end(text, at)
        return len(text) if end < 0 else end
    stack, i = [], at
    while m := _STOPS.search(text, i):
        i = m.start()
        if (end := literal_end(text, i)) > i:
            i = end
            continue
        c = text[i]
        if c in _PAIRS:
            stack.append(_PAIRS[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return i
        i += 1
    return len(text)


def inside(text: str, at: int) -> str:
    """What lies between the bracket at `at` and the one that closes it."""
    return text[at + 1 : closing(text, at)]


def arguments(text: str) -> list[str]:
    """The arguments of a call or initialiser, split at commas outside brackets, template arguments and literals [SRC35]."""
    out, at, i = [], 0, 0
    while m := _ARGUMENT_STOPS.search(text, i):
        i = m.start()
        if (end := literal_end(text, i)) > i:
            i = end
            continue
        c = text[i]
        if c in _PAIRS:
            i = closing(text, i)
        elif c == "<" and (end := template_end(text, i)) > 0:
            i = end
        elif c == ",":
            out.append(text[at:i].strip())
            at = i + 1
        i += 1
    last = text[at:].strip()
    return [*out, last] if last or out else []
