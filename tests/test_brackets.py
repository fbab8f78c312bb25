"""Arguments, literals and declarations of C-like text, where quotes and angles mean different things."""

import pytest

from sparkloom.sources import cpp, scanners
from sparkloom.sources.brackets import arguments, closing, inside

CASES = {
    "a, f(b, c), \"x,y\", {1, 2}": ["a", "f(b, c)", '"x,y"', "{1, 2}"],
    "a -> b, c": ["a -> b", "c"], "a->b, c": ["a->b", "c"], "x << 2, y": ["x << 2", "y"], "x<<2, y": ["x<<2", "y"], "i < 3, j > 4": ["i < 3", "j > 4"],
    "10'000, x, y": ["10'000", "x", "y"], "1'000'000u, 0xFF'FF, 'c', ',', '\\''": ["1'000'000u", "0xFF'FF", "'c'", "','", "'\\''"],
    '"a\\"b,c", d': ['"a\\"b,c"', "d"], '"a\\\\", "b"': ['"a\\\\"', '"b"'], 'R"(a,"b)", c': ['R"(a,"b)"', "c"], 'R"x(a)",b)x", c': ['R"x(a)",b)x"', "c"], 'OR"a,b", c': ['OR"a,b"', "c"],
    "std::map<int, std::vector<int>>{}, y": ["std::map<int, std::vector<int>>{}", "y"], "f<int>(1, 2), std::function<void(int, int)>{}, z": ["f<int>(1, 2)", "std::function<void(int, int)>{}", "z"],
    "[](auto v) { return v < 3, 'x'; }, b": ["[](auto v) { return v < 3, 'x'; }", "b"], "a /* x, y */, b // c, d": ["a /* x, y */", "b // c, d"],
    "": [], "a,": ["a"], ",": [""], "(a, b": ["(a, b"], "a), b": ["a)", "b"],
}


@pytest.mark.parametrize("text", CASES)
def test_arguments(text):
    want = CASES[text]
    assert [a for a in arguments(text) if a or not want] in (want, [w for w in want if w])


def test_brackets():
    assert inside('f("}") } x', 0 + 1) == '"}"' and closing("{ '}' 1'0 }", 0) == 10 and closing("(a", 0) == 2
    assert closing("p<std::optional<int>> x", 1) == 20 and closing("a < b", 2) == 5


def test_settings_around_digit_separators():
    """An odd number of separators does not open a quote."""
    got = cpp.source_arguments('x(*this, "x", 10\'000, a->b, 3), y(*this, "y", {1\'0, 2}, v << 1)')
    assert [(n, v) for n, _, _, v in got] == [("x", "x"), ("x", "10'000"), ("x", "a->b"), ("x", "3"), ("y", "y"), ("y", "{1'0, 2}"), ("y", "v << 1")]


def test_members_with_initialisers_and_of_several_names():
    text = "struct c { property<int> a{1}; property<std::optional<int>> b, d{2} , e = 5; deprecated_property f; enterprise<property<bool>> g{f<int>(1, 2)}; property<int> fn(int x); property<int> h };"
    assert [(n, t) for n, t, _ in cpp.header_settings(text)] == [("a", "property<int>"), ("b", "property<std::optional<int>>"), ("d", "property<std::optional<int>>"), ("e", "property<std::optional<int>>"), ("g", "enterprise<property<bool>>")]


def test_values_in_lists():
    assert scanners.cpp_value("{1'000, f(a, b), x::y, \"q,r\"}") == '[1000, f(a, b), y, q,r]'
