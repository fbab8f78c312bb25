"""Operators that fold, iterate or follow, against plain walks in Python over random inputs, and the cases of their docstrings."""

import copy
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import expressions as X
from sparkloom.operators import builds, constants, diffs, documents, ownership, releases

# expressions -----------------------------------------------------------------------------------------------------------------------


def test_arithmetic(spark):
    cases = {"7 * 24h": 604800000, "1d": 86400000, "1.5h": 5400000, "24h * 365": 31536000000, "2+3*4": 14, "(2+3)*4": 20, "10-4-3": 3, "8/2/2": 2, "-3+5": 2, "2*-3": -6, "-(1 - 3) * 2": 4, "((5))": 5, "(1h + 30min) * 2": 10800000, "5ms": 5, "100": 100, "1/0": None, "x": None, "": None, "3 4": None, "*3": None, "3*": None, "5x": None, "a::b + 1": None, None: None}
    got = spark.createDataFrame([(k,) for k in cases], "x string").select("x", X.calculate("x").alias("v")).collect()
    assert {r.x: r.v for r in got} == cases


def test_durations_by_type(spark):
    rows = [("7 * 24h", "std::chrono::seconds", 604800), ("7 * 24h", "std::optional<std::chrono::minutes>", 10080), ("90min", "std::chrono::hours", 1), ("-90min", "std::chrono::hours", -1), ("5000", "std::chrono::seconds", 5), ("1.5h", "std::chrono::milliseconds", 5400000), ("1h", "some_duration", 3600000), ("1h", None, 3600000), ("x", "int", None), (None, "int", None)]
    df = spark.createDataFrame(rows, "x string, k string, want long").withColumn("got", X.duration("x", "k"))
    assert df.filter(~F.col("want").eqNullSafe(F.col("got"))).collect() == []


def holds(tag, system):
    return {"linux": system == "linux", "darwin": system == "darwin", "windows": system == "windows", "unix": system in X.UNIX, "amd64": True, "cgo": True}.get(tag, False)


def constraint_value(text, system):
    tokens, at = re.findall(r"[A-Za-z0-9_.]+|&&|\|\||!|\(|\)", text), 0

    def one():
        nonlocal at
        t, at = tokens[at], at + 1
        if t == "(":
            v, at = either(), at + 1
            return v
        return not one() if t == "!" else holds(t, system)

    def both():
        nonlocal at
        v = one()
        while at < len(tokens) and tokens[at] == "&&":
            at += 1
            v = one() and v
        return v

    def either():
        nonlocal at
        v = both()
        while at < len(tokens) and tokens[at] == "||":
            at += 1
            v = both() or v
        return v

    return either()


def test_build_constraints(spark):
    r = random.Random(1)

    def some(d):
        k = r.random()
        if d == 0 or k < 0.3:
            return r.choice(["linux", "darwin", "unix", "windows", "amd64", "cgo", "custom", "x.y"])
        return "!" + some(d - 1) if k < 0.45 else f"({some(d - 1)})" if k < 0.6 else some(d - 1) + r.choice([" && ", "||"]) + some(d - 1)

    df = spark.createDataFrame([(some(4), s) for _ in range(300) for s in ("linux", "windows")], "e string, s string")
    assert [x for x in df.select("e", "s", X.builds("e", F.col("s")).alias("v")).collect() if x.v != constraint_value(x.e, x.s)] == []
    broken = spark.createDataFrame([("",), ("&&",), ("linux &&",), (None,)], "e string").select(X.builds("e", "linux").alias("v")).collect()
    assert [x.v for x in broken] == [False, False, False, False]


def test_files_that_build(spark):
    lines = [(["linux,amd64 darwin", "!windows"], True), ([], True), (["!!linux"], True), (["custom"], False), ([" "], True), (["linux,custom"], False)]
    df = spark.createDataFrame(lines, "l array<string>, want boolean")
    assert df.filter(X.builds_lines(F.col("l"), "linux") != F.col("want")).collect() == []
    names = {"a_linux.go": "linux", "a_linux_amd64.go": "linux", "linux.go": None, "a_amd64.go": None, "linux_amd64.go": None, "b_k8s_darwin.go": "darwin", "a_test.go": None}
    assert {x.n: x.v for x in spark.createDataFrame([(n,) for n in names], "n string").select("n", X.system_of_file("n").alias("v")).collect()} == names
    files = [("a.go", "// x\n//go:build !linux\n\npackage a", False), ("a.go", "//go:build unix\n// +build !linux\npackage a", True), ("a.go", "// +build linux\n// +build !cgo\npackage a", False), ("a_darwin.go", "package a", False), ("a.go", "package x\n//go:build windows", True), ("a.go", None, True)]
    df = spark.createDataFrame(files, "n string, c string, want boolean")
    assert df.filter(X.file_builds("n", "c", "linux") != F.col("want")).collect() == []


def test_commands_of_one_system(spark):
    text = 'package a\nfunc NewACommand(fs x) *cobra.Command {\n c := &cobra.Command{ Use: "aa [x]" }\n c.AddCommand(NewOne(1, NewInner(2)), sub.NewCommand(fs), x.newThingCmd(), rp.NewLauncher())\n}\nfunc NewHid() *cobra.Command {\n Use: "h", Hidden: true }\nNewLater()'
    row = spark.createDataFrame([(text,)], "c string").select(builds.constructors("c").alias("m"), builds.added_commands("c").alias("a")).first()
    assert [tuple(x) for x in row.m] == [("NewACommand", "aa", False), ("NewHid", "h", True)]
    assert [tuple(x) for x in row.a] == [(None, "NewOne"), (None, "NewInner"), ("sub", "NewCommand"), ("x", "newThingCmd"), ("rp", "NewLauncher")]
    command = 'package s\nfunc NewCommand(a b) *cobra.Command {\n Use: "sub" }'
    files = [
        ("", "main.go", "package m\nfunc New() *cobra.Command {\n x.AddCommand(NewACommand(), sub.NewCommand(f))}"), ("sub", "s_linux.go", command), ("internal", "z_linux.go", command), ("bare", "b_linux.go", "package b"),
        ("a", "x_linux.go", "package a\nx.AddCommand(NewStartCommand(), NewBoth(), y.NewCommand(rp.NewLauncher()))"), ("a", "x_darwin.go", "package a\nx.AddCommand(NewBoth())"),
        ("a", "c.go", 'package a\nfunc NewStartCommand() *cobra.Command {\n Use: "begin now"}\nfunc NewBoth() *cobra.Command {\nUse: "both"}'), ("cmd/q", "z.go", f"//go:build unix && !darwin\n\n{command}"), ("n", None, None),
    ]
    df = spark.createDataFrame(files, "folder string, name string, contents string")
    assert sorted(x.command for x in builds.only_on(df).collect()) == ["tool a begin", "tool a y", "tool q", "tool sub"]


# constants -------------------------------------------------------------------------------------------------------------------------


def test_constants_through_constants(spark):
    given = [("a", "1h"), ("b", "a * 2 + 3"), ("c", "b - a"), ("d", "e"), ("e", "d"), ("f", "nope"), ("g", "(c + b) / 2"), ("h", None), ("i", "a * a"), ("k::n", "a"), ("j", "k::n + f"), ("z", "2"), ("z", "3")]
    found = constants.resolve_constants(spark.createDataFrame(given, "name string, expression string"))
    assert {x.name: x.value for x in found.collect()} == {"a": 3600000, "b": 7200003, "c": 3600003, "d": None, "e": None, "f": None, "g": 5400003, "h": None, "i": 3600000**2, "k::n": 3600000, "j": None, "z": 2}
    rows = [("x", "a * 2", "std::chrono::seconds"), ("y", "90min", "std::chrono::hours"), ("z", "oops", "int"), ("w", None, "int"), ("v", "b", None)]
    got = constants.evaluate_defaults(spark.createDataFrame(rows, "key string, default string, c_type string"), found, "key")
    assert {x.key: x.value for x in got.collect()} == {"x": 7200, "y": 1, "z": None, "w": None, "v": 7200003}
    with pytest.raises(ValueError, match="stand behind"):
        constants.resolve_constants(spark.createDataFrame(given, "name string, expression string"), 1)


# config trees ----------------------------------------------------------------------------------------------------------------------


def depth_of(tree, target, d=0):
    for name, inner in tree:
        if name == target:
            return d
        if inner and (found := depth_of(inner, target, d + 1)) != -1:
            return found
    return -1


def names_of(tree):
    for name, inner in tree:
        yield name
        yield from names_of(inner)


def crumbs_of(tree, target, before=()):
    for name, inner in tree:
        if name == target:
            return [*before, name]
        if inner and (found := crumbs_of(inner, target, (*before, name))):
            return found
    return None


def shown_of(tree, target):
    for name, inner in tree:
        if name == target:
            return [(name, True), *((n, False) for n, _ in inner)] if inner else [(n, False) for n, _ in tree]

    def below(items, parent=None):
        for item in items:
            name, inner = item
            if name == target:
                if inner:
                    return [(name, False)]
                beside = [x for x in parent[1] if x[0] != target] if parent else []
                return [(parent[0], True), *((n, False) for n, _ in parent[1])] if any(not x[1] for x in beside) else []
            if inner and (found := below(inner, item)) is not None:
                return found
        return None

    return below(tree)


@pytest.fixture(scope="module")
def configs(spark):
    r = random.Random(5)

    def tree(d):
        return [(r.choice("abcdefgh"), tree(d - 1) if d and r.random() < 0.6 else []) for _ in range(r.randrange(1, 4))]

    given, rows = [(i, r.choice("abcdefghij"), tree(3)) for i in range(150)], []

    def put(i, items, parent):
        for position, (name, inner) in enumerate(items):
            own = f"{i}-{len(rows)}"
            rows.append((str(i), own, parent, position, name))
            put(i, inner, own)

    for i, _, t in given:
        put(i, t, None)
    return given, ownership.placed(spark.createDataFrame(rows, "config string, id string, parent string, position int, name string"))


def test_config_owners(spark, configs):
    given, places = configs
    want: dict = {}
    for i, owner, t in given:
        have = want.get(owner)
        if have is None or have[1] != owner or depth_of(t, owner) >= depth_of(given[have[0]][2], owner):
            want[owner] = (i, owner)
        for c in dict.fromkeys(names_of(t)):
            have = want.get(c)
            if have is None or depth_of(t, c) > depth_of(given[have[0]][2], c):
                want[c] = (i, owner)
    rows = spark.createDataFrame([(str(i), i, o) for i, o, _ in given] + [("empty", 999, "a")], "config string, ordinal long, owner string")
    for width in (1024, 7):
        assert {x.component: (int(x.config), x.owner) for x in ownership.config_owners(rows, places, width).collect()} == want
    assert ownership.config_owners(rows.limit(0), places).collect() == []


def test_config_entries_and_breadcrumbs(configs):
    given, places = configs
    have: dict = {}
    for x in ownership.shown_entries(places).collect():
        have.setdefault((int(x.config), x.component), []).append((x.position, x.entry, x.items_only))
    for i, _, t in given:
        for c in set(names_of(t)):
            assert [(e, o) for _, e, o in sorted(have.get((i, c), []))] == shown_of(t, c)
    assert all(x.crumbs == crumbs_of(given[int(x.config)][2], x.component) for x in ownership.breadcrumbs(places).collect())


# releases --------------------------------------------------------------------------------------------------------------------------


def test_chain_is_all_steps(spark):
    r = random.Random(6)
    parts = [(n, r.choice("xy"), c, r.choice(["stable", "deprecated", None]), r.random() < 0.5, r.random() < 0.5, None) for n in (2, 3, 5, 8, 9, 20) for c in "abcdef" if r.random() < 0.7]
    fields = [(*c[:3], f, str(r.randrange(3)), r.choice(["a", "deprecated"]), r.random() < 0.3) for c in parts for f in "pqr" if r.random() < 0.7]
    components = spark.createDataFrame(parts, "release int, type string, name string, status string, requires_cgo boolean, cloud_supported boolean, cloud_only boolean").cache()
    inner = spark.createDataFrame(fields, "release int, type string, name string, field string, default_json string, status string, is_deprecated boolean").cache()
    at = lambda df, n: df.filter(f"release = {n}").drop("release")
    want_c, want_f = [], []
    for a, b in ((2, 3), (3, 5), (5, 8), (8, 9), (9, 20)):
        o, n = at(components, a), at(components, b)
        want_c += diffs.compare_components(o, n).select(F.lit(b).alias("release"), "*").collect()
        want_f += diffs.compare_fields(at(inner, a), at(inner, b), o, n).select(F.lit(b).alias("release"), "*").collect()
    assert sorted(map(str, releases.chain_components(components).collect())) == sorted(map(str, want_c))
    assert sorted(map(str, releases.chain_fields(inner, components).collect())) == sorted(map(str, want_f))
    assert releases.chain_components(components.filter("release = 2")).collect() == []
    runs = spark.createDataFrame([(1, "k", "u"), (2, "k", "u"), (3, "k", "v"), (5, "k", "v"), (5, "m", None), (4, "m", None)], "release int, key string, v string")
    assert sorted((x.key, x.v, x.first, x.last) for x in releases.intervals(runs, ["key"], ["v"]).collect() if x.v) == [("k", "u", 1, 2), ("k", "v", 3, 3), ("k", "v", 5, 5)]


# documents -------------------------------------------------------------------------------------------------------------------------


def reference_errors(doc):
    """The same walk in plain Python."""
    out = []

    def follow(ref, context, seen):
        if not isinstance(ref, str) or not ref:
            out.append((context, f"not a reference: {json.dumps(ref, separators=(",", ":"))}"))
        elif not ref.startswith("#/"):
            out.append((context, f"must start with #/: {ref}"))
        elif ref in seen:
            out.append((context, f"circular: {ref}"))
        else:
            at = doc
            for part in ref[2:].split("/"):
                part = part.replace("~1", "/").replace("~0", "~")
                if isinstance(at, dict) and part in at:
                    at = at[part]
                elif isinstance(at, list) and part.isdigit() and int(part) < len(at):
                    at = at[int(part)]
                else:
                    return out.append((context, f"does not exist: {ref}"))
            walk(at, f"{context} -> {ref}", seen | {ref})
        return None

    def walk(node, context, seen):
        if isinstance(node, list):
            for i, x in enumerate(node):
                walk(x, f"{context}[{i}]", seen)
        elif isinstance(node, dict):
            if node.get("$ref"):
                follow(node["$ref"], context, seen)
            if "$refs" in node and isinstance(node["$refs"], list):
                for i, x in enumerate(node["$refs"]):
                    follow(x, f"{context}.$refs[{i}]", seen)
            elif node.get("$refs"):
                out.append((context, "$refs must be an array"))
            for k, x in node.items():
                if k not in ("$ref", "$refs"):
                    walk(x, f"{context}.{k}" if context else k, seen)

    walk(doc, "", frozenset())
    return out


def test_reference_errors(spark):
    docs = [
        {"d": {"a": {"$ref": "#/d/b"}, "b": {"$ref": "#/d/a"}, "ok": {"x": 1}}, "u": {"$ref": "d/a"}, "v": {"$refs": ["#/d/ok", "#/d/ok", "#/no"]}, "w": {"$refs": 1}, "e~f": {"g/h": {"$ref": "#/e~0f/g~1h"}}},
        {"l": [{"$ref": "#/m"}, [{"$ref": "#/l/0"}]], "m": {"n": {"$refs": ["#/l/1", "#/l/9"]}}, "n": {"$ref": 5}, "r": {"$refs": ["", 3, "#/"]}, "s": {"$ref": ""}, "": {"$refs": "x"}},
        {"$ref": "#/a", "a": {"$refs": ["#/a"]}}, {"$refs": [{"$ref": "#/x"}], "x": {"$ref": {"$ref": "#/x"}}}, [], 5,
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(90, None), (91, "{x")], "doc int, json string")
    got = sorted((x.doc, x.context, x.error) for x in documents.reference_errors(df).collect())
    assert got == sorted((i, *e) for i, d in enumerate(docs) for e in reference_errors(d))
    with pytest.raises(ValueError, match="deeper"):
        documents.reference_chains(df, 1)


def is_set(v):
    return not (v is None or v is False or v == "" or (isinstance(v, (int, float)) and v == 0))


def name_of(x, k="name"):
    return json.dumps(x[k]) if isinstance(x, dict) and k in x else "~"


def laid_over(t, o):
    """Overrides by rule in plain Python."""
    if not isinstance(o, (dict, list)):
        return t
    for k in o:
        a, b = t.get(k), o[k]
        if k == documents.OPTIONS and isinstance(a, list) and isinstance(b, list):
            part = lambda p, i: p[i] if isinstance(p, list) and len(p) > i else None
            new, have = {json.dumps(part(p, 0)): part(p, 1) for p in b}, {json.dumps(part(p, 0)) for p in a}
            t[k] = [[part(p, 0), new.get(json.dumps(part(p, 0)), part(p, 1))] for p in a] + [[part(p, 0), part(p, 1)] for p in b if json.dumps(part(p, 0)) not in have]
        elif k == documents.EXAMPLES and isinstance(b, list):
            a = a if isinstance(a, list) else []
            new, have = {name_of(e, "title"): e for e in b}, {name_of(e, "title") for e in a}
            t[k] = [e | {f: new[name_of(e, "title")][f] for f in ("summary", "config") if is_set(new.get(name_of(e, "title"), {}).get(f))} for e in a] + [e for e in b if name_of(e, "title") not in have]
        elif isinstance(a, list) and isinstance(b, list):
            for i, item in enumerate(a):
                over = next((x for x in b if name_of(x) == name_of(item)), None)
                if isinstance(over, dict) and isinstance(item, dict):
                    item |= {f: copy.deepcopy(over[f]) for f in [*documents.REPLACED, documents.ON_ITEMS] if f in over}
                    a[i] = laid_over(item, over)
        elif isinstance(a, dict) and isinstance(b, dict):
            t[k] = laid_over(a, b)
        elif k in documents.REPLACED:
            t[k] = copy.deepcopy(b)
    return t


def test_overrides_by_rule(spark):
    r = random.Random(7)

    def value(d):
        k = r.random()
        if d <= 0 or k < 0.35:
            return r.choice(["a", "b", 1, True, None, 'q"x', 1.5, ""])
        return some(d - 1) if k < 0.75 else [some(d - 1) if r.random() < 0.8 else r.choice([1, "s"]) for _ in range(r.randrange(3))]

    def some(d):
        out = {}
        for _ in range(r.randrange(1, 5)):
            k = r.choice(["name", "description", "type", "version", "fields", "config", "selfManagedOnly", "other", "examples", "annotated_options"])
            if k == "name":
                out[k] = r.choice("abc")
            elif k == "examples":
                out[k] = [{"title": r.choice("xyz"), **{f: r.choice(["s", "", {"u": 1}]) for f in ("summary", "config") if r.random() < 0.6}} for _ in range(r.randrange(3))] if r.random() < 0.8 else "no"
            elif k == "annotated_options":
                out[k] = [[r.choice("mno"), r.choice(["1", "2"])] + (["third"] if r.random() < 0.2 else []) for _ in range(r.randrange(3))] if r.random() < 0.8 else 5
            else:
                out[k] = [some(d - 1) for _ in range(r.randrange(4))] if k == "fields" and d > 0 else value(d - 1)
        return out

    targets, overs = [some(4) for _ in range(120)], [some(4) for _ in range(120)]
    targets.append({"f": [{"name": "a", "v": 1}], "s": [1]})
    overs.append({"f": [{"name": "a", "v": 2}, {"name": "b"}], "s": [1, 2]})
    want = {str(i): laid_over(copy.deepcopy(a), copy.deepcopy(b)) for i, (a, b) in enumerate(zip(targets, overs, strict=True))}
    assert want["120"] == targets[120]
    docs = spark.createDataFrame([(str(i), json.dumps(a)) for i, a in enumerate(targets)] + [("none", '{"b":1,"a":[]}')], "doc string, json string")
    over = spark.createDataFrame([(str(i), json.dumps(a)) for i, a in enumerate(overs)] + [("unknown", "{}")], "doc string, json string")
    assert {x.doc: json.loads(x.json) for x in documents.merge_overrides(docs, over).collect()} == want | {"none": {"b": 1, "a": []}}
