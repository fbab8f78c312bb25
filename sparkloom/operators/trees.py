"""Trees and references, as edge tables that are joined level by level. Each level is a join on its key; depth is bounded by a parameter."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import C, col
from ..session import stored


def _levels(start: DataFrame, step, most: int, what: str) -> DataFrame:
    """Union of start and what step makes of each level, until a level is empty. Levels are tables in the shared folder, so lineage does not grow and each is worked out once."""
    out = level = stored(start)
    for _ in range(most):
        level = stored(step(level, out))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"{what} is deeper than {most} levels")


def flatten(nodes: DataFrame, node: str = "id", parent: str = "parent", name: str = "name", sep: str = " ", most: int = 50) -> DataFrame:
    """(id, path, depth) of all nodes below roots (null parent); a node without a name adds nothing to the path, though its children count [REC1, D7, AGG22]."""
    rows = nodes.select(F.col(node).alias("id"), F.col(parent).alias("parent"), F.trim(F.coalesce(name, F.lit(""))).alias("__n"), F.col(name).alias("name"))
    start = rows.filter("parent is null").select("id", F.when(F.col("__n") == "", "").otherwise(F.col("name")).alias("path"), F.lit(0).alias("depth"))

    def step(level, _):
        child = rows.filter("parent is not null").join(level.select(F.col("id").alias("parent"), F.col("path").alias("__p"), "depth"), "parent")
        joined = F.when(F.col("__n") == "", F.col("__p")).when(F.col("__p") == "", F.col("name")).otherwise(F.concat("__p", F.lit(sep), "name"))
        return child.select("id", joined.alias("path"), (F.col("depth") + 1).alias("depth"))

    return _levels(start, step, most, "the tree")


def closure(edges: DataFrame, start: DataFrame, source: str = "source", target: str = "target", most: int = 100) -> DataFrame:
    """All ids that can be reached from start (id), start included [REC4]. What was reached before is left out, so cycles end."""
    e = edges.select(F.col(source).alias("id"), F.col(target).alias("__t")).distinct()
    return _levels(start.select("id").distinct(), lambda level, seen: level.join(e, "id").select(F.col("__t").alias("id")).distinct().join(seen, "id", "left_anti"), most, "the graph")


def subtree(paths: DataFrame, root: str, path: str = "path", sep: str = " ") -> DataFrame:
    """[REC7]"""
    return paths.filter((F.col(path) == root) | F.col(path).startswith(root + sep))


def splice(tree: DataFrame, plugin: DataFrame, root: str, path: str = "path", sep: str = " ") -> DataFrame:
    """The tree with what lies at and under root replaced by the plugin's rows [REC11]."""
    return tree.filter(~((F.col(path) == root) | F.col(path).startswith(root + sep))).unionByName(plugin, allowMissingColumns=True)


def depth(path: C, sep: str = " ") -> Column:
    return F.size(F.split(col(path), F.lit(f"\\Q{sep}\\E"))) - 1


def dotted_fields(schema: object, prefix: str = "") -> list[tuple[str, str]]:
    """(path, type) of nested fields: dots between names, [] after arrays, deprecated ones left out [REC2]."""
    out = []
    for f in schema or []:
        if f.get("is_deprecated") or f.get("deprecated"):
            continue
        path = f"{prefix}.{f['name']}" if prefix else f["name"]
        path += "[]" if f.get("kind") == "array" or f.get("type") == "array" else ""
        out.append((path, str(f.get("type", ""))))
        out += dotted_fields(f.get("children"), path)
    return out


def _pointer(doc: object, ref: str):
    at = doc
    for part in ref.removeprefix("#").strip("/").split("/"):
        at = at.get(part) if isinstance(at, dict) else None
    return at


def resolve(node: object, doc: object, seen: tuple[str, ...] = (), depth: int = 0):
    """$ref and $refs replaced by what they point at; keys beside one override it; a reference to itself is dropped [REC3, N29, N30]."""
    if depth > 50:
        return node
    if isinstance(node, list):
        return [resolve(x, doc, seen, depth + 1) for x in node]
    if not isinstance(node, dict):
        return node
    refs = ([node["$ref"]] if isinstance(node.get("$ref"), str) else []) + list(node.get("$refs") or [])
    out: dict = {}
    for r in refs:
        if r not in seen:
            found = resolve(_pointer(doc, r), doc, (*seen, r), depth + 1)
            if isinstance(found, dict):
                out |= found
            elif found is not None and len(node) == 1:
                return found
    return out | {k: resolve(v, doc, seen, depth + 1) for k, v in node.items() if k not in ("$ref", "$refs")}


def deep_merge(a: object, b: object):
    """b over a: objects by key, arrays of named objects by name, other arrays as a union, else b [REC6, SET4]."""
    if isinstance(a, dict) and isinstance(b, dict):
        return {**a, **{k: deep_merge(a[k], v) if k in a else v for k, v in b.items()}}
    if isinstance(a, list) and isinstance(b, list):
        if all(isinstance(x, dict) and "name" in x for x in a + b):
            names = {x["name"]: x for x in a}
            for x in b:
                names[x["name"]] = deep_merge(names[x["name"]], x) if x["name"] in names else x
            return list(names.values())
        return a + [x for x in b if x not in a]
    return b


def rewrite_strings(node: object, f):
    """f over all strings of a JSON value, keys left alone [REC8]."""
    if isinstance(node, dict):
        return {k: rewrite_strings(v, f) for k, v in node.items()}
    if isinstance(node, list):
        return [rewrite_strings(x, f) for x in node]
    return f(node) if isinstance(node, str) else node


def wrap_ref_siblings(node: object):
    """A $ref with other keys beside it becomes allOf [REC9]."""
    if isinstance(node, list):
        return [wrap_ref_siblings(x) for x in node]
    if not isinstance(node, dict):
        return node
    rest = {k: wrap_ref_siblings(v) for k, v in node.items() if k != "$ref"}
    return {"allOf": [{"$ref": node["$ref"]}], **rest} if "$ref" in node and rest else {**({"$ref": node["$ref"]} if "$ref" in node else {}), **rest}


def json_udf(f):
    """A function of JSON values as a function of columns of JSON text, in Arrow batches. These walks have no fixed depth, which no built-in expresses."""
    import pandas as pd

    def run(*columns: pd.Series) -> pd.Series:
        out = [json.dumps(f(*(None if x is None else json.loads(x) for x in row)), sort_keys=True, ensure_ascii=False) for row in zip(*columns, strict=True)]
        return pd.Series(out)

    run.__annotations__ = {}
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    return pandas_udf(run, "string", PandasUDFType.SCALAR)


def apply_overrides(tree: DataFrame, overrides: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """Override bodies merged into command bodies by path [REC10, J44]; both are JSON text."""
    merge = json_udf(lambda a, b: deep_merge(a or {}, b) if b is not None else a)
    return tree.join(overrides.select(path, F.col(body).alias("__o")), path, "left").withColumn(body, F.when(F.col("__o").isNull(), F.col(body)).otherwise(merge(F.col(body), F.col("__o")))).drop("__o")
