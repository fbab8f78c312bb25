"""JSON documents as tables of places: overrides merged by rules, and references followed, as joins over the places of all documents at once.

A place is the array of keys and indices that leads to a value. Documents are taken apart level by level with the variant functions and
put together again from the deepest level up; a level is one table. Keys come out in sorted order, numbers as Spark writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .trees import _levels

#: JSON texts that count as unset.
UNSET = ["null", "false", "0", "-0", "0.0", '""']


def _texts() -> Column:
    return F.array().cast("array<string>")


def _part(text: Column, path: str) -> Column:
    """The JSON text of a part of a JSON text, null where there is none."""
    return F.to_json(F.try_variant_get(F.try_parse_json(text), path, "variant"))


def _up(c: str = "place") -> Column:
    return F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))


def _end(c: str = "place") -> Column:
    return F.get(F.col(c), F.size(c) - 1)


def _kind(text: Column) -> Column:
    return F.when(text.startswith("{"), "object").when(text.startswith("["), "array").otherwise("value")


def _children(level: DataFrame) -> DataFrame:
    """(what the level has, pos, key, value) of the values inside its objects and arrays; value is JSON text."""
    inner = level.filter("kind != 'value'").withColumn("__v", F.try_parse_json("text"))
    tvf = level.sparkSession.tvf
    return inner.lateralJoin(tvf.variant_explode(F.col("__v").outer())).withColumn("value", F.to_json("value")).drop("__v")


def places(docs: DataFrame, most: int = 60) -> DataFrame:
    """(doc, place, labels, kind, text) of all values of documents (doc, json): labels are .key or [index], kind is object, array or value. Text that is no JSON has no values."""
    start = docs.select("doc", _texts().alias("place"), _texts().alias("labels"), F.to_json(F.try_parse_json("json")).alias("text")).filter("text is not null").withColumn("kind", _kind(F.col("text")))

    def step(level: DataFrame, _: DataFrame) -> DataFrame:
        name = F.coalesce("key", F.col("pos").cast("string"))
        label = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos"), F.lit("]")))
        return _children(level).select("doc", F.concat("place", F.array(name)).alias("place"), F.concat("labels", F.array(label)).alias("labels"), F.col("value").alias("text"), _kind(F.col("value")).alias("kind"))

    return _levels(start, step, most, "a document")


# references ------------------------------------------------------------------------------------------------------------------------


def _sites(values: DataFrame) -> DataFrame:
    """(doc, place, labels, suffix, ref, error): where documents refer to others, with what is wrong with the form. Nothing inside $ref or $refs is looked at."""
    inside = lambda n: F.exists(F.slice("labels", 1, F.greatest(F.size("labels") - n, F.lit(0))), lambda x: x.isin(".$ref", ".$refs"))
    label = lambda n: F.get(F.col("labels"), F.size("labels") - n)
    said = F.when(F.col("text").startswith('"'), F.try_variant_get(F.try_parse_json("text"), "$", "string"))
    wrong = F.when(said.isNull() | (said == ""), F.concat(F.lit("not a reference: "), F.col("text"))).when(~said.startswith("#/"), F.concat(F.lit("must start with #/: "), said))
    cut = lambda c, n: F.slice(c, 1, F.size(c) - n).alias(c)
    none = F.lit(None).cast("string")
    one = values.filter((label(1) == ".$ref") & ~inside(1) & ~F.col("text").isin(UNSET)).select("doc", cut("place", 1), cut("labels", 1), F.lit("").alias("suffix"), said.alias("ref"), wrong.alias("error"))
    many = values.filter((label(2) == ".$refs") & label(1).startswith("[") & ~inside(2)).select("doc", cut("place", 2), cut("labels", 2), F.concat(F.lit(".$refs"), label(1)).alias("suffix"), said.alias("ref"), wrong.alias("error"))
    odd = values.filter((label(1) == ".$refs") & ~inside(1) & (F.col("kind") != "array") & ~F.col("text").isin(UNSET)).select("doc", cut("place", 1), cut("labels", 1), F.lit("").alias("suffix"), none.alias("ref"), F.lit("$refs must be an array").alias("error"))
    return one.unionByName(many).unionByName(odd)


def reference_chains(docs: DataFrame, most: int = 100) -> DataFrame:
    """(doc, context, ref, chain, error) of all references of documents (doc, json) and, behind each that resolves, of all that lie in what it points at, and so on [REC3, REC13].

    References are edges: each round joins those reached with the values they point at, and these with the references at or under them.
    chain holds the references that led to a row; one that is in its own chain is circular and goes no further. A reference that no value
    answers to does not exist. In a pointer ~1 stands for / and ~0 for ~. ValueError beyond `most` rounds."""
    values = stored(places(docs))
    sites = stored(_sites(values))
    under = sites.select("doc", F.explode(F.sequence(F.lit(0), F.size("place"))).alias("n"), "place", "labels", "suffix", "ref", "error")
    under = stored(under.select("doc", F.slice("place", 1, F.col("n")).alias("target"), F.array_join(F.slice("labels", F.col("n") + 1, F.greatest(F.size("labels") - F.col("n"), F.lit(0))), "").alias("below"), "suffix", F.col("ref").alias("next"), F.col("error").alias("wrong")))
    known = values.select("doc", F.col("place").alias("target"), F.lit(True).alias("there"))
    escaped = lambda x: F.replace(F.replace(x, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))

    def judged(rows: DataFrame) -> DataFrame:
        parts = F.transform(F.split(F.substr("ref", F.lit(3)), "/", -1), escaped)
        rows = rows.withColumn("error", F.coalesce("error", F.when(F.array_contains("chain", F.col("ref")), F.concat(F.lit("circular: "), F.col("ref")))))
        rows = rows.withColumn("target", F.when(F.col("error").isNull(), parts)).join(known, ["doc", "target"], "left")
        error = F.coalesce("error", F.when(F.col("there").isNull(), F.concat(F.lit("does not exist: "), F.col("ref"))))
        return rows.select("doc", "context", "ref", "chain", "target", error.alias("error"))

    def step(level: DataFrame, _: DataFrame) -> DataFrame:
        met = level.filter("error is null").join(under, ["doc", "target"])
        context = F.concat("context", F.lit(" -> "), F.col("ref"), "below", "suffix")
        return judged(met.select("doc", context.alias("context"), F.col("next").alias("ref"), F.concat("chain", F.array("ref")).alias("chain"), F.col("wrong").alias("error")))

    context = F.concat(F.regexp_replace(F.array_join("labels", ""), r"^\.", ""), "suffix")
    start = judged(sites.select("doc", context.alias("context"), "ref", _texts().alias("chain"), "error"))
    return _levels(start, step, most, "a chain of references").drop("target")


def reference_errors(docs: DataFrame) -> DataFrame:
    """(doc, context, error) of the references that have a bad form, do not resolve, or come back to themselves [REC13]."""
    return reference_chains(docs).filter("error is not null").select("doc", "context", "error")


# overrides -------------------------------------------------------------------------------------------------------------------------

#: Keys whose values an override replaces, and the key that it may set on named list items besides.
REPLACED = ["description", "summary", "type", "annotated_field", "version"]
ON_ITEMS = "selfManagedOnly"
OPTIONS, EXAMPLES = "annotated_options", "examples"


def _keyed(docs: DataFrame, first_only: bool, most: int = 60) -> DataFrame:
    """Values of documents with `keyed`, a place by which two documents are matched: .key in objects, and in lists # with an item's name (title among examples, first element among options), ~ where it has none; `order` is the position in the list or object, `apart` whether the value lies in a list of options or examples.

    first_only: of equally named items of a plain list only the first, as an override is looked up by name."""
    start = docs.select("doc", _texts().alias("place"), _texts().alias("keyed"), F.lit(0).alias("order"), F.lit(False).alias("apart"), F.to_json(F.try_parse_json("json")).alias("text")).filter("text is not null").withColumn("kind", _kind(F.col("text")))

    def step(level: DataFrame, _: DataFrame) -> DataFrame:
        rows = _children(level)
        listed = F.col("key").isNull()
        own = _end("keyed")
        item = F.when(own == f".{OPTIONS}", _part(F.col("value"), "$[0]")).when(own == f".{EXAMPLES}", _part(F.col("value"), "$.title")).otherwise(_part(F.col("value"), "$.name"))
        segment = F.when(listed, F.concat(F.lit("#"), F.coalesce(item, F.lit("~")))).otherwise(F.concat(F.lit("."), F.col("key")))
        apart = F.coalesce(F.col("apart") | (listed & own.isin(f".{OPTIONS}", f".{EXAMPLES}")), F.lit(False))
        out = rows.select("doc", F.concat("place", F.array(F.coalesce("key", F.col("pos").cast("string")))).alias("place"), F.concat("keyed", F.array(segment)).alias("keyed"), F.col("pos").alias("order"), apart.alias("apart"), F.col("value").alias("text"), _kind(F.col("value")).alias("kind"))
        if not first_only:
            return out
        single = out.filter(F.col("apart") | ~_end("keyed").startswith("#"))
        best = F.min_by(F.struct("place", "order", "apart", "text", "kind"), "order").alias("r")
        return single.unionByName(out.filter(~F.col("apart") & _end("keyed").startswith("#")).groupBy("doc", "keyed").agg(best).select("doc", "r.place", "keyed", "r.order", "r.apart", "r.text", "r.kind"))

    return _levels(start, step, most, "a document")


def _replacements(t: DataFrame, o: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, place, text) of values that are replaced or set, and (doc, place, order, text) of items that are added to the list at a place."""
    parents = t.filter("kind = 'object' and not apart").select("doc", F.col("keyed").alias("above"), F.col("place").alias("parent"))
    kinds = t.select("doc", F.col("place").alias("at"), F.col("kind").alias("t_kind"), F.col("text").alias("t_text"))
    above = o.filter("not apart").withColumns({"above": _up("keyed"), "last": F.substr(_end("keyed"), F.lit(2)), "named": _end("keyed").startswith("#")}).filter("size(keyed) > 0 and not named")
    met = above.join(parents, ["doc", "above"]).withColumn("at", F.concat("parent", F.array("last"))).join(kinds, ["doc", "at"], "left")
    met = stored(met.withColumn("on_item", F.coalesce(F.get("above", F.size("above") - 1).startswith("#"), F.lit(False))))
    alike = F.coalesce((F.col("kind") == F.col("t_kind")) & (F.col("kind") != "value"), F.lit(False))
    allowed = F.col("last").isin(REPLACED) | (F.col("on_item") & (F.col("last") == ON_ITEMS))
    out = met.filter(allowed & (F.col("on_item") | ~alike)).select("doc", F.col("at").alias("place"), "text")
    # a list of examples is made where the target has none
    out = out.unionByName(met.filter((F.col("last") == EXAMPLES) & (F.col("kind") == "array") & ~alike).select("doc", F.col("at").alias("place"), "text"))

    lists = met.filter(F.col("last").isin(OPTIONS, EXAMPLES) & alike & (F.col("kind") == "array")).select("doc", F.col("at").alias("list"), "keyed", F.col("last").alias("rule"))
    own = t.filter("apart").select("doc", _up().alias("list"), "place", _end("keyed").alias("name"), "text").join(lists, ["doc", "list"])
    # of equally named items of an override the last counts where it meets one of the target, and all are added where it meets none
    given = o.filter("apart").select("doc", _up("keyed").alias("keyed"), _end("keyed").alias("name"), "order", F.col("text").alias("o_text"))
    last = given.groupBy("doc", "keyed", "name").agg(F.max_by("o_text", "order").alias("o_text"))
    pairs = stored(own.join(last, ["doc", "keyed", "name"], "left"))
    json = lambda c, p: F.coalesce(_part(F.col(c), p), F.lit("null"))
    option = F.concat(F.lit("["), json("text", "$[0]"), F.lit(","), F.when(F.col("o_text").isNotNull(), json("o_text", "$[1]")).otherwise(json("text", "$[1]")), F.lit("]"))
    out = out.unionByName(pairs.filter(F.col("rule") == OPTIONS).select("doc", "place", option.alias("text")))
    for k in ("summary", "config"):
        new = _part(F.col("o_text"), f"$.{k}")
        out = out.unionByName(pairs.filter((F.col("rule") == EXAMPLES) & F.col("text").startswith("{") & new.isNotNull() & ~new.isin(UNSET)).select("doc", F.concat("place", F.array(F.lit(k))).alias("place"), new.alias("text")))
    added = given.join(lists, ["doc", "keyed"]).join(pairs.select("doc", "list", "name").distinct(), ["doc", "list", "name"], "left_anti")
    pair = F.concat(F.lit("["), json("o_text", "$[0]"), F.lit(","), json("o_text", "$[1]"), F.lit("]"))
    return out, added.select("doc", F.col("list").alias("place"), "order", F.when(F.col("rule") == OPTIONS, pair).otherwise(F.col("o_text")).alias("text"))


def assemble(rows: DataFrame) -> DataFrame:
    """(doc, json) of values (doc, place, order, kind, text): containers are made anew from what lies in them, from the deepest level up; values are taken as they are."""
    rows = stored(rows.withColumn("depth", F.size("place")))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    quoted = F.regexp_replace(F.to_json(F.array(_end())), r"^\[|\]$", "")
    level = rows.filter(F.col("depth") == deepest)
    for d in range(deepest, 0, -1):
        made = level.withColumns({"place": _up(), "quoted": quoted, "name": _end()}).groupBy("doc", "place").agg(F.array_sort(F.collect_list(F.struct("order", "text"))).alias("items"), F.array_sort(F.collect_list(F.struct("name", "quoted", "text"))).alias("fields"))
        above = rows.filter(F.col("depth") == d - 1).join(made, ["doc", "place"], "left")
        array = F.concat(F.lit("["), F.coalesce(F.array_join(F.col("items.text"), ","), F.lit("")), F.lit("]"))
        object_ = F.concat(F.lit("{"), F.coalesce(F.array_join(F.transform("fields", lambda x: F.concat(x["quoted"], F.lit(":"), x["text"])), ","), F.lit("")), F.lit("}"))
        level = stored(above.withColumn("text", F.when(F.col("kind") == "array", array).when(F.col("kind") == "object", object_).otherwise(F.col("text"))).drop("items", "fields"))
    return level.select("doc", F.col("text").alias("json"))


def merge_overrides(docs: DataFrame, overrides: DataFrame) -> DataFrame:
    """(doc, json) of documents (doc, json) with the overrides (doc, json) of the same doc laid over them [REC5].

    Only REPLACED keys take an override's value, or are added; other values stay, and keys that only the override has are left out.
    Objects are merged by key; items of lists by name, each with the first override of its name, and no item is added. Options are pairs
    of name and text: an override's text replaces that of its name, and pairs of new names are added. Examples are matched by title: a
    summary or config that is set replaces the example's, and examples of new titles are added. A document is an object, has one row, and
    comes back as it is, but for spelling, where it has no override."""
    t = stored(_keyed(docs, False))
    o = stored(_keyed(overrides.join(docs.select("doc"), "doc", "left_semi"), True))
    found, added = _replacements(t, o)
    found = stored(found)
    prefixes = lambda last: F.transform(F.sequence(F.lit(0), F.size("place") - last), lambda n: F.slice("place", 1, n))
    gone = found.select("doc", F.col("place").alias("prefix"))

    def outside(rows: DataFrame, last: int) -> DataFrame:
        """Rows that lie in no replaced value; last = 0 leaves out replaced values themselves too."""
        hit = rows.select("doc", "place", F.explode(prefixes(last)).alias("prefix")).join(gone, ["doc", "prefix"], "left_semi").select("doc", "place").distinct()
        return rows.join(hit, ["doc", "place"], "left_anti")

    kept = outside(t.select("doc", "place", "order", "kind", "text"), 0)
    whole = F.lit("value").alias("kind")
    # a replaced item keeps its position in its list
    fresh = outside(found.filter("size(place) > 0"), 1).join(t.select("doc", "place", "order"), ["doc", "place"], "left").select("doc", "place", F.coalesce("order", F.lit(0)).alias("order"), whole, "text")
    new = added.select("doc", F.concat("place", F.array(F.concat(F.lit("+"), F.col("order")))).alias("place"), (F.col("order") + (1 << 30)).alias("order"), whole, "text")
    return assemble(kept.unionByName(fresh).unionByName(new))
