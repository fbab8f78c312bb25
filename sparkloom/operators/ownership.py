"""Trees of components that configs declare: who owns a component's navigation, and what a component's page shows of its tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Configs folded together, and blocks of them in each further round.
WIDTH = 1024
_STATE = "struct<own:boolean,depth:int,config:string,owner:string,same:boolean>"


def placed(nodes: DataFrame, most: int = 50) -> DataFrame:
    """Nodes (config, id, parent, position, name) with `depth` and `place`, the positions from the root down, whose order is that of a walk through the tree; null parents are roots."""
    rows = nodes.select("config", "id", "parent", "position", "name")
    out = level = stored(rows.filter("parent is null").withColumns({"depth": F.lit(0), "place": F.array("position")}))
    for _ in range(most):
        up = level.select("config", F.col("id").alias("parent"), F.col("depth").alias("__d"), F.col("place").alias("__p"))
        level = stored(rows.join(up, ["config", "parent"]).select("config", "id", "parent", "position", "name", (F.col("__d") + 1).alias("depth"), F.concat("__p", F.array("position")).alias("place")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"a config is deeper than {most} levels")


def _step(state: Column, e: Column) -> Column:
    """A config's own component: it takes the place of an inherited config, and of an own one unless that is deeper. Another component: it comes in only if strictly deeper."""
    takes = F.when(e["own"], ~state["own"] | (e["depth"] >= state["depth"])).otherwise(e["depth"] > state["depth"])
    new = F.struct(e["own"].alias("own"), e["depth"].alias("depth"), e["config"].alias("config"), e["owner"].alias("owner"), F.lit(False).alias("same")).cast(_STATE)
    return F.when(takes, new).otherwise(state)


def config_owners(configs: DataFrame, places: DataFrame, width: int = WIDTH) -> DataFrame:
    """(component, config, owner, depth): the config that each component's pages use [J42].

    configs (config, ordinal, owner) in the order in which they are read, numbered from 0 without large gaps; places: placed() nodes. A
    config counts for its owner, and for all components that its tree names, at the first place where it names them (an owner's depth is
    -1 where its own tree does not name it). In that order, a config of the component itself replaces what it inherited, and an own one
    that is not deeper; an inherited one comes in only where it is strictly deeper than what is there.

    The result depends on the order, yet it is folded in blocks: what a block of `width` configs does is a table from each state before it
    (inherited or own, by depth) to the state after it, and such tables are put together in rounds of `width`, so that a component that all
    configs name is never one task's list."""
    first = places.groupBy("config", F.col("name").alias("component")).agg(F.min_by("depth", "place").alias("depth"))
    given = configs.select("config", F.col("ordinal").cast("long").alias("ordinal"), "owner")
    given = given.join(places.select("config").distinct(), "config", "left_semi")
    named = given.join(first, "config").filter(~F.col("component").eqNullSafe(F.col("owner"))).select("component", "config", "ordinal", "owner", "depth", F.lit(False).alias("own"))
    own = given.join(first.withColumnRenamed("component", "owner"), ["config", "owner"], "left").select(F.col("owner").alias("component"), "config", "ordinal", "owner", F.coalesce("depth", F.lit(-1)).alias("depth"), F.lit(True).alias("own"))
    events = stored(named.unionByName(own))
    top = events.agg(F.max("depth").alias("d"), F.max("ordinal").alias("n")).first()
    if top["d"] is None:
        return events.select("component", "config", "owner", "depth").limit(0)
    depths = top["d"] + 3  # from -2, where nothing is there yet, to the deepest
    place = lambda s: F.when(s["own"], F.lit(depths)).otherwise(0) + s["depth"] + 2
    before = F.array(*(F.struct(F.lit(o).alias("own"), F.lit(d - 2).alias("depth"), F.lit(None).cast("string").alias("config"), F.lit(None).cast("string").alias("owner"), F.lit(True).alias("same")).cast(_STATE) for o in (False, True) for d in range(depths)))
    event = F.struct("ordinal", "own", "depth", F.col("config").cast("string").alias("config"), F.col("owner").cast("string").alias("owner"))
    lists = events.groupBy("component", F.floor(F.col("ordinal") / width).alias("block")).agg(F.array_sort(F.collect_list(event)).alias("events"))
    tables = stored(lists.select("component", "block", F.transform(before, lambda s: F.aggregate("events", s, _step)).alias("table")))
    blocks = top["n"] // width + 1
    while blocks > 1:
        grouped = tables.groupBy("component", F.floor(F.col("block") / width).alias("block")).agg(F.array_sort(F.collect_list(F.struct("block", "table"))).alias("tables"))

        def through(s: Column, t: Column) -> Column:
            after = F.get(t["table"], place(s))
            return F.when(after["same"], s).otherwise(after)

        tables = stored(grouped.select("component", "block", F.transform(before, lambda s: F.aggregate("tables", s, through)).alias("table")))
        blocks = -(-blocks // width)
    end = F.get("table", F.lit(0))
    return tables.select("component", end["config"].alias("config"), end["owner"].alias("owner"), end["depth"].alias("depth"))


def breadcrumbs(places: DataFrame) -> DataFrame:
    """(config, component, depth, crumbs): the names from the root down to the first place of each component [REC7]."""
    names = places.select("config", F.col("place").alias("at"), F.col("name").alias("crumb"))
    first = places.groupBy("config", F.col("name").alias("component")).agg(F.min_by(F.struct("place", "depth"), "place").alias("f"))
    above = first.select("config", "component", "f.depth", F.explode(F.transform(F.sequence(F.lit(1), F.size("f.place")), lambda n: F.slice("f.place", 1, n))).alias("at"))
    rows = above.join(names, ["config", "at"]).groupBy("config", "component", "depth").agg(F.array_sort(F.collect_list(F.struct(F.size("at").alias("n"), "crumb"))).alias("c"))
    return rows.select("config", "component", "depth", F.col("c.crumb").alias("crumbs"))


def shown_entries(places: DataFrame) -> DataFrame:
    """(config, component, position, entry, items_only): the top entries of the tree that a component's pages show, at its first place, roots before all others [REC7].

    A component at the root with children shows its own items and then its children; at the root without children, the whole tree. Deeper
    down, one with children shows itself; a leaf with other leaves beside it shows its parent's items and then the parent's children; a
    leaf that stands alone shows nothing. items_only marks entries whose items stand without a heading. Positions count from 0."""
    first = places.groupBy("config", F.col("name").alias("component")).agg(F.min_by(F.struct("id", "parent"), F.struct(F.col("depth") > 0, F.col("place"))).alias("f")).select("config", "component", "f.*")
    kids = places.filter("parent is not null").select("config", F.col("parent").alias("of"), F.col("id").alias("child"), F.col("name").alias("entry"), "place")
    families = kids.join(kids.select("config", F.col("of").alias("child")).distinct().withColumn("inner", F.lit(True)), ["config", "child"], "left").withColumn("leaf", F.col("inner").isNull())
    counts = families.groupBy("config", F.col("of").alias("id")).agg(F.count("*").alias("children"))
    # leaf siblings of another name than the component's own
    leaves = families.filter("leaf").groupBy("config", F.col("of").alias("parent"), "entry").agg(F.count("*").alias("same")).groupBy("config", "parent").agg(F.sum("same").alias("leaves"), F.map_from_entries(F.collect_list(F.struct("entry", "same"))).alias("by_name"))
    case = first.join(counts, ["config", "id"], "left").join(leaves, ["config", "parent"], "left")
    others = F.coalesce(F.col("leaves"), F.lit(0)) - F.coalesce(F.try_element_at("by_name", "component"), F.lit(0))
    kind = F.when(F.col("parent").isNull(), F.when(F.col("children").isNotNull(), "own").otherwise("all")).when(F.col("children").isNotNull(), "self").when(others > 0, "beside").otherwise("none")
    case = case.select("config", "component", "id", "parent", kind.alias("kind"))
    head = lambda df, name, only: df.select("config", "component", F.array(F.lit(-1)).alias("place"), F.col(name).alias("entry"), F.lit(only).alias("items_only"))
    below = lambda kind, of: case.filter(F.col("kind") == kind).select("config", "component", F.col(of).alias("of")).join(kids, ["config", "of"]).select("config", "component", "place", "entry", F.lit(False).alias("items_only"))
    names = places.select("config", F.col("id").alias("parent"), F.col("name").alias("parent_name"))
    roots = places.filter("parent is null").select("config", "place", F.col("name").alias("entry"))
    parts = [
        head(case.filter("kind = 'own'"), "component", True), below("own", "id"),
        case.filter("kind = 'all'").select("config", "component").join(roots, "config").select("config", "component", "place", "entry", F.lit(False).alias("items_only")),
        head(case.filter("kind = 'self'"), "component", False),
        head(case.filter("kind = 'beside'").join(names, ["config", "parent"]), "parent_name", True), below("beside", "parent"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    listed = out.groupBy("config", "component").agg(F.array_sort(F.collect_list(F.struct("place", "entry", "items_only"))).alias("e"))
    return listed.select("config", "component", F.posexplode("e").alias("position", "x")).select("config", "component", "position", "x.entry", "x.items_only")
