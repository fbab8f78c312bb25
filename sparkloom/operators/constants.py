"""Named constants whose expressions use one another, and defaults that use them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import arithmetic_tokens, arithmetic_value, in_unit, names_in
from ..session import stored


def _with_values(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows (key, names) with a map of those names that are known, null for none. A row's names are those of one expression."""
    uses = rows.select(key, F.explode("names").alias("name"))
    found = uses.join(known.select("name", "value"), "name").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("values"))
    return rows.join(found, key, "left")


def resolve_constants(constants: DataFrame, most: int = 100) -> DataFrame:
    """(name, value) of constants (name, expression), by substitution until nothing changes [SC-D3, SC-M1, SRC18].

    Each round joins what waits with all values so far and is a table of its own, so there are as many rounds as names stand behind one
    another. Names that nothing defines, cycles, and what uses either, have no value; of a name that is defined twice the expression that
    sorts first counts. ValueError beyond `most` rounds."""
    one = constants.groupBy("name").agg(F.min("expression").alias("expression"))
    tokens = one.select("name", arithmetic_tokens(F.coalesce("expression", F.lit(""))).alias("tokens"))
    waiting = stored(tokens.select("name", "tokens", names_in(F.col("tokens")).alias("names")))
    known = stored(waiting.filter(F.size("names") == 0).select("name", arithmetic_value(F.col("tokens")).alias("value")))
    every = known
    left = waiting.filter(F.size("names") > 0)
    for _ in range(most):
        rows = _with_values(left.select(F.col("name").alias("of"), "tokens", "names"), every, "of").filter(F.size("names") == F.size("values"))
        found = stored(rows.select(F.col("of").alias("name"), arithmetic_value(F.col("tokens"), F.col("values")).alias("value")))
        if found.isEmpty():
            return waiting.select("name").join(every, "name", "left")
        every = every.unionByName(found)
        left = left.join(found.select("name"), "name", "left_anti")
    raise ValueError(f"constants stand behind one another more than {most} times")


def evaluate_defaults(settings: DataFrame, constants: DataFrame, key: str) -> DataFrame:
    """settings (key, default, c_type) with `value`, the default in the unit of its type, names in it replaced by resolved constants (name, value) [SC-D3]."""
    tokens = settings.select(key, "c_type", arithmetic_tokens(F.coalesce("default", F.lit(""))).alias("tokens"))
    rows = _with_values(tokens.select(key, "c_type", "tokens", names_in(F.col("tokens")).alias("names")), constants, key)
    milliseconds = arithmetic_value(F.col("tokens"), F.coalesce("values", F.create_map().cast("map<string,double>")))
    return settings.join(rows.select(key, in_unit(milliseconds, "c_type").alias("value")), key, "left")
