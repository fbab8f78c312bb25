"""Commands that only one system has, from Go sources: what a folder's files register there, less what they register elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import file_builds
from ..functions.text import C, col

#: The shape of a function that returns a command.
_CONSTRUCTOR = r"(?m)^func\s+(\w+)\s*\([^)]*\)\s*\*cobra\.Command\s*\{"
#: Calls that add commands, calls of constructors with or without a package before them, and brackets.
_CALLS = r"\bAddCommand\s*\(|(?:\w+\.)?(?:New|new)\w*\s*\(|[()]"
#: Folders that are no part of a command's path.
NO_COMMAND = ["internal", "common", "testdata"]


def constructors(contents: C) -> Column:
    """Array of (function, command, hidden): functions that return a command, the first word of its Use, and whether it is hidden or deprecated [SRC21]."""
    x = F.coalesce(col(contents), F.lit(""))
    names, bodies = F.regexp_extract_all(x, F.lit(_CONSTRUCTOR), F.lit(1)), F.split(x, _CONSTRUCTOR)

    def one(name: Column, i: Column) -> Column:
        body = F.get(bodies, i + 1)
        use = F.split(F.trim(F.regexp_extract(body, r'\bUse:\s*"([^"]+)"', 1)), r"\s+")[0]
        hidden = body.rlike(r'\bHidden:\s*true\b|\bDeprecated:\s*"|\bDeprecateCmd\s*\(')
        return F.struct(name.alias("function"), F.nullif(use, F.lit("")).alias("command"), hidden.alias("hidden"))

    return F.transform(names, one)


def added_commands(contents: C) -> Column:
    """Array of (package, function): constructors that are called inside AddCommand( ... ), however deep, by a fold over brackets [SRC21].

    The state is the depth, and the depths at which calls of AddCommand have opened; a call counts where one is open."""
    tokens = F.regexp_extract_all(F.coalesce(col(contents), F.lit("")), F.lit(_CALLS), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<int>").alias("open"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, t: Column) -> Column:
        depth, opened, found = s["depth"], s["open"], s["found"]
        state = lambda d, o, f: F.struct(d.alias("depth"), o.alias("open"), f.alias("found"))
        closes = (F.size(opened) > 0) & (F.get(opened, F.size(opened) - 1) == depth)
        fewer = F.slice(opened, 1, F.greatest(F.size(opened) - 1, F.lit(0)))
        return (
            F.when(t == ")", state(depth - 1, F.when(closes, fewer).otherwise(opened), found))
            .when(t == "(", state(depth + 1, opened, found))
            .when(t.startswith("AddCommand"), state(depth + 1, F.concat(opened, F.array(depth + 1)), found))
            .otherwise(state(depth + 1, opened, F.when(F.size(opened) > 0, F.concat(found, F.array(t))).otherwise(found)))
        )

    called = F.transform(F.aggregate(tokens, start, step)["found"], lambda t: F.regexp_replace(t, r"\s*\($", ""))
    return F.transform(called, lambda t: F.struct(F.nullif(F.regexp_extract(t, r"^(\w+)\.", 1), F.lit("")).alias("package"), F.regexp_extract(t, r"(\w+)$", 1).alias("function")))


def command_of(function: C) -> Column:
    """NewStartCommand -> start; null for NewCommand and other names."""
    return F.nullif(F.lower(F.regexp_extract(col(function), r"^(?:New|new)(\w+?)(?:Command|Cmd)$", 1)), F.lit(""))


def command_prefix(folder: C, root: str) -> Column:
    """The command path of a source folder ('' is the root's own): an outer cmd/ is left out; null for folders without commands."""
    parts = F.filter(F.split(col(folder), "/"), lambda p: p != "")
    parts = F.when(F.get(parts, F.lit(0)) == "cmd", F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.when(~F.exists(parts, lambda p: p.isin(NO_COMMAND)), F.concat_ws(" ", F.lit(root), parts))


def only_on(files: DataFrame, system: str = "linux", other: str = "darwin", root: str = "tool") -> DataFrame:
    """(command): command paths that `system` has and `other` lacks, of files (folder, name, contents) [J47].

    A folder below the root that defines commands and whose files build on `system` alone gives its own path and nothing below. In any
    other folder with a file that builds on one of the two alone, the commands registered by files for `system` count that none for
    `other` registers. A constructor that is called is looked up in its folder, or in that of its package; one that is not found counts
    only if it is named like one."""
    parsed = files.select("folder", command_prefix("folder", root).alias("prefix"), constructors("contents").alias("made"), added_commands("contents").alias("added"), *(file_builds("name", "contents", s).alias(f"on_{k}") for k, s in (("this", system), ("that", other))))
    folders = parsed.groupBy("folder", "prefix").agg(F.bool_or("on_this").alias("some"), F.bool_or("on_that").alias("other"), F.bool_or(F.col("on_this") != F.col("on_that")).alias("differs"), F.bool_or(F.size("made") > 0).alias("makes")).filter("prefix is not null")
    whole = F.col("some") & ~F.col("other") & F.col("makes") & (F.col("prefix") != root)
    made = parsed.select("folder", F.explode("made").alias("m")).select("folder", "m.*").groupBy("folder", "function").agg(F.max(F.struct("command", "hidden")).alias("m"))
    calls = parsed.join(folders.filter(F.col("differs") & ~whole).select("folder"), "folder").select("folder", "prefix", "on_this", "on_that", F.explode("added").alias("a"))
    place = F.when(F.col("a.package").isNull(), F.col("folder")).otherwise(F.concat_ws("/", F.nullif("folder", F.lit("")), "a.package"))
    calls = calls.select("folder", "prefix", "on_this", "on_that", F.col("a.package").alias("package"), F.col("a.function").alias("function"), place.alias("at"))
    found = calls.join(made.select(F.col("folder").alias("at"), "function", "m"), ["at", "function"], "left")
    named = F.coalesce(command_of("function"), F.col("package"))
    like = F.col("function").rlike(r"^(?:New|new)(?:\w*(?:Command|Cmd))?$")
    name = F.when(F.col("m").isNotNull(), F.when(~F.col("m.hidden"), F.coalesce("m.command", named))).when(like, named)
    sides = found.withColumn("command", name).filter("command is not null").groupBy("prefix", "command").agg(F.bool_or("on_this").alias("this"), F.bool_or("on_that").alias("that"))
    single = sides.filter("this and not that").select(F.concat_ws(" ", "prefix", "command").alias("command"))
    return folders.filter(whole).select(F.col("prefix").alias("command")).unionByName(single).distinct()
