"""The record-stream operator: records pass unchanged if their key or value matches a pattern; the same filter serves batch and stream."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import truthy_flag  # noqa: F401  (environment flags are read with it)


def regex_filter(df: DataFrame, pattern: str, on: str = "value") -> DataFrame:
    """Records whose `on` column matches; null never does [ST1, F29]."""
    return df.filter(F.col(on).cast("string").rlike(pattern))


def options(env: Mapping[str, str]) -> dict[str, str]:
    """PATTERN is needed, MATCH_VALUE chooses value over key [ST2's configuration]."""
    if not env.get("PATTERN"):
        raise ValueError("PATTERN must be set")
    return {"pattern": env["PATTERN"], "on": "value" if env.get("MATCH_VALUE", "").lower() in ("yes", "ok", "1", "true") else "key"}


def run_filter(source: DataFrame, env: Mapping[str, str], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts the filter over what is there now; `write` gets each batch [ST2, SNK12, SRC32]."""
    return regex_filter(source, **options(env)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_within(df: DataFrame, keys: list[str], time: str, ttl: str) -> DataFrame:
    """Drops repeats of a key within a time to live, with state that expires [ST4]."""
    return df.withWatermark(time, ttl).dropDuplicatesWithinWatermark(keys)


#: Shapes of progress in a program's output: a share, or a step of several; then words of phases.
SHARE, STEP = r"(?i)(?:progress[:\s]*)?(\d+)%", r"(?i)(?:step\s+)?(\d+)\s*(?:/|of)\s*(\d+)"
PHASES = {"fetching": r"(?i)cloning|downloading|fetching", "building": r"(?i)building|compiling|generating", "analyzing": r"(?i)analyzing|parsing|extracting"}


def progress_events(chunks: DataFrame, text: str = "value") -> DataFrame:
    """Chunks of output that tell of progress, with `percent` (null if only a phase is told) and `phase`; works on a stream as on a table [ST3]."""
    from pyspark.sql import functions as F

    x = F.col(text).cast("string")
    done, total = F.regexp_extract(x, STEP, 1).try_cast("double"), F.regexp_extract(x, STEP, 2).try_cast("double")
    percent = F.coalesce(F.regexp_extract(x, SHARE, 1).try_cast("int"), F.when(total > 0, F.round(done / total * 100)).cast("int"))
    phase = F.lit(None).cast("string")
    for name, pattern in reversed(PHASES.items()):
        phase = F.when(x.rlike(pattern), name).otherwise(phase)
    return chunks.withColumns({"percent": percent, "phase": phase}).filter("percent is not null or phase is not null")
