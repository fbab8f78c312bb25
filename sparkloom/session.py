"""The session settings that the library expects."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}
#: Arrow batches to and from Python: Spark's defaults of 10,000 rows and 64 MB are held several times over by each task.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": (str(64 << 20), str(8 << 20))}


def get_session(master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """A session with UTC times and adaptive execution; on a cluster master and partitions come from its own settings."""
    builder = SparkSession.builder.appName("sparkloom").config(map=SETTINGS | more)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir; where there is none, a folder of this machine in local mode, else one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch")
        found = spark.sparkContext.getCheckpointDir()
    return found


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # a session that has ended cannot delete; its folder is the cluster's to clear
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def own_folder(spark: SparkSession) -> str:
    """A new place in the shared folder, which goes when the driver ends."""
    path = f"{shared_folder(spark)}/sparkloom/own-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read back: lineage ends, lost executors do not matter, and unlike a checkpoint it is worked out once."""
    path = own_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Readies a session for Python workers: batches of moderate size, and this package within their reach: on a cluster always, since what the driver's own path has says nothing of theirs; in local mode where neither PYTHONPATH nor the working folder has it."""
    for name, (default, smaller) in BATCHES.items():
        if spark.conf.get(name, default).removesuffix("b") == default:  # a value of the user's own stays
            spark.conf.set(name, smaller)
    root = Path(__file__).resolve().parents[1]
    key, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if key in _shipped:
        return
    if master == "local" or master.startswith("local["):
        on_path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(":") if p]
        if root in on_path or Path.cwd().resolve() == root or (Path.cwd() / "sparkloom").exists():
            return
    out = Path(tempfile.mkdtemp(prefix="sparkloom-")) / "sparkloom.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in (root / "sparkloom").rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(key)
