"""Session defaults, lineage cutting and scratch folders."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of local sessions, by application.
_LOCAL: dict[str, str] = {}


def build_session(app: str = "themeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    Only a local session (tests) may fall back to a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="themeloom-")
    return _LOCAL[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, grouped by application."""
    app = spark.sparkContext.applicationId
    return os.path.join(shared_dir(spark), "tables", app, f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` as a table in the shared folder and continue from there.

    A lost executor never replays earlier rounds, rows are computed once, and the planner sees
    the true size of the table (estimates of chained checkpoints multiply from round to round).
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table with fewer partitions than one for so many cores is dealt out anew.
IDLE_CORES = 4


def spread(df: DataFrame) -> DataFrame:
    """A table as read from files, dealt out anew if its splits would keep at most one in IDLE_CORES cores busy, as on one small file.

    For whoever reads the files; operators take tables as they come.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * IDLE_CORES <= cores else df
