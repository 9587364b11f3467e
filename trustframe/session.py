"""Session helpers: a tuned session for local runs, table loading and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "trustframe", master: str | None = None, **conf: str) -> SparkSession:
    """Session with AQE on; ``master`` is only set for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows over all shuffle partitions before much work is done on each of them.

    A reader cuts a table by its bytes, and a compressed table of millions of short rows is a handful of tasks. Call it
    on the few columns that the work needs, not on what the work makes of them.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the session's setting, or a fresh local one on local masters."""
    context = spark.sparkContext
    current = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not context.getCheckpointDir():
            context.setCheckpointDir(current)
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the table to the shared folder and read it back.

    Survives executor loss and keeps iterative plans short. A written table is used rather than
    ``checkpoint()`` because a checkpointed plan carries the constraints of everything before it, and
    the optimizer's work on them grows with every round of a loop.
    """
    path = f"{checkpoint_root(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    cut = df.sparkSession.read.schema(df.schema).parquet(path)
    cut._cut_path = path
    return cut


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut_lineage`` wrote, once nothing reads them any more; others are left alone."""
    for table in tables:
        path = getattr(table, "_cut_path", None)
        if path:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
