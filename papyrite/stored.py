"""Rows kept in the shared folder that the cluster names, so that plans stay short and a lost executor costs a read."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the checkpoint folder that ``spark.checkpoint.dir`` names; one of this machine serves only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    folder = f"{context.getCheckpointDir()}/papyrite-stored"
    if getattr(context, "_papyrite_stored", None) != folder:
        context._papyrite_stored = folder
        atexit.register(_delete, spark, folder)
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # at exit the JVM may be gone
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once, as a table in the shared folder; it goes at the end of the application, or by ``drop``."""
    folder = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    table._papyrite_stored = folder
    return table


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` made and nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._papyrite_stored)


#: Rows of a few short columns up to which a table may go to every executor.
SMALL_ROWS = 500_000


def if_small(table: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A written table, marked for a broadcast join if it has ``most`` rows at most; else as it is."""
    return F.broadcast(table) if table.count() <= most else table
