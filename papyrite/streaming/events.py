"""Event streams: windowed counts with late data, sessions, idempotent upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, kind: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events by window and kind; on streams, events later than ``late`` are left out. Works on batches too."""
    frame = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(frame.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each key: runs of events no further apart than ``gap``."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), "n")


def current(spark: SparkSession, table: str, below: int | None = None) -> DataFrame | None:
    """The newest whole version of a table that ``upsert_batches`` writes; None if there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = lambda v: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/v={v}/_SUCCESS"))
    versions = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path)]
    whole = [v for v in sorted(versions) if (below is None or v < below) and done(v)]
    return spark.read.parquet(f"{table}/v={whole[-1]}") if whole else None


def upsert_batches(table: str, key: str, order: str | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows replace those of the same key in a Parquet table, so a batch that runs twice changes nothing.

    Of a batch's rows with one key the last by ``order`` counts. Each batch writes a whole new version beside the old
    ones; ``current`` reads the newest that is complete, so a reader never sees half of one.
    """

    def write(batch: DataFrame, number: int) -> None:
        old = current(batch.sparkSession, table, number)
        new = batch.dropDuplicates([key]) if order is None else batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), order).alias("r")).select(key, "r.*").select(*batch.columns)
        whole = new if old is None else old.join(new.select(key), key, "left_anti").unionByName(new)
        whole.write.mode("overwrite").parquet(f"{table}/v={number}")

    return write
