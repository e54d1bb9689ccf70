"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\f\r"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context."""
    context = spark.sparkContext
    if not getattr(context, "_papyrite_shipped", False):
        root = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp(prefix="papyrite")) / "papyrite.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted((root / "papyrite").rglob("*.py")):
                out.write(file, file.relative_to(root))
        context.addPyFile(str(archive))
        context._papyrite_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text modulo ``n``; null ids have none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Array of runs of characters other than ASCII white space; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")


def small(batches: Iterator[Any], rows: int = 400) -> Iterator[Any]:
    """The rows of Arrow batches in batches of ``rows`` at most, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


_HELD: dict[str, Any] = {}


def held(key: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task, by key; one thing at a time, so operators don't add up."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = make()
    return _HELD[key]


#: Setting of Spark by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the shared checkpoint folder that the cluster names.

    A folder of this machine serves only in local mode, where none is named.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "")
        alone = context.master.startswith("local") and not context.master.startswith("local-cluster")
        if not named and not alone:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    folder = f"{context.getCheckpointDir()}/papyrite-tables"
    if getattr(context, "_papyrite_tables", None) != folder:
        context._papyrite_tables = folder
        atexit.register(_delete, spark, folder)
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # at exit the JVM may be gone
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession) -> str:
    """A new folder in the shared one; it goes at the end of the application."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder, so that a lost executor costs no more than reading it again.

    The shuffle files of the write go with its end, as nothing reads them after it. ``drop`` removes it; what is left goes at the end of the application.
    """
    spark = df.sparkSession
    folder = new_folder(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table_ = spark.read.schema(df.schema).parquet(folder)
    table_._papyrite_folder = folder
    return table_


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote and nothing reads any more."""
    for table_ in tables:
        _delete(table_.sparkSession, table_._papyrite_folder)


#: Rows of a few numbers up to which a table may go to every executor. The driver holds such a table several times over
#: while it is hashed and dealt out; 500,000 rows of four numbers would be some 60 MB each time.
SMALL_ROWS = 60_000


def if_small(table_: DataFrame, most: int | None = None) -> DataFrame:
    """A written table of few columns of numbers, marked for a broadcast join if it has ``most`` rows at most; else for a join of sorted rows.

    Left alone, Spark would judge it by its files, which hold many times their size in rows.
    """
    return F.broadcast(table_) if table_.count() <= (SMALL_ROWS if most is None else most) else table_.hint("merge")


#: A class of more than this share of all rows is dealt out over SALTS tasks; there are HOT_SHARE such classes at most.
HOT_SHARE, SALTS = 1000, 64


def join_classes(rows: DataFrame, classes: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``classes`` (``class, n, ...``, a written table, a row for each class) by ``key``; null where there is none.

    ``n`` is the number of rows of a class, ``total`` that of all rows. A small table of classes goes to the rows. Else
    both are dealt by class, and the rows of a class of more than ``total`` / HOT_SHARE by their partition as well.
    """
    named = classes.withColumnRenamed("class", key)
    if named.count() <= SMALL_ROWS:
        return rows.join(F.broadcast(named), key, "left")
    crowded = F.col("n") > max(1, total // HOT_SHARE)
    hot = F.broadcast(named.where(crowded).select(key, F.lit(True).alias("__hot")))
    dealt = rows.join(hot, key, "left").withColumn("__salt", F.when(F.col("__hot"), F.spark_partition_id() % SALTS).otherwise(0)).drop("__hot")
    spread = named.withColumn("__salt", F.explode(F.when(crowded, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(spread.hint("merge"), [key, "__salt"], "left").drop("__salt")


def kept_names(keep: list[str], own: list[str]) -> list[str]:
    """Names under which columns are handed on: one that the operator itself uses gets ``_kept`` behind it, as often as needed."""
    names: list[str] = []
    for name in keep:
        while name in own or name in names:
            name += "_kept"
        names.append(name)
    return names
