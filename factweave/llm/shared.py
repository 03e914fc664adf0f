"""Folders that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir. Where that is unset (tests, local runs) one is
    chosen: the temp folder if the whole of Spark is this process, else the shared warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            base = f"file://{(path := tempfile.mkdtemp(prefix='factweave-'))}"
            atexit.register(shutil.rmtree, path, ignore_errors=True)
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    if not _made:
        atexit.register(_clear, spark)
    _made.append(path := f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return path


_made: list[str] = []


def _clear(spark: SparkSession) -> None:
    """Delete the folders when the driver ends: results are read from them until then."""
    with contextlib.suppress(Exception):  # a session that is gone already
        for path in _made:
            delete(spark, path)


#: Rows that Spark hands to Python at once. Texts are long: the usual 10,000 rows would be tens to hundreds of MB.
BATCH_ROWS = 1024


def bounded_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows of df, read again from a table written to path."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, read again from a table written to the shared folder."""
    return stored(df, shared_folder(df.sparkSession, name))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now rather than at some later
    collection of the driver's garbage; long incremental jobs otherwise fill the disks."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
