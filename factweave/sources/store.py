"""Tables of documents, facts and relations in a folder, with idempotent appends.

Each table is parquet. Appends first take out what is already there, so that repeating a batch
changes nothing; overwrites are written beside the table and then take its place.
"""

from __future__ import annotations

import contextlib
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas

TABLES = {"documents": schemas.DOCUMENTS, "facts": schemas.FACTS, "relations": schemas.RELATIONS}


def canonical_pair(df: DataFrame) -> DataFrame:
    return df.withColumns({"__lo": F.least("fact_a_id", "fact_b_id"), "__hi": F.greatest("fact_a_id", "fact_b_id")})


def new_relations(candidates: DataFrame, existing: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Relations whose pair is in existing in neither direction; of several, the first by order (best match
    first). Orientation is kept."""
    order = [F.desc("similarity"), "fact_a_id", "fact_b_id"] if order is None else order
    first = F.row_number().over(Window.partitionBy("__lo", "__hi").orderBy(*order))
    fresh = canonical_pair(candidates).withColumn("__n", first).where("__n = 1").drop("__n")
    return fresh.join(canonical_pair(existing).select("__lo", "__hi"), ["__lo", "__hi"], "left_anti").drop("__lo", "__hi")


def not_yet_ingested(files: DataFrame, documents: DataFrame) -> DataFrame:
    return files.join(documents.select("filename"), "filename", "left_anti")


def kept_documents(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """Documents that have a fact; the others aren't stored. Facts go by document only once their ids have been made few: a
    document's facts would all meet in one task."""
    return documents.join(facts.select("doc_id").distinct(), "doc_id", "left_semi")


#: Documents whose ids share a block are summed up together.
BLOCK = 4096


def numbered_facts(facts: DataFrame, first: int = 1) -> DataFrame:
    """fact_id from the order of doc_id, chunk and ordinal: the same for any partitioning. Ranks are taken
    inside documents and moved by the counts of the documents before, which are summed by blocks of ids first, so no task
    sorts all facts or all documents."""
    counts = facts.groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("doc_id") / BLOCK))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("m"))
    blocks = blocks.select("block", (F.sum("m").over(Window.orderBy("block")) - F.col("m")).alias("base"))  # one row a block
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("doc_id")) - F.col("n")
    before = counts.withColumn("inside", inside).join(blocks, "block").select("doc_id", (F.col("base") + F.col("inside")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk", "ordinal"))
    return facts.join(before, "doc_id").withColumn("fact_id", F.col("before") + rank + (first - 1)).drop("before")


def shared_home(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: below spark.checkpoint.dir, else in the warehouse; a temp folder only
    where all of Spark is this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local"):
        base = f"file://{tempfile.gettempdir()}/factweave"
    return f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def aged(spark: SparkSession, path: str, folder: str, step_ms: int = 10000) -> None:
    """Make the files below path/<folder>=n the older the smaller n is. Only their times are touched."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.globStatus(hadoop(f"{path}/{folder}=*/*"))
    numbered = sorted((int(f.getPath().getParent().getName().split("=")[1]), f.getPath().toString()) for f in files)
    for back, (_, name) in enumerate(reversed(numbered)):
        fs.setTimes(hadoop(name), int(time.time() * 1000) - back * step_ms, -1)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _moved(self, old: str, new: str) -> bool:
        fs, source = self._fs(f"{self.path}/{old}")
        return fs.exists(source) and fs.rename(source, self._fs(f"{self.path}/{new}")[1])

    def read(self, table: str) -> DataFrame:
        fs, target = self._fs(f"{self.path}/{table}")
        if not fs.exists(target):
            # An overwrite was cut off between its two renames: it is finished now.
            self._moved(f".{table}-next", table) or self._moved(f".{table}-old", table)
        if not fs.exists(target):
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/{table}")

    def append(self, table: str, rows: DataFrame) -> None:
        """Missing columns are null; others than the table's are left out."""
        schema = self.spark.createDataFrame([], TABLES[table]).schema
        rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").parquet(f"{self.path}/{table}")

    def append_documents(self, rows: DataFrame) -> None:
        self.append("documents", rows.join(self.read("documents").select("doc_id"), "doc_id", "left_anti"))

    def append_facts(self, rows: DataFrame) -> None:
        self.append("facts", rows.join(self.read("facts").select("fact_id"), "fact_id", "left_anti"))

    def fresh_relations(self, rows: DataFrame) -> DataFrame:
        return new_relations(rows, self.read("relations"))

    def append_relations(self, rows: DataFrame) -> None:
        self.append("relations", self.fresh_relations(rows))

    def clear(self, table: str) -> int:
        """Delete all rows; how many there were."""
        n = self.read(table).count()
        fs, target = self._fs(f"{self.path}/{table}")
        fs.delete(target, True)
        return n

    def delete_document(self, doc_id: int) -> None:
        """A document with its facts and their relations."""
        facts = self.read("facts")
        gone = facts.where(F.col("doc_id") == doc_id).select("fact_id")
        relations = self.read("relations")
        for side in ("fact_a_id", "fact_b_id"):
            relations = relations.join(gone.select(F.col("fact_id").alias(side)), side, "left_anti")
        for table, rows in (("relations", relations), ("facts", facts.where(F.col("doc_id") != doc_id)), ("documents", self.read("documents").where(F.col("doc_id") != doc_id))):
            self.overwrite(table, rows)

    def overwrite(self, table: str, rows: DataFrame) -> None:
        """The rows in place of the table's. The old table moves aside once the new one is whole, and goes last."""
        rows.write.mode("overwrite").parquet(f"{self.path}/.{table}-next")
        self._drop(f".{table}-old")
        self._moved(table, f".{table}-old")
        if not self._moved(f".{table}-next", table):
            raise OSError(f"{self.path}/{table} could not be replaced")
        self._drop(f".{table}-old")

    def _drop(self, name: str) -> None:
        fs, target = self._fs(f"{self.path}/{name}")
        fs.delete(target, True)

    @contextlib.contextmanager
    def scratch(self, rows: DataFrame):
        """rows, written once to a folder of the store that goes at the end."""
        name = f".scratch-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        try:
            yield self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")
        finally:
            self._drop(name)
