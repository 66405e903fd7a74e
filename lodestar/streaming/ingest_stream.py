"""Memories that come in as a stream, into a table of versions.

A folder holds three tables: `memories` (what went in), `links` (which row corrects which) and `decisions` (one row for
every row that came in). Each batch writes one folder of each, named by the batch's number, and decisions last. A batch
reads the versions before its own only and overwrites its own folders, so a batch that is run again, after a lost driver
as well, leaves the same table. A version counts for readers once its decisions are complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.operators.ingest import COLUMNS, ingest
from lodestar.session import discard, materialize

#: Strength of the link from a row to one that it corrects.
CORRECTS = 0.8
FIRST = -1


def create(stored: DataFrame, folder: str) -> None:
    """Begin a table with the memories that are there already (id, content, labels, embedding), as its version FIRST."""
    spark = stored.sparkSession
    _write(stored.select(*COLUMNS), folder, "memories", FIRST)
    _write(spark.createDataFrame([], "a long, b long, strength double"), folder, "links", FIRST)
    _write(spark.createDataFrame([], "id long, outcome string, original long"), folder, "decisions", FIRST)


def _write(rows: DataFrame, folder: str, table: str, version: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/{table}/version={version}")


def last_version(spark: SparkSession, folder: str) -> int:
    """The last version whose decisions are complete."""
    context = spark.sparkContext
    marks = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/decisions/version=*/_SUCCESS")
    found = marks.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(marks) or []
    return max(int(f.getPath().getParent().getName().partition("=")[2]) for f in found)


def read(spark: SparkSession, folder: str, table: str, version: int | None = None) -> DataFrame:
    """memories, links or decisions as of a version, the last one if none is given."""
    upto = last_version(spark, folder) if version is None else version
    rows = spark.read.parquet(f"{folder}/{table}")
    return rows.where(F.col("version") <= upto).drop("version")


def ingest_batch(batch: DataFrame, number: int, folder: str, history: bool = False) -> None:
    """Take in one batch as the version of that number; once more gives the same."""
    spark = batch.sparkSession
    batch = materialize(batch.select(*COLUMNS), "ingest-arrived")
    stored = read(spark, folder, "memories", number - 1)
    known = read(spark, folder, "decisions", number - 1).select("id").unionByName(stored.select("id"))
    found = materialize(ingest(stored, batch.join(known, "id", "left_anti").dropDuplicates(["id"]), history), "ingest-found")
    went_in = found.where("outcome = 'in'")
    _write(batch.drop("labels").dropDuplicates(["id"]).join(went_in.select("id", "labels"), "id").select(*COLUMNS), folder, "memories", number)
    links = went_in.select(F.col("id").alias("a"), F.explode("conflicts").alias("b"), F.lit(CORRECTS).alias("strength"))
    _write(links, folder, "links", number)
    _write(found.select("id", "outcome", "original"), folder, "decisions", number)
    discard(batch, found)


def ingest_stream(arriving: DataFrame, folder: str, checkpoint: str, history: bool = False) -> StreamingQuery:
    """Run a stream of rows (id, content, labels, embedding) into the table of the folder, as far as there are rows."""
    take = lambda batch, number: ingest_batch(batch, number, folder, history)
    return arriving.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
