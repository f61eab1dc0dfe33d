"""Folder ingest: one output per document layout, for files old and new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow import storage
from orderflow.operators.order_lines import extraction_outcome
from orderflow.plans import registry
from orderflow.sources.readers import UNREADABLE, read_each_file
from orderflow.staging import staged

WORD_SCHEMA = "doc_id string, page int, word_seq int, x0 double, top double, text string"
PAGE_SCHEMA = "doc_id string, page int, text string"
OUTCOME_SCHEMA = "doc_id string, rows bigint, status string"


def ingest(source: DataFrame, layout: str) -> tuple[DataFrame, DataFrame]:
    """Order lines of all documents, and per document whether it gave any. A document
    without lines is a row of the outcome, not an error."""
    lines = registry.extract_lines(source, layout)
    return lines, extraction_outcome(source, lines)


def unreadable_files(files: DataFrame) -> DataFrame:
    """Rows of an outcome for the files that could not be read: their path stands for the document."""
    broken = files.where(F.col("status") == UNREADABLE)
    return broken.select(F.col("file").alias("doc_id"), F.lit(0).cast("bigint").alias("rows"), "status")


def ingest_folder(spark: SparkSession, path: str, layout: str, schema: str = PAGE_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Order lines of all parquet files below a folder, and the outcome: a row for each document, ok or no_rows, and one
    for each file that cannot be read, unreadable, which stops none of the others."""
    source, files = read_each_file(spark, path, schema)
    lines, outcome = ingest(source.drop("file"), layout)
    return lines, outcome.unionByName(unreadable_files(files))


def ingest_new(spark: SparkSession, path: str, layout: str, out: str, progress: str, schema: str = PAGE_SCHEMA) -> None:
    """Ingest what has been added to a folder of parquet files, then stop.

    progress remembers the files done. A batch overwrites its own folder, so one that is
    repeated after a failure leaves no row twice. A broken file stops nothing and counts as done: the files that
    were there before the batches began, but gave no row to any batch so far, are written to unreadable, anew each time.
    (A batch tells no footers, so here a file that breaks in the middle gives the rows before that.)
    What a document gave over all batches is told by ingest_outcome.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    listed = staged(reader.load(path).select(F.col("path").alias("file")))

    def write(batch: DataFrame, number: int) -> None:
        pages = batch.drop("file")
        registry.extract_lines(pages, layout).write.mode("overwrite").parquet(f"{out}/lines/batch={number}")
        written = spark.read.parquet(f"{out}/lines/batch={number}")
        extraction_outcome(pages, written).write.mode("overwrite").parquet(f"{out}/outcome/batch={number}")
        batch.select("file").distinct().write.mode("overwrite").parquet(f"{out}/files/batch={number}")

    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
    query = (
        source.parquet(path).select("*", F.col("_metadata.file_path").alias("file")).writeStream.foreachBatch(write)
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    came = spark.read.schema("file string, batch int").parquet(f"{out}/files") if storage.names(spark, f"{out}/files") else listed.limit(0)
    listed.join(came.select("file"), "file", "left_anti").write.mode("overwrite").parquet(f"{out}/unreadable")


def ingest_outcome(spark: SparkSession, out: str) -> DataFrame:
    """Per document over all batches: its rows and status, a document whose pages came in several batches being one row;
    and a row for each file that could not be read."""
    batches = spark.read.schema(f"{OUTCOME_SCHEMA}, batch int").parquet(f"{out}/outcome")
    found = batches.groupBy("doc_id").agg(F.sum("rows").alias("rows")).withColumn("status", F.when(F.col("rows") > 0, "ok").otherwise("no_rows"))
    broken = spark.read.schema("file string").parquet(f"{out}/unreadable")
    return found.unionByName(unreadable_files(broken.withColumn("status", F.lit(UNREADABLE))))
