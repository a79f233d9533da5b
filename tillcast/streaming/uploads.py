"""Incremental upload feed: new CSV files are validated, counted and applied to the sales table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillcast.constants import SALES_KEY
from tillcast.operators.ingest import accepted_rows, count_against, rejected_rows
from tillcast.session import shared_checkpoint_dir
from tillcast.sources.sales_files import read_upload
from tillcast.sources.scratch import Scratch
from tillcast.sources.tables import read_batches, sales_batches, store_sales_batch, write_batch

# Only the path of a new file is taken from the stream; its content is read by the batch reader.
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def apply_upload(spark: SparkSession, paths: list[str], root: str, batch_id: int) -> None:
    """Apply one set of files. Repeating a batch id gives the same tables.

    Counts compare with batches stored before this one only, so a repeat after a lost driver counts
    what the first attempt counted.
    """
    with Scratch(spark, "upload") as scratch:
        classified, status = read_upload(spark, paths, scratch)
        classified = scratch.stage(classified, "classified")
        # Two scalars; they let Parquet skip row groups outside the dates of this upload.
        span = classified.agg(F.min("date").alias("first"), F.max("date").alias("last")).first()
        earlier = (
            sales_batches(spark, root, before=batch_id)
            .where(F.col("date").between(F.lit(span["first"]), F.lit(span["last"])))
            .select(*SALES_KEY)
        )
        write_batch(count_against(earlier, classified), f"{root}/counts", batch_id)
        write_batch(rejected_rows(classified), f"{root}/rejects", batch_id)
        write_batch(status, f"{root}/status", batch_id)
        accepted = accepted_rows(classified)
        store_sales_batch(accepted.select(*SALES_KEY, "daily_sales_total", "ingest_seq"), root, batch_id)


class ForeignRoot(ValueError):
    """The tables at a root were written under another checkpoint."""


def _stored_id(spark: SparkSession, path: str) -> str | None:
    rows = read_batches(spark, path, "feed_id string").head(1)
    return rows[0].feed_id if rows else None


def claim_root(spark: SparkSession, root: str, checkpoint: str) -> None:
    """Tie a root to one checkpoint, as batch ids only mean something together with it.

    A new or lost checkpoint counts its batches from zero and would replace stored ones, so a root
    that belongs to another checkpoint is refused.
    """
    marks = f"{checkpoint}/tillcast_feed", f"{root}/feed"
    at_checkpoint, at_root = (_stored_id(spark, m) for m in marks)
    if at_root is not None and at_root != at_checkpoint:
        raise ForeignRoot(f"{root} holds batches of another checkpoint than {checkpoint}")
    if at_root is None:
        feed_id = at_checkpoint or str(uuid.uuid4())
        for mark in marks:  # the root last: an interrupted claim is taken up again
            spark.createDataFrame([(feed_id,)], "feed_id string").coalesce(1).write.mode("overwrite").parquet(mark)


def upload_feed(
    spark: SparkSession,
    directory: str,
    root: str,
    checkpoint: str | None = None,
    max_files: int = 1000,
) -> StreamingQuery:
    """Process all files that arrived since the last run, then stop.

    ``max_files`` bounds a micro-batch and with it the list of paths the driver hands on. A root takes
    batches of one checkpoint only.
    """
    checkpoint = checkpoint or f"{shared_checkpoint_dir(spark)}/upload_feed"
    claim_root(spark, root, checkpoint)

    def apply(files: DataFrame, batch_id: int) -> None:
        paths = [r.path for r in files.select("path").collect()]
        if paths:
            apply_upload(files.sparkSession, paths, root, batch_id)

    return (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", "*.csv")
        .option("maxFilesPerTrigger", max_files)
        .load(directory)
        .select("path")
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def upload_counts_table(spark: SparkSession, root: str) -> DataFrame:
    """Inserted, updated and skipped rows per applied batch."""
    return spark.read.parquet(f"{root}/counts").select(
        F.col("batch_id").cast("bigint").alias("batch"), "inserted", "updated", "skipped"
    )
