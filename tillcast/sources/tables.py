"""Stored tables on plain Parquet.

Parquet has no row update, and a path cannot be overwritten while it is read. Keyed tables are
therefore kept as batches: each batch is one directory that a repeated run overwrites as a whole, and
the state is the last row per key. Nothing already stored is rewritten by an upload.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.constants import SALES_KEY, TENANT, TREND_MODEL_NAME
from tillcast.functions import payload
from tillcast.operators.ingest import latest_by_key
from tillcast.operators.runlog import decode_payload, with_run_defaults

SALES_BATCH_SCHEMA = (
    "restaurant_id string, location_id string, date date, daily_sales_total decimal(18,2), batch_id bigint"
)


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Store one batch; running it again replaces the batch instead of adding to it."""
    rows.drop("batch_id").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """Stored batches, optionally only earlier ones (partition pruning); empty where none exist."""
    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    return rows if before is None else rows.where(F.col("batch_id") < before)


def _last_compaction(spark: SparkSession, root: str) -> int | None:
    commits = read_batches(spark, f"{root}/base_commits", "rows bigint, batch_id bigint")
    return commits.agg(F.max("batch_id")).first()[0]


def sales_batches(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """Rows that make up the sales state: the last compacted state and the batches after it."""
    log = read_batches(spark, f"{root}/log", SALES_BATCH_SCHEMA, before)
    through = _last_compaction(spark, root)
    if through is None or (before is not None and through >= before):
        return log
    base = read_batches(spark, f"{root}/base", SALES_BATCH_SCHEMA).where(F.col("batch_id") == through)
    return base.unionByName(log.where(F.col("batch_id") > through))


def store_sales_batch(rows: DataFrame, root: str, batch_id: int) -> None:
    """Store accepted rows of one batch, reduced to the last row per key."""
    write_batch(latest_by_key(rows.withColumn("batch", F.lit(batch_id))), f"{root}/log", batch_id)


def sales_state(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The sales table: last stored row per tenant and date."""
    rows = sales_batches(spark, root, before)
    return rows.groupBy(*SALES_KEY).agg(
        F.max_by("daily_sales_total", "batch_id").alias("daily_sales_total")
    )


def sales_of_key(
    spark: SparkSession, root: str, restaurant_id: str, location_id: str, date: str
) -> DataFrame:
    """Point lookup; the key filter reaches the Parquet scan."""
    return sales_state(spark, root).where(
        (F.col("restaurant_id") == restaurant_id)
        & (F.col("location_id") == location_id)
        & (F.col("date") == F.lit(date).cast("date"))
    )


def compact_sales(spark: SparkSession, root: str, through: int) -> None:
    """Fold all batches up to ``through`` into one state, so that readers skip their history.

    The commit row is written last: an interrupted compaction is never read. Files are laid out by
    date, so that lookups of a few dates skip most of them; the tenant splits a date that holds many
    rows.
    """
    state = sales_state(spark, root, before=through + 1).repartitionByRange("date", *TENANT)
    write_batch(state, f"{root}/base", through)
    rows = spark.range(1).select(F.lit(through).cast("bigint").alias("rows"))
    write_batch(rows, f"{root}/base_commits", through)


def _part_name(key: str) -> str:
    return quote(key, safe="")


def append_keyed(rows: DataFrame, path: str, key: str, by: list[str] | None = None) -> None:
    """Append what one run gives, under its key; running it again replaces the rows instead of adding to them.

    A commit row is written last. An append that was cut short is not read, and neither is one that is being repeated
    seen half: its commit goes first.
    """
    spark = rows.sparkSession
    commit = f"{path}/commits/appended_by=k_{_part_name(key)}"
    remove_folder(spark, commit)
    writer = rows.drop("appended_by").write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}/rows/appended_by=k_{_part_name(key)}")
    spark.range(1).select(F.current_timestamp().alias("committed_at")).coalesce(1).write.mode("overwrite").parquet(commit)


def read_committed(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of all committed appends, with the key as ``appended_by``; a given schema avoids merging footers of all files."""
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", True)
    commits = spark.read.parquet(f"{path}/commits").select("appended_by").distinct()
    # The mark in front keeps keys of digits from being read as numbers.
    return reader.parquet(f"{path}/rows").join(commits, "appended_by", "left_semi").withColumn("appended_by", F.substr("appended_by", F.lit(3)))


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def append_features(rows: DataFrame, path: str, run_id: str, created_at: Column | None = None) -> None:
    """Append feature lists of one run to the feature store."""
    stamp = F.current_timestamp() if created_at is None else created_at
    append_keyed(rows.withColumn("created_at", stamp), path, run_id)


def model_version(trained_at: Column, suffix: Column | None = None) -> Column:
    """``yyyyMMdd_HHmmss_`` and six hex digits; sorts by time."""
    tail = F.substring(F.expr("uuid()"), 1, 6) if suffix is None else suffix
    return F.concat(F.date_format(trained_at, "yyyyMMdd_HHmmss_"), tail)


def new_run_id(at: Column, suffix: Column | None = None) -> Column:
    """``run_yyyyMMdd_HHmmss_`` and eight hex digits."""
    tail = F.substring(F.expr("uuid()"), 1, 8) if suffix is None else suffix
    return F.concat(F.lit("run_"), F.date_format(at, "yyyyMMdd_HHmmss_"), tail)


def append_model_version(models: DataFrame, path: str, version: str) -> None:
    """Store one training run of all its tenants; the same version again replaces it.

    The newest model of every tenant is kept beside the versions, so that reading it reads no history: the last
    table of newest models and the new version are folded into the next one, and a commit row names it.
    """
    spark = models.sparkSession
    stored = models.drop("model_version")
    stored.write.mode("overwrite").parquet(f"{path}/versions/model_version={_part_name(version)}")
    mine = spark.read.schema(stored.schema).parquet(f"{path}/versions/model_version={_part_name(version)}").withColumn("model_version", F.lit(version))
    current = _newest_table(spark, path)
    if current is None:
        newest = mine
    else:
        kept = spark.read.parquet(current).where(F.col("model_version") != version)
        # A repeated version may have lost tenants, whose earlier models then count again.
        lost = read_model_versions(spark, path).where(F.col("model_version") != version) \
            .join(_lost_tenants(spark, current, version, mine), TENANT, "left_semi")
        newest = _of_last_version(kept.unionByName(lost, allowMissingColumns=True).unionByName(mine, allowMissingColumns=True))
    name = f"{uuid.uuid4().hex}"
    newest.write.parquet(f"{path}/newest/{name}")
    order = spark.range(1).select(F.lit(name).alias("name"), F.current_timestamp().alias("committed_at"))
    order.coalesce(1).write.mode("append").parquet(f"{path}/newest_commits")


def _newest_table(spark: SparkSession, path: str) -> str | None:
    commits = read_batches(spark, f"{path}/newest_commits", "name string, committed_at timestamp")
    last = commits.agg(F.max_by("name", "committed_at").alias("name")).first()
    return f"{path}/newest/{last.name}" if last.name else None


def _lost_tenants(spark: SparkSession, current: str, version: str, mine: DataFrame) -> DataFrame:
    """Tenants whose newest model was of this version before it was repeated without them."""
    before = spark.read.parquet(current).where(F.col("model_version") == version)
    return before.select(*TENANT).join(mine.select(*TENANT), TENANT, "left_anti")


def trend_model_records(models: DataFrame, trained_at: Column | None = None) -> DataFrame:
    """The stored form of the trend model."""
    stamp = F.current_timestamp() if trained_at is None else trained_at
    return models.select(
        F.lit(TREND_MODEL_NAME).alias("model_name"), *models.columns, stamp.alias("trained_at")
    )


def read_model_versions(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.option("mergeSchema", True)
        .parquet(f"{path}/versions")
        .withColumn("model_version", F.col("model_version").cast("string"))
    )


def _of_last_version(versions: DataFrame) -> DataFrame:
    """Rows of each tenant's greatest version, which stays in a hash table; an equality join meets them again."""
    last = versions.groupBy(*TENANT).agg(F.max("model_version").alias("model_version"))
    return versions.join(last, [*TENANT, "model_version"]).select(*versions.columns)


def latest_models(spark: SparkSession, path: str) -> DataFrame:
    """The model each tenant trained last, from the table of newest models. Older versions stay readable by their version."""
    current = _newest_table(spark, path)
    return _of_last_version(read_model_versions(spark, path)) if current is None else spark.read.parquet(current)


def write_model_json(records: DataFrame, path: str, version: str) -> None:
    """Average model records as JSON lines for readers outside Spark.

    A training run of some tenants adds a version and leaves the models of all others; the same
    version again replaces it.
    """
    records.write.mode("overwrite").json(f"{path}/model_version={version}")


def read_model_json(spark: SparkSession, path: str) -> DataFrame:
    """Average models kept as JSON lines, with a reason where a line is not usable.

    Where the path holds versions, a tenant's last one counts; lines without a tenant are all kept.
    """
    text = F.col("value")
    value = payload.parsed(text)
    average = payload.field(value, "$.avg_daily_sales", "decimal(22,4)")
    lines = spark.read.text(path)
    versioned = "model_version" in lines.columns
    rows = lines.select(
        payload.field(value, "$.restaurant_id").alias("restaurant_id"),
        payload.field(value, "$.location_id").alias("location_id"),
        payload.field(value, "$.version").alias("version"),
        average.alias("avg_daily_sales"),
        payload.field(value, "$.training_rows", "bigint").alias("training_rows"),
        F.when(~payload.is_object(value), F.lit("model_load_failed"))
        .when(average.isNull(), F.lit("invalid_model_format"))
        .alias("reason"),
        *([F.col("model_version").cast("string").alias("model_version")] if versioned else []),
    )
    if not versioned:
        return rows
    named = F.col("restaurant_id").isNotNull() & F.col("location_id").isNotNull()
    return _of_last_version(rows.where(named)).unionByName(rows.where(~named)).drop("model_version")


def append_runs(runs: DataFrame, path: str, key: str, stored_at: Column | None = None) -> None:
    """Append to the run log under the run's (or batch's) key, partitioned by day so that lookups of recent runs prune.

    Columns may be added over time; older files read as NULL there.
    """
    stamp = F.current_timestamp() if stored_at is None else stored_at
    stored = with_run_defaults(runs).withColumn("stored_at", stamp)
    append_keyed(stored.withColumn("stored_day", F.col("stored_at").cast("date")), path, key, by=["stored_day"])


def run_payload(runs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds the JSON payload built from the given columns."""
    return runs.withColumn("payload_json", F.to_json(F.struct(*columns)))


def read_runs(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The committed run log with decoded payloads, where it has any."""
    runs = read_committed(spark, path, schema)
    return decode_payload(runs) if "payload_json" in runs.columns else runs
