"""Sales CSV files: scan by header name, verdict per file, file per tenant.

The text of all files is read once, into a staged table of lines, which feeds the headers, the verdicts,
the rows and the status.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillcast.constants import DEFAULT_SALES_FILE, MONEY, TENANT
from tillcast.functions.text import base_name, first_filled, safe_id
from tillcast.functions.values import finite_number, iso_date, money
from tillcast.operators.ingest import classify_uploads, latest_by_key
from tillcast.sources.scratch import Scratch

Paths = str | list[str]

SALES_COLUMNS = ["restaurant_id", "location_id", "date", "daily_sales_total"]

CSV_SOURCE = "csv_file"
FALLBACK_SOURCE = "simulated_fallback"
NO_UPLOAD = "upload_sales.csv_not_found"
BAD_HEADERS = "invalid_csv_headers"
OUT_OF_RANGE = "amount_out_of_range"

UPLOAD_STATUS_SCHEMA = "file_name string, ingestion_status string, reason string"
MAX_RECORD_CHARS = 1 << 20  # a quoted cell that never ends would otherwise gather the rest of its file

CELL_OPTIONS = {"escape": '"', "emptyValue": "", "mode": "PERMISSIVE"}

# Whether a quoted cell is still open at the end of a line, for a line that begins outside of one and for one that
# begins inside. A quote opens a cell only as its first sign; behind a closed one anything goes up to the comma.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
_CELL = rf'(?:"{_QUOTED}"[^,]*+|[^",][^,]*+)?'
_OPENS = rf'(?:{_CELL},)*+"{_QUOTED}$'
OPENS = rf"(?s)^{_OPENS}"
STAYS_OPEN = rf'(?s)^{_QUOTED}(?:$|"[^,]*+,{_OPENS})'


def file_name_of(encoded_path: Column) -> Column:
    """File name of a URL-encoded path."""
    return F.url_decode(F.replace(base_name(encoded_path), F.lit("+"), F.lit("%2B")))


def bare_path(path: Column) -> Column:
    """A path without its scheme, which listing and scan spell differently (file:/ and file:///)."""
    return F.regexp_replace(path, "^[a-z0-9]+:/+", "/")


def list_files(spark: SparkSession, path: Paths) -> DataFrame:
    """Names of the files at a path, also of empty ones, which no scan ever opens. The content is not read.

    The names are those of the file index that Spark builds on the driver for any read of the path.
    """
    listed = spark.read.text(path).inputFiles()
    if not listed:
        return spark.createDataFrame([], "file_path string, file_name string")
    found = spark.createDataFrame(pd.DataFrame({"file_path": listed}))
    return found.select(bare_path(F.col("file_path")).alias("file_path"), file_name_of(F.col("file_path")).alias("file_name"))


@dataclass(frozen=True)
class SalesText:
    """The files at a path and their staged lines.

    ``files`` has ``file_path, file_name`` of every file, also of empty ones. ``lines`` has the text line by line with
    ``at`` (when its file was written, the file's name, where the block begins, a number that grows in a block).
    """

    files: DataFrame
    lines: DataFrame

    @cached_property
    def records(self) -> DataFrame:
        """``file_path, file_name, at, record``: the lines, or several joined where a quoted cell goes on.

        Only files in which a cell is left open take the second way. A record that is longer than
        ``MAX_RECORD_CHARS`` is NULL.
        """
        opened = self.lines.where("opens").select("file_path").distinct()
        whole = self.lines.join(opened, "file_path", "left_anti").select("file_path", "file_name", "at", F.col("value").alias("record"))
        split = joined_records(self.lines.join(opened, "file_path", "left_semi"))
        return whole.unionByName(split).where(F.col("record").isNull() | (F.trim("record") != ""))

    @cached_property
    def headers(self) -> DataFrame:
        """``file_path, header, header_at``: the first record of every file; combines to one row per file on the map side."""
        first = F.struct("at", F.coalesce("record", F.lit("")).alias("header"))
        found = self.records.where(F.col("at.start") == 0).groupBy("file_path").agg(F.min(first).alias("first"))
        return found.select("file_path", "first.header", F.col("first.at.n").alias("header_at"))


def read_text(spark: SparkSession, path: Paths, scratch: Scratch) -> SalesText:
    """Stage the lines of all files at a path. Blocks of a file are read by different tasks."""
    listed = list_files(spark, path)
    quoted = F.col("value").contains('"')
    lines = spark.read.text(path).select(
        bare_path(F.col("_metadata.file_path")).alias("file_path"),
        file_name_of(F.col("_metadata.file_path")).alias("file_name"),
        F.struct(
            F.col("_metadata.file_modification_time").alias("written"),
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("n"),
        ).alias("at"),
        "value",
        F.when(quoted, F.col("value").rlike(OPENS)).otherwise(F.lit(False)).alias("opens"),
        F.when(quoted, F.col("value").rlike(STAYS_OPEN)).otherwise(F.lit(True)).alias("stays_open"),
    )
    return SalesText(scratch.stage(listed, "files"), scratch.stage(lines, "lines"))


def _running(df: DataFrame, keys: list[str], order: Column, sets: Column, flips: Column) -> DataFrame:
    """Adds ``known`` and ``flipped``: the last state that a row sets, and whether the rows flip it since (over all rows if none does).

    The state after a row is ``known`` (else the state before the first row) turned by ``flipped``.
    """
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turned = df.withColumn("turns", F.sum(flips.cast("int")).over(so_far) % 2 == 1)
    return turned.withColumn("known", F.last(F.when(sets.isNotNull(), sets != F.col("turns")), ignorenulls=True).over(so_far)) \
        .withColumnRenamed("turns", "flipped")


def joined_records(lines: DataFrame) -> DataFrame:
    """Lines joined to records where a quoted cell holds line breaks.

    What a line does to the state (open or not) depends on the state before it, so lines are composed:
    first inside each block of a file, then over the few rows that sum up the blocks. No file is read by one task.
    """
    block, order = ["file_path", "start"], F.col("n")
    rows = lines.select("file_path", "file_name", "at", "at.start", "at.n", "value", "opens", "stays_open")
    sets = F.when(F.col("opens") == F.col("stays_open"), F.col("opens"))
    inside = _running(rows, block, order, sets, F.col("opens") & ~F.col("stays_open"))
    ends = inside.groupBy(*block).agg(F.max_by(F.struct("known", "flipped"), "n").alias("e")).select(*block, "e.known", "e.flipped")
    by_file = Window.partitionBy("file_path").orderBy("start")
    over = _running(ends.withColumnsRenamed({"known": "sets", "flipped": "turned"}), ["file_path"], F.col("start"),
                    F.when(F.col("sets").isNotNull(), F.col("sets") != F.col("turned")), F.col("sets").isNull() & F.col("turned"))
    after = F.coalesce("known", F.lit(False)) != F.col("flipped")
    carried = over.withColumn("after", after).select(*block, F.lag("after", 1, False).over(by_file).alias("carried"))

    entered = inside.join(carried, block)
    state = F.coalesce("known", "carried") != F.col("flipped")
    before = F.lag(state).over(Window.partitionBy(*block).orderBy(order))
    begun = entered.withColumn("begins", ~F.coalesce(before, F.col("carried")))
    so_far = Window.partitionBy(*block).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = begun.withColumn("in_block", F.sum(F.col("begins").cast("bigint")).over(so_far))
    earlier = by_file.rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.groupBy(*block).agg(F.max("in_block").alias("records"))
    firsts = firsts.select(*block, F.coalesce(F.sum("records").over(earlier), F.lit(0)).alias("first"))
    numbered = counted.join(firsts, block).withColumn("number", F.col("first") + F.col("in_block"))

    one = ["file_path", "number"]
    held = F.sum(F.length("value") + 1).over(Window.partitionBy(*one).orderBy("start", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    measured = numbered.withColumn("held", held)
    fits = F.col("held") <= MAX_RECORD_CHARS
    parts = F.sort_array(F.collect_list(F.when(fits, F.struct("start", "n", "value"))))
    text = F.array_join(F.transform(parts, lambda p: p["value"]), "\n")
    return measured.groupBy(*one).agg(
        F.first("file_name").alias("file_name"), F.min("at").alias("at"), F.when(F.bool_and(fits), text).alias("record")
    ).select("file_path", "file_name", "at", "record")


def _cell_schema(width: int) -> str:
    return ", ".join(f"c{i} string" for i in range(width))


def header_places(headers: DataFrame, width: int, columns: list[str]) -> DataFrame:
    """Position of each wanted column in each file, from 1; 0 where a file lacks it.

    The last of several columns with the same name counts.
    """
    cells = F.from_csv("header", _cell_schema(width), CELL_OPTIONS)
    backwards = F.array(*[F.coalesce(cells[f"c{i}"], F.lit("")) for i in reversed(range(width))])

    def place(name: str) -> Column:
        found = F.array_position(backwards, F.lit(name))
        return F.when(found > 0, width + 1 - found).otherwise(F.lit(0)).cast("int")

    return headers.select("file_path", "header_at", *[place(c).alias(f"at_{c}") for c in columns])


def header_width(headers: DataFrame) -> int:
    """An upper bound of the columns in any file; the driver sees one number."""
    commas = F.length("header") - F.length(F.replace(F.col("header"), F.lit(","), F.lit("")))
    return (headers.agg(F.max(commas)).first()[0] or 0) + 1


def scan_by_name(text: SalesText, columns: list[str] = SALES_COLUMNS) -> DataFrame:
    """Rows of CSV files with the wanted columns found by header name, whatever their order.

    Each row picks its cells through its own file's header: one join on the file, for any number of header
    shapes, and Spark broadcasts the headers where they are small. Every wanted column comes as text, together
    with ``has_<column>`` telling an absent column from an empty cell.
    """
    width = header_width(text.headers)
    places = header_places(text.headers, width, columns)
    rows = text.records.join(places, "file_path").where(F.col("at.n") != F.col("header_at"))
    cells = F.from_csv("record", _cell_schema(width), CELL_OPTIONS)
    # A one-row inline keeps the parse at one evaluation per row.
    parsed = rows.select(
        "file_path", "file_name", F.col("at").alias("ingest_seq"), *[f"at_{c}" for c in columns],
        F.inline(F.array(F.struct(F.array(*[cells[f"c{i}"] for i in range(width)]).alias("cells")))),
    )

    def cell(name: str) -> Column:
        return F.when(F.col(f"at_{name}") > 0, F.get(F.col("cells"), F.col(f"at_{name}") - 1))

    return parsed.select(
        "file_path",
        "file_name",
        "ingest_seq",
        *[cell(c).alias(c) for c in columns],
        *[(F.col(f"at_{c}") > 0).alias(f"has_{c}") for c in columns],
    )


def read_sales_rows(text: SalesText) -> DataFrame:
    """Typed rows of sales files.

    ``valid`` is false where the amount is not a finite number. A finite amount that does not fit the table is
    NULL, with a reason: it is refused by itself, not with its file. A file without an amount column has zeros.
    """
    given, has_amount = F.col("daily_sales_total"), F.col("has_daily_sales_total")
    amount = F.when(has_amount, money(given)).otherwise(F.lit(0).cast(MONEY))
    valid = ~has_amount | finite_number(given).isNotNull()
    return scan_by_name(text).select(
        "file_path",
        "file_name",
        "ingest_seq",
        "restaurant_id",
        "location_id",
        F.col("date").alias("date_text"),
        F.when(amount.isNull(), given).alias("sales_text"),
        amount.alias("daily_sales_total"),
        valid.alias("valid"),
        F.when(valid & amount.isNull(), F.lit(OUT_OF_RANGE)).alias("reason"),
    )


def file_verdicts(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Whether each file is used: one bad row refuses the whole file, and so does having no usable rows."""
    found = rows.groupBy("file_name").agg(
        F.bool_and("valid").alias("good"), F.count_if(F.col("daily_sales_total").isNotNull()).alias("n")
    )
    if files is not None:
        found = files.select("file_name").join(found, "file_name", "left")
    good = F.coalesce(F.col("good") & (F.col("n") > 0), F.lit(False))
    return found.select(
        "file_name",
        F.when(good, F.lit(CSV_SOURCE)).otherwise(F.lit(FALLBACK_SOURCE)).alias("sales_source"),
        F.when(good, F.col("n")).otherwise(F.lit(0)).alias("sales_rows_loaded"),
    )


def rows_of_good_files(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    refused = verdicts.where(F.col("sales_source") == FALLBACK_SOURCE).select("file_name")
    return rows.join(refused, "file_name", "left_anti").drop("valid")


def resolve_tenant_files(tenants: DataFrame, files: DataFrame) -> DataFrame:
    """The best file of each tenant: its own (1), its restaurant's (2) or the default (3).

    Equality joins on the file name only. The default file is a scalar subquery, so tenants without
    a file of their own do not meet in one join partition.
    """
    names = files.select("file_name").distinct()
    default = (
        files.where(F.col("file_name") == DEFAULT_SALES_FILE).agg(F.max("file_name")).scalar()
    )
    restaurant, location = safe_id(F.col("restaurant_id")), safe_id(F.col("location_id"))
    wanted = tenants.select(
        *TENANT,
        F.concat(restaurant, F.lit("__"), location, F.lit("__sales.csv")).alias("own_name"),
        F.concat(restaurant, F.lit("__sales.csv")).alias("restaurant_name"),
    )
    own = names.select(F.col("file_name").alias("own_name"), F.col("file_name").alias("own_file"))
    shared = names.select(
        F.col("file_name").alias("restaurant_name"), F.col("file_name").alias("restaurant_file")
    )
    return (
        wanted.join(own, "own_name", "left")
        .join(shared, "restaurant_name", "left")
        .withColumn("default_file", default)
        .select(
            *TENANT,
            F.coalesce("own_file", "restaurant_file", "default_file").alias("file_name"),
            F.when(F.col("own_file").isNotNull(), F.lit(1))
            .when(F.col("restaurant_file").isNotNull(), F.lit(2))
            .when(F.col("default_file").isNotNull(), F.lit(3))
            .alias("rank"),
        )
    )


def load_tenant_sales(text: SalesText, tenants: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows of the good files, once each, and for every tenant its file and what became of it.

    A tenant's sales are those of its file (``file_name`` in the second relation). Tenants are not multiplied by
    rows here: what is computed of sales is computed per file, and handed to its tenants by ``of_tenants``.
    """
    resolved = resolve_tenant_files(tenants, text.files)
    rows = scratch.stage(read_sales_rows(text), "rows")
    verdicts = file_verdicts(rows, text.files)
    status = of_tenants(resolved, verdicts).select(
        *TENANT,
        "file_name",
        F.coalesce("file_name", F.lit(DEFAULT_SALES_FILE)).alias("sales_file_path"),
        F.coalesce("sales_source", F.lit(FALLBACK_SOURCE)).alias("sales_source"),
        F.coalesce("sales_rows_loaded", F.lit(0)).alias("sales_rows_loaded"),
        F.when(F.col("file_name").isNull(), F.lit("file_not_found")).alias("error"),
    )
    return rows_of_good_files(rows, verdicts), status


def of_tenants(resolved: DataFrame, per_file: DataFrame) -> DataFrame:
    """Each tenant with the one row of its file, NULLs where that is missing.

    The row of the default file, which any number of tenants may share, enters as a scalar subquery, so that
    they do not meet in one join key.
    """
    shared = F.coalesce(F.col("file_name") == DEFAULT_SALES_FILE, F.lit(False))
    values = [c for c in per_file.columns if c != "file_name"]
    default = per_file.where(F.col("file_name") == DEFAULT_SALES_FILE).agg(F.first(F.struct(*values))).scalar()
    of_file = per_file.select(F.col("file_name").alias("own_file"), F.struct(*values).alias("own"))
    joined = resolved.withColumn("own_file", F.when(~shared, F.col("file_name"))).join(of_file, "own_file", "left")
    chosen = joined.withColumn("chosen", F.when(shared, default).otherwise(F.col("own")))
    return chosen.select(*resolved.columns, *[F.col(f"chosen.{c}").alias(c) for c in values])


def dated_file_rows(rows: DataFrame) -> DataFrame:
    """Rows of good files with their date, NULL where the text is none, and why a row is not used, if it is not."""
    date = iso_date(F.col("date_text"))
    return rows.select(
        "file_name",
        date.alias("date"),
        "date_text",
        "sales_text",
        "daily_sales_total",
        F.coalesce("reason", F.when(date.isNull(), F.lit("invalid_date"))).alias("reason"),
        F.col("ingest_seq.start").alias("batch"),
        F.col("ingest_seq.n").alias("ingest_seq"),
    )


def keyed_file_sales(dated: DataFrame) -> DataFrame:
    """The last amount of each file and date; the place of a row in its file is its arrival order."""
    return latest_by_key(dated.where(F.col("reason").isNull()), keys=["file_name", "date"])


def read_upload(
    spark: SparkSession, path: Paths, scratch: Scratch, restaurant_id: str = "", location_id: str = ""
) -> tuple[DataFrame, DataFrame]:
    """Classified rows of uploaded files, and a status per file.

    A file without the two required headers is an error and gives no rows. Where there is no file
    at all the status relation has the one row that says so.
    """
    try:
        text = read_text(spark, path, scratch)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        empty = spark.createDataFrame([], _raw_schema())
        status = spark.createDataFrame([(DEFAULT_SALES_FILE, "error", NO_UPLOAD)], UPLOAD_STATUS_SCHEMA)
        return classify_uploads(empty), status

    headed = F.col("has_date") & F.col("has_daily_sales_total")
    raw = scan_by_name(text).where(headed).select(
        "file_name",
        "ingest_seq",
        F.coalesce(first_filled(F.col("restaurant_id")), F.lit(restaurant_id)).alias("restaurant_id"),
        F.coalesce(first_filled(F.col("location_id")), F.lit(location_id)).alias("location_id"),
        F.col("date").alias("date_text"),
        F.col("daily_sales_total").alias("sales_text"),
    )
    return classify_uploads(raw), upload_status(text)


def upload_status(text: SalesText) -> DataFrame:
    """Header check per uploaded file; a file without a header line fails it."""
    places = header_places(text.headers, header_width(text.headers), ["date", "daily_sales_total"])
    checked = places.select(
        "file_path", ((F.col("at_date") > 0) & (F.col("at_daily_sales_total") > 0)).alias("complete")
    )
    ok = F.coalesce(F.col("complete"), F.lit(False))
    return text.files.join(checked, "file_path", "left").select(
        "file_name",
        F.when(ok, F.lit("ok")).otherwise(F.lit("error")).alias("ingestion_status"),
        F.when(~ok, F.lit(BAD_HEADERS)).alias("reason"),
    )


def _raw_schema() -> str:
    return (
        "file_name string, ingest_seq struct<written: timestamp, file: string, start: bigint, n: bigint>, "
        "restaurant_id string, location_id string, date_text string, sales_text string"
    )
