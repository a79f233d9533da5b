"""Input relations of the registered queries, derived from the given tables.

No relation filters by key or caps rows: each covers its whole table, so work grows with the data.
Joins carry no hints; Spark broadcasts a side only where its measured size is below the threshold,
and otherwise shuffles with skewed partitions split at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.constants import DEFAULT_SALES_FILE, MONEY, TENANT
from tillcast.operators.features import daily_sales

FILE_ROWS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's tenant: nation and market segment."""
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey",
        "n_nationkey",
        F.col("n_name").alias("restaurant_id"),
        F.col("c_mktsegment").alias("location_id"),
    )


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_tenants(spark, sf_dir).select(*TENANT).distinct()


def _tenant_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.join(
        customer_tenants(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tenant_orders(spark, sf_dir).select(
        *TENANT,
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_sales(order_lines(spark, sf_dir))


def sales_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants with any sale, without building their daily totals."""
    return _tenant_orders(spark, sf_dir).select(*TENANT).distinct()


def _own_tenant(number: str, kind: str) -> list[Column]:
    """A tenant for each customer or supplier: its nation, and a location of its own."""
    location = F.concat(F.lit(f"{kind}_"), F.col(number).cast("string"))
    return [F.col("n_name").alias("restaurant_id"), location.alias("location_id")]


def single_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, which have many, few or no orders, and suppliers, which never have any."""
    nation = table(spark, sf_dir, "nation")
    customers = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    suppliers = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return customers.select(*_own_tenant("c_custkey", "customer")).unionByName(
        suppliers.select(*_own_tenant("s_suppkey", "supplier"))
    )


def single_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of single customers; some customers only have orders without an amount."""
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf_dir, "orders")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        *_own_tenant("c_custkey", "customer"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(F.col("c_custkey") % 97 != 0, F.col("o_totalprice").cast(MONEY)).alias("amount"),
        (F.col("o_orderkey") % 2 == 1).alias("is_current"),
    )


def single_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_sales(single_order_lines(spark, sf_dir))


def raw_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean and broken upload rows as text; batch 0 is the stored table, batch 1 the upload."""
    key = F.col("o_orderkey")

    def every(n: int) -> Column:
        return key % n == 0

    return _tenant_orders(spark, sf_dir).select(
        key.alias("upload_id"),
        (key % 2).alias("batch"),
        F.when(every(23), F.lit("")).otherwise(F.col("restaurant_id")).alias("restaurant_id"),
        "location_id",
        F.when(every(29), F.lit("2025-13-01"))
        .when(every(31), F.lit(None))
        .when(every(37), F.lit("2025-1-1"))
        .otherwise(F.col("o_orderdate").cast("date").cast("string"))
        .alias("date_text"),
        F.when(every(17), F.lit("abc"))
        .when(every(19), F.lit("-5"))
        .when(every(41), F.lit(""))
        .when(every(43), F.lit("nan"))
        .otherwise(F.col("o_totalprice").cast(MONEY).cast("string"))
        .alias("sales_text"),
    )


def upload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upload rows grouped into files of a few consecutive rows."""
    number = F.floor(F.col("upload_id") / FILE_ROWS).cast("bigint").cast("string")
    return raw_upload(spark, sf_dir).withColumn(
        "file_name", F.concat(F.lit("batch_"), number, F.lit(".csv"))
    )


def sales_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the sales files on offer."""
    restaurant = F.replace(F.col("restaurant_id"), F.lit(" "), F.lit("_"))
    kind = F.col("n_nationkey") % 3
    name = (
        F.when(kind == 0, F.concat(restaurant, F.lit("__"), F.col("location_id"), F.lit("__sales.csv")))
        .when(kind == 1, F.concat(restaurant, F.lit("__sales.csv")))
        .otherwise(F.lit("upload_sales.csv"))
    )
    return customer_tenants(spark, sf_dir).select(name.alias("file_name")).distinct()


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(F.lit(0.0))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("item_id"), F.col("l_shipdate").cast("date").alias("date"))
        .agg(F.sum("l_quantity").alias("handled_qty"), F.sum(returned).alias("wasted_qty"))
    )


def stock_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as stock movements, before they are summed per day."""
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(F.lit(0.0))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("item_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_quantity").alias("handled_qty"),
        returned.alias("wasted_qty"),
    )


def attendance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("employee_id"), F.col("ts").cast("date").alias("work_date"))
        .agg(F.min("ts").alias("clock_in"), F.max("ts").alias("clock_out"))
    )


def _event_tenant() -> list[Column]:
    user = F.col("user_id")
    return [
        F.concat(F.lit("restaurant_"), (user % 5).cast("string")).alias("restaurant_id"),
        F.concat(F.lit("location_"), (user % 3).cast("string")).alias("location_id"),
    ]


def tenant_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        *_event_tenant(), "event_id", "ts", "event_type", "value"
    )


def _run_log_columns() -> list[Column]:
    event = F.col("event_id")
    return [
        event.alias("seq"),
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"),
        F.col("event_type").alias("step"),
        F.when(F.col("event_type") == "error", F.lit("error"))
        .when(event % 10 == 0, F.lit("skipped"))
        .otherwise(F.lit("ok"))
        .alias("status"),
        F.col("ts").alias("started_at"),
        F.floor(F.col("value") * 10).cast("bigint").alias("duration_ms"),
        F.when(event % 13 == 0, F.concat(F.lit("!"), "props"))
        .when(event % 17 == 0, F.lit("[1]"))
        .otherwise(F.col("props"))
        .alias("payload_json"),
    ]


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*_run_log_columns())


def tenant_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log with the tenant of each run."""
    return table(spark, sf_dir, "events").select(*_event_tenant(), *_run_log_columns())


def run_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        event.alias("request_id"),
        F.when(event % 7 == 0, F.lit("click,view, click,bogus"))
        .when(event % 5 == 0, F.lit(" "))
        .otherwise(F.concat(F.col("event_type"), F.lit(",view,purchase")))
        .alias("steps"),
        F.when(event % 3 == 0, F.lit("view")).otherwise(F.lit("")).alias("exclude_steps"),
        F.when(event % 11 == 0, F.lit("purchase")).otherwise(F.lit("")).alias("start_at"),
        F.when(event % 19 == 0, F.lit("signup")).otherwise(F.lit("")).alias("stop_after"),
        F.when(event % 2 == 0, F.lit("no")).otherwise(F.lit("Yes")).alias("strict"),
    )


REQUEST_STEPS = ["click", "error", "purchase", "signup", "view"]


def raw_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored runs of several steps, wrapped or not.

    One in seven has no ingestion step and one in seven has two, the first without a usable entry.
    Lists hold several sales, none, an amount as text, or an entry that is no object.
    """
    event = F.col("event_id")
    amount = F.col("value").cast(MONEY).cast("string")
    day = F.col("ts").cast("date").cast("string")
    sale = F.concat(F.lit('{"date":"'), day, F.lit('","daily_sales_total":'), amount, F.lit("}"))
    listed = (
        F.when(event % 5 == 0, F.concat(sale, F.lit(","), sale))
        .when(event % 5 == 1, F.concat(sale, F.lit(",5")))
        .when(event % 5 == 2, F.concat(F.lit('{"date":"'), day, F.lit('","daily_sales_total":"'), amount, F.lit('"}')))
        .when(event % 5 == 3, F.lit(""))
        .otherwise(sale)
    )

    def ingestion(entries: Column) -> Column:
        restaurant = (F.col("user_id") % 5).cast("string")
        return F.concat(
            F.lit('{"step":"1_data_ingestion","data":{"restaurant_id":"restaurant_'), restaurant,
            F.lit('","sales":['), entries, F.lit("]}}"),
        )

    other = F.concat(F.lit('{"step":"'), F.col("event_type"), F.lit('","data":{"sales":['), sale, F.lit("]}}"))
    steps = (
        F.when(event % 7 == 0, other)
        .when(event % 7 == 1, F.concat(ingestion(F.lit("7")), F.lit(","), ingestion(sale)))
        .otherwise(F.concat(other, F.lit(","), ingestion(listed)))
    )
    run = F.concat(F.lit('{"results":['), steps, F.lit("]}"))
    return table(spark, sf_dir, "events").select(
        event.alias("seq"),
        F.concat(F.lit("run_"), event.cast("string")).alias("run_id"),
        F.when(event % 3 == 0, F.concat(F.lit('{"result":'), run, F.lit("}"))).otherwise(run).alias("payload_json"),
    )


def wrapped_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored runs that name their tenant at the top, in a step, or not at all."""
    event, user = F.col("event_id"), F.col("user_id")
    restaurant = F.concat(F.lit("restaurant_"), (user % 5).cast("string"))
    location = F.concat(F.lit("location_"), (user % 3).cast("string"))
    own = F.concat(
        F.lit('{"restaurant_id":"'), restaurant, F.lit('","location_id":"'), location, F.lit('"}')
    )
    nested = F.concat(
        F.lit('{"result":{"results":[{"step":"a","data":[1]},{"step":"b","data":{"restaurant_id":"'),
        restaurant,
        F.lit('"}}]}}'),
    )
    payload = (
        F.when(event % 4 == 0, own)
        .when(event % 4 == 1, nested)
        .when(event % 4 == 2, F.lit("{}"))
        .otherwise(F.concat(F.lit("!"), own))
    )
    return table(spark, sf_dir, "events").select(
        event.alias("seq"),
        F.concat(F.lit("run_"), event.cast("string")).alias("run_id"),
        payload.alias("payload_json"),
    )


def run_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run contexts that hold their prediction under its step, under ``data``, at the top, or not at all."""
    event, user = F.col("event_id"), F.col("user_id")
    amount = F.concat(
        F.lit('{"predicted_sales":'), F.col("value").cast(MONEY).cast("string"), F.lit("}")
    )
    sale = F.concat(
        F.lit('{"date":"'), F.col("ts").cast("date").cast("string"), F.lit('","daily_sales_total":'),
        F.col("value").cast(MONEY).cast("string"), F.lit("}")
    )
    under_step = F.concat(
        F.lit('{"5_ml_prediction":{"restaurant_id":"restaurant_'),
        (user % 5).cast("string"),
        F.lit('","forecast":['),
        amount,
        F.lit(']},"1_data_ingestion":{"restaurant_id":"other","location_id":"location_'),
        (user % 3).cast("string"),
        F.lit('","sales":['),
        F.array_join(F.array_repeat(sale, 9), ","),
        F.lit("]}}"),
    )
    under_data = F.concat(
        F.lit('{"data":{"model_used":{"name":"m"},"forecast_intervals":['), amount, F.lit(","), amount, F.lit("]}}")
    )
    context = (
        F.when(event % 4 == 0, under_step)
        .when(event % 4 == 1, under_data)
        .when(event % 4 == 2, F.lit('{"model_used":{},"horizon":5}'))
        .otherwise(F.lit('{"x":1}'))
    )
    return table(spark, sf_dir, "events").select(event.alias("seq"), context.alias("context_json"))


def given_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a provider as it may give them."""
    event = F.col("event_id")
    status = F.when(event % 11 == 0, F.lit("error")).when(event % 13 == 0, F.lit("skipped")).otherwise(F.lit("ok"))
    raw = (
        F.when(event % 5 == 0, F.concat(F.lit('{"risk_level":"low","actions":["'), F.col("event_type"), F.lit('",2,"c"]}')))
        .when(event % 5 == 1, F.concat(F.lit("["), F.col("props"), F.lit("]")))
        .when(event % 5 == 2, F.concat(F.lit("!"), F.col("props")))
        .when(event % 5 == 3, F.lit('{"risk_level":null,"actions":"a"}'))
    )
    return table(spark, sf_dir, "events").select(
        event.alias("seq"),
        *_event_tenant(),
        F.concat(F.lit("prompt "), event.cast("string")).alias("prompt"),
        status.alias("status"),
        F.when(status != "ok", F.col("event_type")).alias("reason"),
        F.lit("given").alias("model"),
        raw.alias("raw_json"),
    )


def step_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("step_id"),
        F.col("event_type").alias("step"),
        F.when(F.col("event_type") == "error", F.array("props")).otherwise(none).alias("errors"),
        F.when(F.col("event_id") % 10 == 0, F.array(F.lit("UpstreamError")))
        .otherwise(none)
        .alias("warnings"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(
            F.lit("["),
            F.col("ts").cast("date").cast("string"),
            F.lit("T00:00:00] event=step_done run_id=run_"),
            F.col("user_id").cast("string"),
            F.lit(" step="),
            F.col("event_type"),
            F.lit(" duration_ms="),
            F.floor(F.col("value") * 10).cast("bigint").cast("string"),
            F.lit(" status="),
            F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("ok")),
        ).alias("value")
    )


def raw_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw outputs of steps: with ``data`` or without, errors as list, scalar or nothing, warnings, metrics, or no object."""
    event, kind = F.col("event_id"), F.col("event_type")
    quoted = F.concat(F.lit('"'), kind, F.lit('"'))
    text = (
        F.when(event % 8 == 0, F.concat(F.lit('{"data":{"k":'), quoted, F.lit('},"errors":[],"step":"s"}')))
        .when(event % 8 == 1, F.concat(F.lit('{"errors":['), quoted, F.lit(',{"type":"E"}],"a":1,"status":"x"}')))
        .when(event % 8 == 2, F.concat(F.lit('{"errors":'), quoted, F.lit(',"warnings":["w",2],"metrics":{"rows":3}}')))
        .when(event % 8 == 3, F.concat(F.lit('{"data":null,"errors":null,"b":['), quoted, F.lit(',null]}')))
        .when(event % 8 == 4, F.concat(F.lit("["), quoted, F.lit("]")))
        .when(event % 8 == 5, F.concat(F.lit("!"), kind))
        .when(event % 8 == 6, F.col("props"))
        .otherwise(F.lit('{"data":7,"metrics":[1]}'))
    )
    return table(spark, sf_dir, "events").select(event.alias("seq"), text.alias("raw_json"))


def run_parts(profiles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts of a run, each for some of the tenants: forecasts, staffing plans and insights, in all eight combinations."""
    day = F.sequence(F.lit(1), F.lit(7))
    base = F.round("avg_daily_sales", 2).cast(MONEY)
    forecasts = profiles.where(F.length("restaurant_id") % 2 == 1).select(
        *TENANT, F.transform(day, lambda d: (base + d).cast(MONEY)).alias("forecast"))
    staffing = profiles.where(F.length("location_id") % 2 == 1).select(
        *TENANT, F.transform(day, lambda d: F.struct(d.alias("day_index"), (d + 10).alias("recommended_staff"))).alias("staffing_plan"))
    insights = profiles.where(F.ascii("location_id") % 2 == 1).select(
        *TENANT, F.lit("ok").alias("insight_status"), F.lit("high").alias("risk_level"), F.array(F.lit("a"), F.lit("b")).alias("actions"))
    return forecasts, staffing, insights


def file_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed sales of files: nations whose name has an odd length have one of their own, all others are in the default file."""
    name = F.concat("restaurant_id", F.lit("__sales.csv"))
    own = F.when(F.length("restaurant_id") % 2 == 1, name).otherwise(F.lit(DEFAULT_SALES_FILE))
    lines = order_lines(spark, sf_dir).select(own.alias("file_name"), "date", "amount")
    return lines.groupBy("file_name", "date").agg(F.sum("amount").cast(MONEY).alias("daily_sales_total"))
