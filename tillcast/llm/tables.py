"""Reading the given tables and staging intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a session within one process may go without: it has a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        path = _local_dirs.setdefault(spark.sparkContext.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='tillcast-')}"
        _local_dirs[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    With ``by`` there is a folder for each value of that column, so that a filter on it reads its rows only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tillcast/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the identity of each row, which stays the same however often ``df`` is read.

    A row of plain Parquet files is named by file and place, which do not depend on how files are split. Any
    other table is written once, with its numbers. ``file`` and ``place`` tell rows apart; ``name`` and ``place`` stay as they are
    when the files are copied to another folder.
    """
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    if plan.nodeName() == "LogicalRelation" and "_metadata" not in df.columns:
        try:
            return df.withColumn(name, F.struct(
                F.xxhash64("_metadata.file_name").alias("name"), F.col("_metadata.row_index").alias("place"), F.xxhash64("_metadata.file_path").alias("file")))
        except AnalysisException:  # files without row numbers
            pass
    none = F.lit(0).cast("long")
    return staged(df.withColumn(name, F.struct(none.alias("name"), F.monotonically_increasing_id().alias("place"), none.alias("file"))), "numbered")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the decimal text of an id (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column) -> Column:
    """True for the rows no model may learn from; a row without an id is held out."""
    return F.coalesce(crc_of_id(doc_id) % 3 == 1, F.lit(True))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns called ``names`` in any case, so that they can be added."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so in any case: for a column of the operator's own."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
