"""Lead tables on shared storage: uploads in, uploads out, exports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadbook import schema as S
from leadbook.operators.identity import PHONE_STATUS, filled_identity, merge_leads
from leadbook.sources.exports import harmonise
from leadbook.sources.files import delete_path
from leadbook.sources.ledger import record_upload, strike_upload


def write_upload(rows: DataFrame, root: str, upload_id: str, created_at: str) -> None:
    """Store one upload as its own partition and enter it in the ledger; writing it again replaces it."""
    tagged = harmonise(rows.drop(S.UPLOAD_ID)).withColumn("created_at", F.lit(created_at))
    path = f"{root}/{S.UPLOAD_ID}={upload_id}"
    tagged.write.mode("overwrite").parquet(path)
    if "phone" in tagged.columns:
        record_upload(rows.sparkSession, root, rows.sparkSession.read.schema(tagged.schema).parquet(path), upload_id, created_at)


def read_uploads(spark: SparkSession, root: str) -> DataFrame:
    """All stored uploads; a filter on upload_id reads only those partitions.

    Where some uploads hold the keys of their rows, rows of the others get them.
    """
    stored = spark.read.option("basePath", root).option("mergeSchema", True).parquet(root)
    stored = stored.withColumn(S.UPLOAD_ID, F.col(S.UPLOAD_ID).cast("string"))
    return filled_identity(stored) if PHONE_STATUS in stored.columns else stored


def read_upload(spark: SparkSession, root: str, upload_id: str) -> DataFrame:
    """The rows of one upload; no other upload's files are looked at."""
    stored = spark.read.parquet(f"{root}/{S.UPLOAD_ID}={upload_id}")
    return stored.withColumn(S.UPLOAD_ID, F.lit(upload_id))


def remove_upload(spark: SparkSession, root: str, upload_id: str) -> bool:
    """Take one upload out of the ledger and delete its rows; called again, it deletes what a crash left."""
    struck = strike_upload(spark, root, upload_id)
    return delete_path(spark, f"{root}/{S.UPLOAD_ID}={upload_id}") or struck


def write_leads(leads: DataFrame, path: str) -> None:
    leads.write.mode("overwrite").parquet(path)


def read_leads(spark: SparkSession, path: str) -> DataFrame:
    """A stored lead frame; one stored before merging existed is merged on reading."""
    stored = spark.read.parquet(path)
    return stored if S.PHONE_NORM in stored.columns else merge_leads(stored)


def _flat(df: DataFrame) -> DataFrame:
    """Maps as JSON text, for formats without nested columns."""
    maps = [f.name for f in df.schema.fields if f.dataType.typeName() == "map"]
    return df.withColumns({c: F.to_json(c) for c in maps}) if maps else df


def write_export(rows: DataFrame, path: str, fmt: str = "csv", partition_by: tuple[str, ...] = ()) -> None:
    """Export rows as CSV or Parquet, optionally one folder per class."""
    writer = (_flat(rows) if fmt == "csv" else rows).write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)
