"""The upload ledger: one short record per upload, so that listing and numbering read no lead row.

A record says which row numbers an upload took, which files it came from, and what merging
it on its own drops and keeps.  It is written after the upload's rows and removed before
them, so an upload without a record does not count yet, or no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadbook import schema as S
from leadbook.operators.identity import dedupe_stats
from leadbook.sources.files import delete_path, names_in, read_json, write_json

READY, EMPTY = "ready", "empty"
STATISTICS = (
    "input_rows", "invalid_phone_dropped", "missing_phone_dropped", "duplicate_rows_merged", "unique_leads", "cross_file_leads",
)
RECORD = f"{S.UPLOAD_ID} string, created_at string, status string, files string, first_row long, next_row long, " + ", ".join(
    f"{c} long" for c in STATISTICS
)


def _folder(root: str) -> str:
    return f"{root}/_ledger"


def _location(root: str, upload_id: str) -> str:
    return f"{_folder(root)}/{upload_id}.json"


def record_upload(spark: SparkSession, root: str, rows: DataFrame, upload_id: str, created_at: str) -> dict:
    """Count an upload's stored rows, and nothing else, and enter it."""
    source = F.col(S.SOURCE_FILE) if S.SOURCE_FILE in rows.columns else F.lit(None).cast("string")
    order = F.col(S.ROW_ORD) if S.ROW_ORD in rows.columns else F.lit(None).cast("long")
    span = rows.agg(F.min(order).alias("first"), F.max(order).alias("last"), F.array_join(F.array_sort(F.collect_set(source)), ", ").alias("files")).first()
    counts = dedupe_stats(rows).first()
    record = {S.UPLOAD_ID: upload_id, "created_at": created_at, "status": READY, "files": span["files"]}
    record |= {"first_row": span["first"] or 0, "next_row": 0 if span["last"] is None else span["last"] + 1}
    record |= {c: counts[c] for c in STATISTICS}
    write_json(spark, _location(root, upload_id), record)
    return record


def record_empty(spark: SparkSession, root: str, upload_id: str, created_at: str, next_row: int) -> None:
    """Enter a batch that stored nothing, so that the one after it finds its first row number."""
    record = {S.UPLOAD_ID: upload_id, "created_at": created_at, "status": EMPTY, "first_row": next_row, "next_row": next_row}
    write_json(spark, _location(root, upload_id), record)


def upload_record(spark: SparkSession, root: str, upload_id: str) -> dict | None:
    return read_json(spark, _location(root, upload_id))


def strike_upload(spark: SparkSession, root: str, upload_id: str) -> bool:
    """Take an upload out of the ledger but for the row numbers it took, which stay taken."""
    held = upload_record(spark, root, upload_id)
    if held is None or held["status"] == EMPTY:
        return False
    record_empty(spark, root, upload_id, held["created_at"], held["next_row"])
    return True


def drop_record(spark: SparkSession, root: str, upload_id: str) -> None:
    delete_path(spark, _location(root, upload_id))


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """All records; none where nothing was entered."""
    if not names_in(spark, _folder(root)):
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).json(_folder(root))


def listed_uploads(spark: SparkSession, root: str) -> DataFrame:
    """(upload_id, created_at, files, row_count, status) of the ready uploads; row_count counts their leads."""
    ready = read_ledger(spark, root).where(F.col("status") == READY)
    return ready.select(S.UPLOAD_ID, "created_at", "files", F.col("unique_leads").alias("row_count"), "status")


def first_free_row(spark: SparkSession, root: str, upload_id: str) -> int:
    """The first row number that no upload sorting before `upload_id` took."""
    earlier = read_ledger(spark, root).where(F.col(S.UPLOAD_ID) < upload_id)
    return earlier.agg(F.coalesce(F.max("next_row"), F.lit(0))).first()[0]
