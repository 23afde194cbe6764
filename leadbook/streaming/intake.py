"""Incremental intake: new export files become stored uploads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadbook import schema as S
from leadbook.operators.identity import with_phone_identity
from leadbook.plans.book import confirm, detected_choices, read_draft
from leadbook.sources.exports import NoHeaderError, decoded_path, literal_path
from leadbook.sources.lead_table import read_upload, write_upload
from leadbook.sources.ledger import first_free_row, record_empty, upload_record

MAX_FILES_PER_BATCH = 1_000
_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def take_in(
    spark: SparkSession, paths: list[str], root: str, upload_id: str, created_at: str, first_row: int = 0
) -> DataFrame | None:
    """Read files, accept what is detected in them, store them as one upload and read it back.

    Its rows are numbered from `first_row`, so that uploads keep their order when
    they are merged, and stored with their keys, which no later step works out again.  Files in which no sheet looks like leads are passed over: None.
    """
    try:
        draft = read_draft(spark, paths)
    except NoHeaderError:
        return None
    choices = detected_choices(draft.catalogue)
    if choices.filter("include").isEmpty():
        return None
    rows = confirm(draft, choices).withColumn(S.ROW_ORD, F.col(S.ROW_ORD) + first_row)
    write_upload(with_phone_identity(rows), root, upload_id, created_at)
    return read_upload(spark, root, upload_id)


def _batch_upload(number: int) -> str:
    return f"batch-{number:012d}"


def _first_row(spark: SparkSession, root: str, number: int) -> int:
    """Where a batch's row numbers begin: in the record of the batch before it, or, where that is missing, behind all earlier ones."""
    if number == 0:
        return 0
    before = upload_record(spark, root, _batch_upload(number - 1))
    return before["next_row"] if before else first_free_row(spark, root, _batch_upload(number))


def intake_stream(
    spark: SparkSession,
    folder: str,
    root: str,
    checkpoint: str,
    then: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Store every new file of `folder`; headers may differ from file to file.

    The stream itself carries file paths only; the contents are read by the batch
    reader, per header layout.  A batch holds at most MAX_FILES_PER_BATCH paths,
    and a replayed batch writes the same upload again.  Rows are numbered on from
    batch to batch: the ledger's record of a batch says where the next one begins, so no
    batch reads what others stored.  A batch without leads stores only a record.
    """
    files = (
        spark.readStream.format("binaryFile").schema(_FILE_SCHEMA)
        .option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", MAX_FILES_PER_BATCH)
        .load(folder).select(decoded_path(F.col("path")).alias("path"))
    )

    def store(batch: DataFrame, number: int) -> None:
        paths = sorted(r["path"] for r in batch.collect())
        if paths:
            session, upload, created = batch.sparkSession, _batch_upload(number), f"batch {number:012d}"
            first = _first_row(session, root, number)
            rows = take_in(session, [literal_path(p) for p in paths], root, upload, created, first)
            if rows is None:
                record_empty(session, root, upload, created, first)
            elif then:
                then(rows, number)

    return (
        files.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(store).start()
    )
