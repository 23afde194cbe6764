"""A corpus pipeline of the operators: language ID, line dedup, n-gram Jaccard join, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet
and read again as the next one's docs.  All but the last return the columns of
`documents`, whatever further columns the table has.  Rows keep their nulls; an empty
table passes through every stage as one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadbook.llm.jaccard import similarity_groups
from leadbook.llm.language import UNKNOWN, crc_of_id, training_texts, with_language
from leadbook.llm.lines import dedup_lines
from leadbook.llm.packing import pack_documents
from leadbook.runtime import ship_code, stage


def _row(docs: DataFrame) -> Column:
    """The row as it is, whatever its columns are called."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def _numbered(docs: DataFrame) -> DataFrame:
    """uid, doc_id, text, and the row as it is."""
    return docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text", _row(docs).alias("row"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter, or without text, go.

    It learns from the labelled documents whose crc32(doc_id as text) mod 4 is not 2.  Where no
    document is labelled, every text with a letter stays.
    """
    texts = training_texts(docs.select("doc_id", "text", "lang").where(crc_of_id(F.col("doc_id")) % 4 != 2))
    if not texts:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = with_language(docs.select(_row(docs).alias("row"), "text"), texts)
    return judged.where(F.col("lang_pred") != UNKNOWN).select("row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of lines that an earlier document has; a document that loses all its text goes."""
    cut = dedup_lines(_numbered(docs))
    changed = F.col("n_deleted") > 0
    left = cut.where(~changed | (F.trim("text") != ""))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return left.select(*(F.when(changed, new[c]).otherwise(F.col("row")[c]).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group linked by five-word shingles of similarity 0.8 or more."""
    rows = _numbered(docs)
    groups = similarity_groups(rows.select("uid", "doc_id", "text"), words=5, num=8, den=10)
    return rows.join(groups.where("uid = lead_uid").select("uid"), "uid", "left_semi").select("row.*")


# An executor's memory is full of what earlier stages left when packing starts, so its workers remember few segments.
PACKING_MEMO = 50_000


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 2048."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, memo_entries=PACKING_MEMO)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


# Arrow batches are bounded by rows and by bytes; the usual 64 MB of text are in a task several times over.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def _stage(step: Stage) -> Stage:
    """A stage whose executors have the package, and whose Python workers get small batches."""

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_code(spark)
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
        return step(spark, docs, sf_dir)

    return run_step


STAGES: list[tuple[str, Stage]] = [
    ("language ID", _stage(known_language)),
    ("line dedup", _stage(without_repeated_lines)),
    ("n-gram Jaccard join", _stage(one_of_each_group)),
    ("best-fit packing", _stage(packed)),
]

# No SQL for these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
