"""Token-id files: a concatenated id array per shard with Elias-Fano document boundaries.

Documents are range-partitioned and sorted by doc_id; each task tokenizes and
writes one shard.  A shard is

    ids | boundaries | document ids | footer | footer length (8 bytes) | magic

where `ids` is an array of little-endian unsigned 16- or 32-bit integers,
`boundaries` the Elias-Fano code of the n_docs + 1 offsets into it, and `document
ids` that of the sorted doc_ids.  A task writes under a name of its own and only
a finished task's name reaches the manifest, which Spark commits as Parquet, so a
lost or repeated task leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadbook.llm.elias_fano import EliasFano
from leadbook.llm.tokenizing import encoder
from leadbook.runtime import scratch_path, stage

MAGIC = b"LBTOKEN1"
MANIFEST = "shard int, path string, n_docs long, n_tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"
# Tokens that a reader holds at a time.
READ_TOKENS = 4_000_000


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Tokenize `docs` (doc_id, text) into shards in ascending doc_id order; returns the manifest.

    A null or empty text is a document of the end id alone.  Rows that repeat a
    doc_id are documents of their own, ordered by text; null doc_ids come first.
    An empty table gives an empty manifest.  Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        row = _write_shard(batches, f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tokens", tokenizer, end_id)
        if row is not None:
            yield pa.RecordBatch.from_pylist([{"shard": shard, **row}], schema=_MANIFEST_ARROW)

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return stage(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32.

    `start` counts the ids of all documents before it.  The manifest has one short
    row per shard; only those rows reach the driver.
    """
    spark = manifest.sparkSession
    shards, start = [], 0
    for row in sorted(manifest.collect(), key=lambda r: r["shard"]):
        shards.append((row["path"], start))
        start += row["n_tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                yield from _read_shard(shard["path"], shard["start"])

    files = spark.createDataFrame(shards, "path string, start long")
    return files.repartition(max(1, len(shards))).mapInArrow(read, ROWS)


_MANIFEST_ARROW = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
_ROWS_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])


def _write_shard(batches: Iterator[pa.RecordBatch], path: str, tokenizer: str, end_id: int) -> dict | None:
    encode = encoder(tokenizer)
    kind = np.dtype("<u2" if max(encode.vocabulary - 1, end_id) < 2**16 else "<u4")
    sink, where, counts, doc_ids, nulls = None, None, [], [], 0
    for batch in batches:
        if sink is None and batch.num_rows:
            store, where = fs.FileSystem.from_uri(path)
            store.create_dir(where.rpartition("/")[0], recursive=True)
            sink = store.open_output_stream(where)
        names = batch.column(0).to_pylist()
        nulls += names.count(None)
        doc_ids += [i for i in names if i is not None]
        for ids, bounds in encode.encode_many((t.as_py() for t in batch.column(1)), end_id):
            counts += np.diff(bounds).tolist()
            sink.write(ids.astype(kind).tobytes())
    if sink is None:
        return None
    bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.uint64)]).astype(np.uint64)
    ids_sorted = np.array(doc_ids, np.int64)
    first = int(ids_sorted[0]) if doc_ids else 0
    parts = [EliasFano.of(bounds).to_bytes(), EliasFano.of((ids_sorted - first).astype(np.uint64)).to_bytes()]
    footer = json.dumps({
        "kind": kind.str, "n_docs": len(counts), "n_tokens": int(bounds[-1]), "null_ids": nulls,
        "first_id": first, "sections": [int(bounds[-1]) * kind.itemsize, *map(len, parts)],
    }).encode()
    sink.write(b"".join(parts) + footer + len(footer).to_bytes(8, "little") + MAGIC)
    sink.close()
    return {"path": path, "n_docs": len(counts), "n_tokens": int(bounds[-1])}


class TokenFile:
    """Random access to one shard: offsets come from select, ids from a ranged read."""

    def __init__(self, path: str):
        store, where = fs.FileSystem.from_uri(path)
        self.source = store.open_input_file(where)
        size = self.source.size()
        tail = self.source.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is not a complete token file")
        length = int.from_bytes(tail[:8], "little")
        self.footer = json.loads(self.source.read_at(length, size - 16 - length))
        self.kind = np.dtype(self.footer["kind"])
        ids, bounds, docs = self.footer["sections"]
        self.bounds = EliasFano.from_bytes(self.source.read_at(bounds, ids))
        self.doc_ids = EliasFano.from_bytes(self.source.read_at(docs, ids + bounds))

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids of documents first..last-1 of the shard, as unsigned 32-bit integers."""
        a, b = self.bounds.value(first), self.bounds.value(last)
        raw = self.source.read_at((b - a) * self.kind.itemsize, a * self.kind.itemsize)
        return np.frombuffer(raw, self.kind).astype("<u4")

    def documents(self) -> list[int | None]:
        known = self.doc_ids.values().astype(np.int64) + self.footer["first_id"]
        return [None] * self.footer["null_ids"] + known.tolist()


def _read_shard(path: str, start: int) -> Iterator[pa.RecordBatch]:
    shard = TokenFile(path)
    bounds, names, first = shard.bounds.values().astype(np.int64), shard.documents(), 0
    while first < len(names):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + READ_TOKENS, "right")) - 1)
        raw, at = memoryview(shard.ids(first, last)).cast("B"), bounds[first]
        crcs = [zlib.crc32(raw[4 * (bounds[i] - at) : 4 * (bounds[i + 1] - at)]) for i in range(first, last)]
        columns = [names[first:last], (bounds[first:last] + start).tolist(), np.diff(bounds[first : last + 1]).tolist(), crcs]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ROWS_ARROW)
        first = last
