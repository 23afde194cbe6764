"""Keeping the lead book current: a log of mergeable runs under a versioned manifest.

A batch is merged on its own to states, one per (phone, name key), and stored as one run
per upload; nothing stored before is read.  When a level holds RUNS_PER_LEVEL runs, these
are merged to one run of the next level, so a row is rewritten once a level and the
number of runs stays logarithmic.  States merge in any order, so the book is what all
live runs merge to.

The manifest is a small file that names the live runs and the batches they hold.  Every
change writes its runs first and then one new version of the manifest; until that is
whole the change has not happened, and after it nothing is left to do but clearing up.
A merged run keeps the runs it came from, so an upload is forgotten by one commit: the runs
that hold it are replaced by their parts, without its own.
One writer at a time, as a stream's batches are.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadbook import schema as S
from leadbook.operators.identity import NAME_KEY, PHONE_STATUS, leads_of, merge_groups, merge_states, reachable, standardise
from leadbook.runtime import discard, stage
from leadbook.sources.files import delete_path, names_in, read_json, write_json

RUNS_PER_LEVEL = 8
# Older versions of the manifest that clearing up leaves.
KEPT_VERSIONS = 3
_KEYS = [S.PHONE_NORM, NAME_KEY]
_UPLOAD = "run_upload"
_NO_UPLOAD = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Manifest:
    """A state of the book: the live runs as (run, level), and the batches taken in as spans."""

    version: int = 0
    runs: tuple[tuple[str, int], ...] = ()
    applied: tuple[tuple[int, int], ...] = ()

    def holds(self, batch_id: int) -> bool:
        return any(first <= batch_id <= last for first, last in self.applied)

    def with_batch(self, batch_id: int) -> Manifest:
        spans: list[tuple[int, int]] = []
        for first, last in sorted([*self.applied, (batch_id, batch_id)]):
            if spans and first <= spans[-1][1] + 1:
                spans[-1] = (spans[-1][0], max(last, spans[-1][1]))
            else:
                spans.append((first, last))
        return replace(self, applied=tuple(spans))


def read_manifest(spark: SparkSession, root: str) -> Manifest:
    """The newest whole version; a book that does not exist yet is empty."""
    for name in reversed(names_in(spark, f"{root}/manifest")):
        held = read_json(spark, f"{root}/manifest/{name}")
        if held is not None:
            return Manifest(int(name.split(".")[0]), tuple(map(tuple, held["runs"])), tuple(map(tuple, held["applied"])))
    return Manifest()


def _commit(spark: SparkSession, root: str, manifest: Manifest) -> Manifest:
    after = replace(manifest, version=manifest.version + 1)
    write_json(spark, f"{root}/manifest/{after.version:012d}.json", {"runs": after.runs, "applied": after.applied})
    return after


def _run_path(root: str, run: str) -> str:
    return f"{root}/runs/{run}"


def _describe(spark: SparkSession, root: str, run: str, uploads: list[str], parts: list[tuple[str, int]]) -> None:
    write_json(spark, f"{root}/parts/{run}.json", {"uploads": uploads, "parts": parts})


def _described(spark: SparkSession, root: str, run: str) -> dict:
    return read_json(spark, f"{root}/parts/{run}.json")


def _states(spark: SparkSession, root: str, runs: list[str]) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(*[_run_path(root, r) for r in runs])


def upsert_leads(rows: DataFrame, batch_id: int, root: str) -> None:
    """Add a batch of lead rows to the book at `root`; a batch that it holds already changes nothing.

    Rows are numbered over all batches (row_ord), as the merge order needs.  A batch without
    a reachable row adds no run.
    """
    spark = rows.sparkSession
    before = read_manifest(spark, root)
    if before.holds(batch_id):
        return
    # Rows with maps are merged in two passes, so they are worked out once, unless they carry their keys and come from a store.
    held = reachable(standardise(rows))
    twice = not {S.EXTRAS, S.NOTE_FIELDS}.isdisjoint(rows.columns)
    held = stage(held, "batch_rows") if twice and PHONE_STATUS not in rows.columns else held
    if S.UPLOAD_ID in held.columns:
        states = merge_groups(held.withColumn(_UPLOAD, F.col(S.UPLOAD_ID)), [_UPLOAD, *_KEYS])
    else:
        states = merge_groups(held, _KEYS).withColumn(_UPLOAD, F.lit(None).cast("string"))
    folder = f"batch-{batch_id:012d}"
    states.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(_UPLOAD).parquet(_run_path(root, folder))
    discard(held)
    runs = []
    for name in names_in(spark, _run_path(root, folder)):  # one per upload of the batch
        if name.startswith(f"{_UPLOAD}="):
            run, upload = f"{folder}/{name}", unquote(name.partition("=")[2])
            _describe(spark, root, run, [] if upload == _NO_UPLOAD else [upload], [])
            runs.append((run, 0))
    after = _commit(spark, root, replace(before.with_batch(batch_id), runs=(*before.runs, *runs)))
    compact(spark, root, after)


def compact(spark: SparkSession, root: str, manifest: Manifest | None = None) -> Manifest:
    """Merge runs of a level to one of the next while a level holds RUNS_PER_LEVEL of them."""
    manifest = manifest or read_manifest(spark, root)
    while True:
        levels: dict[int, list[str]] = {}
        for run, level in manifest.runs:
            levels.setdefault(level, []).append(run)
        full = [level for level, runs in sorted(levels.items()) if len(runs) >= RUNS_PER_LEVEL]
        if not full:
            return manifest
        level, parts = full[0], levels[full[0]][:RUNS_PER_LEVEL]
        run = f"level-{level + 1}-{uuid.uuid4().hex}"
        merge_states(_states(spark, root, parts), _KEYS).write.parquet(_run_path(root, run))
        uploads = sorted({u for p in parts for u in _described(spark, root, p)["uploads"]})
        _describe(spark, root, run, uploads, [(p, level) for p in parts])
        kept = tuple(r for r in manifest.runs if r[0] not in parts)
        manifest = _commit(spark, root, replace(manifest, runs=(*kept, (run, level + 1))))


def forget_upload(spark: SparkSession, upload_id: str, root: str) -> None:
    """Take an upload out of the book, and its rows off the storage.

    One commit replaces the runs that hold it by their parts, down to the upload's own,
    which goes; leads without other rows go with it.  An upload that the book does not
    hold changes nothing.  What is left to delete after a crash, the next call deletes.
    """
    manifest = read_manifest(spark, root)
    open_runs, kept = list(manifest.runs), []
    while open_runs:
        run, level = open_runs.pop()
        about = _described(spark, root, run)
        if upload_id not in about["uploads"]:
            kept.append((run, level))
        open_runs += [tuple(p) for p in about["parts"]] if upload_id in about["uploads"] else []
    if set(kept) != set(manifest.runs):
        manifest = _commit(spark, root, replace(manifest, runs=tuple(sorted(kept))))
    clear_up(spark, root, manifest)


def clear_up(spark: SparkSession, root: str, manifest: Manifest | None = None) -> None:
    """Delete runs that the manifest does not reach, and its older versions.

    Nobody should be reading an older version of the book meanwhile.
    """
    manifest = manifest or read_manifest(spark, root)
    reached, open_runs = set(), [run for run, _ in manifest.runs]
    while open_runs:
        run = open_runs.pop()
        reached.add(run)
        open_runs += [part for part, _ in _described(spark, root, run)["parts"]]
    for name in names_in(spark, f"{root}/runs"):
        inside = [f"{name}/{x}" for x in names_in(spark, _run_path(root, name)) if x.startswith(f"{_UPLOAD}=")]
        for run in inside or [name]:
            if run not in reached:
                delete_path(spark, _run_path(root, run))
                delete_path(spark, f"{root}/parts/{run}.json")
    for name in names_in(spark, f"{root}/manifest")[: -KEPT_VERSIONS]:
        delete_path(spark, f"{root}/manifest/{name}")


def book_states(spark: SparkSession, root: str) -> DataFrame | None:
    """The merged states of the whole book, staged; None while it has no run.  One run alone holds each key once."""
    runs = [run for run, _ in read_manifest(spark, root).runs]
    if not runs:
        return None
    states = _states(spark, root, runs)
    return stage(states if len(runs) == 1 else merge_states(states, _KEYS), "book_states")


def read_book(spark: SparkSession, root: str) -> DataFrame | None:
    """The leads of the book; None while it has no run."""
    states = book_states(spark, root)
    return None if states is None else leads_of(states)


def upsert_stream(rows: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Apply `upsert_leads` to every micro-batch of a stream of lead rows."""
    return (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, number: upsert_leads(batch, number, root))
        .start()
    )
