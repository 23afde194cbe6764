"""Session-level helpers: staged tables and size-checked lookups."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup table is broadcast only when its measured size stays inside both bounds.
BROADCAST_ROWS = 10_000
BROADCAST_ROW_BYTES = 4_096
LOOKUP_SALTS = 32


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for staged tables: `spark.checkpoint.dir` of the session.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would vanish with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="leadbook-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _session_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/leadbook/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_session_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear_staged(spark: SparkSession) -> bool:
    """Delete everything this session has staged; nothing staged may be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_session_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str, partition_by: tuple[str, ...] = (), rows_per_file: int = 0) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    This cuts lineage, survives lost executors, and lets later sections of a
    report read only the columns they use.  `rows_per_file` bounds the rows of a
    file, so that a table from few splits is read again in more.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, once per session, so that their Python workers can import it.

    The archive goes through the shared folder, as staged tables do.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root, held = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    location = f"{scratch_path(spark, 'code')}/{root.name}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(held.getvalue())
    out.close()
    spark.sparkContext.addPyFile(location)
    _SHIPPED.add(application)


def discard(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing will read again; other frames are passed over."""
    for table in tables:
        location = getattr(table, "_staged_path", None)
        if location:
            jvm = table.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(location)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_copy(table: DataFrame) -> DataFrame | None:
    """`table` as a local relation if it is proven small, else None.

    At most BROADCAST_ROWS + 1 rows reach the driver, and a text too long for
    the byte bound is left behind on the executors, so the probe is bounded too.
    """
    kinds = {f.name: f.dataType.typeName() for f in table.schema.fields}
    texts = [c for c, kind in kinds.items() if kind == "string"]
    nested = [c for c, kind in kinds.items() if kind in ("map", "array", "struct")]
    lengths = [F.octet_length(c) for c in texts] + [F.octet_length(F.to_json(F.struct(c))) for c in nested]
    fits = sum((F.coalesce(n, F.lit(0)) for n in lengths), F.lit(0)) <= BROADCAST_ROW_BYTES
    kept = [F.when(fits, F.col(c)).alias(c) if c in texts or c in nested else F.col(c) for c in table.columns]
    probe = table.select(*kept, fits.alias("__fits")).limit(BROADCAST_ROWS + 1).collect()
    if len(probe) > BROADCAST_ROWS or not all(r["__fits"] for r in probe):
        return None
    return table.sparkSession.createDataFrame([tuple(r)[:-1] for r in probe], table.schema)


def lookup_join(rows: DataFrame, table: DataFrame, on: list[str], salt_by: str) -> DataFrame:
    """Left join `rows` to a lookup with at most one row per key.

    A lookup derived from a large scan should be staged first, because its size is
    checked before it is used.  One proven small is broadcast.  A larger one is shuffled, with the rows
    salted and the lookup repeated once per salt, so that one key (or the null
    key) holding a third of the rows is spread over LOOKUP_SALTS tasks.
    """
    local = small_copy(table)
    if local is not None:
        return rows.join(F.broadcast(local), on, "left")
    return salted_left_join(rows, table, on, salt_by)


def salted_left_join(rows: DataFrame, table: DataFrame, on: list[str], salt_by: str) -> DataFrame:
    salt = F.pmod(F.xxhash64(F.col(salt_by)), F.lit(LOOKUP_SALTS)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.lit(LOOKUP_SALTS - 1)))
    left = rows.withColumn("__salt", salt)
    right = table.withColumn("__salt", salts)
    return left.join(right, [*on, "__salt"], "left").drop("__salt")
