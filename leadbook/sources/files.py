"""Small files and folders on the shared storage, through Spark's own file systems."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _located(spark: SparkSession, location: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def path_exists(spark: SparkSession, location: str) -> bool:
    fs, path = _located(spark, location)
    return fs.exists(path)


def delete_path(spark: SparkSession, location: str) -> bool:
    fs, path = _located(spark, location)
    return fs.delete(path, True)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds, sorted; none where there is no such folder."""
    fs, path = _located(spark, folder)
    return sorted(status.getPath().getName() for status in fs.listStatus(path)) if fs.exists(path) else []


def write_json(spark: SparkSession, location: str, value: object) -> None:
    """Write a value as one line; `read_json` takes a file for whole only if its line ends."""
    fs, path = _located(spark, location)
    out = fs.create(path, True)
    out.write((json.dumps(value) + "\n").encode())
    out.close()


def read_json(spark: SparkSession, location: str) -> object | None:
    """The value of a file, or None where it is missing or was cut off while it was written."""
    fs, path = _located(spark, location)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return json.loads(text) if text.endswith("\n") else None
