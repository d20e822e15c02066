"""Writes that readers see whole or not at all: one file, or several tables at once.

A file is written beside its place and renamed over it. Tables are written as a new version below a root; a manifest, one
such file, names the version of each that counts. A write that fails leaves the manifest, and so all tables, as they were.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "manifest.json"


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace_file(spark: SparkSession, new: str, path: str) -> None:
    """Rename one file over another; readers see the one or the other."""
    jvm = spark.sparkContext._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if "://" in path or path.startswith("file:") else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(_path(spark, new), _path(spark, path), options)


def write_json(df: DataFrame, path: str) -> None:
    """df as one file of JSON lines at `path`, which holds the old or the new rows at any time. For a state that one reader
    takes whole; large tables go to `commit`."""
    spark = df.sparkSession
    beside = f"{path}.tmp-{uuid.uuid4().hex}"
    try:
        df.coalesce(1).write.json(beside)
        parts = _files(spark, beside).globStatus(_path(spark, f"{beside}/part-*"))
        if not len(parts):  # no rows, no partitions
            _files(spark, beside).create(_path(spark, f"{beside}/part-none")).close()
            parts = _files(spark, beside).globStatus(_path(spark, f"{beside}/part-*"))
        replace_file(spark, parts[0].getPath().toString(), path)
    finally:
        _files(spark, beside).delete(_path(spark, beside), True)


def _read(spark: SparkSession, path: str) -> str:
    stream = _files(spark, path).open(_path(spark, path))
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def manifest(spark: SparkSession, root: str) -> dict[str, str]:
    """The path of the version of each table that counts, by name; empty before the first commit."""
    at = f"{root}/{MANIFEST}"
    return json.loads(_read(spark, at)) if _files(spark, at).exists(_path(spark, at)) else {}


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(manifest(spark, root)[name])


def commit(spark: SparkSession, root: str, tables: Mapping[str, DataFrame]) -> None:
    """Write these tables and make them count, all at once; tables not named stay. If a write fails, what was written of the
    new version is deleted and nothing has changed. Old versions stay for readers that have them open. One writer a root."""
    version = f"{root}/versions/{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            df.write.parquet(f"{version}/{name}")
        counts = {**manifest(spark, root), **{name: f"{version}/{name}" for name in tables}}
        beside = f"{root}/{MANIFEST}.tmp-{uuid.uuid4().hex}"
        out = _files(spark, beside).create(_path(spark, beside))
        out.write(json.dumps(counts).encode())
        out.close()
        replace_file(spark, beside, f"{root}/{MANIFEST}")
    except BaseException:
        _files(spark, version).delete(_path(spark, version), True)
        raise
