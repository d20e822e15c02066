"""What the operators share: table reading, scratch tables, Arrow helpers and column hygiene."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    A local[...] session without the setting gets a temporary folder of its own; a cluster without it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lineloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, deleted as the driver's JVM ends."""
    path = f"{shared_dir(spark)}/lineloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more, before the driver's JVM ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage; deleted as the driver's JVM ends."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without columns of these names (compared as Spark does, without case): an operator's own columns win."""
    gone = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in gone])


def appended(df: DataFrame, added: str) -> T.StructType:
    """The schema of df with the columns of the DDL string after it."""
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(added).fields])


def with_columns(batch: pa.RecordBatch, arrays: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays.values()], names=[*batch.schema.names, *arrays])


def text_key(column: str = "text") -> F.Column:
    """A 64-bit key of a text; null texts share one."""
    return F.xxhash64(F.col(column))
