"""JSON, JSON lines, CSV, ledgers and caches; sinks for JSON, CSV and markdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = "version int, months map<string, struct<invocations: int, total_usd: double, last_invocation_iso: string, iterations: array<struct<iso: string, cost_usd: double, phase: string, transport: string, source: string, issueId: string, prNumber: int, fingerprint: string, errorClass: string, outcome: string>>>>"


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Whole JSON documents, one a file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A record a line; blank lines are skipped, a bad line is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_csv_strict(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV file whose header has to be the schema's names in order; fields are not quoted."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, quote="", mode="FAILFAST", nullValue="")


def read_ledger(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A ledger's entries, one a row, with their month and place; a bad file is empty, or an error if strict."""
    kind = T.StructType.fromDDL(LEDGER).add("_corrupt_record", "string") if not strict else T.StructType.fromDDL(LEDGER)
    books = spark.read.schema(kind).json(path, multiLine=True, mode="FAILFAST" if strict else "PERMISSIVE")
    months = books.select(F.explode("months").alias("month", "m"))
    return months.select("month", F.posexplode("m.iterations").alias("place", "e")).select("month", "place", "e.*")


def read_latest(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of the file whose date-stamped name comes last."""
    rows = spark.read.schema(schema).csv(path, header=True).withColumn("__f", F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})\.csv$", 1))
    newest = rows.agg(F.max("__f").alias("__f"))
    return rows.join(F.broadcast(newest), "__f").drop("__f")  # one row


def text_items(raw: DataFrame) -> DataFrame:
    """raw (doc_id, pages: array of page structs with items) -> one row an item that is not blank, with its order."""
    pages = raw.select("doc_id", F.explode("pages").alias("p"))
    items = pages.select("doc_id", F.col("p.pageNum").alias("page"), F.col("p.pageWidth").alias("page_width"), F.col("p.pageHeight").alias("page_height"), F.posexplode("p.items").alias("seq", "i"))
    return items.select("doc_id", "page", "seq", "i.text", "i.x", "i.y", "i.width", "i.height", "page_width", "page_height").where(F.trim("text") != "")


def cache_get(cache: DataFrame, version: str, key: Column) -> DataFrame:
    """A point lookup; with the cache partitioned by version only that folder is read."""
    return cache.where((F.col("version") == version) & key)


def cache_put_if_absent(cache: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows to append: those whose key is not there yet, one a key; status tells 200 (there already) from 201."""
    first = rows.dropDuplicates(list(keys))
    there = cache.select(*keys).distinct().withColumn("__t", F.lit(True))
    return first.join(there, list(keys), "left").withColumn("status", F.when(F.col("__t"), 200).otherwise(201)).drop("__t")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, nulls as empty fields."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def markdown_rows(df: DataFrame) -> DataFrame:
    """A table's lines as `line`: header, rule and a line a row, for tables small enough to print."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    head = df.sparkSession.range(1).select(F.explode(F.array(F.lit("| " + " | ".join(df.columns) + " |"), F.lit("|" + " --- |" * len(df.columns)))).alias("line"))
    return head.unionAll(df.select(cells.alias("line")))


def pick_listed(listing: DataFrame, key: str, item: str, code: Column, named: Column) -> DataFrame:
    """key, item: of each key's listed items the one to fetch, the first with the wanted code, else the first whose
    description names it; keys without either are left out."""
    rows = listing.select(key, item, F.coalesce(code, F.lit(False)).alias("__c"), named.alias("__n")).where("__c OR __n")
    return rows.groupBy(key).agg(F.min_by(item, F.struct(~F.col("__c"), item)).alias(item))


def usable(size: Column, right_kind: Column, least: int) -> Column:
    """Whether a cached file may be used again: long enough and of the right kind."""
    return (size >= least) & right_kind
