"""CSV and parquet sources and sinks with manifests and partition checks."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.parsing import whole_number
from tallyframe.session import checkpoint_folder


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder for a written table, inside the shared folder the session names."""
    return f"{checkpoint_folder(spark).rstrip('/')}/tallyframe-{label}-{uuid.uuid4().hex}"


def read_text_table(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """CSV with every column kept as text: an untrusted source is typed later, column by column.

    A folder or a glob reads all its shards as one table.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_typed_table(
    spark: SparkSession, path: str | Sequence[str], schema: str, columns: Sequence[str], null_token: str = ""
) -> DataFrame:
    """CSV with declared types, read for the requested columns only."""
    reader = spark.read.schema(schema).option("header", True).option("nullValue", null_token)
    return reader.csv(path).select(*columns)


def typed(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Non-strict typing of text columns; integers accept ``"125.0"``. Failures become null."""

    def cast(name: str, kind: str) -> Column:
        return whole_number(F.col(name)) if kind == "bigint" else F.col(name).try_cast(kind)

    return df.select(*[cast(n, k).alias(n) for n, k in kinds.items()])


def file_manifest(df: DataFrame) -> DataFrame:
    """Rows per file of a table read from files, with an order-free content sum."""
    return df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(
        F.count("*").alias("row_count"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("content_sum")
    )


def write_table(df: DataFrame, path: str, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write zstd parquet and return a one-row manifest: table, rows, columns, schema fingerprint."""
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    stored = df.sparkSession.read.parquet(path)
    return stored.agg(F.count("*").alias("row_count")).select(
        F.lit(name).alias("table_name"),
        "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.sha2(F.lit(df.schema.json()), 256).alias("schema_fingerprint"),
    )


def with_event_month(facts: DataFrame, dates: DataFrame, key: str, day: str) -> DataFrame:
    """Facts with the year and month of their resolved event date; null when it is unknown."""
    month = dates.select(key, F.year(day).alias("year"), F.month(day).alias("month"))
    return facts.join(month, key, "left")


def undated(facts_with_month: DataFrame) -> DataFrame:
    return facts_with_month.where("year is null or month is null")


def partition_faults(stored: DataFrame, dates: DataFrame, key: str, day: str) -> DataFrame:
    """Per stored partition: rows, rows with no known date, rows in the wrong year or month."""
    checked = stored.join(dates.select(key, F.col(day).alias("_day")), key, "left")
    wrong = (F.year("_day") != F.col("year")) | (F.month("_day") != F.col("month"))
    return checked.groupBy("year", "month").agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col("_day").isNull()).alias("orphan_count"),
        F.count_if(wrong).alias("misplaced_count"),
    )
