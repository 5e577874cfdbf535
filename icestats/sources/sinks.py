"""Table and file sinks, incremental appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def overwrite_table(df: DataFrame, table: str, path: str | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Replace a table with its schema."""
    w = df.write.mode("overwrite").option("overwriteSchema", "true").format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    (w.option("path", path) if path else w).saveAsTable(table)
    return df.sparkSession.table(table)


def create_and_insert(spark: SparkSession, table: str, columns: dict[str, tuple[str, str]], rows: DataFrame, path: str | None = None) -> DataFrame:
    """Create a table with typed, commented columns and insert by position."""
    cols = ", ".join(f"{n} {t} COMMENT '{c}'" for n, (t, c) in columns.items())
    spark.sql(f"CREATE TABLE {table} ({cols}) USING parquet" + (f" LOCATION '{path}'" if path else ""))
    rows.select(*columns).write.insertInto(table)
    return spark.table(table)


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Parquet files; partition by season so that later filters read only their folders."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return path


def new_rows(incoming: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet."""
    return incoming.join(stored.select(*key).distinct(), list(key), "left_anti")


def append_new(incoming: DataFrame, path: str, key: Sequence[str]) -> DataFrame:
    """Append rows with unknown keys to a parquet folder and return the whole."""
    spark = incoming.sparkSession
    new_rows(incoming, spark.read.parquet(path), key).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def date_profile(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count(F.lit(1)).alias("n"))
