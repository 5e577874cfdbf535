"""File sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icestats.schemas import conform


def season_csv(spark: SparkSession, path: str, schema: str, *, name_pattern: str | None = None, ending_year: bool = False) -> DataFrame:
    """All CSV files below a path with a fixed schema and the season from the file name.

    `name_pattern` keeps files whose path matches; Spark drops the others before reading.
    `ending_year` labels the season by its second year.
    """
    df = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    file = F.col("_metadata.file_path")
    if name_pattern:
        df = df.filter(file.rlike(name_pattern))
    year = F.regexp_extract(file, r"(\d{4})_[A-Za-z_]+\.csv", 1).try_cast("int")
    return df.withColumn("file_season", year + int(ending_year))


def inferred_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with inferred types, for files of unknown shape; one extra pass over the data."""
    return spark.read.option("header", True).option("inferSchema", True).option("recursiveFileLookup", True).csv(path)


def union_tables(tables: Sequence[DataFrame], *, allow_missing: bool = False) -> DataFrame:
    """Tables under each other by column name; missing columns become null if allowed."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), tables)


def lower_and_tag(df: DataFrame, column: str, tag: str) -> DataFrame:
    """Lower-case column names and a literal origin column."""
    return df.toDF(*[c.lower() for c in df.columns]).withColumn(column, F.lit(tag))


def binary_documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Whole files as binary with name and size."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "modificationTime", "content")


def parquet_entity(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet table brought to an entity's schema."""
    return conform(spark.read.parquet(path), schema)
