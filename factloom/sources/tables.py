"""Sources and sinks: Parquet tables, strict JSON lines, CSV with BOM, text ids, nested JSON, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines with an explicit schema: strict fails on a row that is no such object, else malformed rows go."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; a byte-order mark before the first name is dropped."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    rows = (reader.schema(schema) if schema else reader).csv(path)
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def read_documents_json(spark: SparkSession, folder: str, schema: T.StructType | str, pattern: str = "*.json") -> DataFrame:
    """One nested JSON document per file, anywhere below a folder; the file's path is kept."""
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.json(folder).withColumn("source_path", F.col("_metadata.file_path"))


def read_ids(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Distinct ids, first match of ``pattern`` in each line of a text file."""
    found = spark.read.text(path).select(F.regexp_extract("value", pattern, 0).alias("id"))
    return found.filter("id <> ''").distinct()


def unpivot_matrix(rows: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """A wide matrix as one row per key and category, from the columns that begin with ``prefix``."""
    wide = [c for c in rows.columns if c.startswith(prefix)]
    long = rows.unpivot(keys, wide, "category", "score")
    return long.withColumn("category", F.substring("category", len(prefix) + 1, 1000)).withColumn("score", F.coalesce(F.expr("try_cast(score AS INT)"), F.lit(0)))


def require_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``, failing while they are read if two share a key."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return rows.withColumn("__n", n).filter(F.assert_true(F.col("__n") == 1, F.lit(f"duplicate key {keys}")).isNull()).drop("__n")


def upsert_missing(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key the store lacks, once each: what an append has to write."""
    return new.dropDuplicates([key]).join(store.select(key), key, "left_anti")


def delete_keys(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return store.join(keys.select(key), key, "left_anti")
