"""Corpus scans: report files by name, headers and statistics of documents, table fingerprints across versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A report's file name, and how many lines its header may take.
FILE_NAME = r"^([A-Z]\d{6})_(\d{4})(?:_(.*?))?(?:\.\w+)?$"
HEADER_LINES = 80


def parse_name(name: Column) -> Column:
    """struct<document_id, stock_code, report_year, rest, warning> of ``A######_YYYY_rest.md``."""
    fits = name.rlike(FILE_NAME)
    part = lambda k: F.when(fits, F.nullif(F.regexp_extract(name, FILE_NAME, k), F.lit("")))
    return F.struct(
        F.concat_ws("_", part(1), part(2)).alias("document_id"), F.substring(part(1), 2, 6).alias("stock_code"), part(2).cast("int").alias("report_year"), part(3).alias("rest"),
        F.when(~fits, "unexpected_file_name").alias("warning"),
    )


def header(text: Column) -> Column:
    """struct<first_line, title>: the first line that is not blank, and the first level-one heading of the first lines."""
    lines = F.slice(F.split(text, "\n"), 1, HEADER_LINES)
    filled = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    titles = F.filter(filled, lambda x: x.startswith("# "))
    return F.struct(F.get(filled, F.lit(0)).alias("first_line"), F.trim(F.substring(F.get(titles, F.lit(0)), 3, 10_000)).alias("title"))


def statistics(text: Column) -> Column:
    """struct<lines, tables, headings, images> of a Markdown document."""
    return F.struct(
        F.size(F.split(text, "\n")).cast("long").alias("lines"), F.regexp_count(F.lower(text), F.lit(r"<table\b")).cast("long").alias("tables"),
        F.regexp_count(text, F.lit(r"(?m)^#{1,6}\s")).cast("long").alias("headings"), F.regexp_count(text, F.lit(r"!\[[^\]]*\]\(")).cast("long").alias("images"),
    )


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """One row per Markdown file below a folder: name parts, hash, header and statistics."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))
    return rows.select("file_name", "path", "sha256", parse_name(F.col("file_name")).alias("n"), header(F.col("text")).alias("h"), statistics(F.col("text")).alias("s")).select("file_name", "path", "sha256", "n.*", "h.*", "s.*")


def fingerprint_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Per document: fingerprints kept, added and lost, as multisets."""
    a, b = old.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), new.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    both = a.join(b, keys, "full_outer").withColumns({"n": F.coalesce("n", F.lit(0)), "m": F.coalesce("m", F.lit(0))})
    return both.groupBy(keys[0]).agg(
        F.sum(F.least("n", "m")).alias("kept"), F.sum(F.greatest(F.col("m") - F.col("n"), F.lit(0))).alias("added"), F.sum(F.greatest(F.col("n") - F.col("m"), F.lit(0))).alias("lost")
    )
