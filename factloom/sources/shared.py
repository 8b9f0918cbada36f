"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the session names one, else the context's; a local folder only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def keep(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once and reads it back: its lineage ends there, and what reads it twice computes it once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._factloom_path = path
    return out


def keep_buckets(df: DataFrame, label: str, key: str) -> DataFrame:
    """As ``keep``, dealt by ``key`` into as many buckets as a shuffle has partitions: joins by the key move only their other side."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path, parts = f"{shared_dir(spark)}/{name}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._factloom_path, out._factloom_table = path, name
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``keep`` or ``keep_buckets`` wrote and that nothing reads any more."""
    for df in tables:
        path, name = getattr(df, "_factloom_path", None), getattr(df, "_factloom_table", None)
        if name:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path:
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
