"""Sharding by jump consistent hashing.

A row's shard is a function of its key and the number of shards alone; there is
no ring table. With one more shard, the only rows that move are those that go to
the new one. Slots number the rows of a shard without gaps: a shard is cut into
stripes by a hash of the id, stripes are numbered side by side, and the small table of stripe
sizes gives each its first slot.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import materialise, small_batches

SHARDS = 16
#: Rows that one stripe should hold: what one task sorts to number its slots.
STRIPE_ROWS = 2000

_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys to 0 .. shards - 1, for all keys side by side."""
    if shards < 1:
        raise ValueError("there must be a shard")
    key = keys.astype(np.int64).view(np.uint64).copy()
    at, next_ = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = next_[live]
        key[live] = key[live] * _STEP + np.uint64(1)
        scale = float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        next_[live] = ((at[live] + 1) * scale).astype(np.int64)
        live = live[next_[live] < shards]
    return at


def jump_udf(shards: int):
    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards)).astype("int32")

    return run


def shard(docs: DataFrame, shards: int = SHARDS, stripe_rows: int = STRIPE_ROWS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard; texts stay where they are.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 1. A null id hashes
    as 0. Rows that repeat an id share a shard and get neighbouring slots, in the
    order of size and checksum. An empty table gives an empty result. ``grown_shard``
    is the row's shard with one shard more.
    """
    small_batches(docs.sparkSession)
    text, key = F.col("text").cast("string"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        key.alias("__key"),
    )
    rows = rows.select("*", jump_udf(shards)("__key").alias("shard"), jump_udf(shards + 1)("__key").alias("grown_shard"))
    rows = materialise(rows, "op6-rows")
    stripes = max(1, math.ceil(rows.count() / (shards * stripe_rows)))
    # By a hash of the id, as ids with a common factor would fill few stripes.
    mixed = F.conv(F.substring(F.md5(F.col("__key").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("__stripe", F.pmod(mixed, F.lit(stripes)))
    # One row per shard and stripe: its size grows only with the number of tasks.
    sizes = rows.groupBy("shard", "__stripe").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("__stripe").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("shard", "__stripe", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy("shard", "__stripe").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("__row", F.row_number().over(within)).join(firsts, ["shard", "__stripe"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__first") + F.col("__row") - 1).cast("long").alias("slot"), "grown_shard"
    )
