"""Joins on keys that many rows share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task takes, however small its fair share is, before the key is split.
HOT_ROWS = 10_000
#: Rows of a table that may be broadcast after they have been counted, and bytes of all their texts.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def fits(rows: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table may be broadcast: by its rows and by the bytes of its texts. Only one row more than allowed is read."""
    texts = [F.coalesce(F.octet_length(c).cast("long"), F.lit(0)) for c, kind in rows.dtypes if kind in ("string", "binary")]
    n, size = rows.limit(most + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(texts, F.lit(0))), F.lit(0))).first()
    return n <= most and size + 16 * n <= most_bytes


def small(rows: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` marked for broadcast if they ``fit``, else as they are."""
    return F.broadcast(rows) if fits(rows, most, most_bytes) else rows


def spread_join(left: DataFrame, right: DataFrame, key: str, salt: str, sizes: DataFrame, how: str = "inner", totals: tuple[int, int] | None = None) -> DataFrame:
    """``left`` joined to ``right`` on ``key``; keys with more left rows than a task's fair share are split over several tasks.

    ``sizes`` has the number ``n`` of left rows of each key; ``totals`` their sum and maximum,
    where these are known. There are at most as many frequent keys as partitions,
    which bounds the table that is broadcast. The right rows of a split key are copied to
    each of its parts. Where no key is that frequent, the join is a plain one.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, most = totals or sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    share = max(HOT_ROWS, total // parts)
    if most <= share:
        return left.join(right, key, how)
    hot = F.broadcast(sizes.filter(F.col("n") > share).select(F.col(key).alias("__hot"), F.ceil(F.col("n") / share).cast("int").alias("__parts")))
    dealt = left.join(hot, left[key] == F.col("__hot"), "left").withColumn("__salt", F.pmod(F.xxhash64(salt), F.coalesce("__parts", F.lit(1))).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    copied = right.join(hot, right[key] == F.col("__hot"), "left").withColumn("__salt", copies)
    return dealt.drop("__hot", "__parts").join(copied.drop("__hot", "__parts"), [key, "__salt"], how).drop("__salt")
