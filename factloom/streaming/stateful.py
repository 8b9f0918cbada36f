"""Stateful operators: rate limiter, circuit breaker, latest record, incremental upsert, tumbling sums.

Each has a batch form, which is its oracle, and where state is needed a form for
Structured Streaming.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Accepted hits and seconds of the two limits, and failures and seconds of the breaker.
LIMITS = ((20, 3600), (240, 60))
BREAKER_FAILURES, BREAKER_SECONDS = 3, 300


def accept(times: list[float], recent: list[float], limit: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Decides hits in order; only accepted hits count against later ones."""
    out = []
    for t in times:
        recent = [r for r in recent if r > t - seconds]
        ok = len(recent) < limit
        out.append(ok)
        if ok:
            recent.append(t)
    return out, recent


_SCHEMA = "key string, event_id long, at double, accepted boolean"


def rate_limit(events: DataFrame, limit: int = LIMITS[0][0], seconds: float = LIMITS[0][1]) -> DataFrame:
    """Batch form on (key, event_id, at). Rows come sorted by key and time; the state is at most ``limit`` times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, recent = None, []
        for frame in batches:
            out = []
            for k, t in zip(frame["key"], frame["at"]):
                if k != key:
                    key, recent = k, []
                (ok,), recent = accept([t], recent, limit, seconds)
                out.append(ok)
            yield frame.assign(accepted=out)

    rows = events.select(F.col("key").cast("string"), F.col("event_id").cast("long"), F.col("at").cast("double"))
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key", "at", "event_id").mapInPandas(run, _SCHEMA)


def rate_limit_stream(events: DataFrame, limit: int = LIMITS[0][0], seconds: float = LIMITS[0][1]) -> DataFrame:
    """The same on a stream; the state of a key is the list of its accepted times, dropped when they have all passed."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        recent = list(state.get[0]) if state.exists else []
        out, recent = accept(rows["at"].tolist(), recent, limit, seconds)
        state.update((recent,))
        state.setTimeoutDuration(int(seconds * 1000))
        yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"], "at": rows["at"], "accepted": out})

    rows = events.select(F.col("key").cast("string"), F.col("event_id").cast("long"), F.col("at").cast("double"))
    return rows.groupBy("key").applyInPandasWithState(run, _SCHEMA, "recent array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def breaker(events: DataFrame, failures: int = BREAKER_FAILURES, seconds: int = BREAKER_SECONDS) -> DataFrame:
    """Failures with the number in the last ``seconds``, and whether they open the breaker; columns key, event_id, at.

    Time is dealt into buckets of ``seconds``: each bucket also gets the rows of the bucket
    before as guests, which are all that a window of its rows can reach. So a key with very
    many failures is spread over tasks, and every row is copied once.
    """
    bucket = F.floor(F.col("at") / seconds)
    places = F.explode(F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("b"), F.lit(False).alias("own"))))
    rows = events.withColumn("__p", places)
    last = Window.partitionBy("key", "__p.b").orderBy("at").rangeBetween(-seconds, 0)
    counted = rows.withColumn("recent", F.count(F.lit(1)).over(last)).filter("__p.own").drop("__p")
    return counted.withColumn("open", F.col("recent") >= failures)


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last record of each key of an append-only log; partial aggregates keep one row per key and task."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def tumbling(events: DataFrame, at: str, value: str, width: str, late: str) -> DataFrame:
    """Counts and sums by window; on a stream the watermark bounds the state."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def upsert_batches(stream: DataFrame, path: str, key: str, checkpoint: str):
    """A streaming sink that appends only keys that the store lacks; a batch that runs again writes nothing new."""
    from factloom.sources.tables import upsert_missing

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            store = spark.read.schema(batch.schema).parquet(path)
        except Exception as e:  # the store does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            store = spark.createDataFrame([], batch.schema)
        upsert_missing(store, batch, key).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
