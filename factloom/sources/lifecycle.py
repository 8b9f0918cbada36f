"""A search index that grows: versions, deltas, tombstones, compaction.

An index is a folder of immutable tables and one small file, CURRENT, that names the
manifest in force: the deltas in order, and for each which units it adds or takes away.
Every change writes new tables and a new manifest beside the old ones and then puts the new
name into CURRENT by one rename that replaces it, so that a reader sees the index before
or after a change and a crash leaves it as it was. Reading merges: of the rows of a unit
those of the last delta that names it count. Compaction writes what is alive as one
delta; tables that no manifest needs are deleted by ``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import impact
from factloom.sources.integrity import exists, read_text, replace_text


class SearchIndex:
    """An index over units (key, tokens) at a path; units are named by whole numbers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- the manifest ---------------------------------------------------------------------

    def deltas(self) -> list[dict]:
        """The deltas in force, oldest first: their name and kind (add or delete)."""
        if not exists(self.spark, f"{self.path}/CURRENT"):
            return []
        return json.loads(read_text(self.spark, f"{self.path}/{read_text(self.spark, f'{self.path}/CURRENT').strip()}"))

    def _commit(self, deltas: list[dict]) -> None:
        name = f"manifest-{uuid.uuid4().hex}.json"
        replace_text(self.spark, f"{self.path}/{name}", json.dumps(deltas))
        replace_text(self.spark, f"{self.path}/CURRENT", name)

    # --- changes --------------------------------------------------------------------------

    def _write(self, units: DataFrame, key: str, tokens: Column) -> dict:
        name = f"delta-{uuid.uuid4().hex}"
        rows = units.select(F.col(key).cast("long").alias("key"), F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"))
        # A unit without a token leaves a row too; of units that repeat a key the first by their tokens stands.
        rows.groupBy("key").agg(F.min("tokens").alias("tokens")).write.parquet(f"{self.path}/{name}")
        return {"name": name, "kind": "add"}

    def build(self, units: DataFrame, key: str, tokens: Column) -> None:
        """Makes the index anew from ``units``, whatever it held."""
        self._commit([self._write(units, key, tokens)])

    def add(self, units: DataFrame, key: str, tokens: Column) -> None:
        """Adds units; one whose key the index has replaces the older one."""
        self._commit([*self.deltas(), self._write(units, key, tokens)])

    def delete(self, keys: DataFrame, key: str) -> None:
        """Takes units away; unknown keys change nothing."""
        name = f"delta-{uuid.uuid4().hex}"
        keys.select(F.col(key).cast("long").alias("key"), F.lit(None).cast("array<string>").alias("tokens")).distinct().write.parquet(f"{self.path}/{name}")
        self._commit([*self.deltas(), {"name": name, "kind": "delete"}])

    def compact(self) -> None:
        """Writes the units that are alive as one delta."""
        self._commit([self._write(self.units(), "key", F.col("tokens"))])

    def vacuum(self) -> int:
        """Deletes tables and manifests that are not in force; the number of them. Not while others read older versions."""
        current = read_text(self.spark, f"{self.path}/CURRENT").strip()
        used = {"CURRENT", current, *(d["name"] for d in self.deltas())}
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(self.path)
        store = folder.getFileSystem(context._jsc.hadoopConfiguration())
        gone = [s.getPath() for s in store.listStatus(folder) if s.getPath().getName() not in used and not s.getPath().getName().startswith(".")]
        for where in gone:
            store.delete(where, True)
        return len(gone)

    # --- reading --------------------------------------------------------------------------

    def units(self) -> DataFrame:
        """(key, tokens) of the units alive: for each key the last delta that names it, unless that deletes it."""
        rows = None
        for place, delta in enumerate(self.deltas()):
            own = self.spark.read.schema("key long, tokens array<string>").parquet(f"{self.path}/{delta['name']}").withColumn("place", F.lit(place))
            rows = own if rows is None else rows.unionByName(own)
        if rows is None:
            return self.spark.createDataFrame([], "key long, tokens array<string>")
        if len(self.deltas()) == 1:
            return rows.filter("tokens IS NOT NULL").select("key", "tokens")
        last = rows.groupBy("key").agg(F.max_by("tokens", "place").alias("tokens"))
        return last.filter("tokens IS NOT NULL")

    def search(self, queries: DataFrame, query_key: str, tokens: Column, k: int) -> DataFrame:
        """(query, key, score, rank): BM25 over the units alive, exact."""
        asked = impact.asked_tokens(queries, query_key, tokens)
        post = impact.Postings(self.units(), "key", {"tokens": (F.col("tokens"), 1.0)}, asked.select("token").distinct())
        return impact.search(post.bm25(), asked, "key", query_key, post.n, k)
