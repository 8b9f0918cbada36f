"""Nearest neighbours by an inverted file: vectors in cells around centroids, queries in the cells that can matter.

Centroids are fitted on a sample of bounded size; every vector is then put into the cell
of its nearest one. Large cells are split into lists of bounded size. A query looks
into its nearest cells; with ``exact`` it then looks into every other cell whose
nearest possible vector, by the angle between query and centroid less the widest angle
of the cell, could still be among its best. Vectors travel once, whatever the number
of queries; a query travels to the lists that it asks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.retrieval import _best, _matrix, top
from factloom.sources.shared import keep

#: Vectors that centroids are fitted on, at most; cells, at most; vectors of a list; rounds of the fit.
SAMPLE_ROWS, MOST_CELLS, LIST_ROWS, FIT_ROUNDS = 20_000, 4096, 50_000, 12
#: Queries that are multiplied with a list at a time.
QUERY_ROWS = 2048
#: What the number of probes is fitted to: share of the nearest so many, on so many rows of the sample.
RECALL, NEAR, TRIED = 0.97, 10, 300


@dataclass
class Index:
    key: str
    lists: DataFrame  # cell, part, key, v: written once, a row per vector
    cells: DataFrame  # cell, parts: a row per cell
    centroids: np.ndarray
    angles: np.ndarray  # the widest angle between a cell's centroid and its vectors
    probes: int  # cells in which a query of the sample finds RECALL of its NEAR nearest in the sample


def fit(sample: np.ndarray, cells: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Unit centroids by spherical k-means, from rows of the sample that lie far apart; fewer where rows repeat."""
    start = [0]
    near = sample @ sample[0]
    while len(start) < cells:
        far = int(near.argmin())
        if near[far] > 1 - 1e-12:
            break
        start.append(far)
        near = np.maximum(near, sample @ sample[far])
    centroids = sample[start].copy()
    for _ in range(rounds):
        own = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centroids)
    return centroids


def fitted_probes(sample: np.ndarray, centroids: np.ndarray) -> int:
    """Nearest cells that hold RECALL of the NEAR nearest others of TRIED rows of the sample."""
    if len(sample) < 2:
        return 1
    tried = sample[:TRIED]
    s = tried @ sample.T
    s[np.arange(len(tried)), np.arange(len(tried))] = -2.0
    near = np.argsort(-s, axis=1, kind="stable")[:, : min(NEAR, len(sample) - 1)]
    cell = (sample @ centroids.T).argmax(1)
    place = np.argsort(np.argsort(-(tried @ centroids.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, cell[near], 1).ravel())
    return int(needed[math.ceil(RECALL * len(needed)) - 1]) + 1


def _assign(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            v = _matrix(batch.column(1))
            dots = v @ centroids.T
            cell = dots.argmax(1)
            angle = np.arccos(np.clip(dots[np.arange(len(v)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(angle)], names=["key", "v", "cell", "angle"])

    return run


def build(vectors: DataFrame, key: str, vector: str, cells: int | None = None, sample: int = SAMPLE_ROWS) -> Index:
    """Puts every vector into a cell; null vectors are left out. ``cells``: about the root of their number, if not given.

    The sample is drawn by a hash of the key and holds at most ``sample`` rows.
    """
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    n = rows.count()
    share = min(1.0, sample / max(1, n))
    drawn = rows if share == 1 else rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))
    few = np.array([r["v"] for r in drawn.select("v").limit(sample).collect()], float)  # at most ``sample`` rows
    few /= np.maximum(np.linalg.norm(few, axis=1, keepdims=True), 1e-300) if len(few) else 1
    centroids = fit(few, min(MOST_CELLS, cells or max(1, round(math.sqrt(n))))) if len(few) else np.zeros((1, 1))
    placed = keep(rows.mapInArrow(_assign(centroids), "key long, v array<double>, cell int, angle double"), "cells")
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle"))
    angles = np.full(len(centroids), -1.0)  # at most MOST_CELLS rows come to the driver
    for r in stats.collect():
        angles[r["cell"]] = r["angle"]
    parts = keep(stats.select("cell", F.ceil(F.col("n") / LIST_ROWS).cast("int").alias("parts")), "lists")
    lists = placed.join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), "key", "v")
    return Index(key, lists, parts, centroids, angles, fitted_probes(few, centroids))


def _nearest_cells(index: Index, probes: int):
    def run(batches):
        for batch in batches:
            dots = _matrix(batch.column(1)) @ index_centroids.T
            dots[:, empty] = -2.0
            n = min(probes, dots.shape[1])
            cells = np.argsort(-dots, axis=1, kind="stable")[:, :n]
            at = np.repeat(np.arange(len(dots)), n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(cells.ravel().astype(np.int32))], names=["q", "v", "cell"])

    index_centroids, empty = index.centroids, index.angles < 0
    return run


def _other_cells(index: Index, probes: int):
    """Cells beyond the first ``probes`` of which a vector may reach the query's k-th best score; a query without one asks all."""

    def run(batches):
        for batch in batches:
            dots = np.clip(_matrix(batch.column(1)) @ centroids.T, -1, 1)
            dots[:, angles < 0] = -2.0
            place = np.argsort(np.argsort(-dots, axis=1, kind="stable"), axis=1)
            reach = np.cos(np.maximum(0, np.arccos(np.clip(dots, -1, 1)) - angles))
            least = batch.column(2).to_numpy(zero_copy_only=False)
            at, cells = np.nonzero((place >= probes) & (angles >= 0) & ~(reach < least[:, None] - 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(cells.astype(np.int32))], names=["q", "v", "cell"])

    centroids, angles = index.centroids, index.angles
    return run


def _products(k: int):
    def run(key, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids = vectors.column("key").to_numpy()
        v = _matrix(vectors.column("v").combine_chunks())
        q, asked = queries.column("q").to_numpy(), queries.column("v").combine_chunks()
        out: list[list] = [[], [], []]
        for a in range(0, len(q) if len(ids) else 0, QUERY_ROWS):
            s = np.round(_matrix(asked.slice(a, QUERY_ROWS)) @ v.T, 12)
            keys, best = _best(np.broadcast_to(ids, s.shape), s, k)
            out[0].append(np.repeat(q[a : a + QUERY_ROWS], keys.shape[1]))
            out[1].append(keys.ravel())
            out[2].append(best.ravel())
        join = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0), kind)
        return pa.table({"q": join(out[0], pa.int64()), "key": join(out[1], pa.int64()), "score": join(out[2], pa.float64())})

    return run


def _ask(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(q, key, score): the k best of each list that a query asks; asked: q, v, cell."""
    dealt = asked.join(F.broadcast(index.cells), "cell").select("q", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return index.lists.groupBy("cell", "part").cogroup(dealt.groupBy("cell", "part")).applyInArrow(_products(k), "q long, key long, score double")


def search(index: Index, queries: DataFrame, query_key: str, vector: str, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(query, key, score, rank): the k most similar vectors by cosine that the nearest ``probes`` cells hold, ties by key.

    ``probes`` is the index's own number if not given. With ``exact`` the vectors are those of
    all cells. Null query vectors are left out.
    """
    probes = probes or index.probes
    q = queries.select(F.col(query_key).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    found = _ask(index, q.mapInArrow(_nearest_cells(index, probes), "q long, v array<double>, cell int"), k)
    if exact:
        found = keep(top(found, ["q"], "score", "key", k).select("q", "key", "score", "rank"), "probed")
        least = found.filter(F.col("rank") == k).select("q", F.col("score").alias("least"))
        open_ = q.join(least, "q", "left").select("q", "v", F.coalesce("least", F.lit(-2.0)).alias("least"))
        more = _ask(index, open_.mapInArrow(_other_cells(index, probes), "q long, v array<double>, cell int"), k)
        found = found.select("q", "key", "score").unionByName(more)
    return top(found, ["q"], "score", "key", k).select(F.col("q").alias(query_key), F.col("key").alias(index.key), "score", "rank")
