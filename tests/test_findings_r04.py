"""Cases of the fourth review: each gave other rows, or failed, before."""

import numpy as np
import pandas as pd
import pytest

from factloom.operators import graph
from factloom.operators import retrieval as ops
from tests.test_findings_r03 import run_both


def test_neighbours_rank_by_the_score_that_is_shown(spark, tmp_path):
    """Cosines that differ behind the sixth digit are ties, which go to the smaller id."""
    rows = pd.DataFrame({"vec_id": [1, 2, 3, 4, 5, 6, 50], "embedding": [[1.0, x] for x in (3e-4, 2e-4, 1e-4, 1.0, 0.5, 0.0, 0.0)]})
    got, want = run_both(spark, tmp_path, "knn_join", embeddings=rows)
    assert got == want and [r[1] for r in sorted(got, key=lambda r: r[3])] == [1, 2, 3, 6, 50]


def _likes(n: int, dim: int = 8):
    """Vectors of few values, so that many cosines tie, some are there often and one has length 0."""
    rng = np.random.default_rng(4)
    v = rng.integers(-1, 2, (n, dim)).astype(float)
    v[: n // 3] = v[0] = 1.0
    v[n // 2] = 0.0
    return v


@pytest.mark.parametrize(("block", "rows"), [(32_768, 1 << 20), (40, 70)])
@pytest.mark.parametrize("least", [None, 0.3])
def test_neighbours_by_any_blocks_are_those_of_all_pairs(spark, block, rows, least):
    v = _likes(300)
    ids = [i - i % 2 if i > 280 else i for i in range(300)]  # some ids twice
    table = spark.createDataFrame([(ids[i], v[i].tolist()) for i in range(300)] + [(999, None)], "id long, v array<double>")
    norm = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    asked = [i for i in range(300) if ids[i] % 3 == 0]
    want = []
    for q in sorted({ids[i] for i in asked}):
        best = sorted((-round(float(norm[i] @ norm[j]), 6), ids[j]) for i in asked if ids[i] == q for j in range(300))
        want += [(q, key, -score, n + 1) for n, (score, key) in enumerate(x for x in best if least is None or -x[0] >= least) if n < 7]
    got = ops.knn(table, table.filter("id % 3 = 0").withColumnRenamed("id", "q"), "id", "q", "v", 7, block, rows, 6, least)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_vectors_and_results_move_as_few_times_as_cores_need():
    """A million vectors that all ask: blocks of 4,096 queries moved each vector 245 times, results 16 times."""
    assert ops._dealt(1_000_000, 1_000_000, 101, 24, ops.KNN_QUERIES, ops.KNN_VECTORS) == (31, 1)
    assert ops._dealt(1000, 50_000, 5, 24, ops.KNN_QUERIES, ops.KNN_VECTORS)[0] == 1
    assert ops._dealt(0, 0, 5, 4, ops.KNN_QUERIES, ops.KNN_VECTORS)[0] >= 1


@pytest.mark.parametrize("tolerance", [0.0, 0.05])
def test_walks_of_a_graph_that_a_task_holds_are_those_of_blocks(spark, monkeypatch, tolerance):
    """Both ways give the scores of the plain walk; where the graph is held, nothing is dealt into blocks."""
    rng = np.random.default_rng(1)
    ends = [(f"n{a}", f"n{b}", float(w)) for a, b, w in zip(*rng.integers(0, 40, (2, 120)), rng.integers(1, 5, 120)) if a != b]
    edges = spark.createDataFrame(ends, "src string, dst string, weight double")
    masses = [(q, f"n{(q * 7 + i) % 40}", float(i)) for q in range(11) for i in range(1, 4)] + [(3, "alone", 2.0), (20, "n1", None), (21, "alone", 1.0)]
    reset = spark.createDataFrame(masses, "query_id long, node string, mass double")
    rows = lambda df: {(r["query_id"], r["node"]): r["score"] for r in df.collect()}
    want = {k: v for k, v in rows(graph.pagerank_many(edges, reset, 0.5, 9, tolerance)).items() if v}
    only = spark.createDataFrame([("n1",), ("alone",), ("n1",)], "node string")
    monkeypatch.setattr(graph, "WHOLE_EDGES", 0)
    blocks = rows(graph.pagerank_blocks(edges, reset, 0.5, 9, tolerance))
    monkeypatch.setattr(graph, "WHOLE_EDGES", 10_000)
    monkeypatch.setattr(graph, "_walk_blocks", None)
    for scores in (4_000_000, 90):
        monkeypatch.setattr(graph, "WHOLE_SCORES", scores)
        whole = rows(graph.pagerank_blocks(edges, reset, 0.5, 9, tolerance))
        assert whole == pytest.approx(want) and blocks == pytest.approx(want)
    some = rows(graph.pagerank_blocks(edges, reset, 0.5, 9, tolerance, only))
    assert some == pytest.approx({k: v for k, v in want.items() if k[1] in ("n1", "alone")})
