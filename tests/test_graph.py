"""Personalised PageRank of many queries equals the plain iteration of each; retrieval equals its steps by hand."""

import pathlib
import random

import pytest

from factloom.operators import graph, skew


def plain(edges, reset, damping, rounds, tolerance):
    nodes = {n for a, b, _ in edges for n in (a, b)} | set(reset)
    out = {n: {} for n in nodes}
    for a, b, w in edges:
        out[a][b] = out[a].get(b, 0) + w
        out[b][a] = out[b].get(a, 0) + w
    all_ = sum(max(0.0, m or 0.0) for m in reset.values())
    r = {n: max(0.0, reset.get(n) or 0.0) / all_ for n in nodes}
    score, took = dict(r), 0
    for took in range(1, rounds + 1):
        moved = dict.fromkeys(nodes, 0.0)
        for a in nodes:
            total = sum(out[a].values())
            for b, w in out[a].items():
                moved[b] += score[a] * w / total
        lost = 1 - sum(moved.values())
        new = {n: (1 - damping) * r[n] + damping * (moved[n] + lost * r[n]) for n in nodes}
        change, score = sum(abs(new[n] - score[n]) for n in nodes), new
        if change < tolerance:
            break
    return score, took


@pytest.mark.parametrize("hot", [10_000, 3])
@pytest.mark.parametrize("tolerance", [0.0, 0.02])
def test_many_queries_at_once(spark, monkeypatch, hot, tolerance):
    monkeypatch.setattr(skew, "HOT_ROWS", hot)  # the hub is split over tasks
    rng = random.Random(4)
    edges = [("hub", f"n{i}", 1.0) for i in range(40)] + [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", rng.random()) for _ in range(80)]
    edges = [e for e in edges if e[0] != e[1]]
    resets = {q: {f"n{rng.randrange(40)}": rng.random() for _ in range(rng.randrange(1, 4))} for q in range(6)}
    resets[6], resets[7] = {"alone": 1.0, "n1": 1.0, "n2": -5.0, "n3": None}, {"hub": 1.0}
    e = spark.createDataFrame(edges, "src string, dst string, weight double")
    r = spark.createDataFrame([(q, n, m) for q, own in resets.items() for n, m in own.items()] + [(8, "n5", -1.0)], "query_id long, node string, mass double")
    got = {}
    for row in graph.pagerank_many(e, r, 0.5, 9, tolerance).collect():
        got.setdefault(row["query_id"], {})[row["node"]] = row["score"]
    assert set(got) == set(resets)  # a query without mass has no rows
    took = set()
    for q, own in resets.items():
        want, rounds = plain(edges, own, 0.5, 9, tolerance)
        took.add(rounds)
        assert abs(sum(got[q].values()) - 1) < 1e-9 and all(abs(got[q].get(n, 0.0) - s) < 1e-9 for n, s in want.items())
    assert tolerance == 0 or len(took) > 1  # queries stop in different rounds


def test_retrieval_falls_back_and_ranks(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("p1", "a", 1.0), ("p2", "b", 1.0), ("p3", "c", 1.0)], "src string, dst string, weight double")
    mentions = spark.createDataFrame([("p1", "a"), ("p2", "b"), ("p3", "c")], "chunk_id string, entity string")
    facts = spark.createDataFrame([(1, "a", "b", 0.9, 1.0)], "query_id long, subject string, object string, score double, confidence double")
    passages = spark.createDataFrame([(q, p, s) for q in (1, 2) for p, s in (("p1", 0.2), ("p2", 0.1), ("p3", 1.0))], "query_id long, chunk_id string, score double")
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in graph.retrieve(edges, facts, passages, mentions, 3).collect()}
    assert got == {(1, 1): "p1", (1, 2): "p2", (1, 3): "p3", (2, 1): "p3", (2, 2): "p1", (2, 3): "p2"}


def test_tables_of_the_loop_are_deleted(spark):
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    e = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    assert graph.pagerank_many(e, spark.createDataFrame([(1, "a", 1.0)], "query_id long, node string, mass double"), rounds=4).count() == 2
    assert all(p.name.startswith("ranked-") for p in set(folder.iterdir()) - before)
