"""Searches over impact-ordered postings equal scores of all pairs, and skip what cannot matter."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import impact


def made(seed, n, words=30):
    rng = random.Random(seed)
    # Rare and frequent words, repeated units, empty ones.
    units = {i: [f"w{min(int(rng.expovariate(0.25)), words)}" for _ in range(rng.randrange(0, 25))] for i in range(n)}
    units[n] = list(units[0])
    queries = {q: [f"w{rng.randrange(words)}" for _ in range(rng.randrange(1, 6))] for q in range(15)} | {90: ["nowhere"], 91: ["w0", "w0", "w1"]}
    return units, queries


def by_hand(units, queries, idf_only=False):
    df, average = Counter(t for w in units.values() for t in set(w)), sum(map(len, units.values())) / len(units)
    out = {}
    for q, asked in queries.items():
        for u, w in units.items():
            tf, score = Counter(w), 0.0
            for t, qtf in Counter(asked).items():
                if tf[t]:
                    idf = math.log(1 + (len(units) - df[t] + 0.5) / (df[t] + 0.5))
                    score += qtf * idf * (1 if idf_only else tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / average)))
            if score:
                out[q, u] = score
    return out


def best(scores, k):
    by_query = {}
    for (q, u), s in scores.items():
        by_query.setdefault(q, []).append((-round(s, 6), u))
    return sorted((q, u, -s, r) for q, rows in by_query.items() for r, (s, u) in enumerate(sorted(rows)[:k], 1))


@pytest.mark.parametrize("scheme, shard_units, query_block", [("bm25", 20_000, 4096), ("bm25", 50, 4), ("idf", 70, 4096)])
def test_equal_to_all_pairs(spark, monkeypatch, scheme, shard_units, query_block):
    monkeypatch.setattr(impact, "QUERY_BLOCK", query_block)
    units, queries = made(1, 300)
    u = spark.createDataFrame(list(units.items()), "unit long, w array<string>")
    q = spark.createDataFrame(list(queries.items()), "q long, w array<string>")
    asked = impact.asked_tokens(q, "q", F.col("w"))
    for wanted in (None, asked.select("token").distinct()):
        post = impact.Postings(u, "unit", {"w": (F.col("w"), 1.0)}, wanted)
        got = impact.search(getattr(post, scheme)(), asked, "unit", "q", post.n, 7, shard_units=shard_units)
        assert sorted((r["q"], r["unit"], r["score"], r["rank"]) for r in got.collect()) == best(by_hand(units, queries, scheme == "idf"), 7)


def test_walk_skips_blocks_and_loses_nothing():
    rng = np.random.default_rng(2)
    skipped = 0
    for trial in range(60):
        n = 3000
        lists, full = [], np.zeros(n)
        for _ in range(rng.integers(1, 5)):
            units = rng.permutation(n)[: rng.integers(1, n)]
            weights = np.sort(np.round(rng.pareto(1.0 + trial % 3, len(units)), 2 if trial % 2 else 9))[::-1]
            factor = float(rng.integers(1, 3))
            lists.append((units, weights, np.argsort(units, kind="stable"), factor))
            full[units] += weights * factor
        k, slack, seen = int(rng.integers(1, 12)), [0.0, 1.5][trial % 2], []
        hit, score = impact.walk(lists, n, k, slack, block=64, seen=seen)
        assert np.allclose(score, full[hit])
        cut = np.sort(full)[-k] - slack
        assert set(np.flatnonzero((full >= cut) & (full > 0)).tolist()) <= set(hit.tolist())
        skipped += seen[0] < 0.8 * sum(len(u) for u, *_ in lists)
    assert skipped > 20


def test_empty_tables(spark):
    u = spark.createDataFrame([], "unit long, w array<string>")
    q = spark.createDataFrame([(1, ["a"])], "q long, w array<string>")
    asked = impact.asked_tokens(q, "q", F.col("w"))
    post = impact.Postings(u, "unit", {"w": (F.col("w"), 1.0)})
    assert impact.search(post.bm25(), asked, "unit", "q", post.n, 3).collect() == []
    some = spark.createDataFrame([(1, ["a"]), (2, None), (3, [])], "unit long, w array<string>")
    post = impact.Postings(some, "unit", {"w": (F.col("w"), 1.0)})
    assert [r["unit"] for r in impact.search(post.bm25(), asked, "unit", "q", post.n, 3).collect()] == [1] and post.n == 3
