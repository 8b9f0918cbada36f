"""Every query with an oracle gives the oracle's rows at the smallest scale."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import evaluation
from factloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda x: "null" if x is None or type(x).__name__ in ("NAType", "NaTType") or x != x else f"{float(x):.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(cell(x.item() if hasattr(x, "item") else x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_oracle(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_bootstrap_equals_its_definition(spark):
    """The interval by the same weights, row by row, and close to the plain bootstrap's."""
    scores = [((k * 37) % 101) / 100 for k in range(150)]
    rows = spark.createDataFrame(list(enumerate(scores)), "id long, score double")
    keys = {r["id"]: r["k"] for r in rows.select("id", F.xxhash64("id").alias("k")).collect()}
    total, mass = np.zeros(500), np.zeros(500)
    for k, x in enumerate(scores):
        w = evaluation.resample_weights(keys[k], 500)
        total, mass = total + w * x, mass + w
    got = evaluation.bootstrap(rows, "id", "score", 500).first()
    want = np.percentile(total / mass, [2.5, 97.5])
    assert abs(got["low"] - want[0]) < 1e-9 and abs(got["high"] - want[1]) < 1e-9 and got["n"] == 150
    rng = np.random.default_rng(0)
    plain = np.percentile(rng.choice(scores, (2000, 150)).mean(axis=1), [2.5, 97.5])
    assert np.abs(want - plain).max() < 0.02


def test_only_these_queries_have_no_oracle():
    """The bootstrap's random numbers and difflib's ratio are not SQL; each is held against its definition in a test of its own."""
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"bootstrap_ci", "fuzzy_match"}
