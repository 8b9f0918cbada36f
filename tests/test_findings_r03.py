"""Cases of the third review: each gave other rows, or failed, before."""

import datetime
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import chunking, graph, mentions
from factloom.operators import retrieval as ops
from factloom.plans import catalog


def run_both(spark, folder, name, **tables):
    """Sorted rows of a query and of its SQL over small tables."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table, frame in tables.items():
        frame.to_parquet(f"{folder}/{table}.parquet", index=False, coerce_timestamps="us")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    got = catalog.queries()[name](spark, str(folder))
    want = con.execute(catalog.oracle_sql()[name])
    at = [[d[0] for d in want.description].index(c) for c in got.columns]
    return sorted(tuple(r) for r in got.collect()), sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_units_with_an_id_twice_stay_two(spark):
    units = spark.createDataFrame([("u", 1, ["a", "b"]), ("u", 1, ["a", "b"]), ("u", 1, ["b", "x"]), ("v", None, ["a"])], "unit_id string, document_id long, atom_ids array<string>")
    atoms = spark.createDataFrame([("a", 1, "A"), ("b", 1, "B")], "atom_id string, document_id long, content string")
    got = sorted((r["unit_id"], r["contents"], r["missing"]) for r in chunking.project_atoms(units, atoms).collect())
    assert got == [("u", ["A", "B"], 0), ("u", ["A", "B"], 0), ("u", ["B"], 1), ("v", [], 1)]


def test_atom_projection_of_repeated_rows(spark, tmp_path):
    rows = pd.DataFrame({"l_orderkey": [1, 1, 2], "l_linenumber": [1, 1, 1], "l_partkey": [7, 8, 9], "l_suppkey": [1, 2, 0], "l_extendedprice": [5.0, 5.0, 6.0]})
    got, want = run_both(spark, tmp_path, "atom_projection", lineitem=pd.concat([rows, rows]))
    assert len(got) == 6 and got == want


@pytest.mark.parametrize("most", [200_000, 1])
def test_a_name_is_searched_behind_its_last_find(spark, most):
    rows = spark.createDataFrame([(1, "all the the the end"), (2, "the the the the")], "k long, t string")
    names = spark.createDataFrame([("all the",), ("the the",)], "name string")
    got = sorted(tuple(r) for r in mentions.find_mentions(rows, "k", "t", names, most, apart=True).collect())
    assert got == [(1, 0, 7, "all the"), (2, 0, 7, "the the"), (2, 8, 15, "the the")]
    assert (1, 8, 15, "the the") in [tuple(r) for r in mentions.find_mentions(rows, "k", "t", names, most).collect()]


def test_synonyms_rank_by_rounded_cosines(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1e-4]), (3, [1.0, 0.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in graph.synonymy_edges(rows, "vec_id", "embedding", 0.4, 2, digits=6).collect())
    assert got == [(1, 2, 1.0), (2, 1, 1.0), (3, 1, 1.0), (3, 2, 1.0)]
    assert (1, 3) in [tuple(r)[:2] for r in graph.synonymy_edges(rows, "vec_id", "embedding", 0.4, 2).collect()]


@pytest.mark.parametrize("name", ["gold_matches", "interval_overlap_join"])
def test_seconds_of_events_are_rounded(spark, tmp_path, name):
    start = datetime.datetime(2024, 1, 1)
    at = [start + datetime.timedelta(seconds=s) for s in (599.6, 600 * 4, 1.5, 3602.4, 2.5, 3603.6)]
    rows = pd.DataFrame({"event_id": [5, 6, 10, 11, 15, 16], "user_id": [1, 1, 2, 2, 3, 3], "ts": at, "props": list("abcdef")})
    got, want = run_both(spark, tmp_path, name, events=rows)
    assert got == want


def test_grams_of_a_long_text_take_time_in_proportion(spark):
    """400,000 characters of three bytes: counting to each place from the start took minutes."""
    long = "".join(chr(0x4E00 + i * 7919 % 20_000) for i in range(400_000))
    rows = spark.createDataFrame([(1, long), (2, "a\nb😀c"), (3, "a"), (4, None)], "k long, t string")
    start = time.monotonic()
    got = {r["k"]: r for r in rows.select("k", text.plain_bigrams(F.col("t"), ("the",)).alias("p"), text.char_grams(F.col("t"), (2,)).alias("c"), text.han_bigrams(F.col("t")).alias("h")).collect()}
    assert time.monotonic() - start < 60
    want = list(dict.fromkeys(long[i : i + 2] for i in range(len(long) - 1)))
    assert got[1]["p"] == got[1]["c"] == got[1]["h"] == want
    assert got[2]["c"] == ["a\n", "\nb", "b😀", "😀c"] and got[3]["c"] == got[4]["c"] == got[3]["p"] == got[4]["p"] == []


def test_dense_rankings_pair_no_unit_with_a_vector_in_rows(spark, monkeypatch):
    """Blocks of two units: results as by hand, units without a vector last, and only k rows a block and question leave a task."""
    monkeypatch.setattr(ops, "UNIT_BLOCK", 2)
    units = [(d, f"{d}{i}", i, None if i == 3 else [1.0, float(i)], ["w" if i % 2 else "x"], [], []) for d in "ab" for i in range(7)]
    rows = spark.createDataFrame(units, "document_id string, unit_id string, ordinal long, vector array<double>, body array<string>, heading array<string>, adjacency array<string>")
    asked = spark.createDataFrame([(1, "a", [1.0, 0.0], ["w"]), (2, "b", [0.0, 1.0], ["none"]), (3, "a", None, ["w"]), (4, "c", [1.0, 0.0], ["w"])], "question_id long, document_id string, vector array<double>, tokens array<string>")
    got = {m: sorted((r["question_id"], r["rank"], r["unit_id"], r["dense_score"]) for r in ops.hybrid(rows, asked, 7, F.col("ordinal") == 1, m).collect()) for m in ("dense", "sparse")}
    assert [r[2] for r in got["dense"]] == ["a0", "a2", "a4", "a5", "a6", "a3", "b6", "b5", "b4", "b2", "b0", "b3", "a0", "a2", "a3", "a4", "a5", "a6"]
    assert got["dense"][0][3] == 1.0 and got["dense"][5][3] is None
    assert [r[2] for r in got["sparse"]] == ["a3", "a5", "a0", "a2", "a4", "a6", "b0", "b2", "b3", "b4", "b5", "b6", "a3", "a5", "a0", "a2", "a4", "a6"]
    plan = ops.hybrid(rows, asked, 3, None, "dense")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan


def test_quality_learns_from_features_made_on_executors(spark, monkeypatch):
    """The same bags and labels as from texts, and no text reaches the driver."""
    import numpy as np

    from factloom.llm import common, quality

    docs = spark.createDataFrame([(i, f"Words {i} of a text! " * (1 + i % 90), "en") for i in range(60)] + [(100, "", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100, 1)], "doc_id long, quality int")
    want = common.labelled_sample(docs, labels, "quality", 15)
    monkeypatch.setattr(common, "labelled_sample", None)
    bags, y = quality.encoded_sample(docs, labels, 15)
    assert y.tolist() == [q for _, q in want] and len(bags) == 30
    assert all(np.array_equal(b, quality.encode(t)) for b, (t, _) in zip(bags, want))
    assert quality.train(docs.limit(0), labels).w["c"].shape == (1,)
