"""Cases of the third review's findings that were left: each failed before, by what a step made or by what it read again."""

import numpy as np
from pyspark.sql import functions as F

from factloom.operators import claims, graph, impact
from factloom.sources import ranges, shared


def test_long_lists_are_read_in_growing_steps():
    """lists that must be read to their end were added up in blocks of 128, some thousand numpy calls a query."""
    n = 20_000

    class Counted(np.ndarray):
        steps = 0

        def __getitem__(self, key):
            Counted.steps += isinstance(key, slice)
            return super().__getitem__(key)

    lists = []
    for t in range(4):
        units = np.random.default_rng(t).permutation(n)
        weights = np.linspace(2.0, 1.0, n)
        lists.append((units.view(Counted), weights, np.argsort(units, kind="stable"), 1.0))
    hit, score = impact.walk(lists, n, 5, slack=10.0)
    want = np.zeros(n)
    for units, weights, _, factor in lists:
        want[np.asarray(units)] += weights * factor
    assert Counted.steps < 100
    assert list(hit) == list(range(n)) and (score == want).all()


def test_tokens_of_one_field_make_no_pairs(spark):
    """each token became a struct with its weight, though all weights were equal."""
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None)], "id long, w array<string>")
    post = impact.Postings(rows, "id", {"w": (F.col("w"), 2.0)})
    got = {(r["key"], r["token"]): (r["length"], r["tf"]) for r in post.table.collect()}
    assert got == {(1, None): (6.0, 0.0), (1, "a"): (6.0, 4.0), (1, "b"): (6.0, 2.0), (2, None): (0.0, 0.0), (3, None): (0.0, 0.0)}


def test_only_near_sentences_are_read_whole(spark):
    """what is needed of the near sentences alone was made of all, and each shard's near ones were read."""
    lines = [(i, i // 10, i % 10, "", ["x"] * (i % 7) + [f"t{i % 5}", "y"]) for i in range(200)]
    sentences = spark.createDataFrame(lines, "sentence_id long, document_id long, line int, heading string, tokens array<string>").withColumn("t", F.array_join("tokens", " "))
    questions = spark.createDataFrame([(1, ["t3", "x"], "t3x"), (2, ["none"], "none")], "question_id long, tokens array<string>, key string")
    read = lambda rows: rows.withColumns({"text_key": F.replace("t", F.lit(" "), F.lit("")), "heading_key": F.lit("")})
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    late = rows(impact.sentence_search(sentences, questions, 3, 2, lambda: F.lit(0.0), 1.0, read))
    assert late == rows(impact.sentence_search(read(sentences), questions, 3, 2, lambda: F.lit(0.0), 1.0)) and len(late) >= 3


def test_claims_read_their_facts_once(spark, tmp_path):
    """singles, comparisons and the year before each made the facts again."""
    facts = [("f1", "D1", "1", "C", 2000, "m", 5, "元"), ("f2", "D2", "1", "C", 2001, "m", 7, "元"), ("f3", "D3", "1", "C", 2003, "m", 7, "元"), ("f4", "D3", "1", "C", 2004, "m", 7, "股"), ("f5", "D5", "1", "C", 2002, "m", 1, "元"), ("f6", "D5", "1", "C", 2002, "m", 2, "元"), ("f7", "D7", "2", "E", 2004, "m", 2, None)]
    spark.createDataFrame(facts, "fact_id string, document_id string, stock_code string, company string, metric_year long, canonical_metric string, normalized_value int, normalized_unit string").write.parquet(str(tmp_path / "f"))
    rows = spark.read.parquet(str(tmp_path / "f"))
    out = claims.compact_claims(rows)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    told = lambda df: sorted((r["kind"], r["text"], tuple(r["cells"])) for r in df.collect())
    assert told(out) == [("comparison", "C2001年m较上年增加2元", ("f2", "f1"))] + sorted([("single", "C2000年m为5元", ("f1",)), ("single", "C2001年m为7元", ("f2",)), ("single", "C2003年m为7元", ("f3",)), ("single", "C2004年m为7股", ("f4",))])
    assert told(claims.compact_claims(rows, rows)) == sorted(told(out) + [("comparison", "C2003年m较上年增加6元", ("f3", "f5")), ("comparison", "C2003年m较上年增加5元", ("f3", "f6"))])


def test_chained_records_are_not_joined_again(spark):
    """links went back to their records by a join that sorted and moved both."""
    rows = spark.createDataFrame([("a", i, f"x{i}", {"k": i}) for i in range(7)], "d string, n long, body string, m map<string, int>")
    whole = claims.chain(rows, "d", "n", F.col("body"), 3)
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    bare = claims.chain(rows, "d", "n", F.col("body"), 3, [])
    assert bare.columns == ["d", "n", "link"] and whole.columns == ["d", "n", "body", "m", "link"]
    assert sorted(tuple(r) for r in bare.collect()) == sorted((r["d"], r["n"], r["link"]) for r in whole.collect())
    assert sorted((r["n"], r["body"], r["m"]["k"]) for r in whole.collect()) == [(i, f"x{i}", i) for i in range(7)]


def test_sources_are_dealt_once(spark):
    """F16: rows were summed up behind one shuffle, dealt into ranges by a second, and moved to their walk by a third."""
    kind = "key string, ordinal long, digest string"
    a = spark.createDataFrame([(f"k{i:03}", i, "d") for i in range(200)], kind)
    b = spark.createDataFrame([(f"k{i:03}", 500 if i == 3 else i, "e" if i == 5 else "d") for i in range(200) if i != 7] + [("k009", 9, "d"), ("x", 900, None), (None, 0, "d")], kind)
    c = spark.createDataFrame([(f"k{i:03}", None if i == 4 else i, None if i == 6 else "d") for i in range(200)], kind)
    out = ranges.merge_validate({"a": a, "b": b, "c": c}, "a")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan and "MapInArrow" not in plan
    want = [("k003", "b", "reordered"), ("k005", "b", "changed"), ("k006", "c", "changed"), ("k007", "b", "missing"), ("k009", "b", "repeated"), ("x", "b", "foreign"), ("x", "c", "missing")]
    want.remove(("x", "c", "missing"))  # what the lead lacks too is not missing
    assert sorted(tuple(r) for r in out.collect()) == want


def test_shards_are_bounded_by_postings(spark, monkeypatch):
    """a shard took 20,000 units, however many postings they had, and a worker held them all."""
    rows = [(u, f"t{t}", float(1 + (u * t) % 5)) for u in range(60) for t in range(5)]
    weights = spark.createDataFrame(rows, "key long, token string, w double")
    asked = spark.createDataFrame([(1, "t1", 1), (1, "t4", 2), (2, "t3", 1)], "q long, token string, qtf long")
    got = lambda: sorted(tuple(r) for r in impact.search(weights, asked, "u", "q", 60, 4).collect())
    whole = got()
    monkeypatch.setattr(impact, "SHARD_POSTINGS", 40)
    assert impact.index(weights, 60)[1] == 8
    assert got() == whole and len(whole) == 8


def test_edges_are_dealt_once(spark):
    """every round of a walk moved all edges to the scores."""
    edges = spark.createDataFrame([(f"n{i}", f"n{(i * 7 + k) % 40}", 1.0 + k) for i in range(40) for k in range(1, 4)], "src string, dst string, weight double").filter("src <> dst")
    steps = graph.transitions(edges)
    scores = spark.createDataFrame([(f"n{i}", 1.0) for i in range(9)], "node string, score double")
    met = steps.withColumnRenamed("src", "node").join(scores.hint("merge"), "node")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    assert all(abs(r["p"] - 1) < 1e-12 for r in steps.groupBy("src").agg(F.sum("p").alias("p")).collect())
    name = steps._factloom_table
    shared.forget(steps)
    assert not spark.catalog.tableExists(name)
