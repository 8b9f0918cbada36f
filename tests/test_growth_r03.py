"""Cases of the third review's findings on growth: each failed before, by what a step made or by what it read again."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import numbers
from factloom.operators import graph, tables, years


@pytest.mark.parametrize("tolerance", [0.0, 0.02])
def test_walks_by_blocks_equal_walks_by_rows(spark, monkeypatch, tolerance):
    """a node's scores of all queries are one row; blocks of seven nodes and parts of about three queries."""
    monkeypatch.setattr(graph, "NODE_BLOCK", 7)
    monkeypatch.setattr(graph, "WALK_QUERIES", 3)
    rng = random.Random(7)
    pairs = [("hub", f"n{i}", 1.0) for i in range(40)] + [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", rng.random()) for _ in range(80)]
    edges = spark.createDataFrame([e for e in pairs if e[0] != e[1]], "src string, dst string, weight double")
    masses = [(q, f"n{rng.randrange(40)}", rng.random()) for q in range(8) for _ in range(2)] + [(8, "alone", 1.0), (8, "n1", 1.0), (8, "n2", -5.0), (9, "alone", 2.0), (10, "n5", -1.0), (11, "n3", None)]
    reset = spark.createDataFrame(masses, "query_id long, node string, mass double")
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    rows = lambda df: {(r["query_id"], r["node"]): r["score"] for r in df.collect() if r["score"] > 0}
    got = rows(graph.pagerank_blocks(edges, reset, 0.5, 9, tolerance))
    assert all(p.name.startswith("ranked-") for p in set(folder.iterdir()) - before)
    want = rows(graph.pagerank_many(edges, reset, 0.5, 9, tolerance))
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    some = rows(graph.pagerank_blocks(edges, reset, 0.5, 9, tolerance, spark.createDataFrame([("n1",), ("alone",)], "node string")))
    assert set(some) == {k for k in want if k[1] in ("n1", "alone")}


def test_plain_tables_need_no_parser(monkeypatch):
    """plain markup is read tag by tag as the parser reads it; what is not plain goes to the parser."""
    rng = random.Random(1)
    plain = ["<tr>", "</tr>", "<td>", "</td>", "<th rowspan=2>", "<td colspan='3'>", '<td rowspan="2" class=x>', "<br>", "<caption>", "</caption>", "a b", " \n", "<b>", "<TD>", "<td >"]
    other = ["&amp;", "<!-- x -->", "<br/>", "< td>", "<td rowspan=0>", "x > y", "<script>", "</td x>", "<", "<td colspan=2/>"]
    raws = ["<table>" + "".join(rng.choice(plain if rng.random() < 0.95 else other) for _ in range(rng.randrange(1, 25))) + "</table>" for _ in range(3000)]
    read = lambda raw: [[(c.text, c.tag, c.rowspan, c.colspan) for c in row] for row in tables.parse_rows(raw)[0]] + [tables.parse_rows(raw)[1]]
    got = [read(raw) for raw in raws]
    assert sum(tables._plain_rows(raw) is not None for raw in raws) > 300
    monkeypatch.setattr(tables, "_plain_rows", lambda raw: None)
    assert got == [read(raw) for raw in raws]


def test_grids_are_parsed_once(spark, monkeypatch):
    """three branches read the tables; the parser's tasks must not run for each."""
    text = "<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>"
    rows = spark.createDataFrame([(f"d{i}", text) for i in range(5)], "document_id string, text string")
    monkeypatch.setattr(tables, "BATCH_TABLES", 2)
    out = tables.grid_mismatches(tables.parse_tables(rows, "document_id", "text"))
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == [(f"d{i}", 0, 4, 0, 3) for i in range(5)]


def test_labels_and_numbers_are_read_once(spark):
    """the text of a cell was cleaned again in each branch that names it."""
    rows = spark.createDataFrame([("（1,234.5）", "营业收入", "2020年", 2021)], "raw string, row string, col string, y long")
    plan = lambda c: rows.select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan(numbers.parse(F.col("raw"))).count("translate(") == 1
    year = years.supplement_year(F.lit("营业收入"), F.lit("row_label"), F.col("row"), F.col("col"), F.col("y"), F.lit(2020))
    assert plan(year).count("regexp_replace(") == 1
    got = rows.select(numbers.parse(F.col("raw")).alias("p"), year.alias("y")).first()
    assert (got["p"]["status"], float(got["p"]["value"]), got["p"]["raw_unit"]) == ("parsed", -1234.5, None)
    assert (got["y"]["metric_year"], got["y"]["error"]) == (2020, None)
