import time

import pytest
from pyspark.sql import functions as F

from factloom.functions import numbers, text
from factloom.operators import chunking, fusion, graph, risk, tables
from factloom.plans import planner
from factloom.streaming import stateful


@pytest.mark.parametrize(
    "kind, given, want",
    [
        ("mixed", "营业收入2021年 A-1 x", ["营", "业", "收", "入", "营业", "业收", "收入", "2021", "年", "a-1", "x"]), ("lexical", "营业收入 ABC 年", sorted({"abc", "营业", "业收", "收入", "营业收入", "年"})),
        ("sparse", "公司营业", ["司营", "营业", "公司营", "司营业"]), ("table", "ＡＢ 收入", ["ab", "收入"]), ("mixed", None, []), ("table", "", []),
    ],
)
def test_tokenizers(spark, kind, given, want):
    rows = spark.createDataFrame([(given,)], "t string")
    assert rows.select(text.tokens(F.col("t"), kind)).first()[0] == want


def test_normalisers_see_unicode_space(spark):
    row = spark.createDataFrame([("　a b\t c ",)], "t string").select(text.normalise(F.col("t")), text.compact(F.lit("（１，２３４．５） 元")), text.compact_words(F.lit("A-b 收_入"))).first()
    assert tuple(row) == ("a b c", "(1,234.5)元", "ab收入")


@pytest.mark.parametrize(
    "raw, status, value, unit",
    [
        ("1,234.5万元", "parsed", 12345000.0, "元"), ("（12）", "parsed", -12.0, None), ("12.5%", "parsed", 0.125, "ratio"), ("不适用", "missing", None, None), (None, "missing", None, None),
        ("12里", "unparseable", None, None), ("abc", "unparseable", None, None), ("-3", "parsed", -3.0, None), ("人民币5元", "parsed", 5.0, "元"),
    ],
)
def test_numbers(spark, raw, status, value, unit):
    none = F.lit(None).cast("string")
    rows = spark.createDataFrame([(raw,)], "raw string").select(numbers.normalise_number(F.col("raw"), none, none, none).alias("n"))
    n = rows.first()["n"]
    assert (n["status"], None if n["value"] is None else float(n["value"]), n["unit"]) == (status, value, unit)


def test_units_come_from_labels_in_order(spark):
    rows = spark.createDataFrame([("5", "收入（万元）", "单位：千元"), ("5", "收入", "单位：千元")], "raw string, label string, hint string")
    got = rows.select(numbers.normalise_number(F.col("raw"), F.col("label"), F.lit(""), F.col("hint")).alias("n")).collect()
    assert [(int(r["n"]["value"]), r["n"]["unit_source"]) for r in got] == [(50000, "row_label"), (5000, "unit_hint")]


SPANS = "<table><tr><th rowspan=2>项目</th><th colspan=2>2021年</th></tr><tr><td>金额</td><td>比例</td></tr><tr><td>收入</td><td>1,000</td><td>50%</td></tr><tr><td>成本<td>500<td></tr></table>"


def test_spans_and_headers(spark):
    rows, _ = tables.parse_rows(SPANS)
    matrix = tables.expand(rows)
    assert matrix == [["项目", "2021年", "2021年"], ["项目", "金额", "比例"], ["收入", "1,000", "50%"], ["成本", "500", ""]]
    out = tables.extract_tables(spark.createDataFrame([("d", SPANS)], "document_id string, text string"), "document_id", "text").first()
    assert (out["header_rows"], out["embedded_headers"], out["data_start"]) == ([0, 1], [], 1)
    assert out["header"] == ["项目", "2021年 / 金额", "2021年 / 比例"]


def test_header_bands_reset_and_places(spark):
    page = "# A\n## B\n单位：万元\n<table><tr><td>项目</td><td>金额</td></tr><tr><td>收入</td><td>1</td></tr><tr><td>项目</td><td>金额</td></tr><tr><td>成本</td><td>2</td></tr></table>\n# C\n\n\n<table><tr><td colspan=3>x</td></tr><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>5</td></tr></table>"
    docs = spark.createDataFrame([("d", page)], "document_id string, text string")
    one, two = tables.extract_tables(docs, "document_id", "text").orderBy("table_index").collect()
    assert (one["header_rows"], one["embedded_headers"], one["unit_hint"], one["section_path"], one["line"]) == ([0], [2], "万元", ["A", "B"], 4)
    assert two["header_rows"] == [0, 1] and two["section_path"] == ["C"] and two["unit_hint"] is None
    rows = tables.extract_tables(docs, "document_id", "text")
    assert [tuple(r)[2:] for r in tables.grid_mismatches(rows).orderBy("table_index").collect()] == [(8, 0, 8), (7, 0, 4)]
    assert [r["failure"] for r in tables.readiness(rows).collect()] == [None, None]


def test_tables_and_cells(spark):
    docs = spark.createDataFrame([("d", f"x {SPANS} y <TABLE><tr><td></td></tr></TABLE>"), ("none", "text"), ("null", None)], "document_id string, text string")
    out = tables.extract_tables(docs, "document_id", "text")
    assert [(r["table_index"], r["status"]) for r in out.orderBy("table_index").collect()] == [(0, "parsed"), (1, "empty")]
    cells = {(r["row_index"], r["col_index"]): (r["cell_role"], r["column_label"], r["row_label"]) for r in tables.cells(out).collect()}
    assert cells[2, 1] == ("data", "2021年", "收入") and cells[2, 0][0] == "row_header" and cells[0, 2][0] == "header" and (3, 2) not in cells
    assert "(row2; 2021年; 1,000)" in tables.edge_list(tables.cells(out)).first()["edges"]


def test_headings_and_chunks(spark):
    md = "front\n# A\none\n## B\ntwo\n# C\nthree"
    docs = spark.createDataFrame([("d", md)], "document_id string, text string")
    lines = chunking.lines(docs, "document_id", "text")
    level = F.nullif(F.length(F.regexp_extract("content", r"^(#{1,6})\s", 1)), F.lit(0))
    paths = chunking.heading_paths(lines, "document_id", level, F.regexp_replace("content", r"^#+\s+", "")).orderBy("line").collect()
    assert [r["heading_path"] for r in paths] == [[], ["A"], ["A"], ["A", "B"], ["A", "B"], ["C"], ["C"]]
    assert chunking.sections(md) == [([], "front"), (["A"], "one"), (["A", "B"], "two"), (["C"], "three")]
    assert chunking.pack("a" * 25, 10) == ["a" * 10, "a" * 10, "a" * 5] and chunking.pack("", 5) == []
    assert all(r["n_chars"] <= 1200 for r in chunking.markdown_chunks(docs, "document_id", "text").collect())
    rows = chunking.token_windows(spark.createDataFrame([(1, ["a", "b", "c", "d", "e"]), (2, [])], "k int, t array<string>"), "k", F.col("t"), 3, 1)
    assert [r["tokens"] for r in rows.orderBy("window").collect()] == [["a", "b", "c"], ["c", "d", "e"], ["e"]]


def test_pagerank_is_a_distribution(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("d", "e", 1.0)], "src string, dst string, weight double")
    got = {r["node"]: r["score"] for r in graph.pagerank(edges, spark.createDataFrame([("a", 1.0), ("e", -1.0)], "node string, mass double"), rounds=30).collect()}
    p = {"a": 1.0, "b": 0.0, "c": 0.0}
    for _ in range(60):
        p = {"a": 0.5 + 0.5 * p["b"] / 3, "b": 0.5 * (p["a"] + p["c"]), "c": 0.5 * p["b"] * 2 / 3}
    assert abs(sum(got.values()) - 1) < 1e-9 and got["d"] == got["e"] == 0 and all(abs(got[k] - p[k]) < 1e-6 for k in p)


def test_rate_limit_counts_accepted_hits_only(spark, tmp_path):
    assert stateful.accept([0, 1, 2, 11, 12], [], 2, 10)[0] == [True, True, False, True, True]
    rows = spark.createDataFrame([("k", i, float(t)) for i, t in enumerate([0, 1, 2, 11, 12])] + [("z", 9, 0.0)], "key string, event_id long, at double")
    want = {0: True, 1: True, 2: False, 3: True, 4: True, 9: True}
    assert {r["event_id"]: r["accepted"] for r in stateful.rate_limit(rows, 2, 10).collect()} == want
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stateful.rate_limit_stream(stream, 2, 10).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).start()
    try:  # state with a timeout asks for batches without data for ever, so the query is stopped once the rows are there
        for _ in range(60):
            if spark.table("limited").count() == len(want):
                break
            time.sleep(1)
    finally:
        q.stop()
    assert {r["event_id"]: r["accepted"] for r in spark.table("limited").collect()} == want


def test_upsert_stream_writes_each_key_once(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    for k in range(2):
        stream = spark.readStream.schema("id long, v string").parquet(str(tmp_path / "in"))
        stateful.upsert_batches(stream, str(tmp_path / "out"), "id", str(tmp_path / f"c{k}")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_redaction_and_gate(spark):
    rows = spark.createDataFrame([("收入 1,000 和 5%", ["5%"]), (None, None)], "t string, ok array<string>")
    assert [r[0] for r in rows.select(fusion.redact_numbers(F.col("t"), F.col("ok"))).collect()] == ["收入 [未经授权数值] 和 5%", None]


def test_risk_views(spark):
    one = lambda n, c, s, q: (n, c, "", s, [(q, "")])
    docs = spark.createDataFrame([(("c1", "One", 2023), [one("r1", "x", 5, "a b"), one("r2", "y", 2, "z")], "text a  b z"), (("c2", "Two", 2023), [one("r3", "x", 9, "q")], "q")], risk.SCHEMA + ", source string")
    assert [r["violation"] for r in risk.validation(docs, ("x", "y"), "source").orderBy("Company.company_id").collect()] == [None, "score_out_of_range"]
    assert [r["company_id"] for r in risk.companies(docs, "y", 1).collect()] == ["c1"] and risk.detail(docs, "zz")[0] == "404" and risk.detail(docs, "c1")[0] == "200"
    assert risk.matrix(docs, ("x", "y")).filter("company_id = 'c1'").select("category_x", "category_y").first() == (5, 2)


@pytest.mark.parametrize(
    "question, kind",
    [("1997年营业收入最高的3家公司", "rank"), ("1997年总资产合计", "aggregate"), ("000000001 1996年毛利率", "formula"), ("000000001 1995年营业收入是多少", "fact"), ("000000001 1995年和1996年营业收入", "fact_series"), ("天气如何", "unsupported"), ("000000001", "metadata")],
)
def test_patterns(question, kind):
    assert planner.pattern(planner.analyse(question)) == kind and kind in planner.PATTERNS


def test_planner_answers(spark):
    from factloom.sources.views import companies, facts

    engine = planner.Engine(facts(spark, "/root/testdata/sf0.001"), companies(spark, "/root/testdata/sf0.001"))
    top = engine.compose("1997年营业收入最高的3家公司")
    assert top["status"] == "found" and len(top["lines"]) == 3
    assert engine.compose("天气如何")["status"] == "unsupported" and engine.compose("1997年营业收入最高的9家公司")["status"] == "blocked"


def test_units_do_not_cross_tables(spark):
    from factloom.operators import chunking

    body = "# H\n\nbefore\n\n<table><tr><td>inside</td></tr></table>\n\nafter\n\n## K\n\nlast"
    rows = spark.createDataFrame([("d", body)], "k string, t string")
    units = chunking.retrieval_units(rows, "k", "t").orderBy("chunk_index").collect()
    assert [(u["content"].strip(), list(u["heading_path"])) for u in units] == [("before", ["H"]), ("after", ["H"]), ("last", ["H", "K"])]
