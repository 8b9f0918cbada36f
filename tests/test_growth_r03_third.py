"""Cases of the third review's growth findings, third session: each failed before, by the rows that a step made."""

import math

from pyspark.sql import functions as F

from factloom.functions import information
from factloom.operators import authorization, formulas, fusion, retrieval


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_renderings_make_no_rows(spark):
    """each way to write a value became a row, which was shuffled twice with its whole scope."""
    claims = [("c1", "1,234.5", 2020), ("c2", "1 234.50元", 2020), ("c3", "12％", 2020), ("c4", "1234.5", 2021), ("c5", None, 2020), ("c6", "12%", 2020)]
    scope = ["e", "e", "D", "m"]
    names = "entity_key string, company string, document_id string, measure string"
    asked = spark.createDataFrame([(c, t, *scope, y) for c, t, y in claims], f"claim_id string, token string, {names}, measure_year long")
    granted = spark.createDataFrame([("a1", *scope, 2020, ["1234.5", "1,234.50 元"]), ("a2", *scope, 2020, ["12 ％", None]), ("a3", *scope, 2020, ["1234.5"])], f"authorization_id string, {names}, measure_year long, allowed_renderings array<string>")
    out = authorization.matching_authorizations(asked, granted)
    assert "Generate" not in _plan(out)
    got = sorted((r["claim_id"], r["authorization_id"] or "") for r in out.collect())
    assert got == [("c1", "a1"), ("c1", "a3"), ("c2", "a1"), ("c3", "a2"), ("c4", ""), ("c5", ""), ("c6", "a2")]


def test_renderings_are_sorted_and_distinct(spark):
    """they were made by functions that no code is generated for."""
    r = spark.sql("SELECT CAST(x AS DECIMAL(38,4)) AS v FROM VALUES ('0'), ('10'), ('12.5'), ('1.2345') t(x)").select("v", authorization.renderings(F.col("v"), F.lit("元"), 4).alias("r"))
    assert "array_sort" not in r.select(F.size("r"))._jdf.queryExecution().analyzed().toString()
    for row in r.collect():
        assert row["r"] == sorted(set(row["r"])) and None not in row["r"]


def test_formula_operands_make_no_rows(spark):
    """each operand became a row, joined with the facts and folded back into a column per role."""
    facts = spark.createDataFrame([("a", 2020, "营业收入", 4), ("a", 2021, "营业收入", 5), ("a", 2021, "营业成本", None), ("a", None, "营业收入", 9), ("b", 2021, "营业收入", 1), ("b", 2021, "营业收入", 2), ("b", 2021, "其他", 2)], "stock_code string, metric_year long, canonical_metric string, normalized_value int").withColumn("normalized_value", F.col("normalized_value").cast("decimal(38,4)"))
    asked = [("a", "revenue_growth_rate.v1", 2021), ("a", "revenue_growth_rate.v1", 2021), ("a", "gross_margin.v1", 2021), ("a", "revenue_growth_rate.v1", None), ("b", "operating_cost_ratio.v1", 2021), (None, "current_ratio.v1", 2021), ("c", "none", 2021), ("c", None, 2021)]
    out = formulas.evaluate(spark.createDataFrame(asked, "stock_code string, formula_id string, target_year long"), facts)
    assert "Generate" not in _plan(out)
    got = sorted(((r["stock_code"] or "", r["formula_id"] or "", r["target_year"] or 0, r["status"], r["value"] and float(r["value"])) for r in out.collect()), key=str)
    growth = "revenue_growth_rate.v1"
    assert got == sorted([
        ("a", growth, 2021, "found", 0.25), ("a", "gross_margin.v1", 2021, "found", None), ("a", growth, 0, "fallback_required", None), ("b", "operating_cost_ratio.v1", 2021, "blocked", None),
        ("", "current_ratio.v1", 2021, "fallback_required", None), ("c", "none", 2021, "unsupported", None), ("c", "", 2021, "unsupported", None),
    ], key=str)


def test_fragments_move_once(spark):
    """fragments were made and moved four times, to count a document, its tokens, to score and to read the results."""
    rows = [(d, i % 3, f"t{i % 4}", f"f{i % 17}", "table_row" if i % 2 else "mixed_narrative", i % 5, sorted({f"p{i % 3}", f"s{i % 7}", "O"}), [f"p{i % 3}", "x"]) for d in (1, 2) for i in range(20 * d)]
    fragments = spark.createDataFrame(rows, "document_id long, table_index int, table_id string, fragment_id string, kind string, line int, tokens array<string>, labels array<string>")
    asked = [(10, 1, ["p1", "s2", "none"], "of p1"), (11, 1, ["none"], "p1"), (20, 2, ["s0", "O"], "p0 p2"), (21, 2, ["p2"], "-"), (30, 3, ["p2"], "-")]
    out = retrieval.table_search(fragments, spark.createDataFrame(asked, "question_id long, document_id long, tokens array<string>, text string"), 6)
    assert _plan(out).count("Join ") == 1
    want = []
    for q, d, tokens, text in asked:
        own = [r for r in rows if r[0] == d]
        weight = {t: math.log((len(own) + 1) / (sum(t in r[6] for r in own) + 1)) + 1 for t in tokens}
        total = {f: sum(weight[t] for r in own if r[3] == f for t in tokens if t in r[6]) for f in {r[3] for r in own}}
        scored = [(-round(total[r[3]] / len(tokens) + 0.1 * sum(len(x) > 1 and x in text for x in r[7]) + (0.01 if r[4] != "table_row" else 0), 8), r[1], r[2], r[4] != "table_row", r[5], r[3]) for r in own if set(tokens) & set(r[6])]
        want += [(q, k, s[-1], -s[0]) for k, s in enumerate(sorted(scored)[:6], 1)]
    assert sorted((r["question_id"], r["rank"], r["fragment_id"], r["score"]) for r in out.collect()) == sorted(want)


def test_candidates_move_once_to_their_question(spark):
    """candidates were merged by pairs of keys, then joined with themselves four times and ranked in two branches."""
    rows = [(q, f"c{i % 6}", "table" if i % 6 < 2 else "text" if i % 6 < 5 else "other", f"t{i % 6}" if i % 6 in (0, 1, 4, 5) else None, [None, "t0", "t0"] if i % 6 == 2 else ["t1", "t0", "t4"] if i % 6 == 4 else ["t5", "t1"] if i % 6 == 5 else None, f"f{i % 3}", i) for q in range(3) for i in range(q, 9 + 4 * q)]
    lines = spark.createDataFrame(rows, "q long, candidate_id string, route string, table_id string, beside array<string>, facet string, rank long")
    lines = lines.withColumns({"signal": F.struct(F.col("facet").alias("facet_id"), "rank"), "authorizations": F.array("facet"), "conflict_status": F.lit("clear"), "fingerprint": F.lit("p")})
    merged = lambda **more: fusion.merge_candidates(lines, ["q", "candidate_id"], ["route", "table_id", "beside"], **more).withColumns({"score": F.size("signals").cast("long"), "facet_ids": F.col("signals.facet_id")})
    out = fusion.adjacency(merged(within="q"), "q", "beside")
    held = fusion.reserve_routes(out, "q", ["f0", "f1"], 3)
    assert held._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert not any(word in _plan(held) for word in ("Join", "Union"))
    own = {(r["q"], r["candidate_id"]): r for r in merged().collect()}
    want = {}
    for (q, c), r in own.items():
        others = [(d, o) for (p, d), o in own.items() if p == q]
        of_tables = {d for d, o in others if r["route"] != "text" and r["table_id"] and r["table_id"] in (o["beside"] or [])}
        of_texts = {d for d, o in others if r["route"] == "text" and o["route"] == "table" and o["table_id"] in (r["beside"] or [])}
        want[q, c] = (len(of_tables | of_texts), r["signals"])
    assert {(r["q"], r["candidate_id"]): (r["n_complements"], r["signals"]) for r in out.collect()} == want
    assert len(held.collect()) == 9


def test_keys_are_made_once_a_text(spark):
    """letters and digits of a question were made again for each of about eighty words, and all signs of a long text were counted."""
    assert "transform(array(concat(" in _plan(spark.range(1).select(information.concerns(F.concat("id", F.lit("诉讼"))).alias("c")))
    signs = lambda text: spark.createDataFrame([(text,)], "t string").select(information._signs(F.col("t"))).first()[0]
    assert signs("a " * 10_000) == information.ASKED_SIGNS + 1
    assert signs("。" * 2_000 + "a1研" * 3) == 9 and signs("a" * 60) == 60 and signs("a" * 300) == 300 and signs("") == 0
    rows = [("项目 本期", True), (" 项目、金额/备注", True), ("项目甲 本期", False), ("项目", False), ("甲 本期", False), ("项目 甲", False)]
    got = spark.createDataFrame(rows, "t string, want boolean").select("want", information._table_header(F.trim("t"), F.array().cast("array<array<string>>"), F.array().cast("array<string>")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
