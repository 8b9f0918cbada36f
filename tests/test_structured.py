import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factloom.operators import facts as ops
from factloom.operators import authorization, formulas, fusion, resolver, selection

FACTS = "fact_id string, document_id string, stock_code string, report_year long, metric_year long, canonical_metric string, normalized_value decimal(38,4), normalized_unit string"


def _facts(spark, rows):
    return spark.createDataFrame([(f"f{k}", f"d{c}", c, y, y, m, None if v is None else Decimal(v), "元") for k, (c, y, m, v) in enumerate(rows)], FACTS)


#: Published growth rates, as current value, previous value and the rate in percent with two places.
GROWTH = [
    ("3340496743.86", "2684873028.18", "24.42"), ("1675417058.94", "1637405569.89", "2.32"), ("323859660.14", "343794748.38", "-5.80"),
    ("707762419.19", "683339179.47", "3.57"), ("2931123716.02", "2304550442.98", "27.19"), ("1819604562.82", "1401197550.73", "29.86"),
]


def test_growth_rates_match_published_values(spark):
    rows = [x for k, (now, before, _) in enumerate(GROWTH) for x in ((str(k), 2021, "营业收入", now), (str(k), 2020, "营业收入", before))]
    asked = spark.createDataFrame([(str(k), "revenue_growth_rate.v1", 2021) for k in range(len(GROWTH))], "stock_code string, formula_id string, target_year long")
    got = {r["stock_code"]: r for r in formulas.evaluate(asked, _facts(spark, rows)).collect()}
    for k, (_, _, want) in enumerate(GROWTH):
        assert got[str(k)]["status"] == "found" and round(got[str(k)]["value"] * 100, 2) == Decimal(want)


def test_formula_statuses(spark):
    rows = [("a", 2020, "营业收入", "0"), ("a", 2021, "营业收入", "5"), ("b", 2020, "营业收入", "-4"), ("b", 2021, "营业收入", "2"), ("c", 2021, "营业收入", "2"), ("d", 2021, "营业收入", "2"), ("d", 2020, "营业收入", "2"), ("d", 2020, "营业收入", "3")]
    asked = spark.createDataFrame([(c, "revenue_growth_rate.v1", 2021) for c in "abcd"] + [("a", "none", 2021)], "stock_code string, formula_id string, target_year long")
    got = {(r["stock_code"], r["formula_id"]): (r["status"], r["code"], r["value"]) for r in formulas.evaluate(asked, _facts(spark, rows)).collect()}
    growth = "revenue_growth_rate.v1"
    assert got["a", growth][:2] == ("blocked", "FORMULA_ZERO_DENOMINATOR") and got["c", growth][0] == "fallback_required"
    assert got["d", growth][1] == "FACT_UNRESOLVED_CONFLICT" and got["a", "none"][0] == "unsupported"
    assert got["b", growth][2] == Decimal("-1.5")  # a negative base keeps its sign
    assert len(formulas.CATALOGUE) == 36


def test_rank_ties_ascend_in_both_directions(spark):
    rows = _facts(spark, [("b", 2020, "营业收入", "1"), ("a", 2020, "营业收入", "1"), ("c", 2020, "营业收入", "2"), ("d", 2020, "营业收入", "0")])
    spec = lambda d: ops.QuerySpec("rank", "营业收入", 2020, "元", order_direction=d, limit=3)
    codes = lambda d: [r["stock_code"] for r in ops.rank(rows, spec(d)).orderBy("rank").collect()]
    assert codes("desc") == ["c", "a", "b"] and codes("asc") == ["d", "a", "b"]


def test_aggregates_and_empty_input(spark):
    rows = _facts(spark, [("a", 2020, "营业收入", "1"), ("b", 2020, "营业收入", "2")])
    spec = lambda op, y=2020: ops.QuerySpec("aggregate", "营业收入", y, "元", aggregate_operator=op)
    assert ops.aggregate(rows, spec("sum")).first()["value"] == 3 and ops.aggregate(rows, spec("average")).first()["value"] == Decimal("1.5")
    assert ops.aggregate(rows, spec("count")).first()["value"] == 2 and ops.aggregate(rows, spec("sum", 1999)).count() == 0


@pytest.mark.parametrize("bad", [{"limit": 6}, {"limit": True}, {"metric_year": 1800}, {"order_direction": "up"}, {"kind": "drop"}, {"canonical_metric": "x; drop table"}])
def test_query_specs_are_checked(bad):
    with pytest.raises(ValueError):
        ops.QuerySpec(**{"kind": "rank", "canonical_metric": "营业收入", "metric_year": 2020, "normalized_unit": "元"} | bad)


def test_allow_list_ignores_empty_lists_and_rejects_unknown_fields(spark):
    rows = _facts(spark, [("a", 2020, "营业收入", "1"), ("b", 2021, "营业收入", "2")])
    assert ops.allow_list(rows, {}).count() == 2 and ops.allow_list(rows, {"stock_codes": [], "metric_years": [2020]}).count() == 1
    with pytest.raises(ValueError):
        ops.allow_list(rows, {"color": ["x"]})


def _candidates(spark, rows):
    base = {"stock_code": "s", "statement": "income_statement", "report_year": 2021, "metric_year": 2021, "canonical_metric": "营业收入", "metric_match_type": "exact_alias", "metric_source": "row_label", "year_confidence": "high", "context_is_financial": True, "unit_source": "raw_value", "normalized_unit": "元"}
    schema = "candidate_id string, document_id string, stock_code string, statement string, normalized_value decimal(38,12), report_year long, metric_year long, canonical_metric string, metric_match_type string, metric_source string, year_confidence string, context_is_financial boolean, unit_source string, normalized_unit string"
    names = [f.split()[0] for f in schema.split(", ")]
    full = [{**base, "candidate_id": f"c{k}", **r} for k, r in enumerate(rows)]
    return spark.createDataFrame([tuple(Decimal(r[n]) if n == "normalized_value" and r[n] is not None else r[n] for n in names) for r in full], schema)


def test_selection_rules(spark):
    weak = {"metric_match_type": "regex", "metric_source": "column_label", "year_confidence": "medium", "context_is_financial": False, "unit_source": "column_label"}
    rows = [
        {"document_id": "single", "normalized_value": "5"}, {"document_id": "low", "normalized_value": "5", **weak},
        {"document_id": "won", "normalized_value": "1"}, {"document_id": "won", "normalized_value": "2", **weak},
        {"document_id": "tie", "normalized_value": "1"}, {"document_id": "tie", "normalized_value": "2"},
        {"document_id": "gone", "normalized_value": None}, {"document_id": "gone", "normalized_value": "1", "metric_year": 2030}, {"document_id": "gone", "normalized_value": "1", "normalized_unit": "股"},
    ]
    audited = selection.audit(_candidates(spark, rows))
    reasons = {(r["document_id"], r["candidate_id"]): r["rejection_reasons"] for r in audited.collect()}
    assert reasons["gone", "c6"] == ["not_parsed_numeric"] and reasons["gone", "c7"] == ["future_metric_year"] and reasons["gone", "c8"] == ["missing_or_incompatible_unit"]
    facts = selection.build_facts(selection.score(audited.filter("eligible")))
    got = {(r["document_id"], int(r["normalized_value"])): (r["is_selected"], r["selection_status"]) for r in facts.collect()}
    assert got["single", 5] == (True, "selected_single_value") and got["low", 5] == (False, "low_confidence")
    assert got["won", 1] == (True, "resolved_by_confidence") and got["won", 2] == (False, "not_selected_conflict")
    assert got["tie", 1] == got["tie", 2] == (False, "unresolved_conflict")
    assert {r["document_id"] for r in selection.conflict_groups(facts).collect()} == {"won", "tie"}


def test_alias_statuses(spark):
    rows = spark.createDataFrame([("1", ["A", "Shared"]), ("2", ["B", "shared "])], "stock_code string, aliases array<string>")
    asked = spark.createDataFrame([(" a",), ("SHARED",), ("none",)], "mention string")
    got = {r["mention"]: (r["status"], r["n"]) for r in resolver.resolve_mentions(asked, rows, "aliases", "stock_code").collect()}
    assert got == {"A": ("unique", 1), "SHARED": ("ambiguous", 2), "NONE": ("missing", 0)}


def test_renderings(spark):
    def of(value, unit, places):
        rows = spark.createDataFrame([(Decimal(value), unit)], f"v decimal(38,{places}), u string")
        return rows.select(authorization.renderings(F.col("v"), F.col("u"), places)).first()[0]

    assert of("0.2442", "ratio", 4) == sorted({"0.2442", "0.24", "24.42", "24.42%"})
    assert {"1.23万元", "12345元", "1.2345万元", "0.00012345亿元"} <= set(of("12345", "元", 0)) and of("0", "元/股", 4) == ["0", "0元/股"]


#: Metric -> value in the target year; the year before holds half of it and one more.
LITERALS = {
    "营业收入": "1000.123456789012", "总资产": "5000", "净资产": "2000.5", "归属于上市公司股东的净利润": "150", "销售费用": "60", "营业利润": "210", "管理费用": "80", "流动负债": "900", "无形资产": "70",
    "财务费用": "-20", "研发费用": "40.25", "净利润": "160", "总负债": "3000", "货币资金": "330", "投资收益": "12", "固定资产": "1100", "现金及现金等价物": "310", "营业成本": "640", "流动资产": "1500",
    "非流动负债": "2100", "存货": "250", "研发人员数": "30", "职工总数": "400", "硕士人数": "45", "博士及以上人数": "5",
}


def _by_hand(formula_id):
    v = lambda m: Decimal(LITERALS[m])
    for i, metric in formulas.GROWTH:
        if i == formula_id:
            before = v(metric) / 2 + 1
            return (v(metric) - before) / before
    for i, a, b in formulas.RATIOS:
        if i == formula_id:
            return v(a) / v(b)
    three = v("销售费用") + v("管理费用") + v("财务费用")
    return {
        "gross_margin.v1": (v("营业收入") - v("营业成本")) / v("营业收入"), "quick_ratio.v1": (v("流动资产") - v("存货")) / v("流动负债"), "three_expense_ratio.v1": three / v("营业收入"),
        "rd_expense_share.v1": v("研发费用") / (three + v("研发费用")), "postgraduate_staff_ratio.v1": (v("硕士人数") + v("博士及以上人数")) / v("职工总数"),
    }[formula_id]


def test_all_formulas_by_literals(spark):
    schema = FACTS.replace("decimal(38,4)", "decimal(38,12)")
    rows = [(f"f{k}{y}", f"d{y}", "a", y, y, m, Decimal(v) if y == 2021 else Decimal(v) / 2 + 1, "元") for k, (m, v) in enumerate(LITERALS.items()) for y in (2020, 2021)]
    asked = spark.createDataFrame([("a", f, 2021) for f in formulas.CATALOGUE], "stock_code string, formula_id string, target_year long")
    got = {r["formula_id"]: r for r in formulas.evaluate(asked, spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 36
    for formula_id, r in got.items():
        assert r["status"] == "found" and abs(r["value"] - _by_hand(formula_id)) < Decimal("1e-11"), formula_id


def test_reservation_skips_what_is_taken(spark):
    """A fits two facets and is reserved for the first; the second then takes B, though C is better."""
    rows = [(1, "A", "text", 10, ["f1", "f2"]), (1, "C", "text", 9, ["f1"]), (1, "B", "text", 8, ["f2"])]
    table = spark.createDataFrame(rows, "question_id long, candidate_id string, route string, fusion_score long, facet_ids array<string>")
    got = fusion.reserve_routes(table, "question_id", ["f1", "f2"], 2).orderBy("place").collect()
    assert [(r["candidate_id"], r["reserved"]) for r in got] == [("A", True), ("B", True)]


def test_reservation_equals_a_plain_walk(spark):
    rng = random.Random(4)
    facets = ["a", "b", "c"]
    rows = [(q, f"c{k:02d}", rng.choice(["text", "table"]), rng.randrange(30), rng.sample(facets, rng.randrange(4))) for q in range(12) for k in range(60)]
    table = spark.createDataFrame(rows, "question_id long, candidate_id string, route string, fusion_score long, facet_ids array<string>")
    got = {}
    for r in fusion.reserve_routes(table, "question_id", facets, 9).orderBy("question_id", "place").collect():
        got.setdefault(r["question_id"], []).append((r["candidate_id"], r["reserved"]))
    for q in range(12):
        own, taken = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[2] != "table", r[1])), []
        for f in facets:
            for route in ("text", "table"):
                fits = [r[1] for r in own if r[2] == route and f in r[4] and r[1] not in taken]
                taken += fits[:1] if len(taken) < 9 else []
        rest = [r[1] for r in own if r[1] not in taken]
        assert got[q] == [(c, True) for c in taken] + [(c, False) for c in rest[: 9 - len(taken)]]


def test_strict_fusion_fails(spark):
    rows = spark.createDataFrame([(1, "c", (1, 2), [], "x", "p1"), (1, "c", (1, 2), [], "x", "p2")], "q long, candidate_id string, signal struct<rank long, weight long>, authorizations array<string>, conflict_status string, fingerprint string")
    assert fusion.merge_candidates(rows, ["q", "candidate_id"], []).first()["provenance_error"]
    with pytest.raises(Exception, match="differ in their provenance"):
        fusion.merge_candidates(rows, ["q", "candidate_id"], [], strict=True).collect()
    packet = spark.createDataFrame([(1, 1, "c", "worth 5", [])], "q long, place long, candidate_id string, safe_text string, renderings array<string>")
    with pytest.raises(Exception, match="nothing authorizes"):
        fusion.answer_packet(packet, "q", strict=True).collect()


def test_an_average_keeps_all_places_of_its_operands(spark):
    from decimal import ROUND_HALF_UP, Decimal, localcontext

    from factloom.operators.facts import exact_mean

    groups = {0: ["0.000000000001", "0.000000000002"], 1: ["99999999999999999.999999999999"] * 3 + ["0.000000000001"], 2: ["-7.123456789012", "3.000000000001", "1.5"], 3: ["1", "1", "0"]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, v string").withColumn("v", F.col("v").cast("decimal(38,12)"))
    got = {r["g"]: r["m"] for r in rows.groupBy("g").agg(exact_mean(F.sum("v"), F.count(F.lit(1))).alias("m")).collect()}
    for g, vs in groups.items():
        with localcontext() as c:
            c.prec = 60
            want = (sum(map(Decimal, vs)) / len(vs)).quantize(Decimal("1e-18"), ROUND_HALF_UP)
        assert abs(got[g] - want) <= Decimal("1e-18")
