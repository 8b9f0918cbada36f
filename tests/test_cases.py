"""Rules of texts, questions and labels by cases worked out by hand: (given, what must come out)."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import answers, fragments, years
from factloom.operators import retrieval as ops

CASES: dict = {}


def _cases(name, cases, result):
    CASES[name] = (cases, result)


_FACETS = [
    ("2021年营业收入增长的原因是什么？", "question:2021年营业收入增长的原因是什么？|clause:2021年营业收入增长|metric:年营业收入增长|metric_year:年营业收入增长 2021|causal:年营业收入增长 原因 影响因素|comparison:年营业收入增长 本期 上期 同比 变动"),
    ("请分析公司面临的风险", "question:请分析公司面临的风险|clause:公司面临的风险|metric:面临的风险|topic:面临的风险 风险 不利因素 应对措施"), ("毛利率", "question:毛利率"),
    ("收入如何，利润如何", "question:收入如何，利润如何|clause:收入|clause:利润|metric:收入如何，利润"),
]


_parsed = lambda c: text.parse_fact_text(c)
_cases(
    "fact_texts",
    [("fact: a ||| b ||| c", "a/b/c"), ("FACT:x||| y |||z\ncontext: more", "x/y/z"), ("fact: a ||| b", None), ("a ||| b ||| c", None), ("", None), ("fact: ||| b ||| c", "/b/c")],
    lambda c: F.when(_parsed(c).isNotNull(), F.concat_ws("/", _parsed(c)["subject"], _parsed(c)["predicate"], _parsed(c)["object"])),
)
_cases("fact_round_trip", [("who", "fact: who ||| is ||| who"), ("", "fact:  ||| is ||| ")], lambda c: text.fact_text(c, F.lit("is"), c))
_cases(
    "json_fields", [('{"a": "x", "b": 2}', "x"), ('Sure! {"a": [1, 2]} done', "[1,2]"), ("no json", None), ('{"b": 1}', None), ('```json\n{"a": true}\n```', "true")], lambda c: text.json_field(c, "a")
)
_cases(
    "repaired_json",
    [('{"a": [1, 2', '{"a": [1, 2]}'), ('{"a": "x', '{"a": "x"}'), ('{"a": 1, "b"', '{"a": 1}'), ('{"a": 1,', '{"a": 1}'), ('{"a": {"b": ["[', '{"a": {"b": ["["]}}'), ('{"ok": 1}', '{"ok": 1}'), ('[{"t": ["s", "p", "o"]}, {"t": ["s"', '[{"t": ["s", "p", "o"]}, {"t": ["s"]}]')],
    text.repaired_json,
)
_cases("truncated_tokens", [("one two  three four", "one two three"), (" a b ", " a b "), ("", ""), ("x y z", "x y z")], lambda c: text.truncate_tokens(c, 3))
_cases("token_counts", [("one two  three", "3"), ("", "0"), ("　x　", "1")], lambda c: text.token_count(c).cast("string"))
_cases(
    "requested_units",
    [("营业收入是多少亿元", "unit_conversion_required/亿元"), ("单位：万元", "unit_conversion_required/万元"), ("利润多少元", "ok/元"), ("股本多少股", "ok/股"), ("毛利率为百分之几，用%表示", "ok/ratio"), ("收入是多少", "unspecified")],
    lambda c: F.concat_ws("/", text.requested_unit(c)["status"], text.requested_unit(c)["unit"]),
)
_cases(
    "question_years",
    [("营业收入是多少", "ok/2021/default_report_year"), ("2021年年报中2020年的收入", "ok/2020/explicit_metric_year"), ("2019年度报告的收入", "report_year_mismatch"), ("2020年年报与2021年年报", "report_year_ambiguous"), ("2019年和2020年收入", "metric_year_ambiguous"), ("2021年的收入", "ok/2021/explicit_metric_year")],
    lambda c: F.concat_ws("/", text.question_years(c, F.lit(2021))["status"], text.question_years(c, F.lit(2021))["metric_year"].cast("string"), text.question_years(c, F.lit(2021))["year_resolution"]),
)


def _labels():
    label = lambda name, sure, about: F.struct(F.lit(name).alias("label"), F.lit(sure).alias("confidence"), F.lit(about).alias("about"))
    return F.array(label("毛利率", 0.8, "毛利率上升 12.5%"), label("风险", 0.5, "汇率风险"))


_cases(
    # 25 x confidence for each label found, 0.7 for each of 毛利 利率 率上 上升 风险 汇率 率风 found, 5 for 12.5%.
    "label_relevance", [("", "-1.0"), ("毛利率上升", "22.8"), ("汇率风险与12.5%", "19.6"), ("无关", "0.0")], lambda c: F.round(text.label_relevance(c, _labels()), 6).cast("string")
)
_cases("question_facets", _FACETS, lambda c: F.array_join(F.transform(answers.facets(c), lambda x: F.concat(x["kind"], F.lit(":"), x["query"])), "|"))
_CHOSEN = [
    ('{"selected_ids": ["b", "a"]}', "shadow_valid:b,a"), ("I choose a", "fallback_free_text_or_schema:a,b,c"), ('{"selected_ids": ["a"], "why": "x"}', "fallback_free_text_or_schema:a,b,c"), ('{"selected_ids": ["a", "a"]}', "fallback_invalid_cardinality:a,b,c"),
    ('{"selected_ids": ["z"]}', "fallback_unknown_id:a,b,c"), ('{"selected_ids": []}', "shadow_valid:"), ('{"selected_ids": [1]}', "fallback_invalid_cardinality:a,b,c"), ('{"selected_ids": "a"}', "fallback_invalid_cardinality:a,b,c"), ("late", "fallback_timeout:a,b,c"),
]


def _chosen(c):
    out = answers.shadow_selection(F.array(*map(F.lit, "abc")), c, c == "late", 3)
    return F.concat(out["status"], F.lit(":"), F.array_join(out["selected"], ","))


_cases("shadow_selection", _CHOSEN, _chosen)


@pytest.mark.parametrize("name", sorted(CASES))
def test_by_hand(spark, name):
    cases, result = CASES[name]
    rows = spark.createDataFrame([(k, g) for k, (g, _) in enumerate(cases)], "k long, given string")
    got = {r["k"]: r["result"] for r in rows.select("k", result(F.col("given")).alias("result")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}


#: (metric, source, label across from it, report year) and by hand: year, how, error.
YEAR_CASES = [
    ("营业收入", "row_label", "2020年", 2021, 2020, "explicit_year", None), ("营业收入", "row_label", "本期", 2021, 2021, "relative_current", None), ("营业收入", "column_label", "上年度", 2021, 2020, "relative_previous", None),
    ("营业收入", "row_label", "", 2021, None, None, "missing_period_label"), ("营业收入", "row_label", "同比增减", 2021, None, None, "comparison_or_change_column"), ("营业收入", "row_label", "第一季度", 2021, None, None, "partial_period_or_quarter"),
    ("营业收入", "row_label", "2021年1-6月", 2021, None, None, "partial_period_or_quarter"), ("营业收入", "row_label", "年初至处置日", 2021, None, None, "partial_duration_date"), ("营业收入", "row_label", "2021年12月31日", 2021, None, None, "partial_duration_date"),
    ("总资产", "row_label", "2021年12月31日", 2021, 2021, "explicit_year_end_date", None), ("总资产", "row_label", "2021年1月1日", 2021, 2020, "explicit_opening_date", None), ("总资产", "row_label", "2021年6月30日", 2021, None, None, "non_standard_balance_date"),
    ("总资产", "row_label", "2021年初", 2021, 2020, "explicit_opening_period", None), ("总资产", "row_label", "期初", 2021, 2020, "relative_previous", None), ("总资产", "row_label", "2020年和2021年", 2021, None, None, "ambiguous_multiple_years"),
    ("营业收入", "row_label", "2030年", 2021, 2030, "explicit_year", "future_metric_year"), ("营业收入", "row_label", "2018年", 2021, 2018, "explicit_year", "metric_year_outside_three_year_window"), ("营业收入", "row_label", "金额", 2021, None, None, "unresolved_metric_year"),
    ("营业收入", "row_label", "2019", None, None, None, "invalid_report_year"), ("股本", "row_label", "年末余额", 2020, 2020, "relative_current", None),
]


def test_years_by_hand(spark):
    rows = [(k, m, s, lab if s == "column_label" else "x", lab if s == "row_label" else "x", y) for k, (m, s, lab, y, *_) in enumerate(YEAR_CASES)]
    given = spark.createDataFrame(rows, "k long, metric string, source string, row_label string, column_label string, report_year long")
    columns = [F.col(c) for c in given.columns[1:]]
    found = given.select("k", years.resolve_year(*columns).alias("y"), years.candidate_year(*columns).alias("c"), years.supplement_year(*columns, F.lit(2020))["error"].alias("s")).collect()
    for r in found:
        year, how, error = YEAR_CASES[r["k"]][4:]
        assert (r["y"]["metric_year"], r["y"]["year_resolution"], r["y"]["error"]) == (year, how, error)
        assert r["c"] == (year if error is None else None)
        assert r["s"] == ("metric_year_outside_three_year_window" if error == "future_metric_year" else error or (None if year == 2020 else "metric_year_mismatch"))


_SAID = ["alpha beta", "alpha beta gamma", "beta gamma", "delta", "alpha", "gamma delta epsilon"]
#: Worked out by hand for the question alpha beta: recall, precision, signal 1 / (10 + place), and what holds or is held by a better one.
_KEPT = [("alpha beta", 1), ("beta gamma", 2), ("delta", 3)]


def test_sentences_by_hand(spark):
    said = spark.createDataFrame([(1, k + 1, t) for k, t in enumerate(_SAID)], "question_id long, position long, text string")
    rows = said.withColumns({"key": text.compact_words(F.col("text")), "asked": F.array(F.lit("alpha"), F.lit("beta")), "grams": F.split("text", " "), "signal": 1.0 / (10.0 + F.col("position"))})
    assert sorted((r["text"], r["rank"]) for r in ops.rank_sentences(rows).collect()) == sorted(_KEPT)


def test_variants_by_hand(spark):
    words = {"base_search_text": "base", "value_search_text": "value", "own_row_header_text": "own", "single_header_text": "single", "multilevel_header_text": "multi", "hierarchical_row_text": "rows", "semantic_search_text": "meaning", "legacy_flat_text": "flat", "search_text": "none"}
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in words.items()])
    variants = {(): "base value own multi rows meaning", ("legacy_flattened_a0",): "flat", ("no_multilevel_headers",): "base value own single rows meaning", ("no_hierarchical_rows", "no_unit_period_scope"): "base value own multi"}
    for ablations, want in variants.items():
        assert row.select(fragments.variant_text(frozenset(ablations))).first()[0] == want
