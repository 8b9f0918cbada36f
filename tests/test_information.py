"""Classes of passages, each rule by a case, and points of questions counted by hand."""

from factloom.functions import information

LITIGATION = ["重大诉讼、仲裁事项"]
CASES = [
    (None, None, None, "empty"), (" \n", "公司研发情况", [], "empty"), ("□适用 √不适用", "公司重大诉讼情况", LITIGATION, "scoped_checkbox_negative"), ("□适用 √不适用", "公司研发情况", ["其他"], "short_without_question_concern"),
    ("√适用 □不适用", "公司研发情况", [], "short_without_question_concern"), ("无", "公司诉讼情况", LITIGATION, "scoped_checkbox_negative"), ("详见本报告第五节", "研发投入", [], "redirect_only"), ("研发投入为1200万元，详见附注", "公司的研发投入", [], "explicit_fact"),
    ("天气状况为晴朗并无变化，详见附注", "公司的研发投入", [], "redirect_only"), ("单位：万元", "x", [], "unit_only"), ("| 单位 | 元 |", "x", [], "unit_only"), ("单位：克", "x", [], "short_without_question_concern"), ("| 项目 | 金额 |\n|---|---|", "x", [], "table_header"),
    ("| 项目 | 金额 |\n|---|---|\n| 研发 | 5 |", "x", [], "explicit_fact"), ("| 项目 | 研发 |\n|---|---|", "x", [], "short_without_question_concern"), ("项目 本期 上期", "x", [], "table_header"), ("# 公司治理情况", "x", [], "heading_or_document_title"),
    ("# 公司治理情况于2020年发生3项变化", "x", [], "explicit_fact"), ("第三节 管理层讨论与分析", "x", [], "heading_or_document_title"), ("某某股份有限公司２０２０年年度报告", "x", [], "heading_or_document_title"), ("是否存在退市情况", "x", [], "heading_or_document_title"),
    ("公司董事会及全体董事保证本报告内容真实、准确、完整", "x", [], "audit_or_governance_boilerplate"), ("2020年营业收入为5亿元", "营业收入", [], "explicit_fact"), ("项目｜金额", "x", [], "short_without_question_concern"), ("晴朗", "天气晴朗", [], "substantive"),
]


def test_each_rule(spark):
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, t string, q string, p array<string>")
    got = {r.i: r for r in information.classified(rows, "t", "q", "p").collect()}
    assert [got[i].reason for i in range(len(CASES))] == [c[3] for c in CASES]
    assert {r.reason for r in got.values() if r.usable} == {"scoped_checkbox_negative", "explicit_fact", "substantive"}


def test_a_box_of_the_own_section(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("□适用 √不适用", "天气", None)], "t string, q string, p array<string>")
    assert information.classified(rows, "t", "q", "p", F.lit(True)).head().reason == "scoped_checkbox_negative"


def test_points(spark):
    rows = spark.createDataFrame([("公司诉讼", "2019年2020年重大诉讼情况", LITIGATION)], "t string, q string, p array<string>")
    r = information.classified(rows, "t", "q", "p").head()
    # Terms of 重大诉讼: three of two characters, two of three, one of four; the text holds 诉讼 alone, the title all 16 characters.
    assert (r.matched_concerns, r.content_score, r.path_score, r.concern_score) == (["litigation"], 100 + 3 * 2, 100 + 16, 100 + 3 * 2 + 16)


def test_terms_of_runs(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("What is A股 是否 it",), ("",), ("x",)], "q string")
    got = [sorted(r[0]) for r in rows.select(information.question_terms(F.col("q"))).collect()]
    assert got == [["a股", "is", "it", "what"], [], []]


def test_no_rows_and_extra_columns(spark):
    rows = spark.createDataFrame([], "t string, q string, p array<string>, reason string")
    out = information.classified(rows, "t", "q", "p")
    assert out.count() == 0 and len(set(out.columns)) == len(out.columns)
