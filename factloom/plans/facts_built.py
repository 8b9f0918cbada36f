"""How facts come about: years of labels, supplements, coverage of metrics, the store with its integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import selection, supplements
from factloom.plans.register import registry
from factloom.plans.structured import _SELECTED_SQL, _built
from factloom.sources.tables import table
from factloom.sources.views import candidates

QUERIES, ORACLES, query = registry()

@query("implausible_values", """SELECT l_orderkey, l_linenumber, CASE l_orderkey % 4 WHEN 0 THEN CASE WHEN l_quantity * 1000000000000000 > 10000000000000000 THEN 'implausible_magnitude' END WHEN 1 THEN CASE WHEN l_quantity > 10 THEN 'implausible_ratio_magnitude' END
  WHEN 2 THEN CASE WHEN l_quantity * 5000 > 100000 THEN 'implausible_per_share_magnitude' END ELSE CASE WHEN 25 - l_quantity < 0 THEN 'negative_nonnegative_metric' END END AS reason FROM lineitem""")  # fmt: skip
def implausible_values(spark: SparkSession, sf: str) -> DataFrame:
    kind, q = F.pmod("l_orderkey", F.lit(4)), F.col("l_quantity").cast("decimal(20,0)")
    pick = lambda *xs: F.when(kind == 0, xs[0]).when(kind == 1, xs[1]).when(kind == 2, xs[2]).otherwise(xs[3])
    value = pick(q * 1_000_000_000_000_000, q, q * 5000, 25 - q)
    reason = selection.implausible(pick("营业收入", "加权平均净资产收益率", "基本每股收益", "总资产"), pick("元", "ratio", "元/股", "元"), value)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", reason.alias("reason"))


# --- supplements -------------------------------------------------------------------------------


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """A cell a line: flags decide what is wrong with it, the order asks for its revenue of 2020."""
    n = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(8))
    raw = F.when(n == 3, "不详").otherwise(F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))
    row_label = F.when(n == 1, "其他收入").otherwise("营业收入（万元）")
    column_label = F.when(n == 2, "2019年").otherwise("2020年")
    hint = F.when(n == 4, "单位：股").otherwise("单位：万元")
    section = F.when(n == 5, "分行业").otherwise("主要会计数据")
    matrix = F.array(F.array(F.lit("项目"), column_label), F.array(row_label, F.when(n == 6, "0").otherwise(raw)))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("cell"), n.alias("n"), F.lit("营业收入").alias("canonical_metric"), F.array(F.lit("营业收入"), F.lit("营业收入（万元）")).alias("aliases"), F.lit("元").alias("normalized_unit"),
        F.lit(2021).cast("long").alias("report_year"), F.lit(2020).cast("long").alias("metric_year"), F.lit(1).alias("row_index"), F.lit(1).alias("col_index"), raw.alias("raw_value"), row_label.alias("row_label"), column_label.alias("column_label"),
        hint.alias("unit_hint"), section.alias("section"), F.lit("").alias("caption"), matrix.alias("matrix"), (n != 7).alias("same_source"),
    )


_CELL_SQL = """cells AS (SELECT l_orderkey AS request, l_linenumber AS cell, (l_orderkey + l_linenumber) % 8 AS n, l_extendedprice::DECIMAL(12,2) AS v FROM lineitem),
  judged AS (SELECT *, [NULL, 'SUPPLEMENT_CELL_NOT_FOUND', 'SUPPLEMENT_YEAR_UNRESOLVED', 'SUPPLEMENT_VALUE_INVALID', 'SUPPLEMENT_UNIT_UNRESOLVED', 'SUPPLEMENT_ELIGIBILITY_REJECTED', 'SUPPLEMENT_PROVENANCE_FAILED', 'SUPPLEMENT_PROVENANCE_FAILED'][n + 1] AS code,
    [NULL, 0, 1, 3, 2, 4, 6, 6][n + 1] AS stage, CASE WHEN n = 0 THEN (v * 10000)::DECIMAL(38,12) END AS value FROM cells)"""


@query("supplement_validation", f"WITH {_CELL_SQL} SELECT request, cell, code, stage::INTEGER AS stage, value::VARCHAR AS value, CASE n WHEN 0 THEN '1.0000' END AS confidence FROM judged")
def supplement_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence of accepted cells: alias 0.32, row 0.25, year 0.25, section 0.10, unit 0.08, scope 0.12, cut at 1."""
    out = supplements.validate(_cells(spark, sf))
    return out.select("request", "cell", "code", "stage", F.col("value").cast("string").alias("value"), F.when(F.col("accepted"), F.col("confidence_score").cast("string")).alias("confidence"))


@query("supplement_decisions", f"""WITH {_CELL_SQL}, d AS (SELECT request, count(DISTINCT value) AS k, max(value) AS value, arg_max(code, (stage, code)) FILTER (WHERE code IS NOT NULL) AS code FROM judged GROUP BY request)
  SELECT request, CASE WHEN k = 1 THEN 'accepted' WHEN k > 1 THEN 'ambiguous' ELSE 'rejected' END AS decision, CASE WHEN k = 1 THEN value::VARCHAR END AS value, CASE WHEN k = 0 THEN code END AS code FROM d""")  # fmt: skip
def supplement_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return supplements.decide(supplements.validate(_cells(spark, sf)), ["request"]).withColumn("value", F.col("value").cast("string"))


@query("supplement_confidence", """SELECT l_linenumber, greatest(0, least(1, CASE WHEN l_returnflag = 'R' THEN 0.32 ELSE 0.22 END + CASE WHEN l_linestatus = 'O' THEN 0.25 ELSE 0.12 END + CASE WHEN l_linenumber % 2 = 0 THEN 0.25 ELSE 0.18 END + CASE WHEN l_linenumber % 3 = 0 THEN 0.10 ELSE 0 END
    + [0.08, 0.08, 0.03, 0.05][l_linenumber % 4 + 1] + CASE WHEN l_linenumber % 5 = 0 THEN 0.12 ELSE 0 END - CASE WHEN l_linenumber = 7 THEN 0.30 ELSE 0 END))::DECIMAL(6,4)::VARCHAR AS confidence, count(*) AS n FROM lineitem GROUP BY ALL""")  # fmt: skip
def supplement_confidence(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    source = F.element_at(F.array(*map(F.lit, supplements.UNIT_SOURCES)), (F.pmod(n, F.lit(4)) + 1).cast("int"))
    context = F.concat_ws(" ", F.when(n % 5 == 0, "主要财务指标"), F.when(n == 7, "分地区"))
    points = supplements.confidence(F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "O", "row_label").otherwise("column_label"), F.when(n % 2 == 0, "high").otherwise("medium"), source, F.when(n % 3 == 0, "财务报告").otherwise("公司概况"), context, F.lit(False))
    return table(spark, sf, "lineitem").groupBy("l_linenumber", points.cast("string").alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


# --- coverage and the store --------------------------------------------------------------------


@query("metric_coverage", _SELECTED_SQL + """, m(canonical_metric) AS (VALUES ('营业收入'), ('未知指标'), ('总资产')), c AS (SELECT canonical_metric, count(*) AS candidates, count(*) FILTER (WHERE len(reasons) = 0) AS eligible FROM audited GROUP BY 1),
  f AS (SELECT canonical_metric, count(*) AS facts, count(*) FILTER (WHERE is_selected) AS selected, count(DISTINCT CASE WHEN is_selected THEN document_id END) AS documents FROM final GROUP BY 1)
  SELECT canonical_metric, coalesce(candidates, 0) AS candidates, coalesce(eligible, 0) AS eligible, coalesce(facts, 0) AS facts, coalesce(selected, 0) AS selected, coalesce(documents, 0) AS documents FROM m LEFT JOIN c USING (canonical_metric) LEFT JOIN f USING (canonical_metric)""")  # fmt: skip
def metric_coverage(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame([("营业收入",), ("未知指标",), ("总资产",)], "canonical_metric string")
    return selection.metric_coverage(names, selection.audit(candidates(spark, sf)), _built(spark, sf))
