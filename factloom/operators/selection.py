"""From metric candidates to facts: audit, score, representative values, conflict rules, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units that a metric may have.
ALLOWED_UNITS = {
    "营业收入": ("元",), "归属于上市公司股东的净利润": ("元",), "扣除非经常性损益后的净利润": ("元",), "总资产": ("元",), "净资产": ("元",), "股本": ("元", "股"),
    "经营活动产生的现金流量净额": ("元",), "基本每股收益": ("元/股",), "稀释每股收益": ("元/股",), "加权平均净资产收益率": ("ratio",),
}
#: Points of a candidate's confidence, and the thresholds of the selection.
POINTS = {
    "metric_match_type": ({"exact_alias": "0.32"}, "0.22"), "metric_source": ({"row_label": "0.25"}, "0.12"), "year_confidence": ({"high": "0.25"}, "0.18"),
    "unit_source": ({"raw_value": "0.08", "row_label": "0.08", "unit_hint": "0.05", "column_label": "0.03"}, "0"),
}
FINANCIAL_CONTEXT, TWO_YEARS_BACK = "0.10", "-0.05"
HIGH, MEDIUM = "0.85", "0.70"
LEAST_SINGLE, LEAST_CONFLICT, MARGIN, SUPPORTED_MARGIN = "0.70", "0.95", "0.12", "0.05"
SUPPORT_STEP, SUPPORT_MOST = "0.01", "0.04"

#: What makes two candidates rivals.
DIMENSIONS = ["document_id", "stock_code", "metric_year", "statement", "canonical_metric", "normalized_unit"]


def _dec(x: str) -> Column:
    return F.lit(x).cast("decimal(6,4)")


def implausible(metric: Column, unit: Column, value: Column) -> Column:
    """The reason why a value cannot be, or null."""
    size = F.abs(value)
    return (
        F.when(unit.isin("元", "股") & (size > F.lit("10000000000000000").cast("decimal(20,0)")), "implausible_magnitude")
        .when((metric == "加权平均净资产收益率") & (size > 10), "implausible_ratio_magnitude")
        .when(metric.isin("基本每股收益", "稀释每股收益") & (size > 100000), "implausible_per_share_magnitude")
        .when(metric.isin("总资产", "股本") & (value < 0), "negative_nonnegative_metric")
    )


def audit(candidates: DataFrame) -> DataFrame:
    """Candidates with their rejection reasons, in diagnostic order and once each, and ``eligible``."""
    metric, unit, value = F.col("canonical_metric"), F.col("normalized_unit"), F.col("normalized_value")
    year, report = F.col("metric_year"), F.col("report_year")
    allowed = F.create_map(*[x for m, us in ALLOWED_UNITS.items() for x in (F.lit(m), F.array(*map(F.lit, us)))])
    reasons = F.array(
        F.when(year > report, "future_metric_year").when(year < report - 2, "metric_year_outside_three_year_window"),
        F.when(value.isNull(), "not_parsed_numeric"),
        F.when(F.coalesce(allowed[metric].isNull(), F.lit(True)), "unsupported_canonical_metric").when(~F.array_contains(allowed[metric], F.coalesce(unit, F.lit(""))), "missing_or_incompatible_unit"),
        implausible(metric, unit, value),
    )
    out = candidates.withColumn("rejection_reasons", F.array_distinct(F.array_compact(reasons)))
    return out.withColumn("eligible", F.size("rejection_reasons") == 0)


def score(candidates: DataFrame) -> DataFrame:
    """Adds ``confidence_score``, a decimal between 0 and 1, and its label."""
    total = _dec("0")
    for column, (points, rest) in POINTS.items():
        case = None
        for value, x in points.items():
            case = (F if case is None else case).when(F.col(column) == value, _dec(x))
        total = total + case.otherwise(_dec(rest))
    total = total + F.when(F.col("context_is_financial"), _dec(FINANCIAL_CONTEXT)).otherwise(_dec("0"))
    total = total + F.when(F.col("metric_year") == F.col("report_year") - 2, _dec(TWO_YEARS_BACK)).otherwise(_dec("0"))
    out = candidates.withColumn("confidence_score", F.least(_dec("1"), F.greatest(_dec("0"), total)).cast("decimal(6,4)"))
    return out.withColumn("confidence", label(F.col("confidence_score")))


def label(points: Column) -> Column:
    return F.when(points >= _dec(HIGH), "high").when(points >= _dec(MEDIUM), "medium").otherwise("low")


def build_facts(scored: DataFrame, dimensions: list[str] = DIMENSIONS) -> DataFrame:
    """One row per group and distinct value, with support, score and selection.

    Both steps are aggregates: candidates collapse to values before anything is
    ordered, so that a window only sees the distinct values of its group.
    """
    best = F.min_by(F.struct("candidate_id", "confidence_score"), F.struct(-F.col("confidence_score"), F.col("candidate_id")))
    values = scored.groupBy(*dimensions, "normalized_value").agg(best.alias("best"), F.count(F.lit(1)).alias("support_count"))
    bonus = F.least(_dec(SUPPORT_MOST), ((F.col("support_count") - 1) * _dec(SUPPORT_STEP)).cast("decimal(18,4)"))
    values = values.select(
        *dimensions, "normalized_value", "support_count", F.col("best.candidate_id").alias("source_candidate_id"),
        F.least(_dec("1"), F.col("best.confidence_score") + bonus).cast("decimal(6,4)").alias("confidence_score"),
        F.md5(F.concat_ws("|", *[F.col(d).cast("string") for d in dimensions], F.col("normalized_value").cast("string"))).alias("fact_id"),
    )
    group = Window.partitionBy(*dimensions)
    ranked = group.orderBy(F.col("confidence_score").desc(), F.col("support_count").desc(), F.col("fact_id"))
    values = values.withColumns({
        "place": F.row_number().over(ranked), "distinct_values": F.count(F.lit(1)).over(group),
        "second_score": F.lead("confidence_score").over(ranked), "second_support": F.lead("support_count").over(ranked),
    })
    margin = F.col("confidence_score") - F.col("second_score")
    supported = (F.col("support_count") >= 2) & (F.col("second_support") == 1) & (margin >= _dec(SUPPORTED_MARGIN))
    wins = (F.col("confidence_score") >= _dec(LEAST_CONFLICT)) & ((margin >= _dec(MARGIN)) | supported)
    single = F.col("distinct_values") == 1
    chosen = (F.col("place") == 1) & F.when(single, F.col("confidence_score") >= _dec(LEAST_SINGLE)).otherwise(F.coalesce(wins, F.lit(False)))
    values = values.withColumn("is_selected", chosen)
    decided = F.max("is_selected").over(group)
    status = (
        F.when(single, F.when(F.col("is_selected"), "selected_single_value").otherwise("low_confidence"))
        .when(F.col("is_selected"), "resolved_by_confidence")
        .when(decided, "not_selected_conflict")
        .otherwise("unresolved_conflict")
    )
    return values.withColumns({"has_conflict": ~single, "selection_status": status}).drop("place", "second_score", "second_support")


def conflict_groups(facts: DataFrame, dimensions: list[str] = DIMENSIONS) -> DataFrame:
    """Groups with several values: how many, from how many candidates, and what was selected."""
    own = facts.filter("has_conflict").groupBy(*dimensions)
    return own.agg(
        F.count(F.lit(1)).alias("distinct_value_count"), F.sum("support_count").alias("candidate_count"), F.max(F.when(F.col("is_selected"), F.col("fact_id"))).alias("selected_fact_id")
    )


def metric_coverage(metrics: DataFrame, candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """Per metric of the catalogue: candidates, those eligible, facts, those selected, documents with a selected fact."""
    c = candidates.groupBy("canonical_metric").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("eligible").alias("eligible"))
    f = facts.groupBy("canonical_metric").agg(F.count(F.lit(1)).alias("facts"), F.count_if("is_selected").alias("selected"), F.countDistinct(F.when(F.col("is_selected"), F.col("document_id"))).alias("documents"))
    out = metrics.select("canonical_metric").distinct().join(c, "canonical_metric", "left").join(f, "canonical_metric", "left")
    return out.fillna(0)


def integrity(facts: DataFrame, dimensions: list[str] = DIMENSIONS) -> DataFrame:
    """One row: facts, distinct ids, and groups with more than one selected fact."""
    groups = facts.groupBy(*dimensions).agg(F.count_if("is_selected").alias("n")).agg(F.count_if(F.col("n") > 1).alias("groups_selected_twice"))
    return facts.agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("fact_id").alias("fact_ids")).crossJoin(groups)  # one row each
