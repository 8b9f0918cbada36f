"""Which year a value belongs to: ordered rules over the label that names its period."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import let, normalise

#: Metrics of a whole year and metrics of a day, and their statements.
DURATION_METRICS = ("营业收入", "归属于上市公司股东的净利润", "扣除非经常性损益后的净利润", "经营活动产生的现金流量净额", "基本每股收益", "稀释每股收益", "加权平均净资产收益率")
INSTANT_METRICS = ("总资产", "净资产", "股本")
STATEMENTS = {
    "营业收入": "income_statement", "归属于上市公司股东的净利润": "income_statement", "扣除非经常性损益后的净利润": "income_statement", "总资产": "balance_sheet", "净资产": "balance_sheet",
    "股本": "balance_sheet", "经营活动产生的现金流量净额": "cash_flow_statement", "基本每股收益": "financial_indicator", "稀释每股收益": "financial_indicator", "加权平均净资产收益率": "financial_indicator",
}
#: What the labels of periods look like.
COMPARISON = "同比|环比|增减|增长|下降|变动|比例|比上|较上|差异|占比"
QUARTER = r"季度|半年度|半年|[1-4一二三四]季|\d+\s*[-至]\s*\d+\s*月"
YEAR = r"(?<!\d)((?:19|20)\d{2})(?!\d)"
CURRENT = "本报告期|报告期|本年度|本年|本期|期末|年末"
PREVIOUS = "上年度|上年|上期|期初|年初"
OPENING_DATE = "(?:1月1日|01月01日|01-01|年初|期初)"
YEAR_END_DATE = "(?:12月31日|12-31|年末|期末)"
MONTH_OR_DAY = r"\d{1,2}\s*月|\d{1,2}\s*日|\d{1,2}[-/]\d{1,2}"
#: Fixed value: report year and the two before it.
WINDOW_YEARS = 2


def resolve_year(metric: Column, source: Column, row_label: Column, column_label: Column, report_year: Column) -> Column:
    """struct<period_label, metric_year, year_resolution, year_confidence, error>.

    The label across from the metric names the period. Rules apply in order, the
    first that fits decides: what makes a label useless, then a year written out (for
    day metrics moved by opening dates), then a word for the previous or the current
    year; last the three-year window. An error keeps the year that it is about.
    """
    across = normalise(F.when(source == "row_label", column_label).otherwise(row_label))
    return let(across, lambda label: let(F.array_distinct(F.transform(F.regexp_extract_all(label, F.lit(YEAR), F.lit(1)), lambda y: y.cast("long"))), lambda years: _resolved(metric, label, years, report_year)))


def _resolved(metric: Column, label: Column, years: Column, report_year: Column) -> Column:
    lasting, instant = metric.isin(*DURATION_METRICS), metric.isin(*INSTANT_METRICS)
    written = F.get(years, F.lit(0))
    dated, opening = instant & label.rlike(MONTH_OR_DAY), label.rlike(OPENING_DATE)
    useless = (
        F.when(report_year.isNull(), "invalid_report_year").when(label == "", "missing_period_label").when(label.rlike(COMPARISON), "comparison_or_change_column").when(label.rlike(QUARTER), "partial_period_or_quarter")
        .when(lasting & (label.rlike(MONTH_OR_DAY) | label.contains("至")), "partial_duration_date").when(F.size(years) > 1, "ambiguous_multiple_years")
        .when(written.isNotNull() & dated & ~opening & ~label.rlike(YEAR_END_DATE), "non_standard_balance_date").when(written.isNull() & ~label.rlike(PREVIOUS) & ~label.rlike(CURRENT), "unresolved_metric_year")
    )
    how = (
        F.when(written.isNotNull() & dated, F.when(opening, "explicit_opening_date").otherwise("explicit_year_end_date")).when(written.isNotNull() & instant & label.rlike("年初|期初"), "explicit_opening_period")
        .when(written.isNotNull(), "explicit_year").when(label.rlike(PREVIOUS), "relative_previous").otherwise("relative_current")
    )
    return let(F.struct(useless.alias("useless"), how.alias("how")), lambda x: _dated(label, x["useless"], x["how"], written, report_year))


def _dated(label: Column, useless: Column, how: Column, written: Column, report_year: Column) -> Column:
    year = F.when(how.isin("explicit_opening_date", "explicit_opening_period"), written - 1).when(how.startswith("explicit"), written).when(how == "relative_previous", report_year - 1).otherwise(report_year)
    late = F.when(year > report_year, "future_metric_year").when(year < report_year - WINDOW_YEARS, "metric_year_outside_three_year_window")
    fine = useless.isNull()
    return F.struct(
        label.alias("period_label"), F.when(fine, year).cast("long").alias("metric_year"), F.when(fine, how).alias("year_resolution"),
        F.when(fine, F.when(how.startswith("explicit"), "high").otherwise("medium")).alias("year_confidence"), F.coalesce(useless, late).alias("error"),
    )


def candidate_year(metric: Column, source: Column, row_label: Column, column_label: Column, report_year: Column) -> Column:
    """The same rules where a doubtful year is no year: the year, or null with any error."""
    return let(resolve_year(metric, source, row_label, column_label, report_year), lambda found: F.when(found["error"].isNull(), found["metric_year"]))


def supplement_year(metric: Column, source: Column, row_label: Column, column_label: Column, report_year: Column, wanted: Column) -> Column:
    """The same rules for a wanted year: both ends of the window are one error, another year is a mismatch."""

    def judged(found: Column) -> Column:
        error = F.when(found["error"] == "future_metric_year", "metric_year_outside_three_year_window").otherwise(found["error"])
        return F.struct(found["metric_year"].alias("metric_year"), found["year_confidence"].alias("year_confidence"), F.coalesce(error, F.when(found["metric_year"] != wanted, "metric_year_mismatch")).alias("error"))

    return let(resolve_year(metric, source, row_label, column_label, report_year), judged)
