"""Supplements: cells that may fill a missing fact, validated stage by stage, and their store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import parse, unit_of_label, unit_rule
from factloom.functions.text import let
from factloom.operators.selection import implausible
from factloom.operators.years import STATEMENTS, supplement_year

#: Words of a section that speak for figures of the company as a whole, or against them.
FINANCIAL_CONTEXT = ("财务", "会计", "主要会计数据", "财务指标", "资产负债", "利润", "现金流", "所有者权益", "股东权益", "营业收入", "股本", "每股收益")
MAIN_SCOPE = ("主要会计数据和财务指标", "主要会计数据", "主要财务指标", "合并资产负债表", "合并利润表", "合并现金流量表")
OTHER_SCOPE = (
    "分部信息", "分行业", "分地区", "分产品", "主要控股参股公司", "主要子公司", "重要子公司", "联营企业", "合营企业", "企业合并", "处置子公司", "非同一控制下", "母公司利润表", "母公司资产负债表",
    "母公司现金流量表", "资产构成重大变动", "按行业", "按地区", "按产品",
)
#: Points of a supplement's confidence, and the least that is accepted.
EXACT, PATTERN, ROW, COLUMN, EXPLICIT, RELATIVE = "0.32", "0.22", "0.25", "0.12", "0.25", "0.18"
CONTEXT, DIRECT_UNIT, HINTED_UNIT, COLUMN_UNIT, SCOPE_BONUS, SCOPE_MALUS, LOOKBACK = "0.10", "0.08", "0.05", "0.03", "0.12", "-0.30", "-0.05"
LEAST_CONFIDENCE = "0.70"
#: The code of each stage at which a cell can fail, and its place.
STAGES = (
    ("SUPPLEMENT_CELL_NOT_FOUND", 0), ("SUPPLEMENT_YEAR_UNRESOLVED", 1), ("SUPPLEMENT_UNIT_UNRESOLVED", 2), ("SUPPLEMENT_VALUE_INVALID", 3), ("SUPPLEMENT_ELIGIBILITY_REJECTED", 4), ("SUPPLEMENT_PROVENANCE_FAILED", 6),
)
#: Where a unit may stand, first the source that counts.
UNIT_SOURCES = ("raw_value", "row_label", "column_label", "unit_hint")


def _dec(x: str) -> Column:
    return F.lit(x).cast("decimal(6,4)")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def metric_source(aliases: Column, row_label: Column, column_label: Column) -> Column:
    """Where one of the metric's aliases stands: the row label before the column label, or null."""
    return F.when(F.array_contains(aliases, F.trim(row_label)), "row_label").when(F.array_contains(aliases, F.trim(column_label)), "column_label")


def unit_evidence(raw_unit: Column, row_label: Column, column_label: Column, hint: Column) -> Column:
    """struct<alias, source, units>: what all sources say; a unit stands only if they name one normalised unit."""
    found = F.array(*[F.struct(a.alias("alias"), F.lit(s).alias("source")) for a, s in zip((raw_unit, unit_of_label(row_label), unit_of_label(column_label), unit_of_label(hint)), UNIT_SOURCES)])

    def agreed(said: Column) -> Column:
        units = F.array_sort(F.array_distinct(F.transform(said, lambda x: unit_rule(x["alias"], 1))))
        one = F.when(F.size(units) == 1, F.get(said, F.lit(0)))
        return F.struct(one["alias"].alias("alias"), one["source"].alias("source"), units.alias("units"))

    return let(F.filter(found, lambda x: unit_rule(x["alias"], 1).isNotNull()), agreed)


def confidence(exact: Column, source: Column, year_confidence: Column, unit_source: Column, section: Column, context: Column, lookback: Column) -> Column:
    """Points between 0 and 1: how the metric, its year and its unit were found, and in what section."""
    points = F.when(exact, _dec(EXACT)).otherwise(_dec(PATTERN)) + F.when(source == "row_label", _dec(ROW)).otherwise(_dec(COLUMN)) + F.when(year_confidence == "high", _dec(EXPLICIT)).otherwise(_dec(RELATIVE))
    points = points + F.when(_any(section, FINANCIAL_CONTEXT), _dec(CONTEXT)).otherwise(_dec("0"))
    points = points + F.when(unit_source.isin("raw_value", "row_label"), _dec(DIRECT_UNIT)).when(unit_source == "unit_hint", _dec(HINTED_UNIT)).when(unit_source == "column_label", _dec(COLUMN_UNIT)).otherwise(_dec("0"))
    points = points + F.when(_any(context, MAIN_SCOPE), _dec(SCOPE_BONUS)).otherwise(_dec("0")) + F.when(_any(context, OTHER_SCOPE), _dec(SCOPE_MALUS)).otherwise(_dec("0")) + F.when(lookback, _dec(LOOKBACK)).otherwise(_dec("0"))
    return F.least(_dec("1"), F.greatest(_dec("0"), points)).cast("decimal(6,4)")


def provenance_matches(matrix: Column, row: Column, column: Column, raw: Column, row_label: Column, column_label: Column, same_source: Column) -> Column:
    """Whether value and labels stand in the table where the cell says, and cell, table and index name one source."""
    at = lambda r, c: F.coalesce(F.get(F.get(matrix, r), c), F.lit(""))
    inside = (row >= 0) & (column >= 0) & (row < F.size(matrix)) & (column < F.size(F.get(matrix, row)))
    text = lambda x: F.coalesce(x, F.lit(""))
    labels = (at(F.lit(0), column) == text(column_label)) & (at(row, F.lit(0)) == text(row_label))
    return F.coalesce(inside & (at(row, column) == raw) & labels & same_source, F.lit(False))


def validate(cells: DataFrame) -> DataFrame:
    """Cells with the first stage that fails, or accepted with value, confidence and statement.

    Columns: canonical_metric, aliases, normalized_unit, report_year, metric_year (what
    is asked for); row_index, col_index, raw_value, row_label, column_label, unit_hint,
    section (its path as text), caption, matrix, same_source (what is offered).
    """
    metric, row_label, column_label = F.col("canonical_metric"), F.col("row_label"), F.col("column_label")
    out = cells.withColumn("metric_source", metric_source(F.col("aliases"), row_label, column_label))
    out = out.withColumn("__year", supplement_year(metric, F.col("metric_source"), row_label, column_label, F.col("report_year"), F.col("metric_year")))
    out = out.withColumn("__number", parse(F.col("raw_value")))
    out = out.withColumn("__unit", unit_evidence(F.col("__number.raw_unit"), row_label, column_label, F.col("unit_hint")))
    alias, scale = F.col("__unit.alias"), F.coalesce(unit_rule(F.col("__unit.alias"), 2), F.lit("1")).cast("decimal(12,2)")
    out = out.withColumn("value", (F.col("__number.value").cast("decimal(26,12)") * scale).cast("decimal(38,12)"))
    fraction = alias.isin("人", "人数", "股") & (F.col("value") != F.floor("value"))
    context = F.concat_ws(" ", "section", "caption", "row_label", "column_label")
    points = confidence(F.lit(True), F.col("metric_source"), F.col("__year.year_confidence"), F.col("__unit.source"), F.coalesce("section", F.lit("")), context, F.col("metric_year") == F.col("report_year") - 2)
    out = out.withColumn("confidence_score", points)
    whole = provenance_matches(F.col("matrix"), F.col("row_index"), F.col("col_index"), F.col("raw_value"), row_label, column_label, F.col("same_source"))
    fails = (
        F.col("metric_source").isNull(), F.col("__year.error").isNotNull(), alias.isNull() | (unit_rule(alias, 1) != F.col("normalized_unit")),
        F.col("value").isNull() | fraction | implausible(metric, F.col("normalized_unit"), F.col("value")).isNotNull(), F.col("confidence_score") < _dec(LEAST_CONFIDENCE), ~whole,
    )
    code, stage = None, None
    for failed, (name, place) in zip(fails, STAGES):
        code, stage = (F if code is None else code).when(failed, name), (F if stage is None else stage).when(failed, place)
    out = out.withColumns({"code": code, "stage": stage, "accepted": code.isNull()})
    statement = F.create_map(*[F.lit(x) for kv in STATEMENTS.items() for x in kv])[metric]
    kept = {"value": F.when(F.col("accepted"), F.col("value")), "statement": F.when(F.col("accepted"), statement), "unit_source": F.col("__unit.source"), "year_error": F.col("__year.error")}
    return out.withColumns(kept).drop("__year", "__number", "__unit")


def decide(validated: DataFrame, keys: list[str]) -> DataFrame:
    """Per request: accepted if exactly one value was, ambiguous for several, else the code of the cell that came furthest."""
    own = validated.groupBy(*keys).agg(
        F.countDistinct(F.when(F.col("accepted"), F.col("value"))).alias("values"), F.max(F.when(F.col("accepted"), F.col("value"))).alias("value"),
        F.max_by("code", F.struct("stage", "code")).alias("code"),
    )
    status = F.when(F.col("values") == 1, "accepted").when(F.col("values") > 1, "ambiguous").otherwise("rejected")
    return own.select(*keys, status.alias("decision"), F.when(F.col("values") == 1, F.col("value")).alias("value"), F.when(F.col("values") == 0, F.col("code")).alias("code"))
