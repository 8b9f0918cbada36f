"""The formula catalogue: operands are year-shifted fact lookups, results carry a status.

All formulas of a request table run in one plan: the facts of an entity that formulas
name, one per metric and year, are one row, in which each request looks up its operands.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Formula:
    formula_id: str
    operator: str
    operands: tuple[tuple[str, str, int], ...]  # role, metric, years back as an offset


#: The catalogue, by formula id in its order: the operator, then the metrics of its operands. Growth takes a
#: metric in the target year and the year before; a simple ratio a numerator and a denominator.
GROWTH = (
    ("revenue_growth_rate.v1", "营业收入"), ("total_assets_growth_rate.v1", "总资产"), ("net_assets_growth_rate.v1", "净资产"),
    ("parent_net_profit_growth_rate.v1", "归属于上市公司股东的净利润"), ("sales_expense_growth_rate.v1", "销售费用"), ("operating_profit_growth_rate.v1", "营业利润"),
    ("administrative_expense_growth_rate.v1", "管理费用"), ("current_liabilities_growth_rate.v1", "流动负债"), ("intangible_assets_growth_rate.v1", "无形资产"),
    ("financial_expense_growth_rate.v1", "财务费用"), ("rd_expense_growth_rate.v1", "研发费用"), ("net_profit_growth_rate.v1", "净利润"),
    ("total_liabilities_growth_rate.v1", "总负债"), ("cash_growth_rate.v1", "货币资金"), ("investment_income_growth_rate.v1", "投资收益"),
    ("fixed_assets_growth_rate.v1", "固定资产"), ("cash_equivalents_growth_rate.v1", "现金及现金等价物"),
)
RATIOS = (
    ("operating_cost_ratio.v1", "营业成本", "营业收入"), ("investment_income_revenue_ratio.v1", "投资收益", "营业收入"), ("administrative_expense_ratio.v1", "管理费用", "营业收入"),
    ("financial_expense_ratio.v1", "财务费用", "营业收入"), ("operating_margin.v1", "营业利润", "营业收入"), ("net_profit_margin.v1", "净利润", "营业收入"),
    ("current_ratio.v1", "流动资产", "流动负债"), ("cash_ratio.v1", "货币资金", "流动负债"), ("debt_asset_ratio.v1", "总负债", "总资产"),
    ("current_liabilities_ratio.v1", "流动负债", "总负债"), ("noncurrent_liabilities_ratio.v1", "非流动负债", "总负债"), ("rd_revenue_ratio.v1", "研发费用", "营业收入"),
    ("rd_profit_ratio.v1", "研发费用", "净利润"), ("rd_staff_ratio.v1", "研发人员数", "职工总数"),
)
SPECIAL = (
    ("gross_margin.v1", "gross_margin", (("revenue", "营业收入", 0), ("cost", "营业成本", 0))),
    ("quick_ratio.v1", "quick_ratio", (("current_assets", "流动资产", 0), ("inventory", "存货", 0), ("denominator", "流动负债", 0))),
    ("three_expense_ratio.v1", "three_expense_ratio", (("sales", "销售费用", 0), ("administrative", "管理费用", 0), ("financial", "财务费用", 0), ("denominator", "营业收入", 0))),
    ("rd_expense_share.v1", "rd_expense_share", (("rd", "研发费用", 0), ("sales", "销售费用", 0), ("financial", "财务费用", 0), ("administrative", "管理费用", 0))),
    ("postgraduate_staff_ratio.v1", "postgraduate_staff_ratio", (("master", "硕士人数", 0), ("doctor", "博士及以上人数", 0), ("denominator", "职工总数", 0))),
)
CATALOGUE: dict[str, Formula] = {
    f.formula_id: f
    for f in (
        *(Formula(i, "growth", (("current", m, 0), ("previous", m, -1))) for i, m in GROWTH),
        *(Formula(i, "simple_ratio", (("numerator", a, 0), ("denominator", b, 0))) for i, a, b in RATIOS),
        *(Formula(*x) for x in SPECIAL),
    )
}

#: Operator -> (numerator, denominator) from a function that gives a role's value.
OPERATORS = {
    "growth": lambda v: (v("current") - v("previous"), v("previous")),
    "simple_ratio": lambda v: (v("numerator"), v("denominator")),
    "gross_margin": lambda v: (v("revenue") - v("cost"), v("revenue")),
    "quick_ratio": lambda v: (v("current_assets") - v("inventory"), v("denominator")),
    "three_expense_ratio": lambda v: (v("sales") + v("administrative") + v("financial"), v("denominator")),
    "rd_expense_share": lambda v: (v("rd"), v("sales") + v("financial") + v("administrative") + v("rd")),
    "postgraduate_staff_ratio": lambda v: (v("master") + v("doctor"), v("denominator")),
}


def divide(numerator: Column, denominator: Column, places: int = 12) -> Column:
    """Decimal division to ``places`` places: operands are narrowed first, or Spark would keep six.

    Operands keep twelve decimals where they have at most 14 and 12 digits before the
    point, ten otherwise.
    """

    def narrow(top: str, base: str) -> Column:
        b = denominator.try_cast(base)
        return (numerator.try_cast(top) / F.nullif(b, F.lit(0).cast(base))).cast(f"decimal(38,{places})")

    return F.coalesce(narrow("decimal(26,12)", "decimal(24,12)"), narrow("decimal(26,10)", "decimal(25,10)"))


def evaluate(requests: DataFrame, facts: DataFrame, entity: str = "stock_code") -> DataFrame:
    """Requests (entity, formula_id, target_year) with value, status and code.

    ``found``; ``blocked`` with FORMULA_ZERO_DENOMINATOR or FACT_UNRESOLVED_CONFLICT
    where several facts answer one operand; ``fallback_required`` with
    FORMULA_OPERAND_MISSING; ``unsupported`` for an unknown formula. A negative
    base keeps its sign in a growth rate.
    """
    operand = lambda f: F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(o).alias("shift")) for _, m, o in f.operands])
    known = F.create_map(*[x for k, f in CATALOGUE.items() for x in (F.lit(k), operand(f))])
    key = lambda metric, year: F.concat_ws("|", metric, year.cast("string"))
    used = facts.filter(F.col("canonical_metric").isin(sorted({m for f in CATALOGUE.values() for _, m, _ in f.operands})) & F.col("metric_year").isNotNull())
    found = used.groupBy(entity, "canonical_metric", "metric_year").agg(F.count(F.lit(1)).alias("n"), F.first("normalized_value").alias("v"))
    entry = F.struct(key(F.col("canonical_metric"), F.col("metric_year")), F.struct("n", "v"))
    held = found.groupBy(entity).agg(F.map_from_entries(F.collect_list(entry)).alias("held"))
    asked = requests.select(entity, "formula_id", "target_year").repartition(entity).dropDuplicates([entity, "formula_id", "target_year"])
    rows = asked.join(held, entity, "left").withColumn("o", F.coalesce(known[F.col("formula_id")], F.array().cast("array<struct<metric:string,shift:int>>")))
    rows = rows.select(entity, "formula_id", "target_year", F.transform("o", lambda o: F.try_element_at("held", key(o["metric"], F.col("target_year") + o["shift"]))).alias("got"))
    roles = {f.operator: [r for r, _, _ in f.operands] for f in CATALOGUE.values()}
    top, base = None, None
    for name, operator in OPERATORS.items():
        a, b = operator(lambda r: F.get("got", F.lit(roles[name].index(r)))["v"])
        mine = F.col("formula_id").isin([f.formula_id for f in CATALOGUE.values() if f.operator == name])
        top, base = (F if top is None else top).when(mine, a.cast("decimal(38,12)")), (F if base is None else base).when(mine, b.cast("decimal(38,12)"))
    folded = rows.withColumns({
        "top": top, "base": base, "operands": F.size("got"), "missing": F.size(F.filter("got", lambda x: x.isNull())), "conflicts": F.size(F.filter("got", lambda x: x["n"] > 1)),
    })
    code = (
        F.when(F.col("operands") == 0, "METRIC_UNRECOGNIZED").when(F.col("conflicts") > 0, "FACT_UNRESOLVED_CONFLICT")
        .when(F.col("missing") > 0, "FORMULA_OPERAND_MISSING").when(F.col("base") == 0, "FORMULA_ZERO_DENOMINATOR")
    )
    out = folded.withColumn("code", code)
    status = (
        F.when(F.col("code").isNull(), "found").when(F.col("code") == "METRIC_UNRECOGNIZED", "unsupported")
        .when(F.col("code") == "FORMULA_OPERAND_MISSING", "fallback_required").otherwise("blocked")
    )
    value = F.when(F.col("code").isNull(), divide(F.col("top"), F.col("base")))
    return out.select(entity, "formula_id", "target_year", value.alias("value"), status.alias("status"), "code")
