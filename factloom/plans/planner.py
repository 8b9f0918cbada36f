"""From a question to DataFrames: analysis, scope, pattern, execution, composition.

The planner is plain Python on the driver and handles a question's text only;
all data stays in DataFrames. Patterns and their limits are this engine's own
choice, as the reference's registry file is not part of its published tree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import facts as fact_ops
from factloom.operators import formulas
from factloom.sources.views import UNIT

#: Boundaries of a plan.
MOST_COMPANIES, MOST_YEARS, MOST_SUBPLANS = 5, 5, 12
#: The order in which a failed status decides a composed answer.
PRECEDENCE = ("error", "blocked", "ambiguous", "unsupported", "fallback_required", "not_found")

#: Formula names in questions.
FORMULA_NAMES = {"营业收入增长率": "revenue_growth_rate.v1", "总资产增长率": "total_assets_growth_rate.v1", "毛利率": "gross_margin.v1", "营业成本率": "operating_cost_ratio.v1", "管理费用率": "administrative_expense_ratio.v1"}
METRIC_NAMES = {"营业收入": "营业收入", "营收": "营业收入", "营业成本": "营业成本", "总资产": "总资产", "资产总额": "总资产", "销售费用": "销售费用", "管理费用": "管理费用"}
_RANK = re.compile(r"(最高|最低|最大|最小)(?:的)?(?:前)?(\d+)?")
_AGGREGATE = {"合计": "sum", "总和": "sum", "平均": "average", "多少家": "count"}
#: The pattern that a question's parts decide.
PATTERNS = ("rank", "aggregate", "formula", "formula_comparison", "fact", "fact_series", "fact_comparison", "metadata", "unsupported")


@dataclass
class Analysis:
    question: str
    metrics: list[str] = field(default_factory=list)
    formulas: list[str] = field(default_factory=list)
    years: list[int] = field(default_factory=list)
    codes: list[str] = field(default_factory=list)
    direction: str | None = None
    limit: int = 1
    operator: str | None = None


def _longest(text: str, names: dict[str, str]) -> list[str]:
    """Values of the names in a text, longest match first, no overlaps, in the order of the text."""
    taken: list[tuple[int, int, str]] = []
    for name in sorted(names, key=len, reverse=True):
        for m in re.finditer(re.escape(name), text):
            if all(m.end() <= a or m.start() >= b for a, b, _ in taken):
                taken.append((m.start(), m.end(), names[name]))
    return list(dict.fromkeys(v for _, _, v in sorted(taken)))


def analyse(question: str) -> Analysis:
    a = Analysis(question, years=sorted({int(y) for y in re.findall(r"(?<!\d)((?:19|20)\d{2})(?!\d)", question)}), codes=sorted(set(re.findall(r"(?<!\d)\d{9}(?!\d)", question))))
    a.formulas = _longest(question, FORMULA_NAMES)
    rest = question
    for name in sorted(FORMULA_NAMES, key=len, reverse=True):
        rest = rest.replace(name, " ")
    a.metrics = _longest(rest, METRIC_NAMES)
    rank = _RANK.search(question)
    if rank:
        a.direction, a.limit = ("desc" if rank[1] in ("最高", "最大") else "asc"), int(rank[2] or 1)
    a.operator = next((v for k, v in _AGGREGATE.items() if k in question), None)
    return a


def pattern(a: Analysis) -> str:
    if a.formulas and a.codes:
        return "formula" if len(a.codes) == 1 else "formula_comparison"
    if a.metrics and a.direction and a.years:
        return "rank"
    if a.metrics and a.operator and a.years:
        return "aggregate"
    if a.metrics and a.codes and a.years:
        return "fact_comparison" if len(a.codes) > 1 else "fact_series" if len(a.years) > 1 else "fact"
    if a.codes and not a.metrics and not a.formulas:
        return "metadata"
    return "unsupported"


def check_boundaries(a: Analysis) -> None:
    if len(a.codes) > MOST_COMPANIES or len(a.years) > MOST_YEARS or len(a.codes or [0]) * len(a.years or [0]) > MOST_SUBPLANS or a.limit > fact_ops.MOST_RANKED:
        raise ValueError("the question asks for more than a plan may hold")


def dominant(statuses: list[str]) -> str:
    """The failed status that decides, or ``found``."""
    return next((s for s in PRECEDENCE if s in statuses), "found")


class Engine:
    """Answers questions from facts and companies; every answer is a lazy DataFrame of one shape."""

    def __init__(self, facts: DataFrame, companies: DataFrame):
        self.facts, self.companies = facts, companies

    def answer(self, question: str) -> DataFrame:
        return self.answer_all([question])

    def answer_all(self, questions: list[str]) -> DataFrame:
        """All questions in one plan: those of a kind form a table that meets the facts once, however many they are."""
        spark = self.facts.sparkSession
        ranks, sums, asked_formulas, asked_facts, codes, rest = [], [], [], [], [], []
        kinds: dict[str, str] = {}
        for q in dict.fromkeys(questions):
            a = analyse(q)
            kind = kinds[q] = pattern(a)
            try:
                check_boundaries(a)
            except ValueError:
                kinds[q] = "unsupported"
                rest.append((q, "blocked"))
                continue
            if kind == "rank":
                spec = fact_ops.QuerySpec("rank", a.metrics[0], a.years[0], UNIT, order_direction=a.direction, limit=a.limit)
                ranks.append((q, spec.canonical_metric, spec.metric_year, -1 if spec.order_direction == "desc" else 1, spec.limit))
            elif kind == "aggregate":
                spec = fact_ops.QuerySpec("aggregate", a.metrics[0], a.years[0], UNIT, aggregate_operator=a.operator)
                sums.append((q, spec.canonical_metric, spec.metric_year, spec.aggregate_operator))
            elif kind.startswith("formula"):
                asked_formulas += [(q, c, f, y) for c in a.codes for f in a.formulas for y in (a.years or [0])]
            elif kind.startswith("fact"):
                asked_facts += [(q, c, m, y) for c in a.codes for m in a.metrics for y in a.years]
            elif kind == "metadata":
                codes += [(q, c) for c in a.codes]
            else:
                rest.append((q, "unsupported"))
        parts = []
        value = F.col("normalized_value")
        facts = self.facts.filter(F.col("normalized_unit") == UNIT)
        if ranks:
            specs = spark.createDataFrame(ranks, "question string, canonical_metric string, metric_year long, sign int, wanted int")
            met = facts.join(specs, ["canonical_metric", "metric_year"])
            order = Window.partitionBy("question").orderBy((value * F.col("sign")).asc(), *fact_ops.RANK_TIES)
            top = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= fact_ops.MOST_RANKED).filter(F.col("rank") <= F.col("wanted"))
            parts.append(top.select("question", "rank", "stock_code", F.col("canonical_metric").alias("metric"), "metric_year", value.cast("decimal(38,4)").cast("string").alias("value")))
        if sums:
            specs = spark.createDataFrame(sums, "question string, canonical_metric string, metric_year long, operator string")
            own = facts.join(specs, ["canonical_metric", "metric_year"]).groupBy("question", "canonical_metric", "metric_year", "operator")
            own = own.agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
            mean = fact_ops.exact_mean(F.col("s"), F.col("n")).cast("decimal(38,16)")
            out = F.when(F.col("operator") == "sum", F.col("s").cast("string")).when(F.col("operator") == "count", F.col("n").cast("decimal(38,4)").cast("string")).otherwise(mean.cast("string"))
            parts.append(own.select("question", F.col("canonical_metric").alias("metric"), "metric_year", out.alias("value")))
        if asked_formulas:
            asked = spark.createDataFrame(asked_formulas, "question string, stock_code string, formula_id string, target_year long")
            known = formulas.evaluate(asked.drop("question").distinct(), self.facts)
            got = asked.join(known, ["stock_code", "formula_id", "target_year"])
            parts.append(got.select("question", "stock_code", F.col("formula_id").alias("metric"), F.col("target_year").alias("metric_year"), F.col("value").cast("string"), "status"))
        if asked_facts:
            asked = spark.createDataFrame(asked_facts, "question string, stock_code string, canonical_metric string, metric_year long")
            text = F.min(value.cast("decimal(38,4)").cast("string"))
            found = self.facts.groupBy("stock_code", "canonical_metric", "metric_year").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) == 1, text).alias("value"))
            status = F.when(F.col("n").isNull(), "not_found").when(F.col("n") == 1, "found").otherwise("ambiguous")
            got = asked.join(found, ["stock_code", "canonical_metric", "metric_year"], "left")
            parts.append(got.select("question", "stock_code", F.col("canonical_metric").alias("metric"), "metric_year", "value", status.alias("status")))
        if codes:
            named = spark.createDataFrame(codes, "question string, stock_code string").join(self.companies, "stock_code")
            parts.append(named.select("question", "stock_code", F.lit("company").alias("metric"), F.col("company").alias("value")))
        if rest or not parts:
            parts.append(spark.createDataFrame(rest, "question string, status string"))
        pattern_of = F.create_map(*[x for q, k in kinds.items() for x in (F.lit(q), F.lit(k))]) if kinds else F.lit(None)
        out = None
        for rows in parts:
            for name, type_ in (("rank", "long"), ("stock_code", "string"), ("metric", "string"), ("metric_year", "long"), ("value", "string"), ("status", "string")):
                if name not in rows.columns:
                    rows = rows.withColumn(name, F.lit(None).cast(type_))
            kind = pattern_of[F.col("question")] if kinds else F.lit(None).cast("string")
            rows = rows.select("question", kind.alias("pattern"), F.col("rank").cast("long"), "stock_code", "metric", F.col("metric_year").cast("long"), F.col("value").cast("string"), F.coalesce("status", F.lit("found")).alias("status"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def compose(self, question: str) -> dict:
        """The answer as text with its status; at most a plan's few rows reach the driver."""
        rows = self.answer(question).limit(MOST_SUBPLANS).collect()
        status = dominant([r["status"] for r in rows]) if rows else "not_found"
        lines = [" ".join(str(x) for x in (r["rank"], r["stock_code"], r["metric"], r["metric_year"], r["value"]) if x is not None) for r in rows if r["status"] == "found"]
        return {"question": question, "status": status, "lines": lines}
