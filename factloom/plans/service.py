"""Risk documents, stateful operators and planned questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import risk
from factloom.plans.planner import Engine
from factloom.sources.tables import table, upsert_missing
from factloom.sources.views import FACTS_SQL, companies, facts
from factloom.streaming import stateful

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


# --- risk documents -----------------------------------------------------------------------------

_CATEGORIES = ("click", "purchase", "view", "login", "logout", "search", "signup", "other")


def _risk(spark: SparkSession, sf: str) -> DataFrame:
    """Users as companies, event types as categories, the value modulo 5 as score."""
    score = (F.pmod(F.col("event_id"), F.lit(5)) + 1).cast("int")
    evidence = F.array(F.struct(F.concat(F.lit("event "), "event_id").alias("EvidenceQuote"), F.lit("seen").alias("Interpretation")))
    one = F.struct(F.concat(F.lit("r"), "event_id").alias("RiskName"), F.col("event_type").alias("Category"), F.lit("").alias("Subcategory"), score.alias("ExposureScore"), evidence.alias("Evidence"))
    company = F.struct(F.concat(F.lit("u"), "user_id").alias("company_id"), F.concat(F.lit("User "), "user_id").alias("company_name"), F.lit(2023).alias("report_year"))
    rows = table(spark, sf, "events")
    return rows.groupBy("user_id").agg(F.first(company).alias("Company"), F.array_sort(F.collect_list(one)).alias("RiskExposures")).drop("user_id")


_RISK_SQL = "r AS (SELECT 'u' || user_id AS company_id, 'r' || event_id AS name, event_type AS category, (event_id % 5 + 1)::INTEGER AS score FROM events)"


@_query("risk_company_filter", f"""WITH {_RISK_SQL} SELECT company_id, count(*)::INTEGER AS risk_count, max(score) AS max_exposure_score FROM r GROUP BY company_id HAVING bool_or(category = 'purchase' AND score >= 4)""")
def risk_company_filter(spark: SparkSession, sf: str) -> DataFrame:
    return risk.companies(_risk(spark, sf), "purchase", 4).select("company_id", "risk_count", "max_exposure_score")


@_query("risk_top3", f"WITH {_RISK_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY score DESC, name) AS n FROM r) SELECT company_id, string_agg(name, ',' ORDER BY n) AS top_risks FROM k WHERE n <= 3 GROUP BY company_id")
def risk_top3(spark: SparkSession, sf: str) -> DataFrame:
    return risk.companies(_risk(spark, sf)).select("company_id", F.array_join("top_risks", ",").alias("top_risks"))


@_query("risk_compare", f"WITH {_RISK_SQL} SELECT category, count(DISTINCT company_id) AS companies, max(score) AS largest, count(DISTINCT company_id) = 3 AS shared FROM r WHERE company_id IN ('u1', 'u2', 'u3') GROUP BY category")
def risk_compare(spark: SparkSession, sf: str) -> DataFrame:
    return risk.shared_categories(_risk(spark, sf), ["u1", "u2", "u3"])


@_query("risk_matrix", f"""WITH {_RISK_SQL} SELECT company_id, 2023 AS report_year, count(*)::INTEGER AS risk_count, max(score) AS max_exposure_score,
  {', '.join(f"coalesce(max(score) FILTER (WHERE category = '{c}'), 0) AS category_{c}" for c in _CATEGORIES)} FROM r GROUP BY company_id""")  # fmt: skip
def risk_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return risk.matrix(_risk(spark, sf), _CATEGORIES)


@_query("risk_validation", f"WITH {_RISK_SQL} SELECT coalesce(v, 'valid') AS violation, count(*) AS n FROM (SELECT company_id, CASE WHEN count(*) > 30 THEN 'too_many_exposures' WHEN bool_or(category NOT IN ('click', 'purchase', 'view')) THEN 'unknown_category' END AS v FROM r GROUP BY 1) GROUP BY 1")
def risk_validation(spark: SparkSession, sf: str) -> DataFrame:
    out = risk.validation(_risk(spark, sf), ("click", "purchase", "view"))
    return out.groupBy(F.coalesce("violation", F.lit("valid")).alias("violation")).agg(F.count(F.lit(1)).alias("n"))


# --- state --------------------------------------------------------------------------------------


@_query("rate_limit_state", """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  w AS (SELECT key, event_id, n, true AS accepted, NULL::DOUBLE AS before, t AS last FROM e WHERE n = 1 UNION ALL
    SELECT e.key, e.event_id, e.n, before IS NULL OR before <= t - 86400, CASE WHEN before IS NULL OR before <= t - 86400 THEN last ELSE before END, CASE WHEN before IS NULL OR before <= t - 86400 THEN t ELSE last END
    FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1)
  SELECT key, event_id, accepted FROM w""")  # fmt: skip
def rate_limit_state(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at")).withColumn("at", F.col("at") / 1e6)
    return stateful.rate_limit(rows, 2, 86_400).select("key", "event_id", "accepted")


@_query("breaker_window", """SELECT event_id, count(*) OVER w AS recent, count(*) OVER w >= 3 AS open FROM (SELECT *, epoch(ts)::BIGINT AS s FROM (SELECT * EXCLUDE (ts), date_trunc('second', ts) AS ts FROM events))
  WINDOW w AS (PARTITION BY event_type ORDER BY s RANGE BETWEEN 300 PRECEDING AND CURRENT ROW)""")  # fmt: skip
def breaker_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("event_type").alias("key"), "event_id", F.unix_timestamp("ts").alias("at"))
    return stateful.breaker(rows).select("event_id", "recent", "open")


@_query("latest_per_case", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_case(spark: SparkSession, sf: str) -> DataFrame:
    return stateful.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@_query("incremental_upsert", "SELECT DISTINCT event_id FROM events WHERE event_id % 3 = 0 AND event_id % 2 <> 0")
def incremental_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id")
    return upsert_missing(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 3 = 0"), "event_id")


@_query("tumbling_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = stateful.tumbling(table(spark, sf, "events"), "ts", "value", "1 hour", "10 minutes")
    return out.withColumn("total", F.round("total", 4))


# --- questions -----------------------------------------------------------------------------------


_CODE, _TEN = "'000000001'", "10000000000000000"


def _mean_sql(top: str, base: str) -> str:
    """top / base, decimals of four places, to twelve places rounded half up, as text."""
    q = f"((2 * abs(({top}) * 10000)::HUGEINT * 1000000000000 + (({base}) * 10000)::HUGEINT) // (2 * (({base}) * 10000)::HUGEINT))"
    return f"CASE WHEN ({top}) < 0 THEN '-' ELSE '' END || {q} // 1000000000000 || '.' || lpad(({q} % 1000000000000)::VARCHAR, 12, '0')"


@_query("plan_and_run", f"""WITH {FACTS_SQL}, one AS (SELECT metric_year, max(normalized_value) FILTER (WHERE canonical_metric = '营业收入') AS revenue, max(normalized_value) FILTER (WHERE canonical_metric = '营业成本') AS cost FROM facts WHERE stock_code = {_CODE} GROUP BY 1),
  top AS (SELECT *, row_number() OVER (ORDER BY normalized_value DESC, stock_code, document_id, fact_id) AS rank FROM facts WHERE canonical_metric = '营业收入' AND metric_year = 1997)
  SELECT '1997年营业收入最高的3家公司' AS question, 'rank' AS pattern, rank, stock_code, canonical_metric AS metric, metric_year, normalized_value::VARCHAR AS value, 'found' AS status FROM top WHERE rank <= 3
  UNION ALL SELECT '1997年总资产合计', 'aggregate', NULL, NULL, '总资产', 1997, sum(normalized_value)::DECIMAL(38,4)::VARCHAR, 'found' FROM facts WHERE canonical_metric = '总资产' AND metric_year = 1997
  UNION ALL SELECT '000000001 1996年营业收入增长率', 'formula', NULL, {_CODE}, 'revenue_growth_rate.v1', 1996, CASE WHEN b.revenue IS NOT NULL AND a.revenue IS NOT NULL THEN {_mean_sql('a.revenue - b.revenue', 'b.revenue')} END,
    CASE WHEN b.revenue IS NULL OR a.revenue IS NULL THEN 'fallback_required' ELSE 'found' END FROM (SELECT 1) z LEFT JOIN one a ON a.metric_year = 1996 LEFT JOIN one b ON b.metric_year = 1995
  UNION ALL SELECT '000000001 1996年毛利率', 'formula', NULL, {_CODE}, 'gross_margin.v1', 1996, CASE WHEN a.revenue IS NOT NULL THEN {_mean_sql('a.revenue - a.cost', 'a.revenue')} END, CASE WHEN a.revenue IS NULL THEN 'fallback_required' ELSE 'found' END FROM (SELECT 1) z LEFT JOIN one a ON a.metric_year = 1996
  UNION ALL SELECT '000000001 1995年营业收入是多少', 'fact', NULL, {_CODE}, '营业收入', 1995, a.revenue::VARCHAR, CASE WHEN a.revenue IS NULL THEN 'not_found' ELSE 'found' END FROM (SELECT 1) z LEFT JOIN one a ON a.metric_year = 1995
  UNION ALL SELECT '天气如何', 'unsupported', NULL, NULL, NULL, NULL, NULL, 'unsupported'""")  # fmt: skip
def plan_and_run(spark: SparkSession, sf: str) -> DataFrame:
    """Questions end to end: analysed, resolved, planned, executed and composed."""
    engine = Engine(facts(spark, sf), companies(spark, sf))
    return engine.answer_all(["1997年营业收入最高的3家公司", "1997年总资产合计", "000000001 1996年营业收入增长率", "000000001 1996年毛利率", "000000001 1995年营业收入是多少", "天气如何"])
