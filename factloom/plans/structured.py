"""Structured core: rank, aggregate, lookups, coverage, supplements, gaps, formulas, fact selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import facts as ops
from factloom.operators import formulas, selection
from factloom.sources.tables import table
from factloom.sources.views import CANDIDATES_SQL, COMPANIES_SQL, FACTS_SQL, UNIT, candidates, companies, facts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def _text(column: str, kind: str = "decimal(38,4)"):
    return F.col(column).cast(kind).cast("string")


_RANKED = ["rank", "stock_code", "document_id", "fact_id"]


def _rank_sql(direction: str) -> str:
    return f"""WITH {FACTS_SQL} SELECT row_number() OVER (ORDER BY normalized_value {direction}, stock_code, document_id, fact_id) AS rank,
      stock_code, document_id, fact_id, normalized_value::VARCHAR AS value FROM facts
      WHERE canonical_metric = '营业收入' AND metric_year = 1997 AND normalized_unit = '元'
      ORDER BY normalized_value {direction}, stock_code, document_id, fact_id LIMIT 5"""


def _spec(**more) -> ops.QuerySpec:
    return ops.QuerySpec(canonical_metric="营业收入", metric_year=1997, normalized_unit=UNIT, **more)


@_query("rank_metric_desc", _rank_sql("DESC"))
def rank_metric_desc(spark: SparkSession, sf: str) -> DataFrame:
    return ops.rank(facts(spark, sf), _spec(kind="rank", limit=5)).select(*_RANKED, _text("normalized_value").alias("value"))


@_query("rank_metric_asc", _rank_sql("ASC"))
def rank_metric_asc(spark: SparkSession, sf: str) -> DataFrame:
    return ops.rank(facts(spark, sf), _spec(kind="rank", limit=5, order_direction="asc")).select(*_RANKED, _text("normalized_value").alias("value"))


def _aggregate(operator: str, value: str):
    sql = f"""WITH {FACTS_SQL} SELECT '{operator}' AS aggregate_operator, {value} AS value, count(*) AS n_facts, min(fact_id) AS first_fact_id
      FROM facts WHERE canonical_metric = '营业收入' AND metric_year = 1997 HAVING count(*) > 0"""

    @_query(f"aggregate_{operator}", sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = ops.aggregate(facts(spark, sf), _spec(kind="aggregate", aggregate_operator=operator))
        return out.select("aggregate_operator", F.col("value").cast("string").alias("value"), "n_facts", "first_fact_id")


_aggregate("sum", "sum(normalized_value)::DECIMAL(38,4)::VARCHAR")
_aggregate("count", "count(*)::DECIMAL(38,4)::VARCHAR")
#: Sixteen places, rounded half up, in whole numbers, as division gives doubles here.
_AVERAGE = "(2 * (sum(normalized_value) * 10000)::HUGEINT * 1000000000000 + count(*)) // (2 * count(*))"
_aggregate("average", f"({_AVERAGE}) // 10000000000000000 || '.' || lpad((({_AVERAGE}) % 10000000000000000)::VARCHAR, 16, '0')")


@_query("fact_lookup_status", f"""WITH {FACTS_SQL},
  held AS (SELECT * FROM facts UNION ALL SELECT 'x' || fact_id, * EXCLUDE (fact_id) FROM facts WHERE fact_id < '2'),
  requests AS (SELECT DISTINCT document_id, stock_code, report_year, metric_year + CASE WHEN fact_id < '8' THEN 0 ELSE 10 END AS metric_year, canonical_metric, normalized_unit FROM facts WHERE canonical_metric = '总资产'),
  found AS (SELECT document_id, metric_year, canonical_metric, count(*) AS n, min(fact_id) AS first_id, min(normalized_value) AS v FROM held GROUP BY ALL)
  SELECT r.document_id, r.metric_year, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS status,
         first_id, CASE WHEN n = 1 THEN v::VARCHAR END AS value
  FROM requests r LEFT JOIN found f ON r.document_id = f.document_id AND r.metric_year = f.metric_year AND r.canonical_metric = f.canonical_metric""")  # fmt: skip
def fact_lookup_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf)
    twice = rows.filter("fact_id < '2'").withColumn("fact_id", F.concat(F.lit("x"), "fact_id"))
    asked = rows.filter("canonical_metric = '总资产'").withColumn("metric_year", F.col("metric_year") + F.when(F.col("fact_id") < "8", 0).otherwise(10))
    out = ops.lookup(asked.select(*ops.IDENTITY).distinct(), rows.unionByName(twice))
    return out.select("document_id", "metric_year", "n", "status", F.get("fact_ids", F.lit(0)).alias("first_id"), _text("value").alias("value"))


@_query("filter_allow_list", f"""WITH {FACTS_SQL} SELECT fact_id, document_id, normalized_value::VARCHAR AS value FROM facts
  WHERE canonical_metric IN ('营业收入', '营业成本') AND metric_year IN (1995, 1996) AND stock_code IN (SELECT lpad(x::VARCHAR, 9, '0') FROM range(1, 60) t(x))""")  # fmt: skip
def filter_allow_list(spark: SparkSession, sf: str) -> DataFrame:
    filters = {"canonical_metrics": ["营业成本", "营业收入"], "metric_years": [1995, 1996], "stock_codes": [f"{x:09d}" for x in range(1, 60)], "document_ids": [], "normalized_units": []}
    return ops.allow_list(facts(spark, sf), filters).select("fact_id", "document_id", _text("normalized_value").alias("value"))


@_query("coverage_report", f"""WITH {FACTS_SQL}, {COMPANIES_SQL}, seen AS (SELECT DISTINCT stock_code FROM facts WHERE metric_year = 1996)
  SELECT count(*) AS expected, count(s.stock_code) AS observed, count(*) - count(s.stock_code) AS missing FROM companies c LEFT JOIN seen s USING (stock_code)""")  # fmt: skip
def coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    return ops.coverage(companies(spark, sf), facts(spark, sf).filter("metric_year = 1996"), "stock_code")


@_query("metadata_lookup", f"""WITH {COMPANIES_SQL}, g AS (SELECT nation, segment, count(*) AS n_documents, min(stock_code) AS first_document FROM companies GROUP BY ALL)
  SELECT nation, segment, n_documents, first_document, CASE WHEN count(*) OVER (PARTITION BY nation) = 1 THEN 'found' ELSE 'ambiguous' END AS status FROM g""")  # fmt: skip
def metadata_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = companies(spark, sf).withColumn("document_id", F.col("stock_code"))
    out = ops.metadata(rows, "segment", "nation")
    return out.select("nation", "segment", "n_documents", F.col("document_ids")[0].alias("first_document"), "status")


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts split by hash: selected ones, and supplements of which some repeat a selected identity."""
    return rows.filter("fact_id < 'a'"), rows.filter("fact_id >= '7' AND fact_id < 'e'").withColumn("fact_id", F.concat(F.lit("s"), "fact_id"))


_SPLIT_SQL = "selected AS (SELECT * FROM facts WHERE fact_id < 'a'), supplements AS (SELECT 's' || fact_id AS fact_id, * EXCLUDE (fact_id) FROM facts WHERE fact_id >= '7' AND fact_id < 'e')"


@_query("supplement_shadow_union", f"""WITH {FACTS_SQL}, {_SPLIT_SQL}
  SELECT fact_id, document_id, 'selected' AS origin, normalized_value::VARCHAR AS value FROM selected UNION ALL
  SELECT fact_id, document_id, 'supplement', normalized_value::VARCHAR FROM supplements x
  WHERE NOT EXISTS (SELECT 1 FROM selected s WHERE s.document_id = x.document_id AND s.canonical_metric = x.canonical_metric AND s.metric_year = x.metric_year)""")  # fmt: skip
def supplement_shadow_union(spark: SparkSession, sf: str) -> DataFrame:
    return ops.shadowed_union(*_split(facts(spark, sf))).select("fact_id", "document_id", "origin", _text("normalized_value").alias("value"))


@_query("fallback_lookup", f"""WITH {FACTS_SQL}, {_SPLIT_SQL}, asked AS (SELECT DISTINCT document_id, canonical_metric, metric_year FROM facts),
  one AS (SELECT document_id, canonical_metric, metric_year, count(*) AS n, min(fact_id) AS f FROM selected GROUP BY ALL), two AS (SELECT document_id, canonical_metric, metric_year, count(*) AS n, min(fact_id) AS f FROM supplements GROUP BY ALL)
  SELECT a.document_id, a.canonical_metric, CASE WHEN coalesce(one.n, two.n, 0) = 0 THEN 'not_found' WHEN coalesce(one.n, two.n) = 1 THEN 'found' ELSE 'ambiguous' END AS status, coalesce(one.f, two.f) AS first_id,
    CASE WHEN one.n IS NULL THEN 'supplement' ELSE 'selected' END AS source FROM asked a LEFT JOIN one USING (document_id, canonical_metric, metric_year) LEFT JOIN two USING (document_id, canonical_metric, metric_year)""")  # fmt: skip
def fallback_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf)
    out = ops.fallback_lookup(rows.select(*ops.IDENTITY).distinct(), *_split(rows))
    return out.select("document_id", "canonical_metric", "status", F.get("fact_ids", F.lit(0)).alias("first_id"), "source")


_SLOTS = [("营业收入", UNIT), ("管理费用", UNIT), ("净利润", UNIT)]


@_query("missing_slot_grid", f"""WITH {FACTS_SQL}, {_SPLIT_SQL},
  documents_ AS (SELECT DISTINCT document_id, report_year FROM facts), metrics(m) AS (VALUES ('营业收入'), ('管理费用'), ('净利润')), offsets(o) AS (VALUES (0), (1), (2)),
  grid AS (SELECT document_id, report_year, m AS canonical_metric, report_year - o AS metric_year FROM documents_, metrics, offsets),
  known AS (SELECT document_id, canonical_metric, metric_year, count(*) AS n FROM (SELECT * FROM selected UNION ALL SELECT * FROM supplements) GROUP BY ALL)
  SELECT g.document_id, g.metric_year, g.canonical_metric, '元' AS normalized_unit, g.report_year,
         CASE WHEN n > 1 THEN 'conflict' WHEN n = 1 THEN 'withheld' ELSE 'no_fact' END AS cause
  FROM grid g LEFT JOIN known k USING (document_id, canonical_metric, metric_year)
  WHERE NOT EXISTS (SELECT 1 FROM selected s WHERE s.document_id = g.document_id AND s.canonical_metric = g.canonical_metric AND s.metric_year = g.metric_year)""")  # fmt: skip
def missing_slot_grid(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf)
    selected, supplements = _split(rows)
    return ops.missing_slots(rows.select("document_id", "report_year").distinct(), selected, selected.unionByName(supplements), _SLOTS)


@_query("fallback_candidate_ids", f"""WITH {CANDIDATES_SQL}, g AS (SELECT document_id, metric_year, canonical_metric, list_sort(list(DISTINCT split_part(candidate_id, '-', 1))) AS t FROM candidates GROUP BY ALL)
  SELECT document_id, metric_year, canonical_metric, len(t) AS n_tables, array_to_string(t, ',') AS table_ids FROM g""")  # fmt: skip
def fallback_candidate_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates(spark, sf).withColumn("table_id", F.split("candidate_id", "-")[0])
    out = ops.candidate_tables(rows, ["document_id", "metric_year", "canonical_metric"], "table_id")
    return out.select("document_id", "metric_year", "canonical_metric", F.size("table_ids").cast("long").alias("n_tables"), F.array_join("table_ids", ",").alias("table_ids"))


def _formula(name: str, ids: list[str], sql: str):
    @_query(name, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = facts(spark, sf)
        asked = rows.select("stock_code", F.col("metric_year").alias("target_year")).distinct().withColumn("formula_id", F.explode(F.array(*map(F.lit, ids))))
        out = formulas.evaluate(asked, rows)
        return out.select("stock_code", "formula_id", "target_year", F.round(F.col("value").cast("double"), 6).alias("value"), "status", "code")


_WIDE_SQL = f"""{FACTS_SQL}, w AS (SELECT stock_code, metric_year AS target_year,
    max(normalized_value) FILTER (WHERE canonical_metric = '营业收入') AS revenue, max(normalized_value) FILTER (WHERE canonical_metric = '营业成本') AS cost,
    max(normalized_value) FILTER (WHERE canonical_metric = '管理费用') AS admin, max(normalized_value) FILTER (WHERE canonical_metric = '总资产') AS assets
  FROM facts GROUP BY ALL)"""


def _one_formula(formula_id: str, top: str, base: str) -> str:
    missing = f"({top}) IS NULL OR ({base}) IS NULL"
    return f"""SELECT stock_code, '{formula_id}' AS formula_id, target_year,
      CASE WHEN {missing} OR ({base}) = 0 THEN NULL ELSE round(({top})::DOUBLE / ({base})::DOUBLE, 6) END AS value,
      CASE WHEN {missing} THEN 'fallback_required' WHEN ({base}) = 0 THEN 'blocked' ELSE 'found' END AS status,
      CASE WHEN {missing} THEN 'FORMULA_OPERAND_MISSING' WHEN ({base}) = 0 THEN 'FORMULA_ZERO_DENOMINATOR' END AS code"""


_formula("formula_growth", ["revenue_growth_rate.v1", "total_assets_growth_rate.v1"], f"""WITH {_WIDE_SQL},
  y AS (SELECT w.*, p.revenue AS revenue_before, p.assets AS assets_before FROM w LEFT JOIN w p ON p.stock_code = w.stock_code AND p.target_year = w.target_year - 1)
  {_one_formula('revenue_growth_rate.v1', 'revenue - revenue_before', 'revenue_before')} FROM y UNION ALL
  {_one_formula('total_assets_growth_rate.v1', 'assets - assets_before', 'assets_before')} FROM y""")  # fmt: skip
_formula("formula_ratio", ["operating_cost_ratio.v1", "administrative_expense_ratio.v1"], f"""WITH {_WIDE_SQL}
  {_one_formula('operating_cost_ratio.v1', 'cost', 'revenue')} FROM w UNION ALL
  {_one_formula('administrative_expense_ratio.v1', 'admin', 'revenue')} FROM w""")  # fmt: skip
_formula("formula_special", ["gross_margin.v1"], f"""WITH {_WIDE_SQL} {_one_formula('gross_margin.v1', 'revenue - cost', 'revenue')} FROM w""")
_formula("formula_status", ["quick_ratio.v1", "no_such_formula.v1"], f"""WITH {_WIDE_SQL}
  SELECT stock_code, 'quick_ratio.v1' AS formula_id, target_year, NULL::DOUBLE AS value, 'fallback_required' AS status, 'FORMULA_OPERAND_MISSING' AS code FROM w UNION ALL
  SELECT stock_code, 'no_such_formula.v1', target_year, NULL, 'unsupported', 'METRIC_UNRECOGNIZED' FROM w""")  # fmt: skip


_AUDIT_SQL = """audited AS (SELECT *, list_filter([
    CASE WHEN metric_year > report_year THEN 'future_metric_year' WHEN metric_year < report_year - 2 THEN 'metric_year_outside_three_year_window' END,
    CASE WHEN normalized_value IS NULL THEN 'not_parsed_numeric' END,
    CASE WHEN canonical_metric <> '营业收入' THEN 'unsupported_canonical_metric' WHEN normalized_unit <> '元' THEN 'missing_or_incompatible_unit' END],
    lambda x: x IS NOT NULL) AS reasons FROM candidates)"""
_SCORE_SQL = """scored AS (SELECT *, least(1, greatest(0, CASE metric_match_type WHEN 'exact_alias' THEN 0.32 ELSE 0.22 END + CASE metric_source WHEN 'row_label' THEN 0.25 ELSE 0.12 END
    + CASE year_confidence WHEN 'high' THEN 0.25 ELSE 0.18 END + CASE unit_source WHEN 'raw_value' THEN 0.08 WHEN 'row_label' THEN 0.08 WHEN 'unit_hint' THEN 0.05 ELSE 0.03 END
    + CASE WHEN context_is_financial THEN 0.10 ELSE 0 END - CASE WHEN metric_year = report_year - 2 THEN 0.05 ELSE 0 END))::DECIMAL(6,4) AS confidence_score FROM audited)"""


@_query("candidate_audit", f"""WITH {CANDIDATES_SQL}, {_AUDIT_SQL} SELECT candidate_id, len(reasons) = 0 AS eligible, array_to_string(reasons, ';') AS rejection_reasons FROM audited""")
def candidate_audit(spark: SparkSession, sf: str) -> DataFrame:
    return selection.audit(candidates(spark, sf)).select("candidate_id", "eligible", F.array_join("rejection_reasons", ";").alias("rejection_reasons"))


@_query("candidate_score", f"""WITH {CANDIDATES_SQL}, {_AUDIT_SQL}, {_SCORE_SQL} SELECT candidate_id, confidence_score::VARCHAR AS confidence_score,
  CASE WHEN confidence_score >= 0.85 THEN 'high' WHEN confidence_score >= 0.70 THEN 'medium' ELSE 'low' END AS confidence FROM scored WHERE len(reasons) = 0""")  # fmt: skip
def candidate_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = selection.score(selection.audit(candidates(spark, sf)).filter("eligible"))
    return rows.select("candidate_id", _text("confidence_score", "decimal(6,4)").alias("confidence_score"), "confidence")


_SELECTED_SQL = f"""WITH {CANDIDATES_SQL}, {_AUDIT_SQL}, {_SCORE_SQL},
  ordered AS (SELECT *, row_number() OVER (PARTITION BY document_id, metric_year, normalized_value ORDER BY confidence_score DESC, candidate_id) AS r,
                count(*) OVER (PARTITION BY document_id, metric_year, normalized_value) AS support_count FROM scored WHERE len(reasons) = 0),
  vals AS (SELECT document_id, stock_code, statement, metric_year, canonical_metric, normalized_unit, normalized_value, support_count, candidate_id,
             least(1, confidence_score + least(0.04, (support_count - 1) * 0.01))::DECIMAL(6,4) AS s,
             md5(document_id || '|' || stock_code || '|' || metric_year || '|' || statement || '|' || canonical_metric || '|' || normalized_unit || '|' || normalized_value::VARCHAR) AS fact_id FROM ordered WHERE r = 1),
  ranked AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY document_id, metric_year) AS k, lead(s) OVER w AS s2, lead(support_count) OVER w AS c2 FROM vals
             WINDOW w AS (PARTITION BY document_id, metric_year ORDER BY s DESC, support_count DESC, fact_id)),
  chosen AS (SELECT *, place = 1 AND CASE WHEN k = 1 THEN s >= 0.70 ELSE s >= 0.95 AND (s - s2 >= 0.12 OR (support_count >= 2 AND c2 = 1 AND s - s2 >= 0.05)) END AS is_selected FROM ranked),
  final AS (SELECT *, CASE WHEN k = 1 THEN CASE WHEN is_selected THEN 'selected_single_value' ELSE 'low_confidence' END WHEN is_selected THEN 'resolved_by_confidence'
             WHEN bool_or(is_selected) OVER (PARTITION BY document_id, metric_year) THEN 'not_selected_conflict' ELSE 'unresolved_conflict' END AS selection_status FROM chosen)"""


def _built(spark: SparkSession, sf: str) -> DataFrame:
    return selection.build_facts(selection.score(selection.audit(candidates(spark, sf)).filter("eligible")))


@_query("fact_selection", _SELECTED_SQL + " SELECT fact_id, document_id, metric_year, support_count, s::VARCHAR AS confidence_score, candidate_id AS source_candidate_id, is_selected, selection_status FROM final")
def fact_selection(spark: SparkSession, sf: str) -> DataFrame:
    return _built(spark, sf).select("fact_id", "document_id", "metric_year", "support_count", _text("confidence_score", "decimal(6,4)").alias("confidence_score"), "source_candidate_id", "is_selected", "selection_status")


@_query("conflict_groups", _SELECTED_SQL + """ SELECT document_id, metric_year, count(*) AS distinct_value_count, sum(support_count)::BIGINT AS candidate_count,
  max(fact_id) FILTER (WHERE is_selected) AS selected_fact_id FROM final WHERE k > 1 GROUP BY document_id, metric_year""")  # fmt: skip
def conflict_groups(spark: SparkSession, sf: str) -> DataFrame:
    return selection.conflict_groups(_built(spark, sf)).select("document_id", "metric_year", "distinct_value_count", "candidate_count", "selected_fact_id")


@_query("selection_integrity", _SELECTED_SQL + """ SELECT count(*) AS facts, count(DISTINCT fact_id) AS fact_ids,
  (SELECT count(*) FROM (SELECT document_id, metric_year FROM final GROUP BY ALL HAVING count(*) FILTER (WHERE is_selected) > 1)) AS groups_selected_twice FROM final""")  # fmt: skip
def selection_integrity(spark: SparkSession, sf: str) -> DataFrame:
    return selection.integrity(_built(spark, sf))


@_query("authorization_dedup", f"""WITH {FACTS_SQL}, a AS (
    SELECT document_id, canonical_metric, normalized_value, 'fact' AS backend, 1 AS priority, fact_id AS id FROM facts UNION ALL
    SELECT document_id, canonical_metric, normalized_value, 'formula', 2, 'f' || fact_id FROM facts WHERE fact_id < '9' UNION ALL
    SELECT document_id, canonical_metric, normalized_value + CASE WHEN fact_id < 'c' THEN 0 ELSE 1 END, 'sql', 3, 'q' || fact_id FROM facts)
  SELECT document_id, canonical_metric, normalized_value::VARCHAR AS value, backend, id FROM (SELECT *, row_number() OVER (PARTITION BY document_id, canonical_metric, normalized_value ORDER BY priority, id) AS r FROM a) WHERE r = 1""")  # fmt: skip
def authorization_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf).select("document_id", "canonical_metric", "normalized_value", "fact_id")
    moved = (F.col("normalized_value") + F.when(F.col("fact_id") < "c", 0).otherwise(1)).cast("decimal(38,4)")
    all_ = (
        rows.withColumns({"backend": F.lit("fact"), "id": F.col("fact_id")})
        .unionByName(rows.filter("fact_id < '9'").withColumns({"backend": F.lit("formula"), "id": F.concat(F.lit("f"), "fact_id")}))
        .unionByName(rows.withColumns({"normalized_value": moved, "backend": F.lit("sql"), "id": F.concat(F.lit("q"), "fact_id")}))
    )
    from factloom.operators.fusion import deduplicate_authorizations

    out = deduplicate_authorizations(all_, ["document_id", "canonical_metric", "normalized_value"])
    return out.select("document_id", "canonical_metric", _text("normalized_value").alias("value"), "backend", "id")


@_query("unit_ambiguity_policy", f"""WITH {CANDIDATES_SQL} SELECT document_id, metric_year, count(DISTINCT normalized_unit) AS n_units, count(DISTINCT (normalized_value, normalized_unit)) AS n_values,
  CASE WHEN count(DISTINCT normalized_unit) > 1 THEN 'unit_ambiguous' WHEN count(DISTINCT (normalized_value, normalized_unit)) > 1 THEN 'value_ambiguous' ELSE 'usable' END AS policy
  FROM candidates WHERE normalized_value IS NOT NULL GROUP BY document_id, metric_year""")  # fmt: skip
def unit_ambiguity_policy(spark: SparkSession, sf: str) -> DataFrame:
    from factloom.operators.fusion import ambiguity_policy

    return ambiguity_policy(candidates(spark, sf).filter("normalized_value IS NOT NULL"), ["document_id", "metric_year"], "normalized_unit", "normalized_value")


@_query("alias_resolution", f"""WITH {COMPANIES_SQL}, a AS (SELECT DISTINCT stock_code, upper(trim(unnest(aliases))) AS alias FROM companies)
  SELECT alias AS mention, count(DISTINCT stock_code) AS n, min(stock_code) AS stock_code, CASE WHEN count(DISTINCT stock_code) = 1 THEN 'unique' ELSE 'ambiguous' END AS status
  FROM a GROUP BY alias UNION ALL SELECT 'NOBODY', 0, NULL, 'missing'""")  # fmt: skip
def alias_resolution(spark: SparkSession, sf: str) -> DataFrame:
    from factloom.operators.resolver import resolve_mentions

    rows = companies(spark, sf)
    mentions = rows.select(F.explode("aliases").alias("mention")).distinct().unionByName(spark.createDataFrame([("nobody",)], "mention string"))
    out = resolve_mentions(mentions, rows, "aliases", "stock_code")
    return out.select("mention", "n", "stock_code", "status")


@_query("duplicate_keys", f"""SELECT o_custkey, year(o_orderdate)::BIGINT AS y, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate").cast("long"))
    return rows.groupBy("o_custkey", "y").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@_query("sorted_contiguity", f"""SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber <> before + 1) AS breaks FROM (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS before FROM lineitem) GROUP BY ALL""")
def sorted_contiguity(spark: SparkSession, sf: str) -> DataFrame:
    before = F.lag("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return table(spark, sf, "lineitem").withColumn("before", before).groupBy("l_orderkey").agg(F.count_if(F.col("l_linenumber") != F.col("before") + 1).alias("breaks"))
