"""The reference data model on the driver's tables: each view says what stands for what.

Money columns are doubles in the tables; they become decimals once, here, so that
sums are exact and do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.tables import table

#: Metric -> what it stands for in the order tables.
METRICS = {"营业收入": "revenue", "营业成本": "cost", "销售费用": "sales", "管理费用": "administration", "总资产": "assets"}
UNIT = "元"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Financial facts: a customer is a company, an order year a report year.

    Revenue is the discounted price, cost the discount, sales expense the tax,
    administration expense the tax of orders of low priority, assets the quantity.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.year("o_orderdate").cast("long").alias("metric_year"))
    price, discount, tax = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (price - price * discount).alias("revenue"), (price * discount).alias("cost"), (price * tax).alias("sales"), F.col("l_quantity").cast("decimal(12,2)").alias("assets")
    )
    low = F.when(F.col("o_orderpriority") == "5-LOW", F.col("sales"))
    sums = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "metric_year")
        .agg(*[F.sum(c).cast("decimal(38,4)").alias(c) for c in ("revenue", "cost", "sales", "assets")], F.sum(low).cast("decimal(38,4)").alias("administration"))
    )
    pairs = F.expr("stack(5, " + ", ".join(f"'{m}', {c}" for m, c in METRICS.items()) + ") AS (canonical_metric, normalized_value)")
    document = F.concat(F.lit("D"), F.col("o_custkey"), F.lit("_"), F.col("metric_year"))
    long = sums.select("o_custkey", "metric_year", pairs).filter("normalized_value IS NOT NULL")
    return long.select(
        F.md5(F.concat_ws("|", document, "canonical_metric")).alias("fact_id"),
        document.alias("document_id"),
        F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("stock_code"),
        F.col("metric_year").alias("report_year"),
        "metric_year",
        "canonical_metric",
        "normalized_value",
        F.lit(UNIT).alias("normalized_unit"),
    )


#: The same view for DuckDB.
FACTS_SQL = """
lines AS (
  SELECT o_custkey, year(o_orderdate)::BIGINT AS metric_year, o_orderpriority,
         l_extendedprice::DECIMAL(12,2) AS price, l_discount::DECIMAL(4,2) AS discount, l_tax::DECIMAL(4,2) AS tax, l_quantity::DECIMAL(12,2) AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sums AS (
  SELECT o_custkey, metric_year, sum(price - price * discount)::DECIMAL(38,4) AS revenue, sum(price * discount)::DECIMAL(38,4) AS cost,
         sum(price * tax)::DECIMAL(38,4) AS sales, sum(price * tax) FILTER (WHERE o_orderpriority = '5-LOW')::DECIMAL(38,4) AS administration,
         sum(quantity)::DECIMAL(38,4) AS assets
  FROM lines GROUP BY ALL),
long AS (
  SELECT o_custkey, metric_year, '营业收入' AS canonical_metric, revenue AS normalized_value FROM sums UNION ALL
  SELECT o_custkey, metric_year, '营业成本', cost FROM sums UNION ALL
  SELECT o_custkey, metric_year, '销售费用', sales FROM sums UNION ALL
  SELECT o_custkey, metric_year, '管理费用', administration FROM sums UNION ALL
  SELECT o_custkey, metric_year, '总资产', assets FROM sums),
facts AS (
  SELECT md5('D' || o_custkey || '_' || metric_year || '|' || canonical_metric) AS fact_id, 'D' || o_custkey || '_' || metric_year AS document_id,
         lpad(o_custkey::VARCHAR, 9, '0') AS stock_code, metric_year AS report_year, metric_year, canonical_metric, normalized_value, '元' AS normalized_unit
  FROM long WHERE normalized_value IS NOT NULL)
"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company index: customers with their nation and three aliases; two of them are shared within a nation."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    code = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nation), "c_nationkey")  # 25 nations, whatever the scale
    return rows.select(
        code.alias("stock_code"), F.col("c_name").alias("company"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"),
        F.array("c_name", code, F.concat("n_name", F.lit(" "), F.pmod("c_custkey", F.lit(50)))).alias("aliases"),
    )


COMPANIES_SQL = """
companies AS (
  SELECT lpad(c_custkey::VARCHAR, 9, '0') AS stock_code, c_name AS company, n_name AS nation, c_mktsegment AS segment,
         [c_name, lpad(c_custkey::VARCHAR, 9, '0'), n_name || ' ' || (c_custkey % 50)] AS aliases
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric candidates: each line item proposes its supplier's tax rate for its part.

    The document is the part, the metric year the ship year; flags and modes decide
    how the metric, its year and its unit were found.
    """
    lines = table(spark, sf_dir, "lineitem")
    year = F.year("l_shipdate").cast("long")
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("candidate_id"),
        F.concat(F.lit("P"), "l_partkey").alias("document_id"),
        F.concat(F.lit("S"), F.pmod("l_partkey", F.lit(100))).alias("stock_code"),
        F.when(F.col("l_linenumber") == 7, "other").otherwise("income_statement").alias("statement"),
        year.alias("metric_year"),
        (year + F.pmod("l_linenumber", F.lit(4)) - 1).cast("long").alias("report_year"),
        F.when(F.col("l_linenumber") == 7, "未知指标").otherwise("营业收入").alias("canonical_metric"),
        F.when(F.col("l_returnflag") == "R", "exact_alias").otherwise("regex").alias("metric_match_type"),
        F.when(F.col("l_linestatus") == "O", "row_label").otherwise("column_label").alias("metric_source"),
        F.when(F.col("l_returnflag") == "N", "medium").otherwise("high").alias("year_confidence"),
        (F.pmod("l_suppkey", F.lit(3)) == 0).alias("context_is_financial"),
        F.element_at(F.array(*map(F.lit, ("raw_value", "row_label", "unit_hint", "column_label"))), (F.pmod("l_orderkey", F.lit(4)) + 1).cast("int")).alias("unit_source"),
        F.when(F.pmod("l_orderkey", F.lit(11)) == 0, "股").otherwise("元").alias("normalized_unit"),
        F.when(F.col("l_quantity") == 50, F.lit(None)).otherwise(F.col("l_tax").cast("decimal(38,12)")).alias("normalized_value"),
    )


CANDIDATES_SQL = """
candidates AS (
  SELECT l_orderkey || '-' || l_linenumber AS candidate_id, 'P' || l_partkey AS document_id, 'S' || l_partkey % 100 AS stock_code, CASE WHEN l_linenumber = 7 THEN 'other' ELSE 'income_statement' END AS statement, year(l_shipdate)::BIGINT AS metric_year,
         (year(l_shipdate) + l_linenumber % 4 - 1)::BIGINT AS report_year,
         CASE WHEN l_linenumber = 7 THEN '未知指标' ELSE '营业收入' END AS canonical_metric,
         CASE WHEN l_returnflag = 'R' THEN 'exact_alias' ELSE 'regex' END AS metric_match_type,
         CASE WHEN l_linestatus = 'O' THEN 'row_label' ELSE 'column_label' END AS metric_source,
         CASE WHEN l_returnflag = 'N' THEN 'medium' ELSE 'high' END AS year_confidence,
         l_suppkey % 3 = 0 AS context_is_financial,
         (['raw_value', 'row_label', 'unit_hint', 'column_label'])[(l_orderkey % 4 + 1)::INTEGER] AS unit_source,
         CASE WHEN l_orderkey % 11 = 0 THEN '股' ELSE '元' END AS normalized_unit,
         CASE WHEN l_quantity = 50 THEN NULL ELSE l_tax::DECIMAL(38,12) END AS normalized_value
  FROM lineitem)
"""
