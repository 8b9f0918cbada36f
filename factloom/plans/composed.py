"""Facets, selections, provenance, candidates and fragments of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import answers, fragments, tables
from factloom.plans.register import registry
from factloom.plans.structure import _extracted
from factloom.sources.tables import table

QUERIES, ORACLES, query = registry()

@query("frozen_rerank", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 4 * 3 + l_partkey % 3 AS concern_score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 4 DESC, l_partkey % 3 DESC, l_linenumber, l_partkey, l_extendedprice) AS rank
  FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity >= 10""")  # fmt: skip
def frozen_rerank(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.struct("l_partkey", "l_extendedprice").alias("chunk_id"), F.col("l_linenumber").alias("original_rank"), (F.col("l_returnflag") != "R").alias("compatible"), (F.col("l_quantity") < 10).alias("low_information"),
        F.pmod("l_suppkey", F.lit(4)).alias("content_score"), F.pmod("l_partkey", F.lit(3)).alias("path_score"),
    )
    return answers.frozen_rerank(rows, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "concern_score", "rank")


@query("first_passing", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 2 DESC, l_partkey % 3 DESC, l_suppkey % 5 DESC, l_linenumber, l_partkey::VARCHAR) AS r FROM lineitem WHERE l_returnflag = 'N') SELECT l_orderkey, l_linenumber, l_partkey::VARCHAR AS text FROM r WHERE r = 1""")
def first_passing(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.pmod("l_suppkey", F.lit(2)).alias("direct"), F.pmod("l_partkey", F.lit(3)).alias("concept"), F.pmod("l_suppkey", F.lit(5)).alias("section"), F.col("l_linenumber").alias("position"), F.col("l_partkey").cast("string").alias("text"),
        F.when(F.col("l_returnflag") == "N", "accepted").otherwise("irrelevant").alias("verdict"),
    )
    return answers.first_passing(rows, "l_orderkey").select("l_orderkey", "l_linenumber", "text")


@query("evidence_by_relevance", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 4 DESC, coalesce(CASE WHEN l_linenumber < 5 THEN l_discount END, 0) DESC, l_linenumber * 10000000 + l_partkey DESC) AS rank FROM lineitem")
def evidence_by_relevance(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("retrieval_rank"), F.pmod("l_suppkey", F.lit(4)).alias("relevance"), F.when(F.col("l_linenumber") < 5, F.col("l_discount")).alias("score"))
    return answers.by_relevance(rows, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "rank")


@query("provenance_violations", """WITH p AS (SELECT o_orderkey AS id, o_orderstatus AS backend, CASE WHEN o_orderpriority = '1-URGENT' THEN 'blocked' ELSE 'ready' END AS state FROM orders WHERE o_orderkey % 7 <> 0),
  r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS backend, CASE WHEN o_orderpriority = '1-URGENT' THEN 'blocked' ELSE 'ready' END AS state, o_orderkey % 3 = 0 AS ran, o_orderkey % 11 = 0 AS failed FROM orders UNION ALL SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN 'blocked' ELSE 'ready' END, false, false FROM orders WHERE o_orderkey % 13 = 0),
  j AS (SELECT r.*, p.backend AS pb, p.state AS ps, count(*) OVER (PARTITION BY r.id) AS n FROM r LEFT JOIN p ON p.id = r.id)
  SELECT DISTINCT id AS subplan_id, code FROM (SELECT id, unnest(list_filter([CASE WHEN pb IS NULL THEN 'unknown_subplan_result' END, CASE WHEN n > 1 THEN 'duplicate_subplan_result' END, CASE WHEN pb <> backend THEN 'subplan_identity_mismatch' END,
    CASE WHEN ps = 'blocked' AND ran THEN 'blocked_subplan_executed' END, CASE WHEN failed THEN 'backend_provenance_failure' END], lambda x: x IS NOT NULL)) AS code FROM j)""")  # fmt: skip
def provenance_violations(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    base = table(spark, sf, "orders").select(k.alias("subplan_id"), F.col("o_orderstatus").alias("backend"), F.lit("lookup").alias("operation"), F.when(F.col("o_orderpriority") == "1-URGENT", "blocked").otherwise("ready").alias("planning_state"))
    i = F.col("subplan_id")
    first = base.withColumns({"backend": F.when(i % 5 == 0, "X").otherwise(F.col("backend")), "execution_state": F.when(i % 3 == 0, "executed").otherwise("not_executed"), "failure_code": F.when(i % 11 == 0, "PROVENANCE_VALIDATION_FAILED")})
    second = base.filter(i % 13 == 0).withColumns({"execution_state": F.lit("not_executed"), "failure_code": F.lit(None).cast("string")})
    return answers.provenance_violations(base.filter(i % 7 != 0), first.unionByName(second))


@query("collected_findings", "SELECT l_returnflag || l_linenumber AS section, count(*) AS n, arg_min(l_orderkey::VARCHAR, (l_orderkey, l_partkey, l_extendedprice)) AS first_origin FROM lineitem GROUP BY 1")
def collected_findings(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linenumber").alias("section"), F.col("l_orderkey").alias("subplan_id"), F.struct("l_partkey", "l_extendedprice").alias("position"), F.lit("x").alias("text"))
    return answers.findings(rows, 3).select("section", "n", F.col("findings")[0]["origin"].cast("string").alias("first_origin"))


@query("scoped_evidence", """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS chunk_id, CASE WHEN l_linenumber = 6 THEN 'unknown_chunk' WHEN l_linenumber = 5 THEN 'foreign_document' WHEN l_linenumber = 4 THEN 'changed_content' END AS rejected, count(*) AS n FROM lineitem GROUP BY ALL""")
def scoped_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """A provider that answers each order with its lines; the sixth is not pinned, the fifth of another document, the fourth has changed."""
    n = F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("chunk_id"), "l_orderkey", "l_linenumber").withColumn("content", F.concat(F.lit("line "), n))
    pinned = rows.filter(n != 6).select("chunk_id", (F.col("l_orderkey") + F.when(n == 5, 1).otherwise(0)).alias("document_id"), F.sha2(F.when(n == 4, "other").otherwise(F.col("content")), 256).alias("content_sha256")).distinct()
    asked = rows.select(F.col("l_orderkey").alias("question_id"), F.col("l_orderkey").alias("document_id")).distinct()
    provider = lambda requests: rows.select(F.col("l_orderkey").alias("question_id"), "chunk_id", F.col("content").alias("text"))
    return answers.scoped(provider, asked, pinned).groupBy("chunk_id", "rejected").agg(F.count(F.lit(1)).alias("n"))


# --- tables -------------------------------------------------------------------------------------


@query("cell_candidates", """SELECT 'C' || o_custkey AS document_id, row_index::INTEGER AS row_index, metric AS canonical_metric, 'column_label' AS metric_source, value_status, value, metric_year, year_error FROM (
    SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS row_index, '营业收入' AS metric, 'parsed' AS value_status, o_totalprice::DECIMAL(18,2)::DECIMAL(38,12)::VARCHAR AS value, 2021 AS metric_year, NULL AS year_error FROM orders)""")  # fmt: skip
def cell_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The last column of the order tables read as revenue, rows as years."""
    cells = tables.cells(_extracted(spark, sf)).filter("col_index = 2 AND row_index > 1").withColumns({"column_label": F.lit("营业收入"), "row_label": F.lit("2021年"), "unit_hint": F.lit(""), "report_year": F.lit(2021).cast("long")})
    out = fragments.metric_candidates(cells, {"营业收入": "营业收入"}, {})
    return out.select("document_id", "row_index", "canonical_metric", "metric_source", "value_status", F.col("normalized_value").cast("string").alias("value"), "metric_year", "year_error")


@query("table_fragments", """WITH k AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice::DECIMAL(18,2)::VARCHAR AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS r FROM orders)
  SELECT 'C' || o_custkey AS document_id, 'table_row' AS kind, r::INTEGER AS line, o_orderkey || ': Detail=' || o_orderstatus || '; Detail=' || p AS retrieval_text FROM k UNION ALL SELECT 'C' || o_custkey, 'table_row', 1, 'Key: Detail=Status; Detail=Price' FROM orders GROUP BY o_custkey
  UNION ALL SELECT 'C' || o_custkey, 'mixed_narrative', 1, 'These are all the orders of customer ' || o_custkey FROM orders GROUP BY o_custkey""")  # fmt: skip
def table_fragments(spark: SparkSession, sf: str) -> DataFrame:
    rows = fragments.row_fragments(tables.cells(_extracted(spark, sf)))
    docs = table(spark, sf, "orders").select("o_custkey").distinct()
    said = F.array(F.concat(F.lit("These are all  the orders of customer "), "o_custkey"), F.lit("不适用"), F.lit("A heading that is long enough to count"), F.lit("short"))
    blocks = docs.select(F.concat(F.lit("C"), "o_custkey").alias("document_id"), F.lit(0).alias("table_index"), F.posexplode(said).alias("at", "content")).select("document_id", "table_index", (F.col("at") + 1).alias("line"), "content", F.array(F.lit("A heading that is long enough to count")).alias("section_path"))
    return fragments.merged(rows, fragments.narrative_fragments(blocks)).select("document_id", "kind", "line", "retrieval_text")


@query("hydrated_fragments", """WITH k AS (SELECT 'C' || o_custkey AS d, count(*) AS n FROM orders GROUP BY 1) SELECT 'found' AS state, sum(n + 1)::BIGINT AS n FROM k UNION ALL SELECT 'foreign', sum(n + 1)::BIGINT FROM k UNION ALL SELECT 'unknown', 1""")
def hydrated_fragments(spark: SparkSession, sf: str) -> DataFrame:
    rows = fragments.row_fragments(tables.cells(_extracted(spark, sf)))
    asked = rows.select("fragment_id", "document_id")
    foreign = asked.withColumn("document_id", F.lit("elsewhere"))
    unknown = spark.createDataFrame([("frag_none", "C1")], "fragment_id string, document_id string")
    return fragments.hydrate(asked.unionByName(foreign).unionByName(unknown), rows).groupBy("state").agg(F.count(F.lit(1)).alias("n"))
