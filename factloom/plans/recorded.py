"""Public records of facts and the rules that hold for them, catalogues, channels, plans, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import records
from factloom.operators.resolver import corpus_scope
from factloom.plans.register import registry
from factloom.sources import integrity
from factloom.sources.tables import table
from factloom.sources.views import COMPANIES_SQL, FACTS_SQL, companies, facts

QUERIES, ORACLES, query = registry()


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """Facts as a store holds them; every fourth company has no short name, every fifth value a text of its own."""
    rows, code = facts(spark, sf), F.col("stock_code").cast("long")
    return rows.withColumns({
        "stock_name": F.when(code % 4 > 0, F.concat(F.lit("C"), code.cast("string"))).otherwise(""), "company_full": F.concat(F.lit("Company "), code.cast("string")), "normalized_value_text": F.when(code % 5 == 0, F.concat(F.col("normalized_value").cast("string"), F.lit("0"))),
        "statement": F.when(F.col("canonical_metric") != "总资产", "income_statement"), "confidence_score": F.lit("0.9"), "source_table_id": F.concat(F.lit("t"), F.substring("fact_id", 1, 3)), "line_range": F.lit(None).cast("string"),
    })


_STORED_SQL = f"""WITH {FACTS_SQL}, s AS (SELECT *, stock_code::BIGINT AS code FROM facts), r AS (SELECT fact_id, CASE WHEN code % 4 > 0 THEN 'C' || code ELSE 'Company ' || code END AS company, normalized_value::VARCHAR || CASE WHEN code % 5 = 0 THEN '0' ELSE '' END AS normalized_value,
  CASE WHEN canonical_metric <> '总资产' THEN 'income_statement' END AS statement, stock_code, metric_year, canonical_metric, normalized_unit, document_id FROM s)"""


@query("fact_records", f"{_STORED_SQL} SELECT fact_id, company, normalized_value, statement FROM r")
def fact_records(spark: SparkSession, sf: str) -> DataFrame:
    return records.fact_records(_stored(spark, sf)).select("fact_id", "company", "normalized_value", "statement")


@query("record_violations", f"""{_STORED_SQL} SELECT count(*) FILTER (WHERE metric_year NOT IN (1995, 1996, 1997) OR canonical_metric NOT IN ('营业收入', '营业成本')) AS outside, 0 AS repeated_ids, count(*) FILTER (WHERE normalized_unit <> '元') AS other_unit,
  count(*) FILTER (WHERE NOT regexp_matches(normalized_value, '^-?[0-9]+(\\.[0-9]+)?$')) AS no_decimal FROM r""")  # fmt: skip
def record_violations(spark: SparkSession, sf: str) -> DataFrame:
    allowed = {"metric_year": [1995, 1996, 1997], "canonical_metric": ["营业收入", "营业成本"], "stock_code": []}
    return records.record_violations(records.fact_records(_stored(spark, sf)), allowed, "元")


@query("record_shapes", f"{_STORED_SQL} SELECT CASE WHEN statement IS NULL THEN 'statement' END AS missing, count(*) AS n FROM r GROUP BY 1")
def record_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of balance sheets name no statement here."""
    rows = records.fact_records(_stored(spark, sf))
    return rows.groupBy(records.record_shape(rows).alias("missing")).agg(F.count(F.lit(1)).alias("n"))


@query("catalog_search", f"""WITH {COMPANIES_SQL}, y AS (SELECT *, 1990 + stock_code::BIGINT % 5 AS report_year FROM companies)
  SELECT stock_code, nation FROM y WHERE contains(lower(replace(company || nation, ' ', '')), 'nation_1') AND report_year = 1991""")  # fmt: skip
def catalog_search(spark: SparkSession, sf: str) -> DataFrame:
    """Companies whose name and nation hold a text, white space and case aside, in the catalogue of one year."""
    rows = companies(spark, sf).withColumn("report_year", 1990 + F.col("stock_code").cast("long") % 5)
    return records.catalog(rows, F.concat("company", "nation"), " Nation _1", 1991).select("stock_code", "nation")


@query("channel_rows", """WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS m, bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS any_ FROM lineitem) SELECT l_orderkey, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM r WHERE m OR NOT any_ GROUP BY 1""")
def channel_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Returned lines of an order, or all of its lines where none was returned."""
    rows = records.channel(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_orderkey", F.col("l_returnflag") == "R")
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


@query("complete_vectors", "SELECT vec_id, len(embedding) AS size FROM embeddings UNION ALL SELECT vec_id, len(embedding) FROM embeddings WHERE vec_id % 9 = 0")
def complete_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks, some of which are asked for twice, with their vectors."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("hash_id"), "embedding")
    chunks = rows.select("hash_id").unionByName(rows.filter("hash_id % 9 = 0").select("hash_id"))
    return integrity.complete_vectors(chunks, rows).select(F.col("hash_id").alias("vec_id"), F.size("embedding").cast("long").alias("size"))


@query("plan_order", """WITH p AS (SELECT n_name AS id, n_nationkey AS place FROM nation WHERE n_nationkey % 5 <> 4), r AS (SELECT n_name AS id, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 3 > 0 GROUP BY 1)
  SELECT id, place::BIGINT AS place, n, CASE WHEN place IS NULL THEN 'unplanned' WHEN n IS NOT NULL THEN 'found' ELSE 'missing' END AS state FROM p FULL JOIN r USING (id)""")  # fmt: skip
def plan_order(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of nations as the results of a plan over nations; some were not planned, some have no result."""
    nation = table(spark, sf, "nation")
    plan = nation.filter("n_nationkey % 5 <> 4").select(F.col("n_name").alias("id"), F.col("n_nationkey").cast("long").alias("place"))
    met = table(spark, sf, "customer").join(F.broadcast(nation.filter("n_nationkey % 3 > 0")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations, whatever the scale
    return records.in_plan_order(met.groupBy(F.col("n_name").alias("id")).agg(F.count(F.lit(1)).alias("n")), plan, "id")


@query("portable_rows", f"{_STORED_SQL} SELECT fact_id, stock_code, company FROM r")
def portable_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Records without the raw contents that stand beside and inside them, after the check that no name gives an annotation away."""
    rows = records.fact_records(_stored(spark, sf))
    nested = rows.select("fact_id", F.struct("stock_code", F.struct("company", F.lit("x").alias("raw")).alias("own"), F.lit("html").alias("raw")).alias("r"), F.lit("<table>").alias("raw"))
    if records.forbidden_fields(nested.schema, frozenset({"gold", "answer"})):
        raise ValueError("a record names its annotation")
    return records.portable(nested, ("raw",)).select("fact_id", "r.stock_code", "r.own.company")


@query("corpus_scopes", """WITH d AS (SELECT DISTINCT o_custkey, year(o_orderdate)::BIGINT AS y FROM orders), r AS (SELECT n_nationkey AS request_id, CASE n_nationkey % 4 WHEN 0 THEN [] WHEN 1 THEN [1995 + n_nationkey % 3] WHEN 2 THEN [1996, 1997, 1996] ELSE [2050] END::BIGINT[] AS ys, CASE WHEN n_nationkey % 5 = 0 THEN ['lookup'] ELSE ['rank', 'lookup'] END AS intents FROM nation),
  m AS (SELECT request_id, ys, intents, o_custkey, y FROM r LEFT JOIN d ON len(ys) = 0 OR list_contains(ys, y))
  SELECT request_id::BIGINT AS request_id, count(y) AS documents, count(DISTINCT o_custkey) AS companies, coalesce(array_to_string(list_sort(list(DISTINCT y) FILTER (WHERE y IS NOT NULL)), ','), '') AS report_years,
    array_to_string(list_filter([CASE WHEN len(any_value(ys)) > 0 AND count(y) = 0 THEN 'RESOLVER_MISSING' END, CASE WHEN NOT list_contains(any_value(intents), 'rank') THEN 'COMPOSITION_UNSUPPORTED' END], lambda x: x IS NOT NULL), ',') AS findings FROM m GROUP BY request_id""")  # fmt: skip
def corpus_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """A request of each nation for all years, for some or for one without a report; a report is a customer's year."""
    k = F.col("n_nationkey")
    years = F.when(k % 4 == 0, F.array().cast("array<bigint>")).when(k % 4 == 1, F.array((1995 + k % 3).cast("long"))).when(k % 4 == 2, F.array(*[F.lit(y).cast("long") for y in (1996, 1997, 1996)])).otherwise(F.array(F.lit(2050).cast("long")))
    requests = table(spark, sf, "nation").select(k.cast("long").alias("request_id"), years.alias("report_years"), F.when(k % 5 == 0, F.array(F.lit("lookup"))).otherwise(F.array(F.lit("rank"), F.lit("lookup"))).alias("intents"))
    year = F.year("o_orderdate").cast("long")
    documents = table(spark, sf, "orders").select(F.concat_ws("_", "o_custkey", year).alias("document_id"), F.col("o_custkey").alias("stock_code"), year.alias("report_year")).distinct()
    out = corpus_scope(requests, documents)
    return out.select("request_id", "documents", "companies", F.array_join(F.col("report_years").cast("array<string>"), ",").alias("report_years"), F.array_join("findings", ",").alias("findings"))
