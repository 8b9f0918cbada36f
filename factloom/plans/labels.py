"""Corpus scans and label functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import labels
from factloom.operators import corpus
from factloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


@_query("document_stats", r"""SELECT doc_id, len(string_split(text, chr(10))) AS lines, md5(list_filter(list_transform(string_split(text, chr(10))[1:80], lambda x: trim(x, ' ')), lambda x: x <> '')[1]) AS first_line FROM documents""")
def document_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", corpus.statistics(F.col("text")).alias("s"), corpus.header(F.col("text")).alias("h"))
    return rows.select("doc_id", "s.lines", F.md5("h.first_line").alias("first_line"))


@_query("file_name_parse", """WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'A' || lpad((c_custkey % 1000000)::VARCHAR, 6, '0') || '_2021_' || c_mktsegment || '.md' END AS name, c_mktsegment FROM customer)
  SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN lpad((c_custkey % 1000000)::VARCHAR, 6, '0') END AS stock_code, CASE WHEN c_custkey % 3 <> 0 THEN '2021' END AS report_year, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS rest,
    CASE WHEN c_custkey % 3 = 0 THEN 'unexpected_file_name' END AS warning FROM n""")  # fmt: skip
def file_name_parse(spark: SparkSession, sf: str) -> DataFrame:
    code = F.lpad(F.pmod("c_custkey", F.lit(1_000_000)).cast("string"), 6, "0")
    name = F.when(F.pmod("c_custkey", F.lit(3)) == 0, F.col("c_name")).otherwise(F.concat(F.lit("A"), code, F.lit("_2021_"), "c_mktsegment", F.lit(".md")))
    rows = table(spark, sf, "customer").select("c_custkey", corpus.parse_name(name).alias("n"))
    return rows.select("c_custkey", "n.stock_code", F.col("n.report_year").cast("string").alias("report_year"), "n.rest", "n.warning")


@_query("fingerprint_diff", """WITH a AS (SELECT l_orderkey AS k, l_returnflag || l_linestatus AS f, count(*) AS n FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL), b AS (SELECT l_orderkey AS k, l_returnflag || l_linestatus AS f, count(*) AS m FROM lineitem WHERE l_linenumber >= 2 GROUP BY ALL)
  SELECT k AS l_orderkey, sum(least(coalesce(n, 0), coalesce(m, 0)))::BIGINT AS kept, sum(greatest(coalesce(m, 0) - coalesce(n, 0), 0))::BIGINT AS added, sum(greatest(coalesce(n, 0) - coalesce(m, 0), 0))::BIGINT AS lost FROM a FULL JOIN b USING (k, f) GROUP BY k""")  # fmt: skip
def fingerprint_diff(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("f"))
    return corpus.fingerprint_diff(rows.filter("l_linenumber <= 4"), rows.filter("l_linenumber >= 2"), ["l_orderkey", "f"])


_ALIASES, _PATTERNS = {"BUILDING": "建筑", "MACHINERY": "机械"}, {"^AUTO": "汽车", "^(AUTO|HOUSE)": "家居"}


@_query("metric_label_match", """SELECT c_mktsegment AS label, CASE c_mktsegment WHEN 'BUILDING' THEN '建筑' WHEN 'MACHINERY' THEN '机械' WHEN 'HOUSEHOLD' THEN '家居' END AS metric,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'exact_alias' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'regex' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'ambiguous' ELSE 'none' END AS match, count(*) AS n FROM customer GROUP BY ALL""")  # fmt: skip
def metric_label_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("label"), labels.metric_of_label(F.col("c_mktsegment"), _ALIASES, _PATTERNS).alias("m"))
    return rows.groupBy("label", F.col("m.metric").alias("metric"), F.col("m.match").alias("match")).agg(F.count(F.lit(1)).alias("n"))


@_query("period_states", """WITH h AS (SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, CASE o_orderkey % 4 WHEN 0 THEN year(o_orderdate) || '年' WHEN 1 THEN '本期' WHEN 2 THEN '期初至期末' ELSE '项目' END AS header FROM orders)
  SELECT o_orderkey, header, CASE o_orderkey % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'resolved' WHEN 2 THEN 'conflict' ELSE 'unknown' END AS status, CASE WHEN o_orderkey % 4 <= 1 THEN y::VARCHAR END AS value FROM h""")  # fmt: skip
def period_states(spark: SparkSession, sf: str) -> DataFrame:
    y, k = F.year("o_orderdate"), F.pmod("o_orderkey", F.lit(4))
    header = F.when(k == 0, F.concat(y.cast("string"), F.lit("年"))).when(k == 1, "本期").when(k == 2, "期初至期末").otherwise("项目")
    rows = table(spark, sf, "orders").select("o_orderkey", header.alias("header"), labels.period_state(header, y).alias("p"))
    return rows.select("o_orderkey", "header", "p.status", F.col("p.value").cast("string").alias("value"))


@_query("heading_rerank", """WITH c AS (SELECT doc_id, lang, CASE doc_id % 3 WHEN 0 THEN '单位：万元' WHEN 1 THEN '不适用' ELSE 'a real passage' END AS content, ((doc_id * 37) % 1000) / 1000.0 AS dense FROM documents),
  s AS (SELECT doc_id, lang, round(dense + CASE lang WHEN 'en' THEN 0.24 WHEN 'de' THEN 0.24 ELSE 0 END - CASE doc_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.48 ELSE 0 END, 8)::DOUBLE AS score FROM c)
  SELECT lang, doc_id, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5""")  # fmt: skip
def heading_rerank(spark: SparkSession, sf: str) -> DataFrame:
    from factloom.operators.retrieval import top

    k = F.pmod("doc_id", F.lit(3))
    content = F.when(k == 0, "单位：万元").when(k == 1, "不适用").otherwise("a real passage")
    topics = [("en", "english"), ("de", "german")]
    adjust = labels.heading_adjustment(F.lit("english and german reports"), F.array("lang"), topics, content)
    rows = table(spark, sf, "documents").select("lang", "doc_id", F.round(F.pmod(F.col("doc_id") * 37, F.lit(1000)) / 1000.0 + adjust, 8).alias("score"))
    return top(rows, ["lang"], "score", "doc_id", 5)


@_query("triple_confidence", """SELECT event_id, round(greatest(0.05, least(1.0, CASE WHEN length(event_type) < 2 THEN 0.7 ELSE 1.0 END::DOUBLE * CASE WHEN contains(lower(props), user_id::VARCHAR) THEN 1.0 ELSE 0.9 END * 0.9 * CASE WHEN event_id % 2 = 0 THEN 1.05 ELSE 1 END * CASE WHEN event_id % 5 = 0 THEN 0.85 ELSE 1 END
  * CASE WHEN length(user_id::VARCHAR) < 2 THEN 0.7 ELSE 1.0 END)), 6)::DOUBLE AS confidence FROM events""")  # fmt: skip
def triple_confidence(spark: SparkSession, sf: str) -> DataFrame:
    known = F.array(F.when(F.pmod("event_id", F.lit(2)) == 0, F.col("event_type")).otherwise("none"))
    c = labels.triple_confidence(F.col("user_id").cast("string"), F.lit("did"), F.col("event_type"), F.col("props"), known, F.pmod("event_id", F.lit(5)) == 0)
    return table(spark, sf, "events").select("event_id", F.round(c, 6).alias("confidence"))
