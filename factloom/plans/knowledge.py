"""Facts and entities of a graph, how they are found and judged, evaluation reports, texts of facts and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import evaluation, graph
from factloom.plans.register import registry
from factloom.sources.tables import table

QUERIES, ORACLES, query = registry()


def _triples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), F.pmod("l_suppkey", F.lit(20))).alias("subject"), F.when(F.col("l_linenumber") < 7, F.concat(F.lit("Has"), "l_returnflag")).alias("predicate"), F.concat(F.lit("P"), F.pmod("l_partkey", F.lit(50))).alias("object"),
        F.col("l_discount").alias("confidence"), F.concat(F.lit("text "), F.col("l_orderkey")).alias("text"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.col("l_orderkey").alias("chunk_id"),
    )


_TRIPLES_SQL = "t AS (SELECT 'S' || l_suppkey % 20 AS s, CASE WHEN l_linenumber < 7 THEN 'Has' || l_returnflag END AS p, 'P' || l_partkey % 50 AS o, l_discount AS c, 'text ' || l_orderkey AS text, l_orderkey * 10 + l_linenumber AS n, l_orderkey AS chunk_id FROM lineitem)"


@query("fact_confidences", f"WITH {_TRIPLES_SQL} SELECT lower(s) AS subject, lower(p) AS predicate, lower(o) AS object, max(c) AS confidence, arg_min(text, n) AS text FROM t GROUP BY 1, 2, 3")
def fact_confidences(spark: SparkSession, sf: str) -> DataFrame:
    return graph.best_facts(_triples(spark, sf))


@query("chunk_entities", f"WITH {_TRIPLES_SQL} SELECT DISTINCT chunk_id, unnest([s, o]) AS entity FROM t WHERE p IS NOT NULL")
def chunk_entities(spark: SparkSession, sf: str) -> DataFrame:
    return graph.chunk_entities(_triples(spark, sf))


@query("distinct_triples", f"WITH {_TRIPLES_SQL}, g AS (SELECT chunk_id, list([s, p, o] ORDER BY n) FILTER (WHERE p IS NOT NULL) AS v, list(['x', 'y']) AS bad FROM t GROUP BY 1) SELECT chunk_id, coalesce(len(list_distinct(v)), 0) AS n FROM g")
def distinct_triples(spark: SparkSession, sf: str) -> DataFrame:
    """Per chunk its triples, those of two parts thrown in, filtered."""
    rows = _triples(spark, sf).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.when(F.col("predicate").isNull(), F.array("subject", "object")).otherwise(F.array("subject", "predicate", "object")).alias("t")))).alias("t"))
    return rows.select("chunk_id", F.size(text.valid_triples(F.transform("t", lambda x: x["t"]))).cast("long").alias("n"))


_EXTRACTED_SQL = """e AS (SELECT l_orderkey AS chunk_id, 'They said S' || min(l_suppkey) || ' sells P' || min(l_partkey) AS content, list('S' || l_suppkey ORDER BY l_linenumber, l_suppkey, l_partkey) || ['They'] AS named, l_orderkey % 13 = 0 AS bad,
  list(CASE WHEN l_linenumber % 5 = 4 THEN ['S' || l_suppkey, 'P' || l_partkey] ELSE ['S' || l_suppkey, 'sells', 'P' || l_partkey] END ORDER BY l_linenumber, l_suppkey, l_partkey) AS t FROM lineitem GROUP BY l_orderkey)"""


@query("merged_extractions", f"""WITH {_EXTRACTED_SQL}, w AS (SELECT *, list_filter(t, lambda x: len(x) = 3) AS w FROM e),
  c AS (SELECT chunk_id, list_transform(w, lambda x: round(greatest(0.05, least(1.0, 1.0::DOUBLE * CASE WHEN contains(lower(content), lower(x[1])) THEN 1.0 ELSE 0.9 END * 1.05 * CASE WHEN contains(lower(content), lower(x[3])) THEN 1.0 ELSE 0.9 END * CASE WHEN chunk_id % 4 = 0 THEN 0.85 ELSE 1.0 END)), 6)) AS sure FROM w)
  SELECT chunk_id, bad AS failed, CASE WHEN bad THEN '' ELSE array_to_string(list_sort(list_distinct(list_filter(list_transform(named || flatten(list_transform(w, lambda x: [x[1], x[3]])), lambda x: lower(x)), lambda x: x <> 'they'))), ',') END AS entities,
    CASE WHEN bad THEN '' ELSE array_to_string(list_transform(w, lambda x: lower(array_to_string(x, '/'))), ',') END AS triples, CASE WHEN bad THEN 0 ELSE round(coalesce(list_sum(sure), 0), 6) END AS confidence FROM w JOIN c USING (chunk_id)""")  # fmt: skip
def merged_extractions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as chunks: suppliers are named, who sells what is stated; some triples have two parts, some extractions failed."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_suppkey", "l_partkey").alias("k"), F.concat(F.lit("S"), "l_suppkey").alias("s"), F.concat(F.lit("P"), "l_partkey").alias("p"), "l_suppkey", "l_partkey")
    triple = F.when(F.col("k.l_linenumber") % 5 == 4, F.array("s", "p")).otherwise(F.array("s", F.lit("sells"), "p"))
    own = lines.groupBy(F.col("l_orderkey").alias("chunk_id")).agg(
        F.concat(F.lit("They said S"), F.min("l_suppkey"), F.lit(" sells P"), F.min("l_partkey")).alias("content"), F.array_sort(F.collect_list(F.struct("k", "s", triple.alias("t")))).alias("x")
    )
    bad = F.col("chunk_id") % 13 == 0
    entities = own.select("chunk_id", F.when(~bad, F.concat(F.transform("x", lambda x: x["s"]), F.array(F.lit("They")))).alias("entities"))
    triples = own.filter(~bad).select("chunk_id", F.transform("x", lambda x: x["t"]).alias("triples"), (F.col("chunk_id") % 4 == 0).alias("cut_short"))
    out = graph.merge_extractions(own.select("chunk_id", "content"), entities, triples)
    total = F.round(F.aggregate("confidences", F.lit(0.0), lambda a, x: a + x), 6)
    return out.select("chunk_id", "failed", F.array_join("entities", ",").alias("entities"), F.array_join(F.transform("triples", lambda t: F.array_join(t, "/")), ",").alias("triples"), total.alias("confidence"))


_COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12)"
_SCORED_SQL = f"""d AS (SELECT a.vec_id AS query_id, b.vec_id AS fact_id, {_COS} AS d FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0), r AS (SELECT *, min(d) OVER (PARTITION BY query_id) AS low, max(d) OVER (PARTITION BY query_id) AS high FROM d)"""


@query("fact_scores", f"WITH {_SCORED_SQL} SELECT query_id, fact_id, round((d - low) / (high - low), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, fact_id) AS rank FROM r QUALIFY rank <= 5")
def fact_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("fact_id"), "embedding")
    asked = rows.filter("fact_id % 50 = 0").select(F.col("fact_id").alias("query_id"), "embedding")
    return graph.score_facts(rows, asked, "embedding", 5).withColumn("score", F.round("score", 6))


@query("dense_passages", f"""WITH v AS (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 10000000, embedding FROM embeddings WHERE vec_id % 7 = 0), d AS (SELECT a.vec_id AS query_id, b.vec_id AS passage_id, {_COS} AS d FROM embeddings a, v b WHERE a.vec_id % 50 = 0),
  r AS (SELECT *, min(d) OVER (PARTITION BY query_id) AS low, max(d) OVER (PARTITION BY query_id) AS high FROM d) SELECT query_id, passage_id, round((d - low) / (high - low), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, passage_id DESC) AS rank FROM r QUALIFY rank <= 5""")  # fmt: skip
def dense_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh passage is there twice; of ties the later one comes first."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("passage_id"), "embedding")
    both = rows.unionByName(rows.filter("passage_id % 7 = 0").withColumn("passage_id", F.col("passage_id") + 10_000_000))
    asked = rows.filter("passage_id % 50 = 0").select(F.col("passage_id").alias("query_id"), "embedding")
    return graph.dense_passages(both, asked, "passage_id", "embedding", 5).withColumn("score", F.round("score", 6))


@query("entity_links", """WITH e AS (SELECT p_partkey AS entity_id, lower(p_name) AS norm FROM part), m AS (SELECT DISTINCT p_name AS mention, lower(p_name) AS norm FROM part UNION SELECT 'Quite Unheard Of', 'quite unheard of')
  SELECT mention, entity_id, 1 AS tier FROM m JOIN e USING (norm) UNION ALL SELECT 'Quite Unheard Of', 7, 3""")  # fmt: skip
def entity_links(spark: SparkSession, sf: str) -> DataFrame:
    """Part names by their equal form; a name that is none, only by its vector. The middle tier is ``fuzzy_match``, tested by brute force."""
    parts = table(spark, sf, "part")
    known = parts.select(F.col("p_partkey").alias("entity_id"), F.lower("p_name").alias("norm"))
    new = spark.createDataFrame([("Quite Unheard Of",)], "mention string")
    asked = parts.select(F.col("p_name").alias("mention")).distinct().unionByName(new)
    near = spark.createDataFrame([("Quite Unheard Of", 7, 0.85), ("Quite Unheard Of", 8, 0.5)], "mention string, entity_id long, score double")
    return graph.link_entities(asked.withColumn("norm", text.entity(F.col("mention"))), known, 0.9, near)


@query("judged_chunks", """WITH j AS (SELECT l_orderkey, l_linenumber, l_linenumber * 1000000 + l_partkey AS position, CASE WHEN l_quantity > 35 THEN 'keep' WHEN l_quantity > 33 THEN 'error' WHEN l_quantity > 30 THEN 'unparseable' ELSE 'drop' END AS verdict, l_extendedprice AS x FROM lineitem),
  k AS (SELECT *, count(*) FILTER (WHERE verdict IN ('keep', 'error')) OVER (PARTITION BY l_orderkey) AS kept, row_number() OVER (PARTITION BY l_orderkey ORDER BY position, x) AS place FROM j)
  SELECT l_orderkey, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM k WHERE CASE WHEN kept < 2 THEN place <= 2 ELSE verdict IN ('keep', 'error') END GROUP BY 1""")  # fmt: skip
def judged_chunks(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    verdict = F.when(q > 35, "keep").when(q > 33, "error").when(q > 30, "unparseable").otherwise("drop")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.struct((F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("p"), "l_extendedprice").alias("position"), verdict.alias("verdict"))
    return graph.keep_fallback(rows, "l_orderkey", 2).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


# --- evaluation ---------------------------------------------------------------------------------


@query("cluster_means", "SELECT l_orderkey, l_returnflag, round(avg(l_discount), 9) AS mean, count(*) AS n FROM lineitem GROUP BY ALL")
def cluster_means(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.cluster_means(table(spark, sf, "lineitem"), ["l_orderkey", "l_returnflag"], "l_discount").withColumn("mean", F.round("mean", 9))


@query("best_similarity", """WITH s AS (SELECT l_orderkey, l_linenumber, least(1, greatest(0, (l_quantity - 25) / 20)) AS s, l_linenumber * 1000000 + l_partkey AS pos FROM lineitem) SELECT l_orderkey, round(max(s), 6)::DOUBLE AS similarity, CASE WHEN max(s) > 0 THEN arg_max(l_linenumber, (s, -pos)) END AS best_reference FROM s GROUP BY 1""")
def best_similarity(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_quantity") - 25) / 20).alias("cosine"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("position"))
    return evaluation.best_similarity(rows, ["l_orderkey"], "l_linenumber", "cosine").withColumn("similarity", F.round("similarity", 6))


@query("prompt_scores", """WITH s AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS sim, CASE l_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN l_linenumber % 2 = 0 ELSE l_linenumber % 3 = 0 END AS a, CASE l_orderkey % 4 WHEN 0 THEN NULL ELSE l_linenumber % 2 = 1 END AS k FROM lineitem)
  SELECT l_orderkey, l_linenumber, round(CASE WHEN a IS NULL AND k IS NULL THEN sim WHEN a IS NULL THEN CASE WHEN k THEN 0.25 ELSE 0 END + 0.75 * sim WHEN a THEN 0.25 + CASE WHEN coalesce(k, false) THEN 0.25 ELSE 0 END + 0.5 * sim ELSE 0 END, 6)::DOUBLE AS score,
    CASE WHEN a IS NULL AND k IS NULL THEN 'no_prompt_similarity_only' WHEN a IS NULL THEN 'no_prom_answer' || CASE WHEN k THEN '_keyword_matched' ELSE '_keyword_missing' END WHEN a THEN 'prom_answer_matched' || CASE WHEN k IS NULL THEN '_no_keyword' WHEN k THEN '_keyword_matched' ELSE '_keyword_missing' END
      ELSE 'prom_answer_not_matched' END AS reason FROM s""")  # fmt: skip
def prompt_scores(spark: SparkSession, sf: str) -> DataFrame:
    n, o = F.col("l_linenumber"), F.col("l_orderkey")
    answer = F.when(o % 3 == 1, n % 2 == 0).when(o % 3 == 2, n % 3 == 0)
    keyword = F.when(o % 4 != 0, n % 2 == 1)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", evaluation.prompt_score(F.col("l_discount") * 10, answer, keyword).alias("s")).select("l_orderkey", "l_linenumber", "s.*")


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as cases: open ones failed, by priority and status."""
    reasons = F.array_compact(F.array(F.when(F.col("o_totalprice") > 100000, "too_dear"), F.when(F.col("o_orderpriority") == "1-URGENT", "urgent"), F.when(F.col("o_orderstatus") == "O", "open")))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderstatus") != "O").alias("passed"), (F.pmod("o_orderkey", F.lit(97)) / 8.0).alias("elapsed_seconds"), reasons.alias("failure_reasons"), F.col("o_orderpriority").alias("prompt_key"))


@query("regression_report", """SELECT count(*) AS completed, count(*) FILTER (WHERE o_orderstatus <> 'O') AS passed, count(*) FILTER (WHERE o_orderstatus = 'O') AS failed, round(count(*) FILTER (WHERE o_orderstatus <> 'O')::DOUBLE / count(*), 4) AS pass_rate,
  round(avg(o_orderkey % 97 / 8.0), 3)::DOUBLE AS average_seconds, round(max(o_orderkey % 97 / 8.0), 3)::DOUBLE AS longest_seconds FROM orders""")  # fmt: skip
def regression_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.regression_report(_cases(spark, sf))


@query("failure_reasons", """SELECT name, count(*) AS n FROM (SELECT unnest([CASE WHEN o_totalprice > 100000 THEN 'too_dear' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END, 'open']) AS name FROM orders WHERE o_orderstatus = 'O') WHERE name IS NOT NULL GROUP BY 1""")
def failure_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.failure_counts(_cases(spark, sf), "failure_reasons")


@query("failures_by_prompt", "SELECT o_orderpriority AS prompt_key, count(*) AS completed, count(*) FILTER (WHERE o_orderstatus = 'O') AS failed FROM orders GROUP BY 1")
def failures_by_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.by_prompt(_cases(spark, sf), "prompt_key")


@query("snapshot_difference", """WITH l AS (SELECT l_returnflag AS arm, l_orderkey AS c, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids, max(l_discount) AS r FROM lineitem GROUP BY ALL),
  g AS (SELECT l_returnflag AS arm, l_orderkey AS c, list(CASE WHEN l_linenumber = 3 THEN 0 ELSE l_partkey END ORDER BY l_linenumber, CASE WHEN l_linenumber = 3 THEN 0 ELSE l_partkey END) AS ids, max(l_discount) AS r FROM lineitem WHERE l_orderkey % 10 <> 0 GROUP BY ALL)
  SELECT arm, count(*) FILTER (WHERE l.ids <> g.ids) AS differing, count(*) FILTER (WHERE g.ids IS NULL) AS unpaired, round(avg(l.r), 8) AS left_recall, round(avg(g.r), 8) AS right_recall FROM l LEFT JOIN g USING (arm, c) GROUP BY arm""")  # fmt: skip
def snapshot_difference(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_orderkey").alias("c"), F.struct("l_linenumber", "l_partkey").alias("rank"), F.col("l_partkey").alias("candidate_id"), F.col("l_discount").alias("recall"), "l_linenumber")
    changed = F.when(F.col("l_linenumber") == 3, F.lit(0)).otherwise(F.col("candidate_id"))
    other = rows.filter("c % 10 <> 0").withColumn("candidate_id", changed).withColumn("rank", F.struct("l_linenumber", F.col("candidate_id").alias("l_partkey")))
    return evaluation.snapshot_difference(rows.drop("l_linenumber"), other.drop("l_linenumber"), "arm", "c", "recall")


@query("labels_by_company", """WITH r AS (SELECT l_suppkey, 'L' || l_partkey AS label, max(l_discount) AS c FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY c DESC, label) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM r)
  SELECT l_suppkey, any_value(n) AS n, string_agg(label, ',' ORDER BY r) AS labels FROM k WHERE r <= 3 GROUP BY 1""")  # fmt: skip
def labels_by_company(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy("l_suppkey", F.concat(F.lit("L"), "l_partkey").alias("label")).agg(F.max("l_discount").alias("c"))
    return evaluation.labels_by_company(rows, "l_suppkey", "label", "c", 3).withColumn("labels", F.array_join("labels", ","))


@query("same_rows", """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders), g AS (SELECT k, CASE WHEN k % 11 = 0 THEN 'X' ELSE v END AS v FROM o WHERE k % 5 <> 0), a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
  SELECT count(*) FILTER (WHERE g.k IS NOT NULL AND a.k IS NOT NULL) AS complete, count(*) FILTER (WHERE g.k IS NULL OR a.k IS NULL) AS incomplete, 0 AS repeated, count(*) FILTER (WHERE o.v <> g.v) AS differing FROM o LEFT JOIN g USING (k) LEFT JOIN a USING (k)""")  # fmt: skip
def same_rows(spark: SparkSession, sf: str) -> DataFrame:
    oracle = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    gold = oracle.filter("k % 5 <> 0").withColumn("v", F.when(F.col("k") % 11 == 0, "X").otherwise(F.col("v")))
    answers = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit("").alias("v")).distinct()
    return evaluation.same_rows(oracle, gold, answers, "k", "v")
