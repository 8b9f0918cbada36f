"""Retrieval inside documents: weighted fields, dense, sparse and hybrid rankings, table rows, sentences, their measures.

A label of the vector table stands for a document, its vectors for units; the words of
a unit follow from its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import impact
from factloom.operators import retrieval as ops
from factloom.plans.register import registry
from factloom.sources.tables import table

QUERIES, ORACLES, query = registry()


def _word(letter: str, n: int):
    return F.concat(F.lit(letter), F.pmod("vec_id", F.lit(n)))


def _units(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("document_id"), F.col("vec_id").alias("unit_id"), F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vector"),
        F.array(_word("a", 7), _word("b", 11), _word("a", 3)).alias("body"), F.array(_word("h", 5), _word("a", 13)).alias("heading"), F.array(_word("b", 4)).alias("adjacency"),
    )


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Units whose number is divisible by 50 ask their own document."""
    rows = table(spark, sf, "embeddings").filter("vec_id % 50 = 0")
    return rows.select(F.col("vec_id").alias("question_id"), F.col("label").alias("document_id"), F.col("embedding").alias("vector"), F.array(_word("a", 7), _word("b", 4), _word("h", 5), _word("a", 7)).alias("tokens"))


_UNITS_SQL = """u AS (SELECT label AS document_id, vec_id AS unit_id, embedding, 3 + 1.25 * 2 + 0.55 AS length FROM embeddings),
  e AS (SELECT document_id, unit_id, length, unnest(['a' || unit_id % 7, 'b' || unit_id % 11, 'a' || unit_id % 3, 'h' || unit_id % 5, 'a' || unit_id % 13, 'b' || unit_id % 4]) AS token, unnest([1, 1, 1, 1.25, 1.25, 0.55])::DOUBLE AS f FROM u),
  q AS (SELECT vec_id AS question_id, label AS document_id, embedding AS qv, ['a' || vec_id % 7, 'b' || vec_id % 4, 'h' || vec_id % 5, 'a' || vec_id % 7] AS tokens FROM embeddings WHERE vec_id % 50 = 0),
  asked AS (SELECT question_id, document_id, token, count(*) AS qtf FROM (SELECT question_id, document_id, unnest(tokens) AS token FROM q) GROUP BY ALL),"""


def _fields_sql(scope: str) -> str:
    """BM25 with one corpus (scope empty) or one for each document."""
    by = "document_id, " if scope else ""
    on = "document_id, " if scope else ""
    n = "SELECT document_id, count(*) AS n, avg(length) AS average FROM u GROUP BY 1" if scope else "SELECT count(*) AS n, avg(length) AS average FROM u"
    return f"""{_UNITS_SQL} post AS (SELECT {by}unit_id, token, sum(f) AS tf, any_value(length) AS length FROM e GROUP BY {by}unit_id, token), df AS (SELECT {by}token, count(*) AS df FROM post GROUP BY ALL), st AS ({n}),
  sparse AS (SELECT question_id, unit_id, round(sum(qtf * ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 8) AS s
    FROM asked JOIN df USING ({on}token) JOIN post USING ({on}token) JOIN st {'USING (document_id)' if scope else 'ON true'} GROUP BY ALL)"""


@query("bm25_fields", f"WITH {_fields_sql('')} SELECT question_id, unit_id, round(s, 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY round(s, 6) DESC, unit_id) AS rank FROM sparse QUALIFY rank <= 10")
def bm25_fields(spark: SparkSession, sf: str) -> DataFrame:
    """All units, whatever their document, by body, heading and adjacency."""
    asked = impact.asked_tokens(_asked(spark, sf), "question_id", F.col("tokens"))
    post = impact.Postings(_units(spark, sf), "unit_id", {n: (F.col(n), w) for n, w in ops.FIELDS.items()}, asked.select("token").distinct())
    return impact.search(post.bm25(), asked, "unit_id", "question_id", post.n, 10)


_HYBRID_SQL = f"""WITH {_fields_sql('document')}, p AS (SELECT q.question_id, u.unit_id, round(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 8) AS dense_score, coalesce(s, 0) AS sparse_score
    FROM q JOIN u USING (document_id) LEFT JOIN sparse USING (question_id, unit_id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY dense_score DESC, unit_id) AS d, row_number() OVER (PARTITION BY question_id ORDER BY sparse_score DESC, unit_id) AS s FROM p)"""


def _hybrid(mode: str, score: str):
    sql = f"""{_HYBRID_SQL}, f AS (SELECT question_id, unit_id, {score} AS score FROM r WHERE unit_id % 9 <> 4)
      SELECT question_id, unit_id, round(score, 8)::DOUBLE AS score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, unit_id) AS rank FROM f QUALIFY rank <= 5"""

    @query(f"{mode}_retrieve", sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """Every ninth unit counts as nothing but formulas."""
        out = ops.hybrid(_units(spark, sf), _asked(spark, sf), 5, F.pmod("unit_id", F.lit(9)) == 4, mode)
        return out.select("question_id", "unit_id", F.round("score", 8).alias("score"), "rank")


_hybrid("hybrid", "round(1.0::DOUBLE / (60 + d) + 1.0::DOUBLE / (60 + s), 12)")
_hybrid("dense", "dense_score")
_hybrid("sparse", "sparse_score")


@query("quota_retrieve", f"""{_HYBRID_SQL}, b AS (SELECT question_id, unit_id, d AS rank, 0 AS channel FROM r WHERE d <= 3 UNION ALL SELECT question_id, unit_id, s, 1 FROM r WHERE s <= 2)
  SELECT question_id, unit_id, channel, place, round(1 - place / 1000000.0, 8)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank, channel) - 1 AS place FROM b) WHERE place < 5""")  # fmt: skip
def quota_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """Dense results stand for texts, sparse ones for table rows."""
    dense, sparse = (ops.hybrid(_units(spark, sf), _asked(spark, sf), 5, None, m) for m in ("dense", "sparse"))
    return ops.with_table_quota(dense, sparse, "question_id", "unit_id", 5)


_CASES_SQL = f"""{_HYBRID_SQL}, ranked AS (SELECT question_id, unit_id, d AS rank FROM r WHERE d <= 20), gold AS (SELECT question_id, unit_id, ['f' || unit_id % 3, 'f' || unit_id % 4] AS facet_ids FROM r WHERE s <= 3),
  g AS (SELECT question_id, unit_id, facet_ids, rank FROM gold LEFT JOIN ranked USING (question_id, unit_id)), c AS (SELECT question_id, min(rank) AS best, count(*) AS n, count(*) FILTER (WHERE rank <= 5) AS h5, count(*) FILTER (WHERE rank <= 15) AS h15 FROM g GROUP BY 1),
  f AS (SELECT question_id, facet, min(rank) AS best FROM (SELECT question_id, rank, unnest(facet_ids) AS facet FROM g) GROUP BY ALL)"""


@query("evidence_metrics", f"""{_CASES_SQL} SELECT count(*) AS cases, sum(n)::BIGINT AS gold, round(avg(coalesce(1.0::DOUBLE / best, 0)), 8) AS mrr, round(sum(h5)::DOUBLE / sum(n), 8) AS recall_at_5, round(sum(h15)::DOUBLE / sum(n), 8) AS recall_at_15,
  round(count(*) FILTER (WHERE best <= 5)::DOUBLE / count(*), 8) AS case_coverage_at_5, round(count(*) FILTER (WHERE best <= 15)::DOUBLE / count(*), 8) AS case_coverage_at_15,
  (SELECT round(count(*) FILTER (WHERE best <= 5)::DOUBLE / count(*), 8) FROM f) AS facet_coverage_at_5, (SELECT round(count(*) FILTER (WHERE best <= 15)::DOUBLE / count(*), 8) FROM f) AS facet_coverage_at_15 FROM c""")  # fmt: skip
def evidence_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Dense rankings held against the three best sparse results."""
    ranked = ops.hybrid(_units(spark, sf), _asked(spark, sf), 20, None, "dense")
    gold = ops.hybrid(_units(spark, sf), _asked(spark, sf), 3, None, "sparse")
    gold = gold.select("question_id", "unit_id", F.array(F.concat(F.lit("f"), F.pmod("unit_id", F.lit(3))), F.concat(F.lit("f"), F.pmod("unit_id", F.lit(4)))).alias("facet_ids"))
    return ops.evidence_metrics(ranked.select("question_id", "unit_id", "rank"), gold, "question_id", "unit_id")


# --- rows of tables and lines of texts ----------------------------------------------------------


def _fragments(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of a customer's orders as table rows and, where returned, narratives; the customer is the document."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("o_custkey").alias("document_id"), F.pmod("l_orderkey", F.lit(10)).alias("table_index"), F.concat(F.lit("t"), "l_orderkey").alias("table_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("fragment_id"),
        F.when(F.col("l_returnflag") == "R", "mixed_narrative").otherwise("table_row").alias("kind"), F.col("l_linenumber").alias("line"),
        F.array_distinct(F.array(F.concat(F.lit("p"), F.pmod("l_partkey", F.lit(9))), F.concat(F.lit("s"), F.pmod("l_suppkey", F.lit(5))), F.col("l_linestatus"))).alias("tokens"), F.array(F.concat(F.lit("p"), F.pmod("l_partkey", F.lit(9))), F.lit("x")).alias("labels"),
    )


@query("table_search", """WITH f AS (SELECT o_custkey AS document_id, l_orderkey % 10 AS table_index, 't' || l_orderkey AS table_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS fragment_id, l_returnflag = 'R' AS mixed, l_linenumber AS line,
    ['p' || l_partkey % 9, 's' || l_suppkey % 5, l_linestatus] AS tokens, 'p' || l_partkey % 9 AS label FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  q AS (SELECT c_custkey AS document_id, ['p' || c_custkey % 9, 's' || c_custkey % 5, 'O', 'none'] AS tokens, 'part p' || c_custkey % 9 || ' of s' || c_custkey % 5 AS text FROM customer), n AS (SELECT document_id, count(*) AS n FROM f GROUP BY 1),
  post AS (SELECT document_id, fragment_id, unnest(tokens) AS token FROM f), df AS (SELECT document_id, token, count(*) AS df FROM post GROUP BY ALL),
  w AS (SELECT document_id, fragment_id, sum(ln((n + 1.0) / (df + 1.0)) + 1.0) / 4 AS w FROM (SELECT document_id, unnest(tokens) AS token FROM q) JOIN df USING (document_id, token) JOIN n USING (document_id) JOIN post USING (document_id, token) GROUP BY ALL),
  s AS (SELECT f.*, round(w + CASE WHEN contains(text, label) THEN 0.1 ELSE 0 END + CASE WHEN mixed THEN 0.01 ELSE 0 END, 8) AS score FROM w JOIN f USING (document_id, fragment_id) JOIN q USING (document_id))
  SELECT document_id AS question_id, fragment_id, score, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, table_index, table_id, mixed, line, fragment_id) AS rank FROM s QUALIFY rank <= 5""")  # fmt: skip
def table_search(spark: SparkSession, sf: str) -> DataFrame:
    part, supplier = F.concat(F.lit("p"), F.pmod("c_custkey", F.lit(9))), F.concat(F.lit("s"), F.pmod("c_custkey", F.lit(5)))
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("question_id"), F.col("c_custkey").alias("document_id"), F.array(part, supplier, F.lit("O"), F.lit("none")).alias("tokens"), F.concat(F.lit("part "), part, F.lit(" of "), supplier).alias("text"))
    return ops.table_search(_fragments(spark, sf), asked, 5)


_LINES_SQL = "l AS (SELECT doc_id AS document_id, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line, unnest(string_split(text, chr(10))) AS content FROM documents), p AS (SELECT doc_id AS document_id, CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, least(instr(text, chr(10)) - 1, 24)) ELSE substr(text, 1, 24) END AS phrase FROM documents)"
_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """(document_id, line, content) of every document."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("at", "content")).select("document_id", (F.col("at") + 1).cast("long").alias("line"), "content")


def _phrase():
    return F.substring(F.split("text", "\n")[0], 1, 24)


@query("fragment_search", f"""WITH {_LINES_SQL}, s AS (SELECT document_id, line, CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, g))::DOUBLE / len(a) END + 0.65 * CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, h))::DOUBLE / len(a) END + CASE WHEN phrase <> '' AND contains(content, phrase) THEN 0.30 ELSE 0 END AS score
    FROM (SELECT document_id, line, content, phrase, {_WORDS.format('content')} AS g, {_WORDS.format("split_part(content, ' ', 1)")} AS h, {_WORDS.format('phrase')} AS a FROM l JOIN p USING (document_id)))
  SELECT document_id AS question_id, line AS fragment_id, round(score, 6)::DOUBLE AS score, row_number() OVER (PARTITION BY document_id ORDER BY round(score, 6) DESC, line) AS rank FROM s WHERE round(score, 6) >= 0.08 QUALIFY rank <= 3""")  # fmt: skip
def fragment_search(spark: SparkSession, sf: str) -> DataFrame:
    """A document is asked for the beginning of its first line; the first word of a line stands for its heading."""
    grams = lambda c: F.array_distinct(text.words(c))
    rows = _lines(spark, sf).select("document_id", F.col("line").alias("fragment_id"), F.col("content").alias("text"), grams(F.col("content")).alias("grams"), grams(F.split("content", " ")[0]).alias("heading_grams"))
    asked = table(spark, sf, "documents").select(F.col("doc_id").alias("question_id"), F.col("doc_id").alias("document_id"), _phrase().alias("phrase")).withColumn("grams", grams(F.col("phrase")))
    return ops.fragment_search(rows, asked)


@query("query_recall", f"WITH {_LINES_SQL}, c AS (SELECT document_id, any_value({_WORDS.format('phrase')}) AS a, list_distinct(flatten(list({_WORDS.format('content')}))) AS t FROM l JOIN p USING (document_id) WHERE line BETWEEN 2 AND 4 GROUP BY 1) SELECT document_id, CASE WHEN len(a) = 0 THEN 0 ELSE round(len(list_intersect(a, t))::DOUBLE / len(a), 6) END::DOUBLE AS recall FROM c")
def query_recall(spark: SparkSession, sf: str) -> DataFrame:
    """How many of its first line's words a document repeats in lines 2 to 4."""
    words = lambda c: F.array_distinct(text.words(c))
    phrases = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), words(_phrase()).alias("asked"))
    rows = _lines(spark, sf).filter("line BETWEEN 2 AND 4").select("document_id", words(F.col("content")).alias("tokens")).join(phrases, "document_id")
    return ops.query_recall(rows, "document_id").withColumn("recall", F.round("recall", 6))


@query("line_neighbours", f"""WITH {_LINES_SQL}, k AS (SELECT document_id, line, substr(content, 1, 1) AS heading, length(content) AS n FROM l), h AS (SELECT *, 1.0::DOUBLE AS score FROM k WHERE n % 7 = 0 AND n > 0),
  b AS (SELECT document_id, line, score FROM h UNION ALL SELECT k.document_id, k.line, 0.42 FROM h JOIN k ON k.document_id = h.document_id AND abs(k.line - h.line) = 1 AND k.heading = h.heading)
  SELECT document_id, line, max(score)::DOUBLE AS score FROM b GROUP BY ALL""")  # fmt: skip
def line_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Lines whose length is divisible by 7 are hits; their first letter stands for the heading."""
    rows = _lines(spark, sf).select("document_id", "line", F.substring("content", 1, 1).alias("heading"), F.length("content").alias("n"))
    hits = rows.filter("n % 7 = 0 AND n > 0").select("document_id", "line", "heading", F.lit(1.0).alias("score"))
    return ops.neighbour_lines(hits, rows)
