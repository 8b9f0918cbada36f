"""Retrieval and evaluation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import ann, evaluation, impact
from factloom.operators import retrieval as ops
from factloom.sources.lifecycle import SearchIndex
from factloom.sources.shared import keep, shared_dir
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


def _units(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.words(F.col("text")).alias("words"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", text.words(F.col("text")).alias("words"))


def _channels(spark: SparkSession, sf: str, schemes: tuple[str, ...] = ("bm25", "idf")) -> list[DataFrame]:
    """The ten best documents of each benchmark item by each scheme, from one table of postings."""
    asked = impact.asked_tokens(_asked(spark, sf), "item_id", F.col("words"))
    post = impact.Postings(_units(spark, sf), "doc_id", {"body": (F.col("words"), 1.0)}, asked.select("token").distinct())
    return [impact.search(getattr(post, scheme)(), asked, "doc_id", "item_id", post.n, 10) for scheme in schemes]


_BASE_SQL = r"""u AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
  q AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
  asked AS (SELECT item_id, token, count(*) AS qtf FROM (SELECT item_id, unnest(w) AS token FROM q) GROUP BY ALL),
  post AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS token FROM u) WHERE token IN (SELECT token FROM asked) GROUP BY ALL),
  df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
  whole AS (SELECT count(*) AS n, avg(len(w)) AS average FROM u)"""
_BM25_SQL = f"""{_BASE_SQL}, bm AS (SELECT item_id, doc_id, round(sum(qtf * ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))), 6) AS score
    FROM asked JOIN df USING (token) JOIN post USING (token) JOIN u USING (doc_id), whole GROUP BY ALL),
  bm_top AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 10)"""
_LEX_SQL = """lx AS (SELECT item_id, doc_id, round(sum(qtf * ln(1.0 + (n - df + 0.5) / (df + 0.5))), 6) AS score FROM asked JOIN df USING (token) JOIN post USING (token), whole GROUP BY ALL),
  lx_top AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM lx QUALIFY rank <= 10)"""


@_query("bm25_search", f"WITH {_BM25_SQL} SELECT item_id, doc_id, score, rank FROM bm_top")
def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    return _channels(spark, sf, ("bm25",))[0]


@_query("lexical_idf_search", f"WITH {_BASE_SQL}, {_LEX_SQL} SELECT item_id, doc_id, score, rank FROM lx_top")
def lexical_idf_search(spark: SparkSession, sf: str) -> DataFrame:
    return _channels(spark, sf, ("idf",))[0]


_GRAM_SQL = """list_distinct(list_transform(range({n} - 1), lambda i: substr({t}, i + 1, 2)) || list_transform(range({n} - 2), lambda i: substr({t}, i + 1, 3)) || list_transform(range({n} - 3), lambda i: substr({t}, i + 1, 4)))"""


@_query("ngram_recall_search", f"""WITH t AS (SELECT item_id AS id, {_GRAM_SQL.format(n='length(text)', t='text')} AS g FROM benchmark), p AS (SELECT a.id AS item_id, b.id AS other_id,
    round(len(list_intersect(a.g, b.g))::DOUBLE / len(a.g), 6) AS score FROM t a JOIN t b ON a.id <> b.id WHERE a.id % 50 = 0)
  SELECT item_id, other_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, other_id) AS rank FROM p QUALIFY rank <= 3""")  # fmt: skip
def ngram_recall_search(spark: SparkSession, sf: str) -> DataFrame:
    """The items whose id is divisible by 50 against all items; the operator takes any set."""
    grams = table(spark, sf, "benchmark").select("item_id", text.char_grams(F.col("text")).alias("g"))
    others = grams.select(F.col("item_id").alias("other_id"), "g")
    return ops.gram_recall_top(others, grams.filter("item_id % 50 = 0"), "other_id", "item_id", "g", 3)


#: Queries of k nearest neighbours, and of gram recall below, are stated query sets.
_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@_query("knn_join", f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p QUALIFY rank <= 5""")  # fmt: skip
def knn_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return ops.knn(rows, asked, "vec_id", "query_id", "embedding", 5, digits=6)


@_query("indexed_knn", f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p QUALIFY rank <= 5""")  # fmt: skip
def indexed_knn(spark: SparkSession, sf: str) -> DataFrame:
    """As ``knn_join``, by an index of cells: those that are near first, then those that may hold more."""
    rows = table(spark, sf, "embeddings")
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = ann.search(ann.build(rows, "vec_id", "embedding"), asked, "query_id", "embedding", 5, exact=True)
    return near.withColumn("score", F.round("score", 6))


@_query("dense_topk", f"""SELECT b.vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY score DESC, vec_id LIMIT 10""")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    query = F.broadcast(rows.filter("vec_id = 0").select(F.col("embedding").alias("q")).limit(1))  # one vector
    scored = rows.crossJoin(query).select("vec_id", F.round(ops.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return scored.orderBy(F.col("score").desc(), "vec_id").limit(10)


@_query("dense_scoped_topk", f"""WITH p AS (SELECT b.label, b.vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0)
  SELECT label, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM p QUALIFY rank <= 3""")  # fmt: skip
def dense_scoped_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    query = F.broadcast(rows.filter("vec_id = 0").select(F.col("embedding").alias("q")).limit(1))  # one vector
    scored = rows.crossJoin(query).select("label", "vec_id", F.round(ops.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return ops.top(scored, ["label"], "score", "vec_id", 3)


_BOTH_SQL = f"WITH {_BM25_SQL}, {_LEX_SQL}, both_ AS (SELECT item_id, doc_id, rank, 0 AS channel FROM bm_top UNION ALL SELECT item_id, doc_id, rank, 1 FROM lx_top)"


@_query("rrf_fusion_float", _BOTH_SQL + """, f AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min((channel, rank)) AS first FROM both_ GROUP BY ALL)
  SELECT item_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first, doc_id) AS rank FROM f""")  # fmt: skip
def rrf_fusion_float(spark: SparkSession, sf: str) -> DataFrame:
    return ops.rrf(_channels(spark, sf), "item_id", "doc_id").withColumn("score", F.round("score", 9))


@_query("rrf_fusion_integer", _BOTH_SQL + " SELECT item_id, doc_id, sum(CASE channel WHEN 0 THEN 3 ELSE 2 END * (1000000000 // (60 + rank)))::BIGINT AS score FROM both_ GROUP BY ALL")
def rrf_fusion_integer(spark: SparkSession, sf: str) -> DataFrame:
    first, second = _channels(spark, sf)
    return ops.integer_rrf([(first, 3), (second, 2)], "item_id", "doc_id")


@_query("interleave_channels", _BOTH_SQL + """, one AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY channel) AS r FROM both_),
  p AS (SELECT item_id, doc_id, channel, row_number() OVER (PARTITION BY item_id ORDER BY rank, channel) AS place FROM one WHERE r = 1)
  SELECT item_id, doc_id, channel, place, round(1 - place / 1000000.0, 6)::DOUBLE AS score FROM p""")  # fmt: skip
def interleave_channels(spark: SparkSession, sf: str) -> DataFrame:
    return ops.interleave(*_channels(spark, sf), "item_id", "doc_id")


@_query("retrieval_metrics", f"""WITH {_BM25_SQL}, gold AS (SELECT item_id, item_id % 7 AS doc_id FROM benchmark UNION ALL SELECT item_id, doc_id FROM bm_top WHERE rank = item_id % 12),
  best AS (SELECT g.item_id, min(rank) AS best FROM gold g LEFT JOIN bm_top t ON t.item_id = g.item_id AND t.doc_id = g.doc_id GROUP BY 1)
  SELECT count(*) AS queries, round(count(*) FILTER (WHERE best <= 5)::DOUBLE / count(*), 6) AS recall_at_5, round(count(*) FILTER (WHERE best <= 15)::DOUBLE / count(*), 6) AS recall_at_15,
    round(avg(coalesce(1.0::DOUBLE / best, 0)), 6) AS mrr FROM best""")  # fmt: skip
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    ranked = keep(_channels(spark, sf, ("bm25",))[0], "ranked")  # read for the gold rows and again for the metrics
    gold = table(spark, sf, "benchmark").select("item_id", F.pmod("item_id", F.lit(7)).cast("long").alias("doc_id"))
    gold = gold.unionByName(ranked.filter("rank = item_id % 12").select("item_id", "doc_id"))
    return ops.metrics(ranked, gold, "item_id", "doc_id")


_SENTENCES_SQL = r"""l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
  s AS (SELECT doc_id * 100000 + line AS sentence_id, doc_id, line, t, CASE WHEN line > 0 THEN first_value(t) OVER (PARTITION BY doc_id ORDER BY line) ELSE '' END AS heading FROM l),
  u AS (SELECT *, regexp_extract_all(lower(heading || ' ' || t), '[a-z0-9]+') AS w, regexp_extract_all(lower(heading), '[a-z0-9]+') AS hw, regexp_extract_all(lower(t), '[a-z0-9]+') AS tw FROM s),
  q AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
  asked AS (SELECT item_id, token, count(*) AS qtf FROM (SELECT item_id, unnest(w) AS token FROM q) GROUP BY ALL),
  post AS (SELECT sentence_id, token, count(*) AS tf FROM (SELECT sentence_id, unnest(w) AS token FROM u) WHERE token IN (SELECT token FROM asked) GROUP BY ALL),
  df AS (SELECT token, count(*) AS df FROM post GROUP BY token), whole AS (SELECT count(*) AS n, avg(len(w)) AS average FROM u),
  bm AS (SELECT item_id, sentence_id, sum(qtf * ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))) AS score
    FROM asked JOIN df USING (token) JOIN post USING (token) JOIN u USING (sentence_id), whole GROUP BY ALL),
  k AS (SELECT item_id, list_distinct(w) AS qs, array_to_string(w, '') AS key FROM q),
  b AS (SELECT item_id, u.sentence_id, doc_id, line, heading, score, qs, key, array_to_string(tw, '') AS tk, array_to_string(hw, '') AS hk,
    len(list_intersect(qs, tw))::DOUBLE / len(qs) + 0.65 * len(list_intersect(qs, hw)) / len(qs) AS share FROM bm JOIN u USING (sentence_id) JOIN k USING (item_id)),
  x AS (SELECT item_id, sentence_id, doc_id, line, heading, round(score + CASE WHEN contains(tk, key) THEN 2 ELSE 0 END + CASE WHEN contains(hk, key) THEN 1.25 ELSE 0 END
    + 0.35 * (share + CASE WHEN contains(tk, key) THEN 0.3 ELSE 0 END), 8) AS score FROM b),
  best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, line) AS rank FROM x QUALIFY rank <= 8),
  near AS (SELECT b.item_id, s.sentence_id, s.doc_id, s.line, round(first(b.score ORDER BY b.rank) * 0.42, 8) AS score FROM best b JOIN s ON s.doc_id = b.doc_id AND s.heading = b.heading AND abs(s.line - b.line) = 1
    WHERE b.rank <= 4 AND NOT EXISTS (SELECT 1 FROM best z WHERE z.item_id = b.item_id AND z.sentence_id = s.sentence_id) GROUP BY ALL)"""


@_query("sentence_search", f"""WITH {_SENTENCES_SQL} SELECT item_id, sentence_id, 'hit' AS kind, round(score, 6) AS score, rank FROM best
  UNION ALL SELECT item_id, sentence_id, 'neighbour', round(score, 6), row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, line) AS rank FROM near QUALIFY rank <= 4""")  # fmt: skip
def sentence_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item against every line of every document; a document's first line is the heading of the others."""
    w, whole = text.words, F.coalesce("text", F.lit(""))
    first = table(spark, sf, "documents").select("doc_id", whole.alias("text"), F.substring_index(whole, "\n", 1).alias("first")).withColumn("fw", w(F.col("first")))
    lines = first.select("doc_id", "first", "fw", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    below = lambda c, none: F.when(F.col("line") > 0, F.col(c)).otherwise(none)
    tokens = F.concat(below("fw", F.array().cast("array<string>")), w(F.col("t")))  # a document's heading is read once
    sentences = lines.select((F.col("doc_id") * 100_000 + F.col("line")).alias("sentence_id"), F.col("doc_id").alias("document_id"), "line", below("first", "").alias("heading"), "t", tokens.alias("tokens"))

    def read(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"hw": w(F.col("heading")), "tw": w(F.col("t"))})
        return rows.withColumns({"heading_key": F.array_join("hw", ""), "text_key": F.array_join("tw", "")})

    asked = _asked(spark, sf).select(F.col("item_id").alias("question_id"), F.col("words").alias("tokens"), F.array_distinct("words").alias("qs"), F.array_join("words", "").alias("key"))
    lexical = lambda: ops.lexical_score(F.col("qs"), F.array_distinct("tw"), F.array_distinct("hw"), F.col("key"), F.col("text_key"))
    out = impact.sentence_search(sentences, asked, 8, 4, lexical, 1 + ops.HEADING_WEIGHT + ops.PHRASE_WEIGHT, read)
    return out.select(F.col("question_id").alias("item_id"), "sentence_id", "kind", F.round("score", 6).alias("score"), "rank")


@_query("percentile_linear", "SELECT lang, quantile_cont(n_chars, 0.5)::DOUBLE AS p50, round(quantile_cont(n_chars, 0.95)::DOUBLE, 6) AS p95 FROM documents GROUP BY lang")
def percentile_linear(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").groupBy("lang")
    return rows.agg(F.percentile("n_chars", 0.5).alias("p50"), F.round(F.percentile("n_chars", 0.95), 6).alias("p95"))


_SCORED_SQL = "s AS (SELECT d.doc_id, d.lang, d.source, l.toxic, round((d.n_chars % 101) / 100.0, 2)::DOUBLE AS score FROM documents d JOIN labels l USING (doc_id))"


@_query("score_summary_groups", f"""WITH {_SCORED_SQL} SELECT coalesce(lang, '*') AS lang, coalesce(toxic::VARCHAR, '*') AS status, count(*) AS n, round(sum(score), 6) AS total, round(avg(score), 6) AS mean,
  count(*) FILTER (WHERE score = 0) AS zero, count(*) FILTER (WHERE score > 0) AS positive, count(*) FILTER (WHERE score >= 0.5) AS at_50, count(*) FILTER (WHERE score >= 0.75) AS at_75, count(*) FILTER (WHERE score >= 0.9) AS at_90
  FROM s GROUP BY GROUPING SETS ((), (lang), (toxic))""")  # fmt: skip
def score_summary_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluation.demo_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return evaluation.summary(rows, "score", {"lang": "lang", "toxic": "status"})


@_query("bucket_summary", f"""WITH {_SCORED_SQL}, b AS (SELECT score, unnest([lang, source, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END]) AS bucket FROM s) SELECT bucket, count(*) AS n, round(avg(score), 6) AS mean FROM b GROUP BY bucket""")
def bucket_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluation.demo_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return evaluation.buckets(rows, F.array("lang", "source", F.when(F.col("toxic") == 1, "toxic").otherwise("clean")), "score")


@_query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluation.demo_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return evaluation.bootstrap(rows, "doc_id", "score")


@_query("min_max_normalize", "SELECT doc_id, round(coalesce((n_chars - min(n_chars) OVER (PARTITION BY lang))::DOUBLE / nullif(max(n_chars) OVER (PARTITION BY lang) - min(n_chars) OVER (PARTITION BY lang), 0), 1), 9) AS score FROM documents")
def min_max_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.min_max(table(spark, sf, "documents"), ["lang"], "n_chars").select("doc_id", F.round("score", 9).alias("score"))


@_query("label_idf", "WITH g AS (SELECT source AS label, count(DISTINCT lang) AS df FROM documents GROUP BY 1), n AS (SELECT count(DISTINCT lang) AS n FROM documents) SELECT label, df, round(ln((1.0 + n) / (1.0 + df)) + 1, 9) AS idf FROM g, n")
def label_idf(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.smoothed_idf(table(spark, sf, "documents"), "source", "lang").select(F.col("source").alias("label"), "df", F.round("idf", 9).alias("idf"))


_ALIVE_SQL = r"""u AS (SELECT doc_id, regexp_extract_all(lower(CASE WHEN doc_id % 6 = 0 THEN reverse(text) ELSE text END), '[a-z0-9]+') AS w FROM documents WHERE doc_id % 10 <> 3 OR doc_id % 6 = 0)"""


@_query("index_life_cycle", f"""WITH {_BM25_SQL.replace("u AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)", _ALIVE_SQL)}
  SELECT item_id, doc_id, score, rank FROM bm_top""")  # fmt: skip
def index_life_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """Search of all benchmark items in an index built from even documents, to which odd ones are added, from which some are deleted, and in which others are replaced."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    words = text.words(F.col("text"))
    index = SearchIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    index.build(docs.filter("doc_id % 2 = 0"), "doc_id", words)
    index.add(docs.filter("doc_id % 2 = 1"), "doc_id", words)
    index.delete(docs.filter("doc_id % 10 = 3"), "doc_id")
    index.add(docs.filter("doc_id % 6 = 0"), "doc_id", text.words(F.reverse("text")))
    index.compact()
    return index.search(_asked(spark, sf), "item_id", F.col("words"), 10).withColumnRenamed("key", "doc_id")
