"""Text scalars: normalisers, tokenizers, ids, numbers, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import numbers, text
from factloom.sources.tables import table
from factloom.sources.views import FACTS_SQL, facts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


_NORMAL = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"
_LETTERS = "[^\\p{L}\\p{N}\\p{M}\\s_]"


@_query("text_normalize", f"SELECT doc_id, md5({_NORMAL}) AS normal, md5(regexp_replace(lower({_NORMAL}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g')) AS compact, length({_NORMAL}) AS n FROM documents")
def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("text")
    return _docs(spark, sf).select("doc_id", F.md5(text.normalise(c)).alias("normal"), F.md5(text.compact_words(c)).alias("compact"), F.length(text.normalise(c)).cast("long").alias("n"))


@_query("entity_normalize", f"SELECT doc_id, md5(regexp_replace(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g'), '{_LETTERS}', '', 'g')) AS entity FROM documents")
def entity_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.md5(text.entity(F.col("text"))).alias("entity"))


@_query("answer_normalize", r"""SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g')), ' '),
  lambda w: w NOT IN ('a', 'an', 'the')), ' ')) AS answer FROM documents""")  # fmt: skip
def answer_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.md5(text.answer(F.col("text"))).alias("answer"))


#: NFKC of the signs that the tables and the Han sample hold and that it changes; the engine takes all of Unicode.
_NFKC = "replace(replace(translate({c}, 'ＡＢ１２（），', 'AB12(),'), 'ﬁ', 'fi'), '…', '...')"
#: What is put before every text, so that tokenizers meet Han runs of several lengths, full-width signs and a ligature.
_HAN_SAMPLE = ["", "营业收入增长 ", "Ａ１２公司（营业）收入 ", "净 ", "报告期 公司 主要会计数据和财务指标 v1.2-beta ", "ﬁnance 3.5 毛利率… "]


@_query("nfkc_compact", f"SELECT doc_id, length(regexp_replace(lower({_NFKC.format(c='h')}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g')) AS n FROM (SELECT doc_id, {_HAN_SAMPLE!r}[doc_id % 6 + 1] || text AS h FROM documents)")
def nfkc_compact(spark: SparkSession, sf: str) -> DataFrame:
    return _han(spark, sf).select("doc_id", F.length(text.nfkc_compact(F.col("h"))).cast("long").alias("n"))


def _han(spark: SparkSession, sf: str) -> DataFrame:
    sample = F.array(*map(F.lit, _HAN_SAMPLE))[F.pmod("doc_id", F.lit(6)).cast("int")]
    return _docs(spark, sf).select("doc_id", F.concat(sample, "text").alias("h"))


@_query("number_parse", """WITH p AS (SELECT event_id, regexp_extract(props, '-?[0-9]+') AS digits, value FROM events),
  v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN digits || '万元' WHEN 1 THEN '(' || digits || ')' WHEN 2 THEN digits || '%' WHEN 3 THEN '--' ELSE 'n' || digits END AS raw, digits FROM p)
  SELECT event_id, raw, CASE event_id % 5 WHEN 3 THEN 'missing' WHEN 4 THEN 'unparseable' ELSE 'parsed' END AS status,
    CASE event_id % 5 WHEN 0 THEN digits::DECIMAL(38,12) * 10000 WHEN 1 THEN -(digits::DECIMAL(38,12)) WHEN 2 THEN digits::DECIMAL(26,12) / 100 END::DOUBLE AS value,
    CASE event_id % 5 WHEN 0 THEN '元' WHEN 2 THEN 'ratio' END AS unit FROM v""")  # fmt: skip
def number_parse(spark: SparkSession, sf: str) -> DataFrame:
    digits, kind = F.regexp_extract("props", "(-?[0-9]+)", 1), F.pmod("event_id", F.lit(5))
    raw = F.when(kind == 0, F.concat(digits, F.lit("万元"))).when(kind == 1, F.concat(F.lit("("), digits, F.lit(")"))).when(kind == 2, F.concat(digits, F.lit("%"))).when(kind == 3, "--").otherwise(F.concat(F.lit("n"), digits))
    none = F.lit(None).cast("string")
    rows = table(spark, sf, "events").select("event_id", raw.alias("raw")).withColumn("p", numbers.normalise_number(F.col("raw"), none, none, none))
    return rows.select("event_id", "raw", "p.status", F.col("p.value").cast("double").alias("value"), "p.unit")


@_query("plain_decimal", f"""WITH {FACTS_SQL} SELECT fact_id, CASE WHEN normalized_value = floor(normalized_value) THEN floor(normalized_value)::DECIMAL(38,0)::VARCHAR ELSE rtrim(normalized_value::VARCHAR, '0') END AS plain FROM facts""")
def plain_decimal(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).select("fact_id", numbers.plain(F.col("normalized_value")).alias("plain"))


@_query("md5_ids", "SELECT doc_id, 'chunk-' || md5(text) AS id FROM documents")
def md5_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", text.md5_id(F.col("text"), "chunk-").alias("id"))


@_query("sha256_ids", """SELECT event_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}' || chr(10)) AS semantic, 'ev_' || substr(sha256(event_id || '|' || event_type), 1, 16) AS stable FROM events""")
def sha256_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    return rows.select("event_id", text.semantic_sha256("user_id", "event_type").alias("semantic"), text.stable_id("ev", F.col("event_id").cast("string"), F.col("event_type")).alias("stable"))


_H = "(SELECT doc_id, " + repr(_HAN_SAMPLE) + "[doc_id % 6 + 1] || text AS h FROM documents)"
_RUNS = "regexp_extract_all({c}, '[㐀-鿿]+')"
_LOW = "lower(trim(regexp_replace(h, '\\s+', ' ', 'g')))"
_LOW_NFKC = _LOW.replace("(h,", f"({_NFKC.format(c='h')},")


def _grams_sql(run: str, n: int) -> str:
    return f"list_transform(range(greatest(length({run}) - {n - 1}, 0)), lambda i: substr({run}, i + 1, {n}))"


_TOKEN_SQL = {
    "mixed": f"flatten(list_transform(regexp_extract_all(h, '[A-Za-z]+(?:[-_.][A-Za-z0-9]+)*|\\p{{Nd}}+(?:\\.\\p{{Nd}}+)?|[㐀-鿿]+'), lambda p: CASE WHEN regexp_matches(p, '^[㐀-鿿]') THEN {_grams_sql('p', 1)} || {_grams_sql('p', 2)} ELSE [lower(p)] END))",
    "lexical": f"list_sort(list_distinct(regexp_extract_all({_LOW}, '[a-z0-9]+') || flatten(list_transform({_RUNS.format(c=_LOW)}, lambda r: {_grams_sql('r', 2)} || CASE WHEN length(r) <= 8 THEN [r] ELSE [] END))))",
    "sparse": f"list_filter(regexp_extract_all({_LOW}, '[a-z0-9]+') || flatten(list_transform({_RUNS.format(c=_LOW)}, lambda r: {_grams_sql('r', 2)} || {_grams_sql('r', 3)})), lambda t: NOT list_contains({sorted(text.SPARSE_STOP)!r}, t))",
    "table": f"list_sort(list_distinct(regexp_extract_all({_LOW_NFKC}, '[a-z0-9]+') || flatten(list_transform({_RUNS.format(c=_LOW_NFKC)}, lambda r: {_grams_sql('r', 2)} || CASE WHEN length(r) <= 4 THEN [r] ELSE [] END))))",
}


def _tokenizer(kind: str):
    @_query(f"tokenize_{kind}", f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_TOKEN_SQL[kind]} AS t FROM {_H})")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _han(spark, sf).select("doc_id", text.tokens(F.col("h"), kind).alias("t"))
        return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


for _kind in text.TOKENIZERS:
    _tokenizer(_kind)


@_query("han_bigrams", f"SELECT doc_id, array_to_string(list_sort(list_distinct(flatten(list_transform({_RUNS.format(c='h')}, lambda r: {_grams_sql('r', 2)})))), ' ') AS grams FROM {_H}")
def han_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    return _han(spark, sf).select("doc_id", F.array_join(F.array_sort(text.han_bigrams(F.col("h"))), " ").alias("grams"))


_BARE = "replace(replace(regexp_replace(lower(h), '[^\\p{L}\\p{N}\\p{M}]+', '', 'g'), 'the', ''), '公司', '')"


@_query("plain_bigrams", f"SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), ' ')) AS digest FROM (SELECT doc_id, list_filter(list_distinct({_grams_sql('b', 2)}), lambda x: NOT regexp_matches(x, '\\p{{Nd}}')) AS g FROM (SELECT doc_id, {_BARE} AS b FROM {_H}))")
def plain_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    rows = _han(spark, sf).select("doc_id", text.plain_bigrams(F.col("h"), ("the", "公司")).alias("g"))
    return rows.select("doc_id", F.size("g").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("g"), " ")).alias("digest"))


@_query("tokenize_words", "SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)")
def tokenize_words(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).select("doc_id", text.words(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@_query("char_ngrams", """SELECT item_id, len(list_distinct(list_transform(range(length(text) - 1), lambda i: substr(text, i + 1, 2))
  || list_transform(range(length(text) - 2), lambda i: substr(text, i + 1, 3)) || list_transform(range(length(text) - 3), lambda i: substr(text, i + 1, 4)))) AS n FROM benchmark""")  # fmt: skip
def char_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.size(text.char_grams(F.col("text"))).cast("long").alias("n"))


@_query("length_buckets", """SELECT CASE WHEN n_chars < 100 THEN 'short' WHEN n_chars < 1000 THEN 'medium' WHEN n_chars < 5000 THEN 'long' ELSE 'very_long' END AS bucket, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1""")
def length_buckets(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").groupBy(text.length_bucket(F.col("n_chars")).alias("bucket"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


_TAGS = {"law": ("license", "copyright"), "contact": ("@",), "table": (" | ",), "shout": ("!!",)}


@_query("intent_buckets", """SELECT tag, count(*) AS n, count(DISTINCT lang) AS langs FROM (SELECT lang, unnest(list_filter([CASE WHEN regexp_matches(lower(text), 'license|copyright') THEN 'law' END,
  CASE WHEN contains(text, '@') THEN 'contact' END, CASE WHEN contains(text, ' | ') THEN 'table' END, CASE WHEN contains(text, '!!') THEN 'shout' END], lambda x: x IS NOT NULL)) AS tag FROM documents) GROUP BY tag""")  # fmt: skip
def intent_buckets(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("lang", F.explode(text.keyword_tags(F.col("text"), _TAGS)).alias("tag"))
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("langs"))


@_query("low_info_filter", f"""WITH n AS (SELECT doc_id, {_NORMAL} AS p, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)
  SELECT reason, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, CASE WHEN length(p) = 0 THEN 'empty' WHEN NOT regexp_matches(p, '\\p{{L}}') THEN 'no_letters' WHEN length(p) < 20 THEN 'too_short'
    WHEN len(list_distinct(w)) * 10 < len(w) THEN 'repetitive' ELSE 'kept' END AS reason FROM n) GROUP BY reason""")  # fmt: skip
def low_info_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).withColumn("reason", F.coalesce(text.low_information(F.col("text")), F.lit("kept")))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
