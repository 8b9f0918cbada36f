"""Passages told apart by what they are worth for a question: classes, and frozen lists in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import information as info
from factloom.operators import answers
from factloom.plans.register import registry
from factloom.sources.tables import table

QUERIES, ORACLES, query = registry()

#: Passages of all orders and the question that each is read for; Spark and the oracle read the same expressions.
_PRICE = "CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR(30))"
_PASSAGE = f"""CASE o_orderkey % 19 WHEN 0 THEN CASE WHEN o_custkey % 2 = 0 THEN ' ' END WHEN 1 THEN '□适用 √不适用' WHEN 2 THEN '√适用 □不适用' WHEN 3 THEN '详见本报告第' || o_custkey || '节'
  WHEN 4 THEN '研发投入为' || {_PRICE} || '元，具体详见附注' WHEN 5 THEN '单位：' || CASE o_custkey % 3 WHEN 0 THEN '万元' WHEN 1 THEN '股' ELSE '克' END
  WHEN 6 THEN '| 项目 | 金额 |' || chr(10) || '|---|---|' || CASE WHEN o_custkey % 2 = 0 THEN chr(10) || '| 收入 | ' || {_PRICE} || ' |' ELSE '' END WHEN 7 THEN '# 第' || o_custkey || '章公司治理情况'
  WHEN 8 THEN '第' || o_custkey || '节 管理层讨论与分析' WHEN 9 THEN 'C' || o_custkey || '股份有限公司' || year(o_orderdate) || '年年度报告' WHEN 10 THEN '公司董事会及全体董事保证C' || o_custkey || '的报告真实、准确、完整'
  WHEN 11 THEN year(o_orderdate) || '年营业收入为' || {_PRICE} || '元' WHEN 12 THEN '无' WHEN 13 THEN '项目 本期 上期' || CASE WHEN o_custkey % 2 = 0 THEN '' ELSE ' ' || o_orderstatus END
  WHEN 14 THEN '| 单位 | ' || CASE WHEN o_custkey % 2 = 0 THEN '元' ELSE o_orderpriority END || ' |' WHEN 15 THEN '是否' || o_orderpriority || '的重大诉讼' WHEN 16 THEN '员工人才' || o_orderstatus
  WHEN 17 THEN '有关情况可详见附注。诉讼仲裁进展顺利并签订和解协议，请参见第' || o_custkey || '节' ELSE o_orderpriority || ' ' || o_orderstatus END"""
_QUESTION = """CASE o_custkey % 7 WHEN 0 THEN year(o_orderdate) || '年公司的研发投入情况如何' WHEN 1 THEN '请介绍公司重大诉讼事项' WHEN 2 THEN '公司营业收入和净利润是什么' WHEN 3 THEN 'What are the URGENT orders'
  WHEN 4 THEN '公司员工与人才A股激励' WHEN 5 THEN '公司治理与内部控制' END"""
_PATH = "CASE o_custkey % 4 WHEN 0 THEN '重要事项/重大诉讼、仲裁事项' WHEN 1 THEN '董事会报告/研发投入' WHEN 2 THEN '员工情况' ELSE '' END"


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of orders, and the whole texts of documents, which are read for the terms of their source."""
    orders = table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("chunk_id"), F.col("o_custkey").cast("long").alias("list_id"), F.expr(_PASSAGE).alias("content"), F.expr(_QUESTION).alias("question"), F.expr(_PATH).alias("path"))
    documents = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("chunk_id"), (-F.crc32(F.coalesce("source", F.lit(""))) - 1).alias("list_id"), F.col("text").alias("content"), F.concat(F.lit("the of "), F.coalesce("source", F.lit(""))).alias("question"), F.coalesce("source", F.lit("")).alias("path"))
    return orders.unionByName(documents).withColumn("path", F.split("path", "/"))


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _any(lst: str, test: str) -> str:
    return f"len(list_filter({lst}, lambda x: {test})) > 0"


def _all(lst: str, test: str) -> str:
    return f"len(list_filter({lst}, lambda x: NOT ({test}))) = 0"


def _is(c: str, pattern: str) -> str:
    return f"regexp_full_match({c}, '{pattern}')"


def _has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, '{pattern}')"


def _n(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{info.SIGN}'))"


def _fact_sql(c: str) -> str:
    return f"({_has(c, info.FACT_PHRASE)} OR {_has(c, info.LABELLED_NUMBER)} OR ({_n(c)} >= 5 AND {_has(c, info.FACT_VERB)}))"


def _key_sql(c: str) -> str:
    return rf"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g')"


def _groups_sql(lst: str, *keys: str) -> str:
    return f"list_filter({lst}, lambda g: len(list_filter(g.words, lambda w: {' OR '.join(f'contains({k}, w)' for k in keys)})) > 0)"


def _points_sql(key: str) -> str:
    return f"coalesce(list_sum(list_transform(list_filter(terms, lambda x: contains({key}, x)), lambda x: length(x))), 0)"


def _asked_sql() -> str:
    c = r"regexp_replace(lower(asked), '(?:19|20|21)[0-9]{2}\s*年?', '', 'g')"  # no question here has more digits in a row
    for phrase in info.QUESTION_PHRASES:
        c = f"replace({c}, '{phrase}', '')"
    return f"regexp_replace({c}, '{info.PARTICLES}', '', 'g')"


_GROUPS = "[" + ", ".join(f"{{'name': '{name}', 'words': {_sql_list(words)}}}" for name, words in info.CONCERNS.items()) + "]"
_ONE_SPACE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_JUDGED = rf"""WITH p AS (SELECT 'o' || o_orderkey AS chunk_id, o_custkey::BIGINT AS list_id, {_PASSAGE} AS content, {_QUESTION} AS question, {_PATH} AS path FROM orders
    UNION ALL SELECT 'd' || doc_id, NULL, text, 'the of ' || coalesce(source, ''), coalesce(source, '') FROM documents),
  n AS (SELECT *, coalesce(content, '') AS raw, translate(coalesce(content, ''), '：，', ':,') AS folded, {_ONE_SPACE.format("coalesce(question, '')")} AS asked FROM p),
  m AS (SELECT *, {_ONE_SPACE.format("folded")} AS plain, {_key_sql("path")} AS title, {_key_sql("folded")} AS key,
    list_transform(list_filter(string_split(folded, chr(10)), lambda l: contains(l, '|')), lambda l: list_filter(list_transform(string_split(l, '|'), lambda x: trim(x)), lambda x: x <> '')) AS lines FROM n),
  q AS (SELECT asked, {_groups_sql(_GROUPS, _key_sql("asked"))} AS groups, list_distinct(flatten(list_transform(regexp_extract_all({_asked_sql()}, '{info.LETTER}+'), lambda r: CASE WHEN {_is("r", "[A-Za-z]+")} THEN CASE WHEN length(r) >= 2 THEN [r] ELSE [] END
    ELSE list_filter(flatten(list_transform(range(1, length(r) + 1), lambda i: list_transform(list_filter(range(2, 5), lambda w: i + w - 1 <= length(r)), lambda w: substr(r, i, w)))), lambda g: NOT list_contains({_sql_list(info.TERM_STOP)}, g)) END))) AS terms FROM (SELECT DISTINCT asked FROM m)),
  s AS (SELECT m.*, groups, terms, flatten(lines) AS cells, list_filter(lines, lambda l: len(l) > 0) AS filled, len({_groups_sql("groups", "key")}) * 100 + {_points_sql("key")} * 3 AS content_score, len({_groups_sql("groups", "title")}) * 100 + {_points_sql("title")} AS path_score,
    len({_groups_sql("groups", "key", "title")}) * 100 + {_points_sql("key")} * 3 + {_points_sql("title")} AS concern_score, array_to_string(list_sort(list_transform({_groups_sql("groups", "key", "title")}, lambda g: g.name)), ',') AS matched FROM m JOIN q USING (asked)),
  u AS (SELECT *, list_transform(regexp_split_to_array(plain, '[。！？；;,，]'), lambda x: trim(regexp_replace(trim(x), '(?:{info.REDIRECT}).*$', ''))) AS clauses, regexp_replace(plain, '^[| ]+|[| ]+$', '', 'g') AS bare,
    list_position(list_transform(filled, lambda l: {_all("l", _is("x", info.SEPARATOR))}), true) AS sep, list_filter(cells, lambda x: NOT {_is("x", info.SEPARATOR)}) AS loose, list_filter(regexp_split_to_array(plain, '[\s、,/]+'), lambda w: w <> '') AS words,
    list_sort(list_transform(regexp_extract_all(plain, '{info.CHECKBOX}'), lambda x: CASE WHEN {_has("x", "^" + info.TICKED)} THEN '1' ELSE '0' END || CASE WHEN contains(x, '不适用') THEN '不适用' ELSE '适用' END)) = ['0适用', '1不适用'] OR {_is("key", info.NEGATIVE)} AS negative FROM s),
  v AS (SELECT *, regexp_replace(bare, '^(?:{info.UNIT_LABEL})\s*[:：]?\s*', '') AS direct, list_transform(cells, lambda x: regexp_replace(x, '[:：]+$', '')) AS clean, {_n("plain")} <= 45 AS short, {_has("plain", info.SENTENCE_END)} AS ended FROM u),
  judged AS (SELECT chunk_id, list_id, content_score, path_score, concern_score, matched, CASE WHEN plain = '' THEN 'empty' WHEN negative AND concern_score > 0 THEN 'scoped_checkbox_negative'
    WHEN {_has("plain", info.REDIRECT)} AND NOT ({_any("clauses", f"x <> '' AND NOT {_is('x', info.REDIRECT_SUBJECT)} AND (len({_groups_sql('groups', _key_sql('x'))}) > 0 OR len(list_filter(terms, lambda t: contains({_key_sql('x')}, t))) > 0) AND {_fact_sql('x')} AND {_n('x')} >= 6")}) THEN 'redirect_only'
    WHEN (direct <> bare AND {_is("direct", info.UNIT_VALUE)}) OR CASE WHEN len(cells) = 0 THEN {_is("bare", info.UNIT_VALUE)} ELSE {_any("clean", _is("x", info.UNIT_VALUE))} AND {_all("clean", " OR ".join(_is("x", r) for r in (info.UNIT_VALUE, info.UNIT_LABEL, info.SEPARATOR)))} END THEN 'unit_only'
    WHEN CASE WHEN sep > 0 THEN sep = len(filled) AND {_all("flatten(filled[1:sep - 1])", _is("x", info.HEADER_CELL))} WHEN len(loose) >= 2 THEN {_all("loose", _is("x", info.HEADER_CELL))} ELSE len(words) >= 2 AND {_all("words", _is("x", info.HEADER_CELL))} END THEN 'table_header'
    WHEN CASE WHEN {_is("plain", info.DOCUMENT_TITLE)} OR (contains(plain, '是否') AND {_n("plain")} <= 60 AND NOT {_has("plain", info.BOX_OR_COLON)} AND NOT ended) THEN true WHEN {_is("trim(raw)", r"#{1,6}\s+[^\n]+")} THEN NOT {_fact_sql(r"regexp_replace(plain, '^#{1,6}\s+', '')")}
      WHEN short AND NOT ended AND {_has("plain", info.HEADING_END)} AND NOT {_has("plain", info.HEADING_SUBJECT)} AND NOT {_has("plain", info.LABELLED_NUMBER)} THEN true WHEN {_fact_sql("plain")} OR ended THEN false
      ELSE short AND ({_has("plain", info.HEADING_START)} OR {_has("plain", info.HEADING_END)} OR {_has("plain", info.TOPIC)}) END THEN 'heading_or_document_title'
    WHEN {_has("plain", "|".join(info.BOILERPLATE))} THEN 'audit_or_governance_boilerplate' WHEN {_fact_sql("plain")} THEN 'explicit_fact' WHEN {_n("plain")} < 12 AND concern_score <= 0 THEN 'short_without_question_concern' WHEN negative THEN 'unscoped_negative' ELSE 'substantive' END AS reason FROM v)"""


@query("information_classes", f"{_JUDGED} SELECT chunk_id, reason, reason IN ('scoped_checkbox_negative', 'explicit_fact', 'substantive') AS usable, concern_score::BIGINT AS concern_score, matched FROM judged")
def information_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every passage with its class and its points for the question."""
    rows = info.classified(_passages(spark, sf), "content", "question", "path")
    return rows.select("chunk_id", "reason", "usable", F.col("concern_score").cast("long").alias("concern_score"), F.array_join("matched_concerns", ",").alias("matched"))


@query("frozen_chunks", f"""{_JUDGED}, r AS (SELECT *, substr(chunk_id, 2)::BIGINT AS old FROM judged WHERE chunk_id LIKE 'o%' AND reason IN ('scoped_checkbox_negative', 'explicit_fact', 'substantive'))
  SELECT list_id, chunk_id, (content_score * 3 + path_score)::BIGINT AS concern_score, row_number() OVER (PARTITION BY list_id ORDER BY content_score DESC, path_score DESC, old) AS rank FROM r""")  # fmt: skip
def frozen_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The orders of each customer as a frozen list of passages: those of use, by their points and their old rank."""
    rows = info.classified(_passages(spark, sf).filter("list_id >= 0"), "content", "question", "path")
    rows = rows.withColumns({"original_rank": F.substring("chunk_id", 2, 20).cast("long"), "compatible": F.lit(True), "low_information": ~F.col("usable")})
    return answers.frozen_rerank(rows, "list_id").select("list_id", "chunk_id", F.col("concern_score").cast("long").alias("concern_score"), "rank")
