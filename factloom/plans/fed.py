"""Rules of texts, questions, labels and choices, fed with texts made of the tables' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import answers, fragments, years
from factloom.operators import retrieval as ops
from factloom.plans.register import registry
from factloom.sources.tables import table

QUERIES, ORACLES, query = registry()

# --- facts as text ------------------------------------------------------------------------------

#: SQL that both engines read: a fact text of a customer in six shapes, some of which are none.
_FACT = """CASE c_custkey % 6 WHEN 0 THEN 'fact: ' || c_name || ' ||| in ||| ' || c_mktsegment WHEN 1 THEN 'FACT:' || c_name || '|||  in|||' || c_mktsegment || chr(10) || 'context: more'
  WHEN 2 THEN 'fact: ' || c_name || ' ||| ' || c_mktsegment WHEN 3 THEN c_name || ' ||| in ||| ' || c_mktsegment WHEN 4 THEN '' ELSE 'fact: ||| in ||| ' || c_mktsegment END"""


@query("fact_texts", f"""WITH t AS (SELECT c_custkey, split_part({_FACT}, chr(10), 1) AS line FROM customer), p AS (SELECT c_custkey, line, string_split(substr(line, 6), '|||') AS p FROM t)
  SELECT c_custkey, CASE WHEN lower(line) LIKE 'fact:%' AND len(p) = 3 THEN array_to_string(list_transform(p, lambda x: trim(x)), '/') END AS result FROM p""")  # fmt: skip
def fact_texts(spark: SparkSession, sf: str) -> DataFrame:
    parsed = text.parse_fact_text(F.expr(_FACT))
    rows = table(spark, sf, "customer").select("c_custkey", parsed.alias("p"))
    return rows.select("c_custkey", F.when(F.col("p").isNotNull(), F.concat_ws("/", "p.subject", "p.predicate", "p.object")).alias("result"))


@query("fact_round_trip", """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_name ELSE '' END AS s, n_name AS o, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE '' END AS x FROM customer JOIN nation ON c_nationkey = n_nationkey)
  SELECT c_custkey, 'fact: ' || s || ' ||| is of ||| ' || o || CASE WHEN x <> '' THEN chr(10) || 'context: ' || x ELSE '' END AS text, s || '/is of/' || o AS parsed FROM c""")  # fmt: skip
def fact_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and their nations as facts, written and parsed again; every fifth has no name, every third no context."""
    nation = F.broadcast(table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))  # 25 nations, whatever the scale
    rows = table(spark, sf, "customer").join(nation, "c_nationkey")
    written = text.fact_text(F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")), F.lit("is of"), F.col("n_name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")))
    rows = rows.select("c_custkey", written.alias("text")).withColumn("p", text.parse_fact_text(F.col("text")))
    return rows.select("c_custkey", "text", F.concat_ws("/", "p.subject", "p.predicate", "p.object").alias("parsed"))


# --- replies as JSON ----------------------------------------------------------------------------

_REPLY = """CASE c_custkey % 5 WHEN 0 THEN '{"a": "' || c_name || '", "b": 2}' WHEN 1 THEN 'Sure! {"a": [' || c_custkey || ', 2]} done' WHEN 2 THEN c_name WHEN 3 THEN '{"b": ' || c_custkey || '}'
  ELSE '```json' || chr(10) || '{"a": {"n": ' || c_custkey || '}}' || chr(10) || '```' END"""


@query("json_fields", f"""WITH r AS (SELECT c_custkey, regexp_extract({_REPLY}, '(?s)(\\{{.*\\}})', 1) AS j FROM customer)
  SELECT c_custkey, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.a') END AS result FROM r""")  # fmt: skip
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", text.json_field(F.expr(_REPLY), "a").alias("result"))


_OBJECT = """'{"name": "' || c_name || '", "list": [' || c_custkey || ', ' || (c_custkey + 1) || '], "o": {"s": "[' || c_mktsegment || '"}, "t": [{"x": [1, 2]}]}'"""
_CUT = f"substr({_OBJECT}, 1, cast(2 + c_custkey * 7 % (length({_OBJECT}) - 1) AS int))"


@query("repaired_json", f"""WITH c AS (SELECT c_custkey, {_CUT} AS c FROM customer),
  d AS (SELECT c_custkey, c, CASE WHEN (length(c) - length(replace(c, '"', ''))) % 2 = 1 THEN c || '"' ELSE c END AS closed FROM c),
  e AS (SELECT c_custkey, c, regexp_replace(regexp_replace(closed, '\\s+$', ''), '(,\\s*"[^"]*"\\s*:?|,|:)$', '') AS kept FROM d),
  f AS (SELECT c_custkey, c, kept, regexp_replace(regexp_replace(kept, '"[^"]*"', '', 'g'), '[^\\[\\]{{}}]', '', 'g') AS shape FROM e),
  g AS (SELECT c_custkey, c, kept, list_reduce(list_prepend('', string_split(shape, '')), lambda open, b: CASE WHEN b IN (']', '}}') THEN open[2:] ELSE b || open END) AS open FROM f)
  SELECT c_custkey, CASE WHEN json_valid(c) THEN c ELSE kept || translate(open, '[{{', ']}}') END AS result FROM g""")  # fmt: skip
def repaired_json(spark: SparkSession, sf: str) -> DataFrame:
    """An object of each customer, cut off somewhere."""
    return table(spark, sf, "customer").select("c_custkey", text.repaired_json(F.expr(_CUT)).alias("result"))


# --- tokens -------------------------------------------------------------------------------------

_TOKENS_SQL = r"t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0d\x20\x{85}\p{Z}]+'), lambda x: x <> '') AS t FROM documents)"


@query("token_counts", f"WITH {_TOKENS_SQL} SELECT doc_id, len(t) AS n FROM t")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.token_count(F.col("text")).cast("long").alias("n"))


@query("truncated_tokens", f"WITH {_TOKENS_SQL} SELECT doc_id, md5(CASE WHEN len(t) <= 60 THEN text ELSE array_to_string(t[1:60], ' ') END) AS digest FROM t")
def truncated_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(text.truncate_tokens(F.col("text"), 60)).alias("digest"))


# --- questions ----------------------------------------------------------------------------------

_Y = "year(o_orderdate)"
_UNIT_QUESTION = f"""'C' || o_custkey || '在' || {_Y} || '年' || CASE o_orderkey % 7 WHEN 0 THEN '营业收入是多少亿元' WHEN 1 THEN '收入，单位：万元' WHEN 2 THEN '利润多少元' WHEN 3 THEN '股本多少股' WHEN 4 THEN '毛利率用%表示' WHEN 5 THEN '股本有几股' ELSE '收入是多少' END"""


@query("requested_units", f"WITH q AS (SELECT o_orderkey, {_UNIT_QUESTION} AS q FROM orders) SELECT o_orderkey, CASE "
  + " ".join(f"WHEN regexp_matches(q, '{p}') THEN '{s}/{u}'" for p, s, u in text.REQUESTED_UNITS) + " ELSE 'unspecified' END AS result FROM q")
def requested_units(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", text.requested_unit(F.expr(_UNIT_QUESTION)).alias("u"))
    return rows.select("o_orderkey", F.concat_ws("/", "u.status", "u.unit").alias("result"))


_YEAR_QUESTION = f"""CASE o_orderkey % 7 WHEN 0 THEN '营业收入是多少' WHEN 1 THEN {_Y} || '年年报中' || ({_Y} - 1) || '年的收入' WHEN 2 THEN ({_Y} - 2) || '年度报告的收入' WHEN 3 THEN ({_Y} - 1) || '年年报与' || {_Y} || '年年报'
  WHEN 4 THEN ({_Y} - 2) || '年和' || ({_Y} - 1) || '年收入' WHEN 5 THEN {_Y} || '年的收入' ELSE ({_Y} - 1) || '年与' || ({_Y} - 1) || '年的利润' END"""


@query("question_years", f"""WITH q AS (SELECT o_orderkey, {_Y} AS y, {_YEAR_QUESTION} AS q FROM orders),
  r AS (SELECT o_orderkey, y, list_distinct(regexp_extract_all(q, '{text.REPORT_YEAR}', 1)) AS reports, list_distinct(regexp_extract_all(regexp_replace(q, '{text.REPORT_YEAR}', ' ', 'g'), '((?:19|20)\\d{{2}})', 1)) AS asked FROM q)
  SELECT o_orderkey, CASE WHEN len(reports) > 1 THEN 'report_year_ambiguous' WHEN len(reports) = 1 AND reports[1]::INTEGER <> y THEN 'report_year_mismatch' WHEN len(asked) > 1 THEN 'metric_year_ambiguous'
    WHEN len(asked) = 0 THEN 'ok/' || y || '/default_report_year' ELSE 'ok/' || asked[1] || '/explicit_metric_year' END AS result FROM r""")  # fmt: skip
def question_years(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", text.question_years(F.expr(_YEAR_QUESTION), F.expr(_Y)).alias("y"))
    return rows.select("o_orderkey", F.concat_ws("/", "y.status", F.col("y.metric_year").cast("string"), "y.year_resolution").alias("result"))


_WORD = "translate(cast({0} AS string), '0123456789', '甲乙丙丁戊己庚辛壬癸')"
_FACET_QUESTION = f"""CASE o_orderkey % 5 WHEN 0 THEN {_Y} || '年' || {_WORD.format('o_custkey')} || '增长的原因是什么？' WHEN 1 THEN '请分析公司面临的' || {_WORD.format('o_custkey')} || '风险' WHEN 2 THEN {_WORD.format('o_custkey')}
  WHEN 3 THEN {_WORD.format('o_custkey')} || '如何，' || {_WORD.format('o_orderkey')} || '如何' ELSE '根据年报，' || {_Y} || '年和' || ({_Y} - 1) || '年' || {_WORD.format('o_orderkey % 100')} || '变动情况' END"""


def _facets_sql() -> str:
    ends = "[" + answers.EDGES.replace("[", "").replace("]", "") + r"\[\]]+"
    trim = lambda x: f"regexp_replace({x}, '^{ends}|{ends}$', '', 'g')"
    clean = lambda x: trim(f"regexp_replace(regexp_replace({trim(x)}, '{answers.PREFIX}', ''), '{answers.SUFFIX}', '')")
    year = "(?:19|20)[0-9]{2}"
    hints = []
    for i, (kind, words, q) in enumerate(answers.HINTS):
        body = f"CASE WHEN metric = '' THEN whole ELSE metric END || '{q.removeprefix('{}')}'" if q.startswith("{}") else f"'{q}'"
        hints.append(f"SELECT o_orderkey, {40 + i} AS place, 0 AS sub, '{kind}' AS kind, {body} AS query FROM b WHERE regexp_matches(whole, '{words}')")
    return f"""WITH a AS (SELECT o_orderkey, {_FACET_QUESTION.replace('AS string', 'AS VARCHAR')} AS whole FROM orders),
      b AS (SELECT o_orderkey, whole, {clean(f"regexp_replace(regexp_replace(whole, '{answers.BOILERPLATE}', ' ', 'g'), '{year}', ' ', 'g')")} AS metric, list_filter(regexp_split_to_array(whole, '{answers.CLAUSES}'), lambda x: true) AS clauses, regexp_extract_all(whole, '{year}') AS years FROM a),
      c AS (SELECT o_orderkey, whole, generate_subscripts(clauses, 1) AS sub, unnest(clauses) AS x FROM b), y AS (SELECT o_orderkey, metric, generate_subscripts(years, 1) AS sub, unnest(years) AS y FROM b),
      every AS (SELECT o_orderkey, 0 AS place, 0 AS sub, 'question' AS kind, whole AS query FROM b
        UNION ALL SELECT o_orderkey, 10, sub, 'clause', z FROM (SELECT o_orderkey, whole, sub, {clean('x')} AS z FROM c) WHERE length(z) >= 2 AND z <> whole
        UNION ALL SELECT o_orderkey, 20, 0, 'metric', metric FROM b WHERE length(metric) >= 2
        UNION ALL SELECT o_orderkey, 30, sub, 'metric_year', metric || ' ' || y FROM y WHERE length(metric) >= 2 AND sub <= 2
        UNION ALL {' UNION ALL '.join(hints)}),
      t AS (SELECT o_orderkey, place, sub, kind, trim(regexp_replace(query, '\\s+', ' ', 'g')) AS query FROM every),
      first_ AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey, lower(regexp_replace(query, '\\s+', '', 'g')) ORDER BY place, sub) AS r FROM t WHERE query <> ''),
      few AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY place, sub) AS n FROM first_ WHERE r = 1)
      SELECT o_orderkey, string_agg(kind || ':' || query, '|' ORDER BY n) AS result FROM few WHERE n <= 6 GROUP BY 1"""


@query("question_facets", _facets_sql())
def question_facets(spark: SparkSession, sf: str) -> DataFrame:
    """A question of each order, with its year and with names made of its numbers."""
    facets = answers.facets(F.col("q"))
    rows = table(spark, sf, "orders").select("o_orderkey", F.expr(_FACET_QUESTION).alias("q"))
    return rows.select("o_orderkey", F.array_join(F.transform(facets, lambda x: F.concat(x["kind"], F.lit(":"), x["query"])), "|").alias("result"))


# --- labels -------------------------------------------------------------------------------------

_HAN = "translate(cast({0} AS {1}), '0123456789', '毛利率上升汇风险营收')"


def _label_parts(kind: str) -> dict[str, str]:
    han = lambda x: _HAN.format(x, kind)
    share = "CASE WHEN c_custkey % 3 = 0 THEN '12.5%' ELSE '' END"
    return {"t": f"CASE WHEN c_custkey % 11 = 0 THEN '' ELSE {han('c_custkey * 7919 + 123456')} || {share} END", "l1": han("c_custkey % 90 + 10"), "l2": han("c_custkey * 7919 % 1000"), "a1": f"{han('c_custkey * 31 % 10000')} || ' 12.5%'", "a2": "c_mktsegment"}


@query("label_relevance", "WITH c AS (SELECT c_custkey, c_custkey % 10 / 10.0 AS sure, " + ", ".join(f"{sql} AS {name}" for name, sql in _label_parts("VARCHAR").items()) + rf""" FROM customer),
  d AS (SELECT *, l1 || ' ' || a1 || ' ' || l2 || ' ' || a2 AS asked FROM c),
  e AS (SELECT *, list_distinct(flatten(list_transform(regexp_extract_all(asked, '[\x{{3400}}-\x{{9fff}}]+'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))) AS grams, list_distinct(regexp_extract_all(asked, '[0-9][0-9,.]*%?')) AS numbers FROM d)
  SELECT c_custkey, round(CASE WHEN t = '' THEN -1 ELSE CASE WHEN contains(t, l1) THEN 25 * sure ELSE 0 END + CASE WHEN contains(t, l2) THEN 25 * 0.5 ELSE 0 END + 0.7 * len(list_filter(grams, lambda g: contains(t, g))) + 5 * len(list_filter(numbers, lambda n: length(n) >= 3 AND contains(t, n))) END, 6)::DOUBLE AS score FROM e""")  # fmt: skip
def label_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Texts and two labels of each customer, made of its number."""
    rows = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 10 / 10.0).alias("sure"), *[F.expr(sql).alias(name) for name, sql in _label_parts("string").items()])
    label = lambda name, sure, about: F.struct(F.col(name).alias("label"), sure.alias("confidence"), F.col(about).alias("about"))
    return rows.select("c_custkey", F.round(text.label_relevance(F.col("t"), F.array(label("l1", F.col("sure"), "a1"), label("l2", F.lit(0.5).cast("double"), "a2"))), 6).alias("score"))


# --- years of labels ----------------------------------------------------------------------------

_S = "year(l_shipdate)"
_PERIOD = f"""CASE (l_orderkey + l_linenumber) % 20 WHEN 0 THEN {_S} || '年' WHEN 1 THEN '本期' WHEN 2 THEN '上年度' WHEN 3 THEN '' WHEN 4 THEN '同比增减' WHEN 5 THEN '第一季度' WHEN 6 THEN {_S} || '年1-6月' WHEN 7 THEN '年初至处置日' WHEN 8 THEN {_S} || '年12月31日'
  WHEN 9 THEN {_S} || '年1月1日' WHEN 10 THEN {_S} || '年6月30日' WHEN 11 THEN {_S} || '年初' WHEN 12 THEN '期初' WHEN 13 THEN ({_S} - 1) || '年和' || {_S} || '年' WHEN 14 THEN ({_S} + 9) || '年' WHEN 15 THEN ({_S} - 3) || '年' WHEN 16 THEN '金额' WHEN 17 THEN '年末 余额'
  WHEN 18 THEN '' || {_S} ELSE '期末' END"""
_METRIC = "CASE l_suppkey % 3 WHEN 0 THEN '营业收入' WHEN 1 THEN '总资产' ELSE '股本' END"
_REPORT = f"CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE {_S} + l_partkey % 3 END"
_YEARS_SQL = f"""WITH a AS (SELECT {_METRIC} AS metric, {_PERIOD} AS label, ({_REPORT})::BIGINT AS report FROM lineitem),
  b AS (SELECT *, metric IN ({', '.join(f"'{m}'" for m in years.DURATION_METRICS)}) AS lasting, metric IN ({', '.join(f"'{m}'" for m in years.INSTANT_METRICS)}) AS instant, list_distinct(regexp_extract_all(label, '(?:19|20)[0-9]{{2}}')) AS ys FROM a),
  c AS (SELECT *, ys[1]::BIGINT AS y, regexp_matches(label, '{years.MONTH_OR_DAY}') AS day, regexp_matches(label, '{years.OPENING_DATE}') AS opening FROM b),
  d AS (SELECT *, CASE WHEN report IS NULL THEN 'invalid_report_year' WHEN label = '' THEN 'missing_period_label' WHEN regexp_matches(label, '{years.COMPARISON}') THEN 'comparison_or_change_column' WHEN regexp_matches(label, '{years.QUARTER}') THEN 'partial_period_or_quarter'
    WHEN lasting AND (day OR contains(label, '至')) THEN 'partial_duration_date' WHEN len(ys) > 1 THEN 'ambiguous_multiple_years' WHEN y IS NOT NULL AND instant AND day AND NOT opening AND NOT regexp_matches(label, '{years.YEAR_END_DATE}') THEN 'non_standard_balance_date'
    WHEN y IS NULL AND NOT regexp_matches(label, '{years.PREVIOUS}') AND NOT regexp_matches(label, '{years.CURRENT}') THEN 'unresolved_metric_year' END AS useless,
    CASE WHEN y IS NOT NULL AND instant AND day THEN CASE WHEN opening THEN 'explicit_opening_date' ELSE 'explicit_year_end_date' END WHEN y IS NOT NULL AND instant AND regexp_matches(label, '年初|期初') THEN 'explicit_opening_period' WHEN y IS NOT NULL THEN 'explicit_year'
      WHEN regexp_matches(label, '{years.PREVIOUS}') THEN 'relative_previous' ELSE 'relative_current' END AS how FROM c),
  e AS (SELECT *, CASE WHEN how IN ('explicit_opening_date', 'explicit_opening_period') THEN y - 1 WHEN how LIKE 'explicit%' THEN y WHEN how = 'relative_previous' THEN report - 1 ELSE report END AS found FROM d),
  f AS (SELECT metric, report, CASE WHEN useless IS NULL THEN found END AS metric_year, CASE WHEN useless IS NULL THEN how END AS year_resolution, CASE WHEN useless IS NULL THEN CASE WHEN how LIKE 'explicit%' THEN 'high' ELSE 'medium' END END AS year_confidence,
    coalesce(useless, CASE WHEN found > report THEN 'future_metric_year' WHEN found < report - 2 THEN 'metric_year_outside_three_year_window' END) AS error FROM e)"""


def _periods(spark: SparkSession, sf: str) -> tuple[DataFrame, list]:
    """A label of each line item that names a period in one of twenty ways, across from one of three metrics, in rows or in columns."""
    rows = table(spark, sf, "lineitem").select(F.expr(_METRIC).alias("metric"), F.expr(_PERIOD).alias("label"), F.expr(_REPORT).cast("long").alias("report"), F.when(F.col("l_linenumber") % 2 == 0, "row_label").otherwise("column_label").alias("source"))
    across = lambda side: F.when(F.col("source") == side, F.col("metric")).otherwise(F.col("label"))
    return rows, [F.col("metric"), F.col("source"), across("row_label"), across("column_label"), F.col("report")]


@query("metric_year_rules", f"{_YEARS_SQL} SELECT metric, metric_year, year_resolution, year_confidence, error, count(*) AS n FROM f GROUP BY ALL")
def metric_year_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows, given = _periods(spark, sf)
    rows = rows.withColumn("y", years.resolve_year(*given))
    return rows.groupBy("metric", "y.metric_year", "y.year_resolution", "y.year_confidence", "y.error").agg(F.count(F.lit(1)).alias("n"))


@query("candidate_years", f"{_YEARS_SQL} SELECT metric, CASE WHEN error IS NULL THEN metric_year END AS metric_year, count(*) AS n FROM f GROUP BY ALL")
def candidate_years(spark: SparkSession, sf: str) -> DataFrame:
    rows, given = _periods(spark, sf)
    return rows.groupBy("metric", years.candidate_year(*given).alias("metric_year")).agg(F.count(F.lit(1)).alias("n"))


@query("supplement_years", f"""{_YEARS_SQL} SELECT metric, metric_year, CASE WHEN error = 'future_metric_year' THEN 'metric_year_outside_three_year_window' WHEN error IS NOT NULL THEN error WHEN metric_year <> report - 1 THEN 'metric_year_mismatch' END AS error, count(*) AS n FROM f GROUP BY ALL""")
def supplement_years(spark: SparkSession, sf: str) -> DataFrame:
    """All cells are asked for the year before their report."""
    rows, given = _periods(spark, sf)
    return rows.withColumn("y", years.supplement_year(*given, F.col("report") - 1)).groupBy("metric", "y.metric_year", "y.error").agg(F.count(F.lit(1)).alias("n"))


# --- choices and texts of candidates ---------------------------------------------------------------

_CHOICE = """CASE k % 9 WHEN 0 THEN '{"selected_ids": ["' || last || '", "' || first || '"]}' WHEN 1 THEN 'I choose ' || first WHEN 2 THEN '{"selected_ids": ["' || first || '"], "why": "x"}' WHEN 3 THEN '{"selected_ids": ["' || first || '", "' || first || '"]}'
  WHEN 4 THEN '{"selected_ids": ["L' || (k % 9) || '"]}' WHEN 5 THEN '{"selected_ids": []}' WHEN 6 THEN '{"selected_ids": [' || k || ']}' WHEN 7 THEN '{"selected_ids": "' || first || '"}' ELSE '{"selected_ids": ["' || first || '"]}' END"""


@query("shadow_selection", f"""WITH o AS (SELECT l_orderkey AS k, list(DISTINCT 'L' || l_linenumber) AS ids FROM lineitem GROUP BY 1), p AS (SELECT k, list_sort(ids) AS ids, list_min(ids) AS first, list_max(ids) AS last FROM o), r AS (SELECT *, {_CHOICE} AS r FROM p),
  j AS (SELECT *, json_valid(r) AND json_type(CASE WHEN json_valid(r) THEN r END) = 'OBJECT' AS object, CASE WHEN json_valid(r) THEN json_extract(r, '$.selected_ids') END AS s FROM r),
  x AS (SELECT *, CASE WHEN json_type(s) = 'ARRAY' THEN json_extract(s, '$[*]') ELSE [] END AS parts, object AND len(json_keys(CASE WHEN object THEN r END)) = 1 AND s IS NOT NULL AS shaped FROM j),
  y AS (SELECT *, json_type(s) = 'ARRAY' AND len(list_filter(parts, lambda e: json_type(e) <> 'VARCHAR')) = 0 AND len(parts) <= 3 AND len(list_distinct(parts)) = len(parts) AS fit, list_transform(parts, lambda e: e ->> '$') AS chosen FROM x),
  z AS (SELECT *, CASE WHEN k % 9 = 8 AND k % 2 = 0 THEN 'fallback_timeout' WHEN NOT coalesce(shaped, false) THEN 'fallback_free_text_or_schema' WHEN NOT fit THEN 'fallback_invalid_cardinality' WHEN len(list_filter(chosen, lambda e: NOT list_contains(ids, e))) > 0 THEN 'fallback_unknown_id' ELSE 'shadow_valid' END AS status FROM y)
  SELECT k AS l_orderkey, status || ':' || array_to_string(CASE WHEN status = 'shadow_valid' THEN chosen ELSE ids[1:3] END, ',') AS result FROM z""")  # fmt: skip
def shadow_selection(spark: SparkSession, sf: str) -> DataFrame:
    """A reply about the lines of each order, in nine forms."""
    ids = F.array_sort(F.collect_set(F.concat(F.lit("L"), "l_linenumber")))
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(ids.alias("ids")).withColumns({"first": F.element_at("ids", 1), "last": F.element_at("ids", -1)})
    out = answers.shadow_selection(F.col("ids"), F.expr(_CHOICE), (F.col("k") % 9 == 8) & (F.col("k") % 2 == 0), 3)
    return rows.withColumn("s", out).select(F.col("k").alias("l_orderkey"), F.concat("s.status", F.lit(":"), F.array_join("s.selected", ",")).alias("result"))


#: SQL that both engines read: the parts of a table row's text.
_TEXT_PARTS = {
    "base_search_text": "p_name", "value_search_text": "'' || p_size", "own_row_header_text": "CASE WHEN p_partkey % 3 > 0 THEN p_brand END", "single_header_text": "p_type", "multilevel_header_text": "'All / ' || p_type",
    "hierarchical_row_text": "CASE WHEN p_partkey % 4 > 0 THEN 'Parts / ' || p_brand ELSE '' END", "semantic_search_text": "'unit ' || p_size % 5", "legacy_flat_text": "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE p_name || ' ' || p_size END", "search_text": "CASE WHEN p_partkey % 10 > 0 THEN p_type END",
}
_VARIANTS = {"full": (), "flat": ("legacy_flattened_a0",), "single": ("no_multilevel_headers",), "rows": ("no_hierarchical_rows", "no_unit_period_scope")}
_JOINED = {"full": ("multilevel_header_text", "hierarchical_row_text", "semantic_search_text"), "single": ("single_header_text", "hierarchical_row_text", "semantic_search_text"), "rows": ("multilevel_header_text",)}


@query("variant_texts", "WITH p AS (SELECT p_partkey, " + ", ".join(f"{sql} AS {name}" for name, sql in _TEXT_PARTS.items()) + " FROM part) SELECT p_partkey, coalesce(nullif(legacy_flat_text, ''), search_text, '') AS flat, "
  + ", ".join(f"array_to_string(list_filter([base_search_text, value_search_text, own_row_header_text, {', '.join(parts)}], lambda x: x <> ''), ' ') AS {name}" for name, parts in _JOINED.items()) + " FROM p")
def variant_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The searched text of each part as a table row, whole and under three ablations."""
    rows = table(spark, sf, "part").select("p_partkey", *[F.expr(sql).alias(name) for name, sql in _TEXT_PARTS.items()])
    return rows.select("p_partkey", *[fragments.variant_text(frozenset(a)).alias(name) for name, a in _VARIANTS.items()])


@query("rank_sentences", r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS position, regexp_extract_all(lower(split_part(coalesce(text, ''), chr(10), 1)), '[a-z0-9]+') AS a FROM documents),
  g AS (SELECT doc_id, t, position, list_distinct(a) AS a, list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+')) AS g, array_to_string(regexp_extract_all(lower(t), '[a-z0-9]+'), '') AS key FROM l),
  s AS (SELECT *, round(len(list_intersect(a, g))::DOUBLE / greatest(1, len(a)) + 0.30 * len(list_intersect(a, g)) / greatest(1, len(g)) + 0.10 * (1.0 / (10.0 + position)) - 0.00015 * greatest(0, length(t) - 240), 9) AS score FROM g),
  o AS (SELECT doc_id, list([{'position': position, 'key': key, 'score': score}] ORDER BY score DESC, position) AS o FROM s GROUP BY 1),
  k AS (SELECT doc_id, list_reduce(o, lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: contains(y.key, x[1].key) OR contains(x[1].key, y.key))) > 0 THEN kept ELSE kept || x END) AS k FROM o)
  SELECT doc_id AS question_id, generate_subscripts(k, 1) AS rank, unnest(list_transform(k, lambda x: x.position)) AS position, round(unnest(list_transform(k, lambda x: x.score)), 6) AS score FROM k""")  # fmt: skip
def rank_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's first line asks; all its lines are the evidence."""
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("question_id"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    rows = lines.select("question_id", F.array_distinct(text.words(F.col("lines")[0])).alias("asked"), F.posexplode("lines").alias("at", "text"))
    rows = rows.select("question_id", (F.col("at") + 1).cast("long").alias("position"), "text", F.array_join(text.words(F.col("text")), "").alias("key"), "asked", F.array_distinct(text.words(F.col("text"))).alias("grams"), (1.0 / (10.0 + F.col("at") + 1)).alias("signal"))
    return ops.rank_sentences(rows).select("question_id", "rank", "position", F.round("score", 6).alias("score"))
