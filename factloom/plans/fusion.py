"""Fused evidence, votes, quorum, authorizations, claims. An order stands for a question, its lines for what was retrieved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import authorization, fusion
from factloom.operators import retrieval as ops
from factloom.plans.register import registry
from factloom.sources.tables import table
from factloom.sources.views import FACTS_SQL, UNIT, facts

QUERIES, ORACLES, query = registry()

FACETS = ["f0", "f1", "f2"]
#: What the fixed candidates lie next to.
_BESIDE = {"c2": ["t0"], "c3": ["t1"], "c4": ["t0", "t1"]}


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    """One rank signal a line: candidates c0 and c1 are tables, c2 to c4 texts."""
    own = F.pmod("l_partkey", F.lit(5))
    is_table = own < 2
    weight = F.when(is_table, 4).otherwise(3).cast("long")
    signal = F.struct(F.concat(F.lit("f"), F.pmod("l_suppkey", F.lit(3))).alias("facet_id"), F.col("l_returnflag").alias("channel"), F.col("l_quantity").cast("long").alias("rank"), weight.alias("weight"))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("question_id"), F.concat(F.lit("c"), own).alias("candidate_id"), F.when(is_table, "table").otherwise("text").alias("route"),
        F.when(is_table, F.concat(F.lit("t"), own)).alias("table_id"), signal.alias("signal"), F.array(F.concat(F.lit("a"), F.pmod("l_suppkey", F.lit(7)))).alias("authorizations"),
        F.when(F.pmod("l_linenumber", F.lit(5)) == 0, "conflict").otherwise("clear").alias("conflict_status"), F.concat(F.lit("p"), F.floor(F.pmod("l_partkey", F.lit(100)) / 95)).alias("fingerprint"),
    )


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.merge_candidates(_signals(spark, sf), ["question_id", "candidate_id"], ["route", "table_id"], within="question_id").withColumn("score", fusion.rrf_score(F.col("signals")))


def _scored(spark: SparkSession, sf: str, **more) -> DataFrame:
    beside = F.create_map(*[x for k, v in _BESIDE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return fusion.adjacency(_merged(spark, sf).withColumns({"adjacent_table_ids": beside[F.col("candidate_id")], **more}), "question_id")


_SIGNALS_SQL = """g AS (SELECT l_orderkey AS question_id, 'c' || l_partkey % 5 AS candidate_id, CASE WHEN l_partkey % 5 < 2 THEN 'table' ELSE 'text' END AS route, CASE WHEN l_partkey % 5 < 2 THEN 't' || l_partkey % 5 END AS table_id,
    'f' || l_suppkey % 3 AS facet, l_returnflag AS channel, l_quantity::BIGINT AS rank, CASE WHEN l_partkey % 5 < 2 THEN 4 ELSE 3 END AS weight, 'a' || l_suppkey % 7 AS auth,
    CASE WHEN l_linenumber % 5 = 0 THEN 'conflict' ELSE 'clear' END AS status, 'p' || (l_partkey % 100) // 95 AS fp FROM lineitem),
  points AS (SELECT question_id, candidate_id, count(*) AS n_signals, sum(weight * (1000000000 // (60 + rank)))::BIGINT AS score, list(DISTINCT facet) AS facets FROM (SELECT DISTINCT question_id, candidate_id, facet, channel, rank, weight FROM g) GROUP BY ALL),
  merged AS (SELECT question_id, candidate_id, min(route) AS route, min(table_id) AS table_id, array_to_string(list_sort(list(DISTINCT auth)), ',') AS authorizations,
    CASE WHEN count(DISTINCT status) > 1 THEN 'merged_conflict_redacted' ELSE min(status) END AS conflict_status, count(DISTINCT fp) > 1 AS provenance_error FROM g GROUP BY ALL),
  m AS (SELECT * FROM merged JOIN points USING (question_id, candidate_id))"""
_BESIDE_SQL = """beside(candidate_id, table_id) AS (VALUES ('c2', 't0'), ('c3', 't1'), ('c4', 't0'), ('c4', 't1')),
  met AS (SELECT t.question_id, t.candidate_id AS table_candidate, x.candidate_id AS text_candidate FROM m t JOIN m x ON x.question_id = t.question_id JOIN beside b ON b.candidate_id = x.candidate_id AND b.table_id = t.table_id),
  n AS (SELECT question_id, candidate_id, count(DISTINCT other) AS k FROM (SELECT question_id, table_candidate AS candidate_id, text_candidate AS other FROM met UNION ALL SELECT question_id, text_candidate, table_candidate FROM met) GROUP BY ALL),
  scored AS (SELECT m.*, coalesce(k, 0) AS n_complements, score + 2000000 * coalesce(k, 0) AS fusion_score FROM m LEFT JOIN n USING (question_id, candidate_id)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY fusion_score DESC, CASE route WHEN 'table' THEN 0 ELSE 1 END, candidate_id) AS place FROM scored)"""


@query("merge_candidates", f"WITH {_SIGNALS_SQL} SELECT question_id, candidate_id, n_signals, score, authorizations, conflict_status, provenance_error FROM m")
def merge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf).select("question_id", "candidate_id", F.size("signals").cast("long").alias("n_signals"), "score", F.array_join("authorizations", ",").alias("authorizations"), "conflict_status", "provenance_error")


@query("adjacency_boost", f"WITH {_SIGNALS_SQL}, {_BESIDE_SQL} SELECT question_id, candidate_id, n_complements, fusion_score FROM scored")
def adjacency_boost(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("question_id", "candidate_id", "n_complements", "fusion_score")


@query("fused_rank", f"WITH {_SIGNALS_SQL}, {_BESIDE_SQL} SELECT question_id, candidate_id, fusion_score, place FROM ranked WHERE place <= 3")
def fused_rank(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.rank_fused(_scored(spark, sf), "question_id", 3).select("question_id", "candidate_id", "fusion_score", "place")


def _reservation_sql(most: int) -> str:
    """The greedy walk, one step after the other; ``taken`` holds places."""
    steps, out = [(f, r) for f in FACETS for r in fusion.ROUTES], ["s0 AS (SELECT DISTINCT question_id, []::BIGINT[] AS taken FROM ranked)"]
    for k, (facet, route) in enumerate(steps, 1):
        fits = f"r.question_id = s.question_id AND r.route = '{route}' AND list_contains(r.facets, '{facet}') AND NOT list_contains(s.taken, r.place)"
        out.append(f"s{k} AS (SELECT s.question_id, CASE WHEN min(r.place) IS NOT NULL AND len(s.taken) < {most} THEN list_append(s.taken, min(r.place)) ELSE s.taken END AS taken FROM s{k - 1} s LEFT JOIN ranked r ON {fits} GROUP BY s.question_id, s.taken)")
    return f"""{', '.join(out)}, walked AS (SELECT r.question_id, r.candidate_id, r.fusion_score, r.authorizations, list_contains(taken, r.place) AS reserved,
      row_number() OVER (PARTITION BY r.question_id ORDER BY CASE WHEN list_contains(taken, r.place) THEN list_position(taken, r.place) ELSE 100 + r.place END) AS place
      FROM ranked r JOIN s{len(steps)} s ON s.question_id = r.question_id)"""


@query("route_reservation", f"WITH {_SIGNALS_SQL}, {_BESIDE_SQL}, {_reservation_sql(3)} SELECT question_id, candidate_id, reserved, place FROM walked WHERE place <= 3")
def route_reservation(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scored(spark, sf, facet_ids=F.array_distinct("signals.facet_id"))  # before the windows, which then carry no signals
    return fusion.reserve_routes(rows, "question_id", FACETS, 3).select("question_id", "candidate_id", "reserved", "place")


@query("answer_packet", f"""WITH {_SIGNALS_SQL}, {_BESIDE_SQL}, first AS (SELECT *, 'evidence ' || candidate_id || ' of ' || n_signals AS body FROM ranked WHERE place <= 2)
  SELECT question_id, '以下为可核验的原文证据：' || chr(10) || chr(10) || '－ ' || string_agg(body, chr(10) || chr(10) || '－ ' ORDER BY place) AS text, string_agg(candidate_id, ',' ORDER BY place) AS candidate_ids,
    array_to_string(list_sort(list_filter(list_distinct(flatten(list([substr(candidate_id, 2), n_signals::VARCHAR]))), lambda x: NOT list_contains(list(DISTINCT substr(candidate_id, 2)), x))), ',') AS unsupported FROM first GROUP BY question_id""")  # fmt: skip
def answer_packet(spark: SparkSession, sf: str) -> DataFrame:
    """Each candidate's text names its number, which is authorized, and how many signals it has, which is not."""
    ranked = fusion.rank_fused(_scored(spark, sf), "question_id", 2)
    body = F.concat(F.lit("evidence "), "candidate_id", F.lit(" of "), F.size("signals"))
    rows = ranked.select("question_id", "candidate_id", "place", body.alias("safe_text"), F.array(F.substring("candidate_id", 2, 9)).alias("renderings"))
    return fusion.answer_packet(rows, "question_id", 2).select("question_id", "text", F.array_join("candidate_ids", ",").alias("candidate_ids"), F.array_join("unsupported", ",").alias("unsupported"))


@query("text_candidates", """WITH u AS (SELECT l_orderkey AS question_id, l_linenumber AS rank, 'f' || l_suppkey % 3 AS facet_id, 'D' || l_partkey % 3 AS document_id, 'a' || unnest([l_partkey % 50, l_partkey % 50 + 1]) AS atom_id, unnest([0, 1]) AS pos FROM lineitem),
  a AS (SELECT 'a' || i AS atom_id, 'D' || i % 3 AS document_id FROM range(60) t(i))
  SELECT question_id, atom_id AS candidate_id, facet_id, (rank - 1) * 16 + pos + 1 AS rank, 3 AS weight FROM u JOIN a USING (atom_id, document_id)""")  # fmt: skip
def text_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as retrieved units of two atoms, one or none of which is of the unit's document."""
    atom = lambda k: F.concat(F.lit("a"), F.pmod("l_partkey", F.lit(50)) + k)
    units = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.concat(F.lit("f"), F.pmod("l_suppkey", F.lit(3))).alias("facet_id"), F.concat(F.lit("D"), F.pmod("l_partkey", F.lit(3))).alias("document_id"), F.col("l_linenumber").alias("rank"), F.array(atom(0), atom(1)).alias("atom_ids"))
    atoms = spark.range(60).select(F.concat(F.lit("a"), "id").alias("atom_id"), F.concat(F.lit("D"), F.pmod("id", F.lit(3))).alias("document_id"))
    out = fusion.text_candidates(units, atoms, "hybrid", 3)
    return out.select("question_id", "candidate_id", "signal.facet_id", "signal.rank", F.col("signal.weight").cast("int").alias("weight"))


@query("table_candidates", """SELECT l_orderkey AS question_id, 'e' || l_partkey AS candidate_id, 'f' || l_suppkey % 3 AS facet_id, v.channel, l_linenumber::BIGINT AS rank, v.weight FROM lineitem, (VALUES ('legacy', 4), ('v2', 2)) v(channel, weight) WHERE (v.channel = 'legacy') = (l_returnflag = 'R')""")
def table_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.concat(F.lit("f"), F.pmod("l_suppkey", F.lit(3))).alias("facet_id"), F.concat(F.lit("e"), "l_partkey").alias("evidence_id"), F.col("l_linenumber").alias("rank"), "l_returnflag")
    legacy, new = rows.filter("l_returnflag = 'R'"), rows.filter("l_returnflag <> 'R'")
    both = fusion.table_candidates(legacy, "legacy", 4).unionByName(fusion.table_candidates(new, "v2", 2))
    return both.select("question_id", "candidate_id", "signal.facet_id", "signal.channel", "signal.rank", F.col("signal.weight").cast("int").alias("weight"))


# --- votes ------------------------------------------------------------------------------------


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.pmod("l_orderkey", F.lit(200)).alias("question_id"), F.pmod("l_partkey", F.lit(20)).alias("fragment_id"), F.pmod("l_suppkey", F.lit(3)).alias("run"), F.col("l_linenumber").alias("place"), F.pmod("l_partkey", F.lit(4)).alias("facet"),
        F.concat(F.lit("fragment "), F.pmod("l_partkey", F.lit(20))).alias("text"),
    )


_VOTES_SQL = "v AS (SELECT l_orderkey % 200 AS question_id, l_partkey % 20 AS fragment_id, l_suppkey % 3 AS run, l_linenumber AS place, l_partkey % 4 AS facet FROM lineitem)"


@query("majority_vote", f"""WITH {_VOTES_SQL}, k AS (SELECT question_id, fragment_id, count(DISTINCT run) AS votes, avg(place) AS m, min(facet) AS facet FROM v GROUP BY ALL HAVING count(DISTINCT run) >= 2)
  SELECT question_id, fragment_id, votes, round(m, 6) AS mean_place, row_number() OVER (PARTITION BY question_id ORDER BY facet, m, votes DESC, fragment_id) AS place FROM k""")  # fmt: skip
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.majority_vote(_votes(spark, sf), 3).select("question_id", "fragment_id", "votes", F.round("mean_place", 6).alias("mean_place"), "place")


@query("unanimous_vote", f"WITH {_VOTES_SQL} SELECT question_id, fragment_id, min(place) FILTER (WHERE run = 0) AS first_place FROM v GROUP BY ALL HAVING count(DISTINCT run) = 3")
def unanimous_vote(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.unanimous(_votes(spark, sf), 3)


@query("unanimous_new", f"""WITH {_VOTES_SQL} SELECT question_id, fragment_id, min(place) FILTER (WHERE run = 0) AS first_place FROM v GROUP BY ALL
  HAVING count(DISTINCT run) = 3 AND NOT (question_id < 100 AND contains('the answer says fragment 3 and fragment 15.', 'fragment ' || fragment_id))""")  # fmt: skip
def unanimous_new(spark: SparkSession, sf: str) -> DataFrame:
    answers = spark.range(100).select(F.col("id").alias("question_id"), F.lit("the answer says fragment 3 and fragment 15.").alias("answer"))
    return fusion.unanimous(_votes(spark, sf), 3, answers).select("question_id", "fragment_id", "first_place")


@query("quorum", """WITH n AS (SELECT o_custkey AS concern, o_orderpriority AS unit, count(DISTINCT o_orderkey) AS n, min(o_orderdate) AS first FROM orders GROUP BY ALL)
  SELECT concern, unit, n, n >= 4 AS met FROM (SELECT *, row_number() OVER (PARTITION BY concern ORDER BY n DESC, first, unit) AS r FROM n) WHERE r = 1""")  # fmt: skip
def quorum(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("concern"), F.col("o_orderpriority").alias("unit"), F.col("o_orderkey").alias("entity"), F.col("o_orderdate").alias("position"))
    return fusion.quorum(rows, 4)


# --- claims and numbers -----------------------------------------------------------------------


@query("claim_gate", r"""WITH c AS (SELECT doc_id, text AS evidence, CASE doc_id % 3 WHEN 0 THEN substr(text, 1, 60) WHEN 1 THEN substr(text, 1, 30) || ' 42' ELSE '' END AS claim, doc_id % 5 AS overlap FROM documents)
  SELECT doc_id, CASE WHEN length(regexp_replace(claim, '\s+', '', 'g')) = 0 THEN 'empty' WHEN NOT contains(regexp_replace(evidence, '\s+', '', 'g'), regexp_replace(claim, '\s+', '', 'g')) THEN 'not_extractive'
    WHEN overlap < 1 THEN 'irrelevant' WHEN len(regexp_extract_all(claim, '[-+]?[0-9][0-9,]*(?:\.[0-9]+)?%?')) > 0 THEN 'unauthorized_number' ELSE 'accepted' END AS verdict FROM c""")  # fmt: skip
def claim_gate(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.pmod("doc_id", F.lit(3))
    claim = F.when(kind == 0, F.substring("text", 1, 60)).when(kind == 1, F.concat(F.substring("text", 1, 30), F.lit(" 42"))).otherwise("")
    rows = table(spark, sf, "documents").select("doc_id", F.col("text").alias("evidence"), claim.alias("claim"), F.pmod("doc_id", F.lit(5)).alias("overlap"))
    rows = rows.withColumns({"numbers": fusion.numeric_fragments(F.col("claim")), "allowed": F.array().cast("array<string>")})
    return fusion.claim_gate(rows).select("doc_id", "verdict")


@query("redact_numbers", r"""SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '[-+]?[0-9][0-9,]*(?:\.[0-9]+)?%?|[^-+0-9]+|.|\n'),
  lambda x: CASE WHEN NOT regexp_matches(x, '[0-9]') OR list_contains(['1', '2', '42', '7', '100%'], x) THEN x ELSE '[未经授权数值]' END), '')) AS redacted FROM documents""")  # fmt: skip
def redact_numbers(spark: SparkSession, sf: str) -> DataFrame:
    allowed = F.array(*map(F.lit, ("1", "2", "42", "7", "100%")))
    return table(spark, sf, "documents").select("doc_id", F.md5(fusion.redact_numbers(F.col("text"), allowed)).alias("redacted"))


def _renderings_sql(unit: str) -> str:
    """Texts of column v, a DECIMAL(38,4)."""
    kept = lambda x: f"CASE WHEN v = 0 THEN '0' ELSE regexp_replace(({x})::VARCHAR, '(\\.[0-9]{{4}}[0-9]*?)0+$', '\\1') END"
    two = lambda x: f"round({x}, 2)::DECIMAL(38,2)::VARCHAR"
    exact = "v::DECIMAL(28,12)"
    parts = ["CASE WHEN v = 0 THEN '0' ELSE v::VARCHAR END", "CASE WHEN v = floor(v) THEN v::DECIMAL(38,0)::VARCHAR ELSE rtrim(v::VARCHAR, '0') END", f"CASE WHEN v <> floor(v) THEN {two(exact)} END"]
    if unit == "元":
        parts.append("CASE WHEN v = 0 THEN '0' ELSE v::VARCHAR END || '元'")
        for word, factor in (("万", "0.0001::DECIMAL(5,4)"), ("亿", "0.00000001::DECIMAL(9,8)")):
            parts += [f"({kept(f'{exact} * {factor}')}) || '{word}元'", f"{two(f'{exact} * {factor}')} || '{word}元'"]
    else:
        parts += [two(f"{exact} * 100::DECIMAL(3,0)"), two(f"{exact} * 100::DECIMAL(3,0)") + " || '%'"]
    return f"list_sort(list_distinct(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)))"


@query("value_renderings", f"WITH {FACTS_SQL}, r AS (SELECT fact_id, CASE WHEN canonical_metric = '总资产' THEN {_renderings_sql('ratio')} ELSE {_renderings_sql('元')} END AS r FROM (SELECT *, normalized_value AS v FROM facts)) SELECT fact_id, len(r) AS n, array_to_string(r, ' ') AS renderings FROM r")
def value_renderings(spark: SparkSession, sf: str) -> DataFrame:
    """Facts in money; those of one metric are read as ratios."""
    unit = F.when(F.col("canonical_metric") == "总资产", "ratio").otherwise(F.col("normalized_unit"))
    rows = facts(spark, sf).select("fact_id", authorization.renderings(F.col("normalized_value"), unit, 4).alias("r"))
    return rows.select("fact_id", F.size("r").cast("long").alias("n"), F.array_join("r", " ").alias("renderings"))


def _authorized_facts(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).filter("canonical_metric IN ('营业收入', '营业成本', '总资产')")


def _authorizations(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of revenue looked up; the same and the cost as operands of a margin; the assets as ranked rows."""
    metric, revenue = F.col("canonical_metric"), F.col("canonical_metric") == "营业收入"
    item = lambda backend, kind, source, row: F.struct(F.lit(backend).alias("backend"), F.lit(kind).alias("kind"), source.alias("source_id"), row.alias("row"))
    direct = F.when(revenue & (F.col("fact_id") < "c"), item("fact", "canonical_fact", F.col("fact_id"), F.lit(0)))
    operand = F.when(metric.isin("营业收入", "营业成本"), item("formula", "canonical_fact", F.concat(F.lit("gross_margin:"), "document_id"), F.when(revenue, 1).otherwise(2)))
    ranked = F.when(metric == "总资产", item("sql", "sql_result", F.lit("rank"), F.lit(0)))
    # A fact is read once for all of its items.
    rows = _authorized_facts(spark, sf).withColumn("i", F.explode(F.array(direct, operand, ranked))).filter("i IS NOT NULL")
    return authorization.authorization_set(authorization.items(rows, *[F.col(f"i.{c}") for c in ("backend", "kind", "source_id", "row")]))


_AUTH_SQL = f"""{FACTS_SQL}, a AS (SELECT CASE WHEN canonical_metric = '营业收入' AND fact_id < 'c' THEN 'fact' WHEN canonical_metric = '总资产' THEN 'sql' ELSE 'formula' END AS backend, stock_code AS entity_key, document_id,
    canonical_metric AS measure, metric_year, normalized_value AS v FROM facts WHERE canonical_metric IN ('营业收入', '营业成本', '总资产'))"""


@query("numeric_authorizations", f"WITH {_AUTH_SQL} SELECT backend, entity_key, document_id, measure, v::VARCHAR AS value, len({_renderings_sql('元')}) AS n_renderings FROM a")
def numeric_authorizations(spark: SparkSession, sf: str) -> DataFrame:
    out = _authorizations(spark, sf)
    return out.select("backend", "entity_key", "document_id", "measure", F.col("normalized_value").cast("string").alias("value"), F.size("allowed_renderings").cast("long").alias("n_renderings"))


@query("claim_authorizations", f"""WITH {_AUTH_SQL} SELECT document_id || '/' || measure AS claim_id, CASE WHEN metric_year % 3 = 1 THEN false ELSE backend <> 'sql' END AS authorized
  FROM a""")  # fmt: skip
def claim_authorizations(spark: SparkSession, sf: str) -> DataFrame:
    """Claims write a value in 万 with thousands marks left out; every third year's claims name another year, and those of ranked rows another company."""
    rows = _authorized_facts(spark, sf)
    token = F.concat(F.round(F.col("normalized_value").cast("decimal(28,12)") * F.lit("0.0001").cast("decimal(5,4)"), 2).cast("decimal(38,2)").cast("string"), F.lit("万元"))
    claims = rows.select(
        F.concat_ws("/", "document_id", "canonical_metric").alias("claim_id"), token.alias("token"), F.col("stock_code").alias("entity_key"),
        F.when(F.col("canonical_metric") == "总资产", "other").otherwise(F.col("stock_code")).alias("company"), "document_id", F.col("canonical_metric").alias("measure"),
        (F.col("metric_year") + F.when(F.pmod("metric_year", F.lit(3)) == 1, 1).otherwise(0)).alias("measure_year"),
    )
    found = authorization.matching_authorizations(claims, _authorizations(spark, sf))
    return found.groupBy("claim_id").agg((F.count("authorization_id") > 0).alias("authorized"))


_TOKEN_CASES = [
    "2019年营业收入1,234.56万元，同比增长12%", "第3章说明：1、收入为5元；2、成本为（3）元", "股票代码600519的净利润-8.5亿元", "3月15日，附注7，排名 2", "1) 首先\n2. 其次 300人", "③2018年度 ①45股", "A12 与 12B 和 7倍", "", "２０２０年 １２％",
]
_TOKENS = ["1,234.56万元 12%", "5元", "-8.5亿元", "", "300人", "45股", "12 7倍", "", "12%"]


@query("financial_tokens", "WITH c AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(_TOKENS)) + ") c(k, tokens)) SELECT doc_id, tokens FROM documents JOIN c ON k = doc_id % " + str(len(_TOKENS)))
def financial_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Nine sentences, each said by every ninth document; the oracle's tokens are written by hand."""
    case = F.array(*map(F.lit, _TOKEN_CASES))[F.pmod("doc_id", F.lit(len(_TOKEN_CASES))).cast("int")]
    return table(spark, sf, "documents").select("doc_id", F.array_join(authorization.financial_tokens(case, F.lit("600519")), " ").alias("tokens"))
