"""Queries on what texts mention, claim, cover and are cut into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import claims, mentions
from factloom.plans.register import registry
from factloom.sources.tables import table
from factloom.sources.views import FACTS_SQL, facts

QUERIES, ORACLES, query = registry()

_LINES_SQL = "l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents)"


@query("metric_mentions", f"""WITH RECURSIVE i AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
  n AS (SELECT DISTINCT name FROM (SELECT w[1] || ' ' || w[2] AS name FROM i UNION ALL SELECT w[3] || ' ' || w[4] || ' ' || w[5] FROM i UNION ALL SELECT unnest(list_filter(w, lambda x: length(x) >= 7)) FROM i) WHERE name IS NOT NULL),
  d AS (SELECT doc_id, lower(text) AS t FROM documents),
  p AS (SELECT doc_id, name, string_split(t, name) AS p FROM d JOIN n ON contains(t, name)),
  m AS (SELECT doc_id, name, list_sum(list_transform(p[1:k], lambda x: length(x)))::BIGINT + (k - 1) * length(name) AS start FROM (SELECT *, unnest(range(1, len(p))) AS k FROM p)),
  o AS (SELECT doc_id, name, start, start + length(name) AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY start, length(name) DESC, name) AS r FROM m),
  walk AS (SELECT doc_id, r, name, start, stop, stop AS reach, true AS kept FROM o WHERE r = 1
    UNION ALL SELECT o.doc_id, o.r, o.name, o.start, o.stop, CASE WHEN o.start >= w.reach THEN o.stop ELSE w.reach END, o.start >= w.reach FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.r = w.r + 1)
  SELECT doc_id, start, stop, name FROM walk WHERE kept""")  # fmt: skip
def metric_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases and long words of the benchmark items, found in all documents; each is searched for behind its last find."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))
    items = table(spark, sf, "benchmark").select(w.alias("w"))
    phrase = lambda i, n: F.when(F.size("w") >= i + n - 1, F.array_join(F.slice("w", i, n), " "))
    names = items.select(F.explode(F.concat(F.array(phrase(1, 2), phrase(3, 3)), F.filter("w", lambda x: F.length(x) >= 7))).alias("name")).filter("name IS NOT NULL")
    return mentions.find_mentions(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", names, apart=True)


#: Two concerns in terms of the documents' words: what mentions them, whose sections are theirs, what tells of an event, what only looks like it.
_CONCERNS = [
    mentions.Concern("the", ("the ", "The "), ("The",), (("the_of", "(^| )the .{0,28} of( |$)"), ("in_the", "(^| )in the( |$)")), ("(^| )there( |$)",)),
    mentions.Concern("que", ("que ", "Que "), ("Le", "La"), (("que_le", "(^| )que .{0,28} le( |$)"),), ("(^| )qui( |$)",)),
]
_POLICY, _DENIAL = "(^| )(that|pour)( |$)", "(^| )(with|pas)( |$)"


def _audit_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents; a line's section is named by the document's first word, a first line is a title, and some lines get a ticked box."""
    docs = table(spark, sf, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    rows = docs.select("doc_id", F.regexp_extract(F.col("lines")[0], r"^(\S*)", 1).alias("first"), F.posexplode("lines").alias("at", "t"))
    boxed = F.when((F.col("doc_id") % 7 == 0) & (F.col("at") == 2), F.concat(F.lit("√适用 "), "t")).when((F.col("doc_id") % 5 == 0) & (F.col("at") == 1), F.concat(F.lit("√不适用 "), "t")).otherwise(F.col("t"))
    path = F.when(F.col("doc_id") % 3 == 0, F.array("first", F.lit("The end"))).otherwise(F.array("first"))
    return rows.select(F.col("doc_id").alias("document_id"), (F.col("at") + 1).cast("long").alias("line"), boxed.alias("text"), (F.col("at") == 0).alias("is_title"), path.alias("path"))


def _audit_sql() -> str:
    parts = []
    for c in _CONCERNS:
        titled = lambda x, c=c: "(" + " OR ".join(f"contains({x}, '{t}')" for t in c.titles) + ")"
        named = "(" + " OR ".join(f"contains(t, '{a}')" for a in c.aliases) + ")"
        events = " ".join(f"WHEN regexp_matches(t, '{p}') THEN 'positive_event:{r}'" for r, p in c.events)
        collides = " OR ".join(f"regexp_matches(t, '{p}')" for p in c.collisions)
        parts.append(f"""SELECT document_id, line, '{c.group}' AS "group", CASE WHEN box = 'yes' AND ({titled('leaf')} OR {titled('upper_')}) THEN 'positive_event:positive_applicability_checkbox'
          WHEN box = 'no' AND {titled('leaf')} AND NOT {titled('upper_')} THEN 'checkbox_negative:leaf_section_not_applicable'
          WHEN line = 1 THEN CASE WHEN {named} OR {titled('leaf')} THEN 'incidental_mention:section_title_only' END {events}
          WHEN {named} THEN 'incidental_mention:' || CASE WHEN {collides} THEN 'semantic_collision' WHEN regexp_matches(t, '{_POLICY}') THEN 'policy_description' WHEN regexp_matches(t, '{_DENIAL}') THEN 'explicit_negative_statement' ELSE 'related_term_only' END END AS f FROM x""")
    return f"""WITH {_LINES_SQL}, y AS (SELECT doc_id AS document_id, line, t AS raw, regexp_extract(first_value(t) OVER (PARTITION BY doc_id ORDER BY line), '^(\\S*)', 1) AS first FROM l),
      x AS (SELECT document_id, line, CASE WHEN document_id % 7 = 0 AND line = 3 THEN '√适用 ' || raw WHEN document_id % 5 = 0 AND line = 2 THEN '√不适用 ' || raw ELSE raw END AS t,
        CASE WHEN document_id % 7 = 0 AND line = 3 THEN 'yes' WHEN document_id % 5 = 0 AND line = 2 THEN 'no' END AS box, CASE WHEN document_id % 3 = 0 THEN 'The end' ELSE first END AS leaf, CASE WHEN document_id % 3 = 0 THEN first ELSE '' END AS upper_ FROM y),
      f AS (SELECT document_id, line, "group", split_part(f, ':', 1) AS kind, split_part(f, ':', 2) AS reason FROM ({' UNION ALL '.join(parts)}) WHERE f IS NOT NULL)"""


@query("negative_findings", f"""{_audit_sql()} SELECT document_id, line, "group", kind, reason FROM f""")
def negative_findings(spark: SparkSession, sf: str) -> DataFrame:
    return mentions.audit_findings(_audit_lines(spark, sf), _CONCERNS, _POLICY, _DENIAL)


@query("negative_audit", f"""{_audit_sql()}, g AS (SELECT DISTINCT document_id, unnest(['the', 'que']) AS "group" FROM x),
  c AS (SELECT document_id, "group", count(*) FILTER (WHERE kind = 'positive_event') AS p, count(*) FILTER (WHERE kind = 'checkbox_negative') AS b, count(*) FILTER (WHERE kind = 'incidental_mention') AS i FROM f GROUP BY ALL),
  n AS (SELECT document_id, count(*) AS lines FROM x GROUP BY 1)
  SELECT document_id, "group", CASE WHEN p > 0 THEN 'positive_event_found' WHEN b > 0 THEN 'scoped_checkbox_negative' ELSE 'no_positive_event_found' END AS decision,
    coalesce(p, 0) AS positive, coalesce(b, 0) AS checkbox, coalesce(i, 0) AS incidental, lines FROM g JOIN n USING (document_id) LEFT JOIN c USING (document_id, "group")""")  # fmt: skip
def negative_audit(spark: SparkSession, sf: str) -> DataFrame:
    lines = _audit_lines(spark, sf)
    return mentions.audit_decisions(lines, mentions.audit_findings(lines, _CONCERNS, _POLICY, _DENIAL), _CONCERNS)


_CLAIMS_SQL = f"""WITH {FACTS_SQL}, x AS (SELECT *, 'C' || ltrim(stock_code, '0') AS company FROM facts),
  b AS (SELECT c.*, p.fact_id AS other, c.normalized_value - p.normalized_value AS change FROM x c JOIN x p ON p.stock_code = c.stock_code AND p.canonical_metric = c.canonical_metric AND p.metric_year = c.metric_year - 1),
  claims AS (SELECT document_id, stock_code, metric_year, canonical_metric, 'single' AS kind, company || metric_year || '年' || canonical_metric || '为' || normalized_value || normalized_unit AS text, fact_id AS cells FROM x
  UNION ALL SELECT document_id, stock_code, metric_year, canonical_metric, 'comparison', company || metric_year || '年' || canonical_metric || '较上年' || CASE WHEN change > 0 THEN '增加' || change || normalized_unit WHEN change < 0 THEN '减少' || abs(change) || normalized_unit ELSE '持平' END, fact_id || ',' || other FROM b)"""


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf).withColumn("company", F.concat(F.lit("C"), F.ltrim(F.col("stock_code"), F.lit("0"))))
    return claims.compact_claims(rows)


@query("cell_claims", f"{_CLAIMS_SQL} SELECT * FROM claims")
def cell_claims(spark: SparkSession, sf: str) -> DataFrame:
    return _claims(spark, sf).withColumn("cells", F.array_join("cells", ","))


@query("claim_chain", """WITH p AS (SELECT l_partkey AS document_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) - 1 AS place, sha256(l_orderkey || '-' || l_linenumber || '=' || l_quantity::BIGINT) AS d FROM lineitem),
  s AS (SELECT document_id, place // 8 AS segment, list(d ORDER BY place) AS ds FROM p GROUP BY ALL),
  c AS (SELECT document_id, list(sha256(array_to_string(ds, '')) ORDER BY segment) AS c FROM s GROUP BY 1),
  seeds AS (SELECT s.document_id, segment, ds, list_reduce(list_prepend(sha256(s.document_id::VARCHAR), c[1:segment]), lambda a, x: sha256(a || '|' || x)) AS seed FROM s JOIN c USING (document_id)),
  k AS (SELECT document_id, segment, seed, ds, unnest(range(1, len(ds) + 1)) AS k FROM seeds)
  SELECT document_id, segment * 8 + k - 1 AS place, list_reduce(list_prepend(seed, ds[1:k]), lambda a, x: sha256(a || '|' || x)) AS link FROM k""")  # fmt: skip
def claim_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Line items of each part as its chain, in segments of eight."""
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("document_id"), (F.row_number().over(order) - 1).cast("long").alias("place"), F.concat("l_orderkey", F.lit("-"), "l_linenumber", F.lit("="), F.col("l_quantity").cast("long")).alias("payload"))
    return claims.chain(rows, "document_id", "place", F.col("payload"), 8, []).select("document_id", "place", "link")


_MASK = "(1 << (l_suppkey % 6)::INTEGER) | (1 << (l_quantity::BIGINT % 6)::INTEGER) | (CASE WHEN l_returnflag = 'R' THEN 64 ELSE 0 END)"


@query("coverage_selection", f"""WITH RECURSIVE c AS (SELECT l_partkey AS question_id, l_orderkey || '-' || l_linenumber AS fragment_id, ({_MASK})::BIGINT AS mask, l_discount AS score FROM lineitem),
  walk AS (SELECT DISTINCT question_id, 0::BIGINT AS rank, NULL::VARCHAR AS fragment_id, 0::BIGINT AS gain, 0::BIGINT AS covered FROM c
    UNION ALL SELECT question_id, rank, fragment_id, gain, covered FROM (SELECT w.question_id, w.rank + 1 AS rank, c.fragment_id, bit_count(c.mask & ~w.covered)::BIGINT AS gain, w.covered | c.mask AS covered,
      row_number() OVER (PARTITION BY w.question_id ORDER BY bit_count(c.mask & ~w.covered) DESC, c.score DESC, c.fragment_id) AS r FROM walk w JOIN c ON c.question_id = w.question_id WHERE w.rank < 5) WHERE r = 1 AND gain > 0)
  SELECT question_id, fragment_id, rank, gain FROM walk WHERE rank > 0""")  # fmt: skip
def coverage_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Every part asks for line items that cover seven facets."""
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("question_id"), F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("fragment_id"), F.expr("shiftleft(1L, cast(l_suppkey % 6 as int)) | shiftleft(1L, cast(cast(l_quantity as bigint) % 6 as int)) | if(l_returnflag = 'R', 64L, 0L)").alias("mask"), F.col("l_discount").alias("score"))
    return claims.coverage_selection(rows, 5)


_SMALL, _LARGE = 90, 260


def _sections_sql() -> str:
    title = "CASE WHEN {0}.h <> '' THEN repeat('#', {0}.level) || ' ' || {0}.h || chr(10) ELSE '' END"
    return f"""WITH RECURSIVE {_LINES_SQL}, s AS (SELECT doc_id, line AS i, CASE WHEN line % 4 = 1 THEN '' ELSE 'H' || line END AS h, (line % 3 + 1)::INTEGER AS level, t AS content FROM l),
  back AS (SELECT doc_id, 1::BIGINT AS i, [{{'h': h, 'level': level, 'c': content, 'hs': CASE WHEN h <> '' THEN h ELSE '' END}}] AS out FROM s WHERE i = 1
    UNION ALL SELECT s.doc_id, s.i, CASE WHEN length(trim(s.content)) < {_SMALL} AND length(b.out[-1].c || chr(10) || chr(10) || {title.format('s')} || s.content) <= {_LARGE}
      THEN list_append(b.out[1:len(b.out) - 1], {{'h': b.out[-1].h, 'level': b.out[-1].level, 'c': b.out[-1].c || chr(10) || chr(10) || {title.format('s')} || s.content, 'hs': b.out[-1].hs || CASE WHEN s.h <> '' THEN ',' || s.h ELSE '' END}})
      ELSE list_append(b.out, {{'h': s.h, 'level': s.level, 'c': s.content, 'hs': CASE WHEN s.h <> '' THEN s.h ELSE '' END}}) END
    FROM back b JOIN s ON s.doc_id = b.doc_id AND s.i = b.i + 1),
  n AS (SELECT doc_id, max(i) AS n FROM s GROUP BY 1), first_ AS (SELECT doc_id, unnest(out) AS x, generate_subscripts(out, 1) AS i, len(out) AS n FROM back JOIN n USING (doc_id) WHERE back.i = n.n),
  p AS (SELECT doc_id, i, n, x.h AS h, x.level AS level, x.c AS c, x.hs AS hs FROM first_),
  ahead AS (SELECT doc_id, 0::BIGINT AS i, []::VARCHAR[] AS out, NULL::VARCHAR AS open, NULL::VARCHAR AS head FROM n
    UNION ALL SELECT a.doc_id, p.i, CASE WHEN length(trim(p.c)) < {_SMALL} THEN CASE WHEN length(trim(coalesce(a.open || chr(10) || chr(10) || {title.format('p')}, '') || p.c)) < {_SMALL} THEN a.out ELSE list_append(a.out, coalesce(a.open || chr(10) || chr(10) || {title.format('p')}, '') || p.c) END
        ELSE list_append(CASE WHEN a.open IS NULL THEN a.out ELSE list_append(a.out, a.open) END, {title.format('p')} || p.c) END,
      CASE WHEN length(trim(p.c)) < {_SMALL} AND length(trim(coalesce(a.open || chr(10) || chr(10) || {title.format('p')}, '') || p.c)) < {_SMALL} THEN coalesce(a.open || chr(10) || chr(10) || {title.format('p')}, '') || p.c END,
      CASE WHEN length(trim(p.c)) < {_SMALL} THEN coalesce(CASE WHEN a.open IS NOT NULL THEN a.head END, {title.format('p')}) END
    FROM ahead a JOIN p ON p.doc_id = a.doc_id AND p.i = a.i + 1),
  last_ AS (SELECT a.doc_id, CASE WHEN open IS NULL THEN out WHEN len(out) > 0 AND length(out[-1] || chr(10) || chr(10) || open) <= {_LARGE} THEN list_append(out[1:len(out) - 1], out[-1] || chr(10) || chr(10) || open) ELSE list_append(out, head || open) END AS out
    FROM ahead a JOIN (SELECT DISTINCT doc_id, n FROM p) k ON k.doc_id = a.doc_id AND k.n = a.i)
  SELECT doc_id, generate_subscripts(out, 1) - 1 AS chunk, md5(unnest(out)) AS digest FROM last_"""


@query("merged_sections", _sections_sql())
def merged_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as sections, three of four with a heading."""
    docs = table(spark, sf, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    sections = F.transform("lines", lambda x, i: F.struct(F.when((i + 1) % 4 == 1, "").otherwise(F.concat(F.lit("H"), (i + 1).cast("string"))).alias("heading"), ((i + 1) % 3 + 1).cast("int").alias("level"), x.alias("content")))
    chunks = docs.select("doc_id", F.posexplode(claims.merge_sections(sections, _SMALL, _LARGE)).alias("chunk", "x"))
    return chunks.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5("x.content").alias("digest"))


_NAMES = "CASE c_custkey % 5 WHEN 0 THEN c_name || ' (' || n_name || ')' WHEN 1 THEN c_name || ' aka ' || n_name || ' Trading Co.' WHEN 2 THEN n_name || '/' || c_name WHEN 3 THEN c_mktsegment || ' of ' || n_name || ', Inc' ELSE c_name END"


@query("entity_aliases", f"""WITH n AS (SELECT c_custkey, c_custkey % 5 AS k, c_name, n_name, c_mktsegment, {_NAMES} AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
  a AS (SELECT c_custkey, name, CASE k WHEN 0 THEN [name, c_name, n_name] WHEN 1 THEN [name, c_name, n_name || ' Trading Co.', c_name || ' aka ' || n_name || ' Trading'] WHEN 2 THEN [name, n_name, c_name] WHEN 3 THEN [name, c_mktsegment || ' of ' || n_name] ELSE [name] END
    || [array_to_string(regexp_extract_all(' ' || name, '[^A-Za-z]([A-Z])', 1), '')] AS a FROM n)
  SELECT c_custkey, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: x = name OR length(x) > 1))), '|') AS aliases FROM a""")  # fmt: skip
def entity_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Names of customers in five shapes, with their nation in brackets, behind aka or a slash, or as a firm."""
    nation = F.broadcast(table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))  # 25 nations, whatever the scale
    rows = table(spark, sf, "customer").join(nation, "c_nationkey").withColumn("name", F.expr(_NAMES))
    return rows.select("c_custkey", F.array_join(F.array_sort(text.entity_aliases(F.col("name"))), "|").alias("aliases"))
