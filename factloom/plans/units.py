"""Atoms and retrieval units of all documents, whose sentences are dealt over headings, lists and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import units
from factloom.plans.register import registry
from factloom.sources.tables import table

QUERIES, ORACLES, query = registry()


def _marked() -> str:
    """An expression for Spark and the oracle: some sentences open a section, a list, a paragraph, or follow a table."""
    out = "coalesce(text, '')"
    for word, before in (("The", "<table><tr><td>1</td></tr></table>' || chr(10) || '"), ("En", "' || chr(10) || '- "), ("In", "' || chr(10) || '# In' || chr(10) || '"), ("Of", "# Of #' || chr(10) || '"), ("To", "' || chr(10) || '## To' || chr(10) || '"), ("La", "' || chr(10) || '")):
        out = f"replace({out}, '. {word} ', '.' || chr(10) || '{before}{word} ')"
    return out


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.expr(_marked()).alias("text"))


_T = units.TABLE
_ATOMS = rf"""WITH RECURSIVE d AS (SELECT doc_id, {_marked()} AS text FROM documents), p AS (SELECT doc_id, regexp_split_to_array(text, '{_T}') AS pieces, regexp_extract_all(text, '{_T}') AS tabs FROM d),
  e AS (SELECT doc_id, unnest(range(len(pieces))) AS part, pieces, tabs FROM p), g AS (SELECT doc_id, part, string_split(pieces[part + 1], chr(10)) AS ls, coalesce(length(tabs[part + 1]), 0) AS tab FROM e),
  h AS (SELECT doc_id, part, tab, len(ls) AS n, unnest(ls) AS content, generate_subscripts(ls, 1) AS i FROM g),
  k AS (SELECT *, length(content) + CASE WHEN i < n THEN 1 ELSE tab END AS span, CASE WHEN NOT regexp_matches(content, '\S') THEN 'blank' WHEN regexp_matches(content, '^\s{{0,3}}#{{1,6}}[ \t]+.') THEN 'heading' WHEN regexp_matches(content, '{units.LIST_LINE}') THEN 'list' ELSE 'paragraph' END AS kind FROM h),
  l AS (SELECT *, row_number() OVER w AS line, coalesce(sum(span) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, part + count(*) FILTER (WHERE kind = 'heading') OVER w AS segment, lag(kind) OVER w AS pk, lag(part) OVER w AS pp,
    max(CASE WHEN kind = 'heading' AND content LIKE '# %' THEN part * 1000000 + i END) OVER w AS h1, max(CASE WHEN kind = 'heading' AND content LIKE '## %' THEN part * 1000000 + i END) OVER w AS h2 FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY part, i)),
  m AS (SELECT *, sum(CASE WHEN kind <> 'blank' AND (kind = 'heading' OR pk IS DISTINCT FROM kind OR pp IS DISTINCT FROM part) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS atom FROM l),
  titles AS (SELECT doc_id, part * 1000000 + i AS at_line, trim(content, '# ') AS title FROM k WHERE kind = 'heading'),
  a AS (SELECT doc_id, atom, min(kind) AS kind, min(segment) AS segment, min(start) AS a_start, max(start + length(content)) AS a_end, min(h1) AS h1, min(h2) AS h2 FROM m WHERE kind <> 'blank' GROUP BY ALL),
  t AS (SELECT doc_id, part AS tab_no, start + length(content) AS a_start, start + span AS a_end FROM m WHERE i = n AND tab > 0),
  v AS (SELECT doc_id, atom, kind, segment, a_start, a_end, h1, h2, NULL::BIGINT AS tab_no FROM a UNION ALL SELECT doc_id, NULL::BIGINT, 'table', NULL::BIGINT, a_start, a_end, NULL::BIGINT, NULL::BIGINT, tab_no FROM t),
  b AS (SELECT *, lag(tab_no) OVER w AS t0, a_start - lag(a_end) OVER w AS d0, lead(tab_no) OVER w AS t1, lead(a_start) OVER w - a_end AS d1 FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY a_start, a_end)),
  atoms AS (SELECT b.doc_id, atom, kind, segment, a_start, a_end, CASE WHEN kind <> 'heading' THEN t0 END AS t0, CASE WHEN kind <> 'heading' THEN t1 END AS t1, d0, d1, concat_ws('/', x.title, CASE WHEN h2 > coalesce(h1, -1) THEN y.title END) AS path
    FROM b LEFT JOIN titles x ON b.doc_id = x.doc_id AND h1 = x.at_line LEFT JOIN titles y ON b.doc_id = y.doc_id AND h2 = y.at_line WHERE kind <> 'table')"""  # fmt: skip


@query("markdown_atoms", f"""{_ATOMS} SELECT doc_id, atom::BIGINT AS atom, kind, segment::BIGINT AS segment, path, a_start::BIGINT AS start, a_end::BIGINT AS stop, md5(substr(text, a_start::BIGINT + 1, (a_end - a_start)::BIGINT)) AS digest,
  concat_ws(',', t0 || ' after ' || d0::BIGINT, t1 || ' before ' || d1::BIGINT) AS tables FROM atoms JOIN d USING (doc_id)""")  # fmt: skip
def markdown_atoms(spark: SparkSession, sf: str) -> DataFrame:
    """Every heading, list and paragraph with its place, the titles above it and the tables beside it."""
    rows = units.atoms_of(units.marked_lines(_documents(spark, sf), "doc_id", "text"), "doc_id")
    beside = F.transform("tables", lambda t: F.concat_ws(" ", t["table"], t["relation"], t["distance"]))
    return rows.select("doc_id", F.col("atom").cast("long").alias("atom"), "kind", F.col("segment").cast("long").alias("segment"), F.array_join("heading_path", "/").alias("path"), "start", F.col("end").alias("stop"), F.md5("content").alias("digest"), F.array_join(beside, ",").alias("tables"))


@query("packed_units", f"""{_ATOMS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, segment ORDER BY a_start) AS k FROM atoms WHERE kind <> 'heading'),
  f AS (SELECT doc_id, segment, k, a_start AS u_start, a_end AS u_end FROM o WHERE k = 1
    UNION ALL SELECT o.doc_id, o.segment, o.k, CASE WHEN f.u_end - f.u_start < 900 AND o.a_end - f.u_start <= 1800 THEN f.u_start ELSE o.a_start END, o.a_end FROM f JOIN o ON o.doc_id = f.doc_id AND o.segment = f.segment AND o.k = f.k + 1),
  r AS (SELECT doc_id, segment, u_start, max(u_end) AS u_end, count(*) AS n, min(kind) AS first_kind, max(kind) AS last_kind, min(path) AS path, flatten(list([t0, t1])) AS ts FROM f JOIN o USING (doc_id, segment, k) GROUP BY ALL)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY u_start) AS unit, path, CASE WHEN first_kind = last_kind THEN first_kind ELSE first_kind || '+' || last_kind END AS kinds, n AS atoms, u_start::BIGINT AS start, u_end::BIGINT AS stop, n = 1 AND u_end - u_start > 1800 AS oversize,
    md5(substr(text, u_start::BIGINT + 1, (u_end - u_start)::BIGINT)) AS digest, array_to_string(list_sort(list_distinct(list_filter(ts, lambda x: x IS NOT NULL))), ',') AS tables FROM r JOIN d USING (doc_id)""")  # fmt: skip
def packed_units(spark: SparkSession, sf: str) -> DataFrame:
    """Units of whole atoms that cross neither headings nor tables."""
    rows = units.packed_units(_documents(spark, sf), "doc_id", "text")
    return rows.select(
        "doc_id", F.col("unit").cast("long").alias("unit"), F.array_join("heading_path", "/").alias("path"), F.array_join("kinds", "+").alias("kinds"), F.size("atoms").cast("long").alias("atoms"), "start", F.col("end").alias("stop"), "oversize", F.md5("content").alias("digest"),
        F.array_join(F.transform("tables", lambda t: t.cast("string")), ",").alias("tables"),
    )
