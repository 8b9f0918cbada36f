"""Structure queries: HTML tables, cells, headings, chunks, windows, positional joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import chunking, tables
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


def _html_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as HTML tables, one per customer: a header over two rows with spans, then a row per order."""
    rows = table(spark, sf, "orders")
    line = F.concat(F.lit("<tr><td>"), "o_orderkey", F.lit("</td><td>"), F.col("o_orderstatus"), F.lit("</td><td>"), F.col("o_totalprice").cast("decimal(18,2)"), F.lit("</td></tr>"))
    own = rows.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("t")))), lambda x: x["t"]), "").alias("body"))
    head = F.lit("<table><caption>Orders</caption><tr><th rowspan=2>Key</th><th colspan=2>Detail</th></tr><tr><th>Status</th><th>Price</th></tr>")
    return own.select(F.concat(F.lit("C"), "o_custkey").alias("document_id"), F.concat(F.lit("Intro.\n"), head, "body", F.lit("</table>")).alias("text"))


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    return tables.extract_tables(_html_tables(spark, sf), "document_id", "text")


@_query("html_tables", "SELECT 'C' || o_custkey AS document_id, 'parsed' AS status, 'Orders' AS caption, 'Key,Detail / Status,Detail / Price' AS header, count(*) + 2 AS source_rows FROM orders GROUP BY o_custkey")
def html_tables(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf).select("document_id", "status", "caption", F.array_join("header", ",").alias("header"), F.col("source_rows").cast("long").alias("source_rows"))


@_query("span_expand", "SELECT 'C' || o_custkey AS document_id, 3 AS width, count(*) + 2 AS height, 'Key|Detail|Detail' AS first_row, 'Key|Status|Price' AS second_row FROM orders GROUP BY o_custkey")
def span_expand(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("matrix")
    return _extracted(spark, sf).select("document_id", F.size(m[0]).alias("width"), F.size(m).cast("long").alias("height"), F.array_join(m[0], "|").alias("first_row"), F.array_join(m[1], "|").alias("second_row"))


@_query("table_cells", """SELECT 'C' || o_custkey AS document_id, cell_role, count(*) AS n, max(v) AS largest FROM (
  SELECT o_custkey, 'row_header' AS cell_role, o_orderkey::VARCHAR AS v FROM orders UNION ALL SELECT o_custkey, 'data', o_orderstatus FROM orders UNION ALL SELECT o_custkey, 'data', o_totalprice::DECIMAL(18,2)::VARCHAR FROM orders
  UNION ALL SELECT DISTINCT o_custkey, unnest(['header', 'header', 'header', 'row_header', 'data', 'data']), unnest(['Key', 'Detail', 'Detail2', 'Key', 'Status', 'Price']) FROM orders) GROUP BY ALL""".replace("'Detail2'", "'Detail'").replace("SELECT DISTINCT o_custkey, unnest", "SELECT o_custkey, unnest").replace("FROM orders) GROUP", "FROM (SELECT DISTINCT o_custkey FROM orders)) GROUP"))
def table_cells(spark: SparkSession, sf: str) -> DataFrame:
    return tables.cells(_extracted(spark, sf)).groupBy("document_id", "cell_role").agg(F.count(F.lit(1)).alias("n"), F.max("raw_value").alias("largest"))


@_query("header_bands", "SELECT 'C' || o_custkey AS document_id, '0,1' AS header_rows, CASE WHEN count(*) >= 1 THEN 2 END::INTEGER AS data_start FROM orders GROUP BY o_custkey")
def header_bands(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf).select("document_id", F.array_join(F.transform("header_rows", lambda x: x.cast("string")), ",").alias("header_rows"), "data_start")


@_query("table_edges", """WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS k, o_orderkey::VARCHAR AS a, o_orderstatus AS b, o_totalprice::DECIMAL(18,2)::VARCHAR AS c FROM orders
    UNION ALL SELECT DISTINCT o_custkey, 1, 'Key', 'Status', 'Price' FROM orders)
  SELECT 'C' || o_custkey AS document_id, 0 AS table_index, count(*) * 3 AS n, md5(string_agg('(row' || k || '; Key; ' || a || ')|(row' || k || '; Detail; ' || b || ')|(row' || k || '; Detail; ' || c || ')', '|' ORDER BY k)) AS digest FROM r GROUP BY o_custkey""")  # fmt: skip
def table_edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.edge_list(tables.cells(_extracted(spark, sf)))
    return rows.select("document_id", "table_index", F.size("edges").cast("long").alias("n"), F.md5(F.array_join("edges", "|")).alias("digest"))


@_query("row_evidence", """SELECT 'C' || o_custkey AS document_id, o_orderkey || ': Detail=' || o_orderstatus || '; Detail=' || o_totalprice::DECIMAL(18,2)::VARCHAR AS display_text FROM orders
  UNION ALL SELECT DISTINCT 'C' || o_custkey, 'Key: Detail=Status; Detail=Price' FROM orders""")  # fmt: skip
def row_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return tables.row_evidence(tables.cells(_extracted(spark, sf))).select("document_id", "display_text")


@_query("category_carry_forward", """SELECT l_orderkey, l_linenumber, last_value(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate ROWS UNBOUNDED PRECEDING) AS category FROM lineitem""")
def category_carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("category"))
    out = tables.carried_category(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"], "category")
    return out.select("l_orderkey", "l_linenumber", "category")


def _markdown():
    """Short lines that end a sentence stand for headings."""
    return F.regexp_replace("text", r"(?m)^([^\n]{1,60}\.)$", "## $1").alias("text")


_MARKED = r"regexp_replace(text, '(?m)^([^\n]{1,60}\.)$', '## \1', 'g')"
_MARKED_LINES = f"l AS (SELECT doc_id, generate_subscripts(string_split(t, chr(10)), 1) AS line, unnest(string_split(t, chr(10))) AS content FROM (SELECT doc_id, {_MARKED} AS t FROM documents))"
_IS_HEADING = r"regexp_matches(content, '^#{1,6}\s+\S')"


@_query("heading_outline", f"""WITH {_MARKED_LINES} SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE line >= first) AS below_heading FROM l LEFT JOIN (SELECT doc_id, min(line) AS first FROM l WHERE regexp_matches(content, '^#{{1,6}}\\s') GROUP BY 1) USING (doc_id) GROUP BY doc_id""")
def heading_outline(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunking.lines(table(spark, sf, "documents").select("doc_id", _markdown()), "doc_id", "text")
    level = F.nullif(F.length(F.regexp_extract("content", r"^(#{1,6})\s", 1)), F.lit(0))
    out = chunking.heading_paths(rows, "doc_id", level, F.regexp_replace("content", r"^#{1,6}\s+", ""))
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.size("heading_path") > 0).alias("below_heading"))


def _kept(rows: DataFrame, most: int) -> DataFrame:
    """Per document how many characters its chunks hold, white space aside, and whether all are short enough."""
    bare = F.length(F.regexp_replace("content", r"(?U)\s+", ""))
    return rows.groupBy("document_id").agg(F.sum(bare).alias("kept"), (F.max("n_chars") <= most).alias("within"))


@_query("markdown_chunks", f"""WITH {_MARKED_LINES} SELECT doc_id::VARCHAR AS document_id, sum(length(regexp_replace(content, '\\s+', '', 'g')))::BIGINT AS kept, true AS within FROM l WHERE NOT {_IS_HEADING} GROUP BY 1 HAVING kept > 0""")
def markdown_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(chunking.markdown_chunks(table(spark, sf, "documents").select("doc_id", _markdown()), "doc_id", "text"), 1200)


@_query("retrieval_units", f"""WITH {_MARKED_LINES} SELECT doc_id::VARCHAR AS document_id, sum(length(regexp_replace(content, '\\s+', '', 'g')))::BIGINT AS kept, true AS within FROM l WHERE NOT {_IS_HEADING} GROUP BY 1 HAVING kept > 0""")
def retrieval_units(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(chunking.retrieval_units(table(spark, sf, "documents").select("doc_id", _markdown()), "doc_id", "text"), 1800)


@_query("token_windows", """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
  w AS (SELECT doc_id, t, unnest(CASE WHEN len(t) <= 200 THEN [0] ELSE range(0, len(t), 150) END) AS start FROM t WHERE len(t) > 0)
  SELECT doc_id, CASE WHEN start = 0 THEN 0 ELSE start // 150 END AS window, len(t[start + 1:start + 200]) AS n, md5(array_to_string(t[start + 1:start + 200], ' ')) AS digest FROM w""")  # fmt: skip
def token_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = chunking.token_windows(table(spark, sf, "documents"), "doc_id", text.words(F.col("text")), 200, 50)
    return out.select("doc_id", F.col("window").cast("long").alias("window"), F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@_query("overlap_tails", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
  SELECT doc_id, line::INTEGER AS line, md5(coalesce(right(lag(content) OVER (PARTITION BY doc_id ORDER BY line), 20), '') || content) AS digest FROM l""")  # fmt: skip
def overlap_tails(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunking.lines(table(spark, sf, "documents"), "doc_id", "text")
    return chunking.overlap_tail(rows, "doc_id", "line", "content", 20).select("doc_id", "line", F.md5("with_overlap").alias("digest"))


@_query("line_asof_offset", """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
  s AS (SELECT doc_id, generate_subscripts(parts, 1) AS line, unnest(list_transform(range(len(parts)), lambda i: coalesce(list_sum(list_transform(parts[1:i], lambda x: length(x) + 1)), 0)))::BIGINT AS start FROM p),
  m AS (SELECT doc_id, unnest([0, 100, 1000, 100000]) AS off FROM documents)
  SELECT m.doc_id, m.off AS "offset", max(line)::INTEGER AS line FROM m JOIN s ON s.doc_id = m.doc_id AND s.start <= m.off GROUP BY ALL""")  # fmt: skip
def line_asof_offset(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    marks = docs.select("doc_id", F.explode(F.array(*map(F.lit, (0, 100, 1000, 100000)))).alias("offset"))
    return chunking.line_of_offset(marks, chunking.lines(docs, "doc_id", "text"), "doc_id")


def _seconds():
    """An event's whole seconds, rounded half to even, as a cast of seconds to a whole number is in SQL."""
    return F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")


@_query("interval_overlap_join", """WITH e AS (SELECT event_id, user_id, epoch(ts)::BIGINT AS s, epoch(ts)::BIGINT + 3600 AS t FROM events)
  SELECT a.event_id, b.event_id AS other_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.s <= b.t AND a.t >= b.s WHERE a.event_id < b.event_id""")  # fmt: skip
def interval_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "user_id", _seconds().alias("start"), (_seconds() + 3600).alias("end"))
    out = chunking.overlaps(rows, rows, "user_id").filter("event_id < other_event_id")
    return out.select("event_id", F.col("other_event_id").alias("other_id"))


@_query("proximity_link", """WITH b AS (SELECT l_orderkey, l_linenumber AS block_id, l_linenumber * 3 AS s, l_linenumber * 3 + 1 AS e FROM lineitem WHERE l_returnflag = 'N'),
  t AS (SELECT l_orderkey, l_linenumber AS table_id, l_linenumber * 3 AS s, l_linenumber * 3 + 2 AS e FROM lineitem WHERE l_returnflag <> 'N')
  SELECT b.l_orderkey, block_id, array_to_string(list_sort(list(DISTINCT table_id)), ',') AS table_ids FROM b JOIN t ON b.l_orderkey = t.l_orderkey
  WHERE least(abs(b.s - t.e), abs(t.s - b.e)) <= 3 OR (b.s <= t.e AND b.e >= t.s) GROUP BY ALL""")  # fmt: skip
def proximity_link(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_linenumber") * 3).alias("start"))
    blocks = rows.filter("l_returnflag = 'N'").select("l_orderkey", F.col("l_linenumber").alias("block_id"), "start", (F.col("start") + 1).alias("end"))
    t = rows.filter("l_returnflag <> 'N'").select("l_orderkey", F.col("l_linenumber").alias("table_id"), "start", (F.col("start") + 2).alias("end"))
    out = chunking.nearby(blocks, t, ["l_orderkey"])
    return out.select("l_orderkey", "block_id", F.array_join(F.transform("table_ids", lambda x: x.cast("string")), ",").alias("table_ids"))


@_query("neighbour_expansion", """WITH s AS (SELECT doc_id, n_chars, lang FROM documents), h AS (SELECT doc_id, 1.0 AS score FROM s WHERE n_chars % 9 = 0),
  n AS (SELECT s.doc_id, 0.42 AS score FROM h JOIN s ON s.doc_id IN (h.doc_id - 1, h.doc_id + 1))
  SELECT doc_id, max(score)::DOUBLE AS score FROM (SELECT * FROM h UNION ALL SELECT * FROM n) GROUP BY doc_id""")  # fmt: skip
def neighbour_expansion(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "n_chars")
    hits = rows.filter("n_chars % 9 = 0").select("doc_id", F.lit(1.0).alias("score"))
    near = hits.select(F.explode(F.array(F.col("doc_id") - 1, F.col("doc_id") + 1)).alias("doc_id"), (F.col("score") * 0.42).alias("score")).join(rows.select("doc_id"), "doc_id", "left_semi")
    return hits.unionByName(near).groupBy("doc_id").agg(F.max("score").alias("score"))


@_query("fuzzy_match")
def fuzzy_match(spark: SparkSession, sf: str) -> DataFrame:
    """All part names, as they are and without their first or last letter, against all part names."""
    known = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    length = F.length("name")
    forms = F.array(F.col("name"), F.substring(F.col("name"), F.lit(2), length), F.substring(F.col("name"), F.lit(1), length - 1))
    return chunking.fuzzy_match(known.select(F.explode(forms).alias("name")), known, 0.9)


# --- tables and text side by side -----------------------------------------------------------------


@_query("grid_reconstruction", "SELECT 'C' || o_custkey AS document_id, 3 * (count(*) + 2) AS covered, 0 AS mismatches, 3 * (count(*) + 2) - 2 AS cells FROM orders GROUP BY o_custkey")
def grid_reconstruction(spark: SparkSession, sf: str) -> DataFrame:
    """One cell spans two columns, one two rows: two places more than cells."""
    return tables.grid_mismatches(_extracted(spark, sf)).select("document_id", "covered", "mismatches", F.col("cells").cast("long").alias("cells"))


@_query("table_readiness", "SELECT 'C' || o_custkey AS document_id, NULL::VARCHAR AS failure FROM orders GROUP BY o_custkey UNION ALL SELECT 'none', 'parse_status_empty'")
def table_readiness(spark: SparkSession, sf: str) -> DataFrame:
    empty = spark.createDataFrame([("none", "<table><tr><td></td></tr></table>")], "document_id string, text string")
    both = _html_tables(spark, sf).unionByName(empty)
    return tables.readiness(tables.extract_tables(both, "document_id", "text")).select("document_id", "failure")


@_query("unique_cells", """WITH k AS (SELECT o_custkey, o_orderstatus AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS r FROM orders)
  SELECT 'C' || o_custkey AS document_id, r::INTEGER AS row_index, 'matched' AS status, 1 AS col_index FROM k UNION ALL SELECT 'C' || o_custkey, 1, 'missing', NULL FROM orders GROUP BY o_custkey""")  # fmt: skip
def unique_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Every order's status is looked for in its row; in the second header row it is not."""
    cells = tables.cells(_extracted(spark, sf))
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) + 1
    wanted = table(spark, sf, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("document_id"), at.alias("row_index"), F.col("o_orderstatus").alias("raw_value"))
    wanted = wanted.unionByName(wanted.select("document_id").distinct().select("document_id", F.lit(1).alias("row_index"), F.lit("F").alias("raw_value")))
    asked = wanted.withColumns({"table_index": F.lit(0), "column_label": F.lit("Detail")})
    return tables.find_unique(asked, cells).select("document_id", "row_index", "status", "col_index")


_TITLED = "'# T' || doc_id || chr(10) || coalesce(text, '') || chr(10) || '## End' || chr(10) || 'last words of ' || doc_id"


@_query("text_atoms", rf"""WITH b AS (SELECT doc_id, regexp_replace({_TITLED}, '(?m)^#{{1,6}}[ \t]+\S[^\n]*$', chr(10), 'g') AS t FROM documents),
  p AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(t, '\n[ \t\r\f\v]*\n'), lambda x: rtrim(ltrim(x, chr(10)), ' ' || chr(10) || chr(9) || chr(13))), lambda x: regexp_matches(x, '\S'))) AS content FROM b)
  SELECT doc_id::VARCHAR AS document_id, count(*) AS atoms, sum(length(regexp_replace(content, '\s+', '', 'g')))::BIGINT AS chars, 1 AS at_end, true AS exact FROM p GROUP BY 1""")  # fmt: skip
def text_atoms(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of all documents under a title, and of a section at their end; ``exact`` holds character and byte ranges against the text."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.expr(_TITLED).alias("text"))
    rows = chunking.text_atoms(docs, "document_id", "text").join(docs, "document_id")
    cut = F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("content")
    raw = F.expr("substring(encode(text, 'UTF-8'), byte_start + 1, byte_end - byte_start) = encode(content, 'UTF-8')")
    last = F.element_at("heading_path", -1) == "End"
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("atoms"), F.sum(F.length(F.regexp_replace("content", r"(?U)\s+", ""))).alias("chars"), F.count_if(last).cast("int").alias("at_end"), F.every(cut & raw).alias("exact"))


@_query("text_blocks", """WITH d AS (SELECT doc_id, string_split(text, chr(10))[1] AS c FROM documents WHERE length(trim(string_split(text, chr(10))[1])) > 0) SELECT doc_id, greatest(1, ceil(length(c) / 100.0))::BIGINT AS blocks, md5(c) AS digest FROM d""")
def text_blocks(spark: SparkSession, sf: str) -> DataFrame:
    first = F.split("text", "\n")[0]
    rows = table(spark, sf, "documents").select("doc_id", F.lit("a").alias("atom_id"), first.alias("content")).filter(F.length(F.trim("content")) > 0)
    out = chunking.text_blocks(rows.withColumnRenamed("doc_id", "document_id"), 100)
    own = out.groupBy("document_id").agg(F.count(F.lit(1)).alias("blocks"), F.array_sort(F.collect_list(F.struct("block", "content"))).alias("b"))
    return own.select(F.col("document_id").alias("doc_id"), "blocks", F.md5(F.array_join(F.transform("b", lambda x: x["content"]), "")).alias("digest"))


@_query("atom_projection", """WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS a, l_suppkey % 3 AS d, l_extendedprice AS x FROM lineitem) SELECT l_orderkey, l_linenumber, x, CASE WHEN a % 3 = d THEN 'text ' || a ELSE '' END || CASE WHEN (a + 1) % 3 = d THEN 'text ' || (a + 1) ELSE '' END AS contents, 2 - (a % 3 = d)::INT - ((a + 1) % 3 = d)::INT AS missing FROM u""")
def atom_projection(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.range(60).select(F.concat(F.lit("a"), "id").alias("atom_id"), F.pmod("id", F.lit(3)).alias("document_id"), F.concat(F.lit("text "), "id").alias("content"))
    a = F.pmod("l_partkey", F.lit(50))
    units = table(spark, sf, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("unit_id"), F.pmod("l_suppkey", F.lit(3)).alias("document_id"), F.array(F.concat(F.lit("a"), a), F.concat(F.lit("a"), a + 1)).alias("atom_ids"))
    out = chunking.project_atoms(units, known)
    return out.select("unit_id.l_orderkey", "unit_id.l_linenumber", F.col("unit_id.l_extendedprice").alias("x"), F.array_join("contents", "").alias("contents"), "missing")


@_query("chunk_alignment", r"""WITH d AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS t, regexp_replace(substr(text, 5, 40), '\s+', '', 'g') AS c FROM documents)
  SELECT doc_id, CASE WHEN c = '' OR instr(t, c) = 0 THEN 'missing' WHEN instr(substr(t, instr(t, c) + 1), c) > 0 THEN 'ambiguous' ELSE 'aligned' END AS status FROM d""")  # fmt: skip
def chunk_alignment(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    chunks = docs.select("doc_id", F.lit("c").alias("chunk_id"), F.substring("text", 5, 40).alias("content"))
    return chunking.align_chunks(chunks, docs, "doc_id").select("doc_id", "status")


@_query("gold_matches", """WITH e AS (SELECT event_id, user_id, epoch(ts)::BIGINT // 600 AS s, props AS text FROM events), g AS (SELECT * FROM e WHERE event_id % 5 = 0)
  SELECT e.event_id AS candidate_id, g.event_id AS gold_id FROM e JOIN g ON e.user_id = g.user_id WHERE abs(e.s - g.s) <= 3 OR e.event_id = g.event_id OR contains(e.text, g.text) OR contains(g.text, e.text)""")  # fmt: skip
def gold_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of four lines overlap where their starts are at most three apart."""
    rows = table(spark, sf, "events").select("user_id", F.col("event_id").alias("candidate_id"), F.floor(_seconds() / 600).alias("start"), F.col("props").alias("text")).withColumn("end", F.col("start") + 3)
    gold = rows.filter("candidate_id % 5 = 0").withColumnRenamed("candidate_id", "gold_id")
    return chunking.matches_gold(rows, gold, "user_id")
