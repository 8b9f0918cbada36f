"""HTML tables inside documents: parsing, span expansion, header bands, cells, edge lists, row evidence."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.shared import keep

#: Rows that a header may take, likeness of an embedded repeat, share of numbers that begins the data.
MOST_HEADER_ROWS, EMBEDDED_LIKENESS, NUMERIC_SHARE = 5, 0.6, 0.2
_WHOLE_NUMBER = r"^[-+(（]?[\d,]+(?:\.\d+)?[)）%％]?$"
_PERIOD_WORDS = ("年", "期", "金额", "比例", "数量", "余额", "发生额")
_TABLE = re.compile(r"<\s*table\b.*?<\s*/\s*table\s*>", re.S | re.I)


@dataclass
class Cell:
    text: str
    tag: str
    rowspan: int
    colspan: int


class _Rows(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[Cell]] = []
        self.open: Cell | None = None
        self.caption: list[str] | None = None
        self.caption_text = ""

    def _close(self):
        if self.open is not None:
            self.open.text = " ".join(self.open.text.split())
            self.open = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self._close()
            self.rows.append([])
        elif tag in ("td", "th"):
            self._close()
            if not self.rows:
                self.rows.append([])
            spans = {k: int(v) if (v or "").strip().isdigit() and int(v) > 0 else 1 for k, v in attrs if k in ("rowspan", "colspan")}
            self.open = Cell("", tag, spans.get("rowspan", 1), spans.get("colspan", 1))
            self.rows[-1].append(self.open)
        elif tag == "caption":
            self.caption = []
        elif tag == "br" and self.open is not None:
            self.open.text += " "

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._close()
        elif tag == "caption" and self.caption is not None:
            self.caption_text, self.caption = " ".join("".join(self.caption).split()), None

    def handle_data(self, data):
        if self.caption is not None:
            self.caption.append(data)
        elif self.open is not None:
            self.open.text += data


#: Markup that needs no parser: tags of tables and inline tags, plain attributes, no character references or comments.
_PLAIN = re.compile(r"""<(/?[a-zA-Z]+[1-6]?)((?:\s+[a-zA-Z]+(?:=(?:"[^"<>&]*"|'[^'<>&]*'|[^\s"'=<>`&/]+))?)*\s*)>([^<]*)""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z]+)(?:=(?:"([^"]*)"|'([^']*)'|(\S+)))?""")
_PLAIN_TAGS = frozenset("table thead tbody tfoot tr td th caption colgroup col br p b i u em strong span div sup sub font a".split())
_PLAIN_TAGS = _PLAIN_TAGS | {"/" + x for x in _PLAIN_TAGS}


def _plain_rows(raw: str) -> tuple[list[list[Cell]], str] | None:
    """As ``parse_rows``, tag by tag without a parser; None where the markup is not that plain."""
    if "&" in raw or "\0" in raw:
        return None
    found = _PLAIN.findall(raw)
    if sum([len(a) + len(b) + len(c) for a, b, c in found]) + 2 * len(found) != len(raw):
        return None
    reader = _Rows()
    rows = reader.rows
    for tag, attributes, text in found:
        if tag not in _PLAIN_TAGS or (attributes and tag[0] == "/"):
            return None
        if tag == "/td" or tag == "/th":
            if reader.open is not None:
                reader._close()
        elif (tag == "td" or tag == "th") and not attributes and rows:
            if reader.open is not None:
                reader._close()
            reader.open = Cell(text if reader.caption is None else "", tag, 1, 1)
            rows[-1].append(reader.open)
            if reader.caption is None:
                continue
        elif tag[0] == "/":
            reader.handle_endtag(tag[1:])
        else:
            reader.handle_starttag(tag, [(k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)])
        if text:
            reader.handle_data(text)
    if reader.caption is not None:  # a parser reads on
        return None
    return rows, reader.caption_text


def parse_rows(raw: str) -> tuple[list[list[Cell]], str]:
    plain = _plain_rows(raw)
    if plain is not None:
        return plain
    parser = _Rows()
    parser.feed(raw)
    parser.close()
    return parser.rows, parser.caption_text


def place(rows: list[list[Cell]]) -> list[tuple[int, int, Cell]]:
    """(row, column, cell): each cell takes the first free place of its row."""
    taken: set[tuple[int, int]] = set()
    out = []
    for r, row in enumerate(rows):
        c = 0
        for cell in row:
            while (r, c) in taken:
                c += 1
            if cell.rowspan > 1:  # what it takes of its own row lies behind
                taken.update((r + dr, c + dc) for dr in range(1, cell.rowspan) for dc in range(cell.colspan))
            out.append((r, c, cell))
            c += cell.colspan
    return out


def expand(rows: list[list[Cell]], placed: list[tuple[int, int, Cell]] | None = None) -> list[list[str]]:
    """A rectangular matrix: spans repeat the text of their cell, a later cell overwrites what it covers."""
    grid: dict[tuple[int, int], str] = {}
    for r, c, cell in place(rows) if placed is None else placed:
        if cell.rowspan == cell.colspan == 1:
            grid[r, c] = cell.text
        else:
            grid.update({(r + dr, c + dc): cell.text for dr in range(cell.rowspan) for dc in range(cell.colspan)})
    if not grid:
        return [[] for _ in rows]
    height, width = max([len(rows) - 1, *(r for r, _ in grid)]) + 1, max(c for _, c in grid) + 1
    return [[grid.get((r, c), "") for c in range(width)] for r in range(height)]


PARSED_SCHEMA = """document_id string, table_index int, caption string, matrix array<array<string>>, spans array<struct<row int, col int, rowspan int, colspan int, tag string, text string>>,
  source_rows int, char_start int, char_end int, line int, unit_hint string, section_path array<string>"""
_STR, _INT = pa.string(), pa.int32()
_ARROW = pa.schema(
    [("document_id", _STR), ("table_index", _INT), ("caption", _STR), ("matrix", pa.list_(pa.list_(_STR))), ("spans", pa.list_(pa.struct([("row", _INT), ("col", _INT), ("rowspan", _INT), ("colspan", _INT), ("tag", _STR), ("text", _STR)]))),
     ("source_rows", _INT), ("char_start", _INT), ("char_end", _INT), ("line", _INT), ("unit_hint", _STR), ("section_path", pa.list_(_STR))]
)
_HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$", re.M)
_UNIT_HINT = re.compile(r"(?:单位|金额单位|币种)\s*[:：]\s*([^,，;；。.\s]+)")
#: Lines above a table in which its unit may be declared.
HINT_LINES = 3
#: Tables of an Arrow batch.
BATCH_TABLES = 512


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows as Arrow columns, cells laid out flat."""
    columns = [list(c) for c in zip(*rows)] or [[] for _ in _ARROW]
    cells = [x for placed in columns[4] for x in placed]
    ends = np.cumsum([0, *map(len, columns[4])], dtype=np.int32)
    kind = _ARROW.field("spans").type.value_type
    parts = ([r for r, _, _ in cells], [c for _, c, _ in cells], [x.rowspan for *_, x in cells], [x.colspan for *_, x in cells], [x.tag for *_, x in cells], [x.text for *_, x in cells])
    spans = pa.ListArray.from_arrays(pa.array(ends, _INT), pa.StructArray.from_arrays([pa.array(p, f.type) for p, f in zip(parts, kind)], fields=list(kind)))
    lines = [row for matrix in columns[3] for row in matrix]
    texts = pa.array([v for row in lines for v in row], _STR)
    inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lines)], dtype=np.int32), _INT), texts)
    matrix = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, columns[3])], dtype=np.int32), _INT), inner)
    made = {"spans": spans, "matrix": matrix}
    return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.array(c, f.type) for f, c in zip(_ARROW, columns)], schema=_ARROW)


def parse_tables(documents: DataFrame, document_id: str, text: str) -> DataFrame:
    """The tables of each document as they stand: matrix, spans, place, headings above and the unit declared just above."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = body or ""
                headings = [(m.start(), len(m[1]), m[2]) for m in _HEADING.finditer(body)]
                path: list[tuple[int, str]] = []
                seen, line, counted = 0, 1, 0
                for k, m in enumerate(_TABLE.finditer(body)):
                    line, counted = line + body.count("\n", counted, m.start()), m.start()
                    while seen < len(headings) and headings[seen][0] < m.start():
                        _, level, title = headings[seen]
                        path, seen = [x for x in path if x[0] < level] + [(level, title)], seen + 1
                    rows, caption = parse_rows(m[0])
                    above = body[: m.start()].rsplit("\n", HINT_LINES + 1)[-HINT_LINES - 1 :]
                    hint = _UNIT_HINT.findall("\n".join([*above, caption]))
                    placed = place(rows)
                    out.append((doc, k, caption or None, expand(rows, placed), placed, len(rows), m.start(), m.end(), line, hint[-1] if hint else None, [t for _, t in path]))
                    if len(out) == BATCH_TABLES:
                        yield _batch(out)
                        out = []
            yield _batch(out)

    return documents.select(documents[document_id].cast("string"), text).mapInArrow(run, PARSED_SCHEMA)


def _numeric(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda v: v.rlike(_WHOLE_NUMBER)))


def _filled(row: Column) -> Column:
    return F.filter(row, lambda v: v != "")


def _header_like(row: Column) -> Column:
    """Something is written, and less than half of it are numbers."""
    written = _filled(row)
    return (F.size(written) > 0) & (_numeric(written) * 2 < F.size(written))


def header_rows(tables: DataFrame) -> DataFrame:
    """Adds ``header_rows``, the band from the top, and ``embedded_headers``, later rows that repeat it.

    A row joins the band while it is header-like and something ties it to the rows
    above: a first row with spans or header cells, a cell that reaches down into it, or a
    wide cell right above; once a second row has joined, the next need no tie. By array
    functions only.
    """
    first = F.exists("spans", lambda s: (s["row"] == 0) & ((s["rowspan"] > 1) | (s["colspan"] > 1) | (s["tag"] == "th")))
    likes = F.transform("matrix", _header_like)

    def grow(band: Column, r: Column) -> Column:
        reached = F.exists("spans", lambda s: (s["row"] < r) & (s["row"] + s["rowspan"] > r) & F.array_contains(band, s["row"]))
        wide = F.exists("spans", lambda s: (s["row"] == r - 1) & (s["colspan"] > 1))
        joins = (F.size(band) == r) & F.get("__likes", r) & (F.col("__first") | (F.size(band) > 1) | reached | wide)
        return F.when(joins, F.concat(band, F.array(r))).otherwise(band)

    rows = F.slice(F.array(*[F.lit(k) for k in range(1, MOST_HEADER_ROWS)]), 1, F.greatest(F.size("matrix") - 1, F.lit(0)))
    band = F.when(F.size("matrix") == 0, F.array().cast("array<int>")).otherwise(F.aggregate(rows, F.array(F.lit(0)), grow))
    out = tables.withColumns({"__first": first, "__likes": likes}).withColumn("header_rows", band)
    known = F.array_distinct(_filled(F.flatten(F.transform("header_rows", lambda r: F.get("matrix", r)))))

    def repeats(row: Column, r: Column) -> Column:
        values = F.array_distinct(_filled(row))
        alike = F.size(F.array_intersect(values, "__known")) / F.greatest(F.lit(1), F.least(F.size(values), F.size("__known")))
        return (r >= F.size("header_rows")) & F.get("__likes", r) & (alike >= EMBEDDED_LIKENESS)

    marked = F.transform("matrix", lambda row, r: F.when(repeats(row, r), r))
    return out.withColumn("__known", known).withColumn("embedded_headers", F.array_compact(marked)).drop("__first", "__likes", "__known")


def flat_header(matrix: Column, band: Column) -> Column:
    """One label a column: what its header rows say, repeats of the label above left out; 第n列 where they say nothing."""

    def label(column: Column) -> Column:
        said = _filled(F.transform(band, lambda r: F.get(F.get(matrix, r), column)))
        new = F.filter(said, lambda v, i: (i == 0) | (v != F.get(said, i - 1)))
        return F.when(F.size(new) > 0, F.array_join(new, " / ")).otherwise(F.format_string("第%d列", column + 1))

    columns = F.sequence(F.lit(0), F.greatest(F.size(F.get(matrix, F.lit(0))) - 1, F.lit(0)))
    return F.when(F.coalesce(F.size(F.get(matrix, F.lit(0))), F.lit(0)) > 0, F.transform(columns, label)).otherwise(F.array().cast("array<string>"))


def data_start(matrix: Column, header: Column, outside: Column) -> Column:
    """The first column after the first that is numeric in a fifth of its body, or whose label names a period or an amount.

    ``outside``: the rows that are no body.
    """
    width = F.coalesce(F.size(F.get(matrix, F.lit(0))), F.lit(0))
    body = F.filter(matrix, lambda row, r: ~F.array_contains(outside, r))

    def begins(column: Column) -> Column:
        written = _filled(F.transform(body, lambda row: F.get(row, column)))
        numeric = (F.size(written) > 0) & (_numeric(written) >= F.size(written) * NUMERIC_SHARE)
        return numeric | F.get(header, column).rlike("|".join(_PERIOD_WORDS))

    later = F.filter(F.sequence(F.lit(1), F.greatest(width - 1, F.lit(1))), begins)
    return F.when(width <= 1, width).otherwise(F.coalesce(F.get(later, F.lit(0)), F.lit(1)))


def extract_tables(documents: DataFrame, document_id: str, text: str) -> DataFrame:
    """One row per table of each document with its status, header and layout; documents without tables give none.

    Documents are parsed one by one; all that follows from a matrix is told by array
    functions.
    """
    rows = header_rows(parse_tables(documents, document_id, text))
    filled = F.exists("matrix", lambda row: F.exists(row, lambda v: v != ""))
    none = F.array()
    rows = rows.withColumn("status", F.when(filled, "parsed").otherwise("empty"))
    for name in ("header_rows", "embedded_headers"):
        rows = rows.withColumn(name, F.when(filled, F.col(name)).otherwise(none.cast("array<int>")))
    rows = rows.withColumn("header", F.when(filled, flat_header(F.col("matrix"), F.col("header_rows"))).otherwise(none.cast("array<string>")))
    return rows.withColumn("data_start", F.when(filled, data_start(F.col("matrix"), F.col("header"), F.concat("header_rows", "embedded_headers"))).otherwise(0))


def readiness(tables: DataFrame) -> DataFrame:
    """Adds ``failure``: why a table cannot be used, or null."""
    ragged = F.size(F.array_distinct(F.transform("matrix", lambda row: F.size(row)))) > 1
    failure = F.when(F.col("status") != "parsed", F.concat(F.lit("parse_status_"), "status")).when(F.size("matrix") == 0, "empty_matrix").when(ragged, "ragged_matrix").when(F.size("matrix") < 2, "no_body_rows")
    return tables.withColumn("failure", failure)


def grid_mismatches(tables: DataFrame) -> DataFrame:
    """(document_id, table_index, cells, covered, mismatches): the grid built again from the spans against the matrix.

    Every place is owned by the last cell that covers it; places that no cell covers
    must be blank. Spans are exploded to places and aggregated, so that nothing depends on
    the size of a table.
    """
    keys = ["document_id", "table_index"]
    tables = keep(tables.select(*keys, "matrix", "spans"), "grids")  # read three times, parsed once
    cell = tables.select(*keys, F.posexplode("spans").alias("n", "s"))
    down = cell.select(*keys, "n", "s", F.explode(F.expr("sequence(s.row, s.row + s.rowspan - 1)")).alias("r"))
    spots = down.select(*keys, "n", "r", F.explode(F.expr("sequence(s.col, s.col + s.colspan - 1)")).alias("c"), "s.text")
    owned = spots.groupBy(*keys, "r", "c").agg(F.max_by("text", "n").alias("owner"))
    line = tables.select(*keys, F.posexplode("matrix").alias("r", "row"))
    written = line.select(*keys, "r", F.posexplode("row").alias("c", "value"))
    both = written.join(owned, [*keys, "r", "c"], "full_outer")
    differs = ~F.coalesce(F.col("value"), F.lit("")).eqNullSafe(F.coalesce("owner", F.lit("")))
    out = both.groupBy(*keys).agg(F.count("owner").alias("covered"), F.count_if(differs).alias("mismatches"))
    return out.join(tables.select(*keys, F.size("spans").alias("cells")), keys)


def find_unique(wanted: DataFrame, table_cells: DataFrame) -> DataFrame:
    """Wanted (document_id, table_index, row_index, column_label, raw_value) with the one cell that fits, and how many do.

    ``status``: matched, missing or ambiguous; only a unique match names its column.
    """
    keys = ["document_id", "table_index", "row_index", "column_label", "raw_value"]
    n = table_cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("col_index").alias("col_index"))
    out = wanted.join(n, keys, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    status = F.when(F.col("n") == 1, "matched").when(F.col("n") == 0, "missing").otherwise("ambiguous")
    return out.withColumns({"col_index": F.when(F.col("n") == 1, F.col("col_index")), "status": status})


def cells(tables: DataFrame) -> DataFrame:
    """Non-empty cells with role, column label and row label, by built-in functions only."""
    rows = tables.select("document_id", "table_index", F.col("matrix")[0].alias("head"), F.posexplode("matrix").alias("row_index", "row"))
    first = F.element_at(F.filter("row", lambda v: v != ""), 1)
    at = F.array_position("row", first)
    out = rows.filter(F.exists("row", lambda v: v != "")).select("document_id", "table_index", "row_index", "head", first.alias("first"), at.alias("at"), F.posexplode("row").alias("col_index", "raw_value"))
    out = out.filter("raw_value <> ''")
    role = F.when(F.col("row_index") == 0, "header").when(F.col("col_index") + 1 == F.col("at"), "row_header").otherwise("data")
    label = F.coalesce(F.nullif(F.get("head", F.col("col_index")), F.lit("")), F.concat(F.lit("Col"), F.col("col_index") + 1))
    return out.select(
        "document_id", "table_index", "row_index", "col_index", role.alias("cell_role"), label.alias("column_label"), F.when(F.col("row_index") == 0, "").otherwise(F.col("first")).alias("row_label"), "raw_value"
    )


def edge_list(table_cells: DataFrame) -> DataFrame:
    """``(row; column; value)`` strings of each table, in order."""
    text = F.format_string("(row%d; %s; %s)", "row_index", "column_label", "raw_value")
    own = table_cells.filter("row_index > 0").groupBy("document_id", "table_index").agg(F.array_sort(F.collect_list(F.struct("row_index", "col_index", text.alias("edge")))).alias("e"))
    return own.select("document_id", "table_index", F.transform("e", lambda x: x["edge"]).alias("edges"))


def row_evidence(table_cells: DataFrame) -> DataFrame:
    """One display text per data row, its labels in the order of columns."""
    part = F.concat_ws("=", "column_label", "raw_value")
    own = table_cells.filter("cell_role = 'data'").groupBy("document_id", "table_index", "row_index", "row_label").agg(F.array_sort(F.collect_list(F.struct("col_index", part.alias("p")))).alias("c"))
    return own.select("document_id", "table_index", "row_index", F.concat(F.col("row_label"), F.lit(": "), F.array_join(F.transform("c", lambda x: x["p"]), "; ")).alias("display_text"))


def carried_category(rows: DataFrame, keys: list[str], order: list[str], category: str) -> DataFrame:
    """The last category that a row or one above it names."""
    above = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(category, F.last(category, ignorenulls=True).over(above))
