"""Splitting documents: lines and headings, sections, packed chunks, token windows, fragments, links between parts."""

from __future__ import annotations

import difflib
import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What links a text block to a table, and how many tables it may name.
LINE_GAP, MOST_LINKS = 3, 20
_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$", re.M)
_SENTENCE = re.compile(r"[^。！？!?；;.\n]*[。！？!?；;.\n]+|[^。！？!?；;.\n]+")


def lines(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, content, start): the lines of each document with their character offsets, by a running sum over its lines."""
    rows = documents.select(key, F.posexplode(F.split(text, "\n")).alias("i", "content"))
    before = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("content") + 1).over(before), F.lit(0)).cast("int")
    return rows.select(key, (F.col("i") + 1).alias("line"), "content", start.alias("start"))


def line_of_offset(marks: DataFrame, line_rows: DataFrame, key: str) -> DataFrame:
    """As-of join: the last line that starts at or before each (key, offset)."""
    both = line_rows.select(key, F.col("start").alias("at"), F.lit(0).alias("kind"), "line").unionByName(marks.select(key, F.col("offset").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("line")))
    before = Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("line", F.last("line", ignorenulls=True).over(before)).filter("kind = 1").select(key, F.col("at").alias("offset"), "line")


def heading_paths(line_rows: DataFrame, key: str, level: Column, title: Column) -> DataFrame:
    """As-of join with a stack: for each line the titles of the open headings, one per level.

    A heading closes all deeper ones: level k is open if no heading of a level
    up to k came after it.
    """
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = line_rows.withColumns({"__level": level, "__title": title})
    for k in range(1, 7):
        at = F.struct("line", F.when(F.col("__level") == k, F.col("__title")).alias("t"))
        rows = rows.withColumn(f"__h{k}", F.last(F.when(F.col("__level") <= k, at), ignorenulls=True).over(before))
    path = F.array_compact(F.array(*[F.col(f"__h{k}.t") for k in range(1, 7)]))
    return rows.withColumn("heading_path", path).drop("__level", "__title", *[f"__h{k}" for k in range(1, 7)])


def overlaps(a: DataFrame, b: DataFrame, key: str, width: int = 3600) -> DataFrame:
    """Pairs of ranges of one document that overlap.

    Ranges are dealt into bins of ``width``, one row for each bin that they touch, and joined by
    document and bin, so that a document with very many ranges is spread over tasks and
    ranges far apart never meet. A pair counts in the first bin that both touch.
    """
    bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.greatest("end", "start") / width)))
    left = a.withColumn("__bin", bins)
    right = b.withColumn("__bin", bins).select(F.col(key).alias("__k"), F.col("__bin").alias("__b"), *[F.col(c).alias(f"other_{c}") for c in b.columns if c != key])
    both = left.join(right, (F.col(key) == F.col("__k")) & (F.col("__bin") == F.col("__b"))).filter((F.col("start") <= F.col("other_end")) & (F.col("end") >= F.col("other_start")))
    return both.filter(F.col("__bin") == F.floor(F.greatest("start", "other_start") / width)).drop("__k", "__b", "__bin")


#: First characters of a text by which texts that hold it are found.
HEAD_CHARS = 12


def _holds(outer: DataFrame, inner: DataFrame, key: str) -> DataFrame:
    """(outer, inner) ids of texts of one document of which the first holds the second; both: key, id, text.

    A text is found by its first characters, a shorter one by all of it: an outer text has a row for
    each of its distinct pieces of the lengths that occur, at most HEAD_CHARS of them.
    """
    size = F.least(F.length("text"), F.lit(HEAD_CHARS))
    asked = inner.filter("text <> ''").select(key, F.col("id").alias("inner"), F.col("text").alias("__in"), size.alias("__size"), F.substring("text", F.lit(1), size).alias("__head"))
    sizes = asked.groupBy(key).agg(F.collect_set("__size").alias("__sizes"))  # HEAD_CHARS sizes at most
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substring("text", i, n))
    whole = outer.filter("text <> ''").join(sizes, key).select(key, F.col("id").alias("outer"), "text", F.explode("__sizes").alias("__size")).filter(F.length("text") >= F.col("__size"))
    cut = whole.select(key, "outer", "text", "__size", F.explode(F.array_distinct(pieces(F.col("__size")))).alias("__head"))
    return cut.join(asked, [key, "__size", "__head"]).filter(F.contains("text", "__in")).select("outer", "inner")


def matches_gold(candidates: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """(candidate_id, gold_id): by overlapping lines, by id, or because one text holds the other; all within a document.

    candidates: key, candidate_id, start, end, text; gold: key, gold_id, start, end, text.
    The three ways are three joins: by bins of lines, by id, and for texts by the document and
    the first characters of the text that is held, which the other must have somewhere.
    """
    lines_ = overlaps(candidates.select(key, "candidate_id", "start", "end"), gold.select(key, "gold_id", "start", "end"), key, 64).select("candidate_id", F.col("other_gold_id").alias("gold_id"))
    ids = candidates.join(gold.select(key, F.col("gold_id").alias("candidate_id")), [key, "candidate_id"]).select("candidate_id", F.col("candidate_id").alias("gold_id"))
    c, g = candidates.select(key, F.col("candidate_id").alias("id"), "text"), gold.select(key, F.col("gold_id").alias("id"), "text")
    held = _holds(c, g, key).select(F.col("outer").alias("candidate_id"), F.col("inner").alias("gold_id")).unionByName(_holds(g, c, key).select(F.col("inner").alias("candidate_id"), F.col("outer").alias("gold_id")))
    return lines_.unionByName(ids).unionByName(held).distinct()


def nearby(blocks: DataFrame, tables: DataFrame, keys: list[str], gap: int = LINE_GAP, most: int = MOST_LINKS) -> DataFrame:
    """Blocks with the tables of their section at most ``gap`` lines away, the first ``most`` in order."""
    t = tables.select(*keys, "table_id", F.col("start").alias("ts"), F.col("end").alias("te"))
    near = F.least(F.abs(F.col("start") - F.col("te")), F.abs(F.col("ts") - F.col("end"))) <= gap
    joined = blocks.join(t, keys).filter(near | ((F.col("start") <= F.col("te")) & (F.col("end") >= F.col("ts"))))
    own = joined.groupBy(*keys, "block_id").agg(F.array_sort(F.collect_set(F.struct("ts", "table_id"))).alias("t"))
    return own.select(*keys, "block_id", F.slice(F.transform("t", lambda x: x["table_id"]), 1, most).alias("table_ids"))


def token_windows(documents: DataFrame, key: str, tokens: Column, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` tokens that share ``overlap`` with the next; the last may be nothing but overlap."""
    step = size - overlap if size > overlap else size
    rows = documents.select(key, tokens.alias("t")).filter(F.size("t") > 0)
    starts = F.when(F.size("t") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("t") - 1, F.lit(step)))
    cut = rows.select(key, "t", F.posexplode(starts).alias("window", "at"))
    return cut.select(key, "window", "at", F.slice("t", F.col("at") + 1, F.lit(size)).alias("tokens"))


def overlap_tail(chunks: DataFrame, key: str, order: str, content: str, n: int) -> DataFrame:
    """Each chunk with the last ``n`` characters of the one before it in front."""
    tail = F.right(F.lag(content).over(Window.partitionBy(key).orderBy(order)), F.lit(n))
    return chunks.withColumn("with_overlap", F.concat(F.coalesce(tail, F.lit("")), content))


def outline(text: str) -> list[tuple[int, str, int]]:
    """(level, title, position) of Markdown headings."""
    return [(len(m[1]), m[2], m.start()) for m in _HEADING.finditer(text)]


def sections(text: str) -> list[tuple[list[str], str]]:
    """(heading path, content) of each section; what stands before the first heading has no path."""
    heads, out, path = outline(text), [], []
    front = text[: heads[0][2]] if heads else text
    if front.strip():
        out.append(([], front.strip()))
    for i, (level, title, at) in enumerate(heads):
        path = [(lv, t) for lv, t in path if lv < level] + [(level, title)]
        end = heads[i + 1][2] if i + 1 < len(heads) else len(text)
        body = text[at:end].partition("\n")[2].strip()
        out.append(([t for _, t in path], body))
    return out


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.findall(text) if s.strip()]


def pack(text: str, most: int) -> list[str]:
    """Chunks of at most ``most`` characters: paragraphs are joined, long ones split at sentences, long sentences cut."""
    pieces: list[tuple[str, str]] = []  # (text, what joins it to the piece before)
    for paragraph in re.split(r"\n\n+", text):
        if len(paragraph) <= most:
            pieces.append((paragraph, "\n\n"))
            continue
        for k, s in enumerate(_SENTENCE.findall(paragraph) or [paragraph]):
            for i in range(0, len(s), most):
                pieces.append((s[i : i + most], "\n\n" if k == i == 0 else ""))
    out: list[str] = []
    for piece, glue in pieces:
        if out and len(out[-1]) + len(glue) + len(piece) <= most:
            out[-1] += glue + piece
        else:
            out.append(piece)
    return [x for x in out if x.strip()]


def merge_small(chunks: list[tuple[list[str], str]], least: int, most: int) -> list[tuple[list[str], str]]:
    """Small sections join the one before them while both fit."""
    out: list[tuple[list[str], str]] = []
    for path, content in chunks:
        if out and (len(content) < least or len(out[-1][1]) < least) and len(out[-1][1]) + 2 + len(content) <= most:
            out[-1] = (out[-1][0], f"{out[-1][1]}\n\n{content}" if content else out[-1][1])
        else:
            out.append((path, content))
    return out


CHUNK_SCHEMA = "document_id string, chunk_index int, heading_path array<string>, content string, n_chars int"
_CHUNK_ARROW = pa.schema([("document_id", pa.string()), ("chunk_index", pa.int32()), ("heading_path", pa.list_(pa.string())), ("content", pa.string()), ("n_chars", pa.int32())])


def markdown_chunks(documents: DataFrame, document_id: str, text: str, least: int = 200, most: int = 1200) -> DataFrame:
    """Heading-aware chunks: sections, packed to ``most`` characters, small ones merged."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = [(path, c) for path, content in sections(body or "") for c in (pack(content, most) or [""])]
                for k, (path, content) in enumerate(c for c in merge_small(parts, least, most) if c[1]):
                    out.append({"document_id": doc, "chunk_index": k, "heading_path": path, "content": content, "n_chars": len(content)})
            yield pa.RecordBatch.from_pylist(out, schema=_CHUNK_ARROW)

    return documents.select(documents[document_id].cast("string"), text).mapInArrow(run, CHUNK_SCHEMA)


def retrieval_units(documents: DataFrame, document_id: str, text: str, target: int = 900, most: int = 1800) -> DataFrame:
    """Units of about ``target`` characters that never cross a heading or a table; a longer paragraph is cut at ``most``.

    What stands in a table is no part of any unit.
    """

    def run(batches):
        for batch in batches:
            out = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k = 0
                for path, content in ((path, part) for path, whole in sections(body or "") for part in _TABLE_SPAN.split(whole)):
                    unit = ""
                    for piece in pack(content, most):
                        if unit and len(unit) + 2 + len(piece) > target:
                            out.append({"document_id": doc, "chunk_index": k, "heading_path": path, "content": unit, "n_chars": len(unit)})
                            k, unit = k + 1, ""
                        unit = f"{unit}\n\n{piece}" if unit else piece
                    if unit:
                        out.append({"document_id": doc, "chunk_index": k, "heading_path": path, "content": unit, "n_chars": len(unit)})
                        k += 1
            yield pa.RecordBatch.from_pylist(out, schema=_CHUNK_ARROW)

    return documents.select(documents[document_id].cast("string"), text).mapInArrow(run, CHUNK_SCHEMA)


def _rare_grams(rows: DataFrame, counts: DataFrame, size: int, most: Column) -> DataFrame:
    """(name, rare): the first ``most`` distinct grams of each name, ordered from rare to frequent."""
    own = rows.select("name", F.explode(_padded_grams("name", size)).alias("gram")).join(counts, "gram", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")))
    return own.groupBy("name").agg(order.alias("o")).select("name", F.transform(F.slice("o", F.lit(1), most), lambda x: x["gram"]).alias("rare"))


def _padded_grams(name: str, size: int) -> Column:
    """Distinct grams with a pad in front, and one behind for pairs: one more than characters if all differ."""
    padded = F.concat(F.lit("\x02"), name, F.lit("\x03" if size == 2 else ""))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.length(name)), lambda i: F.substring(padded, i + 1, F.lit(size))))


def fuzzy_match(names: DataFrame, known: DataFrame, cutoff: float = 0.85) -> DataFrame:
    """Names with their most alike known name, as difflib.get_close_matches(name, known, 1, cutoff) finds it.

    The candidates are exact. A ratio of at least c between names of a and b characters needs M >= c (a + b) / 2 matched
    ones. In padded names the a + b - 2M others break at most a + 1 - T of the pairs of neighbours, T = 3M - (a + b) + 1;
    below c = 2/3 that may be none, and T = M + 1 holds for single characters. So of the distinct grams of a name all but
    a + 1 - T are in the other, and the rarest gram that both have is among the rarest a + 2 - T of either. T is least for
    the shortest possible partner, of c / (2 - c) a characters. Pairs that share such a gram are compared, each once.
    """
    slack = 1e-9

    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        matcher, out = difflib.SequenceMatcher(), []
        for name, match in zip(a, b):
            if matcher.b != name:
                matcher.set_seq2(name)
            matcher.set_seq1(match)
            close = matcher.real_quick_ratio() >= cutoff and matcher.quick_ratio() >= cutoff
            out.append(matcher.ratio() if close else None)
        return pd.Series(out, dtype="float64")

    score = F.pandas_udf(ratios, "double")
    size, share = (2, (3 * cutoff - 2) / (2 - cutoff)) if cutoff >= 2 / 3 else (1, cutoff / (2 - cutoff))
    most = (F.floor(F.length("name") * (1 - share) + slack) + 1).cast("int")
    names, known = (rows.select("name").filter("name IS NOT NULL").distinct() for rows in (names, known))
    counts = known.select(F.explode(_padded_grams("name", size)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    a = _rare_grams(names, counts, size, most).select("name", "rare", F.explode("rare").alias("gram"))
    b = _rare_grams(known, counts, size, most).select(F.col("name").alias("match"), F.col("rare").alias("match_rare"), F.explode("rare").alias("gram"))
    long_enough = 2 * F.least(F.length("name"), F.length("match")) >= (cutoff - slack) * (F.length("name") + F.length("match"))
    pairs = a.join(b, "gram").filter(long_enough & (F.get(F.array_intersect("rare", "match_rare"), F.lit(0)) == F.col("gram")))
    scored = pairs.select("name", "match", score("name", "match").alias("ratio")).filter(F.col("ratio") >= cutoff)
    return scored.groupBy("name").agg(F.max_by(F.struct("match", "ratio"), F.struct("ratio", "match")).alias("m")).select("name", "m.match", "m.ratio")


# --- text around tables -------------------------------------------------------------------------

ATOM_SCHEMA = "document_id string, atom_index int, atom_id string, content string, char_start int, char_end int, byte_start int, byte_end int, line_start int, line_end int, heading_path array<string>, content_sha256 string"
_ATOM_ARROW = pa.schema(
    [("document_id", pa.string()), ("atom_index", pa.int32()), ("atom_id", pa.string()), ("content", pa.string()), *[(n, pa.int32()) for n in ("char_start", "char_end", "byte_start", "byte_end", "line_start", "line_end")], ("heading_path", pa.list_(pa.string())), ("content_sha256", pa.string())]
)
_TABLE_SPAN = re.compile(r"<\s*table\b.*?<\s*/\s*table\s*>", re.S | re.I)
_PARAGRAPH = re.compile(r"\S[^\n]*(?:\n[^\S\n]*\S[^\n]*)*")


def atoms(text: str) -> list[dict]:
    """The paragraphs of a text outside its tables and headings, with character, byte and line ranges.

    A paragraph is a run of lines that are not blank; a heading line ends one and is none. A table ends one too.
    """
    out: list[dict] = []
    path: list[tuple[int, str]] = []
    at, byte, line = 0, 0, 1

    def advance(to: int) -> tuple[int, int]:
        nonlocal at, byte, line
        byte += len(text[at:to].encode("utf-8", "surrogatepass"))
        line += text.count("\n", at, to)
        at = to
        return byte, line

    spans = [*[(m.start(), m.end()) for m in _TABLE_SPAN.finditer(text)], (len(text), len(text))]
    begin = 0
    for table_start, table_end in spans:
        for m in _PARAGRAPH.finditer(text, begin, table_start):
            start = m.start()
            for part in re.split(r"(?<=\n)", m[0]):
                stop = start + len(part)
                if (h := _HEADING.match(part.rstrip("\n"))) is not None:
                    path = [x for x in path if x[0] < len(h[1])] + [(len(h[1]), h[2])]
                elif out and out[-1]["char_end"] == start and out[-1]["open"]:
                    out[-1]["char_end"] = stop
                    start = stop
                    continue
                else:
                    out.append({"char_start": start, "char_end": stop, "open": True, "heading_path": [t for _, t in path]})
                    start = stop
                    continue
                if out:
                    out[-1]["open"] = False
                start = stop
            if out:
                out[-1]["open"] = False
        begin = table_end
    for x in out:
        content = text[x["char_start"] : x["char_end"]].rstrip()
        x["char_end"] = x["char_start"] + len(content)
        x["content"] = content
        x["byte_start"], x["line_start"] = advance(x["char_start"])
        x["byte_end"], x["line_end"] = advance(x["char_end"])
        del x["open"]
    return out


def text_atoms(documents: DataFrame, document_id: str, text: str) -> DataFrame:
    """The atoms of each document with ids from their document, place and content. Documents are read one by one."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, x in enumerate(atoms(body or "")):
                    digest = hashlib.sha256(x["content"].encode("utf-8", "surrogatepass")).hexdigest()
                    name = hashlib.sha256(f"{doc}|{x['char_start']}|{digest}".encode()).hexdigest()[:20]
                    out.append({**x, "document_id": doc, "atom_index": k, "atom_id": f"atom_{name}", "content_sha256": digest})
            yield pa.RecordBatch.from_pylist(out, schema=_ATOM_ARROW)

    return documents.select(documents[document_id].cast("string"), text).mapInArrow(run, ATOM_SCHEMA)


def text_blocks(atom_rows: DataFrame, most: int) -> DataFrame:
    """Atoms cut into blocks of at most ``most`` characters: document_id, atom_id, block, content."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("content"), F.lit(1)), F.lit(most))
    cut = atom_rows.select("document_id", "atom_id", "content", F.posexplode(starts).alias("block", "at"))
    return cut.select("document_id", "atom_id", "block", F.substring("content", F.col("at"), F.lit(most)).alias("content"))


def project_atoms(units: DataFrame, atom_rows: DataFrame) -> DataFrame:
    """Units (unit_id, document_id, array atom_ids) with their atoms' contents in order; ``missing`` counts ids that the document does not have.

    One row per unit, whether or not its id is there twice: contents are put together once for each
    list of a document, and units take those of their list.
    """
    lists = units.select("document_id", "atom_ids").distinct()
    parts = lists.select("document_id", "atom_ids", F.posexplode("atom_ids").alias("at", "atom_id"))
    met = parts.join(atom_rows.select("atom_id", "document_id", "content"), ["atom_id", "document_id"], "left")
    own = met.groupBy("document_id", "atom_ids").agg(F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("at", "content")))).alias("a"), F.count_if(F.col("content").isNull()).alias("missing"))
    own = own.select(F.col("document_id").alias("__d"), F.col("atom_ids").alias("__a"), F.transform("a", lambda x: x["content"]).alias("contents"), "missing")
    return units.join(own, F.col("document_id").eqNullSafe(F.col("__d")) & (F.col("atom_ids") == F.col("__a"))).select("unit_id", "document_id", "contents", "missing")


def align_chunks(chunks: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Chunks with their only place in the source, white space aside: ``aligned`` with start and end, ``missing`` or ``ambiguous``.

    chunks: key, chunk_id, content; documents: key, text. Places are in the text without white space.
    """
    bare = lambda c: F.regexp_replace(F.col(c), r"(?U)\s+", "")
    both = chunks.select(key, "chunk_id", bare("content").alias("c")).join(documents.select(key, bare("text").alias("t")), key, "left")
    first = F.expr("locate(c, coalesce(t, ''))")
    second = F.expr("locate(c, coalesce(t, ''), locate(c, coalesce(t, '')) + 1)")
    status = F.when((F.col("c") == "") | (first == 0), "missing").when(second > 0, "ambiguous").otherwise("aligned")
    start = F.when(status == "aligned", first - 1)
    return both.select(key, "chunk_id", status.alias("status"), start.alias("start"), (start + F.length("c")).alias("end"))
