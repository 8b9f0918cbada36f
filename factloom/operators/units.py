"""Atoms of Markdown documents and the retrieval units packed from them, by windows over lines; tables part both.

A document is dealt into lines once, with offsets in characters, and shuffled once; what follows are windows in the order of its
lines and groups inside a document, then a fold over the atoms of a section. No document stands whole in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A complete table, a heading, a line of a list; characters that a unit should have and may have.
TABLE = r"(?is)<\s*table\b.*?<\s*/\s*table\s*>"
HEADING = r"(?s)^\s{0,3}(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*\z"
LIST_LINE = r"^\s*(?:[-+*][ \t]+|\d{1,3}[.)、][ \t]*|[（(]?[一二三四五六七八九十]+[)）、.．][ \t]*)"
TARGET, MOST = 900, 1800


def marked_lines(documents: DataFrame, key: str, text: str) -> DataFrame:
    """The lines outside tables of each document, in one shuffle; all windows and groups after it keep its partitions and order.

    Gives key, part (tables before it), i (from 0 in its part), content, start and end (characters), kind (blank, heading, list, paragraph),
    segment (tables and headings before it, itself included), heading_path, run (atoms begun so far: consecutive lines of one kind in
    one part are an atom, a heading one of its own) and beside: struct<first, last, start, end, table>, the atoms at both ends of its part,
    where the part lies and whether a table follows it. Null texts are empty and give one blank line.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    pieces = F.transform(F.split(body, TABLE, -1), lambda p: F.split(p, "\n", -1))
    parts = documents.select(key, text).repartition(key).select(F.col(key), F.posexplode(F.arrays_zip(pieces.alias("lines"), F.regexp_extract_all(body, F.lit(f"({TABLE})"), F.lit(1)).alias("table"))).alias("part", "p"))
    rows = parts.select(key, "part", F.coalesce(F.length("p.table"), F.lit(0)).alias("__table"), (F.size("p.lines") - 1).alias("__last"), F.posexplode("p.lines").alias("i", "content"))
    rows = rows.withColumn("__span", F.length("content") + F.when(F.col("i") == F.col("__last"), F.col("__table")).otherwise(1))
    kind = F.when(~F.col("content").rlike(r"(?U)\S"), "blank").when(F.col("content").rlike(HEADING), "heading").when(F.col("content").rlike(LIST_LINE), "list").otherwise("paragraph")
    rows = rows.withColumn("kind", kind)
    order = Window.partitionBy(key).orderBy("part", "i")
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key, "part").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.col("kind") == "heading"
    level = F.when(head, F.length(F.regexp_extract("content", HEADING, 1)))
    title = F.when(head, F.regexp_replace(F.regexp_extract("content", HEADING, 2), r"(?U)^\s+|\s+$", ""))
    begins = (F.col("kind") != "blank") & (head | ~F.lag("kind").over(order).eqNullSafe(F.col("kind")) | ~F.lag("part").over(order).eqNullSafe(F.col("part")))
    rows = rows.withColumns({"start": F.sum("__span").over(upto) - F.col("__span"), "__begins": begins, "__level": level, "__title": title})
    # Level k is open if no heading of a level up to k came after it.
    at = F.struct("part", "i")
    for k in range(1, 7):
        rows = rows.withColumn(f"__h{k}", F.last(F.when(F.col("__level") <= k, F.struct(at.alias("at"), F.when(F.col("__level") == k, F.col("__title")).alias("t"))), ignorenulls=True).over(upto))
    rows = rows.withColumns({"heading_path": F.array_compact(F.array(*[F.col(f"__h{k}.t") for k in range(1, 7)])), "end": F.col("start") + F.length("content"), "segment": F.col("part") + F.sum(head.cast("int")).over(upto), "run": F.sum(F.col("__begins").cast("int")).over(upto)})
    atom = F.when(F.col("kind") != "blank", F.col("run"))
    ends = F.struct(F.min(atom).over(whole).alias("first"), F.max(atom).over(whole).alias("last"), F.min("start").over(whole).alias("start"), F.max("end").over(whole).alias("end"), (F.col("__table") > 0).alias("table"))
    return rows.withColumn("beside", ends).select(key, "part", "i", "content", "start", "end", "kind", "segment", "heading_path", "run", "beside")


def _joined(lines: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(lines), lambda x: x["content"]), "\n")


def atoms_of(lines: DataFrame, key: str) -> DataFrame:
    """key, atom (from 1), kind, segment, heading_path, start, end, content, gap, and ``tables``: struct<table, relation, distance> of tables beside it.

    ``gap`` holds the blank lines that follow in the same section, each behind its line break. A table lies beside an atom that comes
    right before or after it; a heading or another table between them parts them, and headings themselves have none. Tables are
    numbered from 0.
    """
    filled, line = F.col("kind") != "blank", F.struct("i", "content")
    own = lines.groupBy(key, "segment", F.col("run").alias("atom")).agg(
        F.min(F.when(filled, F.col("kind"))).alias("kind"), F.first("part").alias("__part"), F.first("beside").alias("__beside"), F.first("heading_path").alias("heading_path"), F.min(F.when(filled, F.col("start"))).alias("start"), F.max(F.when(filled, F.col("end"))).alias("end"),
        _joined(F.collect_list(F.when(filled, line))).alias("content"), F.array_sort(F.collect_list(F.when(~filled, line))).alias("gap"),
    )
    own = own.filter("kind IS NOT NULL")
    at, b = F.col("__part"), F.col("__beside")

    def note(here: Column, number: Column, relation: str, distance: Column) -> Column:
        return F.when(here & (F.col("kind") != "heading"), F.struct(number.alias("table"), F.lit(relation).alias("relation"), distance.alias("distance")))

    found = F.array_compact(F.array(note((at > 0) & (F.col("atom") == b["first"]), at - 1, "after", F.col("start") - b["start"]), note(b["table"] & (F.col("atom") == b["last"]), at, "before", b["end"] - F.col("end"))))
    gap = F.array_join(F.transform("gap", lambda x: F.concat(F.lit("\n"), x["content"])), "")
    return own.withColumns({"tables": found, "gap": gap}).drop("__part", "__beside")


def _unit_starts(atoms: Column, target: int, most: int) -> Column:
    """array<int>: the places of atoms, from 1, that begin a unit.

    Atoms of a section join the open unit; it closes once it spans ``target`` characters, and before an atom that would
    carry it past ``most``.
    """
    none = F.lit(-1).cast("long")
    begin = F.struct(none.alias("open"), F.lit(1).alias("n"), F.array().cast("array<int>").alias("cuts"))

    def step(state: Column, x: Column) -> Column:
        fits = (state["open"] >= 0) & (x["end"] - state["open"] <= most)
        first = F.when(fits, state["open"]).otherwise(x["start"])
        return F.struct(F.when(x["end"] - first >= target, none).otherwise(first).alias("open"), (state["n"] + 1).alias("n"), F.when(fits, state["cuts"]).otherwise(F.concat(state["cuts"], F.array(state["n"]))).alias("cuts"))

    return F.aggregate(atoms, begin, step)["cuts"]


def packed_units(documents: DataFrame, key: str, text: str, target: int = TARGET, most: int = MOST) -> DataFrame:
    """Retrieval units: whole atoms of one section between tables, about ``target`` characters, an atom longer than ``most`` alone.

    Gives key, unit (from 1 in a document), segment, heading_path, kinds, atoms (their numbers), start, end, content (as it stands in the
    text), oversize and tables (numbers of tables beside its atoms). Documents without text have no unit; headings are in none.
    Sections are folded as arrays of their atoms; the text of a document crosses one shuffle.
    """
    if not 1 <= target <= most:
        raise ValueError("a unit's target lies between 1 and its most characters")
    atoms = atoms_of(marked_lines(documents, key, text), key).filter("kind <> 'heading'")
    own = atoms.groupBy(key, "segment").agg(F.first("heading_path").alias("heading_path"), F.array_sort(F.collect_list(F.struct("start", "end", "atom", "kind", "content", "gap", F.transform("tables", lambda t: t["table"]).alias("tables")))).alias("__a"))
    own = own.withColumn("__cuts", _unit_starts(F.col("__a"), target, most))

    def unit(cut: Column, k: Column) -> Column:
        n = F.coalesce(F.get("__cuts", k + 1), F.size("__a") + 1) - cut
        return F.slice("__a", cut, n)

    def told(x: Column) -> Column:
        final = F.element_at(x, -1)
        ahead = F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda a: F.concat(a["content"], a["gap"]))
        return F.struct(
            F.array_sort(F.array_distinct(F.transform(x, lambda a: a["kind"]))).alias("kinds"), F.transform(x, lambda a: a["atom"]).alias("atoms"), x[0]["start"].alias("start"), final["end"].alias("end"),
            F.array_join(F.concat(ahead, F.array(final["content"])), "\n").alias("content"), ((F.size(x) == 1) & (final["end"] - x[0]["start"] > most)).alias("oversize"), F.array_sort(F.array_distinct(F.flatten(F.transform(x, lambda a: a["tables"])))).alias("tables"),
        )

    out = own.select(key, "segment", "heading_path", F.explode(F.transform(F.transform("__cuts", unit), told)).alias("u"))
    return out.select(key, F.row_number().over(Window.partitionBy(key).orderBy("u.start")).alias("unit"), "segment", "heading_path", "u.*")
