"""Fragments of evidence made of tables: metric candidates, row and narrative fragments, their order, variants of their text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.labels import metric_of_label, row_before_column
from factloom.functions.numbers import normalise_number
from factloom.operators.years import STATEMENTS, resolve_year

#: Narratives shorter than this, or nothing but one of these, are no evidence.
LEAST_NARRATIVE = 20
TRIVIAL = "^(?:不适用|适用|无|是|否|√适用□不适用|□适用√不适用)[。.]?$"


def metric_candidates(cells: DataFrame, aliases: dict[str, str], patterns: dict[str, str]) -> DataFrame:
    """Data cells that name a metric in their row or column, with its value, unit and year.

    cells: document_id, table_index, row_index, col_index, cell_role, row_label, column_label,
    raw_value, unit_hint, report_year. The row's metric decides; another one in the column is noted.
    """
    label = {side: metric_of_label(F.col(f"{side}_label"), aliases, patterns) for side in ("row", "column")}
    out = cells.filter("cell_role = 'data'").withColumns({"__row": label["row"], "__column": label["column"]})
    out = out.withColumn("__m", row_before_column(F.col("__row.metric"), F.col("__column.metric"))).filter("__m.metric IS NOT NULL")
    out = out.withColumns({"__v": normalise_number(F.col("raw_value"), F.col("row_label"), F.col("column_label"), F.col("unit_hint")), "__y": resolve_year(F.col("__m.metric"), F.col("__m.source"), F.col("row_label"), F.col("column_label"), F.col("report_year"))})
    statement = F.create_map(*[F.lit(x) for kv in STATEMENTS.items() for x in kv])[F.col("__m.metric")]
    key = F.concat_ws("|", "document_id", *[F.col(c).cast("string") for c in ("table_index", "row_index", "col_index")])
    return out.select(
        F.concat(F.lit("cand_"), F.substring(F.sha2(key, 256), 1, 20)).alias("candidate_id"), "document_id", "table_index", "row_index", "col_index", F.col("__m.metric").alias("canonical_metric"), statement.alias("statement"),
        F.col("__m.source").alias("metric_source"), F.when(F.col("__m.source") == "row_label", F.col("__row.match")).otherwise(F.col("__column.match")).alias("metric_match_type"), F.col("__m.conflict").alias("metric_conflict"),
        F.col("__v.status").alias("value_status"), F.col("__v.value").alias("normalized_value"), F.col("__v.unit").alias("normalized_unit"), F.col("__v.unit_source").alias("unit_source"),
        "report_year", F.col("__y.metric_year").alias("metric_year"), F.col("__y.year_confidence").alias("year_confidence"), F.col("__y.error").alias("year_error"),
    )


def row_fragments(cells: DataFrame) -> DataFrame:
    """One fragment a table row: its display text, its cells' labels and values in column order, and its id from all of these."""
    part = F.struct("col_index", "column_label", "raw_value")
    own = cells.filter("cell_role = 'data'").groupBy("document_id", "table_index", "row_index", "row_label").agg(F.array_sort(F.collect_list(part)).alias("c"))
    text = F.concat("row_label", F.lit(": "), F.array_join(F.transform("c", lambda x: F.concat(x["column_label"], F.lit("="), x["raw_value"])), "; "))
    return _fragment(own.select("document_id", "table_index", F.col("row_index").alias("line"), "row_label", F.transform("c", lambda x: x["raw_value"]).alias("values"), text.alias("retrieval_text")), "table_row")


def narrative_fragments(blocks: DataFrame) -> DataFrame:
    """Text blocks next to a table that say something: document_id, table_index, line, content, section_path."""
    plain = F.trim(F.regexp_replace("content", r"(?U)\s+", " "))
    said = F.length(F.regexp_replace(plain, r"(?U)[\s\W_]+", "")) >= LEAST_NARRATIVE
    heading = F.coalesce(plain == F.trim(F.element_at(F.concat(F.array(F.lit("")), F.coalesce("section_path", F.array().cast("array<string>"))), -1)), F.lit(False))
    good = said & ~plain.rlike(TRIVIAL) & ~heading & ~F.lower(plain).rlike("</?table")
    return _fragment(blocks.filter(good).select("document_id", "table_index", "line", F.lit("").alias("row_label"), F.array().cast("array<string>").alias("values"), plain.alias("retrieval_text")), "mixed_narrative")


def _fragment(rows: DataFrame, kind: str) -> DataFrame:
    key = F.concat_ws("|", F.lit(kind), "document_id", F.col("table_index").cast("string"), F.col("line").cast("string"), "retrieval_text")
    return rows.withColumns({"kind": F.lit(kind), "fragment_id": F.concat(F.lit("frag_"), F.substring(F.sha2(key, 256), 1, 20))})


def fragment_order() -> list[Column]:
    """By document and table, rows before narratives, then by row or first line and id."""
    return [F.col("document_id"), F.col("table_index"), F.when(F.col("kind") == "table_row", 0).otherwise(1), F.col("line"), F.col("fragment_id")]


def merged(*streams: DataFrame) -> DataFrame:
    """All fragments in one order."""
    return reduce(DataFrame.unionByName, streams).orderBy(*fragment_order())


def hydrate(candidates: DataFrame, fragments: DataFrame) -> DataFrame:
    """Candidates (fragment_id, document_id) with their whole fragment; ``state`` is found, unknown or foreign (of another document)."""
    own = fragments.withColumnRenamed("document_id", "__doc")
    out = candidates.join(own, "fragment_id", "left")
    state = F.when(F.col("__doc").isNull(), "unknown").when(F.col("__doc") != F.col("document_id"), "foreign").otherwise("found")
    return out.withColumn("state", state).withColumn("retrieval_text", F.when(state == "found", F.col("retrieval_text"))).drop("__doc")


def variant_text(ablations: frozenset[str]) -> Column:
    """The searched text of a table row under ablations: flat as of old, without levels of headers, row hierarchies, or unit, period and scope."""
    if "legacy_flattened_a0" in ablations:
        return F.coalesce(F.nullif("legacy_flat_text", F.lit("")), "search_text", F.lit(""))
    parts = ["base_search_text", "value_search_text", "own_row_header_text", "single_header_text" if "no_multilevel_headers" in ablations else "multilevel_header_text"]
    parts += [] if "no_hierarchical_rows" in ablations else ["hierarchical_row_text"]
    parts += [] if "no_unit_period_scope" in ablations else ["semantic_search_text"]
    return F.array_join(F.filter(F.array(*[F.coalesce(F.col(p), F.lit("")) for p in parts]), lambda x: x != ""), " ")
