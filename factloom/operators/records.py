"""Public rows of facts and evidence: projection, assertions about rows, stripping, catalogue and channel filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The fields of a public fact record, in order.
FACT_RECORD = (
    "fact_id", "document_id", "stock_code", "company", "report_year", "metric_year", "canonical_metric", "normalized_value", "normalized_unit", "statement", "confidence_score", "source_table_id", "line_range",
)


def fact_records(facts: DataFrame) -> DataFrame:
    """Public records: the company by its short name or else its full one, the value as text."""
    company = F.coalesce(F.nullif("stock_name", F.lit("")), F.col("company_full"))
    rows = facts.withColumns({"company": company, "normalized_value": F.coalesce("normalized_value_text", F.col("normalized_value").cast("string"))})
    return rows.select(*FACT_RECORD)


def record_violations(records: DataFrame, allowed: dict[str, list], unit: str) -> DataFrame:
    """One row: how many records break each rule that holds after a scan: inside the allow list, ids unique, one unit, values decimal."""
    outside = F.lit(False)
    for column, values in allowed.items():
        if values:
            outside = outside | ~F.coalesce(F.col(column).isin(values), F.lit(False))
    number = F.col("normalized_value").cast("string").rlike(r"^-?\d+(\.\d+)?$")
    return records.agg(
        F.count_if(outside).alias("outside"), (F.count("fact_id") - F.countDistinct("fact_id")).alias("repeated_ids"), F.count_if(F.col("normalized_unit") != unit).alias("other_unit"), F.count_if(~F.coalesce(number, F.lit(False))).alias("no_decimal"),
    )


def record_shape(records: DataFrame, optional: tuple[str, ...] = ("line_range",)) -> Column:
    """The first field of a record that is null though it may not be, or null."""
    return F.coalesce(*[F.when(F.col(c).isNull(), c) for c in records.columns if c not in optional])


def forbidden_fields(schema: T.DataType, names: frozenset[str], path: str = "") -> list[str]:
    """Where a schema, at any depth, has a field whose name gives an annotation away."""
    if isinstance(schema, T.StructType):
        return [x for f in schema.fields for x in ([f"{path}{f.name}"] if f.name.lower() in names else []) + forbidden_fields(f.dataType, names, f"{path}{f.name}.")]
    if isinstance(schema, T.ArrayType):
        return forbidden_fields(schema.elementType, names, path)
    if isinstance(schema, T.MapType):
        return forbidden_fields(schema.valueType, names, path)
    return []


def _without(column: Column, kind: T.DataType, raw: tuple[str, ...]) -> Column | None:
    """A column without fields of these names at any depth of structs and arrays; None where nothing is left."""
    if isinstance(kind, T.StructType):
        left = [(f.name, x) for f in kind.fields if f.name not in raw and (x := _without(column[f.name], f.dataType, raw)) is not None]
        return F.when(column.isNotNull(), F.struct(*[x.alias(n) for n, x in left])) if left else None
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        if _without(F.lit(None), kind.elementType, raw) is None:
            return None
        return F.transform(column, lambda x: _without(x, kind.elementType, raw))
    return column


def portable(rows: DataFrame, raw: tuple[str, ...]) -> DataFrame:
    """Without raw contents: columns and fields of these names go, at any depth."""
    out = [(f.name, _without(F.col(f"`{f.name}`"), f.dataType, raw)) for f in rows.schema.fields if f.name not in raw]
    return rows.select(*[c.alias(n) for n, c in out if c is not None])


def catalog(rows: DataFrame, search: Column, needle: str | None = None, year: int | None = None) -> DataFrame:
    """Catalogue entries whose normalised text holds ``needle`` and whose report year is ``year``, where these are given."""
    if needle and needle.strip():
        rows = rows.filter(F.contains(F.lower(F.regexp_replace(search, r"(?U)\s+", "")), F.lit("".join(needle.split()).lower())))
    return rows if year is None else rows.filter(F.col("report_year") == year)


def channel(rows: DataFrame, group: str, matches: Column) -> DataFrame:
    """Rows of each group that belong to a channel, or all of the group where none does."""
    any_ = F.max(matches.cast("int")).over(Window.partitionBy(group))
    return rows.withColumns({"__any": any_, "__m": matches}).filter((F.col("__any") == 0) | F.col("__m")).drop("__any", "__m")


def in_plan_order(results: DataFrame, plan: list[str] | DataFrame, key: str) -> DataFrame:
    """Results with their place in a plan; ids of the plan without a result and results outside it are kept apart by ``state``.

    ``plan``: ids in order, or a table of place and ``key``.
    """
    order = results.sparkSession.createDataFrame(list(enumerate(plan)), f"place long, {key} string") if isinstance(plan, list) else plan.select("place", key)
    out = order.join(results, key, "full_outer")
    present = F.lit(True) if not [c for c in results.columns if c != key] else F.coalesce(*[F.col(c).isNotNull() for c in results.columns if c != key])
    return out.withColumn("state", F.when(F.col("place").isNull(), "unplanned").when(present, "found").otherwise("missing"))
