"""Fact queries: lookups with cardinality, allow-listed scans, rank, aggregate, coverage, supplements, gaps."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The six columns that filters may name, by filter field.
FILTER_COLUMNS = {"document_ids": "document_id", "stock_codes": "stock_code", "report_years": "report_year", "metric_years": "metric_year", "canonical_metrics": "canonical_metric", "normalized_units": "normalized_unit"}
IDENTITY = ["document_id", "stock_code", "report_year", "metric_year", "canonical_metric", "normalized_unit"]
RANK_TIES = ["stock_code", "document_id", "fact_id"]
#: Limits of a query specification.
MOST_RANKED, FIRST_YEAR, LAST_YEAR = 5, 1900, 2200
_UNSAFE = re.compile(r";|--|/\*|\b(?:select|insert|update|delete|drop|alter|attach|copy|pragma|union)\b", re.I)


def allow_list(rows: DataFrame, filters: dict[str, list]) -> DataFrame:
    """Conjunction of IN lists; an empty or missing list sets no condition, an unknown field is an error."""
    unknown = set(filters) - set(FILTER_COLUMNS)
    if unknown:
        raise ValueError(f"unknown filter fields: {sorted(unknown)}")
    conditions = [F.col(FILTER_COLUMNS[k]).isin(list(v)) for k, v in filters.items() if v]
    return rows.filter(reduce(Column.__and__, conditions)) if conditions else rows


def validate_filters(filters: dict[str, list]) -> None:
    for k, v in filters.items():
        if k not in FILTER_COLUMNS or not isinstance(v, list) or v != sorted(set(v)):
            raise ValueError(f"filter {k} must be a sorted list of distinct values")


@dataclass(frozen=True)
class QuerySpec:
    """A registered rank or aggregate query; nothing of it becomes SQL text."""

    kind: str
    canonical_metric: str
    metric_year: int
    normalized_unit: str
    document_ids: list = field(default_factory=list)
    entity_keys: list = field(default_factory=list)
    report_years: list = field(default_factory=list)
    order_direction: str = "desc"
    limit: int = 1
    aggregate_operator: str = "sum"

    def __post_init__(self):
        if self.kind not in ("rank", "aggregate"):
            raise ValueError("kind is rank or aggregate")
        if isinstance(self.metric_year, bool) or not FIRST_YEAR <= self.metric_year <= LAST_YEAR:
            raise ValueError("metric_year out of range")
        if self.kind == "rank" and (isinstance(self.limit, bool) or not 1 <= self.limit <= MOST_RANKED or self.order_direction not in ("asc", "desc")):
            raise ValueError("a rank has a limit of 1 to 5 and a direction")
        if self.kind == "aggregate" and self.aggregate_operator not in ("count", "sum", "average"):
            raise ValueError("an aggregate counts, sums or averages")
        for text in (self.canonical_metric, self.normalized_unit, *map(str, self.document_ids), *map(str, self.entity_keys)):
            if _UNSAFE.search(text):
                raise ValueError("unsafe text in a query specification")

    def filters(self) -> dict[str, list]:
        return {
            "document_ids": sorted(set(self.document_ids)), "stock_codes": sorted(set(self.entity_keys)), "report_years": sorted(set(self.report_years)),
            "metric_years": [self.metric_year], "canonical_metrics": [self.canonical_metric], "normalized_units": [self.normalized_unit],
        }


def rank(rows: DataFrame, spec: QuerySpec) -> DataFrame:
    """The first ``limit`` rows by value; ties always ascend by identity. Only these rows reach one task."""
    value = F.col("normalized_value")
    order = [value.desc() if spec.order_direction == "desc" else value.asc(), *RANK_TIES]
    top = allow_list(rows, spec.filters()).orderBy(*order).limit(spec.limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def exact_mean(total: Column, n: Column) -> Column:
    """total / n of a decimal with twelve places, correct to nineteen.

    Spark narrows a quotient of wide decimals. So eight places come first, and what they leave
    of the total, which is small, is divided on its own.
    """
    n = n.cast("decimal(10,0)")
    first = (total.cast("decimal(30,8)") / n).cast("decimal(26,8)")
    rest = total.cast("decimal(34,12)") - (first * n).cast("decimal(30,8)")
    return first + rest.cast("decimal(24,12)") / n


def aggregate(rows: DataFrame, spec: QuerySpec) -> DataFrame:
    """One row, or none where nothing matches; an average keeps sixteen places."""
    own = allow_list(rows, spec.filters())
    value = {"count": F.count(F.lit(1)).cast("decimal(38,4)"), "sum": F.sum("normalized_value"), "average": exact_mean(F.sum("normalized_value"), F.count(F.lit(1))).cast("decimal(38,16)")}[spec.aggregate_operator]
    out = own.agg(value.alias("value"), F.count(F.lit(1)).alias("n_facts"), F.min("fact_id").alias("first_fact_id"))
    unit = "count" if spec.aggregate_operator == "count" else spec.normalized_unit
    return out.filter("n_facts > 0").withColumns({"aggregate_operator": F.lit(spec.aggregate_operator), "normalized_unit": F.lit(unit)})


def lookup(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """Requests with status found, not_found or ambiguous and the facts that match all six identity columns."""
    found = rows.groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("fact_id")).alias("fact_ids"), F.min("normalized_value").alias("value"))
    out = requests.join(found, IDENTITY, "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "not_found").when(n == 1, "found").otherwise("ambiguous")
    return out.withColumns({"n": n, "status": status, "value": F.when(n == 1, F.col("value"))})


def coverage(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """One row: how many expected keys there are, how many were observed and how many are missing."""
    both = expected.select(key).distinct().join(observed.select(key).distinct().withColumn("seen", F.lit(1)), key, "left")
    return both.agg(F.count(F.lit(1)).alias("expected"), F.count("seen").alias("observed"), (F.count(F.lit(1)) - F.count("seen")).alias("missing"))


def shadowed_union(selected: DataFrame, supplements: DataFrame) -> DataFrame:
    """Selected facts, and the supplements whose identity no selected fact has."""
    extra = supplements.join(selected.select(*IDENTITY).distinct(), IDENTITY, "left_anti")
    return selected.withColumn("origin", F.lit("selected")).unionByName(extra.withColumn("origin", F.lit("supplement")))


def missing_slots(documents: DataFrame, selected: DataFrame, all_facts: DataFrame, metrics: list[tuple[str, str]], offsets: int = 3) -> DataFrame:
    """Documents x metric and unit x years back without a selected fact, by cause.

    The grid is made row by row from constant arrays, so nothing is multiplied in
    a join: ``conflict`` where several facts exist, ``withheld`` where one does,
    ``no_fact`` where none does.
    """
    slots = F.array(*[F.struct(F.lit(m).alias("canonical_metric"), F.lit(u).alias("normalized_unit")) for m, u in metrics])
    grid = documents.select("document_id", "report_year", F.explode(slots).alias("slot"), F.lit(offsets).alias("k"))
    grid = grid.select("document_id", "report_year", "slot.*", F.explode(F.sequence(F.lit(0), F.lit(offsets - 1))).alias("offset"))
    grid = grid.withColumn("metric_year", F.col("report_year") - F.col("offset"))
    keys = ["document_id", "metric_year", "canonical_metric", "normalized_unit"]
    known = all_facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    gaps = grid.join(selected.select(*keys).distinct(), keys, "left_anti").join(known, keys, "left")
    cause = F.when(F.col("n") > 1, "conflict").when(F.col("n") == 1, "withheld").otherwise("no_fact")
    return gaps.select(*keys, "report_year", cause.alias("cause"))


def metadata_witnesses(rows: DataFrame, field_name: str, key: str) -> DataFrame:
    """(entity, value, document_id): every document that says a value, a row each, whatever their number."""
    return rows.select(key, field_name, "document_id").distinct()


def metadata(rows: DataFrame, field_name: str, key: str, witnesses: int = 20) -> DataFrame:
    """Values of a metadata field per entity, with how many documents say so, the first of them, and the status.

    Any number of documents may say the same: all are counted, ``witnesses`` of them are
    gathered here, chosen by a window that Spark prunes per task; ``metadata_witnesses`` has
    all of them, a row each.
    """
    said = metadata_witnesses(rows, field_name, key)
    counted = said.groupBy(key, field_name).agg(F.count(F.lit(1)).alias("n_documents"))
    first = Window.partitionBy(key, field_name).orderBy("document_id")
    named = said.withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= witnesses)
    named = named.groupBy(key, field_name).agg(F.array_sort(F.collect_list("document_id")).alias("document_ids"))
    values = counted.groupBy(key).agg(F.count(F.lit(1)).alias("__values"))
    out = counted.join(named, [key, field_name]).join(values, key)
    return out.withColumn("status", F.when(F.col("__values") == 1, "found").otherwise("ambiguous")).drop("__values")


def fallback_lookup(requests: DataFrame, selected: DataFrame, supplements: DataFrame) -> DataFrame:
    """``lookup`` in the selected facts, and in the supplements for what these do not have; ``source`` says where."""
    first = lookup(requests, selected).withColumn("source", F.lit("selected"))
    open_ = first.filter("status = 'not_found'").select(*requests.columns)
    second = lookup(open_, supplements).withColumn("source", F.lit("supplement"))
    return first.filter("status <> 'not_found'").unionByName(second)


def candidate_tables(candidates: DataFrame, keys: list[str], table_id: str) -> DataFrame:
    """Per key the sorted distinct ids of the tables that propose a value."""
    return candidates.groupBy(*keys).agg(F.array_sort(F.collect_set(table_id)).alias("table_ids"))
