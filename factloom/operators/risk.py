"""The risk-exposure dataset: nested documents, validation, company views, matrix, comparison, co-movement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Nested risk documents.
SCHEMA = """Company struct<company_id string, company_name string, report_year int>,
  RiskExposures array<struct<RiskName string, Category string, Subcategory string, ExposureScore int, Evidence array<struct<EvidenceQuote string, Interpretation string>>>>"""


def validation(documents: DataFrame, categories: tuple[str, ...], text: str | None = None, most: int = 30) -> DataFrame:
    """Documents with the first rule that they break, or null: shape, categories, scores, quotes in the source text."""
    plain = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    risks = F.col("RiskExposures")
    bad = F.when(F.col("Company.company_id").isNull() | F.col("Company.report_year").isNull(), "company_incomplete").when(risks.isNull() | (F.size(risks) == 0), "no_exposures").when(F.size(risks) > most, "too_many_exposures")
    bad = bad.when(F.exists(risks, lambda r: r["Category"].isNull() | ~r["Category"].isin(*categories)), "unknown_category")
    bad = bad.when(F.exists(risks, lambda r: r["ExposureScore"].isNull() | ~r["ExposureScore"].between(1, 5)), "score_out_of_range")
    bad = bad.when(F.exists(risks, lambda r: F.coalesce(F.size(r["Evidence"]), F.lit(0)) == 0), "exposure_without_evidence")
    if text:
        source = plain(F.col(text))
        bad = bad.when(F.exists(risks, lambda r: F.exists(r["Evidence"], lambda e: ~F.contains(source, plain(e["EvidenceQuote"])))), "quote_not_in_source")
    return documents.withColumn("violation", bad)


def companies(documents: DataFrame, category: str | None = None, least: int | None = None, search: str | None = None) -> DataFrame:
    """Companies with an exposure of the category and score, the number of exposures and their three strongest."""
    rows = documents
    if category is not None or least is not None:
        fits = lambda r: (F.lit(True) if category is None else r["Category"] == category) & (F.lit(True) if least is None else r["ExposureScore"] >= least)
        rows = rows.filter(F.exists("RiskExposures", fits))
    if search:
        rows = rows.filter(F.contains(F.lower(F.concat_ws(" ", "Company.company_id", "Company.company_name")), F.lit(search.lower())))
    ranked = F.array_sort(F.transform("RiskExposures", lambda r: F.struct((-r["ExposureScore"]).alias("s"), r["RiskName"].alias("name"))))
    return rows.select(
        "Company.company_id", "Company.company_name", "Company.report_year", F.size("RiskExposures").alias("risk_count"), F.array_max(F.transform("RiskExposures", lambda r: r["ExposureScore"])).alias("max_exposure_score"),
        F.transform(F.slice(ranked, 1, 3), lambda x: x["name"]).alias("top_risks"),
    )


def detail(documents: DataFrame, company_id: str, year: int | None = None) -> tuple[str, DataFrame]:
    """Status 200, 404 or 409 (several years, none named) and the document with its number of quotes."""
    rows = documents.filter(F.col("Company.company_id") == company_id)
    if year is not None:
        rows = rows.filter(F.col("Company.report_year") == year)
    found = len(rows.limit(2).collect())
    quotes = F.aggregate("RiskExposures", F.lit(0), lambda n, r: n + F.coalesce(F.size(r["Evidence"]), F.lit(0)))
    return {0: "404", 1: "200"}.get(found, "409"), rows.withColumn("evidence_count", quotes)


def matrix(documents: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """One wide row per company and year: risk count, largest score, and the largest score of each category (0 for none)."""
    best = lambda c: F.coalesce(F.array_max(F.transform(F.filter("RiskExposures", lambda r: r["Category"] == c), lambda r: r["ExposureScore"])), F.lit(0))
    return documents.select(
        "Company.company_id", "Company.report_year", F.size("RiskExposures").alias("risk_count"), F.array_max(F.transform("RiskExposures", lambda r: r["ExposureScore"])).alias("max_exposure_score"),
        *[best(c).alias(f"category_{c}") for c in categories],
    )


def shared_categories(documents: DataFrame, company_ids: list[str]) -> DataFrame:
    """Categories with the number of the named companies that have them; ``shared`` if all do."""
    rows = documents.filter(F.col("Company.company_id").isin(company_ids)).select("Company.company_id", F.explode("RiskExposures").alias("r"))
    out = rows.groupBy(F.col("r.Category").alias("category")).agg(F.countDistinct("company_id").alias("companies"), F.max("r.ExposureScore").alias("largest"))
    return out.withColumn("shared", F.col("companies") == len(set(company_ids)))


def page(rows: DataFrame, order: list[Column | str], number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def keys_agree(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys of both, of the left alone and of the right alone."""
    both = left.select(*keys).distinct().withColumn("l", F.lit(1)).join(right.select(*keys).distinct().withColumn("r", F.lit(1)), keys, "full_outer")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


def co_movement(prices: DataFrame, key: str, day: str, close: str, groups: DataFrame) -> DataFrame:
    """Extension: mean Pearson correlation of simple returns within each group of securities (key, group).

    Built on pairs within a group, for groups of a few dozen securities; the
    reference's own definition is not recoverable, so no parity is claimed.
    """
    before = F.lag(close).over(Window.partitionBy(key).orderBy(day))
    returns = prices.withColumn("ret", F.col(close) / F.nullif(before, F.lit(0.0)) - 1).filter("ret IS NOT NULL").join(groups, key)
    other = returns.select(F.col(key).alias("other"), day, "group", F.col("ret").alias("other_ret"))
    pairs = returns.join(other, ["group", day]).filter(F.col(key) < F.col("other"))
    corr = pairs.groupBy("group", key, "other").agg(F.corr("ret", "other_ret").alias("r"))
    return corr.groupBy("group").agg(F.count(F.lit(1)).alias("pairs"), F.avg("r").alias("mean_correlation"))
