"""Entity resolution over alias arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise_alias(value: Column) -> Column:
    return F.upper(F.trim(value))


def resolve_mentions(mentions: DataFrame, entities: DataFrame, aliases: str, key: str) -> DataFrame:
    """Mentions with the number of entities that carry them as an alias: unique, ambiguous or missing."""
    index = entities.select(key, F.explode(aliases).alias("alias")).select(key, normalise_alias(F.col("alias")).alias("mention")).distinct()
    counted = index.groupBy("mention").agg(F.countDistinct(key).alias("n"), F.min(key).alias(key))
    asked = mentions.select(normalise_alias(F.col("mention")).alias("mention")).distinct()
    out = asked.join(counted, "mention", "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "unique").otherwise("ambiguous")
    return out.select("mention", F.coalesce("n", F.lit(0)).alias("n"), key, status.alias("status"))


def resolve_with_year(mentions: DataFrame, entities: DataFrame, aliases: str, key: str) -> DataFrame:
    """As ``resolve_mentions`` for pairs of mention and report_year."""
    index = entities.select(key, "report_year", F.explode(aliases).alias("alias")).select(key, "report_year", normalise_alias(F.col("alias")).alias("mention")).distinct()
    counted = index.groupBy("mention", "report_year").agg(F.countDistinct(key).alias("n"), F.min(key).alias(key))
    asked = mentions.select(normalise_alias(F.col("mention")).alias("mention"), "report_year").distinct()
    out = asked.join(counted, ["mention", "report_year"], "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "unique").otherwise("ambiguous")
    return out.select("mention", "report_year", F.coalesce("n", F.lit(0)).alias("n"), key, status.alias("status"))


#: What may be asked of a whole corpus.
CORPUS_INTENTS = ("aggregate", "rank")


def corpus_scope(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Per request for the whole corpus its scope: request_id, documents, companies, report_years, findings.

    requests: request_id, report_years (an array, empty for all), intents (an array); documents:
    document_id, stock_code, report_year. Years without a document and requests that neither rank
    nor aggregate are findings. Documents are counted once per year, whatever the number of requests.
    """
    years = documents.groupBy("report_year").agg(F.countDistinct("document_id").alias("documents"))
    firms = documents.select("report_year", "stock_code").distinct()
    every = years.agg(F.array_sort(F.collect_set("report_year")).alias("all"))  # one row, a value per year
    asked = requests.crossJoin(F.broadcast(every)).select("request_id", F.explode_outer(F.when(F.size("report_years") > 0, F.array_distinct("report_years")).otherwise(F.col("all"))).alias("report_year"))
    counted = asked.join(years, "report_year", "left").groupBy("request_id").agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.array_sort(F.collect_set(F.when(F.col("documents").isNotNull(), F.col("report_year")))).alias("report_years"))
    # A company of several years counts once: requests for the same years share the count.
    sets = requests.join(counted.select("request_id", F.col("report_years").alias("__years")), "request_id").select("__years").distinct().withColumn("report_year", F.explode("__years"))
    companies = sets.join(firms, "report_year").groupBy("__years").agg(F.countDistinct("stock_code").alias("companies"))
    out = requests.select("request_id", "intents", F.col("report_years").alias("__asked")).join(counted, "request_id").join(companies, F.col("report_years") == F.col("__years"), "left")
    missing = F.when((F.size("__asked") > 0) & (F.col("documents") == 0), "RESOLVER_MISSING")
    unfit = F.when(~F.arrays_overlap("intents", F.array(*map(F.lit, CORPUS_INTENTS))), "COMPOSITION_UNSUPPORTED")
    return out.select("request_id", "documents", F.coalesce("companies", F.lit(0)).alias("companies"), "report_years", F.array_compact(F.array(missing, unfit)).alias("findings"))
