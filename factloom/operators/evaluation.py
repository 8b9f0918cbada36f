"""Evaluation: score summaries, buckets, bootstrap intervals, normalisation, smoothed IDF."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def demo_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A score between 0 and 1 for each labelled document, made of its length."""
    rows = documents.select("doc_id", "lang", "source", "n_chars").join(labels.select("doc_id", "toxic"), "doc_id")
    return rows.select("doc_id", "lang", "source", "toxic", F.round(F.pmod("n_chars", F.lit(101)) / 100.0, 2).alias("score"))


def summary(rows: DataFrame, score: str, groups: dict[str, str]) -> DataFrame:
    """Counts, total, mean and thresholds overall and by each group, in one pass over the data."""
    s = F.col(score)
    names = list(groups)
    sets = [[], *[[F.col(n)] for n in names]]
    out = rows.groupingSets(sets, *names).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(s), 6).alias("total"), F.round(F.avg(s), 6).alias("mean"), F.count_if(s == 0).alias("zero"), F.count_if(s > 0).alias("positive"),
        F.count_if(s >= 0.5).alias("at_50"), F.count_if(s >= 0.75).alias("at_75"), F.count_if(s >= 0.9).alias("at_90"),
    )
    measures = [c for c in out.columns if c not in names]
    return out.select(*[F.coalesce(F.col(n).cast("string"), F.lit("*")).alias(groups[n]) for n in names], *measures)


def buckets(rows: DataFrame, labels: Column, score: str) -> DataFrame:
    """Means by bucket, a row counting in each of its buckets."""
    return rows.select(F.explode(labels).alias("bucket"), score).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("mean"))


#: Resamples of the bootstrap, and its interval.
RESAMPLES, LOW, HIGH = 10_000, 0.025, 0.975


def resample_weights(key: int, resamples: int) -> np.ndarray:
    """How often a row stands in each resample: Poisson numbers of mean 1, seeded by the row's key alone."""
    return np.random.Generator(np.random.Philox(key=key & ((1 << 64) - 1))).poisson(1.0, resamples)


def bootstrap(rows: DataFrame, key: str, score: str, resamples: int = RESAMPLES) -> DataFrame:
    """One row: mean, n and 95 % interval by the Poisson bootstrap.

    Every task adds up its own rows' weights in two arrays and gives one row for each
    resample, whatever the number of rows; nothing is resampled on the driver, and a
    task that runs again draws the same numbers.
    """

    def run(batches):
        total, mass = np.zeros(resamples), np.zeros(resamples)
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if x is not None:
                    w = resample_weights(k, resamples)
                    total += w * x
                    mass += w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(total), pa.array(mass)], names=["resample", "total", "mass"])

    parts = rows.select(F.xxhash64(key).alias("k"), F.col(score).cast("double")).mapInArrow(run, "resample long, total double, mass double")
    means = parts.groupBy("resample").agg((F.sum("total") / F.nullif(F.sum("mass"), F.lit(0.0))).alias("mean"))
    whole = rows.agg(F.avg(score).alias("mean"), F.count(score).alias("n"))
    return whole.crossJoin(means.agg(F.percentile("mean", LOW).alias("low"), F.percentile("mean", HIGH).alias("high")))  # one row each


def cluster_means(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """The mean score of each cluster, by document and question."""
    return rows.groupBy(*keys).agg(F.avg(score).alias("mean"), F.count(F.lit(1)).alias("n"))


def best_similarity(pairs: DataFrame, keys: list[str], reference: str, cosine: str) -> DataFrame:
    """The largest cosine over a prediction's references, between 0 and 1, and the reference; none where nothing is above 0."""
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(cosine), F.lit(0.0))))
    out = pairs.withColumn("__s", clamped).groupBy(*keys).agg(F.max("__s").alias("similarity"), F.max_by(reference, F.struct("__s", -F.col("position"))).alias("__r"))
    return out.withColumn("best_reference", F.when(F.col("similarity") > 0, F.col("__r"))).drop("__r")


def prompt_score(similarity: Column, answer_matches: Column, keyword_matches: Column) -> Column:
    """struct<score, reason>. A prompt may name an answer, keywords or neither; a null match says that it names none.

    Without both the similarity counts alone. A named answer that is missed gives 0, one
    that is met a quarter, a quarter more for the keywords, and half the similarity. With
    keywords alone they give a quarter and the similarity three.
    """
    keyword = F.when(F.coalesce(keyword_matches, F.lit(False)), 0.25).otherwise(0.0)
    suffix = F.when(keyword_matches.isNull(), "_no_keyword").when(keyword_matches, "_keyword_matched").otherwise("_keyword_missing")
    neither = answer_matches.isNull() & keyword_matches.isNull()
    score = F.when(neither, similarity).when(answer_matches.isNull(), keyword + 0.75 * similarity).when(answer_matches, 0.25 + keyword + 0.5 * similarity).otherwise(0.0)
    reason = (
        F.when(neither, "no_prompt_similarity_only").when(answer_matches.isNull(), F.concat(F.lit("no_prom_answer"), F.when(keyword_matches, "_keyword_matched").otherwise("_keyword_missing")))
        .when(answer_matches, F.concat(F.lit("prom_answer_matched"), suffix)).otherwise("prom_answer_not_matched")
    )
    return F.struct(F.round(score, 6).alias("score"), reason.alias("reason"))


def regression_report(latest: DataFrame) -> DataFrame:
    """One row: completed, passed and failed cases, pass rate, average and longest time.

    latest: case_id, passed, elapsed_seconds.
    """
    return latest.agg(
        F.count(F.lit(1)).alias("completed"), F.count_if("passed").alias("passed"), F.count_if(~F.coalesce("passed", F.lit(False))).alias("failed"),
        F.round(F.count_if("passed") / F.count(F.lit(1)), 4).alias("pass_rate"), F.round(F.avg("elapsed_seconds"), 3).alias("average_seconds"), F.round(F.max("elapsed_seconds"), 3).alias("longest_seconds"),
    )


def failure_counts(latest: DataFrame, column: str) -> DataFrame:
    """How often each reason (or code) stands in the arrays of failed cases."""
    return latest.filter(~F.coalesce("passed", F.lit(False))).select(F.explode(column).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def by_prompt(latest: DataFrame, prompt: str) -> DataFrame:
    return latest.groupBy(prompt).agg(F.count(F.lit(1)).alias("completed"), F.count_if(~F.coalesce("passed", F.lit(False))).alias("failed"))


def snapshot_difference(left: DataFrame, right: DataFrame, arm: str, case: str, recall: str) -> DataFrame:
    """Per arm: cases whose candidate sequences differ, cases of one side alone, and both mean recalls.

    Sides: arm, case, rank, candidate_id and the case's recall. A sequence is compared by
    the hash of its ids in order.
    """

    def shape(rows: DataFrame, side: str) -> DataFrame:
        ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("candidate_id").cast("string").alias("c")))), lambda x: x["c"])
        return rows.groupBy(arm, case).agg(F.sha2(F.array_join(ids, "\n"), 256).alias(f"{side}_hash"), F.max(recall).alias(f"{side}_recall"))

    both = shape(left, "left").join(shape(right, "right"), [arm, case], "full_outer")
    return both.groupBy(arm).agg(
        F.count_if(F.col("left_hash") != F.col("right_hash")).alias("differing"), F.count_if(F.col("left_hash").isNull() | F.col("right_hash").isNull()).alias("unpaired"),
        F.round(F.avg("left_recall"), 8).alias("left_recall"), F.round(F.avg("right_recall"), 8).alias("right_recall"),
    )


def labels_by_company(rows: DataFrame, company: str, label: str, confidence: str, most: int = 50) -> DataFrame:
    """Each company's labels, the surest first; all are counted, the ``most`` first are named."""
    order = Window.partitionBy(company).orderBy(F.col(confidence).desc(), label)
    first = rows.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= most)
    named = first.groupBy(company).agg(F.array_sort(F.collect_list(F.struct("__r", label))).alias("l"))
    n = rows.groupBy(company).agg(F.count(F.lit(1)).alias("n"))
    return n.join(named, company).select(company, "n", F.transform("l", lambda x: x[label]).alias("labels"))


def same_rows(oracle: DataFrame, gold: DataFrame, answers: DataFrame, key: str, field: str) -> DataFrame:
    """One row: keys of all three tables, keys that one of them lacks, keys that repeat, and gold that differs from the oracle's."""
    sides = [rows.groupBy(key).agg(F.count(F.lit(1)).alias(f"n{i}"), F.min(field).alias(f"v{i}")) for i, rows in enumerate((oracle, gold, answers))]
    all_ = sides[0].join(sides[1], key, "full_outer").join(sides[2], key, "full_outer")
    n = [F.coalesce(f"n{i}", F.lit(0)) for i in range(3)]
    whole = (n[0] > 0) & (n[1] > 0) & (n[2] > 0)
    return all_.agg(F.count_if(whole).alias("complete"), F.count_if(~whole).alias("incomplete"), F.count_if((n[0] > 1) | (n[1] > 1) | (n[2] > 1)).alias("repeated"), F.count_if(F.col("v0") != F.col("v1")).alias("differing"))


def min_max(rows: DataFrame, partition: list[str], value: str) -> DataFrame:
    """``score`` between 0 and 1 within a partition; 1 where all values are equal. Extremes are aggregated, not windowed."""
    ends = rows.groupBy(*partition).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    out = rows.join(ends, partition)
    span = F.col("__high") - F.col("__low")
    return out.withColumn("score", F.when(span == 0, 1.0).otherwise((F.col(value) - F.col("__low")) / F.nullif(span, F.lit(0)))).drop("__low", "__high")


def smoothed_idf(rows: DataFrame, label: str, document: str) -> DataFrame:
    """ln((1 + N) / (1 + df)) + 1 of each label."""
    n = rows.agg(F.countDistinct(document).alias("__n"))
    out = rows.groupBy(label).agg(F.countDistinct(document).alias("df")).crossJoin(F.broadcast(n))
    return out.withColumn("idf", F.log((1.0 + F.col("__n")) / (1.0 + F.col("df"))) + 1).drop("__n")
