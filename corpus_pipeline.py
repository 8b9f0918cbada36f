"""Corpus pipeline: toxicity, quality, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``. Both classifiers
learn from the labelled rows of the whole input, whatever the earlier stages
dropped. Rows without an id pass the near-duplicate stage, as nothing can name
their group. Null texts are empty: all stages take them, empty tables, repeated rows
and columns of any name, as their operators state.

Near copies share 80 % of their shingles of NEAR_SHINGLE words, the rule of op2,
so that stage and query call the same texts near copies. Shingles of five words
find fewer: one changed word breaks five of them, and short texts with a few
changed words would stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import exact_dedup, near_dedup, packing, quality, toxicity
from factloom.llm.common import materialise, table

NEAR_SHINGLE = near_dedup.SHINGLE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep(docs, size=NEAR_SHINGLE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("packing", pack),
]

#: SQL can express neither classifier; tests hold each stage against a plain version, packing by its contract.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
