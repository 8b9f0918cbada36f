"""From retrieved evidence to an answer: facets of a question, selections by others, provenance, ports of models."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a question is cut into clauses, and what does not belong to a metric's name.
CLAUSES = "[，。；;！？?!]+"
EDGES = " ：:，,。；;！？?!（）()[]【】"
PREFIX = "^(?:根据|请|结合|从|简要|详细|分析|说明|介绍|概述|回答|查询)+"
SUFFIX = "(?:情况|原因|变化|变动|分析|说明|如何|是什么|有哪些|多少|是否|请|简要|根据|年度报告|年报|公司|该公司|本公司|的)+$"
BOILERPLATE = "(?:根据|来自|年度报告|年报|请|简要|详细|分析|说明|介绍|概述|回答|查询|该公司|本公司|公司|股份有限公司|有限责任公司)"
YEAR = r"(?<!\d)(?:19|20)\d{2}(?!\d)"
#: Words of a question that add a facet, and the facet's query; {} stands for the metric.
HINTS = (
    ("causal", "原因|为何|为什么|变动|变化", "{} 原因 影响因素"), ("comparison", "增长|下降|增加|减少|同比|变动", "{} 本期 上期 同比 变动"), ("topic", "核心竞争力|优势|竞争", "核心竞争力 技术 品牌 渠道 研发 人才"),
    ("topic", "风险|不利|困难", "{} 风险 不利因素 应对措施"),
)
MOST_FACETS = 6


def _clean(c: Column) -> Column:
    """A clause without signs at its ends, without what questions begin with and metrics end with."""
    ends = "[" + EDGES.replace("]", r"\]").replace("[", r"\[", 1) + "]"
    inner = F.regexp_replace(F.regexp_replace(c, f"^{ends}+|{ends}+$", ""), PREFIX, "")
    return F.regexp_replace(F.regexp_replace(inner, SUFFIX, ""), f"^{ends}+|{ends}+$", "")


def facets(question: Column, most: int = MOST_FACETS) -> Column:
    """array<struct<kind, query, facet_id>>: the question, its clauses, its metric with and without years, and what its words hint at.

    Proposals come in this order, each text once (white space and case aside), the first ``most`` of them.
    """
    if not 1 <= most <= MOST_FACETS:
        raise ValueError(f"most must be 1 to {MOST_FACETS}")
    whole = F.trim(F.regexp_replace(question, r"(?U)\s+", " "))
    one = lambda kind, q: F.struct(F.lit(kind).alias("kind"), F.trim(F.regexp_replace(q, r"(?U)\s+", " ")).alias("query"))
    clauses = F.filter(F.transform(F.split(whole, CLAUSES), _clean), lambda x: (F.length(x) >= 2) & (x != whole))
    metric = _clean(F.regexp_replace(F.regexp_replace(whole, BOILERPLATE, " "), YEAR, " "))
    years = F.slice(F.array_distinct(F.regexp_extract_all(whole, F.lit(f"({YEAR})"), F.lit(1))), 1, 2)
    known = F.length(metric) >= 2
    named = F.when(metric == "", whole).otherwise(metric)
    none = F.array().cast("array<struct<kind:string,query:string>>")
    parts = [F.array(one("question", whole)), F.transform(clauses, lambda x: one("clause", x)), F.when(known, F.array(one("metric", metric))).otherwise(none), F.when(known, F.transform(years, lambda y: one("metric_year", F.concat_ws(" ", metric, y)))).otherwise(none)]
    for kind, words, query in HINTS:
        text = F.concat(named, F.lit(query.removeprefix("{}"))) if query.startswith("{}") else F.lit(query)
        parts.append(F.when(whole.rlike(words), F.array(one(kind, text))).otherwise(none))
    every = F.filter(F.concat(*parts), lambda x: x["query"] != "")
    print_ = lambda x: F.lower(F.regexp_replace(x["query"], r"(?U)\s+", ""))

    def add(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda y: print_(y) == print_(x)), kept).otherwise(F.concat(kept, F.array(x)))

    chosen = F.slice(F.aggregate(every, none, add), 1, most)
    return F.transform(chosen, lambda x, i: F.struct(x["kind"].alias("kind"), x["query"].alias("query"), F.concat(F.lit("facet-"), (i + 1).cast("string"), F.lit("-"), F.substring(F.sha2(x["query"], 256), 1, 10)).alias("facet_id")))


def shadow_selection(candidates: Column, response: Column, timed_out: Column, most: int = 8) -> Column:
    """struct<status, selected>: a model's choice among candidate ids if it keeps to the form, else the first candidates.

    ``response`` is JSON text of one field, selected_ids: at most ``most`` ids, each once, all of them candidates.
    """
    keys = F.json_object_keys(response)
    ids = F.from_json(response, "selected_ids array<string>")["selected_ids"]
    quoted = F.get_json_object(response, "$.selected_ids").rlike(r'^\[\s*("(?:[^"\\]|\\.)*"\s*(,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]$')
    status = (
        F.when(timed_out, "fallback_timeout").when(F.coalesce(F.size(keys) != 1, F.lit(True)) | ~F.array_contains(keys, "selected_ids"), "fallback_free_text_or_schema")
        .when(~F.coalesce(quoted, F.lit(False)) | (F.size(ids) > most) | (F.size(F.array_distinct(ids)) < F.size(ids)), "fallback_invalid_cardinality").when(F.size(F.array_except(ids, candidates)) > 0, "fallback_unknown_id").otherwise("shadow_valid")
    )
    return F.struct(status.alias("status"), F.when(status == "shadow_valid", ids).otherwise(F.slice(candidates, 1, most)).alias("selected"))


def frozen_rerank(chunks: DataFrame, group: str) -> DataFrame:
    """A frozen top-k without incompatible and low-information chunks, by content score, path score and its old rank.

    chunks: group, chunk_id, original_rank, compatible, low_information, content_score, path_score.
    """
    order = Window.partitionBy(group).orderBy(F.col("content_score").desc(), F.col("path_score").desc(), "original_rank", "chunk_id")
    kept = chunks.filter(F.col("compatible") & ~F.col("low_information"))
    return kept.withColumns({"concern_score": F.col("content_score") * 3 + F.col("path_score"), "rank": F.row_number().over(order).cast("long")})


def first_passing(sentences: DataFrame, chunk: str) -> DataFrame:
    """Of each chunk the best sentence that a gate lets through: by directness, concept and section score, position and text.

    sentences: chunk, direct, concept, section, position, text, verdict.
    """
    order = Window.partitionBy(chunk).orderBy(F.col("direct").desc(), F.col("concept").desc(), F.col("section").desc(), "position", "text")
    return sentences.filter("verdict = 'accepted'").withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def by_relevance(evidence: DataFrame, group: str) -> DataFrame:
    """Evidence by its relevance to labels, then by its own score; ``retrieval_rank`` keeps the old place.

    evidence: group, retrieval_rank, relevance, score.
    """
    order = Window.partitionBy(group).orderBy(F.col("relevance").desc(), F.coalesce("score", F.lit(0.0)).desc(), F.col("retrieval_rank").desc())
    return evidence.withColumn("rank", F.row_number().over(order).cast("long"))


def provenance_violations(plan: DataFrame, results: DataFrame) -> DataFrame:
    """(subplan_id, code): where results depart from their plan.

    plan: subplan_id, backend, operation, planning_state; results: those columns,
    execution_state and failure_code. Results outside the plan, second results, another
    backend, operation or state than planned, blocked parts that ran all the same, and
    provenance failures that a backend reports.
    """
    n = results.groupBy("subplan_id").agg(F.count(F.lit(1)).alias("n"))
    planned = plan.select("subplan_id", *[F.col(c).alias(f"p_{c}") for c in ("backend", "operation", "planning_state")])
    both = results.join(planned, "subplan_id", "left").join(n, "subplan_id")
    known = F.col("p_backend").isNotNull()
    codes = F.array(
        F.when(~known, "unknown_subplan_result"), F.when(F.col("n") > 1, "duplicate_subplan_result"),
        F.when(known & ((F.col("backend") != F.col("p_backend")) | (F.col("operation") != F.col("p_operation")) | (F.col("planning_state") != F.col("p_planning_state"))), "subplan_identity_mismatch"),
        F.when(known & (F.col("p_planning_state") == "blocked") & (F.col("execution_state") != "not_executed"), "blocked_subplan_executed"), F.when(F.col("failure_code") == "PROVENANCE_VALIDATION_FAILED", "backend_provenance_failure"),
    )
    return both.select("subplan_id", F.explode(F.array_compact(codes)).alias("code")).distinct()


def findings(results: DataFrame, most: int = 100) -> DataFrame:
    """(section, n, findings): each section's findings with the result that they come from; all are counted, the ``most`` first listed."""
    order = Window.partitionBy("section").orderBy("subplan_id", "position")
    first = results.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= most)
    listed = first.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("__r", "subplan_id", "text"))).alias("f"))
    return results.groupBy("section").agg(F.count(F.lit(1)).alias("n")).join(listed, "section").select("section", "n", F.transform("f", lambda x: F.struct(x["subplan_id"].alias("origin"), x["text"].alias("text"))).alias("findings"))


# --- ports --------------------------------------------------------------------------------------


class GeneratorPort(Protocol):
    """Claims from evidence: a table of (question_id, chunk_id, text) to one of (question_id, claim, chunk_ids)."""

    def __call__(self, evidence: DataFrame) -> DataFrame: ...


class EvidenceProviderPort(Protocol):
    """Evidence for requests (question_id, document_id, question): (question_id, chunk_id, rank, score, text)."""

    def __call__(self, requests: DataFrame) -> DataFrame: ...


class FactQueryPort(Protocol):
    """Selected facts inside an allow list."""

    def __call__(self, filters: dict[str, list]) -> DataFrame: ...


def scoped(provider: EvidenceProviderPort, requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """A provider's evidence, held against the pinned chunks: only what stands there with this content, in the document asked for.

    chunks: chunk_id, document_id, content_sha256. ``rejected`` says why a row does not count: foreign_document, unknown_chunk or changed_content.
    """
    pinned = chunks.select("chunk_id", F.col("document_id").alias("__doc"), "content_sha256")
    rows = provider(requests).join(requests.select("question_id", "document_id"), "question_id").join(pinned, "chunk_id", "left")
    why = F.when(F.col("__doc").isNull(), "unknown_chunk").when(F.col("__doc") != F.col("document_id"), "foreign_document").when(F.sha2("text", 256) != F.col("content_sha256"), "changed_content")
    return rows.withColumn("rejected", why).drop("__doc", "content_sha256")


def extract_triples(chunks: DataFrame, extractor: Callable[[str], list[tuple[str, str, str]]]) -> DataFrame:
    """(chunk_id, subject, predicate, object) by any extractor, run on executors; one that fails on a chunk gives none for it and says so.

    ``extractor`` goes to the executors with the plan. The column ``error`` is null for triples.
    """

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for chunk_id, text in zip(frame["chunk_id"], frame["text"]):
                try:
                    out += [(chunk_id, *t, None) for t in dict.fromkeys(map(tuple, extractor(text or ""))) if len(t) == 3]
                except Exception as e:  # a model may fail on any text; the chunk stays in the result
                    out.append((chunk_id, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["chunk_id", "subject", "predicate", "object", "error"])

    return chunks.select("chunk_id", "text").mapInPandas(run, "chunk_id string, subject string, predicate string, object string, error string")
