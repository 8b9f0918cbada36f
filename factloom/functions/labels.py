"""Labels of table rows and columns: metrics, periods, scopes, units, headings; confidence of triples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import compact_words, entity

#: Heading bonus for the first topic and each further one, and its most.
BONUS, MORE, MOST = 0.24, 0.03, 0.30
#: Penalties of passages that carry little.
PENALTIES = {"unit_only": 0.50, "trivial": 0.48, "contents": 0.45}


def metric_of_label(label: Column, aliases: dict[str, str], patterns: dict[str, str]) -> Column:
    """struct<metric, match>: an exact alias, else the only pattern that fits, else ambiguous or none."""
    exact = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[F.trim(label)]
    hits = F.array_distinct(F.array_compact(F.array(*[F.when(label.rlike(p), m) for p, m in patterns.items()])))
    metric = F.coalesce(exact, F.when(F.size(hits) == 1, F.get(hits, F.lit(0))))
    match = F.when(exact.isNotNull(), "exact_alias").when(F.size(hits) == 1, "regex").when(F.size(hits) > 1, "ambiguous").otherwise("none")
    return F.struct(metric.alias("metric"), match.alias("match"))


def row_before_column(row: Column, column: Column) -> Column:
    """struct<metric, source, conflict>: the row's metric decides, a different one of the column is a conflict."""
    source = F.when(row.isNotNull(), "row_label").when(column.isNotNull(), "column_label")
    return F.struct(F.coalesce(row, column).alias("metric"), source.alias("source"), F.coalesce(row != column, F.lit(False)).alias("conflict"))


def tri_state(values: Column) -> Column:
    """struct<status, value>: resolved for one distinct value, unknown for none, conflict for several."""
    known = F.array_distinct(F.array_compact(values))
    status = F.when(F.size(known) == 0, "unknown").when(F.size(known) == 1, "resolved").otherwise("conflict")
    return F.struct(status.alias("status"), F.when(F.size(known) == 1, F.get(known, F.lit(0))).alias("value"))


def period_state(header: Column, report_year: Column) -> Column:
    """Years that a header names, or the report's and the year before for 本期 and 上期."""
    years = F.transform(F.regexp_extract_all(header, F.lit(r"((?:19|20)\d{2})"), F.lit(1)), lambda y: y.cast("int"))
    relative = F.array(F.when(header.rlike("本期|本年|期末|年末"), report_year), F.when(header.rlike("上期|上年|期初|年初"), report_year - 1))
    return tri_state(F.when(F.size(years) > 0, years).otherwise(relative))


def scope_state(text: Column) -> Column:
    return tri_state(F.array(F.when(text.rlike("合并"), "consolidated"), F.when(text.rlike("母公司"), "parent")))


def heading_adjustment(question: Column, headings: Column, topics: list[tuple[str, ...]], content: Column) -> Column:
    """Bonus for topics that question and headings share, less the penalty of the content."""
    asked, path = compact_words(question), compact_words(F.array_join(headings, "\n"))
    hit = lambda text, words: text.rlike("|".join(words))
    matched = sum((F.when(hit(asked, t) & hit(path, t), 1).otherwise(0) for t in topics), F.lit(0))
    bonus = F.when(matched > 0, F.least(F.lit(MOST), BONUS + (matched - 1) * MORE)).otherwise(0.0)
    plain = F.trim(content)
    penalty = (
        F.when(plain.rlike(r"^(单位|金额单位|币种)\s*[:：]\s*\S+$"), PENALTIES["unit_only"]).when(plain.rlike(r"^\W*(不适用|适用|无)?\W*$"), PENALTIES["trivial"])
        .when(F.regexp_count(plain, F.lit("第[0-9一二三四五六七八九十百]+节")) >= 4, PENALTIES["contents"]).otherwise(0.0)
    )
    return F.round(bonus - penalty, 8)


def triple_confidence(subject: Column, predicate: Column, object_: Column, passage: Column, entities: Column, cut_short: Column) -> Column:
    """Confidence of an extracted triple, between 0.05 and 1; 0 where a part is blank."""
    blank = (F.trim(subject) == "") | (F.trim(predicate) == "") | (F.trim(object_) == "")
    low, known = F.lower(F.coalesce(passage, F.lit(""))), F.transform(entities, entity)
    c = F.when((F.length(F.trim(subject)) < 2) | (F.length(F.trim(object_)) < 2), 0.7).otherwise(1.0)
    c = c * F.when(F.length(F.trim(predicate)) < 2, 0.8).otherwise(1.0)
    for part in (subject, object_):
        c = c * F.when(F.contains(low, F.lower(part)), 1.0).otherwise(0.9)
        c = c * F.when(F.array_contains(known, entity(part)), 1.05).otherwise(1.0)
    c = c * F.when(cut_short, 0.85).otherwise(1.0)
    return F.when(blank, 0.0).otherwise(F.greatest(F.least(c, F.lit(1.0)), F.lit(0.05)))
