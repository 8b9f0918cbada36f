"""Text functions: normalisers, tokenizers, ids, labels. Columns in, columns out."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordinary Han characters, as a regular-expression class.
HAN = "\\x{3400}-\\x{9fff}"
#: Words that the sparse tokenizer leaves out.
SPARSE_STOP = frozenset("根据 年度 报告 年报 公司 情况 什么 哪些 为何 为什么 如何 请问 简要 分析 概述 介绍 说明 主要 相关 报告期 本年度 该公司 是否 以及 及其".split())
#: Full-width forms and what stands for them in numbers.
FULL_WIDTH, HALF_WIDTH = "（），．。＋－—０１２３４５６７８９％：", "(),..+--0123456789%:"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` names it.

    Spark repeats an expression in each branch of a condition that names it.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalise(c: Column) -> Column:
    """Runs of Unicode white space become one space; no white space at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def compact(c: Column) -> Column:
    """Full-width signs in ASCII, all white space gone."""
    return F.regexp_replace(F.translate(normalise(c), FULL_WIDTH, HALF_WIDTH), r"(?U)\s+", "")


def compact_words(c: Column) -> Column:
    """Lower case, only letters and digits of any script."""
    return F.regexp_replace(F.lower(normalise(c)), r"(?U)[\s\W_]+", "")


def entity(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"(?U)\s+", " "), r"(?U)[^\w\s]", "")


def answer(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    plain = F.regexp_replace(F.lower(c), r"\p{Punct}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def nfkc_compact(c: Column) -> Column:
    """NFKC, lower case, white space and punctuation gone."""
    return F.regexp_replace(F.lower(nfkc(c)), r"(?U)[\s\W_]+", "")


# --- tokenizers -------------------------------------------------------------------------------


def nfkc(c: Column) -> Column:
    """Compatibility normal form. Spark has no normalize(), so this one runs in Python, in batches."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else unicodedata.normalize("NFKC", t) for t in texts], dtype="object")

    return F.pandas_udf(run, "string")(c)


def _matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({pattern})"), F.lit(1))


def _grams(run: Column, n: int) -> Column:
    """The n-grams of a string, none where it is shorter. The string is walked once; substring() would count to each place from its start."""
    return F.coalesce(F.regexp_extract_all(run, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)), F.array().cast("array<string>"))


def _from_runs(c: Column, of: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(_matches(c, f"[{HAN}]+"), of))


def mixed_tokens(c: Column) -> Column:
    """Words and numbers in lower case; of a Han run its characters, then its bigrams."""
    pieces = _matches(c, rf"[A-Za-z]+(?:[-_.][A-Za-z0-9]+)*|\p{{Nd}}+(?:\.\p{{Nd}}+)?|[{HAN}]+")
    return F.flatten(F.transform(pieces, lambda p: F.when(p.rlike(f"^[{HAN}]"), F.concat(_grams(p, 1), _grams(p, 2))).otherwise(F.array(F.lower(p)))))


def _short_run(run: Column, most: int) -> Column:
    return F.when(F.length(run) <= most, F.array(run)).otherwise(F.array().cast("array<string>"))


def lexical_tokens(c: Column) -> Column:
    """Sorted set of ASCII words, Han bigrams, and Han runs of up to eight characters."""
    low = F.lower(normalise(c))
    return F.array_sort(F.array_distinct(F.concat(_matches(low, "[a-z0-9]+"), _from_runs(low, lambda run: F.concat(_grams(run, 2), _short_run(run, 8))))))


def sparse_tokens(c: Column) -> Column:
    """ASCII words, then Han bigrams and trigrams of each run, without the stop list."""
    low = F.lower(normalise(c))
    every = F.concat(_matches(low, "[a-z0-9]+"), _from_runs(low, lambda run: F.concat(_grams(run, 2), _grams(run, 3))))
    return F.filter(every, lambda t: ~t.isin(*sorted(SPARSE_STOP)))


def table_tokens(c: Column) -> Column:
    """Sorted set of ASCII words after NFKC, Han bigrams, and Han runs of up to four characters."""
    low = F.lower(normalise(nfkc(c)))
    return F.array_sort(F.array_distinct(F.concat(_matches(low, "[a-z0-9]+"), _from_runs(low, lambda run: F.concat(_grams(run, 2), _short_run(run, 4))))))


TOKENIZERS = {"mixed": mixed_tokens, "lexical": lexical_tokens, "sparse": sparse_tokens, "table": table_tokens}


def tokens(c: Column, kind: str) -> Column:
    return TOKENIZERS[kind](c)


def han_bigrams(c: Column) -> Column:
    """Distinct bigrams of the Han runs of a text."""
    return F.array_distinct(_from_runs(F.coalesce(c, F.lit("")), lambda run: _grams(run, 2)))


def plain_bigrams(c: Column, stop: tuple[str, ...]) -> Column:
    """Distinct character bigrams without digits, stop words and all but letters and digits taken out first."""
    bare = compact_words(c)
    for word in stop:
        bare = F.replace(bare, F.lit(word), F.lit(""))
    return F.filter(F.array_distinct(_grams(bare, 2)), lambda g: ~g.rlike(r"\p{Nd}"))


def words(c: Column) -> Column:
    """ASCII words in lower case, by built-in functions only."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def char_grams(c: Column, widths: tuple[int, ...] = (2, 3, 4)) -> Column:
    """Distinct character n-grams of a string, by built-in functions only."""
    return F.array_distinct(F.concat(*[_grams(c, n) for n in widths]))


def gram_recall(query: Column, text: Column) -> Column:
    """Share of the query's n-grams that the text has; both are arrays of distinct grams."""
    return F.when(F.size(query) == 0, 0.0).otherwise(F.size(F.array_intersect(query, text)) / F.size(query))


# --- ids and hashes ---------------------------------------------------------------------------


def md5_id(c: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.md5(c))


def canonical_json(*columns: str) -> Column:
    """A JSON object with its keys in alphabetical order and a final newline."""
    return F.concat(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), F.lit("\n"))


def semantic_sha256(*columns: str) -> Column:
    return F.sha2(canonical_json(*columns), 256)


def stable_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length))


# --- labels -----------------------------------------------------------------------------------


def length_bucket(n: Column) -> Column:
    return F.when(n < 100, "short").when(n < 1000, "medium").when(n < 5000, "long").otherwise("very_long")


def keyword_tags(c: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """The tags with a keyword in the text, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(F.lower(c).rlike("|".join(map(re.escape, ks))), tag) for tag, ks in rules.items()]))


def checkbox_state(c: Column) -> Column:
    """``applicable``, ``not_applicable``, ``conflict`` or ``none`` by the ticked box of a template line."""
    yes, no = c.rlike("[√☑✓]\\s*适用"), c.rlike("[√☑✓]\\s*不适用")
    return F.when(yes & no, "conflict").when(no, "not_applicable").when(yes, "applicable").otherwise("none")


def formula_only(c: Column) -> Column:
    """A display-math block with at least 20 commands and fewer than 20 Han characters."""
    return c.rlike(r"^\s*\$\$[\s\S]*\$\$\s*$") & (F.regexp_count(F.lower(c), F.lit(r"\\[a-z]+")) >= 20) & (F.regexp_count(c, F.lit(f"[{HAN}]")) < 20)


def unit_hint(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?:单位|金额单位|币种)\s*[:：]\s*([^,，;；。.\s]+)", 1), F.lit(""))


def year_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")


def low_information(c: Column) -> Column:
    """Why a passage carries little: empty, numbers only, too short, one word over and over; else null."""
    plain, w = normalise(c), words(c)
    return (
        F.when(F.length(plain) == 0, "empty").when(~plain.rlike(r"(?U)[\p{L}]"), "no_letters").when(F.length(plain) < 20, "too_short")
        .when(F.size(F.array_distinct(w)) * 10 < F.size(w), "repetitive")
    )


#: How names give other names. Each rule takes out what a pattern finds (all), what stands without it (less), or the parts between (split).
ALIAS_RULES = (
    ("less", r"\s*[(（][^()（）]*[)）]"), ("all", r"[(（]([^()（）]+)[)）]"), ("split", r"(?i)\b(?:aka|a\.k\.a\.|also known as)(?=\s|$)"), ("split", "/"),
    ("less", r"(?i)[,\s]+(?:inc|corp|co|ltd|llc|plc|company|corporation|limited|group)\.?$"),
)
#: Fixed value: the longest name that is split at slashes.
SLASH_CHARS = 80


def entity_aliases(name: Column) -> Column:
    """array<string>: the name, then its variants by ALIAS_RULES, then its acronym, each once and none empty; empty for null."""
    name = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    parts = [F.array(name)]
    for kind, pattern in ALIAS_RULES:
        if kind == "less":
            found = F.array(F.regexp_replace(name, pattern, ""))
        elif kind == "all":
            found = F.regexp_extract_all(name, F.lit(pattern), F.lit(1))
        else:
            found = F.split(name, pattern)
        parts.append(F.when(F.length(name) <= SLASH_CHARS, found).otherwise(F.array().cast("array<string>")) if pattern == "/" else found)
    capitals = F.regexp_extract_all(name, F.lit(r"(?<![A-Za-z])([A-Z])"), F.lit(1))
    parts.append(F.when(F.size(capitals) >= 2, F.array(F.array_join(capitals, ""))).otherwise(F.array().cast("array<string>")))
    return F.filter(F.array_distinct(F.transform(F.concat(*parts), lambda x: F.trim(x))), lambda x: x != "")


# --- triples, facts as text, tokens -------------------------------------------------------------


def fact_text(subject: Column, predicate: Column, object_: Column, context: Column | None = None) -> Column:
    """``fact: s ||| p ||| o``, with a context on a second line where there is one."""
    line = F.concat(F.lit("fact: "), F.concat_ws(" ||| ", *[F.coalesce(x, F.lit("")) for x in (subject, predicate, object_)]))
    if context is None:
        return line
    own = F.trim(F.coalesce(context, F.lit("")))
    return F.when(own == "", line).otherwise(F.concat(line, F.lit("\ncontext: "), own))


def parse_fact_text(c: Column) -> Column:
    """struct<subject, predicate, object> of the first line of a fact text, or null."""
    first = F.trim(F.regexp_extract(c, r"^([^\n\r]*)", 1))
    parts = F.transform(F.split(F.regexp_extract(first, r"(?i)^fact:(.*)$", 1), r"\|\|\|", -1), lambda p: F.trim(p))
    good = first.rlike(r"(?i)^fact:") & (F.size(parts) == 3)
    return F.when(good, F.struct(parts[0].alias("subject"), parts[1].alias("predicate"), parts[2].alias("object")))


def valid_triples(triples: Column) -> Column:
    """Of an array of arrays those with three parts, each once, in their order."""
    return F.array_distinct(F.filter(triples, lambda t: F.size(t) == 3))


def json_field(c: Column, name: str) -> Column:
    """A field of the first JSON object that a text holds, whatever stands around it; null where there is none."""
    return F.get_json_object(F.regexp_extract(c, r"(?s)(\{.*\})", 1), f"$.{name}")


def repaired_json(c: Column) -> Column:
    """A JSON text that was cut off, closed again: the open string, a dangling comma or key, then all open brackets.

    Text that parses stays as it is. Brackets inside strings do not count.
    """
    bare = F.regexp_replace(c, r'\\\\.', "")
    quotes = F.length(F.regexp_replace(bare, r'[^"]', ""))
    closed = F.when(quotes % 2 == 1, F.concat(c, F.lit('"'))).otherwise(c)
    trimmed = F.regexp_replace(F.regexp_replace(closed, r'\s+$', ""), r'(,\s*"(?:[^"\\]|\\.)*"\s*:?|,|:)$', "")
    shape = F.regexp_replace(F.regexp_replace(trimmed, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    # What is left of a text's brackets once all closed pairs are gone stands open.
    left = F.aggregate(F.split(shape, ""), F.lit(""), lambda open_, b: F.when(b.isin("]", "}"), F.substring(open_, F.lit(1), F.length(open_) - 1)).otherwise(F.concat(open_, b)))
    ends = F.translate(F.reverse(left), "[{", "]}")
    return F.when(F.try_parse_json(c).isNotNull(), c).otherwise(F.concat(trimmed, ends))


def token_count(c: Column) -> Column:
    """White-space tokens; the reference counts with a model's own vocabulary, which is not at hand."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda t: t != ""))


def truncate_tokens(c: Column, most: int) -> Column:
    """The first ``most`` white-space tokens, joined by single spaces; a text that is short enough stays as it is."""
    t = F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != "")
    return F.when(F.size(t) <= most, c).otherwise(F.array_join(F.slice(t, 1, most), " "))


# --- questions ----------------------------------------------------------------------------------

#: How a question names a unit, in the order in which the rules apply.
REQUESTED_UNITS = (
    (r"单位\s*[：:为]?\s*亿元|多少亿元|以亿元", "unit_conversion_required", "亿元"), (r"单位\s*[：:为]?\s*万元|多少万元|以万元", "unit_conversion_required", "万元"), (r"单位\s*[：:为]?\s*(?:人民币)?元|多少元|以元", "ok", "元"),
    (r"单位\s*[：:为]?\s*股|多少股|股本[^，。；？?]{0,8}(?:股|股份)$", "ok", "股"), (r"%|百分比|百分点|单位\s*[：:为]?\s*比率", "ok", "ratio"),
)
#: Fixed value: how a question names the report of a year.
REPORT_YEAR = r"((?:19|20)\d{2})\s*年?\s*(?:年度报告|年报)"


def requested_unit(question: Column) -> Column:
    """struct<status, unit> that a question asks for."""
    status, unit = None, None
    for pattern, s, u in REQUESTED_UNITS:
        hit = question.rlike(pattern)
        status, unit = (F if status is None else status).when(hit, s), (F if unit is None else unit).when(hit, u)
    return F.struct(status.otherwise("unspecified").alias("status"), unit.alias("unit"))


def question_years(question: Column, report_year: Column) -> Column:
    """struct<status, metric_year, year_resolution>: which year a question about one report asks for.

    Years that name a report must be this one; another year is the metric's, and there may be one at most.
    """
    reports = F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(REPORT_YEAR), F.lit(1)), lambda y: y.cast("int")))
    rest = F.regexp_replace(question, REPORT_YEAR, " ")
    asked = F.array_distinct(F.transform(F.regexp_extract_all(rest, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1)), lambda y: y.cast("int")))
    status = (
        F.when(F.size(reports) > 1, "report_year_ambiguous").when((F.size(reports) == 1) & (F.get(reports, F.lit(0)) != report_year), "report_year_mismatch").when(F.size(asked) > 1, "metric_year_ambiguous").otherwise("ok")
    )
    fine, none = status == "ok", F.size(asked) == 0
    return F.struct(status.alias("status"), F.when(fine, F.coalesce(F.get(asked, F.lit(0)), report_year.cast("int"))).alias("metric_year"), F.when(fine, F.when(none, "default_report_year").otherwise("explicit_metric_year")).alias("year_resolution"))


#: Labels that count, points of a label found, of each shared bigram and of each shared number of three signs and more.
MOST_LABELS, LABEL_POINTS, BIGRAM_POINTS, NUMBER_POINTS = 8, 25.0, 0.7, 5.0


def label_relevance(c: Column, labels: Column) -> Column:
    """How much a text has to do with labels: struct<label, confidence, about>, ``about`` being reason and evidence as one text."""
    few = F.slice(labels, 1, MOST_LABELS)
    named = F.aggregate(few, F.lit(0.0), lambda total, x: total + F.when((x["label"] != "") & F.contains(c, x["label"]), LABEL_POINTS * x["confidence"]).otherwise(0.0))
    asked = F.array_join(F.transform(few, lambda x: F.concat_ws(" ", x["label"], x["about"])), " ")
    grams = F.size(F.filter(han_bigrams(asked), lambda g: F.contains(c, g)))
    numbers = F.array_distinct(_matches(asked, r"\d[\d,.]*%?"))
    shared = F.size(F.filter(numbers, lambda n: (F.length(n) >= 3) & F.contains(c, n)))
    return F.when(F.coalesce(c, F.lit("")) == "", -1.0).otherwise(named + BIGRAM_POINTS * grams + NUMBER_POINTS * shared)
