"""Numeric authorization: what a structured result allows an answer to write, and which claims it covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import plain
from factloom.operators.fusion import deduplicate_authorizations

#: Enumeration signs that are no numbers, and how a financial number is written.
CIRCLED = "[\\x{2460}-\\x{2473}\\x{3251}-\\x{325f}\\x{32b1}-\\x{32bf}]"
NUMBER = r"(?<![A-Za-z0-9])[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?(?:[%％]|(?:万|亿|千|百)?(?:亿元|万元|元|股|人|次|倍))?"
#: What stands around numbers that are ordinals, years, dates or list marks.
BEFORE = r"(?:序号|章节|附注|排名)\s*"
ORDINALS, DATES = "章|节|条|项|款|名|位|期|届|次", "月|日|号"
SCALES = (("万", "0.0001"), ("亿", "0.00000001"))
IDENTITY = ["entity_key", "document_id", "measure_kind", "measure", "measure_year", "normalized_value", "normalized_unit"]


def _kept(value: Column, places: int) -> Column:
    """Decimal text without trailing zeros beyond ``places`` decimals; zero is 0."""
    text = value.cast("string")
    short = F.regexp_replace(text, rf"(\.\d{{{places}}}\d*?)0+$", "$1") if places else plain(value)
    return F.when(value == 0, "0").otherwise(short)


def renderings(value: Column, unit: Column, places: int) -> Column:
    """Sorted texts by which an answer may write a value of ``places`` decimals.

    The value as it stands; a whole one without decimals, another without trailing
    zeros and to two places; a ratio as a percentage; money and shares with their unit,
    in units, in 万 and in 亿, exact and to two places.
    """
    exact = value.cast("decimal(28,12)")
    two = lambda x: F.round(x, 2).cast("decimal(38,2)").cast("string")
    raw, whole = F.when(value == 0, "0").otherwise(value.cast("string")), exact == F.floor(exact)
    parts = [raw, F.when(whole, F.floor(exact).cast("decimal(38,0)").cast("string")).otherwise(plain(value)), F.when(~whole, two(exact))]
    percent = two(exact * F.lit("100").cast("decimal(3,0)"))
    ratio, counted = unit == "ratio", unit.isin("元", "股")
    parts += [F.when(ratio, percent), F.when(ratio, F.concat(percent, F.lit("%"))), F.when(counted | (unit == "元/股"), F.concat(raw, unit))]
    for word, factor in SCALES:
        scaled = exact * F.lit(factor).cast(f"decimal({len(factor) - 1},{len(factor) - 2})")
        for text in (_kept(scaled, places), two(scaled)):
            parts.append(F.when(counted, F.concat(text, F.lit(word), unit)))
    return F.sort_array(F.array_except(F.array(*parts), F.array(F.lit(None).cast("string"))))


def authorization_set(rows: DataFrame, places: int = 4) -> DataFrame:
    """Authorizations of usable results, each identity once, from the first backend that has it.

    rows: backend, source_id, row (its place in the source), entity_key, company,
    document_id, measure_kind, measure, measure_year, normalized_value,
    normalized_unit, citation_ids. Items without citations are no authorization.
    """
    usable = rows.filter(F.size("citation_ids") > 0).withColumn("citation_ids", F.array_sort(F.array_distinct("citation_ids")))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    known = F.concat_ws("|", *[text(c) for c in ("backend", "source_id", "row", *IDENTITY)])
    marked = usable.withColumn("authorization_id", F.concat(F.lit("auth_"), F.substring(F.sha2(known, 256), 1, 20)))
    once = deduplicate_authorizations(marked.withColumn("id", F.struct("source_id", "row", "authorization_id")), IDENTITY).drop("id")
    return once.withColumn("allowed_renderings", renderings(F.col("normalized_value"), F.col("normalized_unit"), places))


def items(facts: DataFrame, backend: str | Column, kind: str | Column, source_id: Column, row: Column) -> DataFrame:
    """Rows of facts as items of an authorization set, each citing its fact; formula operands and ranked rows are facts too."""
    return facts.select(
        F.lit(backend).alias("backend"), source_id.alias("source_id"), row.cast("int").alias("row"), F.col("stock_code").alias("entity_key"), F.col("stock_code").alias("company"), "document_id",
        F.lit(kind).alias("measure_kind"), F.col("canonical_metric").alias("measure"), F.col("metric_year").alias("measure_year"), "normalized_value", "normalized_unit",
        F.array("fact_id").alias("citation_ids"),
    )


def normal_rendering(token: Column) -> Column:
    """Thousands marks, spaces and the full-width percent sign do not tell renderings apart."""
    return F.translate(F.regexp_replace(token, r"(?U)\s+", ""), "％,", "%")


def matching_authorizations(claims: DataFrame, authorizations: DataFrame) -> DataFrame:
    """(claim_id, token, authorization_id): the authorizations in whose scope a claim's number lies.

    claims: claim_id, token, entity_key, company, document_id, measure, measure_year.
    Scope is the entity, company and document, the measure and its year, and one of
    the allowed renderings. ``authorizations`` is a set, which has each id once. A join
    on what a claim speaks of; the renderings stay an array, so that no row is made of
    each way to write a value.
    """
    scope = ["entity_key", "company", "document_id", "measure", "measure_year"]
    granted = authorizations.select("authorization_id", *scope, "allowed_renderings")
    asked = claims.select("claim_id", "token", *scope, normal_rendering(F.col("token")).alias("rendering"))
    # Most renderings are normal as they are written; only where none of them fits are they made so.
    fits = F.array_contains("allowed_renderings", F.col("rendering")) | F.array_contains(F.transform("allowed_renderings", normal_rendering), F.col("rendering"))
    same = [asked[c] == granted[c] for c in scope]
    return asked.join(granted, [*same, fits], "left").select("claim_id", "token", "authorization_id")


def financial_tokens(text: Column, stock_code: Column) -> Column:
    """The numbers of a text that state a value: no years, dates, codes, ordinals or list marks.

    The text is cut at its numbers, so that each is seen with what stands before and
    behind it. Enumeration signs in circles are taken away first.
    """
    bare = F.translate(F.regexp_replace(text, CIRCLED, ""), "０１２３４５６７８９，．＋－（）％", "0123456789,.+-()%")
    found, around = F.regexp_extract_all(bare, F.lit(f"({NUMBER})"), F.lit(1)), F.split(bare, NUMBER, -1)
    rows = F.zip_with(F.zip_with(found, F.slice(around, 1, F.size(found)), lambda t, b: F.struct(t.alias("t"), b.alias("b"))), F.slice(around, 2, F.greatest(F.size(found), F.lit(1))), lambda x, a: F.struct(x["t"].alias("t"), x["b"].alias("b"), F.left(a, F.lit(5)).alias("a")))

    def states_value(x: Column) -> Column:
        token, before, after = x["t"], x["b"], x["a"]
        digits = F.regexp_replace(F.regexp_replace(token, r"^[+-]", ""), ",", "")
        short = token.rlike(r"^\d{1,2}$")
        year = F.split(digits, r"\.")[0].rlike(r"^(19|20|21)\d{2}$") & after.rlike(r"^\s*年")
        mark = short & (after.rlike(r"^\s*、") | (before.rlike(r"[（(]\s*$") & after.rlike(r"^\s*[）)]")))
        at_line = ((before == "") | before.rlike(r"\n$")) & after.rlike(r"^\s*[、.)）]")
        ordinal = before.rlike(r"第\s*$") & after.rlike(rf"^\s*(?:{ORDINALS})")
        other = after.rlike(rf"^\s*(?:{DATES})") | before.rlike(rf"{BEFORE}$")
        return ~(year | mark | at_line | ordinal | other | F.coalesce(F.regexp_replace(token, r"^[+-]", "") == stock_code, F.lit(False)))

    return F.transform(F.filter(rows, states_value), lambda x: x["t"])
