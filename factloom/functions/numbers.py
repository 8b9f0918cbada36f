"""Numbers in tables: parsing, units, plain decimal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import compact, let, normalise

#: Texts that stand for no value.
NULL_MARKERS = ("", "-", "--", "---", "—", "–", "－", "不适用", "不适用。", "无", "N/A", "n/a", "NA", "na", "null", "None")
#: Unit rules, alias -> (rule, normalised unit, multiplier).
UNITS = {
    "元": ("money_yuan", "元", "1"), "人民币元": ("money_yuan", "元", "1"), "人民币": ("money_yuan", "元", "1"), "万元": ("money_wanyuan", "元", "10000"),
    "人民币万元": ("money_wanyuan", "元", "10000"), "千元": ("money_qianyuan", "元", "1000"), "人民币千元": ("money_qianyuan", "元", "1000"), "亿元": ("money_yiyuan", "元", "100000000"),
    "人民币亿元": ("money_yiyuan", "元", "100000000"), "%": ("ratio_percent", "ratio", "0.01"), "百分比": ("ratio_percent", "ratio", "0.01"), "人": ("count_person", "人", "1"),
    "人数": ("count_person", "人", "1"), "股": ("share_count", "股", "1"), "元/股": ("money_per_share", "元/股", "1"), "元／股": ("money_per_share", "元/股", "1"),
}
_NUMBER = r"[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"


def _unit(alias: Column, place: int) -> Column:
    rules = F.create_map(*[x for a, rule in UNITS.items() for x in (F.lit(a), F.lit(rule[place]))])
    return rules[alias]


def unit_rule(alias: Column, place: int) -> Column:
    """Of a unit as written: its rule (0), the unit it stands for (1) or its multiplier as text (2), or null."""
    return _unit(alias, place)


def unit_of_label(label: Column) -> Column:
    """The unit that a label states in brackets or after 单位, or null."""
    return let(compact(label), _unit_in)


def _unit_in(text: Column) -> Column:
    inside = F.regexp_extract(text, r"\(([^()]{1,40})\)", 1)
    hinted = F.regexp_extract(text, r"(?:单位|金额单位|币种)[:：]?([^,，;；。.]+)", 1)
    found = [let(x, lambda x: F.when(_unit(x, 0).isNotNull(), x)) for x in (F.regexp_replace(inside, "^(单位|金额单位|币种)[:：]?", ""), hinted)] + [F.when(_unit(text, 0).isNotNull(), text)]
    return F.coalesce(*found)


def parse(raw: Column) -> Column:
    """struct<status, value, raw_unit, error>: parsed, missing or unparseable."""
    missing = normalise(raw).isin(*NULL_MARKERS) | raw.isNull()
    pattern = rf"^(?:人民币)?({_NUMBER})([\x{{4e00}}-\x{{9fff}}A-Za-z%/]+)?$"

    def told(x: Column) -> Column:
        """From what the text says: whether it is missing, whether it is a number, its unit and its value."""
        unknown = x["unit"].isNotNull() & _unit(x["unit"], 0).isNull()
        status = F.when(x["missing"], "missing").when(~x["matched"] | unknown | x["number"].isNull(), "unparseable").otherwise("parsed")
        error = F.when(x["missing"], "null_marker").when(~x["matched"], "not_numeric").when(unknown, "unknown_unit_suffix").when(x["number"].isNull(), "invalid_decimal")
        return F.struct(status.alias("status"), F.when(status == "parsed", x["number"]).alias("value"), F.when(~x["missing"], x["unit"]).alias("raw_unit"), error.alias("error"))

    def read(x: Column) -> Column:
        matched = x["inner"].rlike(pattern)
        number = F.when(matched, F.regexp_replace(F.regexp_extract(x["inner"], pattern, 1), ",", "")).try_cast("decimal(38,12)")
        unit = F.nullif(F.regexp_extract(x["inner"], pattern, 2), F.lit(""))
        return let(F.struct(x["bracketed"].alias("bracketed"), matched.alias("matched"), unit.alias("unit"), number.alias("number"), missing.alias("missing")), signed)

    def signed(x: Column) -> Column:
        number = F.when(x["bracketed"] & (x["number"] > 0), -x["number"]).otherwise(x["number"])
        return let(F.struct(x["missing"].alias("missing"), x["matched"].alias("matched"), x["unit"].alias("unit"), number.alias("number")), told)

    def opened(text: Column) -> Column:
        bracketed = text.rlike(r"^\(.*\)$")
        inner = F.when(bracketed, F.regexp_replace(text, r"^\((.*)\)$", "$1")).otherwise(text)
        return let(F.struct(bracketed.alias("bracketed"), inner.alias("inner")), read)

    return let(compact(raw), opened)


def normalise_number(raw: Column, row_label: Column, column_label: Column, hint: Column) -> Column:
    """struct<status, value, unit, unit_source>: the first of value, row, column and hint that has a unit decides."""
    p = parse(raw)
    sources = [("raw_value", p["raw_unit"]), ("row_label", unit_of_label(row_label)), ("column_label", unit_of_label(column_label)), ("unit_hint", unit_of_label(hint))]
    alias = F.coalesce(*[u for _, u in sources])
    source = F.coalesce(*[F.when(u.isNotNull(), name) for name, u in sources])
    scale = F.coalesce(_unit(alias, 2), F.lit("1")).cast("decimal(12,2)")
    value = (p["value"].cast("decimal(26,12)") * scale).cast("decimal(38,12)")
    return F.struct(p["status"].alias("status"), value.alias("value"), _unit(alias, 1).alias("unit"), source.alias("unit_source"))


def plain(value: Column) -> Column:
    """A decimal without trailing zeros and without an exponent; whole numbers keep theirs."""
    text = value.cast("string")
    return F.when(text.contains("."), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)
