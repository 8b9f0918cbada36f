"""What a passage is worth as an answer: its class, and how much it has to do with a question.

Texts are compared in their compatibility form. Spark has no function for that form, so one Arrow
pass per text column makes it; all rules after it are Spark's own functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import let, nfkc, normalise

# --- Fixed values: the patterns and words by which passages are told apart ----------------------------------------------

_HAN = "\\x{3400}-\\x{9fff}"
LETTER, SIGN = f"[{_HAN}A-Za-z]", f"[{_HAN}A-Za-z0-9]"
ORDINAL = r"[一二三四五六七八九十百零〇\d]+"
YEAR = r"(?<!\d)(?:19|20|21)\d{2}\s*年?"
REDIRECT = rf"(?:具体)?(?:请参见|请参阅|详见|参见|请见)(?:本报告|报告|本节|下文|上文|第{ORDINAL}[章节部分项]|附注|附件|相关章节|有关章节)?"
REDIRECT_SUBJECT = "(?:有关|相关|上述|该等|具体|其他)?(?:情况|事项|内容|信息|详情|说明)?(?:可)?"
CHECKBOX = r"([□☐○◯■☑√✓✔])\s*(?:(?:本年度|本年)?\s*)(适用|不适用)"
TICKED = "[■☑√✓✔]"
NEGATIVE = "不适用|无|否|未发生|不存在|没有|并无|无需|未涉及|未受到"
UNIT_VALUE = "(?:人民币|美元|港币|欧元)?(?:元|万元|亿元|千元|百万元|股|万股|人|万人|户|家|次|倍|%|％|平方米|万平方米|吨|万吨|千瓦时|万千瓦时)|人民币|美元|港币|欧元"
UNIT_LABEL = "单位|金额单位|计量单位|币种"
SEPARATOR = ":?-{3,}:?"
HEADER_CELL = "序号|项目|项目名称|科目|名称|类别|类型|指标|年份|年度|日期|本期|上期|本年|上年|期初|期末|本期数|上期数|本年数|上年数|本期金额|上期金额|金额|数量|比例|占比|同比|变动比例|备注|说明|合计"
DOCUMENT_TITLE = r"(?:\S{2,50}(?:股份有限公司|有限责任公司|集团有限公司|公司)\s*)?(?:(?:19|20|21)\d{2}\s*年?)?(?:半年度|年度|季度)?报告(?:摘要|全文)?"
HEADING_START = rf"^(?:第{ORDINAL}[章节部分篇]|{ORDINAL}[、.)）]|[（(]{ORDINAL}[）)])\s*\S"
HEADING_END = "(?:情况|事项|概况|说明|分析|讨论|意见|报告|信息|构成|结构|制度|管理|治理|业务|模式|风险|计划|战略|展望|目录|指标|数据|变化)$"
TOPIC = "(?:诉讼仲裁|重大诉讼|重大仲裁|关联交易|现金流量|营业收入|研发投入|审计意见|固定资产|核心竞争力|行业地位)$"
HEADING_SUBJECT = "公司|董事会|股东大会|报告期"
SENTENCE_END, BOX_OR_COLON = "[。！？；;]", "[：:√✓✔☑□☐]"
FACT_VERB = "为|是|达到|达成|增长|下降|增加|减少|实现|完成|获得|拥有|持有|发生|未发生|存在|不存在|包括|构成|占比|同比|环比|续聘|聘任|解聘|出具|发表|支付|收到|投入|生产|销售|签订|终止|转让|处置|设立|成立|导致|带来|影响|面临"
FACT_PHRASE = "标准无保留意见|无保留意见|保留意见|否定意见|无法表示意见|未发现重大缺陷|无重大诉讼|无重大仲裁|不构成重大影响"
LABELLED_NUMBER = rf"{LETTER}{{2}}.{{0,18}}\d|\d.{{0,12}}{LETTER}{{2}}"
BOILERPLATE = (
    "(?:董事会|监事会).{0,35}(?:保证|承诺).{0,30}(?:真实|准确|完整)", "不存在虚假记载、?误导性陈述或重大遗漏", "(?:全体董事|全体监事).{0,25}(?:异议|保证)", "公司严格按照.{0,40}(?:公司法|证券法).{0,45}(?:规范运作|治理)",
    "(?:不断|持续)(?:建立健全|健全|完善).{0,25}(?:治理结构|内控制度|内部控制制度)", "依法依规.{0,20}履行信息披露义务", "(?:股东大会|董事会|监事会).{0,35}(?:各司其职|规范运作|依法运作)", "按照.{0,30}审计准则.{0,30}(?:执行|开展|实施)(?:了)?审计工作",
    "(?:已获取|获取的)审计证据.{0,25}(?:充分|适当)", "管理层负责.{0,35}(?:编制|财务报表|内部控制)", "(?:仅供参考|不构成投资建议|敬请投资者注意投资风险)",
)
CONCERNS = {
    "business": ("主营业务", "主要业务", "经营模式", "业务模式", "产品服务"), "revenue": ("营业收入", "营收", "收入", "销售收入"), "profit": ("净利润", "利润", "盈利", "亏损"),
    "cash_flow": ("现金流量", "现金流", "经营活动现金", "投资活动现金", "筹资活动现金"), "research": ("研发", "研究开发", "技术创新", "专利"), "employee": ("员工", "职工", "人员构成", "人才"),
    "customer": ("客户", "客户集中度"), "supplier": ("供应商", "供应商集中度"), "audit_opinion": ("审计意见", "审计报告", "无保留意见", "保留意见"), "auditor": ("会计师事务所", "审计机构", "续聘", "聘任审计"),
    "governance": ("公司治理", "治理结构", "董事会", "监事会", "股东大会"), "internal_control": ("内部控制", "内控", "重大缺陷"), "litigation": ("诉讼", "仲裁"), "penalty": ("处罚", "整改", "监管措施", "纪律处分"),
    "delisting": ("退市", "暂停上市", "终止上市"), "bankruptcy": ("破产", "重整"), "contract": ("重大合同", "重要合同", "合同履行"), "related_party": ("关联交易", "关联方交易"), "asset": ("资产", "固定资产", "资产变动", "资产处置"),
    "liability": ("负债", "偿债", "债务"), "dividend": ("分红", "利润分配", "现金红利", "股利"), "risk": ("风险", "不利因素", "挑战", "风险管控"), "environment": ("环境保护", "环保", "排污", "污染", "碳排放"),
    "strategy": ("发展战略", "发展规划", "未来计划", "经营计划"),
}
QUESTION_PHRASES = "股份有限公司 有限责任公司 年度报告 年报 报告期内 报告期 本年度 请问 请说明 说明一下 请介绍 介绍一下 概述一下 概述 介绍 说明 有关 相关 具体 主要 情况 事项 是什么 有哪些 怎么样 如何 是否 公司".split()
PARTICLES = "[的了着和与及并]"
TERM_STOP = "股份 有限 年度 报告 年报 公司 本年 情况 事项 介绍 说明 概述 相关 有关 具体 主要 什么 哪些 如何 是否 请问 报告期 期内".split()
#: Points of a shared concern and of a shared character in text; signs of a heading, of a question in a heading, of a fact, of a fact beside a redirect, of a short text; lengths of terms.
CONCERN_POINTS, TEXT_POINTS = 100, 3
HEADING_SIGNS, ASKED_SIGNS, FACT_SIGNS, RESIDUAL_SIGNS, SHORT_SIGNS, TERM_SIGNS = 45, 60, 5, 6, 12, (2, 4)
#: Characters of a long text in which signs are looked for first.
HEAD = 512

# --- rules ---------------------------------------------------------------------------------------------------------------

#: A full-width bar would turn into one that divides cells; it waits behind a private character.
_BAR, _HELD = "｜", "\ue000"


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _whole(c: Column, pattern: str) -> Column:
    return c.rlike(f"^(?:{pattern})$")


def _signs(c: Column) -> Column:
    """How many signs a text has; of more than any rule asks for, only that there are more, which the beginning of a long text tells."""
    counted = lambda x: F.length(F.regexp_replace(x, f"[^{SIGN[1:-1]}]+", ""))
    return F.when((F.length(c) > HEAD) & (counted(F.left(c, F.lit(HEAD))) > ASKED_SIGNS), ASKED_SIGNS + 1).otherwise(counted(c))


def _key(c: Column) -> Column:
    """Letters and digits of a normal text, in lower case."""
    return F.regexp_replace(F.lower(c), r"(?U)[\s\W_]+", "")


def concerns(key: Column) -> Column:
    """array<struct<name, words>>: the concerns that a text (its letters and digits only) speaks of."""
    known = F.array(*[F.struct(F.lit(name).alias("name"), _strings(words).alias("words")) for name, words in CONCERNS.items()])
    return let(key, lambda k: F.filter(known, lambda g: F.exists(g["words"], lambda w: F.contains(k, w))))


def question_terms(plain: Column) -> Column:
    """The distinct terms of a question: Latin words, and grams of 2 to 4 characters of other runs; years, phrases and particles aside."""
    c = F.regexp_replace(F.lower(plain), YEAR, "")
    for phrase in QUESTION_PHRASES:
        c = F.replace(c, F.lit(phrase), F.lit(""))
    runs = F.regexp_extract_all(F.regexp_replace(c, PARTICLES, ""), F.lit(f"({LETTER}+)"), F.lit(1))
    least, most = TERM_SIGNS

    def terms(run: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(run))
        grams = F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(least), F.lit(most)), lambda n: F.when(i + n - 1 <= F.length(run), F.substring(run, i, n)))))
        latin = F.when(F.length(run) >= least, F.array(run)).otherwise(F.array().cast("array<string>"))
        return F.when(run.rlike("^[A-Za-z]+$"), latin).otherwise(F.filter(F.array_compact(grams), lambda g: ~F.array_contains(_strings(TERM_STOP), g)))

    return F.array_distinct(F.flatten(F.transform(runs, terms)))


def _shared(groups: Column, *keys: Column) -> Column:
    def spoken(w: Column) -> Column:
        hit = F.contains(keys[0], w)
        for key in keys[1:]:
            hit = hit | F.contains(key, w)
        return hit

    return F.transform(F.filter(groups, lambda g: F.exists(g["words"], spoken)), lambda g: g["name"])


def _points(terms: Column, key: Column) -> Column:
    return F.aggregate(terms, F.lit(0), lambda total, t: total + F.when(F.contains(key, t), F.length(t)).otherwise(0))


def _labelled(c: Column) -> Column:
    """A number near letters. That a text has a digit is looked at first, as the pattern is dear on long texts without one."""
    return c.rlike(r"\d") & c.rlike(LABELLED_NUMBER)


def _fact(c: Column) -> Column:
    """Phrases and verbs are Han, so that texts without such characters are read once for all of them."""
    return _labelled(c) | (c.rlike(f"[{_HAN}]") & (c.rlike(FACT_PHRASE) | ((_signs(c) >= FACT_SIGNS) & c.rlike(FACT_VERB))))


def _rows_of_cells(folded: Column) -> Column:
    """array<array<string>>: the cells that are not empty, of each line with a bar."""
    barred = F.filter(F.split(folded, r"\R|[\x1c-\x1e]"), lambda line: F.contains(line, F.lit("|")))
    return F.transform(barred, lambda line: F.filter(F.transform(F.split(line, r"\|"), normalise), lambda cell: cell != ""))


def _unit_only(plain: Column, cells: Column) -> Column:
    bare = F.regexp_replace(plain, r"^[| ]+|[| ]+$", "")
    direct = F.regexp_replace(bare, rf"^(?:{UNIT_LABEL})\s*[:：]?\s*", "")
    clean = F.transform(cells, lambda x: F.regexp_replace(x, "[:：]+$", ""))
    of_cells = F.exists(clean, lambda x: _whole(x, UNIT_VALUE)) & F.forall(clean, lambda x: _whole(x, UNIT_VALUE) | _whole(x, UNIT_LABEL) | _whole(x, SEPARATOR))
    return ((direct != bare) & _whole(direct, UNIT_VALUE)) | F.when(F.size(cells) == 0, _whole(bare, UNIT_VALUE)).otherwise(of_cells)


def _table_header(plain: Column, rows: Column, cells: Column) -> Column:
    """Nothing below the line that parts header and body, and only header words above; without that line, header words only."""
    filled = F.filter(rows, lambda row: F.size(row) > 0)
    parts = F.transform(filled, lambda row: F.forall(row, lambda x: _whole(x, SEPARATOR)))
    at = F.array_position(parts, F.lit(True))
    words_only = F.forall(F.flatten(F.slice(filled, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))), lambda x: _whole(x, HEADER_CELL))
    loose = F.filter(cells, lambda x: ~_whole(x, SEPARATOR))
    words = F.filter(F.split(plain, r"[\s、,/]+"), lambda w: w != "")
    all_words = plain.rlike(rf"^[\s、,/]*(?:{HEADER_CELL})(?:[\s、,/]|$)") & (F.size(words) >= 2) & F.forall(words, lambda w: _whole(w, HEADER_CELL))
    return F.when(at > 0, (at == F.size(filled)) & words_only).when(F.size(loose) >= 2, F.forall(loose, lambda x: _whole(x, HEADER_CELL))).otherwise(all_words)


def _heading(raw: Column, plain: Column, fact: Column, signs: Column) -> Column:
    short, ended = signs <= HEADING_SIGNS, plain.rlike(SENTENCE_END)
    asks = F.contains(plain, F.lit("是否")) & (signs <= ASKED_SIGNS) & ~plain.rlike(BOX_OR_COLON) & ~ended
    marked = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "").rlike(r"^#{1,6}\s+[^\n]+\z")
    closes = short & ~ended & plain.rlike(HEADING_END) & ~plain.rlike(HEADING_SUBJECT) & ~_labelled(plain)
    return (
        F.when(_whole(plain, DOCUMENT_TITLE) | asks, True).when(marked, ~_fact(F.regexp_replace(plain, r"^#{1,6}\s+", ""))).when(closes, True)
        .when(fact | ended, False).otherwise(short & (plain.rlike(HEADING_START) | plain.rlike(HEADING_END) | plain.rlike(TOPIC)))
    )


def _redirect(plain: Column, groups: Column, terms: Column) -> Column:
    """It points elsewhere, and nothing beside the pointers is a fact about what the question asks."""

    def tells(rest: Column) -> Column:
        about = let(_key(rest), lambda key: (F.size(_shared(groups, key)) > 0) | F.exists(terms, lambda t: F.contains(key, t)))
        return (rest != "") & ~_whole(rest, REDIRECT_SUBJECT) & (_signs(rest) >= RESIDUAL_SIGNS) & _fact(rest) & about

    clauses = F.transform(F.split(plain, "[。！？；;,，]"), lambda x: F.trim(F.regexp_replace(F.trim(x), f"(?:{REDIRECT}).*$", "")))
    return plain.rlike(f"[{_HAN}]") & plain.rlike(REDIRECT) & ~F.exists(clauses, tells)


def _ticked_negative(plain: Column) -> Column:
    """Two boxes, of which the one of what does not apply is ticked."""
    boxes, labels = (F.regexp_extract_all(plain, F.lit(CHECKBOX), F.lit(k)) for k in (1, 2))
    pairs = F.array_sort(F.zip_with(boxes, labels, lambda box, label: F.concat(F.when(box.rlike(TICKED), "1").otherwise("0"), label)))
    return F.contains(plain, F.lit("适用")) & (pairs == F.array(F.lit("0适用"), F.lit("1不适用")))


def classified(rows: DataFrame, text: str, question: str, path: str, scoped: Column | None = None) -> DataFrame:
    """Adds to each row what its passage is worth for its question.

    Columns read: ``text`` and ``question`` (string; null is empty), ``path`` (array<string>, the titles above the passage; null is empty).
    ``scoped``: whether a ticked box is known to belong to the question's own section.

    Adds ``usable``, ``reason``, ``matched_concerns`` (sorted), ``concern_score`` (100 a shared concern, 3 a character of terms in the text,
    1 in the titles), ``content_score`` and ``path_score`` (the same for text and titles alone). An empty passage is not usable.
    Rows are judged one by one: no shuffle.
    """
    titles = F.array_join(F.filter(F.transform(F.coalesce(F.col(path), F.array().cast("array<string>")), lambda t: normalise(t)), lambda t: t != ""), " ")
    given = {"__raw": F.coalesce(F.col(text), F.lit("")), "__titles": titles, "__asked": F.coalesce(F.col(question), F.lit(""))}
    rows = rows.withColumns(given)
    rows = rows.withColumns({"__folded": nfkc(F.translate("__raw", _BAR, _HELD)), "__titles": nfkc(F.col("__titles")), "__asked": nfkc(F.col("__asked"))})
    rows = rows.withColumns({"__plain": normalise(F.translate("__folded", _HELD, "|")), "__asked": normalise(F.col("__asked"))})
    rows = rows.withColumns({"__key": _key(F.col("__plain")), "__title_key": _key(normalise(F.col("__titles"))), "__groups": concerns(_key(F.col("__asked"))), "__terms": question_terms(F.col("__asked")), "__rows": _rows_of_cells(F.col("__folded")), "__signs": _signs(F.col("__plain")), "__fact": _fact(F.col("__plain"))})
    plain, key, title, groups, terms, signs, fact = (F.col(c) for c in ("__plain", "__key", "__title_key", "__groups", "__terms", "__signs", "__fact"))
    in_text, in_title = _points(terms, key), _points(terms, title)
    rows = rows.withColumns({
        "matched_concerns": F.array_sort(_shared(groups, key, title)), "content_score": F.size(_shared(groups, key)) * CONCERN_POINTS + in_text * TEXT_POINTS,
        "path_score": F.size(_shared(groups, title)) * CONCERN_POINTS + in_title, "concern_score": F.size(_shared(groups, key, title)) * CONCERN_POINTS + in_text * TEXT_POINTS + in_title,
    })
    cells, known = F.flatten("__rows"), F.lit(False) if scoped is None else F.coalesce(scoped, F.lit(False))
    negative, about = _ticked_negative(plain) | _whole(key, NEGATIVE), F.col("concern_score") > 0
    reason = (
        F.when(plain == "", "empty").when(negative & (known | about), "scoped_checkbox_negative").when(_redirect(plain, groups, terms), "redirect_only").when(_unit_only(plain, cells), "unit_only")
        .when(_table_header(plain, F.col("__rows"), cells), "table_header").when(_heading(F.col("__raw"), plain, fact, signs), "heading_or_document_title").when(plain.rlike(f"[{_HAN}]") & plain.rlike("|".join(BOILERPLATE)), "audit_or_governance_boilerplate")
        .when(fact, "explicit_fact").when((signs < SHORT_SIGNS) & ~about, "short_without_question_concern").when(negative, "unscoped_negative").otherwise("substantive")
    )
    out = rows.withColumn("reason", reason).withColumn("usable", F.col("reason").isin("scoped_checkbox_negative", "explicit_fact", "substantive"))
    return out.drop(*[c for c in out.columns if c.startswith("__")])
