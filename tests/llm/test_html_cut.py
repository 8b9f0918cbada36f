"""The labelling comes from the cut, and blocks equal those of an independent parser."""

import random
import re
import time
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import functions as F

from factloom.llm import html_extract as h

SF = "/root/testdata/sf0.01"


class _Reference(HTMLParser):
    """Text between block-level tags, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.now, self.raw = [], "", 0

    def flush(self):
        if self.now.strip():
            self.blocks.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        self.raw += tag in h.RAW_TAGS
        if tag in h.BLOCK_TAGS:
            self.flush()

    def handle_endtag(self, tag):
        self.raw -= tag in h.RAW_TAGS
        if tag in h.BLOCK_TAGS:
            self.flush()

    def handle_data(self, data):
        if not self.raw:
            self.now += data


def _reference(page):
    parser = _Reference()
    parser.feed(page)
    parser.close()
    parser.flush()
    return parser.blocks


def _random_page(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.random()
        if kind < 0.4 or depth > 4:
            out.append(rng.choice(["some text ", "a &amp; b", " &lt;x&gt; ", "é\n日本  ", "1.5 ", "&copy;", "<!-- <p>no</p> -->", "<br>", "<img src='a>b'>"]))
        elif kind < 0.5:
            out.append(rng.choice(["<script>var a = 1;</script>", "<style>p {}</style>", "<noscript>off</noscript>"]))
        else:
            tag = rng.choice(["div", "p", "span", "b", "a", "section", "ul", "li", "h2", "table", "td", "article", "aside"])
            out.append(f"<{tag} class='x y' data-a=\"1>2\">{_random_page(rng, depth + 1)}</{tag}>")
    return "".join(out)


def test_blocks_equal_an_independent_parser(spark):
    rng = random.Random(12)
    pages = [_random_page(rng) for _ in range(600)] + [r[0] for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    for page in pages:
        assert [b.text for b in h.blocks(page)] == _reference(page), page


def _article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)
    parts = re.split(r"</?(?:p|h1|br)\b[^>]*>", inner[1]) if inner else []
    return " ".join(x for x in (" ".join(unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in parts) if x)


def test_no_page_loses_or_gains_text(spark):
    rows = h.main_text(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect()
    assert rows and all(r["text"] == _article(r["html"]) for r in rows)


def test_the_cut_changes_labels(spark):
    """By their own statistics many blocks go wrong; so would the pages if the edges were left out."""
    changed = wrong = 0
    for (page,) in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect():
        found = h.blocks(page)
        source, sink, edges = h.graph(found)
        own = [a > b for a, b in map(h.costs, found)]
        changed += sum(a != b for a, b in zip(own, h.min_cut(source, sink, edges)))
        wrong += " ".join(b.text for b, keep in zip(found, h.min_cut(source, sink, [])) if keep) != _article(page)
    assert changed > 100 and wrong > 50


def test_neighbours_decide_where_no_element_speaks():
    long = "<p>" + "A sentence about rivers and towns. " * 6 + "</p>"
    page = f"<div><div><a href=/a>One</a></div><div><a href=/b>Two</a></div><div>{long}<p>Yes</p>{long}</div><div><a href=/c>Three</a></div></div>"
    found = h.blocks(page)
    short = next(i for i, b in enumerate(found) if b.text == "Yes")
    assert h.costs(found[short])[0] < h.costs(found[short])[1]  # alone it would go
    assert h.extract(page) == " ".join(("A sentence about rivers and towns. " * 6 + "| Yes | " + "A sentence about rivers and towns. " * 6).replace("|", " ").split())


def test_class_words_are_mild():
    comment = "<div class='comment'><p>" + "I liked this article a lot, thank you. " * 8 + "</p></div>"
    assert h.extract(f"<article><p>{'The article itself goes on here. ' * 9}</p></article>{comment}") == ("The article itself goes on here. " * 9).strip()
    assert h.extract("<article><h1>Of</h1><p>So</p></article><div class=ad>Buy one now and get another one for free today.</div>") == "Of So"


def test_clashing_columns(spark):
    rows = spark.range(3).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("<article><p>Some text.</p></article>").alias("html"), F.lit(1).alias("text"), F.lit("x").alias("n_chars"))
    assert [(r["text"], r["n_chars"]) for r in h.main_text(rows).collect()] == [("Some text.", 10)] * 3


def test_smoothness_alone_decides_pages(spark):
    """Without edges between neighbours, the ties to elements left in place, pages lose lines of their article."""
    wrong = changed = 0
    for (page,) in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect():
        found = h.blocks(page)
        source, sink, edges = h.graph(found)
        near = {(i, j) for i, j, _ in h.smoothness(found)}
        without = h.min_cut(source, sink, [e for e in edges if e[:2] not in near])
        changed += sum(a != b for a, b in zip(h.min_cut(source, sink, edges)[: len(found)], without))
        wrong += " ".join(b.text for b, keep in zip(found, without) if keep) != _article(page)
    assert wrong > 10 and changed > 10


def _nearest(page):
    """The text by the nearest element that speaks, and by nothing else."""
    return " ".join(b.text for b in h.blocks(page) if b.spoken and b.spoken[1] > 0)


PROSE = "The river rises in the hills above the town and meets the sea below the old harbour wall. "


def test_labels_are_not_those_of_the_nearest_element_that_speaks():
    long = (PROSE * 9).strip()
    # Much text weighs more than a class word that layouts use for anything.
    assert h.extract(f"<body><div class=widget><p>{long}</p></div><div class=widget><a href=/x>More</a></div></body>") == long != _nearest(f"<div class=widget><p>{long}</p></div>")
    # Where nothing speaks, statistics and neighbours find the text, and leave the links out.
    page = f"<body><div><a href=/1>Home</a></div><div><p>{long}</p><p>Indeed</p><p>{long}</p></div><div><a href=/2>About</a></div></body>"
    assert h.extract(page) == f"{long} Indeed {long}" and _nearest(page) == ""
    # Links inside an article are no part of it because it stands around them.
    links = "<ul>" + "".join(f"<li><a href=/{i}>Elsewhere {i}</a></li>" for i in range(6)) + "</ul>"
    page = f"<article><p>{long}</p><p>{long}</p>{links}</article>"
    assert h.extract(page) == f"{long} {long}" != _nearest(page)
    # What readers write reads like an article; there the word counts more.
    assert h.extract(f"<article><p>{long}</p></article><div class=comments><p>{long}</p></div>") == long


def test_articles_of_short_lines_stay_whole():
    for lines in (["So"], ["a", "b"], ["x"] * 200, ["one two", "three"] * 50 + [PROSE.strip()] * 3):
        assert h.extract("<nav><a href=/>x</a></nav><article><h1>Of</h1>" + "".join(f"<p>{x}</p>" for x in lines) + "</article><footer>All rights</footer>") == " ".join(["Of", *lines])


def test_deep_and_long_pages_stay_cheap():
    began = time.process_time()
    assert h.extract("<div>a b c " * 100_000) == ""
    assert h.extract("<article>" + "<p>x" * 50_000) == " ".join(["x"] * 50_000)
    assert h.extract("<div></x><b>" * 50_000) == ""
    assert time.process_time() - began < 30
