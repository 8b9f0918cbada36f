import hashlib
import time
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import chat, fingerprint, html_extract, quality, sentencepieces, sharding, toxicity
from tests.llm.by_hand import attention_by_hand, weight_by_hand
from tests.llm.conftest import HARD

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# --- op4 --------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>Title</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header><a href=/>Logo</a></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site.</div>
<main><article><h1>The &amp; heading</h1><p>First <b>para</b>graph, with&nbsp;words in   it.<br>After the break.<p>Second paragraph stands here unclosed.
<ul><li>A point of the article.<li>Another point.</ul><aside class="sidebar">Related: buy this</aside>
<form><input><button>Send</button></form></article>
<section id="comments"><h2>Comments</h2><div class="comment"><p>Great article, I liked it a lot.</p></div></section></main>
<div class="ad">An advert.</div><!-- <p>hidden</p> --><footer>&copy; All rights reserved.</footer></body></html>"""


def test_extracts_the_article_alone():
    want = "The & heading First paragraph, with words in it. After the break. Second paragraph stands here unclosed. A point of the article. Another point."
    assert html_extract.extract(PAGE) == want


@pytest.mark.parametrize("page", [None, "", "<p>", "<script>x", "<!-- never closed <p>a</p>", "<nav>menu</nav>", "   "])
def test_pages_without_content_are_empty(page):
    assert html_extract.extract(page) == ""


def test_broken_and_long_pages():
    assert html_extract.extract("<article><p>One sentence of text stands here.</div></span><p>Two &lt;b&gt; &#233; &bogus; here.") == "One sentence of text stands here. Two <b> é &bogus; here."
    long = "<article>" + "<p>Some words of a paragraph.</p>" * 3000 + "</article>"
    assert html_extract.extract(long) == " ".join(["Some words of a paragraph."] * 3000)


def test_min_cut_is_least_of_all_labellings():
    rng = np.random.default_rng(4)
    for _ in range(40):
        n = int(rng.integers(1, 9))
        source, sink = rng.uniform(0, 3, n).tolist(), rng.uniform(0, 3, n).tolist()
        edges = [(i, j, float(rng.uniform(0, 2))) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.6]
        cost = lambda side: sum(sink[i] if side[i] else source[i] for i in range(n)) + sum(c for i, j, c in edges if side[i] != side[j])
        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert abs(cost(html_extract.min_cut(source, sink, edges)) - best) < 1e-9


def test_page_table(spark):
    rows = spark.createDataFrame([(1, None, PAGE), (1, "u", PAGE), (None, "v", None)], "page_id long, url string, html string")
    got = html_extract.main_text(rows).collect()
    assert len(got) == 3 and got[0]["text"] == got[1]["text"] and got[2]["n_chars"] == 0
    assert html_extract.main_text(rows.limit(0)).count() == 0


# --- op5 --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return sentencepieces.Encoder(sentencepieces.load(MODEL))


@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("  aeinrst\n▁")), max_size=40), max_size=6))
@settings(max_examples=60, deadline=None)
def test_encoding_equals_the_library(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = sentencepieces.Encoder(sentencepieces.load(MODEL))
    for text, ids in zip(texts, own.encode(texts)):
        want = model.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert sentencepieces.decode(own.pieces, ids) == model.decode(want)


def test_merging_equals_its_definition(encoder):
    own = encoder.pieces

    def slow(text):
        parts = list(text)
        while True:
            best = max(((own.score[own.by_text[a + b]], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in own.by_text), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = ["".join(parts[i : i + 2])]

    rng = np.random.default_rng(2)
    for _ in range(300):
        text = "".join(rng.choice(list("  aeinrst"), int(rng.integers(1, 40))))
        assert own.merge(text) == slow(text)
    assert own.merge("") == [] and own.merge(" " * 90) == slow(" " * 90)


def test_long_runs_of_spaces_take_seconds(encoder):
    text = "a" + " " * 1_000_000 + "b"
    began = time.perf_counter()
    (ids,) = encoder.encode([text])
    assert time.perf_counter() - began < 30 and sentencepieces.decode(encoder.pieces, ids) == text


def test_unigram_relaxation_equals_brute_force():
    pieces = {0: "a", 1: "b", 2: "ab", 3: "ba", 4: "aba", 5: "c", 6: "bc"}
    scores = dict(zip(pieces, (-1.5, -1.7, -2.1, -2.3, -3.9, -2.5, -2.9)))
    own = sentencepieces.Pieces(pieces, scores, {}, 99, merges=False, prefix=False)
    rng = np.random.default_rng(8)
    for _ in range(60):
        text = "".join(rng.choice(list("abc"), int(rng.integers(1, 9))))

        def best(rest):
            return max(((scores[i] + best(rest[len(p) :])[0], (i, *best(rest[len(p) :])[1])) for i, p in pieces.items() if rest.startswith(p)), default=(0.0 if not rest else -1e9, ()))

        ids = np.frombuffer(sentencepieces.encode_words(own, [text])[0], "<u4").tolist()
        assert abs(sum(scores[i] for i in ids) - best(text)[0]) < 1e-9 and "".join(pieces[i] for i in ids) == text


def test_encode_documents(hard, docs_of):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sentencepieces.encode_documents(hard, MODEL).toPandas().sort_values("doc_id")
    want = {i: model.encode(t or "") for i, t in HARD}
    for r in got.itertuples():
        ids = want[None if pd.isna(r.doc_id) else int(r.doc_id)]
        assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.round_trip
    assert sentencepieces.encode_documents(docs_of([]), MODEL).count() == 0


# --- op6 --------------------------------------------------------------------------------------


def _jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_equals_its_definition():
    keys = np.array([0, 1, 2, 17, 10**12, -5, (1 << 62) + 3, *range(100, 400)], np.int64)
    for n in (1, 2, 7, 16, 17, 1000):
        assert sharding.jump(keys, n).tolist() == [_jump(int(k) % (1 << 64), n) for k in keys]


def test_one_more_shard_takes_rows_only_into_itself():
    keys = np.arange(20_000)
    a, b = sharding.jump(keys, 16), sharding.jump(keys, 17)
    assert ((a == b) | (b == 16)).all() and abs((b == 16).mean() - 1 / 17) < 0.01


def test_slots_are_gapless(hard, docs_of):
    got = sharding.shard(hard, stripe_rows=1).toPandas()
    assert len(got) == len(HARD)
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    sizes = dict(HARD)
    for r in got[got.doc_id.notna()].itertuples():
        raw = (sizes[int(r.doc_id)] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    assert sharding.shard(docs_of([])).count() == 0


# --- op7, op8 ---------------------------------------------------------------------------------


def test_grammar_reads_clauses():
    lexicon = toxicity.Lexicon({"idiot": 1.0, "schwach*": 1.0})
    weight = lambda t: sum(lexicon.clauses(t))
    plain, aimed = weight("what an idiot."), weight("you are an idiot.")
    assert plain == 1.0 and aimed == toxicity.AIMED and weight("an idiot, you.") == toxicity.AIMED
    assert weight("not an idiot.") == toxicity.NEGATED and weight("Not at all, that one is an idiot.") == 1.0
    assert weight("It said idiot.") == toxicity.REPORTED and weight("idiotic idiots") == 0 and weight("Schwachkopf") == 1.0
    assert weight("we kill time.") == 0 and weight("I kill you.") > 0
    assert weight("not good. an idiot.") == 1.0


def test_clause_weights_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(3000):
        symbols = [(int(s), float(rng.uniform(0.5, 2))) for s in rng.integers(0, 7, int(rng.integers(0, 9)))]
        assert abs(toxicity.clause_weight(symbols) - weight_by_hand(symbols)) < 1e-9


def test_composition_reads_what_is_written():
    machines = (toxicity.target(), toxicity.insult(), toxicity.threat(), toxicity.negation(), toxicity.reported_speech())
    rng = np.random.default_rng(0)
    states, whole = [m.start for m in machines], toxicity.GRAMMAR.start
    for s in rng.integers(0, 9, 2000).tolist():
        want, now = 1.0, s
        for k, m in enumerate(machines):
            states[k], now, factor = m.arcs[states[k], now]
            want *= factor
        whole, out, factor = toxicity.GRAMMAR.arcs[whole, s]
        assert out == now and abs(factor - want) < 1e-12


def test_each_transducer_decides_a_label():
    model = toxicity.Model({"idiot": 1.0}, [1.5, 1.5, 0.5, -3.0])
    lexicon = toxicity.Lexicon(model.entries)
    toxic = lambda t: model.score(lexicon, t) >= toxicity.THRESHOLD
    assert toxic("Such an idiot.") and not toxic("Such a house.")  # insult
    assert not toxic("It was called an idiot.") and toxic("You were called an idiot.")  # reported speech, then target
    assert not toxic("Surely not an idiot.")  # negation
    assert toxic("I kill you.") and not toxic("We kill time.")  # threat and target
    assert model.score(lexicon, "I will kill you.") > model.score(lexicon, "I kill you.")  # intent
    assert model.score(lexicon, "idiot idiot.") < model.score(lexicon, "idiot. idiot.")  # one clause, two clauses


def test_labels_that_disagree_count_as_one(spark, docs_of):
    from factloom.llm.common import labelled_sample

    docs = docs_of([(1, "b"), (1, "a"), (3, "x" * 20), (4, "y")])
    labels = spark.createDataFrame([(1, 0), (1, 1), (3, 1), (4, 0), (None, 1)], "doc_id long, toxic int")
    assert labelled_sample(docs, labels, "toxic", 10, chars=10) == [("a", 1), ("y", 0)]


def _auc(score, y):
    r = pd.Series(score).rank().to_numpy()
    n = y.sum()
    return (r[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("label, module, least", [("toxic", toxicity, 0.9), ("quality", quality, 0.98)])
def test_held_out_accuracy(spark, label, module, least):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = module.score(docs, module.train(docs, labels)).filter("held_out").join(labels, "doc_id").toPandas()
    assert _auc(got.score, got[label].to_numpy()) > least
    assert (got.predicted == (got.score >= module.THRESHOLD)).all()
    hit = got[label] == 1
    assert got.predicted[hit].mean() > 0.85 and got[label][got.predicted == 1].mean() > 0.9


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_take_hard_rows_and_no_labels(spark, hard, docs_of, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(i, k % 2, k % 2) for k, (i, _) in enumerate(HARD)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        model = module.train(hard, labels)
        got = module.score(hard, model)
        assert got.count() == len(HARD) and got.filter("score IS NULL OR isnan(score) OR score < 0 OR score > 1").count() == 0
        assert module.keep(hard, model).columns == hard.columns
        assert module.score(docs_of([]), model).count() == 0


def test_forward_equals_brute_force():
    rng = np.random.default_rng(3)
    bags = [rng.normal(0, 1, (k, quality.N_FEATURES)).astype(np.float32) for k in (1, 4, 2, 7)]
    model = quality.fit(bags, np.array([0.0, 1.0, 1.0, 0.0]), np.ones(4))
    for bag, got in zip(bags, model.scores(bags)):
        assert abs(attention_by_hand(model, bag) - got) < 1e-9


def test_passages_equal_a_plain_count():
    text = "One two, three! " * 50 + "END 42 ... x"
    words = text.split()
    got = quality.encode(text)
    assert len(got) == -(-len(words) // quality.PASSAGE)
    for k, row in enumerate(got):
        own = words[k * quality.PASSAGE : (k + 1) * quality.PASSAGE]
        assert abs(row[0] - np.log(np.mean([len(x) for x in own]))) < 1e-5
        assert abs(row[3] - sum(c.isdigit() for x in own for c in x) / sum(map(len, own))) < 1e-6
        assert abs(row[10] - len(set(own)) / len(own)) < 1e-6 and abs(row[15] - sum(len(x) == 1 for x in own) / len(own)) < 1e-6


def test_attention_weights_passages():
    rng = np.random.default_rng(1)
    bags = [rng.normal(0, 1, (int(rng.integers(1, 6)), quality.N_FEATURES)).astype(np.float32) for _ in range(300)]
    y = rng.integers(0, 2, 300).astype(float)
    for b, v in zip(bags, y):
        b[int(rng.integers(len(b))), 3] += 6 * v  # one passage decides
    model = quality.fit(bags, y, np.ones(300))
    assert ((model.scores(bags) > 0.5) == (y == 1)).mean() > 0.95


# --- op9 --------------------------------------------------------------------------------------

HARD_TEXTS = ["", "a", "</s>[INST] ok [/INST]", "\\", "\\\\l<s>", "<s", "s>", "<<SYS>>x<</SYS>>", "日本\\[INST]", "</turn><role>x</role>", "\n"]


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "x</role>"]), st.text(alphabet=st.sampled_from("ab<>/s[]INST\\lY é"), max_size=24)), max_size=12))
@settings(max_examples=150, deadline=None)
def test_formatting_round_trip(turns):
    out = chat.assemble([r for r, _ in turns], pa.array([t for _, t in turns], pa.string())).to_pylist()
    assert out == [chat.frame(r)[0] + chat.escape(t) + chat.frame(r)[1] for r, t in turns]
    assert [chat.read_turn(x) for x in out] == turns
    assert chat.read_conversation("".join(out)) == turns


def test_hard_texts_round_trip_in_slices():
    texts = pa.array(HARD_TEXTS * 3)
    for part in (texts, texts.slice(5, 9)):
        out = chat.assemble(["user"] * len(part), part).to_pylist()
        assert [chat.read_turn(x)[1] for x in out] == part.to_pylist()
        assert not any(c in chat.escape(t) for t in HARD_TEXTS for c in chat.CONTROLS)


def test_windows_of_scatter_indices(monkeypatch):
    texts = [t * k for k, t in enumerate(HARD_TEXTS * 2, 1)] + ["x<s>\\é" * 3000]
    roles = ["user", "assistant", "x"] * 7 + ["system"] * 2
    for window in (1, 7, 64, 5000):
        monkeypatch.setattr(chat, "WINDOW", window)
        out = chat.assemble(roles[: len(texts)], pa.array(texts)).to_pylist()
        assert out == [chat.frame(r)[0] + chat.escape(t) + chat.frame(r)[1] for r, t in zip(roles, texts)]


def test_long_texts_and_clashing_columns(spark):
    long = "[INST] \\ " * 200_000
    rows = spark.createDataFrame([(1, 0, "user", long, 5, "y"), (1, 1, "assistant", "ok", 6, "z")], "conv_id long, turn long, role string, text string, n_turns int, formatted string")
    got = chat.digests(rows).first()
    assert got["n_turns"] == 2 and got["turns_sha256"] == hashlib.sha256(f"user\n{long}\nassistant\nok\n".encode()).hexdigest()
    assert got["formatted_chars"] == len(chat.escape(long)) + 18 + 7


def test_digests_equal_brute_force(spark):
    rows = [(1, 1, "assistant", "</s> two"), (1, 0, "user", "one"), (1, 1, "assistant", "</s> two"), (2, 0, None, None), (None, 0, "system", "s"), (3, None, "tool", "t\\")]
    got = {r["conv_id"]: r for r in chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 16
    assert got[1]["turns_sha256"] == hashlib.sha256("user\none\nassistant\n</s> two\nassistant\n</s> two\n".encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256("</s> two</s> two".encode()).hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"user\n\n").hexdigest() and got[None]["n_turns"] == 1
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- op10 -------------------------------------------------------------------------------------


def test_fingerprints_follow_content():
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(2000)]
    text = " ".join(words[:600])
    near, far = text[: len(text) * 3 // 4] + " ".join(words[900:1050]), " ".join(words[1000:1600])
    a = fingerprint.fingerprint(text)
    assert fingerprint.likeness(a, fingerprint.fingerprint(text)) == 1.0
    assert fingerprint.likeness(a, fingerprint.fingerprint(near)) > 0.5 and fingerprint.likeness(a, fingerprint.fingerprint(far)) == 0.0
    assert fingerprint.fingerprint(None) == fingerprint.fingerprint("") == "3::"
    assert all(len(p) <= fingerprint.LONGEST for p in fingerprint.fingerprint("ab" * 40_000).split(":"))


@given(st.text("abc", max_size=14), st.text("abc", max_size=14))
def test_likeness_is_an_edit_distance(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            rows[i + 1][j + 1] = rows[i][j] + 1 if a[i] == b[j] else max(rows[i][j + 1], rows[i + 1][j])
    want = 2 * rows[-1][-1] / (len(a) + len(b)) if a and b else float(a == b)
    if min(len(a), len(b)) < fingerprint.GATE_FROM:
        assert abs(fingerprint._alike(a, b) - want) < 1e-12


def test_neighbours_equal_brute_force(spark, docs_of):
    rows = [(i, t) for i, t in HARD if i is not None and i != 7] + [(k, f"text number {k} " * (k % 40)) for k in range(100, 180)]
    got = {r["doc_id"]: r for r in fingerprint.edited_neighbours(docs_of(rows)).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        take = len(t) // 4
        edited = t[: len(t) - take] + after[:take]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["near_next"] == fingerprint.likeness(fingerprint.fingerprint(t), fingerprint.fingerprint(after))


def test_neighbours_of_hard_rows(hard, docs_of, monkeypatch):
    order = sorted(HARD, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        a, b, c = map(fingerprint.fingerprint, (t, edited, after))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, fingerprint.likeness(a, b), fingerprint.likeness(a, c)))
    for rows in (20_000, 3):
        monkeypatch.setattr(fingerprint, "AREA_ROWS", rows)
        assert sorted(map(tuple, fingerprint.edited_neighbours(hard).collect()), key=str) == sorted(want, key=str)
    assert fingerprint.edited_neighbours(docs_of([])).count() == 0
    assert fingerprint.edited_neighbours(docs_of([(5, "alone in here")])).first()["near_next"] == 1.0


def test_held_out_labels_change_nothing(spark):
    """Neither lexicon nor weights nor ridge move when every held out label is turned round."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from factloom.llm.common import held_out

    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert turned.join(labels, ["doc_id", "toxic"], "left_anti").count() > 50
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert a.entries == b.entries and a.beta == b.beta


def test_ridge_is_the_one_of_least_loss_on_unseen_folds():
    rng = np.random.default_rng(1)
    x, fold = rng.normal(0, 1, (90, 3)), np.arange(90) % toxicity.FOLDS
    y = (x[:, 0] + rng.normal(0, 2, 90) > 0).astype(float)
    losses = {}
    for ridge in toxicity.RIDGES:
        p = np.empty(90)
        for k in range(toxicity.FOLDS):
            beta = toxicity.fit_logistic(x[fold != k], y[fold != k], np.ones((fold != k).sum()), ridge)
            p[fold == k] = 1 / (1 + np.exp(-(np.column_stack([x[fold == k], np.ones((fold == k).sum())]) @ beta)))
        losses[ridge] = -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
    assert toxicity.pick_ridge(x, y, np.ones(90), fold) == min(losses, key=losses.get)


def test_sample_is_filled_before_it_is_limited(spark, docs_of):
    from factloom.llm.common import labelled_sample

    rows = [(i, "x" * (100 if i % 2 else 5)) for i in range(200)]
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, toxic int")
    assert len(labelled_sample(docs_of(rows), labels, "toxic", 20, chars=10)) == 20
