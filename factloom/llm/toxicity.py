"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns the words of a clause into symbols: insult, threat,
target, intent, negation, reported speech, other. Five small transducers are
composed into one machine, each reading what the one before writes: the target
transducer marks what is said to somebody, the insult transducer weighs insults by
it and by how many came before, the threat transducer drops threats to nobody and
weighs those with an intent, the negation transducer weakens what a negation
reaches and the reported-speech transducer what is only quoted. So each insult or
threat of a clause gets its reading; the clause, not the word, gets a weight.
Clause weights are summed up in three numbers, which a logistic function turns
into the score.

The insult lexicon, words and word beginnings, and the logistic weights are
learned from labelled training rows; seeds stand in where there are none.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import drop, held_out, labelled_rows, materialise, partitions, small_batches

THRESHOLD = 0.3
#: Training rows of each label value that the lexicon and the weights are learned from, at most.
TRAIN_PER_CLASS = 2000
#: Folds of the cross-fitting, and the ridges that they choose among.
FOLDS = 3
RIDGES = (0.1, 1.0, 10.0)

#: Seed words of the lexical transducer, in English, German, French and Spanish.
INSULTS = ("idiot", "moron", "imbecile", "stupid", "dumb", "fool", "jerk", "loser", "scum", "trash", "vermin", "filth", "worthless", "pathetic", "disgusting", "clown", "coward", "dummkopf", "abschaum", "salaud", "ordure", "imbécil", "basura")
THREATS = ("kill", "hurt", "destroy", "burn", "shoot", "stab", "strangle", "töten", "umbringen", "vernichten", "tuer", "détruire", "matar", "destruir")
TARGETS = ("you", "your", "yours", "yourself", "he", "she", "they", "him", "her", "them", "du", "dich", "dir", "ihr", "euch", "sie", "tu", "toi", "vous", "lui", "usted", "ustedes", "tú", "él", "ella", "ellos")
NEGATIONS = ("not", "no", "never", "neither", "nor", "without", "isn't", "aren't", "wasn't", "don't", "nicht", "kein", "keine", "nie", "pas", "jamais", "ni", "nunca", "jamás", "sin")
REPORTS = ("said", "says", "wrote", "writes", "called", "calls", "quoted", "claimed", "sagte", "sagt", "schrieb", "nannte", "dit", "écrit", "appelé", "dijo", "escribió", "llamó")
INTENTS = ("will", "shall", "gonna", "going", "i'll", "we'll", "werde", "werden", "vais", "allons", "voy", "vamos")
QUOTES = "\"“”„«»"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, INSULT_AT, THREAT_AT = range(9)
SYMBOLS = range(9)
HITS = (INSULT, THREAT, INSULT_AT, THREAT_AT)
#: How much more often a lexicon entry stands in toxic rows, and what a clean row that it hits costs.
LEAST_ODDS, CLEAN_COST = 6.0, 3.0
#: Words after a negation that it reaches.
REACH = 3
#: What a reading leaves of a match's weight, and what an addressed insult, a further insult and a threat with intent gain.
NEGATED, REPORTED, AIMED, FURTHER, INTENDED = 0.25, 0.6, 1.5, 0.5, 1.5

_TOKEN = re.compile(rf"[\w'’]+|[{QUOTES}]")
_BREAK = re.compile(r"[.!?;:\n]")


# --- transducers -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Transducer:
    """Deterministic: (state, symbol) -> (next state, symbol written, factor on the weight of a match)."""

    start: int
    arcs: dict[tuple[int, int], tuple[int, int, float]] = field(hash=False)


def _machine(states: int, step) -> Transducer:
    """``step(state, symbol)`` gives the next state, what is written in the symbol's place, and the factor."""
    return Transducer(0, {(q, s): step(q, s) for q in range(states) for s in SYMBOLS})


def target() -> Transducer:
    """State 1 once somebody is addressed: what is said then is said to them."""
    aimed = {INSULT: INSULT_AT, THREAT: THREAT_AT}
    return _machine(2, lambda q, s: (1 if q or s == TARGET else 0, aimed.get(s, s) if q else s, 1.0))


def insult() -> Transducer:
    """State 1 after the first insult of a clause: each further one adds less; one that is aimed weighs more."""

    def step(q: int, s: int) -> tuple[int, int, float]:
        if s not in (INSULT, INSULT_AT):
            return q, s, 1.0
        return 1, s, (AIMED if s == INSULT_AT else 1.0) * (FURTHER if q else 1.0)

    return _machine(2, step)


def threat() -> Transducer:
    """State 1 after a word of intent: a threat to nobody is none, one that is intended weighs more."""

    def step(q: int, s: int) -> tuple[int, int, float]:
        if s == THREAT_AT:
            return q, s, INTENDED if q else 1.0
        return 1 if q or s == INTENT else 0, OTHER if s == THREAT else s, 0.0 if s == THREAT else 1.0

    return _machine(2, step)


def negation() -> Transducer:
    """The state counts the words that a negation still reaches."""
    return _machine(REACH + 1, lambda q, s: (REACH if s == NEGATION else max(0, q - 1), s, NEGATED if q and s in HITS else 1.0))


def reported_speech() -> Transducer:
    """State 1 from a verb of saying or a quotation mark to the end of the clause."""
    return _machine(2, lambda q, s: (1 if q or s == REPORT else 0, s, REPORTED if q and s in HITS else 1.0))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The second reads what the first writes; states pair up and factors multiply."""
    names = {(first.start, second.start): 0}
    arcs, queue = {}, [(first.start, second.start)]
    while queue:
        pair = queue.pop()
        for s in SYMBOLS:
            a, written, fa = first.arcs[pair[0], s]
            b, out, fb = second.arcs[pair[1], written]
            if (a, b) not in names:
                names[a, b] = len(names)
                queue.append((a, b))
            arcs[names[pair], s] = (names[a, b], out, fa * fb)
    return Transducer(0, arcs)


GRAMMAR = reduce(compose, (target(), insult(), threat(), negation(), reported_speech()))


def clause_weight(symbols: list[tuple[int, float]], grammar: Transducer = GRAMMAR) -> float:
    """Weight of a clause from its (symbol, weight) sequence.

    An insult or threat before its target is aimed as one behind it: the clause is
    read with the target in front.
    """
    state, total = grammar.start, 0.0
    if any(s == TARGET for s, _ in symbols):
        state = grammar.arcs[state, TARGET][0]
    for s, weight in symbols:
        state, _, factor = grammar.arcs[state, s]
        if s in HITS:
            total += weight * factor
    return total


# --- lexicon ---------------------------------------------------------------------------------


class Lexicon:
    """The lexical transducer: an automaton over characters that finds words and word beginnings."""

    def __init__(self, entries: dict[str, float]):
        """``entries``: word -> weight, a word that ends in ``*`` being a beginning."""
        self.entries = entries
        self.closed = {c: (REPORT, 0.0) for c in QUOTES}
        for words, symbol in ((TARGETS, TARGET), (INTENTS, INTENT), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
            self.closed |= {w: (symbol, 0.0) for w in words}
        keys: dict[str, list] = {}
        for word, weight in entries.items():
            open_ = word.endswith("*")
            keys.setdefault(word.rstrip("*"), []).append((INSULT, weight, open_))
        for word in THREATS:
            keys.setdefault(word, []).append((THREAT, 1.5, False))
        self.machine = ahocorasick.Automaton()
        for key, values in keys.items():
            self.machine.add_word(key, (len(key), values))
        self.machine.make_automaton()

    def matches(self, text: str) -> dict[int, tuple[int, float]]:
        """Start of each matched word -> (symbol, weight); the text is in lower case."""
        found: dict[int, tuple[int, float]] = {}
        n = len(text)
        for last, (length, values) in self.machine.iter(text):
            start = last - length + 1
            if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
                continue
            closed = last + 1 < n and (text[last + 1].isalnum() or text[last + 1] == "_")
            for symbol, weight, open_ in values:
                if (open_ or not closed) and weight > found.get(start, (0, 0.0))[1]:
                    found[start] = (symbol, weight)
        return found

    def clauses(self, text: str) -> list[float]:
        """Weights of the clauses that hold a match, in order, those of weight 0 left out."""
        text = text.lower()
        found, out = self.matches(text), []
        done = -1
        for start in sorted(found):
            if start < done:
                continue
            left = start
            while left and text[left - 1] not in ".!?;:\n":
                left -= 1
            end = _BREAK.search(text, start)
            done = end.start() if end else len(text)
            symbols = [found.get(m.start()) or self.closed.get(m[0], (OTHER, 0.0)) for m in _TOKEN.finditer(text, left, done)]
            weight = clause_weight(symbols)
            if weight > 0:
                out.append(weight)
        return out


def _beginnings(text: str) -> set[str]:
    out = set()
    for word in set(re.findall(r"\w+", text.lower())):
        out.add(word)
        out.update(word[:k] + "*" for k in range(3, min(9, len(word))))
    return out


def _marks(text: str) -> list[int]:
    """The least hashes of the text's passages of five words: near copies share one."""
    w = text.split()
    return sorted({xxhash.xxh64_intdigest(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))})[:4]


def _distinct(rows: list[tuple[int, int, list[int]]]) -> set[int]:
    """Numbers of rows (number, label, marks) without copies and near copies, whose rare words would look like evidence."""
    seen: set[tuple[int, int]] = set()
    out = set()
    for number, y, marks in rows:
        keys = {(y, m) for m in marks}
        if not keys & seen:
            out.add(number)
        seen |= keys
    return out


def _least(n1: int) -> int:
    """Toxic rows that a word or beginning must stand in."""
    return max(3, math.ceil(0.004 * n1))


def choose(counts: dict[str, int], hit: dict[str, set[int]], miss: dict[str, set[int]], n1: int, n0: int, most: int = 256) -> dict[str, float]:
    """Words and beginnings that mark toxic rows, with log-odds weights; seeds always belong to it.

    ``counts``: toxic rows of each telling beginning; ``hit``, ``miss``: its toxic and clean
    rows, of ``n1`` and ``n0``. First come those that explain rows which nothing else
    explains (a greedy cover), then all others that are as telling and frequent. Of
    nested beginnings that explain the same rows the longest is taken.
    """
    n1, n0 = max(1, n1), max(1, n0)
    least = _least(n1)
    odds = {b: (n / n1) / ((len(miss[b]) + 1) / n0) for b, n in counts.items()}
    usable = set(odds)
    chosen: list[str] = []
    left, covered, wrong = set(usable), set(), set()
    while left and len(chosen) < most:
        gain = {b: len(hit[b] - covered) for b in left}
        left = {b for b in left if gain[b] >= least}
        if not left:
            break
        # Rows explained, less clean rows hit; beginnings that say little because they are short pay for it.
        worth = {b: gain[b] / n1 - CLEAN_COST * len(miss[b] - wrong) / n0 - 0.001 * max(0, 8 - len(b)) for b in left}
        best = max(left, key=lambda b: (worth[b], len(b.rstrip("*")), b))
        if worth[best] <= 0:
            break
        for b in _sharpened(best, usable, hit, miss):
            chosen.append(b)
            covered |= hit[b]
            wrong |= miss[b]
        left.discard(best)
    often = max(8, math.ceil(0.02 * n1))
    for b in sorted(usable, key=lambda b: (-counts[b], -len(b), b)):
        if len(chosen) >= most:
            break
        if counts[b] >= often and odds[b] >= 40 and not any(_nested(b, c) for c in chosen):
            chosen.append(b)
    out = {w: 0.5 for w in INSULTS}
    for b in chosen:
        out[b] = min(3.0, max(0.5, math.log(odds[b]) / 2))
    return out


def _sharpened(best: str, usable: set, hit: dict, miss: dict) -> list[str]:
    """A beginning, or at most two longer ones that explain most of what it does and hit half its clean rows at most."""
    if not miss[best] or not best.endswith("*"):
        return [best]
    longer = {b for b in usable if b != best and b.startswith(best[:-1])}
    out: list[str] = []
    covered: set[int] = set()
    wrong: set[int] = set()
    while longer and len(out) < 2 and len(covered) < len(hit[best]):
        pick = max(longer, key=lambda b: (len(hit[b] - covered) - 5 * len(miss[b] - wrong), len(b.rstrip("*")), b))
        if not hit[pick] - covered:
            break
        out.append(pick)
        covered |= hit[pick]
        wrong |= miss[pick]
        longer.discard(pick)
    good = len(covered) >= 0.8 * len(hit[best]) and 2 * len(wrong) <= len(miss[best])
    return out if good else [best]


def _nested(a: str, b: str) -> bool:
    a_, b_ = a.rstrip("*"), b.rstrip("*")
    return (a_.startswith(b_) and b.endswith("*")) or (b_.startswith(a_) and a.endswith("*")) or a_ == b_


# --- score -----------------------------------------------------------------------------------


def features(weights: list[float]) -> tuple[float, float, float]:
    return math.log1p(sum(weights)), math.log1p(max(weights, default=0.0)), math.log1p(len(weights))


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (p - y)) + penalty @ beta
        hessian = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


@dataclass
class Model:
    entries: dict[str, float]
    beta: list[float]

    def score(self, lexicon: Lexicon, text: str | None) -> float:
        z = sum(b * v for b, v in zip(self.beta, (*features(lexicon.clauses(text or "")), 1.0)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _sample_marks(batches):
    for batch in batches:
        texts = batch.column(2).to_pylist()
        hashes = pa.array([xxhash.xxh64_intdigest(t) for t in texts], pa.uint64()).cast(pa.decimal128(20, 0))
        marks = pa.array([[f"{m:x}" for m in _marks(t)] for t in texts], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hashes, marks], names=["doc_id", "y", "h", "marks"])


def _entries(wanted: set[str] | None = None):
    """(beginning, number, y, uses) of each sample row, of ``wanted`` beginnings only if these are given."""

    def run(batches):
        for batch in batches:
            for number, y, uses, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
                found = _beginnings(text)
                found = sorted(found if wanted is None else found & wanted)
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array(np.full(n, v, np.int32)) for v in (number, y, uses))], names=["b", "number", "y", "uses"])

    return run


_ENTRIES = "b string, number int, y int, uses int"


def _learn(sample: DataFrame, rows: list[tuple[int, int, list[int]]]) -> list[dict[str, float]]:
    """The lexicons of the sample without each fold, and of all of it.

    ``sample``: number, y, text; ``rows``: number, label, marks. Executors count the beginnings
    once for all lexicons and say in which rows the telling ones stand; the driver sees
    counts and row numbers of these.
    """
    spark = sample.sparkSession
    chosen = [_distinct([r for r in rows if r[0] % FOLDS != fold]) for fold in range(FOLDS)] + [_distinct(rows)]
    uses = spark.createDataFrame([(n, sum((n in c) << k for k, c in enumerate(chosen))) for n, *_ in rows], "number int, uses int")
    used = sample.join(F.broadcast(uses.filter("uses > 0")), "number").select("number", "y", "uses", "text")  # a row per sample row
    label = dict((n, y) for n, y, _ in rows)
    sizes = [(sum(label[n] for n in c), sum(1 - label[n] for n in c)) for c in chosen]
    bit = lambda k, y: F.count_if((F.col("y") == y) & F.col("uses").bitwiseAND(F.lit(1 << k)).cast("boolean"))
    counts = used.mapInArrow(_entries(), _ENTRIES).groupBy("b").agg(*[bit(k, y).alias(f"n{y}_{k}") for k in range(len(chosen)) for y in (0, 1)])
    tells = [(F.col(f"n1_{k}") >= _least(max(1, n1))) & (F.col(f"n1_{k}") / max(1, n1) / ((F.col(f"n0_{k}") + 1) / max(1, n0)) >= LEAST_ODDS) for k, (n1, n0) in enumerate(sizes)]
    found = counts.select("b", *[F.when(t, F.col(f"n1_{k}")).alias(f"k{k}") for k, t in enumerate(tells)]).filter(reduce(lambda a, b: a | b, tells)).collect()
    wanted = {r["b"] for r in found}
    if not wanted:
        return [{w: 0.5 for w in INSULTS} for _ in chosen]
    where = used.mapInArrow(_entries(wanted), _ENTRIES).groupBy("b").agg(F.collect_list("number").alias("rows")).collect()
    rows_of = {r["b"]: r["rows"] for r in where}
    out = []
    for k, own in enumerate(chosen):
        own_counts = {r["b"]: r[f"k{k}"] for r in found if r[f"k{k}"] is not None}
        hit = {b: {n for n in rows_of[b] if n in own and label[n]} for b in own_counts}
        miss = {b: {n for n in rows_of[b] if n in own and not label[n]} for b in own_counts}
        out.append(choose(own_counts, hit, miss, *sizes[k]))
    return out


def _cross_features(lexicons: list[dict[str, float]]):
    def run(batches):
        machines = [Lexicon(x) for x in lexicons]
        for batch in batches:
            numbers, ys, texts = (batch.column(c).to_pylist() for c in range(3))
            x = [features(machines[n % FOLDS].clauses(t)) for n, t in zip(numbers, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(map(float, v)) for v in x], pa.list_(pa.float64()))], names=["number", "y", "x"])

    return run


def pick_ridge(x: np.ndarray, y: np.ndarray, w: np.ndarray, fold: np.ndarray) -> float:
    """The ridge of least log loss on rows that the fit has not seen, fold by fold; of equal ones the largest."""

    def loss(ridge: float) -> float:
        total = 0.0
        for k in range(FOLDS):
            own = fold == k
            if own.all() or not own.any():
                continue
            beta = fit_logistic(x[~own], y[~own], w[~own], ridge)
            z = np.clip(np.column_stack([x[own], np.ones(own.sum())]) @ beta, -30, 30)
            total += float((w[own] * np.logaddexp(0, np.where(y[own] == 1, -z, z))).sum())
        return total

    return min(RIDGES, key=lambda r: (round(loss(r), 9), -r))


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Model:
    """Learns from at most ``per_class`` training rows of each label value; held out rows are never read.

    Without rows of both values the seeds and fixed weights stand. The weights are
    fitted by cross-fitting: each row's features come from a lexicon learned without
    the row's fold, so that they trust the lexicon as far as unseen rows let them; the
    lexicon that scores is learned from all rows. The ridge is chosen by the same folds.
    Texts stay on executors; the driver sees four marks a row, and what tells of toxicity.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample = materialise(labelled_rows(docs, labels, "toxic", per_class).select(F.col("doc_id").cast("long"), "y", "text"), "op7-sample")
    seen = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("toxic").count().collect()
    share = {r["toxic"]: r["count"] for r in seen}
    marked = sample.mapInArrow(_sample_marks, "doc_id long, y int, h decimal(20,0), marks array<string>").collect()
    if len({r["y"] for r in marked}) < 2:
        return Model({w: 1.0 for w in INSULTS}, [1.5, 1.5, 0.5, -3.0])
    marked.sort(key=lambda r: (r["h"], r["doc_id"]))
    numbers = spark.createDataFrame([(r["doc_id"], k) for k, r in enumerate(marked)], "doc_id long, number int")
    numbered = sample.join(F.broadcast(numbers), "doc_id").select("number", "y", "text").repartition(partitions(spark), "number")  # a row per sample row
    numbered = materialise(numbered, "op7-numbered")
    lexicons = _learn(numbered, [(k, r["y"], r["marks"]) for k, r in enumerate(marked)])
    rows = numbered.mapInArrow(_cross_features(lexicons[:FOLDS]), "number int, y int, x array<double>").collect()
    rows.sort(key=lambda r: r["number"])
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)
    # The sample has other class shares than the labels: weights undo this.
    w = np.where(y == 1, share[1] / max(1, y.sum()), share[0] / max(1, (1 - y).sum()))
    w = w * len(w) / w.sum()
    ridge = pick_ridge(x, y, w, np.array([r["number"] % FOLDS for r in rows]))
    drop(sample)
    drop(numbered)
    return Model(lexicons[-1], [float(b) for b in fit_logistic(x, y, w, ridge)])


_SCHEMA = "doc_id long, score double"


def _scorer(model: Model):
    def run(batches):
        lexicon = Lexicon(model.entries)
        for batch in batches:
            scores = [model.score(lexicon, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Null and empty texts get the score of no match.

    Rows are scored one by one, so repeated rows get equal scores and an empty
    table an empty result; a null id is not held out.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scorer(model), _SCHEMA)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def score_udf(model: Model):
    """A column function: text -> score."""

    def run(texts: pd.Series) -> pd.Series:
        lexicon = Lexicon(model.entries)
        return pd.Series([model.score(lexicon, t) for t in texts], dtype="float64")

    return F.pandas_udf(run, "double")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose score is below the threshold, with the columns of ``docs``."""
    small_batches(docs.sparkSession)
    return docs.withColumn("__toxic", score_udf(model)(F.col("text").cast("string"))).filter(F.col("__toxic") < THRESHOLD).select(*docs.columns)
