"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded by surface statistics of
its words; a tanh layer embeds it, a gated attention layer (tanh times sigmoid)
weighs the passages, and the weighted sum gives the score. Only documents have
labels: the attention weights are learned through them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import held_out, labelled_rows, small_batches

THRESHOLD = 0.7
#: Training rows of each label value, at most.
TRAIN_PER_CLASS = 2000
#: Words of a passage.
PASSAGE = 64
HIDDEN, GATE = 16, 8
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.01, 1e-4

#: Byte classes.
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.isin(np.arange(256), list(b".,;:"))
_CRY = np.isin(np.arange(256), list(b"!?"))
_SYMBOL = np.isin(np.arange(256), list(b"#$%&*@^~<>{}[]\\/=+_|`"))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_HIGH = np.arange(256) >= 128
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

N_FEATURES = 22


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def encode(text: str | None) -> np.ndarray:
    """Passages by features. A text without words is one passage of zeros."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    n = len(starts)
    if not n:
        return np.zeros((1, N_FEATURES), np.float32)
    first = np.arange(0, n, PASSAGE)
    counts = np.diff(np.append(first, n)).astype(np.float64)

    def per_word(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask[data], out=total[1:])
        return total[ends] - total[starts]

    def summed(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.astype(np.float64), first)

    length = (ends - starts).astype(np.float64)
    upper, letter, digit, stop, cry, symbol = (per_word(m) for m in (_UPPER, _LETTER, _DIGIT, _STOP, _CRY, _SYMBOL))
    total = np.maximum(1.0, summed(length))
    mean = total / counts
    word = _hashes(data, starts, ends)
    area = np.repeat(np.arange(len(first)), counts.astype(np.int64))
    order = np.lexsort((word, area))
    w, a = word[order], area[order]
    new = np.ones(n, bool)
    new[1:] = (w[1:] != w[:-1]) | (a[1:] != a[:-1])
    distinct = np.bincount(a[new], minlength=len(first)).astype(np.float64)
    runs = np.diff(np.append(np.flatnonzero(new), n))
    most = np.maximum.reduceat(runs, np.flatnonzero(np.diff(np.append(-1, a[new])))).astype(np.float64)
    again = np.zeros(n, bool)
    again[1:] = word[1:] == word[:-1]
    # Words that stood earlier in the document, outside their passage.
    _, seen_at, inverse = np.unique(word, return_index=True, return_inverse=True)
    earlier = area[seen_at][inverse] < area
    line = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=line[1:])
    lines = line[np.append(starts[first[1:]], len(data))] - line[starts[first]]
    last = data[ends - 1]
    out = np.column_stack(
        [
            np.log(mean), np.sqrt(np.maximum(0.0, summed(length**2) / counts - mean**2)) / 8, summed(upper) / total, summed(digit) / total, summed(symbol) / total,
            summed(stop) / total * 5, summed(cry) / total * 3, summed((upper == letter) & (letter > 1)) / counts, summed(_SYMBOL[last]) / counts, summed(_CRY[last]) / counts,
            distinct / counts, most / counts, summed(again) / counts, summed(earlier) / counts, lines / counts, summed(length == 1) / counts,
            summed(per_word(_HIGH)) / total,
            summed((length == 1) & (data[starts] == 124)) / counts, summed(_UPPER[data[starts]]) / counts, summed(letter == 0) / counts, np.log(counts) / 4, np.full(len(first), np.log(n) / 8),
        ]
    )
    return out.astype(np.float32)


@dataclass
class Model:
    """Weights; ``mean`` and ``scale`` standardise the features."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        """x: passages of several documents one below the other; first: where each document begins."""
        w = self.w
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"] + w["v"]), 1 / (1 + np.exp(-(h @ w["U"] + w["u"])))
        e = (t * g) @ w["a"]
        sizes = np.diff(np.append(first, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
        att = e / np.repeat(np.add.reduceat(e, first), sizes)
        z = np.add.reduceat(h * att[:, None], first, axis=0)
        logit = z @ w["o"] + w["c"][0]
        return x, h, t, g, att, sizes, z, logit

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.empty(0)
        first = np.cumsum([0] + [len(b) for b in bags[:-1]])
        logit = self.forward(np.concatenate(bags).astype(np.float64), first)[-1]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = 7) -> Model:
    """Adam on the weighted cross-entropy of documents."""
    rng = np.random.Generator(np.random.PCG64(seed))
    everything = np.concatenate(bags)
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    w = {"W": init(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, GATE), "v": np.zeros(GATE), "U": init(HIDDEN, GATE), "u": np.zeros(GATE), "a": init(GATE), "o": init(HIDDEN), "c": np.zeros(1)}
    model = Model(everything.mean(0).astype(np.float64), everything.std(0).astype(np.float64) + 1e-3, w)
    m, v, step = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        rate = RATE * (1 - epoch / EPOCHS) + 1e-4
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            first = np.cumsum([0] + [len(bags[i]) for i in own[:-1]])
            x, h, t, g, att, sizes, z, logit = model.forward(np.concatenate([bags[i] for i in own]).astype(np.float64), first)
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            d = weight[own] * (p - y[own]) / weight[own].sum()
            grad = {"o": z.T @ d, "c": np.array([d.sum()])}
            dz = np.repeat(d[:, None] * w["o"], sizes, axis=0)
            datt = (dz * h).sum(1)
            de = att * (datt - np.repeat(np.add.reduceat(att * datt, first), sizes))
            grad["a"] = (t * g).T @ de
            dt, dg = de[:, None] * w["a"] * g * (1 - t**2), de[:, None] * w["a"] * t * g * (1 - g)
            grad["V"], grad["v"], grad["U"], grad["u"] = h.T @ dt, dt.sum(0), h.T @ dg, dg.sum(0)
            dh = (dz * att[:, None] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h**2)
            grad["W"], grad["b"] = x.T @ dh, dh.sum(0)
            step += 1
            for k in w:
                if w[k].ndim == 2:
                    grad[k] = grad[k] + DECAY * w[k]
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _encoder(batches):
    for batch in batches:
        bags = [encode(t).tobytes() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.binary())], names=["doc_id", "y", "bag"])


def encoded_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The features of the training rows and their labels, by id. Texts are encoded on executors; the driver sees a row of numbers a passage."""
    small_batches(docs.sparkSession)
    rows = labelled_rows(docs, labels, "quality", per_class).select(F.col("doc_id").cast("long"), F.col("y"), "text")
    table = rows.mapInArrow(_encoder, "doc_id long, y int, bag binary").toArrow()
    order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
    bags = table.column("bag")
    return [np.frombuffer(bags[int(i)].as_py(), np.float32).reshape(-1, N_FEATURES) for i in order], table.column("y").to_numpy()[order].astype(float)


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Model:
    """Learns from at most ``per_class`` training rows of each label value; held out rows are never read.

    Without rows of both values every document gets the share of label 1, or 1
    where there are no labels.
    """
    bags, y = encoded_sample(docs, labels, per_class)
    seen = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("quality").count().collect()
    share = {r["quality"]: r["count"] for r in seen}
    if len(set(y.tolist())) < 2:
        zero = {"W": np.zeros((N_FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": np.zeros((HIDDEN, GATE)), "v": np.zeros(GATE), "U": np.zeros((HIDDEN, GATE)), "u": np.zeros(GATE), "a": np.zeros(GATE), "o": np.zeros(HIDDEN), "c": np.array([-30.0 if set(y.tolist()) == {0.0} else 30.0])}
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), zero)
    # The sample has other class shares than the labels: weights undo this.
    weight = np.where(y == 1, share[1] / y.sum(), share[0] / (1 - y).sum())
    return fit(bags, y, weight / weight.mean())


_SCHEMA = "doc_id long, score double"


def _score_texts(model: Model, texts: list) -> np.ndarray:
    return np.concatenate([model.scores([encode(t) for t in texts[i : i + 256]]) for i in range(0, len(texts), 256)] or [np.empty(0)])


def _scorer(model: Model):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_score_texts(model, batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Null and empty texts are one empty passage.

    Rows are scored one by one, so repeated rows get equal scores and an empty
    table an empty result; a null id is not held out.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scorer(model), _SCHEMA)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def score_udf(model: Model):
    """A column function: text -> score."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(_score_texts(model, list(texts)), dtype="float64")

    return F.pandas_udf(run, "double")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose score reaches the threshold, with the columns of ``docs``."""
    small_batches(docs.sparkSession)
    return docs.withColumn("__quality", score_udf(model)(F.col("text").cast("string"))).filter(F.col("__quality") >= THRESHOLD).select(*docs.columns)
