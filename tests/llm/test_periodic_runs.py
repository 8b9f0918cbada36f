"""Runs equal those of a search over every stretch; digests equal plain ones."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from factloom.llm import periodic_runs as r
from tests.llm.conftest import HARD


def by_hand(words, least, exponent):
    """Every period, every stretch of words equal to those a period on; of one stretch the smallest period."""
    n, out, seen = len(words), [], set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q) and (i, length) not in seen:
                seen.add((i, length))
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def found(docs, least, exponent):
    flat = np.array([w for d in docs for w in d], np.int64)
    return r.find_runs(flat, np.array([len(d) for d in docs], np.int64), least, exponent)


@pytest.mark.parametrize("least, exponent", [(1, 2), (2, 2), (6, 4), (5, 3), (9, 2), (1, 4)])
def test_equal_to_every_stretch(least, exponent):
    rng = random.Random(least * 10 + exponent)
    docs = []
    for _ in range(400):
        letters = rng.choice([1, 2, 2, 3, 4, 9])
        words = [rng.randrange(letters) for _ in range(rng.randrange(60))]
        if words and rng.random() < 0.6:
            part = words[: rng.randrange(1, 9)]
            words = words[: rng.randrange(len(words))] + part * rng.randrange(1, 9) + words[rng.randrange(len(words)) :]
        docs.append(words + words[len(words) // 3 :] if rng.random() < 0.4 else words)  # long blocks with runs inside
    assert found(docs, least, exponent) == [by_hand(d, least, exponent) for d in docs]


def test_known_strings():
    a, b = [0], [1]
    for _ in range(12):
        a, b = a + b, a
    assert found([a], 1, 2) == [by_hand(a, 1, 2)]  # Fibonacci: runs in runs
    assert found([[7] * 5000], 6, 4) == [[(0, 5000, 1)]]
    assert found([[1, 2, 3] * 2000 + [1]], 6, 4) == [[(0, 6001, 3)]]
    inside = [1, 2] * 5
    copied = [9, 8, *inside, 7, 6, 5, 9, 8, *inside, 7, 6, 4]
    assert found([copied], 6, 4) == [[(2, 10, 2), (17, 10, 2)]]


def test_blocks_are_those_of_lempel_ziv():
    rng = random.Random(5)
    for _ in range(100):
        words = [rng.randrange(3) for _ in range(rng.randrange(1, 50))]
        names = r.block_names(np.array(words), np.zeros(len(words), np.int64))
        order = np.argsort(names[-1][:-1])
        assert order.tolist() == sorted(range(len(words)), key=lambda i: words[i:])
        lcp = np.zeros(len(words), np.int64)
        pair = np.sort(np.stack([order[:-1], order[1:]]), axis=0)
        lcp[1:] = r.ahead(names, pair[0], pair[1])
        longest, source = r.previous_factors(order, lcp)
        for i, n, s in zip(order.tolist(), longest.tolist(), source.tolist()):
            want = max((next(k for k in range(len(words) - i + 1) if i + k == len(words) or words[j + k] != words[i + k]) for j in range(i)), default=0)
            assert n == want and (not n or (s < i and words[s : s + n] == words[i : i + n]))


def row_by_hand(doc_id, text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = by_hand(words, 6, 4) if n < 3000 else found([[{w: k for k, w in enumerate(sorted(set(words)))}[w] for w in words]], 6, 4)[0]
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None, None, None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_rows_by_hand(spark, docs_of):
    rng = random.Random(3)
    rows = [x for x in HARD if x[0] != 10] + [(10, "word " * 2900)]
    for i in range(20, 420):
        words = [rng.choice("a b c the of river é".split()[: 1 + i % 7]) for _ in range(rng.randrange(60))]
        rows.append((i, " ".join(words) if i % 3 else " x   " + "\x0b".join(words)))  # other spaces are letters
    key = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else v for v in x)
    got = sorted((tuple(x) for x in r.runs_of(docs_of(rows), r.plant).collect()), key=key)
    assert got == sorted((row_by_hand(i, t) for i, t in rows), key=key)
    assert sum(x[1] > 0 for x in got) > 30


def test_long_and_empty(spark, docs_of):
    text = "a b " * 300_000
    assert [tuple(x)[:6] for x in r.runs_of(docs_of([(1, text)])).collect()] == [(1, 1, 0, 600_000, 2, 300_000_000)]
    assert r.runs_of(docs_of([]), r.plant).collect() == []
    assert [tuple(x) for x in r.word_runs(docs_of([(1, "x " * 9), (2, "y"), (None, None)])).collect()] == [(1, 0, 9, 1)]
