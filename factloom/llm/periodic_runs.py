"""Periodic runs of words: stretches that repeat with a fixed period, longer than their neighbours let them be.

The words of a batch of documents are numbered and their blocks of 1, 2, 4, ...
words named by prefix doubling, each document for itself; the last names are the
ranks of its suffix array. Two positions' common extension, to either side, is read
off the names of falling block lengths. Neighbours in the suffix array give the LCP
array, and from it the longest previous factor of each position, which cuts a
document into Lempel-Ziv blocks. A run either touches a border between two blocks or
lies inside one. Those at borders come from Main's extensions: for each border and
each period that the two blocks allow, one or more places are extended to both sides.
Those inside a block are copies of runs in its earlier occurrence; runs stand in
buckets by their start, and blocks are walked from left to right.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import small_batches

#: A run has at least so many words, and at least so many periods.
LEAST, EXPONENT = 6, 4
#: Words of one pass of the arrays; a longer document has a pass of its own.
PASS_WORDS = 1 << 18


def block_names(words: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """Names of the blocks of 1, 2, 4, ... words at each position, until all differ; one number more than words.

    Equal names are equal blocks of one document (``owner``, ascending). A name is the number
    of positions whose blocks sort before, so the last names are ranks of suffixes.
    """
    n = len(words)
    key = owner.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    at, names = np.arange(n), np.full(n + 1, -1, np.int32)
    before = np.zeros(n, np.int64)  # names of the last round
    out: list[np.ndarray] = []
    length = 1
    while True:
        order = np.argsort(key, kind="stable")
        at, key, before = at[order], key[order], before[order]
        first = np.ones(len(at), bool)
        first[1:] = key[1:] != key[:-1]
        whole = np.ones(len(at), bool)
        whole[1:] = before[1:] != before[:-1]
        place = np.arange(len(at))
        names[at] = before + np.maximum.accumulate(np.where(first, place, 0)) - np.maximum.accumulate(np.where(whole, place, 0))
        out.append(names.copy())
        alone = first & np.append(first[1:], True)
        at = at[~alone]
        if not len(at):
            return out
        before = names[at].astype(np.int64)
        then = np.minimum(at + length, n)
        inside = (then < n) & (owner[np.minimum(then, n - 1)] == owner[at])
        key = before * (n + 1) + np.where(inside, names[then] + 1, 0)
        length *= 2


def ahead(names: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that agree from ``a`` and from ``b`` on; a < b."""
    same = np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        same += (names[k][a + same] == names[k][b + same]).astype(np.int64) << k
    return same


def behind(names: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that agree up to ``a`` and up to ``b``, these two left out; a < b."""
    same = np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        x = a - same - (1 << k)
        same += ((x >= 0) & (names[k][np.maximum(x, 0)] == names[k][np.maximum(b - same - (1 << k), 0)])).astype(np.int64) << k
    return same


def previous_factors(suffixes: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per suffix in sorted order: the longest earlier factor it starts with, and where that begins.

    The candidates are the nearest suffixes to either side that begin earlier. Pointers
    jump over those that begin later, carrying the least LCP on the way.
    """
    n = len(suffixes)
    best, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for step in (-1, 1):
        to = np.arange(n) + step
        # lcp[r] stands between r - 1 and r; a last 0 ends both ways.
        least = lcp.astype(np.int64).copy() if step < 0 else np.append(lcp[1:], 0).astype(np.int64)
        live = np.flatnonzero((least > 0) & (to >= 0) & (to < n))
        live = live[suffixes[to[live]] > suffixes[live]]
        while len(live):
            through = to[live]
            least[live], to[live] = np.minimum(least[live], least[through]), to[through]
            live = live[least[live] > 0]
            live = live[suffixes[to[live]] > suffixes[live]]
        longer = least > best
        best[longer], source[longer] = least[longer], suffixes[to[longer]]
    return best, source


def _border_runs(names: list[np.ndarray], border: np.ndarray, left: np.ndarray, right: np.ndarray, first: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """Rows (start, end, period) of the runs that touch a border; left, right: lengths of the blocks beside it.

    The part of a run beyond one period is shorter than both blocks together, which bounds the
    period, and the sum of these bounds is linear in the text.
    """
    n = len(names[0]) - 1
    # Periods q with max(least - q, (exponent - 1) * q) below that sum.
    low = np.maximum(1, least - (left + right) + 1)
    many = np.maximum(0, (left + right - 1) // (exponent - 1) - low + 1)
    where = np.repeat(np.arange(len(border)), many)
    q = np.arange(len(where)) - np.repeat(np.cumsum(many) - many - low, many)
    beyond = np.maximum(least - q, (exponent - 1) * q)
    b = border[where]
    # Words equal to those a period on form a stretch; it holds one of these places if its run touches the border.
    inside = beyond <= q + 2  # else it is longer than what lies between the outer two
    places = [(b - 1 - q, q, where), (b, q, where), ((b - q)[inside], q[inside], where[inside]), ((b - q + 1)[inside], q[inside], where[inside])]
    x, q, where = (np.concatenate(c) for c in zip(*places))
    ok = (x >= first[where]) & (x + q < n)
    x, q = x[ok], q[ok]
    ok = names[0][x] == names[0][x + q]
    x, q = x[ok], q[ok]
    start, beyond = x - behind(names, x, x + q), ahead(names, x, x + q)
    end = x + beyond + q
    ok = end - start >= np.maximum(least, exponent * q)
    found = np.unique(np.stack([start[ok], end[ok], q[ok]], 1), axis=0)
    if not len(found):
        return found
    # Of one stretch the smallest period counts; multiples of it are no periods of their own.
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    return found[new]


def _copied(runs: list[tuple[int, int, int]], blocks: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """``runs`` and their copies inside blocks (begin, length, source), in order of start and period."""
    buckets: dict[int, list[tuple[int, int]]] = {}
    for start, end, q in runs:
        buckets.setdefault(start, []).append((end, q))
    starts = sorted(buckets)
    for begin, length, source in blocks:
        if length < least + 2:
            continue
        by, stop = begin - source, source + length - 1
        k = bisect_right(starts, source)
        while k < len(starts) and starts[k] < stop:  # copies are put in further on and may be copied again
            inside = [x for x in buckets[starts[k]] if x[0] <= stop]
            if inside:
                if starts[k] + by not in buckets:
                    insort(starts, starts[k] + by)
                buckets.setdefault(starts[k] + by, []).extend((end + by, q) for end, q in inside)
            k += 1
    return sorted((s, end, q) for s, found in buckets.items() for end, q in found)


def find_runs(words: np.ndarray, lengths: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """All runs (start, length, period) of each document, by start, then period.

    ``words`` holds the documents' word numbers one after another, ``lengths`` their sizes.
    A run is a stretch with smallest period q of at least ``least`` and ``exponent`` * q words
    (exponent 2 or more) that neither neighbour extends.
    """
    if exponent < 2 or least < 1:
        raise ValueError("a run has two periods at least")
    out: list[list[tuple[int, int, int]]] = [[] for _ in lengths]
    if not len(words):
        return out
    owner = np.repeat(np.arange(len(lengths)), lengths)
    firsts = np.cumsum(lengths) - lengths
    names = block_names(words, owner)
    # A run repeats at least so many words one period on; documents without such a repetition have none.
    shortest = min(max(least - q, (exponent - 1) * q) for q in range(1, least + 1))
    level = min(shortest.bit_length() - 1, len(names) - 1)
    count = np.bincount(names[level][:-1], minlength=len(words))
    searched = np.zeros(len(lengths), bool)
    searched[owner[count[names[level][:-1]] > 1]] = True
    if not searched.any():
        return out
    order = np.empty(len(words), np.int64)
    order[names[-1][:-1]] = np.arange(len(words))
    suffixes = order[searched[owner[order]]]
    lcp = np.zeros(len(suffixes), np.int64)
    pair = np.sort(np.stack([suffixes[:-1], suffixes[1:]]), axis=0)
    lcp[1:] = ahead(names, pair[0], pair[1])
    longest, source = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    longest[suffixes], source[suffixes] = previous_factors(suffixes, lcp)

    blocks: dict[int, list[tuple[int, int, int]]] = {}
    borders, left, right, floor = [], [], [], []
    for d in np.flatnonzero(searched):
        first, end = int(firsts[d]), int(firsts[d] + lengths[d])
        steps, sources, at, cut, before = longest[first:end].tolist(), source[first:end].tolist(), 0, [], 0
        while at < end - first:
            step = steps[at] or 1
            cut.append((first + at, step, sources[at] if steps[at] else first + at))
            if at:
                borders.append(first + at)
                left.append(before)
                right.append(step)
                floor.append(first)
            at, before = at + step, step
        borders.append(end)
        left.append(before)
        right.append(0)
        floor.append(first)
        blocks[int(d)] = cut
    found = _border_runs(names, np.array(borders), np.array(left), np.array(right), np.array(floor), least, exponent)
    if len(found):
        of = owner[found[:, 0]]
        for d in np.unique(of):
            base = int(firsts[d])
            runs = _copied([tuple(r) for r in found[of == d].tolist()], [b for b in blocks[int(d)] if b[2] < b[0]], least)
            out[d] = sorted((s - base, e - s, q) for s, e, q in runs)
            out[d].sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    kept, at = [], 0
    # Sorted by where the dropped part begins, so that overlapping parts merge.
    for begin, end in sorted((s + q, s + n) for s, n, q in runs):
        kept += words[at:begin] if begin > at else []
        at = max(at, end)
    return kept + words[at:]


def plant(doc_id: int | None, words: list) -> list:
    """The words, of every tenth id with a repeated passage up to the end.

    With h the CRC-32 of the decimal id and g = h // 10: where 10 divides h, word i from a = g % n
    on becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8). A null id changes nothing.
    """
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
)


def _row(doc_id, words: list, runs: list) -> tuple:
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest())


def _numbered(docs: list[list]) -> np.ndarray:
    flat = pa.array([w for words in docs for w in words], pa.binary())
    return flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _worker(edit: Callable | None, least: int, exponent: int):
    def passes(batch):
        some, total = [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = (text.as_py() or b"").split()  # bytes split at exactly the six white-space bytes
            words = edit(doc_id, words) if edit else words
            if some and total + len(words) > PASS_WORDS:
                yield some
                some, total = [], 0
            some.append((doc_id, words))
            total += len(words)
        if some:
            yield some

    def run(batches):
        for batch in batches:
            for some in passes(batch):
                lengths = np.array([len(w) for _, w in some], np.int64)
                found = find_runs(_numbered([w for _, w in some]), lengths, least, exponent)
                rows = [_row(i, words, runs) for (i, words), runs in zip(some, found)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    return run


def runs_of(docs: DataFrame, edit: Callable | None = None, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """Per row: doc_id, n_runs; of the run with most periods start, length, period, exponent_milli; two digests.

    ``runs_sha256`` is of all runs as lines start,length,period; ``collapsed_sha256`` of the words
    that ``collapse`` leaves, joined by a space. Words are what the six ASCII white-space
    characters part. ``edit`` (id, words) may change a document's words first. Null and empty
    texts have no word and no run, repeated rows equal results, an empty table an empty
    result. Rows are read one by one: nothing is shuffled, whatever repeats.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(_worker(edit, least, exponent), "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def word_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """Every run as a row: doc_id, start, length, period, in word numbers; rows without a run give none."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))

    def run(batches):
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or b"").split()
                found = find_runs(_numbered([words]), np.array([len(words)]), least, exponent)[0]
                if found:
                    start, length, period = zip(*found)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id] * len(found), pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "period": pa.array(period, pa.int64())})

    return rows.mapInArrow(run, "doc_id long, start long, length long, period long")
