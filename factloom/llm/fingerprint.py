"""Document fingerprints by context-triggered piecewise hashing.

A hash over the last WINDOW bytes decides where a chunk ends, so that chunks
depend on content and not on position. Each chunk becomes one character. A
fingerprint holds the block size and the signatures at this size and at twice
it; two fingerprints are compared by edit distance where their sizes meet.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import materialise, partitions, small_batches

WINDOW = 7
LEAST_BLOCK = 3
#: Characters that a signature has at most; the block size grows until it fits.
LONGEST = 64
#: Signatures of this length and more need a common run of so many characters to be alike at all.
GATE_FROM, GATE_RUN = 8, 4
#: The characters of a signature, by six-bit number.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

#: Rows of a range of ids.
AREA_ROWS = 1_000_000

_CHARS = np.frombuffer(ALPHABET.encode(), np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the last WINDOW bytes at each place."""
    out = np.zeros(len(data), np.uint32)
    factor = 1
    for back in range(min(WINDOW, len(data))):
        out[back:] += (data[: len(data) - back].astype(np.uint32) + np.uint32(1)) * np.uint32(factor)
        factor = factor * 0x01000193 % (1 << 32)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(12)
    return out


def _short_runs(signature: bytes) -> bytes:
    """Runs of one character are cut to three, as they carry little."""
    if len(signature) < 4:
        return signature
    s = np.frombuffer(signature, np.uint8)
    run = (s[3:] == s[2:-1]) & (s[2:-1] == s[1:-2]) & (s[1:-2] == s[:-3])
    return s[np.concatenate(([True] * 3, ~run))].tobytes()


class _Powers:
    """Powers of the base and of its inverse, kept for texts of usual length."""

    KEPT = 1 << 18

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n <= len(self.up):
            return self.up[:n], self.down[:n]
        out = []
        for factor in (_BASE, _INVERSE):
            a = np.full(max(n, 1 << 14), factor, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        if n <= self.KEPT:
            self.up, self.down = out
        return out[0][:n], out[1][:n]


_powers = _Powers()


def fingerprint(text: str | None) -> str:
    """``block:signature:signature at twice the block``; a null text is empty and gives ``3::``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return f"{LEAST_BLOCK}::"
    data = np.frombuffer(raw, np.uint8)
    rolling = _rolling(data)
    up, down = _powers.of(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])

    def signature(block: int) -> bytes:
        ends = np.flatnonzero(rolling % np.uint32(block) == block - 1) + 1 if block < 1 << 32 else np.empty(0, np.int64)
        if not len(ends) or ends[-1] != n:
            ends = np.append(ends, n)
        starts = np.concatenate(([0], ends[:-1]))
        chunk = _mix((total[ends] - total[starts]) * down[starts])
        return _short_runs(_CHARS[(chunk & np.uint64(63)).astype(np.int64)].tobytes())

    block = LEAST_BLOCK
    while block * LONGEST < n:
        block *= 2
    own = signature(block)
    while len(own) > LONGEST:
        block *= 2
        own = signature(block)
    while len(own) < LONGEST // 2 and block > LEAST_BLOCK:
        finer = signature(block // 2)
        if len(finer) > LONGEST:
            break
        block, own = block // 2, finer
    return f"{block}:{own.decode()}:{signature(2 * block).decode()}"


def _common_run(a: str, b: str, run: int) -> bool:
    if len(a) < run or len(b) < run:
        return False
    seen = {a[i : i + run] for i in range(len(a) - run + 1)}
    return any(b[i : i + run] in seen for i in range(len(b) - run + 1))


def _alike(a: str, b: str) -> float:
    """1 less the edit distance (insertions and deletions 1, changes 2) over both lengths."""
    if not a or not b:
        return float(a == b)
    if a == b:
        return 1.0
    if min(len(a), len(b)) >= GATE_FROM and not _common_run(a, b, GATE_RUN):
        return 0.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full  # a zero bit for each step of the longest common subsequence
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - row.bit_count()
    return 2 * common / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints, 0 where the block sizes do not meet."""
    if a == b:
        return 1.0
    block_a, one_a, two_a = a.split(":")
    block_b, one_b, two_b = b.split(":")
    block_a, block_b = int(block_a), int(block_b)
    if not one_a or not one_b:
        return 0.0
    if block_a == block_b:
        return max(_alike(one_a, one_b), _alike(two_a, two_b))
    if block_a == 2 * block_b:
        return _alike(one_a, two_b)
    if block_b == 2 * block_a:
        return _alike(two_a, one_b)
    return 0.0


def fingerprint_udf():
    """A column function: text -> fingerprint."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x) for x in texts], dtype="object")

    return F.pandas_udf(run, "string")


def likeness_udf():
    """A column function: two fingerprints -> their likeness."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(run, "double")


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


_EDGED = pa.schema([*_ARROW, ("area", pa.int32()), ("edge", pa.string()), ("text", pa.string())])


def _compared(doc_id, text: str, mark: str, following: str, following_mark: str) -> tuple:
    """A document's result, given the text that follows it."""
    take = len(text) // 4
    edited = text[: len(text) - take] + following[:take]
    edited_mark = fingerprint(edited)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, len(text), sha, mark, edited_mark, likeness(mark, edited_mark), likeness(mark, following_mark))


def _pairs(batches):
    """Rows come sorted; each but the last is compared with the one that follows. The first and the last row are handed on as edges."""
    from pyspark import TaskContext

    area, before = TaskContext.get().partitionId(), None

    def edge(kind, row):
        return (row[0], *[None] * 6, area, kind, row[1])

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _EDGED)], schema=_EDGED)

    for batch in batches:
        out = []
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            row = (doc_id, text, fingerprint(text))
            out.append((*_compared(*before, *row[1:]), area, None, None) if before else edge("first", row))
            before = row
        if out:
            yield table(out)
    if before:
        yield table([edge("last", before)])


def _edge_pairs(batches):
    for batch in batches:
        rows = [_compared(i, text, fingerprint(text), following, fingerprint(following)) for i, text, following in zip(*(c.to_pylist() for c in batch.columns))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last quarter of the code points replaced by the first
    as many of the next document in ascending order of ids, the first document
    following the last. Null ids come first; rows that repeat an id follow in the
    order of the SHA-256 of their texts, null texts being empty. A table of one row is its
    own neighbour; an empty table gives an empty result.

    Rows are dealt into as many sorted ranges as there are partitions, or one for AREA_ROWS rows,
    equal rows too, and each range is read as a stream. What it lacks is the row after its last one: the
    first and last rows of all ranges, two each, meet in a join by range.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.sha2(text, 256).alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "tie", "row"]
    ranges = max(partitions(spark), math.ceil(docs.count() / AREA_ROWS))
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    found = materialise(dealt.select("doc_id", "text").mapInArrow(_pairs, f"{_SCHEMA}, area int, edge string, text string"), "op10-ranges")
    firsts = found.filter("edge = 'first'").select(F.col("area").alias("next"), F.col("text").alias("following"))
    lasts = found.filter("edge = 'last'").select("area", "doc_id", "text")
    # A row per range: numbers alone, no texts.
    by, every = Window.orderBy("area"), Window.orderBy("area").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lasts.select("area").withColumn("next", F.coalesce(F.lead("area").over(by), F.min("area").over(every)))
    edges = lasts.join(after, "area").join(firsts, "next").select("doc_id", "text", "following")
    return found.filter("edge IS NULL").select(*_ARROW.names).unionByName(edges.mapInArrow(_edge_pairs, _SCHEMA))
