"""Best-fit packing with certified bin counts.

Documents become token sequences; one longer than a bin is cut, its short piece
first. Pieces as long as a bin fill one each. The others are dealt into groups of
bounded size; each group runs best-fit decreasing and compares its bins with a
lower bound from dual-feasible functions, its certificate. Full bins are final.
Until the bins of all groups together meet the bound of all pieces, groups give up
the documents of their bins that are not full; these are dealt anew, so that
groups exchange them, and packed again. A repacking counts only if its group needs
fewer bins.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import materialise, small_batches

BIN = 1024
END_ID = 2
#: Pieces of a group, and rounds in which groups with a gap exchange documents.
GROUP_PIECES = 2048
ROUNDS = 3

_PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, copy long"
_PIECE_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("copy", pa.int64())])


# --- tokens ---------------------------------------------------------------------------------


#: White space from here on is left to the tokenizer file's own library: the fast one keeps a stack frame for each character.
LONG_RUN = 20_000
_LONG_RUN = re.compile(rf"\s{{{LONG_RUN}}}")


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable Latin-1 as it is, the others from 256 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def tokenizer(json_path: str, pattern: str):
    """Text -> its ids, as ``tokenizers`` gives them for this file without adding special tokens.

    The vocabulary's ids are its merge ranks, so that another library can encode
    with them; nothing is remembered from text to text. A text that holds a special
    token's string or a very long run of white space goes through ``tokenizers``.
    """
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(json_path)
    special = [t.content for t in own.get_added_tokens_decoder().values()]
    byte = byte_letters()
    ranks = {bytes(byte[c] for c in piece): rank for piece, rank in own.get_vocab(with_added_tokens=False).items() if piece not in special}
    plain = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special) or (len(text) >= LONG_RUN and _LONG_RUN.search(text)):
            return np.array(own.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(plain.encode_ordinary(text), "<u4")

    return encode


def cut(n: int, size: int = BIN) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: the remainder first, then whole bins."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def _tokenise(json_path: str, pattern: str, size: int, end_id: int):
    def run(batches):
        encode, end = tokenizer(json_path, pattern), np.array([end_id], "<u4")
        for batch in batches:
            out = []
            for doc_id, text, copy in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.concatenate((encode(text or ""), end))
                for k, (at, n) in enumerate(cut(len(ids), size)):
                    out.append((doc_id, k, at, n, zlib.crc32(ids[at : at + n]), copy))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _PIECE_ARROW)], schema=_PIECE_ARROW)

    return run


# --- bounds and best fit ----------------------------------------------------------------------


def lower_bound(lengths: np.ndarray, size: int = BIN) -> int:
    """The largest of the dual-feasible-function bounds on the bins that ``lengths`` need.

    f0 with every threshold (items above size - t count as whole, below t as
    nothing), and the functions u(k), which round x * (k + 1) down to multiples
    unless it is whole; both map any feasible bin to at most one bin.
    """
    return bound_of_counts(np.bincount(lengths, minlength=size + 1)[: size + 1], size)


def bound_of_counts(count: np.ndarray, size: int = BIN) -> int:
    """``lower_bound`` of ``count[n]`` items of each length n."""
    count = count.astype(np.int64)
    x = np.arange(size + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // size)
    items, weight = np.cumsum(count), np.cumsum(count * x)
    for t in range(1, size // 2 + 1):
        whole = int(items[size] - items[size - t])
        middle = int(weight[size - t] - weight[t - 1])
        best = max(best, -(-(whole * size + middle) // size))
    for k in range(1, 101):
        scaled = x * (k + 1)
        u = np.where(scaled % size == 0, x * k, (scaled // size) * size)
        best = max(best, -(-int((count * u).sum()) // (k * size)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int = BIN) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins; items of equal length keep their order."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_at: list[list[int]] = [[] for _ in range(size + 1)]  # bins by the room they have left
    mask, made = 0, 0  # bit r of mask: a bin with room r is open
    for i in order.tolist():
        need = int(lengths[i])
        fits = mask >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                mask ^= 1 << room
        else:
            room, b, made = size, made, made + 1
        bins[i], offsets[i] = b, size - room
        left = room - need
        if left:
            open_at[left].append(b)
            mask |= 1 << left
    return bins, offsets, made


def pack_group(frame: pd.DataFrame, size: int = BIN) -> pd.DataFrame:
    """One group: the new bins if they are fewer than the old ones, with the certificate.

    A bin's number is made of round, group and the bin's place in its group; -1
    in column ``bin`` says that a piece has no bin yet.
    """
    frame = frame.sort_values(["length", "doc_id", "piece", "copy"], ascending=[False, True, True, True], kind="stable")
    lengths = frame["length"].to_numpy(np.int64)
    bins, offsets, made = best_fit_decreasing(lengths, size)
    old = frame["bin"].to_numpy(np.int64)
    before = len(np.unique(old)) if (old >= 0).all() else None
    if before is not None and before <= made:  # each bin came in whole and can stay as it was
        bins, offsets, made = old, frame["offset"].to_numpy(np.int64), before
    else:
        bins = (np.int64(frame["round"].iloc[0]) << 58) + (np.int64(frame["group"].iloc[0]) << 22) + bins
    bound = lower_bound(lengths, size)
    filled = pd.Series(lengths).groupby(bins).transform("sum").to_numpy()
    out = frame[["doc_id", "piece", "start", "length", "ids_crc32", "copy"]].copy()
    out["bin"], out["offset"], out["released"] = bins, offsets, filled < size
    out["lower_bound"], out["made"] = np.int64(bound), np.int64(made)
    return out


_PACKED = _PIECE_SCHEMA + ", bin long, offset long, released boolean, lower_bound long, made long"


def pieces(docs: DataFrame, json_path: str, pattern: str, size: int = BIN, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, copy (tells rows that repeat an id apart)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("copy"))
    return rows.mapInArrow(_tokenise(json_path, pattern, size, end_id), _PIECE_SCHEMA)


def pack(docs: DataFrame, json_path: str, pattern: str, size: int = BIN, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Per piece of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset, lower_bound, made, all_bound.

    A null text is empty and takes its end token alone; null ids and rows that
    repeat an id are packed like any other. ``lower_bound`` and ``made`` are the
    certificate of the group that packed the piece: equal means that its bins
    cannot be fewer; ``all_bound`` bounds the bins of all documents together. An
    empty table gives an empty result.

    Bins that are not full meet those of other groups in up to ``rounds`` more
    rounds, which end as soon as the bound of all pieces is met.
    """
    made = materialise(pieces(docs, json_path, pattern, size, end_id), "op1-pieces")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    counts = np.zeros(size + 1, np.int64)
    for row in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``size`` rows
        counts[row["length"]] = row["n"]
    n, bound, closed = int(counts[:size].sum()), bound_of_counts(counts, size), int(counts[size])
    whole = made.filter(F.col("length") == size).withColumns({"bin": -1 - F.monotonically_increasing_id(), "offset": none, "lower_bound": one, "made": one})
    waiting = made.filter(F.col("length") < size).withColumns({"bin": F.lit(-1).cast("long"), "offset": none})
    done = [whole]
    for turn in range(rounds + 1):
        if not n:
            break
        count = max(1, math.ceil(n / group_pieces))
        # What is dealt is a whole bin, or in the first round a piece.
        unit = [F.col("bin")] if turn else [F.col("copy"), F.col("piece")]
        dealt = waiting.withColumns({"round": F.lit(turn), "group": F.pmod(F.xxhash64(*unit, F.lit(turn)), F.lit(count))})
        packed = materialise(dealt.groupBy("group").applyInPandas(lambda frame: pack_group(frame, size), _PACKED), f"op1-round{turn}")
        first = F.col("offset") == 0  # one piece of each bin
        state = packed.agg(F.count_if(first), F.count_if(first & ~F.col("released")), F.count_if("released")).first()
        if turn == rounds or count == 1 or closed + state[0] <= bound:
            done.append(packed.drop("released"))
            break
        closed, n = closed + state[1], state[2]
        done.append(packed.filter("NOT released").drop("released"))
        waiting = packed.filter("released").drop("released", "lower_bound", "made")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset", "lower_bound", "made"]
    return out.select(*columns, F.lit(bound).cast("long").alias("all_bound"))
