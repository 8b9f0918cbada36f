"""SentencePiece encoding and decoding by suffix-array matching.

The words of a batch that are not known yet are concatenated and indexed by a
suffix array. Every vocabulary piece is looked up by binary search; the suffixes
in its range are its occurrences, each an edge from its first to its last place.
The edges are sorted by position and relaxed from left to right: a unigram model
keeps the best-scoring edge into each place; a byte-pair model keeps the edge
whose piece may follow the piece that ends where it starts, which is unique.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import small_batches

#: The mark that SentencePiece writes for a space; inside this module it is a space again.
MARK = "▁"
_GAP = 0xFF  # stands between words of the index; no byte of UTF-8
#: Words that an encoder remembers before it starts afresh.
REMEMBERED = 800_000


class Pieces:
    """A vocabulary: pieces by id with scores; ``merges`` tells a byte-pair model from a unigram model."""

    def __init__(self, pieces: dict[int, str], scores: dict[int, float], byte_ids: dict[int, int], unknown: int, merges: bool, prefix: bool = True):
        self.ids = sorted(i for i, p in pieces.items() if p)
        self.text = [pieces[i].replace(MARK, " ") for i in self.ids]
        self.raw = [t.encode() for t in self.text]
        self.score = np.array([scores[i] for i in self.ids])
        self.scores = self.score.tolist()
        self.by_text = {t: k for k, t in enumerate(self.text)}
        self.byte_ids, self.unknown, self.merges, self.prefix = byte_ids, unknown, merges, prefix
        self.out = np.array([*self.ids, unknown], dtype=np.uint32)
        self.written = dict(zip(self.ids, self.raw)) | {i: bytes([b]) for b, i in byte_ids.items()} | {unknown: " ⁇ ".encode()}
        self.words = -(-max(map(len, self.raw)) // 8)
        lengths = np.array([len(r) for r in self.raw])
        pad = lambda fill: np.frombuffer(b"".join(r.ljust(8 * self.words, fill) for r in self.raw), ">u8").reshape(-1, self.words).astype(np.uint64)
        self.low, self.high, self.lengths = pad(b"\x00"), pad(b"\xff"), lengths
        inner = any(" " in t.lstrip(" ") for t in self.text)
        # Places that no piece reaches across: before a space behind another character, and around characters in no piece.
        lone = "".join(c for c in "\n\t\r" if not any(c in t for t in self.text))
        self.split = re.compile(".+" if inner else f" *[^ {lone}]+|[{lone}]| +" if lone else " *[^ ]+| +", re.S).findall
        # Pieces of equal score are merged in the order of their places, which no two neighbours tell.
        values, counts = np.unique(self.score, return_counts=True)
        tied = set(values[counts > 1].tolist()) if merges else set()
        self.tied = [t for t, r in zip(self.text, self.score.tolist()) if r in tied and len(t) > 1]
        shortest = [t for t in self.tied if not any(o != t and o in t for o in self.tied)]
        self.has_tied = re.compile("|".join(map(re.escape, shortest))).search if shortest else None
        self.fits: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging as defined: the best-scored neighbours first, the leftmost of equals.

        A heap holds the neighbours that may merge and links tell who is next, so that
        a word of n characters takes n log n steps.
        """
        parts: list[str] = list(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            both = parts[i] + parts[after[i]]
            k = self.by_text.get(both)
            if k is not None:
                heapq.heappush(heap, (-self.scores[k], i, both))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            # An offer whose parts have merged otherwise since then is void.
            if j >= n or not parts[i] or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p]

    def may_follow(self, code: int) -> bool:
        """Whether merging the text of two pieces gives these two pieces; code: first * (n + 2) + second."""
        known = self.fits.get(code)
        if known is None:
            n = len(self.ids)
            first, second = divmod(code, n + 2)
            if second == n or (first == n and second < n and len(self.text[second]) == 1):
                known = True  # a character in no piece merges with nothing
            else:
                want = [self.text[k] for k in (first, second) if k < n]
                known = self.merge("".join(want)) == want
            self.fits[code] = known
        return known


@lru_cache(maxsize=2)
def load(model_path: str) -> Pieces:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = m.get_piece_size()
    plain = {i: m.id_to_piece(i) for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
    scores = {i: m.get_score(i) for i in plain}
    merges = all(s == round(s) for s in scores.values())
    return Pieces(plain, scores, {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}, m.unk_id(), merges)


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` bytes and more, and the eight bytes that each begins with."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : n + k]
    rank, width = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1, 8
    while width < depth:
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - width)] = rank[width:]
        rank = np.unique(rank * (n + 2) + behind, return_inverse=True)[1].astype(np.int64) + 1
        width *= 2
    return np.argsort(rank, kind="stable"), key


def occurrences(pieces: Pieces, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, piece) of every occurrence of every piece, by binary search in the suffix array."""
    n, words = len(data), pieces.words
    order, key = suffix_array(data, 8 * words)
    key = np.concatenate((key, np.zeros(8 * words, np.uint64)))

    def bound(target: np.ndarray, upper: bool) -> np.ndarray:
        low, high = np.zeros(len(target), np.int64), np.full(len(target), n, np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_]) // 2
            at = order[mid]
            right = np.full(len(open_), upper)
            for w in range(words - 1, -1, -1):
                mine, other = key[at + 8 * w], target[open_, w]
                right = (mine < other) | ((mine == other) & right)
            low[open_] = np.where(right, mid + 1, low[open_])
            high[open_] = np.where(right, high[open_], mid)

    first, last = bound(pieces.low, False), bound(pieces.high, True)
    counts = last - first
    piece = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    return order[np.repeat(first, counts) + inside], piece


def encode_words(pieces: Pieces, words: list[str]) -> list[bytes]:
    """Little-endian 32-bit ids of each word. Words with pieces of equal score are not indexed but merged as defined, as places decide them."""
    if not pieces.has_tied:
        return _indexed(pieces, words)
    tied = [pieces.has_tied(w) is not None for w in words]
    rest = iter(_indexed(pieces, [w for w, t in zip(words, tied) if not t]))
    return [_merged(pieces, w) if t else next(rest) for w, t in zip(words, tied)]


def _indexed(pieces: Pieces, words: list[str]) -> list[bytes]:
    if not words:
        return []
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    data = np.frombuffer(bytes([_GAP]).join(raw) + bytes([_GAP]), np.uint8)
    sizes = np.array([len(r) for r in raw])
    begins = np.cumsum(sizes + 1) - sizes - 1
    base = np.repeat(begins, sizes + 1)  # where the word of each place begins
    start, piece = occurrences(pieces, data)
    n = len(pieces.ids)
    length = pieces.lengths[piece] if len(piece) else np.empty(0, np.int64)
    # Characters that are no piece get an edge of their own.
    lead = np.flatnonzero(((data & 0xC0) != 0x80) & (data != _GAP))
    chars = np.where(data[lead] < 0x80, 1, np.where(data[lead] < 0xE0, 2, np.where(data[lead] < 0xF0, 3, 4)))
    width = np.zeros(len(data), np.int64)
    width[lead] = chars
    alone = np.zeros(len(data), bool)
    alone[start[length == width[start]]] = True
    strange = lead[~alone[lead]]
    start = np.concatenate((start, strange))
    piece = np.concatenate((piece, np.full(len(strange), n)))
    end = start + np.concatenate((length, width[strange]))

    # Sorted by how far into its word an edge ends, edges of one step do not depend on each other.
    depth = end - base[start]
    order = np.lexsort((end, depth))
    start, piece, end, depth = start[order], piece[order], end[order], depth[order]
    last = np.full(len(data) + 1, -1, np.int64)  # best edge into each place
    if pieces.merges:
        at_piece = np.full(len(data) + 1, -1, np.int64)
        at_piece[begins] = n + 1  # nothing before
    else:
        value = np.full(len(data) + 1, -np.inf)
        value[begins] = 0.0
        gain = np.concatenate((pieces.score, [pieces.score.min() - 10.0]))
    steps = np.flatnonzero(np.diff(depth, prepend=-1))
    for lo, hi in zip(steps, np.append(steps[1:], len(depth))):
        s, p, e = start[lo:hi], piece[lo:hi], end[lo:hi]
        if pieces.merges:
            before = at_piece[s]
            ok = np.flatnonzero(before >= 0)
            # The first piece of a word has nothing before it: code n for the first part.
            codes, which = np.unique(np.where(before[ok] == n + 1, n, before[ok]) * (n + 2) + p[ok], return_inverse=True)
            fits = np.array([pieces.may_follow(c) for c in codes.tolist()], bool)
            ok = ok[fits[which]]
            last[e[ok]] = lo + ok
            at_piece[e[ok]] = p[ok]
        else:
            new = value[s] + gain[p]
            best = np.lexsort((s, new, e))
            best = best[np.flatnonzero(np.diff(np.append(e[best], -1)))]
            value[e[best]], last[e[best]] = new[best], lo + best

    # Back from the end of every word at once.
    here = begins + sizes
    live = np.flatnonzero(sizes > 0)
    lost = np.zeros(len(words), bool)
    steps_of, edge_of = [], []
    while len(live):
        edge = last[here[live]]
        lost[live[edge < 0]] = True
        live, edge = live[edge >= 0], edge[edge >= 0]
        steps_of.append(live)
        edge_of.append(edge)
        here[live] = start[edge]
        live = live[here[live] > begins[live]]
    word_of = np.concatenate(steps_of) if steps_of else np.empty(0, np.int64)
    edge = np.concatenate(edge_of) if edge_of else np.empty(0, np.int64)
    order = np.lexsort((start[edge], word_of))
    word_of, edge = word_of[order], edge[order]
    known = piece[edge] < n
    count = np.where(known, 1, end[edge] - start[edge] if pieces.byte_ids else 1)
    slot = np.cumsum(count) - count
    ids = np.empty(int(count.sum()), "<u4")
    ids[slot[known]] = pieces.out[piece[edge[known]]]
    for k in np.flatnonzero(~known).tolist():
        if pieces.byte_ids:
            ids[slot[k] : slot[k] + count[k]] = [pieces.byte_ids[b] for b in data[start[edge[k]] : end[edge[k]]].tolist()]
        else:
            ids[slot[k]] = pieces.unknown
    per_word = np.bincount(word_of, weights=count, minlength=len(words)).astype(np.int64)
    stops = np.cumsum(per_word) * 4
    blob = ids.tobytes()
    out = [blob[a:b] for a, b in zip((stops - per_word * 4).tolist(), stops.tolist())]
    for k in np.flatnonzero(lost).tolist():
        out[k] = _merged(pieces, words[k])
    return out


def _merged(pieces: Pieces, word: str) -> bytes:
    ids: list[int] = []
    for part in pieces.merge(word):
        k = pieces.by_text.get(part)
        if k is not None:
            ids.append(pieces.ids[k])
        elif pieces.byte_ids:
            ids.extend(pieces.byte_ids[b] for b in part.encode("utf-8", "surrogatepass"))
        else:
            ids.append(pieces.unknown)
    return np.array(ids, "<u4").tobytes()


class Encoder:
    """Encodes batches of texts; words that it has met are not matched again."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.known = pieces, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = self.pieces
        lead = " " if pieces.prefix else ""
        rows = [pieces.split(lead + t.replace(MARK, " ")) if t else [] for t in texts]
        new = list({w for row in rows for w in row if w not in self.known})
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list({w for row in rows for w in row})
        for at in range(0, len(new), 100_000):
            part = new[at : at + 100_000]
            self.known.update(zip(part, encode_words(pieces, part)))
        return [b"".join(map(self.known.__getitem__, row)) for row in rows]


def decode(pieces: Pieces, ids: bytes) -> str:
    """The text of little-endian 32-bit ids; bytes that are no UTF-8 become U+FFFD, the unknown id U+2047."""
    out = b"".join(map(pieces.written.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    text = out.decode("utf-8", "replace")
    return text.removeprefix(" ") if pieces.prefix else text


@lru_cache(maxsize=2)
def _encoder(model_path: str) -> Encoder:
    return Encoder(load(model_path))


_SCHEMA = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def _run(model_path: str, chars: int):
    def run(batches):
        encoder = _encoder(model_path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                stop, total = at, 0
                while stop < len(texts) and (stop == at or total + len(texts[stop]) <= chars):
                    total += len(texts[stop])
                    stop += 1
                rows = []
                for doc_id, text, coded in zip(ids[at:stop], texts[at:stop], encoder.encode(texts[at:stop])):
                    back = decode(encoder.pieces, coded)
                    rows.append((doc_id, len(coded) // 4, zlib.crc32(coded), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text.replace(MARK, " ")))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.bool_())],
                    names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"],
                )
                at = stop

    return run


def encode_documents(docs: DataFrame, model_path: str, chars: int = 4 << 20) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_crc32 of the ids, decoded_sha256 of the text decoded from them, round_trip.

    Null and empty texts have no tokens. Texts are indexed in parts of about
    ``chars`` characters, a longer text alone; nothing is shuffled. Repeated rows
    give equal rows, an empty table an empty result.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_run(model_path, chars), _SCHEMA)
