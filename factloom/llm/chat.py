"""Chat formatting by columnar byte assembly.

For a batch of turns the bytes of all texts lie in one Arrow buffer. numpy finds
the control strings in it, computes the length of every segment (header, escaped
content, footer), their cumulative offsets and the scatter indices, and copies
everything into one preallocated buffer, which becomes the Arrow column of
formatted turns. A conversation is the concatenation of its turns.

The template: a system turn is ``<<SYS>>text<</SYS>>``, a user turn
``<s>[INST] text [/INST]``, an assistant turn `` text</s>``; any other role
``<role>name</role>text</turn>``. Inside texts the first byte of a control string
becomes a backslash and a letter, and a backslash two, so that no text can open or
close a turn and every text can be read back.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import partitions, small_batches

#: What opens and closes a turn of each role.
FRAMES = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", "</s>")}
OTHER = ("<role>", "</role>", "</turn>")
#: The strings that no text may hold unescaped.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<role>", "</role>", "</turn>")
#: How a control string's first byte and the backslash are written.
ESCAPES = {"<": "\\l", "[": "\\b", "\\": "\\\\"}
_BACK = {v[1]: k for k, v in ESCAPES.items()}

_BACKSLASH = 92
#: Bytes of texts whose scatter indices are held at a time.
WINDOW = 4 << 20


def escape(text: str) -> str:
    """Row by row, what ``assemble`` does for whole batches."""
    text = text.replace("\\", ESCAPES["\\"])
    for control in CONTROLS:
        text = text.replace(control, ESCAPES[control[0]] + control[1:])
    return text


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, parts = [], iter(text.split("\\"))
    out.append(next(parts))
    for part in parts:
        if part:
            out.append(_BACK[part[0]] + part[1:])
        else:  # an escaped backslash: the next part is plain
            out.append("\\" + next(parts))
    return "".join(out)


def frame(role: str) -> tuple[str, str]:
    if role in FRAMES:
        return FRAMES[role]
    return OTHER[0] + escape(role) + OTHER[1], OTHER[2]


def _marks(data: np.ndarray, first_of_text: np.ndarray) -> np.ndarray:
    """Places in ``data`` that are written as two bytes: backslashes and first bytes of control strings."""
    found = [np.flatnonzero(data == _BACKSLASH)]
    for control in CONTROLS:
        code = np.frombuffer(control.encode(), np.uint8)
        at = np.flatnonzero(data[: max(0, len(data) - len(code) + 1)] == code[0])
        for k in range(1, len(code)):
            at = at[data[at + k] == code[k]]
        # A control string that begins in one text and ends in the next is none.
        found.append(at[np.searchsorted(first_of_text, at, side="right") == np.searchsorted(first_of_text, at + len(code) - 1, side="right")])
    return np.sort(np.concatenate(found))


def assemble(roles: list[str], texts: pa.Array) -> pa.Array:
    """Formatted turns of a batch, in one buffer. ``texts`` has no nulls."""
    n = len(roles)
    texts = texts.cast(pa.large_string())
    if n == 0:
        return texts
    _, offsets_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8)[offsets[0] : offsets[-1]] if data_buffer is not None else np.empty(0, np.uint8)
    starts = offsets - offsets[0]
    marks = _marks(data, starts[1:-1])

    kinds, which = np.unique(np.asarray(roles, dtype=object).astype(str), return_inverse=True)
    heads = [frame(k)[0].encode() for k in kinds]
    foots = [frame(k)[1].encode() for k in kinds]
    head_len, foot_len = np.array([len(x) for x in heads])[which], np.array([len(x) for x in foots])[which]
    marks_before = np.searchsorted(marks, starts)
    content_len = np.diff(starts) + np.diff(marks_before)
    ends = np.cumsum(head_len + content_len + foot_len)
    begins = ends - (head_len + content_len + foot_len)

    out = np.empty(int(ends[-1]), np.uint8)
    letters = data.copy()
    for plain, coded in ESCAPES.items():
        here = marks[data[marks] == ord(plain)]
        letters[here] = ord(coded[1])
    # Contents: byte i of a text goes behind its turn's header and behind the escapes before it. Scatter indices are made
    # for WINDOW bytes at a time, as they take far more room than what they place.
    base = begins + head_len - starts[:-1] - marks_before[:-1]
    for lo in range(0, len(data), WINDOW):
        hi = min(len(data), lo + WINDOW)
        first, last = np.searchsorted(starts, lo, side="right") - 1, np.searchsorted(starts, hi)
        done, stop = np.searchsorted(marks, (lo, hi))
        moved = np.zeros(hi - lo + 1, np.int64)
        moved[marks[done:stop] - lo + 1] = 1
        target = np.arange(lo + done, hi + done) + np.cumsum(moved[:-1]) + np.repeat(base[first:last], np.diff(np.clip(starts[first : last + 1], lo, hi)))
        out[target] = letters[lo:hi]
        escaped = target[marks[done:stop] - lo]
        out[escaped] = _BACKSLASH
        out[escaped + 1] = letters[marks[done:stop]]
    for parts, lengths, where in ((heads, head_len, begins), (foots, foot_len, begins + head_len + content_len)):
        for k, part in enumerate(parts):
            code = np.frombuffer(part, np.uint8)
            if len(code):
                out[np.add.outer(where[which == k], np.arange(len(code)))] = code
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(out))


def read_turn(turn: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    for role, (head, foot) in FRAMES.items():
        if turn.startswith(head) and turn.endswith(foot) and len(turn) >= len(head) + len(foot):
            return role, unescape(turn[len(head) : len(turn) - len(foot)])
    name, _, rest = turn.removeprefix(OTHER[0]).partition(OTHER[1])
    if not turn.startswith(OTHER[0]) or not rest.endswith(OTHER[2]):
        raise ValueError("not a formatted turn")
    return unescape(name), unescape(rest.removesuffix(OTHER[2]))


def read_conversation(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation: the inverse of formatting."""
    turns, at = [], 0
    while at < len(text):
        role = next((r for r, (head, _) in FRAMES.items() if text.startswith(head, at)), None)
        foot = FRAMES[role][1] if role else OTHER[2]
        head = len(FRAMES[role][0]) if role else len(OTHER[0])
        end = text.find(foot, at + head)
        if end < 0:
            raise ValueError("a turn is not closed")
        turns.append(read_turn(text[at : end + len(foot)]))
        at = end + len(foot)
    return turns


_TURN_ARROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("formatted", pa.large_string())])


def _assemble(batches):
    for batch in batches:
        roles = batch.column(2).to_pylist()
        formatted = assemble(roles, batch.column(3)).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), formatted], names=["conv_id", "turn", "role", "formatted"])


def format_turns(conversations: DataFrame) -> DataFrame:
    """Per row: conv_id, turn, role, formatted. Null roles are ``user``, null texts empty; nothing is shuffled."""
    small_batches(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(_assemble, "conv_id long, turn long, role string, formatted string")


_DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def _digest(batches):
    """Rows come sorted by conversation and turn: only hash states are kept, never a conversation."""
    now, open_, out = None, False, []

    def close():
        out.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

    for batch in batches:
        for conv_id, formatted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not open_ or conv_id != now:
                if open_:
                    close()
                now, open_, n, turns, loss, loss_chars, chars = conv_id, True, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
            role, text = read_turn(formatted)
            n, chars = n + 1, chars + len(formatted)
            turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == "assistant":  # the loss mask
                loss.update(text.encode("utf-8", "surrogatepass"))
                loss_chars += len(text)
        if len(out) > 4000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _DIGEST_ARROW)], schema=_DIGEST_ARROW)
            out.clear()
    if open_:
        close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _DIGEST_ARROW)], schema=_DIGEST_ARROW)


def digests(conversations: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted turns: n_turns, hashes of turns and of loss text, lengths.

    Turns follow ``turn``; rows of one turn follow role and formatted text, rows that are
    repeated count as often as they occur, a null turn comes first. Rows with a
    null conv_id are one conversation. An empty table gives an empty result.
    """
    turns = format_turns(conversations).repartition(partitions(conversations.sparkSession), "conv_id")
    return turns.sortWithinPartitions("conv_id", "turn", "role", "formatted").select("conv_id", "formatted").mapInArrow(_digest, _DIGEST_SCHEMA)


def conversations_text(conversations: DataFrame) -> DataFrame:
    """conv_id and its whole formatted text, for conversations that fit a row."""
    turns = format_turns(conversations).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "formatted"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["formatted"]), "").alias("formatted"))
