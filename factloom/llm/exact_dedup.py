"""Exact deduplication by Patricia tries over length-and-content-hash partitions.

Every task of the scan first inserts the normalised bytes of its own rows into a
compressed radix trie, so that a text with any number of copies leaves a task
once. The surviving strings are dealt by (length, content hash) and inserted into
the tries of the owners; a terminal node holds the best row and the number of
copies. Two texts share a group only if a trie compared all their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import materialise, partitions, small_batches, spread_join

#: The characters that normalisation deletes.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
_DELETE = {ord(c): None for c in SPACES}

#: Bytes that a task's trie takes before it gives its largest subtrees away, and what a node takes beside its label:
#: itself, the headers of its label and its owner, its dictionary of children and the entry in its parent's.
TRIE_BYTES = 96 << 20
NODE_BYTES = 320

_PART_SCHEMA = "norm_len long, content_hash long, content binary, best_chars long, keep_id long, copies long"
_PART_ARROW = pa.schema(
    [("norm_len", pa.int64()), ("content_hash", pa.int64()), ("content", pa.binary()), ("best_chars", pa.int64()), ("keep_id", pa.int64()), ("copies", pa.int64())]
)
_GROUP_SCHEMA = "text_sha256 string, keep_id long, group_size long"
_GROUP_ARROW = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


class _Node:
    __slots__ = ("kids", "label", "owner")

    def __init__(self, label: bytes):
        self.label, self.kids, self.owner = label, {}, None


def _shared_prefix(label: bytes, key: bytes, at: int) -> int:
    """How many leading bytes of ``label`` stand in ``key`` from ``at`` on."""
    if key.startswith(label, at):
        return len(label)
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if key.startswith(label[:mid], at):
            low = mid
        else:
            high = mid - 1
    return low


def better(a: tuple, b: tuple) -> tuple:
    """Of two (chars, id, copies) the owner: most characters, then the smallest id, null ids last."""
    key = lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0)
    first = a if key(a) <= key(b) else b
    return first[0], first[1], a[2] + b[2]


class PatriciaTrie:
    """A compressed radix trie over byte strings whose terminals hold an owner."""

    def __init__(self):
        self.root, self.bytes, self.size = _Node(b""), 0, 0

    def insert(self, key: bytes, owner: tuple) -> None:
        node, at, end = self.root, 0, len(key)
        while at < end:
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = _Node(key[at:])
                self.bytes += end - at + NODE_BYTES
                node, at = kid, end
                break
            same = _shared_prefix(kid.label, key, at)
            if same < len(kid.label):
                upper = _Node(kid.label[:same])
                kid.label = kid.label[same:]
                upper.kids[kid.label[0]] = kid
                node.kids[key[at]] = kid = upper
                self.bytes += NODE_BYTES
            node, at = kid, at + same
        if node.owner is None:
            node.owner = owner
            self.size += 1
        else:
            node.owner = better(node.owner, owner)

    @staticmethod
    def _walk(node: _Node, prefix: bytes) -> Iterator[tuple[bytes, tuple]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            key = prefix + node.label
            if node.owner is not None:
                yield key, node.owner
            stack.extend((kid, key) for kid in node.kids.values())

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        return self._walk(self.root, b"")

    def spill(self, down_to: int) -> Iterator[tuple[bytes, tuple]]:
        """Gives away whole subtrees of the root, largest first, until ``down_to`` bytes remain."""
        weights = {}
        for first, kid in self.root.kids.items():
            stack, weight = [kid], 0
            while stack:
                node = stack.pop()
                weight += len(node.label) + NODE_BYTES
                stack.extend(node.kids.values())
            weights[first] = weight
        for first in sorted(weights, key=weights.get, reverse=True):
            if self.bytes <= down_to:
                return
            for item in self._walk(self.root.kids.pop(first), b""):
                self.size -= 1
                yield item
            self.bytes -= weights[first]


def normalise(text: str | None) -> bytes:
    return (text or "").translate(_DELETE).encode("utf-8", "surrogatepass")


def _rows(items) -> Iterator[pa.RecordBatch]:
    block, weight = [], 0
    for content, (chars, doc_id, copies) in items:
        block.append((len(content), xxhash.xxh64_intdigest(content) - (1 << 63), content, chars, doc_id, copies))
        weight += len(content)
        if weight > 4 << 20 or len(block) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*block), _PART_ARROW)], schema=_PART_ARROW)
            block, weight = [], 0
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*block), _PART_ARROW)], schema=_PART_ARROW)


def _combine(trie_bytes: int):
    def run(batches):
        trie = PatriciaTrie()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                trie.insert(normalise(text), (len(text or ""), doc_id, 1))
                if trie.bytes > trie_bytes:
                    yield from _rows(trie.spill(trie_bytes // 4))
        yield from _rows(trie.items())

    return run


def _own(batches):
    """Rows come sorted by (length, hash): the trie of one such key is finished when the next begins."""
    trie, key, out = PatriciaTrie(), None, []

    def finished():
        for content, (_, doc_id, copies) in trie.items():
            out.append((hashlib.sha256(content).hexdigest(), doc_id, copies))

    for batch in batches:
        for *now, content, chars, doc_id, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if now != key:
                finished()
                trie, key = PatriciaTrie(), now
            trie.insert(content, (chars, doc_id, copies))
        if len(out) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _GROUP_ARROW)], schema=_GROUP_ARROW)
            out = []
    finished()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _GROUP_ARROW)], schema=_GROUP_ARROW)


def groups(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id, group_size."""
    small_batches(docs.sparkSession)
    local = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_combine(trie_bytes), _PART_SCHEMA)
    dealt = local.repartition(partitions(docs.sparkSession), "norm_len", "content_hash")
    return dealt.sortWithinPartitions("norm_len", "content_hash").mapInArrow(_own, _GROUP_SCHEMA)


def text_sha256(text) -> F.Column:
    """SHA-256 of the normalised text in UTF-8, lowercase hex."""
    return F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]", ""), 256)


def _decide(docs: DataFrame, trie_bytes: int) -> DataFrame:
    # A text that occurs once needs no partner: the join only carries groups of two and more, and splits large ones.
    many = materialise(groups(docs, trie_bytes).filter("group_size > 1"), "op3-groups")
    many = many.select(F.col("text_sha256").alias("__sha"), F.col("keep_id").alias("__keep"), F.col("group_size").alias("__size"))
    rows = docs.withColumns({"__sha": text_sha256(F.col("text")), "__own": F.col("doc_id").cast("long")})
    out = spread_join(rows, many, "__sha", "__own", many.select("__sha", F.col("__size").alias("n")), "left")
    out = out.withColumn("__keep", F.when(F.col("__size").isNull(), F.col("__own")).otherwise(F.col("__keep")))
    return out.withColumn("__size", F.coalesce("__size", F.lit(1).cast("long"))).withColumn("__kept", F.col("__own").eqNullSafe(F.col("__keep")))


def mark(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256 in place of columns of these names.

    Null and empty texts form one group. Of equal texts the row with the most
    code points stays, then the smallest id; a null id comes last. Rows that
    repeat an id within a group are all ``kept`` if that id is the owner's, as an id
    is all that can name them; ``keep`` leaves the longest of them alone. Other
    columns pass through. An empty table gives an empty result.
    """
    added = {"keep_id": "__keep", "group_size": "__size", "kept": "__kept", "text_sha256": "__sha"}
    out = _decide(docs, trie_bytes)
    return out.select(*[c for c in docs.columns if c.lower() not in added], *[F.col(v).alias(k) for k, v in added.items()])


def keep(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with its columns, whatever their names."""
    kept = _decide(docs, trie_bytes).filter("__kept")
    # Where ids repeat, several rows may bear the owner's: this costs a further shuffle, and is asked first on the ids alone.
    if not docs.select("doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        first = Window.partitionBy("__own", "__sha").orderBy(F.length("text").desc())
        kept = kept.withColumn("__row", F.row_number().over(first)).filter("__row = 1")
    return kept.select(*docs.columns)
