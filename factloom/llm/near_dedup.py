"""MinHash near-deduplication with b-bit signatures.

A document is the set of its distinct word shingles. Rows with the same word
sequence collapse into one class first. Each class gets K minima; groups of ROWS
minima form band keys, and of every minimum the low BITS bits are kept in a
packed signature. Classes that share a band key are candidates. Signatures give
a collision-corrected estimate of their similarity by counting bits; candidates
whose estimate is far below the threshold go, all others are confirmed on their
full sets.

Within a bucket no list of all pairs is made while one link can do: in the first
rounds each member is compared with its most similar bucket representative, and
buckets whose members already share a component drop out. What is left of a
bucket, members of different components, is compared completely in the last
round, so that no candidate pair that could still join two components is skipped.
There each bucket compares the signatures of its members outside its largest
component with those of all its members, block by block. What is near enough forms
clusters; in each, the same is done with bitmaps of full sets. A block gives a
forest of near pairs, or one link for each pair of document and component it
joins, never all its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import drop, materialise, partitions, small_batches, spread_join
from factloom.llm.components import components

#: Words of a shingle where the caller names no size: the contract of op2.
SHINGLE = 2
PERCENT = 80
BANDS, ROWS = 48, 6
K = BANDS * ROWS
#: Bits kept of each minimum, and how many standard deviations below the threshold an estimate may lie.
BITS = 2
SLACK = 5.5
#: Rounds with one comparison per member before the complete one, at most.
STAR_ROUNDS = 2
#: Rows of a block of the complete round, on either side.
LEFT_BLOCK, RIGHT_BLOCK = 256, 512
#: Bytes of bitmaps that a block may take before it is halved.
BLOCK_BYTES = 32 << 20

_SEED = np.random.Generator(np.random.PCG64(20240229))
_A = (_SEED.integers(0, 1 << 32, K, dtype=np.uint64) | 1).astype(np.uint32)
_B = _SEED.integers(0, 1 << 32, K, dtype=np.uint64).astype(np.uint32)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_C1, _C2, _C3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)

_SIG_SCHEMA = "doc_id long, n_shingles long, digest binary, bands array<long>, signature array<long>"
_SIG_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("signature", pa.list_(pa.int64()))])


def words(text: str | None) -> list[bytes]:
    """A-Z in lower case, split at the characters 0x20 and 0x09 to 0x0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, size: int = SHINGLE) -> set:
    w = words(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < size else set(zip(*(w[i:] for i in range(size))))


def similar(a: set, b: set, percent: int = PERCENT) -> bool:
    if not a or not b:
        return False
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(joined: bytes, n_words: int, size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of words that single spaces join."""
    if not n_words:
        return np.empty(0, np.uint64)
    data = np.frombuffer(joined, np.uint8)
    n = len(data)
    power = np.full(n, _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    gaps = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [n]))
    back = np.full(n, _INVERSE, np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    word = _mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _C3)
    width = min(size, n_words)
    mixed = np.zeros(n_words - width + 1, np.uint64)
    for i in range(width):
        mixed = _mix(mixed * _C3 + word[i : n_words - width + 1 + i] + np.uint64(i + 1))
    return np.unique(mixed)


def minima(hashes: np.ndarray) -> np.ndarray:
    """K minima of the hashes under K affine permutations of 32-bit numbers."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(K, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 1024):
        block = np.multiply.outer(_A, x[at : at + 1024])
        block += _B[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _C3
    for i in range(ROWS):
        key = _mix(key * _C1 + rows[:, i] + np.uint64(1))
    return key.view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, 64 / BITS of them to a 64-bit word."""
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64)


def _sign(size: int):
    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                joined = b" ".join(w)
                hashes = shingle_hashes(joined, len(w), size)
                if len(hashes):
                    least = minima(hashes)
                    out.append((doc_id, len(hashes), xxhash.xxh3_128_digest(joined), band_keys(least), packed(least)))
                else:
                    out.append((doc_id, 0, None, None, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _SIG_ARROW)], schema=_SIG_ARROW)

    return run


def _confirm(percent: int, size: int):
    def run(batches):
        text_b, set_b = None, set()
        for batch in batches:
            a, b, ca, cb = [], [], [], []
            for one, two, comp_a, comp_b, text_1, text_2 in zip(*(c.to_pylist() for c in batch.columns)):
                if text_2 != text_b:  # rows come sorted by the second id
                    text_b, set_b = text_2, shingle_set(text_2, size)
                if similar(shingle_set(text_1, size), set_b, percent):
                    a.append(one), b.append(two), ca.append(comp_a), cb.append(comp_b)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "u": pa.array(ca, pa.int64()), "v": pa.array(cb, pa.int64())})

    return run


def forest(passes: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs of ``passes`` that keep its connected components: fewer than rows and columns together."""
    rows, cols = np.nonzero(passes)
    if len(rows) < sum(passes.shape):
        return list(zip(rows.tolist(), cols.tolist()))
    out, root = [], list(range(sum(passes.shape)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in zip(rows.tolist(), cols.tolist()):
        a, b = find(i), find(passes.shape[0] + j)
        if a != b:
            root[a] = b
            out.append((i, j))
    return out


def _pairs_by_estimate(least: float):
    """Rows (key, i, j, side, id, comp, signature) sorted by block: pairs of different components that may meet the threshold.

    A block's pairs are thinned out to a forest with the same connected components.
    """
    limit = math.floor(K * (1 - (least * (1 - 2.0**-BITS) + 2.0**-BITS)))  # unequal minima at most
    low = np.uint64(0x5555555555555555)

    def links(left: list[tuple], right: list[tuple]) -> list[tuple]:
        a, b = np.array([s for _, _, s in left], np.int64).view(np.uint64), np.array([s for _, _, s in right], np.int64).view(np.uint64)
        unequal = np.zeros((len(a), len(b)), np.int64)
        for w in range(a.shape[1]):
            x = np.bitwise_xor.outer(a[:, w], b[:, w])
            unequal += np.bitwise_count((x | x >> np.uint64(1)) & low)
        other = np.array([c for _, c, _ in left])[:, None] != np.array([c for _, c, _ in right])
        return [(left[i][0], right[j][0]) for i, j in forest((unequal <= limit) & other)]

    def run(batches):
        key, left, right = None, [], []
        for batch in batches:
            out = []
            for *now, side, doc_id, comp, signature in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    if left and right:
                        out += links(left, right)
                    key, left, right = now, [], []
                (right if side else left).append((doc_id, comp, signature))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])
        if left and right and (out := links(left, right)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])

    return run


def _with_tokens(size: int):
    """(id, the distinct shingle hashes as bytes)."""

    def run(batches):
        for batch in batches:
            ids, sets = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                ids.append(doc_id)
                sets.append(shingle_hashes(b" ".join(w), len(w), size).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["id", "tokens"])

    return run


def block_links(left: list[tuple], right: list[tuple], percent: int) -> list[tuple]:
    """(a, b, component of a, component of b): a link for each left row and right component that meet the threshold.

    Rows are (id, component, token bytes). Tokens that occur once in the block are
    in no intersection; the others become bits, and intersections bit counts.
    """
    sets = [np.frombuffer(t, np.uint64) for _, _, t in (*left, *right)]
    sizes = np.array([len(s) for s in sets], np.int64)
    _, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    owner = np.repeat(np.arange(len(sets)), sizes)
    keep_ = counts[which] > 1
    owner, bit = owner[keep_], shared[which[keep_]]
    width = int(shared[-1] + 64) // 64 if len(shared) else 1
    if len(sets) * width * 8 > BLOCK_BYTES and max(len(left), len(right)) > 1:  # long documents: smaller blocks
        h, k = (len(left) + 1) // 2, (len(right) + 1) // 2
        if len(left) > len(right):
            return block_links(left[:h], right, percent) + block_links(left[h:], right, percent)
        return block_links(left, right[:k], percent) + block_links(left, right[k:], percent)
    bits = np.zeros((len(sets), max(1, width)), np.uint64)
    np.bitwise_or.at(bits, (owner, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    n, comps = len(left), np.array([c for _, c, _ in right])
    out = []
    for i, (a, comp, _) in enumerate(left):
        both = np.bitwise_count(bits[i] & bits[n:]).sum(axis=1, dtype=np.int64)
        hit = np.flatnonzero((comps != comp) & ((100 + percent) * both >= percent * (sizes[i] + sizes[n:])) & (both > 0))
        for k in hit[np.unique(comps[hit], return_index=True)[1]].tolist():
            out.append((a, right[k][0], comp, right[k][1]))
    return out


def _compare_blocks(percent: int):
    """Rows come sorted by cluster, block and side; a block has a bounded number of rows."""

    def run(batches):
        key, left, right = None, [], []
        for batch in batches:
            out = []
            for *now, side, doc_id, comp, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    if left and right:
                        out += block_links(left, right, percent)
                    key, left, right = now, [], []
                (right if side else left).append((doc_id, comp, tokens))
            if out:
                yield _link_batch(out)
        if left and right and (out := block_links(left, right, percent)):
            yield _link_batch(out)

    return run


def _link_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["a", "b", "ca", "cb"])


def estimate(x, y):
    """Similarity from two packed signatures: equal minima, corrected for low bits that agree by chance."""
    pairs = 0x5555555555555555  # the lower bit of each field of BITS = 2
    unequal = F.aggregate(
        F.zip_with(x, y, lambda p, q: F.bit_count((p.bitwiseXOR(q).bitwiseOR(F.shiftrightunsigned(p.bitwiseXOR(q), 1))).bitwiseAND(F.lit(pairs)))),
        F.lit(0),
        lambda total, k: total + k,
    )
    chance = 1.0 / (1 << BITS)
    return ((K - unequal) / F.lit(float(K)) - F.lit(chance)) / F.lit(1 - chance)


def least_estimate(percent: int = PERCENT) -> float:
    j, chance = percent / 100, 1.0 / (1 << BITS)
    m = j + (1 - j) * chance
    return j - SLACK * (m * (1 - m) / K) ** 0.5 / (1 - chance)


def _blocks(rows: DataFrame, group: str, payload: DataFrame) -> DataFrame:
    """Rows (group, id, comp) with their ``payload`` (id and one column), dealt into blocks: those outside their group's largest component against all of it.

    Sorted by group, block (i, j) and side. A block has about LEFT_BLOCK and
    RIGHT_BLOCK rows, whatever the size of its group.
    """
    counts = rows.groupBy(group, "comp").agg(F.count(F.lit(1)).alias("n")).groupBy(group)
    counts = counts.agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("members"), (F.sum("n") - F.max("n")).alias("apart"))
    sizes = counts.select(group, F.col("members").alias("n"))
    rows = spread_join(rows, counts.filter("apart > 0"), group, "id", sizes)
    lefts, rights = F.ceil(F.col("apart") / LEFT_BLOCK), F.ceil(F.col("members") / RIGHT_BLOCK)
    place = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("long")
    span = lambda n: F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    block = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    left = F.when(F.col("comp") != F.col("main"), F.transform(span(rights), lambda j: block(place(lefts, 1), j, 0)))
    right = F.transform(span(lefts), lambda i: block(i, place(rights, 2), 1))
    own = rows.select(group, "id", "comp", F.when(left.isNotNull(), F.concat(left, right)).otherwise(right).alias("at")).join(payload, "id")
    dealt = own.select(group, F.explode("at").alias("at"), "id", "comp", payload.columns[-1])
    dealt = dealt.select(group, "at.i", "at.j", "at.side", "id", "comp", payload.columns[-1]).repartition(partitions(rows.sparkSession), group, "i", "j")
    return dealt.sortWithinPartitions(group, "i", "j", "side", "id")


def classes(docs: DataFrame, percent: int = PERCENT, star_rounds: int = STAR_ROUNDS, size: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, class_id (smallest id with this word sequence), component_id.

    Shingles have ``size`` words. Null and empty texts have no shingles and no partner. A row with a null id
    gets null classes, as nothing can name it. Rows that repeat an id count as one document: the links of
    each of their texts are its links. Ties go to the smaller id. An empty table
    gives an empty result. Band keys of a pair at the threshold meet with
    probability 1 - (1 - J ** ROWS) ** BANDS, over 0.9999995 at J = 0.8.
    """
    spark = docs.sparkSession
    small_batches(spark)
    spent: list[DataFrame] = []

    def written(df: DataFrame, label: str) -> DataFrame:
        spent.append(materialise(df, f"op2-{label}"))
        return spent[-1]

    signed = materialise(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sign(size), _SIG_SCHEMA), "op2-signed")
    named = signed.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    owners = materialise(named.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies")), "op2-owners")
    firsts = owners.select(F.col("class_id").alias("id")).distinct()
    reps = named.join(firsts, named["doc_id"] == firsts["id"], "left_semi").select(F.col("doc_id").alias("id"), "bands", "signature")
    reps = written(reps, "reps")

    rows = reps.select("id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high")
    shared = written(shared.select("key", "n"), "shared")
    buckets = written(spread_join(rows, shared, "key", "id", shared).distinct(), "buckets")
    # A member that meets many others stands in the middle of its group: the better representative.
    members = written(buckets.groupBy("id").agg(F.sum("n").alias("degree")), "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id IS NOT NULL AND text IS NOT NULL").join(members, "id", "left_semi")
    # Copies of a class need no texts of their own: only ids that stand for a class are members.
    texts = written(texts, "texts")
    marks = written(reps.select("id", "signature").join(members, "id", "left_semi"), "marks")

    enough = least_estimate(percent)
    comp = members.select("id", F.col("id").alias("comp"))
    buckets = buckets.select("key", "id")
    tried = None

    def by_second(pairs: DataFrame, columns: DataFrame) -> DataFrame:
        """Pairs with columns of their second member: a hub that many pairs name is split."""
        return spread_join(pairs, columns, "b", "a", pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")))

    def confirmed(pairs: DataFrame, label: str) -> DataFrame:
        """Of (a, b, ca, cb) those whose full sets meet the threshold."""
        first = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
        second = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
        both = by_second(pairs, second).join(first, "a").select("a", "b", "ca", "cb", "text_a", "text_b")
        return written(both.mapInArrow(_confirm(percent, size), "a long, b long, u long, v long"), label)

    def relabelled(comp: DataFrame, found: DataFrame, label: str) -> DataFrame:
        to = components(found.select("u", "v")).withColumnRenamed("node", "comp")
        return written(comp.join(to, "comp", "left").select("id", F.coalesce("component", "comp").alias("comp")), label)

    n_members = members.count()
    for turn in range(star_rounds):
        placed = buckets.join(comp if turn else members.withColumn("comp", F.col("id")), "id")
        hub = F.min_by(F.struct("id", "comp"), F.struct(F.xxhash64("id", F.lit(turn)) if turn else -F.col("degree"), "id"))
        hubs = placed.groupBy("key").agg(hub.alias("hub"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
        hubs = hubs.select("key", F.col("hub.id").alias("b"), F.col("hub.comp").alias("cb"))
        pairs = spread_join(placed, hubs, "key", "id", shared).filter("comp <> cb")
        pairs = pairs.select(F.col("id").alias("a"), "b", F.col("comp").alias("ca"), "cb").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, f"candidates{turn}")
        rated = by_second(pairs, marks.select(F.col("id").alias("b"), F.col("signature").alias("y")))
        rated = rated.join(marks.select(F.col("id").alias("a"), F.col("signature").alias("x")), "a").withColumn("near", estimate(F.col("x"), F.col("y")))
        best = F.max_by(F.struct("b", "cb"), F.struct("near", F.col("b")))
        pairs = rated.filter(F.col("near") >= enough).groupBy("a", "ca").agg(best.alias("best"))
        pairs = written(pairs.select("a", F.col("best.b").alias("b"), "ca", F.col("best.cb").alias("cb")), f"pairs{turn}")
        found = confirmed(pairs, f"links{turn}")
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tried = both if tried is None else tried.unionByName(both)
        n_found = found.count()
        if not n_found:
            break
        comp = relabelled(comp, found, f"comp{turn}")
        if n_found * 50 < n_members:  # a further round would settle little
            break

    # The complete round. Candidates are members of one bucket and of different components whose signatures are near
    # enough; what they connect is a cluster, and only its members' full sets are read.
    placed = buckets.join(comp, "id")
    live = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key")
    rest = written(spread_join(placed, live, "key", "id", shared), "rest")
    marked = _blocks(rest, "key", marks)
    near = written(marked.mapInArrow(_pairs_by_estimate(enough), "u long, v long").distinct(), "near")
    cluster = components(near).withColumnRenamed("node", "id").withColumnRenamed("component", "cluster")
    alive = written(cluster.join(comp, "id"), "alive")
    tokens = texts.join(alive.select("id"), "id", "left_semi").select("id", "text").mapInArrow(_with_tokens(size), "id long, tokens binary")
    blocks = _blocks(alive, "cluster", tokens)
    pairs = written(blocks.mapInArrow(_compare_blocks(percent), "a long, b long, ca long, cb long"), "meet")
    comp = materialise(relabelled(comp, confirmed(pairs, "last"), "comp"), "op2-components")
    for df in spent:
        drop(df)

    # Components carry the smallest id, for a class's id is its smallest and a component's its smallest class.
    # A text that occurs once is its own class, so that only copies are joined.
    copied = owners.filter("copies > 1").select("digest", "class_id")
    out = signed.select("doc_id", "n_shingles", "digest")
    out = spread_join(out, copied, "digest", "doc_id", owners.select("digest", F.col("copies").alias("n")), "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    sizes = owners.groupBy("class_id").agg(F.sum("copies").alias("n"))
    comp = comp.withColumnRenamed("id", "class_id")
    out = spread_join(out, comp, "class_id", "doc_id", sizes, "left")
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "class_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), whole.alias("component_id"))


def mark(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, n_shingles, class_id, component_id, kept (its id is its component's)."""
    return classes(docs, percent, size=size).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row's id of each component stays, with the columns of ``docs``; rows with a null id stay."""
    gone = mark(docs, percent, size).filter("NOT kept").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
