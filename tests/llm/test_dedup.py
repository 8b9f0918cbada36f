import hashlib
import random

from factloom.llm import exact_dedup, near_dedup
from factloom.llm.components import components
from tests.llm.conftest import HARD


def test_trie_keeps_every_string_and_its_owner():
    rng = random.Random(3)
    trie, want = exact_dedup.PatriciaTrie(), {}
    for k in range(4000):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randrange(12)))
        owner = (rng.randrange(5), k, 1)
        trie.insert(key, owner)
        want[key] = exact_dedup.better(want[key], owner) if key in want else owner
    assert dict(trie.items()) == want and trie.size == len(want)


def test_trie_spills_whole_subtrees():
    trie, keys = exact_dedup.PatriciaTrie(), {bytes([a, b]) * 50 for a in range(20) for b in range(20)}
    for k in keys:
        trie.insert(k, (1, 1, 1))
    out = [k for k, _ in trie.spill(30_000)]
    assert trie.bytes <= 30_000 and trie.size > 0 and set(out) | {k for k, _ in trie.items()} == keys and len(out) + trie.size == len(keys)


def _brute_exact(rows):
    strip = lambda t: "".join(c for c in (t or "") if c not in exact_dedup.SPACES)
    groups = {}
    for i, t in rows:
        groups.setdefault(strip(t), []).append((-len(t or ""), i is None, i))
    return sorted(
        ((i, min(groups[strip(t)])[2], len(groups[strip(t)]), i == min(groups[strip(t)])[2], hashlib.sha256(strip(t).encode()).hexdigest()) for i, t in rows),
        key=str,
    )


def test_exact_dedup_equals_brute_force(hard, docs_of):
    for rows, df in ((HARD, hard), ([], docs_of([]))):
        got = exact_dedup.mark(df, trie_bytes=1000).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert sorted(map(tuple, got), key=str) == _brute_exact(rows)


def test_exact_keep_has_the_columns_of_its_input(hard):
    kept = exact_dedup.keep(hard)
    assert kept.columns == hard.columns
    assert {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 8, 9, 10, 11}


def test_exact_keep_leaves_one_row_of_repeated_ids(docs_of):
    kept = exact_dedup.keep(docs_of([(7, "a b"), (7, "a b"), (7, "a  b"), (8, "ab"), (None, "x"), (None, "x"), (9, "y")])).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("7", "a  b"), ("9", "y"), ("None", "x")]


def _brute_near(rows):
    sets = [near_dedup.shingle_set(t) for _, t in rows]
    ids = [i for i, _ in rows]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if near_dedup.similar(sets[a], sets[b]):
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in zip(ids, sets)}


def _near_rows():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, t) for k, t in enumerate([None, "", "one", "ONE", "one two", "two one", "one  two"])]
    for base in range(12):  # chains of copies with more and more edits
        text = rng.choices(words, k=rng.choice((12, 40, 150)))
        for _ in range(14):
            rows.append((len(rows), " ".join(text)))
            for _ in range(max(1, len(text) // 25)):
                text[rng.randrange(len(text))] = rng.choice(words)
    return rows


def test_near_dedup_equals_brute_force(docs_of):
    rows = _near_rows()
    component, sizes = _brute_near(rows)
    got = near_dedup.mark(docs_of(rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == component
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_dedup_without_star_rounds_equals_brute_force(docs_of):
    rows = _near_rows()
    component, _ = _brute_near(rows)
    got = near_dedup.classes(docs_of(rows), star_rounds=0).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == component


def test_near_dedup_hard_rows(hard, docs_of):
    got = near_dedup.mark(hard)
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(HARD) and by_id[7]["component_id"] == 6 and by_id[8]["component_id"] == 6 and by_id[5]["component_id"] == 4
    assert by_id[1]["n_shingles"] == 0 and by_id[10]["n_shingles"] == 1 and by_id[None]["component_id"] is None
    kept = near_dedup.keep(hard)
    assert kept.columns == hard.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 6, 9, 10, 11, None}
    assert near_dedup.mark(docs_of([])).count() == 0


def test_signatures_estimate_similarity(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[500:2500]  # similarity 0.6
    rows = [([int(x) for x in near_dedup.packed(near_dedup.minima(a))], [int(x) for x in near_dedup.packed(near_dedup.minima(b))])]
    got = spark.createDataFrame(rows, "x array<long>, y array<long>").select(near_dedup.estimate(F.col("x"), F.col("y"))).first()[0]
    assert abs(got - 0.6) < 0.15


def test_block_links_find_every_pair():
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    rows = []
    for k in range(40):
        s = base.copy()
        s[rng.integers(0, 100, k // 2)] = rng.integers(0, 1 << 63, k // 2, dtype=np.uint64)
        rows.append((k, k, np.unique(s).tobytes()))
    sets = {i: set(np.frombuffer(t, np.uint64).tolist()) for i, _, t in rows}
    want = {(a, b) for a in range(10) for b in sets if a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert {(a, b) for a, b, _, _ in near_dedup.block_links(rows[:10], rows, 80)} == want


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(5001, 5100)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_trie_bytes_bound_the_memory_of_short_keys():
    import pyarrow as pa

    def batches():
        for at in range(0, 200_000, 2000):
            yield pa.RecordBatch.from_pydict({"doc_id": list(range(at, at + 2000)), "text": [f"{k * 7919 % 600_011}" for k in range(at, at + 2000)]})

    import tracemalloc

    tracemalloc.start()
    rows = 0
    for batch in exact_dedup._combine(8 << 20)(batches()):
        rows += batch.num_rows
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 200_000 and most < 32 << 20
