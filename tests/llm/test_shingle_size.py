"""Near dedup by shingles of another size, against brute force on full sets."""

import random

import pytest

from factloom.llm import near_dedup


def _components(rows, size):
    ids, sets = [i for i, _ in rows], [near_dedup.shingle_set(t, size) for _, t in rows]
    root = {i: i for i in ids}
    for _ in ids:
        for a, x in zip(ids, sets):
            for b, y in zip(ids, sets):
                if near_dedup.similar(x, y):
                    root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("star_rounds", [0, 2])
@pytest.mark.parametrize("size", [2, 5])
def test_size_equals_brute_force(docs_of, size, star_rounds):
    rng, rows = random.Random(5), []
    for group in range(8):
        base = [f"w{rng.randrange(4000)}" for _ in range(60)]
        for changed in range(5):
            w = list(base)
            for at in range(changed):
                w[7 + 12 * at] = f"x{group}{changed}{at}"
            rows.append((len(rows) + 1, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.classes(docs_of(rows), star_rounds=star_rounds, size=size).collect()}
    assert got == _components(rows, size)


def test_two_words_drop_what_five_keep(docs_of):
    w = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(w)), (2, " ".join(["x" if i in (10, 25) else x for i, x in enumerate(w)]))]
    kept = {size: {r["doc_id"] for r in near_dedup.keep(docs_of(rows), size=size).collect()} for size in (2, 5)}
    assert kept == {2: {1}, 5: {1, 2}}
