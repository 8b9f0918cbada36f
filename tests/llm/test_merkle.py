"""Trees, proofs and folds equal a plain recursion; a changed row fails, whatever its place."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from factloom.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, digest string, idx int, grp int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], text)))


def climb(nodes):
    """The root, and for each node the (left, right) siblings of every level."""
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, over = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at : at + 8]
            for k in range(len(run)):
                for i in under[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h(*run))
            over.append(sum(under[at : at + 8], []))
        nodes, under = up, over
    return nodes[0], paths


def by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    groups = [(lang, sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))) for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode()))]
    trees = [climb([leaf(r, r[4]) for r in of]) for _, of in groups]
    root, above = climb([t[0] for t in trees])
    out = []
    for (_, of), (subroot, paths), up in zip(groups, trees, above):
        for r, path in zip(of, paths):
            path = path + up
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            at = leaf(r, "".join(c.lower() if c.isascii() else c for c in r[4]) if changed else r[4])
            for left, right in path:
                at = h(left, at, right)
            out.append((r[0], leaf(r, r[4]), subroot, root, h(*(a + b for a, b in path)), at, at == root))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


def made(spark, rows):
    return spark.createDataFrame([(*r, "mine", 7, 8) for r in rows], COLUMNS)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 2, None: 1}, {"en": 8, "de": 9, "": 1}, {"en": 65, None: 64, "éa": 63, "z": 513}, {f"l{i}": 1 + i % 3 for i in range(20)}])
def test_equal_to_a_plain_recursion(spark, sizes):
    rows, i = [], 0
    for lang, n in sizes.items():
        for k in range(n):
            i += 1
            rows.append((i * 7 % 997, f"S{k % 3}" if k % 4 else None, lang, k if k % 5 else None, None if k % 11 == 3 else f"Text {i} Émile" if k % 6 else "no capital here"))
    got = [tuple(r) for r in merkle.manifest(made(spark, rows), merkle.tampered_third(F.col("doc_id"))).collect()]
    assert ordered(got) == ordered(by_hand(rows))
    if len(rows) > 20:
        assert 0 < sum(not r[-1] for r in got) < len(got) / 2


def test_nulls_repeats_and_ties(spark):
    rows = [(None, None, None, None, None)] * 3 + [(4, "s", "en", 1, "Same")] * 20 + [(4, "t", "en", 1, "Other"), (None, "s", "en", 2, ""), (5, "s", "en", 0, "x" * 200_000)]
    got = [tuple(r) for r in merkle.manifest(made(spark, rows), merkle.tampered_third(F.col("doc_id"))).collect()]
    assert ordered(got) == ordered(by_hand(rows))


def test_untouched_rows_verify_and_empty_tables_are_empty(spark):
    rows = [(i, "s", "en", i, f"A {i}") for i in range(30)]
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in merkle.manifest(made(spark, rows)).collect())
    assert merkle.manifest(made(spark, [])).collect() == []


def test_values_cannot_be_shifted_between_columns(spark):
    one = spark.range(1).select(merkle.leaf(F.lit("ab"), F.lit("c")).alias("x"), merkle.leaf(F.lit("a"), F.lit("bc")).alias("y"), merkle.leaf(F.lit(None), F.lit("-")).alias("z"), merkle.leaf(F.lit("-"), F.lit(None)).alias("w")).first()
    assert len(set(one)) == 4
