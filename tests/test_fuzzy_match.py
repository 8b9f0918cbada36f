"""fuzzy_match against difflib.get_close_matches over all known names."""

import difflib
import random

import pytest

from factloom.operators import chunking
from factloom.plans import catalog

FIRST = "old cold bold blue big tin tiny".split()
SECOND = "anvil bolt gear gizmo ring widget".split()


def _best(names, known, cutoff):
    out = {}
    for name in set(names) - {None}:
        for match in difflib.get_close_matches(name, sorted(set(known) - {None}), 1, cutoff):
            out[name] = (match, difflib.SequenceMatcher(None, match, name).ratio())
    return out


def _frame(spark, names):
    return spark.createDataFrame([(x,) for x in names], "name string")


def _found(spark, names, known, cutoff):
    rows = chunking.fuzzy_match(_frame(spark, names), _frame(spark, known), cutoff).collect()
    assert len(rows) == len({r["name"] for r in rows})
    return {r["name"]: (r["match"], r["ratio"]) for r in rows}


def test_names_that_differ_in_the_first_letter_meet(spark):
    assert _found(spark, ["old anvil", "lue bolt"], ["cold anvil", "blue bolt", "tin gear"], 0.85) == {"old anvil": ("cold anvil", 18 / 19), "lue bolt": ("blue bolt", 16 / 17)}


@pytest.mark.parametrize("cutoff", [0.0, 0.3, 0.6, 2 / 3, 0.7, 0.85, 0.9, 1.0])
def test_equals_brute_force(spark, cutoff):
    rng = random.Random(3)
    known = [f"{a} {b}" for a in FIRST for b in SECOND] + ["", "a", "ab", "aaaaaaaa", "abababab", "日本語 株式", "é🎉x", "x" * 230 + "yz", None]
    names = [None, "", "zq", "aaaaaaa", "babababa", "日本株式", "🎉x", "x" * 225]
    for name in known[:-1]:
        letters = list(name)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(letters))
            letters[at : at + rng.randint(0, 1)] = rng.choice(["", "o", "l", "xy"])
        names.append("".join(letters))
    names += ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 12))) for _ in range(30)]
    assert _found(spark, names, known, cutoff) == _best(names, known, cutoff)


def test_query_asks_for_all_names_and_for_others(spark, tmp_path):
    known = ["old anvil", "cold anvil", "cold bolt", "old bolt", "bold gear", "tin", "", None, "tin"]
    spark.createDataFrame(enumerate(known, 1), "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    rows = catalog.queries()["fuzzy_match"](spark, str(tmp_path)).collect()
    names = [x for name in known[:-2] for x in (name, name[1:], name[:-1])]
    want = _best(names, known, 0.9)
    assert {r["name"]: (r["match"], r["ratio"]) for r in rows} == want and len(rows) == len(want)
    assert set(known) - {None} <= set(want) and any(name not in known for name in want)


def test_query_equals_brute_force_on_the_smallest_scale(spark):
    known = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_name").distinct().collect()]
    rows = catalog.queries()["fuzzy_match"](spark, "/root/testdata/sf0.001").collect()
    assert {r["name"]: (r["match"], r["ratio"]) for r in rows} == _best([x for n in known for x in (n, n[1:], n[:-1])], known, 0.9)
