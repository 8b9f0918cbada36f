"""Byte ranges give every line once; sorted sources are compared as by hand; an index that grew equals one built anew."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import ann
from factloom.operators import retrieval as ops
from factloom.sources import ranges
from factloom.sources.lifecycle import SearchIndex


def write(path, parts):
    path.mkdir()
    for i, rows in enumerate(parts):
        (path / f"part-{i:05d}.json").write_text("\n".join(rows) + ("\n" if i % 2 else ""))


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
def test_every_line_once(spark, tmp_path, size):
    rng = random.Random(size)
    lines = [json.dumps({"d": f"k{i // 3:04d}", "t": "é" * rng.randrange(12)}, ensure_ascii=False) for i in range(90)]
    write(tmp_path / "x", [lines[:40], lines[40:41], lines[41:]])
    path = str(tmp_path / "x")
    rows = ranges.ranged(spark, path, "d", size).collect()
    assert [r["line"] for r in sorted(rows, key=lambda r: (r["path"], r["start"]))] == lines
    index = ranges.build_index(spark, path, "d", size)
    assert index.agg(F.sum("lines")).first()[0] == 90
    if size >= 64:
        asked = ranges.ranged(spark, path, "d", size, index).filter("document = 'k0017'")
        assert sorted(r["line"] for r in asked.collect()) == sorted(lines[51:54])
        assert size > 100 or asked.rdd.getNumPartitions() < 6 < ranges.ranged(spark, path, "d", size).rdd.getNumPartitions()


def test_changes_and_disorder_are_found(spark, tmp_path):
    lines = [json.dumps({"d": f"k{i:03d}"}) for i in range(50)]
    write(tmp_path / "x", [lines[:20], lines[20:]])
    path = str(tmp_path / "x")
    kept = ranges.build_index(spark, path, "d", 100).collect()
    index = spark.createDataFrame(kept, "range int, path string, start long, end long, first string, last string, lines long, digest string")
    (tmp_path / "x/part-00001.json").write_text((tmp_path / "x/part-00001.json").read_text().replace("k044", "k044"[::-1].replace("440k", "k044")).replace('{"d": "k045"}', '{"d":"k0045"}'))
    assert ranges.ranged(spark, path, "d", 100, index).filter("document = 'k003'").count() == 1
    with pytest.raises(Exception, match="changed|sorted"):
        ranges.ranged(spark, path, "d", 100, index).collect()
    write(tmp_path / "y", [lines[20:], lines[:20]])
    with pytest.raises(Exception, match="before the one"):
        ranges.build_index(spark, str(tmp_path / "y"), "d", 10_000).collect()
    write(tmp_path / "z", [lines[::-1]])
    with pytest.raises(Exception, match="sorted"):
        ranges.build_index(spark, str(tmp_path / "z"), "d", 10_000).collect()


def disagreements(sources, lead):
    out = set()
    keys = {k for rows in sources.values() for k, *_ in rows if k is not None}
    own = {n: {} for n in sources}
    for n, rows in sources.items():
        for k, o, d in rows:
            if k is not None:
                own[n].setdefault(k, []).append((o, d))
    for n in sources:
        for k in keys:
            here, there = own[n].get(k), own[lead].get(k)
            if n != lead and (here is None) != (there is None):
                out.add((k, n, "missing" if here is None else "foreign"))
            if n != lead and here and there and (min(d for _, d in here), max(d for _, d in here)) != (min(d for _, d in there), max(d for _, d in there)):
                out.add((k, n, "changed"))
            if here and len(here) > 1:
                out.add((k, n, "repeated"))
            later = [o for other, rows in own[n].items() if other > k for o, _ in rows]
            if here and later and max(o for o, _ in here) > min(later):
                out.add((k, n, "reordered"))
    return out


def test_sources_side_by_side(spark):
    rng = random.Random(8)
    for _ in range(3):
        base = [(f"k{i:03d}", i, "d") for i in range(120)]
        b = [r for r in base if rng.random() > 0.1] + [("k0505", 50, "d"), ("z", 999, "d")]
        c = [(k, o if rng.random() > 0.05 else rng.randrange(120), d if rng.random() > 0.1 else "other") for k, o, d in base] + [base[7], (None, 1, "d")]
        sources = {"a": base, "b": b, "c": c}
        frames = {n: spark.createDataFrame(rows, "key string, ordinal long, digest string") for n, rows in sources.items()}
        got = [tuple(r) for r in ranges.merge_validate(frames, "a").collect()]
        assert len(got) == len(set(got)) and set(got) == disagreements(sources, "a")
    assert ranges.merge_validate({n: f.limit(0) for n, f in frames.items()}, "a").collect() == []


def test_index_that_grew_equals_one_built_anew(spark, tmp_path):
    rng = random.Random(3)
    words = lambda: [f"w{min(int(rng.expovariate(0.3)), 20)}" for _ in range(rng.randrange(12))]
    first, second = [(i, words()) for i in range(80)], [(i, words()) for i in range(60, 140)]
    frame = lambda rows: spark.createDataFrame(rows, "k long, w array<string>")
    queries = frame([(q, [f"w{q}", f"w{q + 1}", "w0"]) for q in range(8)])
    grown, anew = SearchIndex(spark, str(tmp_path / "grown")), SearchIndex(spark, str(tmp_path / "anew"))
    assert grown.search(queries, "k", F.col("w"), 5).collect() == []
    grown.build(frame(first), "k", F.col("w"))
    grown.add(frame(second), "k", F.col("w"))
    grown.delete(frame([(i, []) for i in range(0, 200, 7)]), "k")
    grown.add(frame([(7, ["w0", "w0"])]), "k", F.col("w"))
    alive = {k: w for k, w in first} | {k: w for k, w in second}
    alive = {k: w for k, w in alive.items() if k % 7} | {7: ["w0", "w0"]}
    anew.build(frame(sorted(alive.items())), "k", F.col("w"))
    results = lambda x: sorted(tuple(r) for r in x.search(queries, "k", F.col("w"), 5).collect()) if False else sorted((r[0], r[1], r["score"], r["rank"]) for r in x.search(queries.withColumnRenamed("k", "q"), "q", F.col("w"), 5).collect())
    want = results(anew)
    assert results(grown) == want and {r["key"] for r in grown.units().collect()} == set(alive)
    grown.compact()
    assert len(grown.deltas()) == 1 and results(grown) == want
    assert grown.vacuum() == 8 and results(grown) == want  # four deltas and four manifests


def test_a_change_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    from factloom.sources import lifecycle

    index = SearchIndex(spark, str(tmp_path / "x"))
    rows = spark.createDataFrame([(1, ["a"])], "k long, w array<string>")
    index.build(rows, "k", F.col("w"))

    def killed(*_):
        raise OSError("killed")

    monkeypatch.setattr(lifecycle, "replace_text", killed)
    with pytest.raises(OSError):
        index.add(rows.withColumn("k", F.lit(2)), "k", F.col("w"))
    with pytest.raises(OSError):
        index.compact()
    assert [r["key"] for r in index.units().collect()] == [1]


def test_cells_lists_and_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 60)  # large cells are split
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (12, 16))
    v = [centres[i % 12] * 2 + rng.normal(0, 1, 16) for i in range(900)] + [np.zeros(16)] + [centres[0]] * 200
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None)], "id long, v array<double>")
    asked = rows.filter("id % 50 = 0").select(F.col("id").alias("q"), "v")
    index = ann.build(rows, "id", "v", cells=30)
    assert index.lists.count() == 1101 and index.cells.agg(F.max("parts")).first()[0] > 1
    want = sorted((r["q"], r["id"], r["rank"]) for r in ops.knn(rows, asked, "id", "q", "v", 10).collect())
    got = sorted((r["q"], r["id"], r["rank"]) for r in ann.search(index, asked, "q", "v", 10, probes=3, exact=True).collect())
    assert got == want
    near = {(r["q"], r["id"]) for r in ann.search(index, asked, "q", "v", 10, probes=8).collect()}
    assert len(near & {(q, i) for q, i, _ in want}) >= 0.9 * len(want)


def test_recall_of_the_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "embedding")
    index = ann.build(rows, "vec_id", "embedding")
    want = {(r["q"], r["vec_id"]) for r in ops.knn(rows, asked, "vec_id", "q", "embedding", 10).collect()}
    got = {(r["q"], r["vec_id"]) for r in ann.search(index, asked, "q", "embedding", 10).collect()}
    assert len(got & want) >= 0.9 * len(want)
