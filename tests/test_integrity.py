import hashlib

import pytest
from pyspark.sql import functions as F

from factloom.operators import records
from factloom.sources import integrity


def test_canonical_lines(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None), (1, "a", 1.5)], "k long, z string, a double")
    path = str(tmp_path / "lines")
    n, digest = integrity.write_canonical_jsonl(rows, path, ["k"])
    assert n == 2 and [r[0] for r in spark.read.text(path).collect()] == ['{"a":1.5,"k":1,"z":"a"}', '{"a":null,"k":2,"z":"b"}']
    assert integrity.write_canonical_jsonl(rows, path, ["k"]) == (2, digest)
    assert integrity.read_canonical_jsonl(spark, path, "a double, k long, z string", digest).count() == 2
    with pytest.raises(ValueError, match="hash"):
        integrity.read_canonical_jsonl(spark, path, "k long", "0" * 64)
    with pytest.raises(ValueError, match="empty"):
        integrity.write_canonical_jsonl(rows.limit(0), path, ["k"])
    with pytest.raises(ValueError, match="repeats"):
        integrity.write_canonical_jsonl(rows.unionByName(rows), path, ["k"])
    assert integrity.hash_of(spark, path) == digest  # what was refused changed nothing


def test_numbered_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [(r["line"], r["row"]["a"]) for r in integrity.read_numbered_jsonl(spark, str(tmp_path / "x.jsonl"), "a long").orderBy("line").collect()] == [(1, 1), (3, 2)]


def test_shards(spark, tmp_path):
    rows = spark.createDataFrame([("d1", 2, "x"), ("d1", 1, "y"), ("d2", 1, "z")], "document_id string, n long, t string")
    path = str(tmp_path / "shards")
    integrity.write_shards(rows, path, "document_id", ["n"])
    assert [r["t"] for r in integrity.read_shards(spark, path, "document_id", ["d1"]).collect()] == ["y", "x"]
    with pytest.raises(ValueError, match="missing or changed"):
        integrity.read_shards(spark, path, "document_id", ["d1", "nobody"])
    spark.createDataFrame([(9, "new")], "n long, t string").write.mode("append").parquet(f"{path}/shards/document_id=d1")
    with pytest.raises(ValueError, match="missing or changed"):
        integrity.read_shards(spark, path, "document_id", ["d1"])


def test_store_keeps_its_rules(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "fact_id string, document_id string, metric_year long, canonical_metric string, normalized_unit string, normalized_value double, is_selected boolean"
    facts = spark.createDataFrame([("a", "d", 2020, "m", "u", 1.0, True), ("b", "d", 2020, "m", "u", 2.0, False)], schema)
    none = spark.createDataFrame([], "x string")
    tables = {"facts": facts, "conflicts": none, "decisions": none, "metadata": none}
    integrity.write_store(spark, path, tables, integrity.STORE_CHECKS)
    assert integrity.read_store(spark, path, "facts").count() == 2 and [r["fact_id"] for r in integrity.read_store(spark, path, "selected").collect()] == ["a"]
    with pytest.raises(ValueError, match="selected_twice"):
        integrity.write_store(spark, path, tables | {"facts": facts.withColumn("is_selected", F.lit(True))}, integrity.STORE_CHECKS)
    assert integrity.read_store(spark, path, "facts").filter("is_selected").count() == 1


def test_traces(spark, tmp_path):
    path = str(tmp_path / "traces")
    given = spark.createDataFrame([('{"b": 1, "a": "é", "n": {"y": [1, 2], "x": null}}',), ('{"n":{"x":null,"y":[1,2]},"a":"é","b":1}',), ('{"b": 2}',)], "trace string")
    names = [r["trace_hash"] for r in integrity.append_traces(given, path).collect()]
    assert names[0] == names[1] != names[2] and integrity.read_traces(spark, path).count() == 2
    assert hashlib.sha256('{"a":"é","b":1,"n":{"x":null,"y":[1,2]}}'.encode()).hexdigest() == names[0]
    integrity.append_traces(given, path)
    assert integrity.read_traces(spark, path).count() == 2
    wanted = spark.createDataFrame([(names[2],), ("0" * 64,)], "trace_hash string")
    assert [r["trace"] for r in integrity.read_traces(spark, path, wanted).collect()] == ['{"b":2}']
    spark.createDataFrame([(names[2], '{"b":3}')], "trace_hash string, trace string").write.mode("append").parquet(path)
    with pytest.raises(Exception, match="name says"):
        integrity.read_traces(spark, path).collect()


def test_a_write_that_breaks_off_leaves_the_old_table(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("h",), ("g",)], "hash_id string")
    one = spark.createDataFrame([(1.0,)], "w double")
    path = str(tmp_path / "graph")
    integrity.write_graph(rows, one, path)
    rename, calls = integrity._rename, []

    def broken(fs, source, target):
        calls.append(target)
        if len(calls) == 2:
            raise OSError("killed")
        rename(fs, source, target)

    monkeypatch.setattr(integrity, "_rename", broken)
    with pytest.raises(OSError, match="killed"):
        integrity.write_graph(rows.limit(1), one, path)
    assert not integrity.exists(spark, path) and [df.count() for df in integrity.read_graph(spark, path)] == [2, 1]
    monkeypatch.setattr(integrity, "_rename", rename)
    integrity.write_graph(rows.limit(1), one, path)
    assert [df.count() for df in integrity.read_graph(spark, path)] == [1, 1] and integrity.settled(spark, path) == path
    assert not list(tmp_path.glob("graph.old-*"))


def test_pointer_is_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "CURRENT")
    for content in ("one", "two"):
        integrity.replace_text(spark, path, content)
        assert integrity.read_text(spark, path) == content and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["CURRENT"]


def test_line_numbers_over_splits(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("".join(f'{{"a": {i}}}\n' if i % 3 else "\n" for i in range(1, 4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = integrity.read_numbered_jsonl(spark, str(tmp_path / "x.jsonl"), "a long").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["line"], r["row"]["a"]) for r in rows) == [(i, i) for i in range(1, 4000) if i % 3]


def test_cache_computes_once(spark, tmp_path):
    path, asked = str(tmp_path / "cache"), []

    def compute(misses):
        asked.append(sorted(r["k"] for r in misses.collect()))
        return misses.withColumn("v", F.upper("k"))

    first = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    assert sorted(r["v"] for r in integrity.through_cache(first, path, "k", compute).collect()) == ["A", "A", "B"]
    second = spark.createDataFrame([("b",), ("c",)], "k string")
    assert sorted(r["v"] for r in integrity.through_cache(second, path, "k", compute).collect()) == ["B", "C"] and asked == [["a", "b"], ["c"]]
    known, missing = integrity.reusable(second, spark.read.parquet(path).filter("k <> 'c'"), "k")
    assert [r["k"] for r in known.collect()] == ["b"] and [r["k"] for r in missing.collect()] == ["c"]


def test_vectors_and_translations(spark, tmp_path):
    old = spark.createDataFrame([("h", "text", [1.0])], "hash_id string, content string, embedding array<float>")
    row = integrity.vectors(old).first()
    assert (row["embedding_text"], row["metadata"]) == ("text", {})
    assert integrity.vectors(old.withColumn("metadata", F.lit('{"a": "b"}'))).first()["metadata"] == {"a": "b"}
    chunks = spark.createDataFrame([("h",), ("gone",)], "hash_id string")
    with pytest.raises(Exception, match="no vector for chunk gone"):
        integrity.complete_vectors(chunks, old).collect()
    t = lambda *xs: spark.createDataFrame(list(xs), "text string, translation string")
    got = integrity.translated(spark.createDataFrame([("x",), ("y",), ("z",)], "text string"), t(("x", "1")), t(("x", "2"), ("y", "3"))).orderBy("text").collect()
    assert [(r["translation"], r["tier"]) for r in got] == [("1", "static"), ("3", "cache"), (None, "provider")]
    path = str(tmp_path / "graph")
    integrity.write_graph(chunks, old, path)
    assert [df.count() for df in integrity.read_graph(spark, path)] == [2, 1]
    table = str(tmp_path / "table")
    integrity.rewrite(chunks, table)
    integrity.rewrite(spark.read.parquet(table).filter("hash_id = 'h'"), table)
    assert spark.read.parquet(table).count() == 1


def test_records(spark):
    schema = "fact_id string, document_id string, stock_code string, stock_name string, company_full string, report_year long, metric_year long, canonical_metric string, normalized_value decimal(10,2), normalized_value_text string, normalized_unit string, statement string, confidence_score string, source_table_id string, line_range string"
    facts = spark.createDataFrame([("f", "d", "1", "", "Full", 2020, 2020, "m", None, "1.50", "u", "s", "1", "t", None)], schema)
    rows = records.fact_records(facts)
    assert rows.columns == list(records.FACT_RECORD) and (rows.first()["company"], rows.first()["normalized_value"]) == ("Full", "1.50")
    assert tuple(records.record_violations(rows.unionByName(rows), {"stock_code": ["2"], "metric_year": []}, "u").first()) == (2, 1, 0, 0)
    assert rows.select(records.record_shape(rows)).first()[0] is None and rows.withColumn("statement", F.lit(None)).select(records.record_shape(rows)).first()[0] == "statement"
    nested = spark.createDataFrame([], "a struct<gold:string,b:array<struct<Answer:string>>>, c string")
    assert records.forbidden_fields(nested.schema, frozenset({"gold", "answer"})) == ["a.gold", "a.b.Answer"]
    assert records.portable(spark.createDataFrame([(("r", 1), "raw", 2)], "a struct<raw:string,n:long>, raw string, c long"), ("raw",)).schema.simpleString() == "struct<a:struct<n:bigint>,c:bigint>"
    entries = spark.createDataFrame([("Big Co", 2020), ("Small", 2021)], "name string, report_year long")
    assert [r["name"] for r in records.catalog(entries, F.col("name"), "big c", 2020).collect()] == ["Big Co"] and records.catalog(entries, F.col("name"), " ").count() == 2
    labels = spark.createDataFrame([("q1", "text"), ("q1", "table"), ("q2", "table")], "q string, kind string")
    assert sorted(map(tuple, records.channel(labels, "q", F.col("kind") == "text").collect())) == [("q1", "text"), ("q2", "table")]
    got = records.in_plan_order(spark.createDataFrame([("b", 1), ("x", 2)], "id string, v long"), ["a", "b"], "id").collect()
    assert {(r["id"], r["place"], r["state"]) for r in got} == {("a", 0, "missing"), ("b", 1, "found"), ("x", None, "unplanned")}
