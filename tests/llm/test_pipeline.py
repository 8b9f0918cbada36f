import zlib

import public_tokenizers

import corpus_pipeline
from factloom.llm import near_dedup, quality, registry, toxicity
from factloom.llm.common import materialise
from tests.llm.by_hand import attention_by_hand, toxicity_by_hand
from tests.llm.conftest import HARD

SF = "/root/testdata/sf0.001"


def test_each_stage_decides_as_its_operator(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    source, labels = docs, spark.read.parquet(f"{SF}/labels.parquet")
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want = ids(docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialise(stage(spark, docs, SF), "test")
        if name == "toxicity":
            model = toxicity.train(source, labels)
            lexicon = toxicity.Lexicon(model.entries)
            want = {i for i in want if toxicity_by_hand(model, lexicon, texts[i]) < toxicity.THRESHOLD}
        elif name == "quality":
            model = quality.train(source, labels)
            want = {i for i in want if attention_by_hand(model, quality.encode(texts[i])) >= quality.THRESHOLD}
        elif name == "exact dedup":
            best = {}
            for i in sorted(want):
                key = "".join(texts[i].split(" "))
                key = "".join(c for c in key if c not in "\t\n\x0b\x0c\r")
                if key not in best or len(texts[i]) > len(texts[best[key]]):
                    best[key] = i
            want = set(best.values())
        elif name == "near dedup":
            order = sorted(want)
            sets = {i: near_dedup.shingle_set(texts[i]) for i in order}
            parent = {i: i for i in order}

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a in order:
                for b in order:
                    if b < a and near_dedup.similar(sets[a], sets[b]):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
            want = {i for i in order if find(i) == i}
        else:
            assert ids(docs) == want and docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0
            break
        assert docs.columns == columns and ids(docs) == want, name


def test_run_equals_its_stages(spark):
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0


def test_run_takes_hard_rows_and_empty_tables(spark, docs_of, hard, tmp_path):
    labels = spark.createDataFrame([(4, 1, 0), (6, 1, 0), (6, 0, 1), (10, 0, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for k, docs in enumerate((hard, docs_of([]))):
        folder = f"{tmp_path}/{k}"
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.filter("doc_id IS NOT NULL" if k else "true").write.parquet(f"{folder}/labels.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, folder).columns == docs.columns
        got = corpus_pipeline.run(spark, folder).toPandas()
        if k:
            assert got.empty
        else:
            known = {i for i, _ in HARD}
            assert {None if i != i else int(i) for i in got.doc_id} <= known and (got.groupby("sequence_id").length.sum() <= 1024).all()
            assert len(got[got.piece == 0]) == len(got[got.piece == 0].drop_duplicates(["doc_id", "ids_crc32"]))


def test_every_operator_is_registered(spark):
    names = registry.queries()
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14))
    assert set(registry.oracle_sql()) <= set(names)
    assert public_tokenizers.path("byte_bpe_50k.json") and zlib.crc32(b"1")
