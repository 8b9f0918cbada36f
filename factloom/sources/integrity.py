"""Sinks and sources that hold what they promise: canonical files, hashed shards, a versioned store, traces, caches.

A table is written beside its place. It gets there by two renames, of the old table to a
name of its own and of the new one to the place; what reads through ``settled`` finds the
old table where a crash came between the two, and the next write puts it right. A pointer file is
replaced by one rename. Paths may lie in any file system that Hadoop knows.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.text import canonical_json


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


#: What a table is called while the one that takes its place is put there.
_OLD = ".old-"


def _siblings(spark: SparkSession, path: str) -> list:
    fs, where = _fs(spark, path.rstrip("/"))
    folder = where.getParent()
    found = fs.listStatus(folder) if fs.exists(folder) else []
    return sorted((s.getPath() for s in found if s.getPath().getName().startswith(f"{where.getName()}{_OLD}")), key=lambda p: p.getName())


def settled(spark: SparkSession, path: str) -> str:
    """Where the table of a path is: there, or, if a write broke off between its two renames, under its old name."""
    if exists(spark, path):
        return path
    old = _siblings(spark, path)
    return old[-1].toString() if old else path


def move(spark: SparkSession, source: str, target: str) -> None:
    """Puts the table ``source`` in the place of ``target``; the old one is deleted once the new one is there."""
    fs, new = _fs(spark, source)
    _, place = _fs(spark, target.rstrip("/"))
    if fs.exists(place):
        # The name sorts by time, so that of several the last is the one that was in force.
        _rename(fs, place, _fs(spark, f"{target.rstrip('/')}{_OLD}{time.time_ns():020d}")[1])
    _rename(fs, new, place)
    for old in _siblings(spark, target):
        fs.delete(old, True)


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"cannot move {source} to {target}")


def write_text(spark: SparkSession, path: str, content: str, replace: bool = True) -> None:
    fs, where = _fs(spark, path)
    out = fs.create(where, replace)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def replace_text(spark: SparkSession, path: str, content: str) -> None:
    """Writes a small file beside its place and renames it there, over an older one, in one step."""
    beside = f"{path}-{uuid.uuid4().hex}"
    write_text(spark, beside, content)
    context = spark.sparkContext
    fs_ = context._jvm.org.apache.hadoop.fs
    _, source = _fs(spark, beside)
    _, target = _fs(spark, path)
    how = context._gateway.new_array(fs_.Options.Rename, 1)
    how[0] = fs_.Options.Rename.OVERWRITE
    fs_.FileContext.getFileContext(source.toUri(), context._jsc.hadoopConfiguration()).rename(source, target, how)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def rewrite(df: DataFrame, path: str) -> None:
    """Replaces a whole Parquet table; ``df`` may read from it."""
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.parquet(beside)
    move(df.sparkSession, beside, path)


# --- canonical JSON lines -----------------------------------------------------------------------


def write_canonical_jsonl(df: DataFrame, path: str, order: list[str]) -> tuple[int, str]:
    """JSON lines with sorted keys, strictly ascending by ``order``, in parts that follow each other; (rows, hash).

    The hash is the SHA-256 of the parts' SHA-256 in order. Empty output and repeated keys
    are refused, and nothing is left behind then.
    """
    spark = df.sparkSession
    repeated = df.groupBy(*order).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        raise ValueError("rows are not strictly sorted: a key repeats")
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    line = F.regexp_replace(canonical_json(*df.columns), "\n$", "")
    df.orderBy(*order).select(line.alias("value")).write.text(beside)
    n = spark.read.text(beside).count()
    if not n:
        fs, where = _fs(spark, beside)
        fs.delete(where, True)
        raise ValueError("refusing to write an empty file")
    digest = hash_of(spark, beside)
    move(spark, beside, path)
    return n, digest


def hash_of(spark: SparkSession, path: str) -> str:
    """SHA-256 of a folder of lines: of their number and of sums of their hashes, which tasks add up on their own."""
    lines = spark.read.text(path).select(F.sha2("value", 256).alias("h"))
    part = lambda i: F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return lines.agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *[part(i) for i in range(4)]), 256)).first()[0]


def read_canonical_jsonl(spark: SparkSession, path: str, schema: str, digest: str | None = None) -> DataFrame:
    path = settled(spark, path)
    if digest is not None and hash_of(spark, path) != digest:
        raise ValueError(f"{path} is not what its hash says")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_numbered_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(source_path, line, row) of JSON lines, blank ones left out, each with its line number.

    Files are read in splits; a line's number is its place in the split and the lines of the
    splits before it.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    own = F.row_number().over(Window.partitionBy("source_path", "block").orderBy("at"))
    before = F.sum("n").over(Window.partitionBy("source_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    counts = lines.groupBy("source_path", "block").agg(F.count(F.lit(1)).alias("n")).select("source_path", "block", F.coalesce(before, F.lit(0)).alias("before"))  # a row per split
    numbered = lines.withColumn("own", own).join(counts, ["source_path", "block"])
    return numbered.filter(F.trim("value") != "").select("source_path", (F.col("own") + F.col("before")).cast("long").alias("line"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row"))


# --- shards -------------------------------------------------------------------------------------


def _row_hash(columns: list[str]):
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def shard_hashes(df: DataFrame, key: str) -> DataFrame:
    """(key, rows, digest) of each shard: sums of row hashes, which do not depend on the order of rows or on memory."""
    columns = [c for c in df.columns if c != key]
    part = lambda i: F.sum(F.conv(F.substring(_row_hash(columns), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws("|", *[part(i).cast("string") for i in range(4)]), 256).alias("digest"))


def write_shards(df: DataFrame, path: str, key: str, order: list[str]) -> None:
    """One folder per document, its rows in order, and a manifest with the hash of each.

    Tasks take ranges of (document, order), so that a large document is written by several, in files that follow each other.
    """
    spark = df.sparkSession
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).write.partitionBy(key).parquet(f"{beside}/shards")
    shard_hashes(df, key).write.parquet(f"{beside}/manifest")
    move(spark, beside, path)


def read_shards(spark: SparkSession, path: str, key: str, wanted: list[str], check: bool = True) -> DataFrame:
    """The shards of the named documents, and of no other: folders are pruned. An unknown or changed shard is an error."""
    path = settled(spark, path)
    rows = spark.read.parquet(f"{path}/shards").withColumn(key, F.col(key).cast("string")).filter(F.col(key).isin(wanted))
    if check:
        known = spark.read.parquet(f"{path}/manifest").withColumn(key, F.col(key).cast("string")).filter(F.col(key).isin(wanted)).select(key, "digest")
        found = shard_hashes(rows, key).select(key, F.col("digest").alias("now"))
        bad = known.join(found, key, "full_outer").filter(~F.col("digest").eqNullSafe(F.col("now"))).limit(1).collect()
        if bad or known.count() != len(set(wanted)):
            raise ValueError(f"shards of {path} are missing or changed")
    return rows


# --- the fact store -----------------------------------------------------------------------------

TABLES = ("facts", "conflicts", "decisions", "metadata")


def write_store(spark: SparkSession, path: str, tables: dict[str, DataFrame], checks: dict[str, str]) -> str:
    """Writes the tables as a new version, checks it, and only then makes it the current one; the version's name.

    ``checks``: name -> SQL over the tables that counts violations. A check that counts any
    leaves the store as it was.
    """
    if set(tables) != set(TABLES):
        raise ValueError(f"a store holds {TABLES}")
    version = f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
        spark.read.parquet(f"{path}/{version}/{name}").createOrReplaceTempView(f"store_{name}")
    broken = {name: n for name, sql in checks.items() if (n := spark.sql(sql).first()[0])}
    if broken:
        fs, where = _fs(spark, f"{path}/{version}")
        fs.delete(where, True)
        raise ValueError(f"the store breaks its rules: {broken}")
    replace_text(spark, f"{path}/CURRENT", version)
    return version


#: The rules of a fact store: ids are unique, a group selects one fact at most, selected facts have a value.
STORE_CHECKS = {
    "repeated_ids": "SELECT count(*) - count(DISTINCT fact_id) FROM store_facts",
    "selected_twice": "SELECT count(*) FROM (SELECT 1 FROM store_facts GROUP BY document_id, metric_year, canonical_metric, normalized_unit HAVING count(*) FILTER (WHERE is_selected) > 1)",
    "selected_without_value": "SELECT count(*) FROM store_facts WHERE is_selected AND normalized_value IS NULL",
}


def read_store(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the current version; ``selected`` is the view of the selected facts."""
    version = read_text(spark, f"{path}/CURRENT").strip()
    rows = spark.read.parquet(f"{path}/{version}/{'facts' if name == 'selected' else name}")
    return rows.filter("is_selected") if name == "selected" else rows


# --- traces -------------------------------------------------------------------------------------


def canonical_trace(trace: Column) -> Column:
    """JSON text with sorted keys and without spaces; text that is no JSON is an error."""
    return F.to_json(F.parse_json(trace))


def append_traces(traces: DataFrame, path: str) -> DataFrame:
    """Adds the traces (column trace, JSON text) that the table at ``path`` lacks, and gives (trace, trace_hash) of all given.

    A trace is named by the SHA-256 of its canonical text; written again, in whatever order of
    keys, it changes nothing.
    """
    spark = traces.sparkSession
    text = canonical_trace(F.col("trace"))
    named = traces.select("trace", F.sha2(text, 256).alias("trace_hash"), text.alias("canonical"))
    new = named.select("trace_hash", F.col("canonical").alias("trace")).dropDuplicates(["trace_hash"])
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select("trace_hash"), "trace_hash", "left_anti")
    new.write.mode("append").parquet(path)
    return named.select("trace", "trace_hash")


def read_traces(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(trace_hash, trace), those of ``wanted`` (trace_hash) or all, each once; a row that is not what its name says stops the job."""
    rows = spark.read.parquet(path).dropDuplicates(["trace_hash", "trace"])
    if wanted is not None:
        rows = rows.join(wanted.select("trace_hash").distinct(), "trace_hash", "left_semi")
    whole = F.sha2(canonical_trace(F.col("trace")), 256) == F.col("trace_hash")
    return rows.select("trace_hash", F.when(whole, F.col("trace")).otherwise(F.raise_error(F.concat(F.lit("not what its name says: "), "trace_hash"))).alias("trace"))


# --- caches and stores of vectors -----------------------------------------------------------------


def request_key(*parts):
    """SHA-256 of the parts of a request, nulls apart from empty texts."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def through_cache(requests: DataFrame, path: str, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``compute`` for the distinct requests that the cache at ``path`` lacks; they are appended, and all requests answered from it.

    The cache is read before it grows, so that a second run computes nothing.
    """
    spark = requests.sparkSession
    asked = requests.dropDuplicates([key])
    if exists(spark, path):
        asked = asked.join(spark.read.parquet(path).select(key), key, "left_anti")
    if not asked.isEmpty():
        compute(asked).write.mode("append").parquet(path)
    # Two runs at once may both have appended a key: one answer each counts.
    return requests.select(key).join(spark.read.parquet(path).dropDuplicates([key]), key, "left")


def reusable(chunks: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(cached rows of known chunks, chunks to extract)."""
    return cache.join(chunks.select(key), key, "left_semi"), chunks.join(cache.select(key), key, "left_anti")


def translated(values: DataFrame, fixed: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Values with their translation from the fixed dictionary, else from the cache; ``tier`` says which, or provider where neither has it."""
    a, b = fixed.select(text, F.col("translation").alias("__f")), cache.select(text, F.col("translation").alias("__c"))
    out = values.join(a, text, "left").join(b, text, "left")
    tier = F.when(F.col("__f").isNotNull(), "static").when(F.col("__c").isNotNull(), "cache").otherwise("provider")
    return out.withColumns({"translation": F.coalesce("__f", "__c"), "tier": tier}).drop("__f", "__c")


def vectors(rows: DataFrame) -> DataFrame:
    """A vector store in its present shape: what an older one lacks is filled in, the text from the content, no metadata as an empty map."""
    if "embedding_text" not in rows.columns:
        rows = rows.withColumn("embedding_text", F.lit(None).cast("string"))
    if "metadata" not in rows.columns:
        rows = rows.withColumn("metadata", F.lit(None).cast("string"))
    meta = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return rows.select("hash_id", "content", F.coalesce("embedding_text", "content").alias("embedding_text"), meta.alias("metadata"), "embedding")


def complete_vectors(chunks: DataFrame, store: DataFrame, key: str = "hash_id") -> DataFrame:
    """Chunks with their vectors; a chunk without one is an error of the query."""
    out = chunks.join(store.select(key, "embedding"), key, "left")
    return out.withColumn("embedding", F.coalesce("embedding", F.raise_error(F.concat(F.lit("no vector for chunk "), F.col(key))).cast("array<float>")))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    spark = nodes.sparkSession
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    nodes.write.parquet(f"{beside}/nodes")
    edges.write.parquet(f"{beside}/edges")
    move(spark, beside, path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    path = settled(spark, path)
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
