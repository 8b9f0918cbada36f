"""What the operators of this subpackage share: tables, shared folders and materialised results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to a Python worker. Texts may be long, so a batch is kept small.
ARROW_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` where the session names one, else the
    context's checkpoint folder; only where neither is set (tests, local mode) a
    new local folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="factloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def small_batches(spark: SparkSession) -> None:
    """Lowers Spark's default Arrow batch size; a size that the user has set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    The lineage ends there: a lost executor costs a re-read, and a branch that
    is read twice is computed once. The result is a plain Parquet table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._factloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table that ``materialise`` wrote and that nothing reads any more."""
    path = getattr(df, "_factloom_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        where.getFileSystem(conf).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of one key that a task takes, however small its fair share is, before the key is split.
HOT_ROWS = 1000


def spread_join(left: DataFrame, right: DataFrame, key: str, salt: str, sizes: DataFrame, how: str = "inner", total: int | None = None, most: int | None = None) -> DataFrame:
    """``left`` joined to ``right`` on ``key``, with the keys that many left rows share split over several tasks.

    ``sizes`` has the number ``n`` of left rows of each key, for frequent keys at
    least; ``total`` and ``most`` are their sum and maximum, where these are known. A
    key is split by the hash of column ``salt`` where it has more rows than a
    task's fair share; there are at most as many such keys as partitions, which
    bounds the table that is broadcast. The right rows of a split key are copied to
    each of its parts. Where no key is that frequent, the join is a plain one.
    """
    parts = partitions(left.sparkSession)
    if total is None:
        total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    share = max(HOT_ROWS, (total or 0) // parts)
    if (most or 0) <= share:
        return left.join(right, key, how)
    hot = F.broadcast(sizes.filter(F.col("n") > share).select(F.col(key).alias("__hot"), F.ceil(F.col("n") / share).cast("int").alias("__parts")))
    dealt = left.join(hot, left[key] == F.col("__hot"), "left")
    parts_of = F.coalesce("__parts", F.when(F.col(key).isNull(), parts), F.lit(1))  # null keys match nothing and may stand anywhere
    dealt = dealt.withColumn("__salt", F.pmod(F.xxhash64(salt), parts_of).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    copied = right.join(hot, right[key] == F.col("__hot"), "left").withColumn("__salt", copies).drop("__hot", "__parts")
    return dealt.drop("__hot", "__parts").join(copied, [key, "__salt"], how).drop("__salt")


def held_out(doc_id):
    """Rows that never train a classifier: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Characters of a text that may train a classifier: longer ones are left out, which bounds what the driver collects.
TRAIN_CHARS = 64_000


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, chars: int = TRAIN_CHARS) -> DataFrame:
    """At most ``per_class`` training rows of each label value: doc_id, y, text, one row an id.

    Rows and ``chars`` bound what a classifier learns from. Held out rows, null ids, null
    labels, null texts and longer texts are left out before rows are counted. An id with both
    labels counts as 1; of rows that repeat an id the smallest text stands. Rows are taken
    in the order of a hash of the id, so that the sample does not depend on partitions.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.length("text") <= chars)
    usable = usable.join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = None
    for value in (0, 1):
        part = usable.filter(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # The sample has at most 2 * per_class rows of 12 bytes, whatever the input's size.
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, chars: int = TRAIN_CHARS) -> list:
    """``labelled_rows`` on the driver, as (text, label) in a fixed order; ``per_class`` and ``chars`` bound what it holds."""
    rows = labelled_rows(docs, labels, label, per_class, chars).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [(r["text"], r["y"]) for r in rows]


def importable_on_workers() -> None:
    """Python workers import this package by PYTHONPATH or their folder; else its code travels by value."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if os.path.exists(os.path.join(os.getcwd(), "factloom")) or root in paths:
        return
    import factloom
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(factloom)


importable_on_workers()
