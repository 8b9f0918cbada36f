"""Sorted lines by byte ranges, and sorted streams walked side by side.

``RangedLines`` is a Python data source: its partitions are byte ranges of the files of
a folder, cut at ``range_bytes`` whatever lines there are; a range holds the lines that
begin in it. With an index (``build_index``: the first and last document, the order and a hash of
each range) a filter on the document leaves only the ranges that can hold it, and each
range that is read is checked against its hash. Files are read through
``pyarrow.fs``, so that they may lie in any store that it reaches.

``merge_validate`` deals rows of several sources into the same ranges of keys, makes one
row of each key, and walks each range once, in order, for what lies behind each key.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from factloom.sources.shared import keep

RANGE_BYTES = 64 << 20


def _open(path: str):
    import pyarrow.fs as fs

    store, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store, inside


def _files(path: str) -> list[tuple[str, int]]:
    """The parts of a folder by name, or the one file, with their sizes."""
    import pyarrow.fs as fs

    store, inside = _open(path)
    info = store.get_file_info(inside)
    found = store.get_file_info(fs.FileSelector(inside)) if info.type == fs.FileType.Directory else [info]
    head = path[: len(path) - len(inside)]
    return sorted((head + f.path, f.size) for f in found if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", ".")))


class Range(InputPartition):
    def __init__(self, number: int, path: str, start: int, end: int, digest: str | None = None):
        self.number, self.path, self.start, self.end, self.digest = number, path, start, end, digest


def lines_of(part: Range) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in a range, blank ones left out; a line is read to its end wherever that is."""
    store, inside = _open(part.path)
    with store.open_input_file(inside) as file:
        at, rest = part.start, b""
        file.seek(max(0, at - 1))
        if at and file.read(1) != b"\n":  # the range begins inside a line of the range before
            while piece := file.read(1 << 16):
                cut = piece.find(b"\n")
                if cut >= 0:
                    at, rest = at + cut + 1, piece[cut + 1 :]
                    break
                at += len(piece)
            else:
                return
        while at < part.end:
            cut = rest.find(b"\n")
            if cut < 0:
                piece = file.read(1 << 20)
                if piece:
                    rest += piece
                    continue
                if rest.strip():
                    yield at, rest
                return
            if rest[:cut].strip():
                yield at, rest[:cut]
            at, rest = at + cut + 1, rest[cut + 1 :]


class RangedLines(DataSource):
    """Options: path; key (the document's field, the one lines are sorted by); range_bytes; index (JSON rows of ``build_index``)."""

    @classmethod
    def name(cls) -> str:
        return "ranged_lines"

    def schema(self) -> str:
        return "range int, path string, start long, document string, line string"

    def reader(self, schema) -> DataSourceReader:
        return RangedReader(self.options)


class RangedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.key = options["path"], options["key"]
        self.size = int(options.get("range_bytes", RANGE_BYTES))
        self.index = {r["range"]: r for r in json.loads(options["index"])} if options.get("index") else None
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if getattr(f, "attribute", None) == ("document",) and values is not None:
                self.wanted = values if self.wanted is None else self.wanted & values
            yield f  # lines of other documents in a range are left out by Spark

    def partitions(self) -> list[Range]:
        cut = [(path, start, min(start + self.size, size)) for path, size in _files(self.path) for start in range(0, size, self.size)]
        out = []
        for number, (path, start, end) in enumerate(cut):
            known = self.index.get(number) if self.index is not None else None
            if self.index is not None and (known is None or known["end"] != end):
                raise ValueError("the index is not of these files")
            if known and self.wanted is not None and not any(known["first"] is not None and known["first"] <= w <= known["last"] for w in self.wanted):
                continue
            out.append(Range(number, path, start, end, known["digest"] if known else None))
        return out or [Range(-1, "", 0, 0)]

    def read(self, part: Range):
        if part.number < 0:
            return
        digest, last = hashlib.sha256(), None
        for start, line in lines_of(part):
            digest.update(line + b"\n")
            document = str(json.loads(line)[self.key])
            if last is not None and document < last:
                raise ValueError(f"{part.path} is not sorted at byte {start}")
            last = document
            yield part.number, part.path, start, document, line.decode()
        if part.digest is not None and digest.hexdigest() != part.digest:
            raise ValueError(f"bytes {part.start} to {part.end} of {part.path} have changed")


def ranged(spark: SparkSession, path: str, key: str, range_bytes: int = RANGE_BYTES, index: DataFrame | None = None) -> DataFrame:
    """Lines of a sorted folder or file: range, path, start, document, line, one partition per range.

    With ``index`` a filter on ``document`` prunes ranges, and each one read must have its hash.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RangedLines)
    reader = spark.read.format("ranged_lines").option("path", path).option("key", key).option("range_bytes", str(range_bytes))
    if index is not None:  # a row per range
        reader = reader.option("index", json.dumps([r.asDict() for r in index.collect()]))
    return reader.load()


def build_index(spark: SparkSession, path: str, key: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(range, path, start, end, first, last, lines, digest): a row per range, written by no one; order is checked in and between ranges.

    A range that no line begins in has null documents. ``read`` checks the order inside a
    range; here each range must begin where the one before it ended, or later.
    """
    reader = RangedReader({"path": path, "key": key, "range_bytes": str(range_bytes)})
    cut = [(p.number, p.path, p.start, p.end) for p in reader.partitions() if p.number >= 0]
    ranges = spark.createDataFrame(cut, "range int, path string, start long, end long").repartition(max(1, len(cut)), "range")

    def scan(batches):
        for batch in batches:
            for number, where, start, end in zip(*(batch.column(c).to_pylist() for c in range(4))):
                digest, first, last, n = hashlib.sha256(), None, None, 0
                for at, line in lines_of(Range(number, where, start, end)):
                    digest.update(line + b"\n")
                    document = str(json.loads(line)[key])
                    if last is not None and document < last:
                        raise ValueError(f"{where} is not sorted at byte {at}")
                    first, last, n = first if first is not None else document, document, n + 1
                row = (number, where, start, end, first, last, n, digest.hexdigest())
                kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["range", "path", "start", "end", "first", "last", "lines", "digest"])

    rows = ranges.mapInArrow(scan, "range int, path string, start long, end long, first string, last string, lines long, digest string")
    before = F.last("last", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    late = F.coalesce(F.col("first") < F.col("__before"), F.lit(False))
    checked = rows.withColumn("__before", before)
    return checked.withColumn("lines", F.when(late, F.raise_error(F.lit("a range begins before the one in front of it ends")).cast("long")).otherwise(F.col("lines"))).drop("__before")


# --- sorted streams side by side ------------------------------------------------------------------


def merge_validate(sources: dict[str, DataFrame], lead: str) -> DataFrame:
    """What several sorted sources disagree on: key, source, kind.

    Each source has key, ordinal (its place there) and digest. Against ``lead``, the others can
    lack a key (missing), have one that it lacks (foreign), or another digest under it
    (changed); in any source a key may repeat (repeated) or stand behind a larger one that
    follows it by key (reordered). Null keys are left out. Keys are dealt into ranges that
    all sources share, by one shuffle; a range becomes one row a key, and is walked once, from
    its largest key down, for the least ordinal behind each key. What later ranges hold is
    one number a range and source, and is compared afterwards.
    """
    names = sorted(sources)
    rows = None
    for i, name in enumerate(names):
        own = sources[name].select(F.col("key").cast("string").alias("key"), F.lit(i).alias("source"), F.col("ordinal").cast("long").alias("ordinal"), F.col("digest").cast("string").alias("digest"))
        rows = own if rows is None else rows.unionByName(own)
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers = range(len(names))

    def summed(i: int) -> list[Column]:
        mine = lambda c: F.when(F.col("source") == i, F.col(c))
        return [F.count(mine("source")).alias(f"n{i}"), F.min(mine("ordinal")).alias(f"low{i}"), F.max(mine("ordinal")).alias(f"high{i}"), F.min(mine("digest")).alias(f"digest{i}"), F.max(mine("digest")).alias(f"other{i}")]

    once = rows.filter("key IS NOT NULL").repartitionByRange(parts, "key").groupBy("key").agg(*[c for i in numbers for c in summed(i)])
    there = lambda i: F.col(f"n{i}") > 0
    said = lambda i: F.struct(f"digest{i}", f"other{i}")
    first = names.index(lead)
    kinds = []
    for i in numbers:
        kinds.append(F.when(F.col(f"n{i}") > 1, F.struct(F.lit(names[i]).alias("source"), F.lit("repeated").alias("kind"))))
        if i != first:
            kind = F.when(there(first) & ~there(i), "missing").when(there(i) & ~there(first), "foreign").when(there(i) & ~said(i).eqNullSafe(said(first)), "changed")
            kinds.append(F.when(kind.isNotNull(), F.struct(F.lit(names[i]).alias("source"), kind.alias("kind"))))
    found = once.select("key", F.array_compact(F.array(*kinds)).alias("found"), *[c for i in numbers for c in (f"low{i}", f"high{i}")], F.spark_partition_id().alias("range"))
    ends = [c for i in numbers for c in (f"high{i}", f"late{i}", f"low{i}")]
    schema = "key string, found array<struct<source:string,kind:string>>, range int, " + ", ".join(f"{c} {'boolean' if c[:4] == 'late' else 'long'}" for c in ends)
    walked = keep(found.sortWithinPartitions(F.col("key").desc()).mapInArrow(_walk_sources(len(names)), schema), "merged")
    lows = walked.groupBy("range").agg(*[F.min(f"low{i}").alias(f"low{i}") for i in numbers]).orderBy(F.col("range").desc()).collect()  # a row per range
    after, bounds = [None] * len(names), []
    for r in lows:
        bounds.append((r["range"], *after))
        after = [min((x for x in (r[f"low{i}"], after[i]) if x is not None), default=None) for i in numbers]
    bounds = spark.createDataFrame(bounds, "range int, " + ", ".join(f"after{i} long" for i in numbers))
    reordered = [F.when(F.col(f"late{i}") | (F.col(f"high{i}") > F.col(f"after{i}")), F.struct(F.lit(names[i]).alias("source"), F.lit("reordered").alias("kind"))) for i in numbers]
    every = walked.join(F.broadcast(bounds), "range").select("key", F.explode(F.concat("found", F.array_compact(F.array(*reordered)))).alias("x"))
    return every.select("key", "x.source", "x.kind")


def _walk_sources(n: int):
    """(key, found, range) and per source its highest ordinal, whether that is behind a later key of the batch's range, and its least."""
    most = np.iinfo(np.int64).max

    def run(batches):
        least = [most] * n
        for batch in batches:
            columns = [batch.column("key"), batch.column("found"), batch.column("range")]
            for i in range(n):
                low, high = (batch.column(f"{c}{i}") for c in ("low", "high"))
                lows = np.append(least[i], low.fill_null(most).to_numpy(zero_copy_only=False))
                before = np.minimum.accumulate(lows)
                late = high.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False) > before[:-1]
                least[i] = before[-1]
                columns += [high, pa.array(late), low]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "found", "range", *[f"{c}{i}" for i in range(n) for c in ("high", "late", "low")]])

    return run
