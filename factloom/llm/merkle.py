"""Merkle manifest of a dataset: a tree of SHA-256 per group of rows, and one over the groups.

Every row is a leaf, the digest of its columns. A level's nodes are partitioned by
group and parent number; an ordered ``collect_list`` over the whole frame gives each
node its run of at most FAN nodes, which is both what the parent digests and, without
the node itself, its siblings. Of the nodes of a run one stands for the parent on the
next level. Going down again, each node gets its parent's path to the root by one
join a level, so that the work is that of the leaves and an eighth, a 64th ... of it.
Leaves are numbered without gathering a group in one task: rows go to ranges of
(group, order), ranges are counted, and a row's number is that of its range's first
row plus its own in the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import materialise, partitions

#: Nodes that one parent digests.
FAN = 8
#: Columns of a leaf, in the order in which they are digested.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """A value as ``<UTF-8 bytes>:<value>``, null as ``-``: no two rows of values give the same bytes."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``idx``: their number from 0 in their group by ``order``, nulls first.

    Rows equal in all of these get numbers in any order.
    """
    by = [group, *order]
    ranges = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(partitions(rows.sparkSession), *by, "__row")
    ranges = materialise(ranges.withColumn("__range", F.spark_partition_id()), label)
    # Ranges follow the order of groups, so that there are at most as many counts as ranges and groups together.
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("__range", group).agg(F.count(F.lit(1)).alias("__n"))
    firsts = counts.select("__range", group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    own = F.row_number().over(Window.partitionBy("__range", group).orderBy(*order, "__row"))
    return ranges.withColumn("__own", own).join(firsts, ["__range", group]).withColumn("idx", F.col("__first") + F.col("__own") - 1).drop("__range", "__row", "__own", "__first")


def with_runs(nodes: DataFrame) -> DataFrame:
    """Nodes (grp, idx, digest, ...) with ``run``, the digests below their parent, and ``top``: whether the group has no other node."""
    frame = Window.partitionBy("grp", F.col("idx").bitwiseAND(F.lit(-FAN))).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = nodes.withColumn("run", F.collect_list("digest").over(frame))
    # Only the first run of a group can be the only one, and a run of one node that is first is the whole level.
    return runs.withColumn("top", (F.col("idx") == 0) & (F.size("run") == 1))


def grow(nodes: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels above and with ``nodes`` (grp, idx, digest), and per group its root: grp, digest, level.

    Every level but the first is a table in the shared folder. The number of levels
    follows from the largest group.
    """
    most = nodes.agg(F.max("idx")).first()[0]
    levels, roots, level = [nodes], None, 0
    while True:
        found = with_runs(levels[-1].select("grp", "idx", "digest"))
        done = found.filter("top").select("grp", "digest", F.lit(level).alias("level"))
        roots = done if roots is None else roots.unionByName(done)
        if not most:
            return levels, roots
        parents = found.filter(~F.col("top") & (F.col("idx") % FAN == 0))
        parents = parents.select("grp", F.shiftright("idx", FAN.bit_length() - 1).alias("idx"), F.sha2(F.concat_ws("", "run"), 256).alias("digest"))
        levels.append(materialise(parents, f"{label}-level"))
        most, level = most // FAN, level + 1


def paths(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """Nodes of the first level with ``path`` and the columns of their group's root.

    ``roots``: grp, level, path (what stands above the group's root) and other columns to
    carry. A path is an array of (left, right): the siblings' digests, level by level.
    """
    carried = [c for c in roots.columns if c not in ("grp", "level", "path")]
    above = None
    for level in range(len(levels) - 1, -1, -1):
        found = with_runs(levels[level])
        place = (F.col("idx") % FAN).cast("int")
        step = F.struct(
            F.concat_ws("", F.slice("run", F.lit(1), place)).alias("left"), F.concat_ws("", F.slice("run", place + 2, F.lit(FAN))).alias("right")
        )
        # The group's root takes what is known of it, as the parent number -1; other nodes their parent's path.
        tops = roots.filter(F.col("level") == level).select("grp", F.lit(-1).cast("long").alias("parent"), F.col("path").alias("__path"), *carried)
        above = tops if above is None else above.select("grp", F.col("idx").alias("parent"), F.col("path").alias("__path"), *carried).unionByName(tops)
        keyed = found.withColumn("parent", F.when(F.col("top"), -1).otherwise(F.shiftright("idx", FAN.bit_length() - 1)))
        joined = keyed.withColumn("__step", step).join(above, ["grp", "parent"])
        above = joined.withColumn("path", F.when(F.col("top"), F.col("__path")).otherwise(F.concat(F.array("__step"), "__path"))).drop("parent", "run", "top", "__path", "__step")
    return above


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and a path of siblings give."""
    return F.aggregate(path, digest, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]), 256))


def proof(path: Column) -> Column:
    """SHA-256 of the siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda step: F.concat(step["left"], step["right"]))), 256)


_PATH = "array<struct<left:string,right:string>>"


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A row's group is its ``lang``; groups ascend bytewise, null first, and so do doc_ids in a
    group, null first; rows that repeat an id by their leaf. A lone leaf is its group's root, a
    lone group's root the whole one. Where ``changed`` (a Boolean column of ``docs``) holds, the
    row is verified with the A-Z of its text lower-cased: against the siblings as they
    were. Null values are encoded as such, an empty table gives an empty result, other
    columns are not read.
    """
    columns = [F.col(c) for c in COLUMNS]
    tampered = leaf(*columns[:-1], lower_ascii(columns[-1]))
    leaves = docs.select(
        F.col("doc_id").cast("long"),
        F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang").cast("string"))).alias("grp"),
        leaf(*columns).alias("digest"),
        (F.when(changed, tampered) if changed is not None else F.lit(None).cast("string")).alias("changed"),
    )
    leaves = materialise(numbered(leaves, "grp", ["doc_id", "digest"], "op12-leaves"), "op12-numbered")
    levels, subroots = grow(leaves, "op12")
    subroots = materialise(subroots, "op12-subroots")
    # The tree over the groups is built in the same way, its leaves numbered by the group's name.
    named = subroots.select(F.lit("").alias("all"), F.col("grp").alias("name"), "digest", F.col("level").alias("depth"))
    tops = materialise(numbered(named, "all", ["name"], "op12-groups").withColumnRenamed("all", "grp"), "op12-groups-numbered")
    above, roots = grow(tops, "op12-top")
    roots = roots.select("grp", "level", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    groups = paths(above, roots).select(F.col("name").alias("grp"), F.col("depth").alias("level"), "path", F.col("digest").alias("subroot"), "root")
    rows = paths(levels, materialise(groups, "op12-groups-paths"))
    folded = fold(F.coalesce("changed", "digest"), F.col("path"))
    rows = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_third(doc_id: Column) -> Column:
    """Rows whose CRC-32 of the decimal id is divisible by 3; a null id is never one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))
