"""Entity-passage graph: edges, synonymy, one-hop expansion, personalised PageRank, deletion, statistics."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.labels import triple_confidence
from factloom.functions.text import entity
from factloom.operators.chunking import fuzzy_match
from factloom.operators.retrieval import SCORE_DIGITS, knn
from factloom.operators.skew import spread_join
from factloom.sources.shared import forget, keep, keep_buckets

DAMPING = 0.5
#: Likeness and number of neighbours of a synonymy edge.
SYNONYMY, NEIGHBOURS = 0.8, 101
#: Nodes of a block of scores, and queries that are walked side by side in it.
NODE_BLOCK, WALK_QUERIES = 32_768, 256
#: Transitions of a graph that a task holds whole (12 bytes each), and scores of its queries there.
WHOLE_EDGES, WHOLE_SCORES = 16_000_000, 4_000_000


def fact_edges(triples: DataFrame) -> DataFrame:
    """Both directions of each (subject, object) with the summed confidence; self-loops and blanks go."""
    own = triples.filter((F.col("subject") != F.col("object")) & (F.col("subject") != "") & (F.col("object") != ""))
    there = own.select(F.col("subject").alias("src"), F.col("object").alias("dst"), "confidence")
    both = there.unionByName(there.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence"))
    return both.groupBy("src", "dst").agg(F.sum("confidence").alias("weight"))


def passage_edges(mentions: DataFrame) -> DataFrame:
    """(chunk, entity) with the largest confidence, not the sum."""
    return mentions.groupBy("chunk_id", "entity").agg(F.max("confidence").alias("weight"))


def synonymy_edges(vectors: DataFrame, key: str, vector: str, least: float = SYNONYMY, most: int = NEIGHBOURS, name: str | None = None, digits: int = SCORE_DIGITS) -> DataFrame:
    """Pairs of vectors with a cosine of at least ``least`` among each one's nearest ``most``.

    Cosines count as rounded to ``digits``, ties by key. With ``name``, only entities whose name has more than two ASCII letters and digits ask for synonyms.
    """
    asking = vectors.filter(F.length(F.regexp_replace(name, "[^A-Za-z0-9]", "")) > 2) if name else vectors
    near = knn(vectors, asking.select(F.col(key).alias("src"), vector), key, "src", vector, most, digits=digits, least=least)
    return near.filter(F.col("src") != F.col(key)).select("src", F.col(key).alias("dst"), F.col("score").alias("weight"))


def overwrite_weights(facts: DataFrame, synonyms: DataFrame) -> DataFrame:
    """A synonymy edge replaces the weight of a fact edge between the same nodes."""
    both = facts.select("src", "dst", F.col("weight").alias("f")).join(synonyms.select("src", "dst", F.col("weight").alias("s")), ["src", "dst"], "full_outer")
    return both.select("src", "dst", F.coalesce("s", "f").alias("weight"))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Without self-loops and unknown ends; parallel edges stay."""
    n = nodes.select("node")
    return edges.filter("src <> dst").join(n, F.col("src") == n["node"], "left_semi").join(n, F.col("dst") == n["node"], "left_semi")


def one_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Neighbours of the seeds in either direction, with their summed weight."""
    s = seeds.select("node")
    out = edges.join(s, edges["src"] == s["node"]).select(F.col("dst").alias("neighbour"), "weight")
    back = edges.join(s, edges["dst"] == s["node"]).select(F.col("src").alias("neighbour"), "weight")
    return out.unionByName(back).groupBy("neighbour").agg(F.sum("weight").alias("weight"))


def transitions(edges: DataFrame) -> DataFrame:
    """(src, dst, p) of the undirected weighted graph: p is the edge's share of what leaves src. Written once, in buckets of src, so that no round moves edges."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summed = both.repartition(parts, "src").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    total = F.sum("weight").over(Window.partitionBy("src"))
    return keep_buckets(summed.select("src", "dst", (F.col("weight") / total).alias("p")), "transitions", "src")


def pagerank_many(edges: DataFrame, reset: DataFrame, damping: float = DAMPING, rounds: int = 20, tolerance: float = 1e-9) -> DataFrame:
    """Personalised PageRank of many queries at once: query_id, node, score, the scores of a query adding up to 1.

    reset: query_id, node, mass; null, NaN and negative masses count as 0, and a query
    without mass has no rows, nor have nodes that a query's walk does not reach. Each
    round moves the scores of all queries in one join by node and one aggregate, whose
    result is written; hubs of the graph are split over tasks. A query whose scores change by less than
    ``tolerance`` in sum is done and takes no part in later rounds. What sits on nodes
    without edges goes back to the query's reset distribution.
    """
    steps = transitions(edges)
    degree = steps.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    totals = tuple(degree.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first())
    from_node = steps.withColumnRenamed("src", "node")
    mass = F.when(F.col("mass") > 0, F.nanvl(F.col("mass").cast("double"), F.lit(0.0))).otherwise(0.0)
    given = reset.groupBy("query_id", "node").agg(F.sum(mass).alias("mass")).filter("mass > 0")
    total = given.groupBy("query_id").agg(F.sum("mass").alias("all"))
    base = keep(given.join(total, "query_id").select("query_id", "node", (F.col("mass") / F.col("all")).alias("r")), "reset")
    score, spent, done = base.select("query_id", "node", "r", F.col("r").alias("score")), [steps, base], []
    zero = F.lit(0.0)
    for i in range(rounds):
        moved = spread_join(from_node, score.select("query_id", "node", "score"), "node", "dst", degree, "inner", totals)
        # The old score and the reset mass travel as rows beside what moves, so that one aggregate holds all three.
        moved = moved.groupBy("query_id", F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("p")).alias("in")).select("*", zero.alias("r"), zero.alias("old"))
        rows = moved.unionByName(score.select("query_id", "node", zero.alias("in"), "r", F.col("score").alias("old")))
        rows = keep(rows.groupBy("query_id", "node").agg(*[F.sum(c).alias(c) for c in ("in", "r", "old")]), "round")
        spent.append(rows)
        lost = rows.groupBy("query_id").agg((1.0 - F.sum("in")).alias("lost"))
        new = (1 - damping) * F.col("r") + damping * (F.col("in") + F.col("lost") * F.col("r"))
        score = rows.join(lost, "query_id").select("query_id", "node", "r", new.alias("score"), "old")
        if tolerance > 0 and i + 1 < rounds:
            change = keep(score.groupBy("query_id").agg(F.sum(F.abs(F.col("score") - F.col("old"))).alias("change")), "changes")
            spent.append(change)
            over = F.col("change") < tolerance
            ended, live = change.agg(F.count_if(over), F.count_if(~over)).first()
            if ended:
                done.append(keep(score.join(change.filter(over).select("query_id"), "query_id", "left_semi").select("query_id", "node", "score"), "ranked"))
            score = score.join(change.filter(~over).select("query_id"), "query_id", "left_semi")
            if not live:
                break
    done.append(keep(score.select("query_id", "node", "score"), "ranked"))
    forget(*spent)
    return reduce(DataFrame.unionByName, done)


def pagerank_blocks(edges: DataFrame, reset: DataFrame, damping: float = DAMPING, rounds: int = 20, tolerance: float = 1e-9, only: DataFrame | None = None) -> DataFrame:
    """As ``pagerank_many``, for walks that reach most of the graph: a node's scores of up to 256 queries are one row.

    Nodes are dealt into blocks of a bounded size. Each round joins the nodes' scores to
    what they are linked to in each block, and a task adds them up in one matrix per
    block, reading them as a stream; so a score moves once per block that its node reaches,
    not once per edge. A graph that a task can hold goes whole to each share of the queries,
    and no score moves. ``only``: the nodes whose scores are wanted; nodes with a score of 0
    have no rows.
    """
    steps = transitions(edges)
    mass = F.when(F.col("mass") > 0, F.nanvl(F.col("mass").cast("double"), F.lit(0.0))).otherwise(0.0)
    given = reset.groupBy("query_id", "node").agg(F.sum(mass).alias("mass")).filter("mass > 0")
    total = given.groupBy("query_id").agg(F.sum("mass").alias("all"))
    names = keep(steps.select(F.col("src").alias("node"), F.lit(True).alias("linked")).unionByName(given.select("node", F.lit(False).alias("linked"))).groupBy("node").agg(F.max("linked").alias("linked")), "names")
    n, queries = names.count(), total.count()
    whole = steps.count() <= WHOLE_EDGES and n <= WHOLE_SCORES
    if whole:
        parts = max(1, math.ceil(queries * n / WHOLE_SCORES), min(queries, edges.sparkSession.sparkContext.defaultParallelism))
    else:
        parts = max(1, math.ceil(queries / WALK_QUERIES))
    dealt = total.withColumn("part", F.pmod(F.row_number().over(Window.orderBy("query_id")) - 1, F.lit(parts)).cast("int")) if whole else total.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    asked = keep(dealt.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("query_id")) - 1), "asked")  # about 256 queries a part at most
    blocks = 1 if whole else max(1, math.ceil(n / NODE_BLOCK))
    at = F.row_number().over(Window.partitionBy("block").orderBy("node")) - 1
    nodes = keep(names.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")).withColumn("at", at), "nodes")
    base = keep(given.join(asked, "query_id").join(nodes, "node").select("part", "place", "block", "at", "linked", (F.col("mass") / F.col("all")).alias("r")), "reset")
    if whole:
        found = keep(_walk_whole(steps, nodes, base, only, n, parts, damping, rounds, tolerance), "walked")
        out = keep(found.join(nodes.select("at", "node"), "at").join(asked.select("part", "place", "query_id"), ["part", "place"]).select("query_id", "node", "score"), "ranked")
        forget(steps, asked, names, base, nodes, found)
        return out
    ends = steps.join(nodes.select(F.col("node").alias("dst"), F.col("block").alias("to"), F.col("at").alias("there")), "dst").groupBy("src", "to").agg(F.collect_list(F.struct("there", "p")).alias("x"))
    links = keep(ends.join(nodes.select(F.col("node").alias("src"), "block", "at"), "src").select("block", "at", "to", F.col("x.there").alias("ats"), F.col("x.p").alias("ps")), "links")
    resets = keep(base.groupBy("part", "block", "at").agg(F.collect_list(F.struct("place", "r")).alias("x")).select("part", "block", F.lit(1).alias("kind"), "at", F.col("x.place").alias("ats"), F.col("x.r").alias("ps"), F.lit(None).cast("binary").alias("scores")), "resets")
    # What sits on nodes without edges, in every block of each part; its share after each round follows from it.
    loose = base.groupBy("part", "place").agg(F.sum(F.when(F.col("linked"), 0.0).otherwise(F.col("r"))).alias("v"))
    width = asked.agg(F.coalesce(F.max("place") + 1, F.lit(1))).first()[0]
    per_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    def said(rows: DataFrame, kind: int) -> DataFrame:
        own = rows.groupBy("part").agg(F.collect_list(F.struct("place", "v")).alias("x"))
        return own.select("part", per_block.alias("block"), F.lit(kind).alias("kind"), F.lit(0).alias("at"), F.col("x.place").alias("ats"), F.col("x.v").alias("ps"), F.lit(None).cast("binary").alias("scores"))

    loose = keep(said(loose, 2), "loose")
    fixed = resets.unionByName(loose)
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["part", "block", "kind", "at", "ats", "ps", "scores"]
    spent, state, change = [steps, asked, names, base], None, None
    for i in range(rounds + 1):  # round 0 lays out the reset distribution
        rows = fixed
        if state is not None:
            scores = state.filter("kind = 0")
            moved = scores.select("part", "block", "at", "scores").join(links, ["block", "at"]).select("part", F.col("to").alias("block"), F.lit(4).alias("kind"), F.lit(0).alias("at"), "ats", "ps", "scores")
            rows = rows.unionByName(scores.select(*columns)).unionByName(moved)
            if change is not None:
                rows = rows.unionByName(said(change, 3))
        dealt = rows.select(*columns).repartition(tasks, "part", "block").sortWithinPartitions("part", "block", "kind")
        before, state = state, keep(dealt.mapInArrow(_walk_blocks(i, width, damping, tolerance), "part int, block int, kind int, at int, ats array<int>, ps array<double>, scores binary"), "round")
        forget(*([before] if before is not None else []))
        change = None
        if i and tolerance > 0 and i < rounds:
            change = keep(state.filter("kind = 9").select("part", F.posexplode("ps").alias("place", "v")).groupBy("part", "place").agg(F.sum("v").alias("v")), "changes")
            spent.append(change)
            if not change.filter(F.col("v") >= tolerance).limit(1).count():
                break
    wanted = nodes if only is None else nodes.join(only.select("node").distinct(), "node", "left_semi")
    shown = state.filter("kind = 0").select("part", "block", "at", "scores").join(wanted.select("block", "at", "node"), ["block", "at"])
    found = shown.select("part", "node", "scores").mapInArrow(_spread_scores, "part int, place int, node string, score double")
    out = keep(found.join(asked.select("part", "place", "query_id"), ["part", "place"]).select("query_id", "node", "score"), "ranked")
    forget(*spent, nodes, links, resets, loose, state)
    return out


def _walk_whole(steps: DataFrame, nodes: DataFrame, base: DataFrame, only: DataFrame | None, n: int, parts: int, damping: float, rounds: int, tolerance: float) -> DataFrame:
    """(part, place, at, score): all rounds of a part's queries in one task, which holds the graph; the transitions move once for each part, scores never."""
    spark = steps.sparkSession
    into = steps.join(nodes.select(F.col("node").alias("src"), F.col("at").alias("from")), "src").groupBy("dst").agg(F.collect_list(F.struct("from", "p")).alias("x"))
    wanted = nodes.withColumn("wanted", F.lit(True)) if only is None else nodes.join(only.select("node", F.lit(True).alias("wanted")).distinct(), "node", "left")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    links = wanted.join(into.withColumnRenamed("dst", "node"), "node", "left").select(every, F.when(F.col("wanted"), 1).otherwise(0).alias("kind"), "at", F.coalesce("x.from", F.array().cast("array<int>")).alias("ats"), F.coalesce("x.p", F.array().cast("array<double>")).alias("ps"))
    resets = base.groupBy("part", "at").agg(F.collect_list(F.struct("place", "r")).alias("x")).select("part", F.lit(2).alias("kind"), "at", F.col("x.place").alias("ats"), F.col("x.r").alias("ps"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = links.unionByName(resets).repartition(max(tasks, parts), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(_walk_graph(n, damping, rounds, tolerance), "part int, place int, at int, score double")


def _walk_graph(n: int, damping: float, rounds: int, tolerance: float):
    """Rows come sorted by part: of kind 0 and 1 a node with what leads into it, 1 where its scores are wanted, of kind 2 a node's reset masses by query."""

    def ends(pieces: list, kind: type) -> np.ndarray:
        return np.concatenate(pieces) if pieces else np.zeros(0, kind)

    def walk(part: int, at: list, sizes: list, src: list, p: list, kinds: list, masses: list):
        at, sizes, src, p, kinds = ends(at, np.int32), ends(sizes, np.int64), ends(src, np.int32), ends(p, np.float64), ends(kinds, np.int32)
        width = max((int(places.max()) + 1 for _, places, _ in masses), default=0)
        if not width:
            return
        r = np.zeros((n, width))
        for node, places, share in masses:
            r[node, places] = share
        linked = np.zeros(n, bool)
        linked[at[sizes > 0]] = True  # edges go both ways
        loose = r[~linked].sum(axis=0)
        starts = np.append(0, np.cumsum(sizes))
        own = np.flatnonzero(sizes)
        score, lost, live = r.copy(), loose, np.ones(width, bool)
        cuts = np.append(np.flatnonzero(np.diff(starts[own] // (1 << 16), prepend=-1)), len(own))
        for _ in range(rounds):
            moved = np.zeros((n, width))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                begin, end = starts[own[a]], starts[own[b - 1] + 1]
                moved[at[own[a:b]]] = np.add.reduceat(score[src[begin:end]] * p[begin:end, None], starts[own[a:b]] - begin, axis=0)
            moved += lost * r
            moved *= damping
            moved += (1 - damping) * r
            moved[:, ~live] = score[:, ~live]
            score -= moved
            change = np.abs(score, out=score).sum(axis=0)
            score, lost = moved, loose * (1 - damping + damping * lost)
            if tolerance > 0:
                live = change >= tolerance
                if not live.any():
                    break
        wanted = at[kinds == 1]
        for a in range(0, len(wanted), 4096):
            some = wanted[a : a + 4096]
            row, place = np.nonzero(score[some])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), part, np.int32)), pa.array(place, pa.int32()), pa.array(some[row], pa.int32()), pa.array(score[some][row, place])], names=["part", "place", "at", "score"])

    def run(batches):
        now, own = None, None
        for batch in batches:
            part, kind, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero(np.diff(part)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)]):
                if a == b:
                    continue
                if part[a] != now:
                    if own is not None:
                        yield from walk(now, *own)
                    now, own = int(part[a]), tuple([] for _ in range(6))
                for graph in (True, False):
                    chosen = np.flatnonzero((kind[a:b] < 2) == graph)
                    some = batch.slice(a, b - a).take(pa.array(chosen))
                    ats, ps = some.column(3).flatten().to_numpy(), some.column(4).flatten().to_numpy()
                    sizes = some.column(3).value_lengths().to_numpy(zero_copy_only=False)
                    if graph:
                        for x, new in zip(own, (at[a:b][chosen], sizes, ats, ps, kind[a:b][chosen])):
                            x.append(new)
                    else:
                        stops = np.cumsum(sizes)
                        own[5].extend((int(i), ats[e - m : e].copy(), ps[e - m : e].copy()) for i, m, e in zip(at[a:b][chosen], sizes, stops))
        if own is not None:
            yield from walk(now, *own)

    return run


def _walk_blocks(step: int, width: int, damping: float, tolerance: float):
    """One round of ``pagerank_blocks`` over rows sorted by part and block.

    Kinds: 0 a node's scores, 1 its reset masses by query, 2 what sits on nodes without
    edges and 3 the last round's changes by query, 4 scores that move to ``ats`` with shares ``ps``;
    9, written only: the block's changes by query.
    """
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("at", pa.int32()), ("ats", pa.list_(pa.int32())), ("ps", pa.list_(pa.float64())), ("scores", pa.binary())])

    class Block:
        def __init__(self):
            self.n, self.r, self.old, self.new = 0, *(np.zeros((1024, width)) for _ in range(3))
            self.loose, self.live = np.zeros(width), np.ones(width, bool)

        def hold(self, n: int) -> None:
            self.n = max(self.n, n)
            if n > len(self.r):
                more = np.zeros((max(n, 2 * len(self.r)) - len(self.r), width))
                self.r, self.old, self.new = (np.concatenate([x, more]) for x in (self.r, self.old, self.new))

        def take(self, kind: int, at: int, ats: np.ndarray, ps: np.ndarray, scores: bytes | None) -> None:
            if kind == 0:
                self.hold(at + 1)
                self.old[at] = np.frombuffer(scores)
            elif kind == 1:
                self.hold(at + 1)
                self.r[at, ats] = ps
            elif kind == 2:
                self.loose[ats] = ps
            elif kind == 3:
                self.live[ats] = ps >= tolerance
            else:
                self.hold(int(ats.max()) + 1)
                moved = np.frombuffer(scores)
                for k in range(0, len(ats), 4096):  # a node stands once in ats
                    self.new[ats[k : k + 4096]] += ps[k : k + 4096, None] * moved

        def rows(self, part: int, block: int):
            n, old = self.n, self.old[: self.n]
            if step:
                lost = self.loose
                for _ in range(step - 1):
                    lost = self.loose * (1 - damping + damping * lost)
                new = (1 - damping) * self.r[:n] + damping * (self.new[:n] + lost * self.r[:n])
                new[:, ~self.live] = old[:, ~self.live]
            else:
                new = self.r[:n]
            change = np.abs(new - old).sum(axis=0)
            there = np.flatnonzero(new.any(axis=1))
            for k in range(0, len(there), 1024):
                own = there[k : k + 1024]
                m = len(own)
                fill = lambda x: pa.array(np.full(m, x), pa.int32())  # noqa: B023, E731
                none = lambda t: pa.nulls(m, t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([fill(part), fill(block), fill(0), pa.array(own, pa.int32()), none(schema.field("ats").type), none(schema.field("ps").type), pa.array([new[a].tobytes() for a in own], pa.binary())], schema=schema)
            yield pa.RecordBatch.from_pylist([{"part": part, "block": block, "kind": 9, "at": 0, "ps": change.tolist()}], schema=schema)

    def run(batches):
        now, own = None, None
        for batch in batches:
            part, block, kind, at = (batch.column(i).to_numpy(zero_copy_only=False).tolist() for i in range(4))
            (ats, a), (ps, b) = ((c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy().tolist()) for c in (batch.column(4), batch.column(5)))
            scores = batch.column(6)
            for k in range(batch.num_rows):
                if (part[k], block[k]) != now:
                    if own is not None:
                        yield from own.rows(*now)
                    now, own = (part[k], block[k]), Block()
                own.take(kind[k], at[k], ats[a[k] : a[k + 1]], ps[b[k] : b[k + 1]], scores[k].as_py())
        if own is not None:
            yield from own.rows(*now)

    return run


def _spread_scores(batches):
    """A row per query from rows of (part, node, scores); zeros go."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 1024):
            some = batch.slice(begin, 1024)
            values = np.array([np.frombuffer(x) for x in some.column(2).to_pylist()])
            row, place = np.nonzero(values)
            yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(row)), pa.array(place, pa.int32()), some.column(1).take(pa.array(row)), pa.array(values[row, place])], names=["part", "place", "node", "score"])


def pagerank(edges: DataFrame, reset: DataFrame, damping: float = DAMPING, rounds: int = 20) -> DataFrame:
    """Personalised PageRank on the undirected weighted graph: (node, score), scores adding up to 1.

    One query of ``pagerank_many``, with the nodes that it does not reach. After
    ``rounds`` steps the error is below damping ** rounds.
    """
    one = reset.select(F.lit(0).cast("long").alias("query_id"), "node", "mass")
    ranked = pagerank_many(edges, one, damping, rounds, 0.0).select("node", "score")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).unionByName(reset.select("node")).distinct()
    return ends.join(ranked, "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))


def best_facts(triples: DataFrame) -> DataFrame:
    """One row per fact (subject, predicate, object in lower case): its largest confidence and its first text."""
    keys = [F.lower(c).alias(c) for c in ("subject", "predicate", "object")]
    return triples.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.min_by("text", "ordinal").alias("text"))


def chunk_entities(triples: DataFrame) -> DataFrame:
    """(chunk_id, entity): the distinct subjects and objects of each chunk's triples of three parts."""
    ends = triples.filter("subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL").select("chunk_id", F.explode(F.array("subject", "object")).alias("entity"))
    return ends.distinct()


def score_facts(facts: DataFrame, queries: DataFrame, vector: str, k: int) -> DataFrame:
    """Per query the k best facts: query_id, fact_id, score (cosine, min-max normalised over all facts), rank.

    Best and worst come from products of blocks: the worst fact is the best for the turned query.
    """
    best = knn(facts, queries, "fact_id", "query_id", vector, k)
    turned = queries.select("query_id", F.transform(vector, lambda x: -x.cast("double")).alias(vector))
    low = knn(facts.select("fact_id", F.transform(vector, lambda x: x.cast("double")).alias(vector)), turned, "fact_id", "query_id", vector, 1).select("query_id", (-F.col("score")).alias("low"))
    high = best.filter("rank = 1").select("query_id", F.col("score").alias("high"))
    span = F.col("high") - F.col("low")
    score = F.when(span == 0, 1.0).otherwise((F.col("score") - F.col("low")) / F.nullif(span, F.lit(0.0)))
    return best.join(low, "query_id").join(high, "query_id").select("query_id", "fact_id", score.alias("score"), "rank")


def dense_passages(passages: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """As ``score_facts`` for passages, where ties go to the larger key: the reverse of an ascending sort."""
    turned = passages.select((-F.col(key)).alias("fact_id"), vector)
    return score_facts(turned, queries, vector, k).select("query_id", (-F.col("fact_id")).alias(key), "score", "rank")


def link_entities(mentions: DataFrame, entities: DataFrame, cutoff: float = 0.9, neighbours: DataFrame | None = None, least: float = SYNONYMY) -> DataFrame:
    """(mention, entity_id, tier): by equal normal form, else by the most alike known name, and by near vectors.

    mentions: mention, norm; entities: entity_id, norm; neighbours, where vectors are at
    hand: mention, entity_id, score. Mentions with an equal form take no other tier. An
    entity that two tiers find counts for the first.
    """
    exact = mentions.join(entities, "norm").select("mention", "entity_id", F.lit(1).alias("tier"))
    open_ = mentions.join(entities.select("norm").distinct(), "norm", "left_anti")
    near = fuzzy_match(open_.select(F.col("norm").alias("name")), entities.select(F.col("norm").alias("name")), cutoff)
    alike = open_.join(near, open_["norm"] == near["name"]).select("mention", F.col("match").alias("norm")).join(entities, "norm").select("mention", "entity_id", F.lit(2).alias("tier"))
    out = exact.unionByName(alike)
    if neighbours is not None:
        by_vector = neighbours.filter(F.col("score") >= least).join(open_.select("mention"), "mention", "left_semi")
        out = out.unionByName(by_vector.select("mention", "entity_id", F.lit(3).alias("tier")))
    return out.groupBy("mention", "entity_id").agg(F.min("tier").alias("tier"))


def one_hop_passages(edges: DataFrame, mentions: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(kind, item): passages that name a seed, and neighbour entities, the ``most`` first passages by id."""
    s = seeds.select("node")
    found = mentions.join(s, mentions["entity"] == s["node"], "left_semi").select(F.col("chunk_id").alias("item")).distinct().orderBy("item").limit(most)
    near = one_hop(edges, seeds).join(s, F.col("neighbour") == s["node"], "left_anti").select(F.col("neighbour").alias("item"))
    return found.select(F.lit("passage").alias("kind"), F.col("item").cast("string")).unionByName(near.select(F.lit("entity").alias("kind"), F.col("item").cast("string")))


def retrieve(edges: DataFrame, facts: DataFrame, passages: DataFrame, mentions: DataFrame, k: int, link_k: int = 5, passage_weight: float = 0.05, damping: float = DAMPING, rounds: int = 20, tolerance: float = 1e-9) -> DataFrame:
    """Graph retrieval for all queries at once: (query_id, chunk_id, score, rank) of each one's k best passages.

    facts: query_id, subject, object, score, confidence (a query's best facts); passages:
    query_id, chunk_id, score (its own, between 0 and 1); mentions: chunk_id, entity; edges:
    between entities, and between passages and entities; passages are nodes by their
    chunk_id. Phrase weights of the best ``link_k`` entities and a small share of each
    passage's own score are the reset distribution of a personalised PageRank over the
    whole graph; a query's passages are ranked by what they hold in the end, those not
    reached last. A query without a fact gets its passages by their own scores.
    """
    named = facts.select("query_id", F.explode(F.array("subject", "object")).alias("phrase"), "score", "confidence")
    n = mentions.groupBy(F.col("entity").alias("phrase")).agg(F.countDistinct("chunk_id").alias("n"))
    weight = named.join(n, "phrase").groupBy("query_id", "phrase").agg(F.avg(F.col("score") * F.col("confidence") / F.col("n")).alias("mass"))
    best = Window.partitionBy("query_id").orderBy(F.round("mass", 12).desc(), "phrase")
    phrases = weight.filter("mass > 0").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= link_k)
    linked = keep(phrases.select("query_id", F.col("phrase").alias("node"), "mass"), "phrases")
    asking = linked.select("query_id").distinct()
    own = passages.select("query_id", F.col("chunk_id").alias("node"), (F.col("score") * passage_weight).alias("mass")).join(asking, "query_id", "left_semi")
    ranked = pagerank_blocks(edges, linked.unionByName(own), damping, rounds, tolerance, passages.select(F.col("chunk_id").alias("node"))).withColumnRenamed("node", "chunk_id").withColumnRenamed("score", "walked")
    rows = passages.join(ranked, ["query_id", "chunk_id"], "left").join(asking.withColumn("__linked", F.lit(True)), "query_id", "left")
    score = F.round(F.when(F.col("__linked"), F.coalesce("walked", F.lit(0.0))).otherwise(F.col("score")), 9)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    out = rows.select("query_id", "chunk_id", score.alias("score")).withColumn("rank", F.row_number().over(order).cast("long"))
    return out.filter(F.col("rank") <= k)


#: Words that name nobody.
PRONOUNS = ("he", "she", "it", "they", "we", "you", "i", "this", "that", "these", "those")


def merge_extractions(chunks: DataFrame, entities: DataFrame, triples: DataFrame) -> DataFrame:
    """Per chunk what was extracted from it: chunk_id, content, entities, triples, confidences, failed.

    chunks: chunk_id, content; entities: chunk_id, entities (an array, null where extraction failed);
    triples: chunk_id, triples (an array of arrays, null where it failed), cut_short. Entities
    are the distinct normal forms of named ones and of both ends of whole triples, sorted, without
    pronouns; triples keep their order, in normal form, each with its confidence; those without
    three parts go. A chunk of which either failed or is missing has nothing, and says so.
    """
    rows = chunks.select("chunk_id", "content").join(entities.select("chunk_id", "entities"), "chunk_id", "left").join(triples.select("chunk_id", "triples", "cut_short"), "chunk_id", "left")
    failed = F.col("entities").isNull() | F.col("triples").isNull()
    rows = rows.select(
        "chunk_id", "content", failed.alias("failed"), F.coalesce("cut_short", F.lit(False)).alias("cut"), F.when(failed, F.array().cast("array<string>")).otherwise(F.col("entities")).alias("named"),
        F.when(failed, F.array().cast("array<array<string>>")).otherwise(F.filter("triples", lambda t: F.size(t) == 3)).alias("whole"),
    )
    ends = F.flatten(F.transform("whole", lambda t: F.array(t[0], t[2])))
    forms = F.array_sort(F.array_distinct(F.transform(F.concat("named", ends), entity)))
    sure = F.transform("whole", lambda t: F.round(triple_confidence(t[0], t[1], t[2], F.col("content"), F.col("named"), F.col("cut")), 6))
    return rows.select(
        "chunk_id", "content", F.filter(forms, lambda e: (e != "") & ~e.isin(*PRONOUNS)).alias("entities"), F.transform("whole", lambda t: F.transform(t, entity)).alias("triples"), sure.alias("confidences"), "failed",
    )


def keep_fallback(judged: DataFrame, group: str, least: int) -> DataFrame:
    """Rows that a judge keeps; a row that it failed on stays, and where fewer than ``least`` are left the first ``least`` of the input stay.

    judged: group, position, verdict (keep, drop, unparseable, error).
    """
    kept = F.col("verdict").isin("keep", "error")
    n = judged.groupBy(group).agg(F.count_if(kept).alias("__kept"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("position"))
    rows = judged.withColumn("__place", place).join(n, group)
    return rows.filter(F.when(F.col("__kept") < least, F.col("__place") <= least).otherwise(kept)).drop("__place", "__kept")


def delete_cascade(pairs: DataFrame, gone: DataFrame, chunk: str, item: str) -> DataFrame:
    """Items that only the deleted chunks used; pairs: (chunk, item)."""
    deleted = pairs.join(gone.select(chunk), chunk, "left_semi").select(item).distinct()
    alive = pairs.join(gone.select(chunk), chunk, "left_anti").select(item).distinct()
    return deleted.join(alive, item, "left_anti")


def statistics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, total weight and the largest degree."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).agg(F.count(F.lit(1)).alias("nodes"), F.max("degree").alias("largest_degree"))
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("weight"), 6).alias("weight")).crossJoin(degree)  # one row each


def phrase_weights(facts: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """Mean over a phrase's facts of score x confidence / passages that name it; beyond the best ``k`` zero."""
    n = passages.groupBy("phrase").agg(F.countDistinct("chunk_id").alias("n"))
    weight = facts.join(n, "phrase").groupBy("phrase").agg(F.avg(F.col("score") * F.col("confidence") / F.col("n")).alias("weight"))
    best = weight.filter("weight > 0").orderBy(F.col("weight").desc(), "phrase").limit(k).select("phrase", F.lit(True).alias("__in"))
    return weight.join(best, "phrase", "left").select("phrase", F.when(F.col("__in"), F.col("weight")).otherwise(0.0).alias("weight"))
