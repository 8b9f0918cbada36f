"""Top-k retrieval over impact-ordered postings.

Units are counted once: a table of postings (unit, token, frequency, length) is written
and everything else is taken from it, the statistics of the corpus, the weights of any
number of schemes, and the index. An index deals units into shards of bounded size; in
each, a token's postings stand by falling weight, so that every block of them has its
first weight as maximum. A query walks the blocks of its tokens by falling maximum and
adds up weights; once what all unread blocks could add to an unseen unit is less than
the k-th best sum so far, the rest is skipped, and the units that can still be among the
best get their whole scores. So the result is exact, and a frequent token costs what
its heavy postings cost. The shard holds a part of a frequent token's postings, never
all of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.skew import fits, small, spread_join
from factloom.sources.shared import keep

#: BM25.
K1, B = 1.2, 0.75
#: Units and postings of a shard (whichever is reached first), queries that meet a shard at a time, and postings of a block.
SHARD_UNITS, SHARD_POSTINGS, QUERY_BLOCK, BLOCK = 20_000, 1_000_000, 4096, 128


def asked_tokens(queries: DataFrame, query_key: str, tokens: Column) -> DataFrame:
    """(query, token, qtf) of every query."""
    return queries.select(query_key, F.explode(tokens).alias("token")).groupBy(query_key, "token").agg(F.count(F.lit(1)).alias("qtf"))


class Postings:
    """Postings of the wanted tokens, written once, and the statistics of all units."""

    def __init__(self, units: DataFrame, key: str, fields: dict[str, tuple[Column, float]], wanted: DataFrame | None = None):
        """``fields``: name -> (tokens, weight): frequency and length are sums over fields, each times its weight.

        ``wanted``: the distinct tokens to keep, all of them if left out. Every unit is
        read once: beside its postings it leaves one row without a token, for the statistics.
        """
        fields = {name: (F.coalesce(t, F.array().cast("array<string>")), w) for name, (t, w) in fields.items()}
        length = sum((F.size(t) * w for t, w in fields.values()), F.lit(0.0))
        one = lambda t, w: F.transform(t, lambda x: F.struct(x.alias("token"), F.lit(float(w)).alias("f")))
        none = F.lit(None).cast("string")
        if len(fields) == 1:  # one weight for all, so that no pair is made of each token
            (tokens, own), = fields.values()
            rows = units.select(F.col(key).alias("key"), length.alias("length"), F.explode(F.concat(F.array(none), tokens)).alias("token"))
            rows = rows.withColumn("f", F.when(F.col("token").isNull(), 0.0).otherwise(float(own)))
        else:
            itself = F.array(F.struct(none.alias("token"), F.lit(0.0).alias("f")))
            rows = units.select(F.col(key).alias("key"), length.alias("length"), F.explode(F.concat(itself, *[one(t, w) for t, w in fields.values()])).alias("e"))
            rows = rows.select("key", "length", "e.token", "e.f")
        if wanted is not None:
            mark = small(wanted.select("token").withColumn("__wanted", F.lit(True)))
            rows = rows.join(mark, "token", "left").filter(F.col("__wanted") | F.col("token").isNull()).drop("__wanted")
        self.key = key
        self.table = keep(rows.groupBy("key", "token", "length").agg(F.sum("f").alias("tf")), "postings")
        self.n, average = self.table.filter("token IS NULL").agg(F.count(F.lit(1)), F.avg("length")).first()
        self.average = average if average and average > 0 else 1.0
        self.df = self.table.filter("token IS NOT NULL").groupBy("token").agg(F.count(F.lit(1)).alias("df"))

    def _idf(self) -> Column:
        return F.log(1.0 + (self.n - F.col("df") + 0.5) / (F.col("df") + 0.5))

    def _weighted(self, weight: Column) -> DataFrame:
        rows = self.table.filter("token IS NOT NULL")
        if fits(self.df):
            rows = rows.join(F.broadcast(self.df), "token")
        else:  # a token of very many units is split over tasks
            rows = spread_join(rows, self.df, "token", "key", self.df.select("token", F.col("df").alias("n")))
        return rows.select("key", "token", weight.alias("w"))

    def bm25(self) -> DataFrame:
        """(key, token, w): what the token adds to a BM25 score of the unit."""
        norm = K1 * (1.0 - B + B * F.col("length") / self.average)
        return self._weighted(self._idf() * F.col("tf") * (K1 + 1.0) / (F.col("tf") + norm))

    def idf(self) -> DataFrame:
        """(key, token, w): the token's idf, whatever its frequency."""
        return self._weighted(self._idf())


def index(weights: DataFrame, units: int, shard_units: int = SHARD_UNITS) -> tuple[DataFrame, int]:
    """(shard, token, keys, ws): each shard's postings by falling weight, ties by key; and the number of shards."""
    shards = max(1, math.ceil(units / shard_units), math.ceil(weights.count() / SHARD_POSTINGS))
    entry = F.struct((-F.col("w")).alias("minus"), F.col("key").cast("long").alias("key"))
    rows = weights.groupBy(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "token").agg(F.array_sort(F.collect_list(entry)).alias("p"))
    return rows.select("shard", "token", F.col("p.key").alias("keys"), F.transform("p.minus", lambda x: -x).alias("ws")), shards


def walk(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]], n: int, k: int, slack: float = 0.0, block: int = BLOCK, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Units 0 .. n - 1 and their scores, all whose score is at most ``slack`` below the k-th best.

    ``lists``: (units, weights, places by rising unit, factor) of each token, by falling weight;
    no weight is negative.
    ``seen`` gets the number of postings read before the rest was skipped.
    """
    total = np.zeros(n)
    at, ends = [0] * len(lists), [len(x[0]) for x in lists]
    tops = [w[0] * f if len(w) else 0.0 for _, w, _, f in lists]
    bound, read, look = sum(tops), 0, block
    while bound > 0:
        if read >= look:
            look *= 2
            hit = total[total > 0]
            if len(hit) >= k and np.partition(hit, len(hit) - k)[len(hit) - k] - slack > bound * (1 + 1e-12):
                break
        t = max(range(len(lists)), key=tops.__getitem__)
        units, weights, _, factor = lists[t]
        # What has to be read anyway is read in steps that grow with it: as many of them as there are doublings, not blocks.
        stop = min(at[t] + max(block, read // len(lists)), ends[t])
        total[units[at[t] : stop]] += weights[at[t] : stop] * factor  # a unit stands once in a list
        read += stop - at[t]
        at[t] = stop
        new = weights[stop] * factor if stop < ends[t] else 0.0
        bound, tops[t] = bound - tops[t] + new, new
        if bound < 1e-9 and not any(tops):
            bound = 0.0
    if seen is not None:
        seen.append(read)
    hit = np.flatnonzero(total > 0)
    if len(hit) > k:
        least = np.partition(total[hit], len(hit) - k)[len(hit) - k]
        hit = hit[total[hit] + bound * (1 + 1e-12) >= least - slack - 1e-9]
    # The whole scores of what is left, token by token in one order, so that equal units get equal sums.
    score = np.zeros(len(hit))
    if len(hit) * 8 > n:  # so many that adding up all units is cheaper than looking each up
        total.fill(0.0)
        for units, weights, _, factor in lists:
            total[units] += weights * factor
        score, lists = total[hit], []
    for units, weights, order, factor in lists:
        place = np.searchsorted(units, hit, sorter=order)
        place = order[np.minimum(place, len(units) - 1)]
        score += np.where(units[place] == hit, weights[place] * factor, 0.0)
    if len(hit) > k:
        near = score >= np.partition(score, len(hit) - k)[len(hit) - k] - slack - 1e-9
        hit, score = hit[near], score[near]
    return hit, score


def _answer(k: int, slack: float):
    def run(key, postings: pa.Table, questions: pa.Table) -> pa.Table:
        tokens = postings.column("token").to_pylist()
        keys = postings.column("keys").combine_chunks()
        cuts = np.concatenate([[0], np.cumsum(keys.value_lengths().to_numpy(zero_copy_only=False))]) if len(keys) else np.zeros(1, int)
        units, local = np.unique(keys.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        ws = postings.column("ws").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        place = {t: (local[a:b], ws[a:b], np.argsort(local[a:b], kind="stable")) for t, a, b in zip(tokens, cuts[:-1], cuts[1:])}
        out_q, out_key, out_score = [], [], []
        for q, asked in zip(questions.column("q").to_pylist(), questions.column("asked").to_pylist()):
            lists = [(*place[x["token"]], float(x["qtf"])) for x in asked if x["token"] in place]
            if lists:
                hit, score = walk(lists, len(units), k, slack)
                out_q.append(np.full(len(hit), q))
                out_key.append(units[hit])
                out_score.append(score)
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return pa.table({"q": join(out_q, pa.int64()), "key": join(out_key, pa.int64()), "score": join(out_score, pa.float64())})

    return run


def search(weights: DataFrame, asked: DataFrame, key: str, query_key: str, units: int, k: int, slack: float = 0.0, digits: int = 6, shard_units: int = SHARD_UNITS, query_block: int | None = None) -> DataFrame:
    """(query, key, score, rank): per query the k units of most weight, ties by key; exact.

    ``weights``: (key, token, w), ``asked``: (query, token, qtf); keys are whole numbers.
    Scores are rounded to ``digits`` before they are ranked. With ``slack`` all units are
    returned whose score is at most so much below a shard's k-th best, without a rank: a
    later step may add up to that to any of them. Queries travel to each shard, a block
    of them at a time; each shard and block is one group of bounded size.
    """
    lists, shards = index(weights, units, shard_units)
    queries = asked.groupBy(F.col(query_key).cast("long").alias("q")).agg(F.array_sort(F.collect_list(F.struct("token", "qtf"))).alias("asked"))
    blocks = max(1, math.ceil(asked.select(query_key).distinct().count() / (query_block or QUERY_BLOCK)))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = lists.select("*", every(blocks, "part")) if blocks > 1 else lists.withColumn("part", F.lit(0))
    right = queries.select("q", "asked", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("part"), every(shards, "shard"))
    found = left.groupBy("part", "shard").cogroup(right.groupBy("part", "shard")).applyInArrow(_answer(k, slack), "q long, key long, score double")
    found = found.select(F.col("q").alias(query_key), F.col("key").alias(key), F.round("score", digits).alias("score"))
    if slack:
        return found
    order = Window.partitionBy(query_key).orderBy(F.col("score").desc(), key)
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


#: Fixed values of sentence search: points where the text, and where the heading holds the whole question, and the share of the lexical score.
WHOLE_TEXT, WHOLE_HEADING, LEXICAL_SHARE = 2.0, 1.25, 0.35
#: Best sentences whose neighbouring lines are shown too, and what these keep of the score.
LEADERS, NEIGHBOUR_SHARE = 4, 0.42


def sentence_search(sentences: DataFrame, questions: DataFrame, k: int, neighbours: int, lexical: Callable[[], Column], most_lexical: float, read: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Per question its k best sentences and lines beside the best four: question_id, sentence_id, kind, score, rank.

    sentences: sentence_id (a whole number), document_id, line, heading, tokens (of heading and
    text), heading_key, text_key (compact forms) and what ``lexical`` reads; questions:
    question_id, tokens, key and what ``lexical`` reads. The score is BM25, plus what the
    question earns by standing in text or heading as a whole, plus a share of a lexical
    score of at most ``most_lexical``. These extras are bounded, so that only sentences
    within that bound of the k-th best BM25 score are looked at; ``read`` adds to these what
    need not be there for all (heading_key, text_key, what ``lexical`` reads). A neighbour has
    the same heading and is no hit itself.
    """
    asked = asked_tokens(questions, "question_id", F.col("tokens"))
    post = Postings(sentences, "sentence_id", {"tokens": (F.col("tokens"), 1.0)}, asked.select("token").distinct())
    slack = WHOLE_TEXT + WHOLE_HEADING + LEXICAL_SHARE * most_lexical
    near = search(post.bm25(), asked, "sentence_id", "question_id", post.n, k, slack, digits=12)
    # A shard's k-th best is no better than that of all shards, which leaves far fewer sentences to be read again.
    near = keep(near, "near")
    best = near.withColumn("__r", F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("score").desc()))).filter(F.col("__r") <= k)
    least = best.groupBy("question_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    near = near.join(least, "question_id").filter((F.col("n") < k) | (F.col("score") >= F.col("least") - slack - 1e-9)).select("question_id", "sentence_id", "score")
    near = keep(near, "near")
    rows = read(sentences.drop("tokens").join(small(near), "sentence_id")).join(questions.drop("tokens"), "question_id")
    whole = lambda c, points: F.when((F.col("key") != "") & F.contains(F.col(c), F.col("key")), points).otherwise(0.0)
    score = F.round(F.col("score") + whole("text_key", WHOLE_TEXT) + whole("heading_key", WHOLE_HEADING) + LEXICAL_SHARE * lexical(), 8)
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "document_id", "line", "sentence_id")
    ranked = rows.select("question_id", "sentence_id", "document_id", "line", "heading", score.alias("score")).withColumn("rank", F.row_number().over(order))
    best = keep(ranked.filter(F.col("rank") <= k), "sentences")
    beside = best.filter(F.col("rank") <= LEADERS).select("question_id", "document_id", "heading", F.col("rank").alias("leader"), "score", F.posexplode(F.array(F.col("line") - 1, F.col("line") + 1)).alias("side", "line"))
    there = sentences.select("document_id", "heading", "line", "sentence_id")
    beside = there.join(small(beside), ["document_id", "heading", "line"]).join(best.select("question_id", "sentence_id"), ["question_id", "sentence_id"], "left_anti")
    # A line beside two leaders counts for the better one, which comes first.
    first = beside.groupBy("question_id", "sentence_id", "document_id", "line").agg(F.min_by("score", F.struct("leader", "side")).alias("score"))
    first = first.withColumn("score", F.round(F.col("score") * NEIGHBOUR_SHARE, 8)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= neighbours)
    shown = lambda df, kind: df.select("question_id", "sentence_id", F.lit(kind).alias("kind"), "score", F.col("rank").cast("long"))
    return shown(best, "hit").unionByName(shown(first, "neighbour"))
