"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector's non-zero integer components are its terms. Candidates are dealt to
ranges, queries to groups, and a task is a pair of a group and a range: it holds
the group's queries and streams the range's candidates in blocks. A block has
postings by term (places and weights); each term's postings, weighted by the
queries that hold it, are scattered into a dense array of scores, the best k are
selected by partition, and selections are merged with those of the blocks
before. What tasks found is merged by query.

A group holds so many queries that their copies cost far less than the
accumulation: with n candidates and m queries, n * groups + m * ranges rows are
shuffled, and groups (ranges beyond a fixed number) grow with m / QUERY_CELLS
(n / RANGE_CELLS) only.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.llm.common import Workspace, need

SCALE = 64
#: Components of a group's queries, held by a task (8 bytes each).
QUERY_CELLS = 16_000_000
#: Components of a range's candidates, which a task streams, and the least number of ranges.
RANGE_CELLS = 64_000_000
LEAST_RANGES = 16
#: Candidates of a block, and queries accumulated together; bound the score array.
BLOCK_ROWS, QUERIES = 2048, 64
FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, terms, most): floor(scale * x) of each component and the largest size of one; rows that take no part are left out."""
    x = F.col("embedding")
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == F.lit(float("inf"))))
    kept = need(vectors, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull()).where(~odd)
    # as a double, which doesn't wrap
    most = F.aggregate(x, F.lit(0.0), lambda m, e: F.greatest(m, F.abs(e.cast("double")) * scale + 1))
    return kept.select(F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("terms"), most.alias("most"))


class Postings:
    """A block's inverted index: for each term the places of the rows that hold it, and their weights."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, flat: np.ndarray, kind) -> None:
        """``ids``: the rows' vec_ids; ``lengths``: components of each; ``flat``: all components."""
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        owner = np.repeat(place, lengths)
        term = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        held = np.flatnonzero(flat)
        held = held[np.lexsort((owner[held], term[held]))]
        self.place, self.weight = owner[held], flat[held].astype(kind)
        self.edges = np.searchsorted(term[held], np.arange(int(lengths.max(initial=0)) + 1))

    @classmethod
    def of(cls, rows: np.ndarray, kind=np.int64) -> Postings:
        """From a dense matrix, rows numbered from 0."""
        return cls(np.arange(len(rows)), np.full(len(rows), rows.shape[1]), rows.ravel(), kind)


def accumulate(queries: np.ndarray, block: Postings) -> np.ndarray:
    """Scores of queries (one a row) against a block, term at a time; scores[i, j] of row i and query j."""
    scores = np.zeros((len(block.ids), len(queries)), queries.dtype)
    for t in range(min(queries.shape[1], len(block.edges) - 1)):
        at = slice(block.edges[t], block.edges[t + 1])
        asking = np.flatnonzero(queries[:, t])
        if at.start == at.stop or not len(asking):
            continue
        places = block.place[at]
        # a row occurs once in a term's postings; whole rows of scores are scattered faster than parts
        if 4 * len(asking) >= len(queries):
            held = scores.take(places, 0)
            held += block.weight[at, None] * queries[:, t]
            scores[places] = held
        else:
            scores[places[:, None], asking] += block.weight[at, None] * queries[asking, t]
    return scores


class Best:
    """The k best candidates of each query so far."""

    def __init__(self, names: np.ndarray, k: int) -> None:
        self.names, self.k = names, k
        self.query = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.bar = np.full(len(names), np.iinfo(np.int64).min)

    def add(self, first: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` of candidates ``ids`` for the queries from ``first`` on, one a column."""
        own = ids[:, None] == self.names[first : first + scores.shape[1]]
        low = np.iinfo(scores.dtype).min
        scores[own] = low
        bar = self.bar[first : first + scores.shape[1]]
        n = len(ids)
        if n > self.k:
            # each query's k-th best here: nothing below it can stay
            bar = np.maximum(bar, np.partition(scores, n - self.k, axis=0)[n - self.k])
        row, query = np.nonzero((scores >= bar) & ~own)
        query_all = np.concatenate([self.query, query + first])
        id_all, score_all = np.concatenate([self.id, ids[row]]), np.concatenate([self.score, scores[row, query].astype(np.int64)])
        order = np.lexsort((id_all, -score_all, query_all))
        q = query_all[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = order[rank < self.k]
        self.query, self.id, self.score = query_all[keep], id_all[keep], score_all[keep]
        last = order[rank == self.k - 1]
        self.bar[query_all[last]] = score_all[last]


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, flat values) of an Arrow list column."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def _search(batches, k: int, kind):
    """Rows of one task, queries first: (asks, vec_id, terms)."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    asked: list = []
    held: list = []
    size = 0
    groups: list[tuple[np.ndarray, Best]] = []

    def search():
        if not groups:
            names = np.concatenate([a for a, _, _ in asked])
            lengths, flat = np.concatenate([a for _, a, _ in asked]), np.concatenate([a for _, _, a in asked])
            rows = np.zeros((len(names), int(lengths.max(initial=0))), kind)
            rows[np.arange(rows.shape[1]) < lengths[:, None]] = flat
            groups.extend((rows[i : i + QUERIES], Best(names[i : i + QUERIES], k)) for i in range(0, len(names), QUERIES))
        block = Postings(*(np.concatenate(x) for x in zip(*held)), kind)
        for queries, best in groups:
            best.add(0, block.ids, accumulate(queries, block))

    for batch in batches:
        asks = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        for flag, into in ((True, asked), (False, held)):
            part = batch.filter(pa.array(asks == flag))
            for at in range(0, part.num_rows, BLOCK_ROWS):
                one = part.slice(at, BLOCK_ROWS)
                into.append((one.column(1).to_numpy(), *_lists(one.column(2))))
                if not flag and asked:
                    size += one.num_rows
                    if size >= BLOCK_ROWS:
                        search()
                        held, size = [], 0
                        into = held
        if not asked:
            held = []
    if asked and held:
        search()
    for _, best in groups:
        if len(best.query):
            yield pa.RecordBatch.from_arrays([pa.array(best.names[best.query]), pa.array(best.id), pa.array(best.score)], schema=schema)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = SCALE, range_cells: int = RANGE_CELLS, query_cells: int = QUERY_CELLS) -> DataFrame:
    """The ``k`` best rows by integer inner product for each query: query_id, rank, vec_id, score.

    Queries are the rows of ``vectors`` (vec_id, embedding) whose vec_id is
    divisible by ``every``; candidates are all rows with another vec_id; ties
    go to the smaller vec_id. Rows with a null vec_id, a null vector or a null
    or non-finite component take no part; a vector shorter than another counts
    as ending in zeros. Rows that repeat a vec_id are candidates each, and a
    repeated query row counts once, the least of its vectors. Components so large that a score could
    leave 64 bits raise an error. An empty table, or one without queries, gives
    an empty result. Extra columns are ignored. ``range_cells`` and
    ``query_cells``: components of a task's candidates and queries.
    """
    space = Workspace(vectors.sparkSession, "topk")
    held = space.put(quantised(vectors, scale), "held")
    asks = F.col("vec_id") % every == 0
    told = held.agg(F.count(F.lit(1)).alias("n"), F.count_if(asks).alias("asked"), F.max("most").alias("most"), F.max(F.size("terms")).alias("width")).first()
    bound = int(told.most or 0) ** 2 * (told.width or 0)
    if bound >= 2**63:
        raise ValueError(f"scores may leave 64 bits: components of up to {told.most} in vectors of {told.width}")
    width = max(1, told.width or 0)
    ranges = max(LEAST_RANGES, -(-told.n * width // range_cells))
    groups = max(1, -(-told.asked * width // query_cells))
    first = held.where(asks).groupBy("vec_id").agg(F.min("terms").alias("terms"))
    spread = first.withColumn("grp", F.pmod(F.xxhash64("vec_id"), F.lit(groups))).withColumn("rng", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))
    # a salt too, as many rows may be alike
    offered = held.withColumn("rng", F.pmod(F.xxhash64("vec_id") + F.monotonically_increasing_id(), F.lit(ranges))).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cell = (F.col("grp") * ranges + F.col("rng")).cast("int").alias("cell")
    asked, offered = (x.select(cell, F.lit(flag).alias("asks"), "vec_id", "terms") for x, flag in ((spread, True), (offered, False)))
    dealt = asked.unionByName(offered).repartitionById(groups * ranges, "cell").sortWithinPartitions(F.desc("asks"))
    kind = np.int32 if bound < 2**31 else np.int64
    found = dealt.select("asks", "vec_id", "terms").mapInArrow(partial(_search, k=k, kind=kind), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_term_at_a_time(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS terms
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.terms, c.terms), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
