"""Exact top-k inner-product search by no-random-access aggregation over sorted lists.

A block of candidates has one list per dimension, its entries sorted by value: read from the top by queries of a positive
component there, from the bottom by those of a negative one. Lists are read side by side, in rounds of growing depth. After a
round, each candidate has a lower bound (what was read of it, the rest at the lists' worst) and an upper bound (the rest at
the values last read). Candidates whose upper bound is below the bar are out; once few are left - no one unread or out can
qualify - their scores are resolved by reading on for them alone. A block of queries goes through a round together, so that
bounds are matrix products of the read parts.

The bar is the k-th best lower bound of the block, or what is known otherwise if that is more: one block, the seed, is
searched first, and each query's k-th best resolved score there is its bar in all other blocks; in the seed, a sixteenth of the
candidates is resolved first. So lists are read to the depth at which candidates fall below a score that k others are known to
reach, not until the block's own bounds close.

Queries and candidates are dealt to a grid of blocks of bounded size, by a hash of vec_id, and each query's best of every
block are merged. Scores are integers, held exactly in doubles up to 2^53.

Defined results: vectors that are null, empty, hold a null or non-finite component, or have a null vec_id take no part; only
vectors of as many components are compared; rows with the same vec_id all are candidates, and each of them a query, whose
results are merged under its vec_id (so equal rows give each result as often as they are there); a query never meets a row of its own vec_id; ties go to the smaller vec_id; fewer candidates
than k are all returned; very long vectors make a block's memory grow with their length, so callers give a smaller `block`;
an empty table gives none; further columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import cut

#: Candidates of a block, queries that go through its rounds together, and queries that are dealt to a block: each candidate is
#: copied once for so many.
BLOCK, QUERIES, DEALT = 4096, 1024, 65_536


def integers(vectors: DataFrame, column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, vector): floor(scale * x) of each component, x as double."""
    x = F.transform(vectors[column], lambda v: v.cast("double"))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).filter(finite("x"))
    return rows.select("vec_id", F.transform("x", lambda v: F.floor(F.lit(scale) * v).cast("double")).alias("vector"))


def finite(column: str) -> F.Column:
    """Whether no component is null, NaN or infinite."""
    return F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


class Lists:
    """The sorted lists of a block: values of each dimension from the bottom, and each entry's rank there."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        by_value = np.argsort(self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, by_value, 0)
        self.rank = np.empty_like(by_value)
        np.put_along_axis(self.rank, by_value, np.arange(len(ids))[:, None], 0)


def search_block(query_ids: np.ndarray, queries: np.ndarray, lists: Lists, k: int, bars: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query's number, vec_id, score) of the k best of each query in a block, and the share of list entries each query read.

    bars: a score that k candidates anywhere are known to reach.
    """
    ids, vectors, listed, rank = lists.ids, lists.vectors, lists.values, lists.rank
    n, m = len(ids), len(queries)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)  # read from the top, from the bottom
    low, high = listed[0], listed[-1]
    first, stop = np.searchsorted(ids, query_ids), np.searchsorted(ids, query_ids, side="right")
    own_row = np.repeat(np.arange(m), stop - first)
    own_at = np.arange(len(own_row)) + np.repeat(first - np.cumsum(stop - first) + (stop - first), stop - first)
    active, out, read = np.arange(m), [], np.ones(m)
    bars, seeds = np.full(m, -np.inf) if bars is None else bars, max(4 * k, n // 16)
    if np.isinf(bars).any() and k < seeds < n:
        scores = vectors[:seeds] @ queries.T
        inside = own_at < seeds
        scores[own_at[inside], own_row[inside]] = -np.inf
        bars = np.maximum(bars, np.partition(scores, seeds - k, axis=0)[seeds - k])
    else:
        seeds = 0
    depths = [max(k + 1, n // 16), *(n * x // 8 for x in range(2, 7)), n]
    for depth in depths:
        if not len(active):
            break
        depth = min(depth, n)
        u, d = up[active], down[active]
        place = np.full(m, -1)
        place[active] = np.arange(len(active))
        mine = place[own_row] >= 0
        own = own_at[mine], place[own_row[mine]]
        if depth == n:  # all is read: the bounds are the scores
            least = most = vectors @ queries[active].T
        else:
            top, bottom = rank >= n - depth, rank < depth
            least = np.where(top, vectors, low) @ u.T + np.where(bottom, vectors, high) @ d.T
            most = np.where(top, vectors, listed[n - depth]) @ u.T + np.where(bottom, vectors, listed[depth - 1]) @ d.T
        least[own] = -np.inf
        bar = np.maximum(bars[active], np.partition(least, n - k, axis=0)[n - k] if n > k else -np.inf)
        alive = most >= bar
        alive[own] = False
        count = alive.sum(0)
        done = (count <= max(4 * k, n // 8)) | (depth == n)
        c, q = np.nonzero(alive[:, done])
        out.append((active[done][q], c))
        # entries read in the rounds, then those left of the candidates to resolve
        read[active[done]] = depth / n + (1 - depth / n) * np.minimum(1, (count[done] + seeds) / n)
        active = active[~done]
    q, c = (np.concatenate(x) for x in zip(*out, strict=True))
    scores = np.concatenate([np.einsum("ij,ij->i", queries[q[i : i + 65536]], vectors[c[i : i + 65536]]) for i in range(0, len(q), 65536)] or [np.empty(0)])
    best = np.lexsort((ids[c], -scores, q))
    q, c, scores = q[best], c[best], scores[best]
    place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    return q[place < k], ids[c[place < k]], scores[place < k], read


_FOUND = "query_id long, ask long, times int, vec_id long, score long, entries_read double"


def _cells(candidates: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Each query's k best of each cell: candidates (column, dims, vec_id, vector) in copies for every row of the grid, queries
    (ask, times, bar) in copies for every column."""

    def run(part: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[] for _ in range(6)]
        asks, every_id = part["asks"].to_numpy(), part["vec_id"].to_numpy()
        values = part["vector"].combine_chunks().values.to_numpy().reshape(len(every_id), -1)
        if asks.any() and not asks.all():
            lists = Lists(every_id[~asks], values[~asks])
            query_ids, own, number, times, bars = every_id[asks], values[asks], *(part[c].to_numpy()[asks] for c in ("ask", "times", "bar"))
            for i in range(0, len(query_ids), QUERIES):
                some = slice(i, i + QUERIES)
                q, c, s, read = search_block(query_ids[some], own[some], lists, k, bars[some])
                for x, y in zip(found, (query_ids[some][q], number[some][q], times[some][q], c, s.astype(np.int64), read[q]), strict=True):
                    x.append(y)
        kinds = (np.int64, np.int64, np.int32, np.int64, np.int64, np.float64)
        return pa.table({name: np.concatenate(x) if x else np.empty(0, kind) for name, x, kind in zip(("query_id", "ask", "times", "vec_id", "score", "entries_read"), found, kinds, strict=True)})

    columns = ("row", "column", "dims", "asks", "ask", "times", "bar", "vec_id", "vector")
    both = candidates.withColumns({"asks": F.lit(False), "ask": F.lit(0).cast("long"), "times": F.lit(1), "bar": F.lit(0.0)}).select(*columns).unionAll(asked.withColumn("asks", F.lit(True)).select(*columns))
    return both.groupBy("row", "column", "dims").applyInArrow(run, _FOUND)


def search(vectors: DataFrame, is_query: F.Column, k: int = 5, block: int = BLOCK, dealt: int = DEALT) -> DataFrame:
    """query_id, rank, vec_id, score, entries_read: for each row of (vec_id, vector) that is_query picks, its k best among all
    others, and the share of the lists' entries that were read for it."""
    counted = vectors.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    across, down = max(1, -(-counted["n"] // block)), max(1, -(-counted["q"] // dealt))
    hashed = vectors.select("vec_id", "vector", F.size("vector").alias("dims"), F.xxhash64("vec_id", "vector").alias("h"), is_query.alias("ask"))
    every = lambda first, n: F.explode(F.sequence(F.lit(first), F.lit(n - 1)))
    cells = hashed.withColumn("column", F.pmod("h", F.lit(across)).cast("int")).withColumn("row", every(0, down)).drop("ask")
    # `ask` tells rows of one vec_id apart, of which equal ones ask once
    asked = hashed.filter("ask").groupBy("vec_id", "vector", "dims", F.col("h").alias("ask")).agg(F.count(F.lit(1)).cast("int").alias("times"))
    asked = asked.withColumn("row", F.pmod(F.xxhash64("ask"), F.lit(down)).cast("int"))
    seed = _cells(cells.filter(F.col("column") == 0), asked.withColumns({"column": F.lit(0), "bar": F.lit(float("-inf"))}), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if across == 1:
        best = seed
    else:
        seed = cut(seed, "seed")
        known = seed.groupBy("query_id", "ask").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).filter(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "ask", F.col("score").cast("double").alias("bar"))
        told = asked.join(known, ["vec_id", "ask"], "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
        rest = _cells(cells.filter(F.col("column") > 0), told.withColumn("column", every(1, across)), k)
        best = seed.unionAll(rest)
    read = F.avg("entries_read").over(Window.partitionBy("query_id"))
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1), "times")))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("entries_read", read).select("query_id", "rank", "vec_id", "score", "entries_read")
