"""Exact inner-product search: a ball tree per shard, branch and bound, and a shared score of the k-th result.

Vectors are dealt over shards of bounded size, queries over blocks of bounded size; every block meets every shard. A
node's ball (centre, radius) bounds the inner product with a query from above by ``q . centre + |q| radius``; nodes are
visited in the order of that bound, and those below the query's k-th score so far are left out. In a first pass each
shard follows only the best path to one leaf per query; the k-th best of what all shards found is a lower bound of the
final k-th score, and the second pass starts with it in every shard. Ties are never cut: only nodes whose bound is
truly smaller are left out.

Defined cases: rows with a null id, and vectors null or holding null or non-finite components, take no part; vectors
meet only vectors of their own length; components are 64-bit integers and scores are exact, in whole numbers of any size
where 64 bits might not hold a sum; a score that 64 bits do not hold ends the search with an error; a row never meets rows of its own id; repeated rows of a query ask once, repeated candidates each
count; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF = 64
SHARD_ROWS = 8192
BLOCK_ROWS = 1024
_NONE = np.iinfo(np.int64).min
_RESULT = "query_id long, query_key long, vec_id long, score long"


class BallTree:
    """Nodes in arrays: ``centre``, ``radius``, rows ``[low, high)`` and the first of two children (-1: a leaf)."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        exact = points.astype(float)
        nodes, waiting = [], [(0, len(points))]
        while waiting:
            following = []
            for place, (low, high) in enumerate(waiting):
                own = exact[self.order[low:high]]
                centre = own.mean(axis=0)
                away = ((own - centre) ** 2).sum(axis=1)
                child = -1
                if high - low > LEAF:
                    # halves along the line from the farthest point to the one farthest from it: never empty
                    a = own[away.argmax()]
                    b = own[((own - a) ** 2).sum(axis=1).argmax()]
                    middle = (high - low) // 2
                    split = np.argpartition(own @ (b - a), middle)
                    self.order[low:high] = self.order[low:high][split]
                    # behind the rest of this level and the children found so far
                    child = len(nodes) + len(waiting) - place + len(following)
                    following += [(low, low + middle), (low + middle, high)]
                nodes.append((low, high, child, centre, np.sqrt(away.max())))
            waiting = following
        self.low, self.high, self.child = (np.array([n[k] for n in nodes]) for k in range(3))
        self.centre, self.radius = np.stack([n[3] for n in nodes]), np.array([n[4] for n in nodes])

    def bounds(self, queries: np.ndarray, norms: np.ndarray, which: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Upper bounds for pairs of a query and a node, widened by rounding."""
        centre = np.einsum("ij,ij->i", queries[which], self.centre[nodes])
        size = norms[which] * (self.radius[nodes] + 1e-6)
        return centre + size + 1e-9 * (np.abs(centre) + size) + 1e-6


class Best:
    """The k best candidates per query so far: greater scores first, then smaller ids."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.own, self.k, self.floor = ids, k, floor
        self.scores = np.full((len(ids), k), _NONE)
        self.ids = np.full((len(ids), k), np.iinfo(np.int64).max)

    def kth(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floor)

    def offer(self, which: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = np.where(self.own[which][:, None] == ids, _NONE, scores)
        all_scores = np.concatenate([self.scores[which], scores], axis=1)
        all_ids = np.concatenate([self.ids[which], np.broadcast_to(ids, scores.shape)], axis=1)
        by_id = np.argsort(all_ids, axis=1, kind="stable")
        all_scores, all_ids = np.take_along_axis(all_scores, by_id, 1), np.take_along_axis(all_ids, by_id, 1)
        best = np.argsort(-np.maximum(all_scores, _NONE + 1), axis=1, kind="stable")[:, : self.k]
        self.scores[which] = np.take_along_axis(all_scores, best, 1)
        self.ids[which] = np.take_along_axis(all_ids, best, 1)


def search(
    points: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray, first_leaf_only: bool
) -> Best:
    """Branch and bound of all queries of a block over one shard."""
    tree, best = BallTree(points), Best(own, k, floor)
    exact = queries.astype(float)
    largest = points.shape[1] * max(np.abs(points.astype(float)).max(), 1.0) * max(np.abs(exact).max(), 1.0)
    # doubles hold the products exactly while they stay below 2**53, words of 64 bits below 2**63
    kind = float if largest < 2**53 else np.int64 if largest < 2**62 else object
    rows, row_ids, asked = points[tree.order].astype(kind), ids[tree.order], queries.astype(kind)
    norms = np.sqrt((exact**2).sum(axis=1))

    def visit(which: np.ndarray, leaves: np.ndarray) -> None:
        order = np.argsort(leaves, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(leaves[order])) + 1):
            low, high = tree.low[leaves[part[0]]], tree.high[leaves[part[0]]]
            scores = asked[which[part]] @ rows[low:high].T
            if kind is object:
                scores[own[which[part]][:, None] == row_ids[low:high]] = 0  # its own row is no candidate
                if (scores <= _NONE).any() or (scores >= -_NONE).any():
                    raise ValueError("an inner product is beyond 64 bits")
            best.offer(which[part], row_ids[low:high], scores.astype(np.int64))

    which, nodes = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
    if first_leaf_only:
        while (inner := tree.child[nodes] >= 0).any():
            children = tree.child[nodes[inner]]
            left = tree.bounds(exact, norms, which[inner], children)
            right = tree.bounds(exact, norms, which[inner], children + 1)
            nodes[inner] = np.where(left >= right, children, children + 1)
        visit(which, nodes)
        return best

    leaves = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
    while len(which):
        bound = tree.bounds(exact, norms, which, nodes)
        open_ = bound >= best.kth()[which]
        which, nodes, bound = which[open_], nodes[open_], bound[open_]
        leaf = tree.child[nodes] < 0
        leaves.append((which[leaf], nodes[leaf], bound[leaf]))
        children = tree.child[nodes[~leaf]]
        which, nodes = np.repeat(which[~leaf], 2), np.column_stack([children, children + 1]).ravel()
    which, nodes, bound = (np.concatenate(x) for x in zip(*leaves))
    order = np.lexsort((nodes, -bound, which))  # each query's leaves by their bound, the greatest first
    which, nodes, bound = which[order], nodes[order], bound[order]
    while len(which):
        open_ = bound >= best.kth()[which]
        which, nodes, bound = which[open_], nodes[open_], bound[open_]
        next_ = np.append(True, which[1:] != which[:-1])[: len(which)]
        visit(which[next_], nodes[next_])
        which, nodes, bound = which[~next_], nodes[~next_], bound[~next_]
    return best


def _meet(key, points: pd.DataFrame, queries: pd.DataFrame, k: int, first_leaf_only: bool) -> pd.DataFrame:
    if not len(points) or not len(queries):
        return pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in _RESULT.split(", ")})
    own = queries["query_id"].to_numpy()
    best = search(
        np.stack(points["vector"]), points["vec_id"].to_numpy(), np.stack(queries["asked"]), own, k,
        queries["floor"].to_numpy(), first_leaf_only,
    )
    found = best.scores > _NONE + 1
    row, _ = np.nonzero(found)
    return pd.DataFrame(
        {"query_id": own[row], "query_key": queries["query_key"].to_numpy()[row], "vec_id": best.ids[found], "score": best.scores[found]}
    )


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of each query's ``k`` best rows.

    ``vectors`` has ``vec_id`` and ``vector`` (integers); ``is_query`` marks the rows that ask.
    """
    usable = F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
    usable &= F.forall("vector", lambda x: x.isNotNull()) & (F.size("vector") > 0)
    rows = vectors.where(usable).select(
        F.col("vec_id").cast("long"), F.col("vector").cast("array<long>"), F.size("vector").alias("width"), is_query.alias("asks")
    )
    asking = rows.where("asks").drop("asks").dropDuplicates(["vec_id", "vector"])
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    shards, blocks = -(-max(sizes["n"], 1) // shard_rows), -(-max(sizes["q"], 1) // block_rows)
    dealt = rows.select(
        "vec_id", "vector", "width", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
    )
    queries = asking.select(
        F.col("vec_id").alias("query_id"), F.xxhash64("vector").alias("query_key"), F.col("vector").alias("asked"),
        F.col("width").alias("q_width"), F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).alias("q_block"),
    )

    def met(asked: DataFrame, first_leaf_only: bool) -> DataFrame:
        sent = asked.withColumn("q_shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        pairs = dealt.groupBy("width", "shard", "block").cogroup(sent.groupBy("q_width", "q_shard", "q_block"))
        return pairs.applyInPandas(partial(_meet, k=k, first_leaf_only=first_leaf_only), _RESULT)

    own = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    probed = met(queries.withColumn("floor", F.lit(_NONE + 1).cast("long")), True)
    kth = probed.withColumn("rank", F.row_number().over(own)).where(F.col("rank") == k)
    kth = kth.select(F.col("query_id").alias("q"), F.col("query_key").alias("qk"), F.col("score").alias("kth"))
    shared = queries.join(kth, (F.col("query_id") == F.col("q")) & (F.col("query_key") == F.col("qk")), "left")
    shared = shared.select("query_id", "query_key", "asked", "q_width", "q_block", F.coalesce("kth", F.lit(_NONE + 1)).alias("floor"))
    ranked = met(shared, False).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
