"""Ball-tree search against all inner products."""

import numpy as np
import pytest
from corpora import with_clashes
from pyspark.sql import functions as F

from tallymill.llm import ball_tree


def by_hand(rows, asks, k):
    out = []
    usable = [(i, v) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None for x in v)]
    for i, v in {(i, tuple(v)) for i, v in usable if asks(i)}:
        scores = [(-sum(a * b for a, b in zip(v, w)), j) for j, w in usable if j != i and len(w) == len(v)]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard, block", [(8192, 1024), (70, 9)])
@pytest.mark.parametrize("spread", [3, 300])
def test_search(spark, shard, block, spread):
    rng = np.random.default_rng(spread)
    rows = [(k, rng.integers(-spread, spread + 1, 6).tolist()) for k in range(500)]
    rows += [(500 + k, [1, 2, 3, 4, 5, 6]) for k in range(150)]
    rows += [(700, None), (701, [1, None, 2, 3, 4, 5]), (None, [1] * 6), (702, []), (703, [1, 2]), (710, [3, 4]), (720, [2**40] * 6)]
    rows += [(20, rows[20][1]), (21, rows[21][1])]
    vectors = with_clashes(spark.createDataFrame(rows, "vec_id long, vector array<long>"), "score", "rank", "query_id", "shard", "block", "width")
    got = ball_tree.top_k(vectors, F.col("vec_id") % 10 == 0, 5, shard, block).collect()
    assert sorted(tuple(r) for r in got) == by_hand(rows, lambda i: i % 10 == 0, 5)


def test_large_values_are_exact(spark):
    rows = [(k, [2**27 - k, 2**27 - 3 * k, -(2**27) + k]) for k in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = ball_tree.top_k(vectors, F.col("vec_id") == 0, 5).collect()
    assert sorted(tuple(r) for r in got) == by_hand(rows, lambda i: i == 0, 5)


def test_values_beyond_any_double(spark):
    rows = [(0, [3 * 10**8, 1]), (50, [-4 * 10**8, 1]), (51, [4 * 10**8, 5]), (1, [1, 6])]
    rows += [(100, [2**61, 1]), (2, [3, 2**40 + 1]), (3, [3, 2**40]), (4, [-3, 1])]
    vectors = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    wide = F.col("vec_id").isin(0, 50, 51, 1)
    got = ball_tree.top_k(vectors.where(wide), F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(tuple(r) for r in got) == by_hand(rows[:4], lambda i: i % 50 == 0, 5)
    got = ball_tree.top_k(vectors.where(~wide), F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(tuple(r) for r in got) == by_hand(rows[4:], lambda i: i % 50 == 0, 5)
    with pytest.raises(Exception, match="beyond 64 bits"):
        ball_tree.top_k(vectors, F.col("vec_id") % 50 == 0, 5).collect()


def test_nodes_hold_their_points():
    points = np.random.default_rng(1).integers(-9, 9, (1000, 4))
    tree = ball_tree.BallTree(points)
    for low, high, child, centre, radius in zip(tree.low, tree.high, tree.child, tree.centre, tree.radius):
        own = points[tree.order[low:high]]
        assert np.sqrt(((own - centre) ** 2).sum(axis=1)).max() <= radius + 1e-9
        if child >= 0:
            assert (tree.low[child], tree.high[child + 1]) == (low, high) and tree.high[child] == tree.low[child + 1]


def test_empty(spark):
    assert ball_tree.top_k(spark.createDataFrame([], "vec_id long, vector array<long>"), F.lit(True)).count() == 0
