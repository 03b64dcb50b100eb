"""Top-k by KD-trees against brute force."""

import math
import random

import numpy as np
import pytest

from tessera.llm import queries
from tessera.llm.kdtree import Tree, top_k

SCHEMA = "vec_id long, embedding array<float>, q string, kth int"


def plain(rows, k=5, step=50):
    q = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        mine = [math.floor(256 * float(np.float32(x))) for x in v]
        q[i] = min(q.get(i, mine), mine)
    out = []
    for i in q:
        if i % step == 0:
            hits = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i and len(q[j]) == len(q[i]))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(hits[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("shape", [(400, 100_000, 100_000), (400, 60, 3)])
def test_against_all_pairs(spark, shape):
    n, shard_rows, block_rows = shape
    rnd = random.Random(n)
    same = [0.25, -0.5, 0.125]
    rows = [(i, same if rnd.random() < 0.3 else [rnd.gauss(0, 1) for _ in range(3)]) for i in range(n)]
    rows += [(-50, [1.0, 1.0, 1.0]), (None, same), (1000, None), (1050, [float("nan"), 0.0, 0.0]), (1100, [float("inf"), 0.0, 0.0]),
             (1150, [None, 1.0, 1.0]), (1200, [1.0, 2.0]), (1201, [3.0, 4.0]), (100, same), (100, same), (7, [9.0, 9.0, 9.0]), (1250, []), (1300, [])]
    got = [tuple(r) for r in top_k(frame(spark, rows), shard_rows=shard_rows, block_rows=block_rows).collect()]
    assert sorted(got) == plain(rows)


def test_few_and_none(spark):
    assert top_k(frame(spark, [(0, [1.0])])).collect() == []
    assert top_k(frame(spark, [])).collect() == []
    rows = [(0, [1.0]), (1, [2.0]), (50, [0.5])]
    assert sorted(map(tuple, top_k(frame(spark, rows)).collect())) == plain(rows)


def test_large_components_are_exact():
    rnd = np.random.default_rng(1)
    x = rnd.integers(-(1 << 40), 1 << 40, (50, 4))
    tree = Tree(np.arange(50), x.copy(), 3, leaf=4)
    for i, hits in tree.search(np.arange(50), x, np.zeros(50), np.zeros(50, bool), 2):
        want = sorted(((sum(int(a) * int(b) for a, b in zip(x[i], x[j])), -j) for j in range(50) if j != i), reverse=True)[:2]
        assert sorted(hits, reverse=True) == want


def test_boxes_are_skipped():
    rnd = np.random.default_rng(2)
    x = np.concatenate([rnd.integers(900, 1000, (64, 8)), rnd.integers(-1000, -900, (4000, 8))])
    tree = Tree(np.arange(len(x)), x.copy(), 6, leaf=16)
    met = 0

    class Counted(list):
        def __getitem__(self, i):
            nonlocal met
            met += 1
            return super().__getitem__(i)

    tree.nodes = Counted(tree.nodes)
    list(tree.search(np.array([-1]), np.full((1, 8), 10), np.zeros(1), np.zeros(1, bool), 5))
    assert met < len(list(tree.nodes)) / 4


def test_query_on_the_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = queries.QUERIES["op9_exact_top_k"](spark, d)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == plain(rows)
