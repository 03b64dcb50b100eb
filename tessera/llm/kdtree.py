"""Exact top-k inner products by a KD-tree in each shard.

Vectors are dealt to shards by a hash of their id. A shard's tree splits at medians
of the widest dimension and keeps each node's tight bounding box. For a query, the
largest inner product that a box allows bounds all vectors below; nodes are taken
best bound first until the bound falls below the kth score so far. Each query first
searches the shard of its own id; the kth score found there goes along to all other
shards, which so can skip boxes from the start. Queries meet a shard in blocks.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import stored

SHARD_ROWS = 4_096
BLOCK_ROWS = 16_384
LEAF = 128
EXACT = 1 << 53  # sums of doubles are exact below


def quantised(vector: Column, scale: int = 256) -> Column:
    """``floor(scale x component)``, each component as a double; null for a null vector
    or one with a null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


class Tree:
    """``ids`` and ``vectors`` (rows of whole numbers), of which ``copies`` rows of
    equal vectors are kept: those of the smallest ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: int, leaf: int = LEAF) -> None:
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        first = np.flatnonzero(np.r_[True, (vectors[1:] != vectors[:-1]).any(axis=1)])
        place = np.arange(len(ids)) - np.repeat(first, np.diff(np.r_[first, len(ids)]))
        self.ids, self.vectors = ids[place < copies], vectors[place < copies]
        self.leaf = max(leaf, copies)
        self.nodes: list[tuple[int, int, int, int]] = []  # first and last row, children or -1
        low, high = [], []
        todo = [(0, len(self.ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            number = len(self.nodes)
            self.nodes.append((a, b, -1, -1))
            if parent >= 0:
                p = list(self.nodes[parent])
                p[2 + side] = number
                self.nodes[parent] = tuple(p)
            part = self.vectors[a:b]
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            if b - a > self.leaf:
                widest = int(np.argmax(high[-1] - low[-1])) if part.shape[1] else 0
                middle = (b - a) // 2
                split = np.argpartition(part[:, widest], middle) if part.shape[1] else np.arange(b - a)
                self.vectors[a:b], self.ids[a:b] = part[split], self.ids[a:b][split]
                todo += [(a, a + middle, number, 0), (a + middle, b, number, 1)]
        self.low, self.high = np.array(low), np.array(high)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, known: np.ndarray, k: int):
        """Yields each query's number and its hits ``(score, id)``, the best ``k`` of this
        shard. Where ``known``, the query has ``k`` hits elsewhere of score ``kth`` or more."""
        most = int(np.abs(queries).max(initial=0)) * int(np.abs(self.vectors).max(initial=0)) * max(1, queries.shape[1])
        kind = np.float64 if most < EXACT else object  # beyond, products in whole numbers of any size
        rows, queries = self.vectors.astype(kind), queries.astype(kind)
        bounds = np.maximum(queries, 0) @ self.high.astype(kind).T + np.minimum(queries, 0) @ self.low.astype(kind).T
        for i, query in enumerate(queries):
            best: list[tuple] = []  # heap: (score, -id), the worst first
            least = kth[i] if known[i] else None
            bound = bounds[i]
            heap = [(-bound[0], 0)]
            while heap:
                top, node = heapq.heappop(heap)
                if least is not None and -top < least:
                    break
                a, b, left, right = self.nodes[node]
                if left >= 0:
                    heapq.heappush(heap, (-bound[left], left))
                    heapq.heappush(heap, (-bound[right], right))
                    continue
                scores = rows[a:b] @ query
                for j in (range(b - a) if least is None else np.flatnonzero(scores >= least).tolist()):
                    doc = int(self.ids[a + j])
                    if doc == query_ids[i]:
                        continue
                    hit = (int(scores[j]), -doc)
                    if len(best) < k:
                        heapq.heappush(best, hit)
                    elif hit > best[0]:
                        heapq.heapreplace(best, hit)
                if len(best) == k:
                    least = best[0][0] if least is None else max(least, best[0][0])
            yield i, best


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _search(k: int):
    names = ["query_id", "vec_id", "score"]

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if vectors.num_rows and queries.num_rows:
            tree = Tree(vectors["vec_id"].to_numpy(), _matrix(vectors["q"]).copy(), k + 1)
            ids, kth = queries["vec_id"].to_numpy(), queries["kth"]
            known = np.array(kth.is_valid())
            for i, hits in tree.search(ids, _matrix(queries["q"]), kth.fill_null(0).to_numpy(), known, k):
                out.extend((int(ids[i]), -doc, score) for score, doc in hits)
        columns = zip(*out) if out else ([], [], [])
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

    return run


def top_k(vectors: DataFrame, queries: str = "vec_id % 50 = 0", k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``queries`` names (of the
    columns ``vec_id`` and ``q``), the ``k`` rows with the largest inner products of
    quantised vectors but its own, ties to the smaller id.

    Rows with a null id, and vectors that are null or hold a null or non-finite component,
    take no part. Rows that share an id count once, with the smallest vector. Vectors of
    different lengths do not meet. Empty table, or no other row: no hit."""
    q = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("q"))
    q = stored(q.where("vec_id is not null and q is not null").groupBy("vec_id").agg(F.min("q").alias("q")), "vectors")
    asked = q.where(queries).toDF("vec_id", "q")
    shards, blocks = max(1, -(-q.count() // shard_rows)), max(1, -(-asked.count() // block_rows))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int")
    keys = ["shard", "block", "dims"]
    dims = F.size("q").alias("dims")
    rows = q.select("vec_id", "q", shard.alias("shard"), dims)
    every = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    first = asked.select("vec_id", "q", shard.alias("shard"), block.alias("block"), dims, F.lit(None).cast("long").alias("kth")).toDF("vec_id", "q", *keys, "kth")
    schema = "query_id long, vec_id long, score long"
    own = rows.join(first.select(*keys).distinct(), ["shard", "dims"])  # blocks that ask this shard
    own = own.toDF(*own.columns)
    home = stored(own.groupBy(*keys).cogroup(first.groupBy(*keys)).applyInArrow(_search(k), schema), "home")
    kth = home.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
    rest = first.drop("kth").withColumnRenamed("shard", "home").join(kth, "vec_id", "left")
    rest = rest.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).where("shard <> home")
    rest = rest.toDF(*rest.columns)
    away = every.groupBy(*keys).cogroup(rest.groupBy(*keys)).applyInArrow(_search(k), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return home.union(away).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
