"""Maximum inner product search with vantage-point trees, one per shard.

Vectors are lengthened by one component so that all of a shard have its
largest norm; the largest inner product is then the smallest Euclidean distance.
Both sides are first scaled by powers of two, so that no square overflows.  A shard's
tree splits its vectors by their distance from a vantage point at the median.
A branch is left out when the triangle inequality puts all of it farther away
than the k-th neighbour found so far; ``factor`` scales that neighbour's
distance in the test: 1 is exact, smaller values leave out more.

Rows are dealt to shards by a hash, so a vector that many rows share spreads
over all of them, and within a shard equal vectors are one point with a list
of ids.  Queries visit each shard in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import ship_package, stored

SHARD_ROWS = 65_536     # rows of a shard, at most about
LEAF = 256
QUERY_BLOCK = 8_192

_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Tree:
    """A vantage-point tree over the distinct rows of ``x`` (original vectors),
    lengthened to ``longest`` (their largest norm, if not given)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, longest: float | None = None, seed: int = 7, leaf: int = LEAF):
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]).any(1)
        self.ids, self.first = ids, np.append(np.flatnonzero(new), len(x))
        self.x = x[new]
        top = np.abs(self.x).max(initial=0.0)
        small = _scaled(self.x, top)
        norms = (small ** 2).sum(1)
        most = max(norms.max(initial=0.0), 0.0 if longest is None else float(_scaled(longest, top)) ** 2)
        self.norm = math.sqrt(most)
        self.points = np.column_stack([small, np.sqrt(np.maximum(most - norms, 0))])
        # what rounding can add to a distance, given as the root of an error of squares up to the largest
        self.slack = float(np.sqrt(8 * (x.shape[1] + 4) * np.finfo(float).eps * max(most, 1.0) * 4))
        self.square = (self.points ** 2).sum(1)
        self.leaf, self.compared = leaf, 0
        self.root = self._build(np.arange(len(self.x)), np.random.default_rng(seed))

    def _build(self, rows: np.ndarray, rng) -> tuple:
        if len(rows) <= self.leaf:
            return (rows,)
        at = rng.integers(len(rows))
        rows[[0, at]] = rows[[at, 0]]
        vantage, rest = rows[0], rows[1:]
        away = np.sqrt(((self.points[rest] - self.points[vantage]) ** 2).sum(1))
        half = len(rest) // 2
        order = np.argpartition(away, half)
        border = away[order[half]]
        return (rows[:1], border, self._build(rest[order[:half]], rng), self._build(rest[order[half:]], rng))

    def search(self, own_ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query: ids and scores of the ``k`` best rows other than
        its own, ties to smaller ids."""
        n = len(queries)
        # a query's own scale changes no order of its inner products: it is taken as near to the points' norm as powers of two allow
        small = _scaled(queries, np.abs(queries).max(axis=1, initial=0.0, keepdims=True))
        norm = np.sqrt((small ** 2).sum(1, keepdims=True))
        if self.norm > 0:
            small = np.ldexp(small, np.rint(np.log2(np.where(norm > 0, self.norm / np.where(norm > 0, norm, 1), 1))).astype(int))
        q = np.column_stack([small, np.zeros(n)])
        q_square = (q ** 2).sum(1)
        # one point more than asked, as a query's own may be among them
        best = np.full((n, k + 1), np.inf)
        seen: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]

        def distances(active, rows):
            self.compared += len(active) * len(rows)
            square = q_square[active, None] + self.square[None, rows] - 2 * q[active] @ self.points[rows].T
            return np.sqrt(np.maximum(square, 0))

        def take(active, rows, d):
            both = np.concatenate([best[active], d], axis=1)
            best[active] = np.partition(both, k, axis=1)[:, : k + 1]
            near = d <= best[active].max(1)[:, None] + self.slack
            for i in np.flatnonzero(near.any(1)):
                seen[active[i]].append((rows[near[i]], d[i, near[i]]))

        def visit(node, active):
            if not len(active):
                return
            if len(node) == 1:
                if len(node[0]):
                    take(active, node[0], distances(active, node[0]))
                return
            vantage, border, inner, outer = node
            d = distances(active, vantage)
            take(active, vantage, d)
            d = d[:, 0]
            inside = d < border
            visit(inner, active[inside])
            visit(outer, active[~inside])
            reach = factor * best[active].max(1) + self.slack
            visit(outer, active[inside & (border - d <= reach)])
            visit(inner, active[~inside & (d - border <= reach)])

        if len(self.x):
            visit(self.root, np.arange(n))
        out = []
        for i in range(n):
            rows = np.concatenate([r for r, _ in seen[i]] or [np.zeros(0, np.int64)])
            d = np.concatenate([v for _, v in seen[i]] or [np.zeros(0)])
            rows = rows[d <= best[i].max() + self.slack]
            with np.errstate(over="ignore", invalid="ignore"):
                score = (self.x[rows] * queries[i]).sum(1)
            members = [self.ids[self.first[r]: self.first[r + 1]][: k + 1] for r in rows]
            ids = np.concatenate(members) if members else np.zeros(0, np.int64)
            score = np.repeat(score, [len(m) for m in members])
            other = ids != own_ids[i]
            ids, score = ids[other], score[other]
            order = np.lexsort((ids, -score))[:k]
            out.append((ids[order], score[order]))
        return out


def _scaled(x: np.ndarray, top) -> np.ndarray:
    """``x`` times the power of two that brings ``top`` to between a half and one."""
    return np.ldexp(x, -np.frexp(top)[1])


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null in it, all finite, not all zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, id_col: str = "vec_id",
            vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``is_query`` holds:
    the ``k`` other rows (all, if fewer) with the largest inner product found.

    Rows whose vector is null, empty, zero or has null or non-finite parts
    take no part, nor do rows without an id; vectors are compared with those
    of their own length.  Rows that share an id are each other's own.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = stored(rows.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v")), "vectors")
    total = rows.count()
    shards = max(1, math.ceil(total / shard_rows), min(total // 1024, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    asked = rows.where("asks")
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    dealt = rows.select("dim", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).alias("shard"), "id", "v")

    tree_schema = "dim int, shard long, ids binary, vectors binary"

    def gather(key, table):
        x = np.asarray(table.column("v").combine_chunks().flatten(), np.float64)
        ids = np.asarray(table.column("id"), np.int64)
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int64()),
                         "ids": [ids.tobytes()], "vectors": [x.tobytes()]})

    index = stored(dealt.groupBy("dim", "shard").applyInArrow(gather, tree_schema), "vector-shards")
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.select("dim", "id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def look(key, left, right):
        found = [[], [], []]
        if left.num_rows and right.num_rows:
            dim = key[0].as_py()
            x = np.frombuffer(left.column("vectors")[0].as_py()).reshape(-1, dim)
            tree = Tree(np.frombuffer(left.column("ids")[0].as_py(), np.int64), x)
            own = np.asarray(right.column("id"), np.int64)
            q = np.asarray(right.column("v").combine_chunks().flatten(), np.float64).reshape(-1, dim)
            for at in range(0, len(own), 512):
                for query, (ids, score) in zip(own[at:at + 512], tree.search(own[at:at + 512], q[at:at + 512], k, factor)):
                    found[0].append(np.full(len(ids), query))
                    found[1].append(ids)
                    found[2].append(score)
        return pa.table([pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(found, _FOUND)], schema=_FOUND)

    keys = ["dim", "shard", "block"]
    found = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(look, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
