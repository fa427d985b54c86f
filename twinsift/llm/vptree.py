"""Nearest neighbours by one vantage-point tree per shard.

Rows are dealt to shards by a hash of their id; every shard builds a tree: a node keeps a
vantage point and the distance that halves its rows. A branch is skipped when the triangle
inequality, relaxed by `factor`, shows nothing nearer: with factor 1 the search is exact, a
larger one skips more. Every query first searches one shard, that of its own row; the distance
of its k-th find bounds the search in all others, which send only what is at least as near.
The best of all shards are merged per query. A shard is sent and its tree built once for each of
the two passes, and the queries stream through it, so a task holds one shard, which is bounded in
rows. What is repeated is the query set (a stated one), once per shard.

Defined cases: vectors that are null, zero, or hold a null or non-finite component take no
part, as query or candidate; vectors are compared with those of their own length only; rows
that repeat a vec_id count once (the smallest vector); ties go to the smaller vec_id; null
vec_id takes no part; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from twinsift.session import materialise

SHARD_ROWS = 8_192
LEAF = 64
FACTOR = 1.0
SLACK = 1e-7        # for rounding in the bounds


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=-1))


class Tree:
    """Nodes in arrays: vantage point, radius bounds of both halves, children or leaf rows."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x
        self.order = np.arange(len(x))
        self.nodes: list[tuple] = []
        stack = [(0, len(x), -1, 0)]
        while stack:
            lo, hi, parent, side = stack.pop()
            number = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][4 + side] = number
            if hi - lo <= leaf:
                self.nodes.append([-1, lo, hi, None, -1, -1])
                continue
            rows = self.order[lo:hi]
            # The row farthest from the middle sees the others at the most varied distances.
            vantage = rows[np.argmax(distances(x[rows], x[rows].mean(axis=0)))]
            far = distances(x[rows], x[vantage])
            by = np.argsort(far, kind="stable")
            self.order[lo:hi], far = rows[by], far[by]
            half = (hi - lo) // 2
            bounds = (far[0], far[half - 1], far[half], far[-1])
            self.nodes.append([vantage, lo, hi, bounds, -1, -1])
            stack.append((lo + half, hi, number, 1))
            stack.append((lo, lo + half, number, 0))

    def nearest(self, ids: np.ndarray, q: np.ndarray, own: int, k: int,
                factor: float, limit: float = math.inf) -> list[tuple[float, int]]:
        """(distance, id) of the k nearest rows, of those no farther than `limit`."""
        best: list[tuple[float, int]] = []
        stack = [(0.0, 0)]
        while stack:
            bound, number = stack.pop()
            if bound * factor > limit + SLACK:
                continue
            vantage, lo, hi, bounds, near, far = self.nodes[number]
            if vantage < 0:
                rows = self.order[lo:hi]
                d = distances(self.x[rows], q)
                keep = np.flatnonzero((d <= limit) & (ids[rows] != own))
                if len(keep):
                    best += [(float(d[i]), int(ids[rows[i]])) for i in keep]
                    best.sort()
                    del best[k:]
                    if len(best) == k:
                        limit = min(limit, best[-1][0])
                continue
            d = float(distances(self.x[vantage], q))
            children = [(max(0.0, bounds[0] - d, d - bounds[1], bound), near),
                        (max(0.0, bounds[2] - d, d - bounds[3], bound), far)]
            stack += sorted(children, reverse=True)
        return best


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and vector of the rows that take part, one per vec_id."""
    v = F.col(column)
    good = (F.col("vec_id").isNotNull() & v.isNotNull()
            & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
            & F.exists(v, lambda c: c != 0))
    return vectors.filter(good).groupBy(F.col("vec_id").cast("bigint").alias("vec_id")).agg(
        F.min(v.cast("array<double>")).alias("v"))


def visit(index: DataFrame, asked: DataFrame, k: int, factor: float) -> DataFrame:
    """query_id, vec_id and score of the nearest rows that each query finds in its shard.

    `asked` may repeat a query for several shards and has the bound of its search (`limit`).
    Of a shard, the rows arrive first; then its queries pass through the tree one by one.
    """
    columns = ["dim", "shard", "kind", "vec_id", "v", "limit"]
    rows = (index.withColumns({"kind": F.lit(0), "limit": F.lit(math.inf)}).select(*columns)
            .unionByName(asked.withColumn("kind", F.lit(1)).select(*columns))
            .repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind", "vec_id"))

    def run(batches):
        here, ids, held, tree = None, [], [], None
        for batch in batches:
            dims, shards, kinds, vec_ids, limits = (
                batch.column(n).to_numpy() for n in ("dim", "shard", "kind", "vec_id", "limit"))
            lists = batch.column("v")
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            out: list[tuple] = []
            for i in range(batch.num_rows):
                if (dims[i], shards[i]) != here:
                    here, ids, held, tree = (dims[i], shards[i]), [], [], None
                vector = values[at[i]:at[i + 1]]
                if kinds[i] == 0:
                    ids.append(vec_ids[i])
                    held.append(vector.copy())
                elif len(ids):
                    if tree is None:
                        tree, ids, held = Tree(np.stack(held)), np.array(ids), []
                    own = int(vec_ids[i])
                    out += [(own, vec, d) for d, vec in
                            tree.nearest(ids, vector, own, k, factor, float(limits[i]))]
            found = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), type=t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float64()))],
                names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, every: int = 100, k: int = 10, factor: float = FACTOR,
           column: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score (distance) of the k nearest rows of each query.

    Queries are the rows whose vec_id is divisible by `every`.
    """
    rows = materialise(usable(vectors, column).withColumn("dim", F.size("v")), "vectors")
    n_shards = max(1, math.ceil(rows.count() / shard_rows))
    index = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int"))
    queries = index.filter(F.col("vec_id") % every == 0)
    # Rows of the own shard only are of use here; the bound is that of the k-th find.
    first = materialise(visit(index, queries.withColumn("limit", F.lit(math.inf)), k, factor), "nearest")
    bounds = first.groupBy(F.col("query_id").alias("vec_id")).agg(
        F.when(F.count("*") >= k, F.max("score")).alias("limit"))
    others = F.filter(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: s != F.col("shard"))
    asked = (queries.join(bounds, "vec_id", "left").withColumn("limit", F.coalesce("limit", F.lit(math.inf)))
             .withColumn("shard", F.explode(others)))
    found = first.unionByName(visit(index, asked, k, factor))
    order = W.Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
