"""Centroid clustering in whole numbers, with a vantage-point tree over the centroids.

Every round builds the tree over the current centroids (k vectors, so its size is bounded by
k * dim) and broadcasts it. A vector opens the nodes of the tree best bound first; a node is
closed only when its bound lies beyond the best distance found, so that nodes at exactly that
distance are opened and a tie goes to the smaller centroid number. Distances at the leaves are
exact integers. Each task returns one row per centroid with the sums of its vectors, so a
centroid with most of the rows costs no more than any other.

Defined cases: vectors that are null, have another number of components, or hold a null or
non-finite component take no part, nor do those with a component of 2^27 or more after scaling,
whose squared distances would not fit a long. Repeated rows count as often as they stand; among
the first centroids, rows of equal hash are ordered by their vectors, null ids come last. With
fewer than k vectors there are fewer centroids; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.session import materialise

LEAF = 2
LARGEST = float(2 ** 27)
SLACK = 1e-9        # relative, for rounding in the bounds; distances themselves are exact
CHUNK = 4096


def usable(vectors: DataFrame, dim: int, scale: int, column: str = "embedding") -> DataFrame:
    """vec_id and v (whole numbers) of the rows that take part."""
    v = F.col(column)
    # Not a number counts as larger than any number, so the comparison leaves it out as well.
    whole = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double") * scale) < LARGEST, F.lit(False)))
    good = v.isNotNull() & (F.size(v) == dim) & whole
    return vectors.filter(good).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"))


class CentroidTree:
    """Vantage-point tree over the rows of `centroids`: a node has a vantage centroid, and the
    least and greatest distance from it to the centroids of either half."""

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF):
        self.c = centroids
        self.nodes: list[dict] = []
        stack = [(np.arange(len(centroids)), None, None)]
        while stack:
            rows, parent, side = stack.pop()
            if parent is not None:
                self.nodes[parent][side]["node"] = len(self.nodes)
            if len(rows) <= leaf:
                self.nodes.append({"rows": rows})
                continue
            # The centroid farthest from the first one sees the others at the most varied distances.
            vantage = rows[np.argmax(self.squared(self.c[rows], rows[0]))]
            far = np.sqrt(self.squared(self.c[rows], vantage).astype(np.float64))
            order = np.argsort(far, kind="stable")
            rows, far, half = rows[order], far[order], len(rows) // 2
            self.nodes.append({"vantage": vantage,
                               "near": {"lo": far[0], "hi": far[half - 1]},
                               "far": {"lo": far[half], "hi": far[-1]}})
            stack.append((rows[half:], len(self.nodes) - 1, "far"))
            stack.append((rows[:half], len(self.nodes) - 1, "near"))

    def squared(self, x: np.ndarray, number: int) -> np.ndarray:
        """Exact squared distances of the rows of x to one centroid."""
        d = x - self.c[number]
        return np.einsum("ij,ij->i", d, d)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each row's nearest centroid, and the distances taken.

        Every vector keeps a bound per open node and opens its own best one; vectors that open
        the same node in a step are handled together.
        """
        n = len(x)
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, -1)
        bounds = np.full((n, len(self.nodes)), np.inf)
        bounds[:, 0] = 0.0
        radius = np.full(n, np.inf)
        taken = 0
        active = np.arange(n)
        while len(active):
            node_of = bounds[active].argmin(axis=1)
            bound = bounds[active, node_of]
            open_ = bound <= radius[active]             # inclusive: equals are opened
            active, node_of, bound = active[open_], node_of[open_], bound[open_]
            for k in np.unique(node_of):
                rows, low, node = active[node_of == k], bound[node_of == k], self.nodes[k]
                bounds[rows, k] = np.inf
                for c in node.get("rows", [node.get("vantage")]):
                    d = self.squared(x[rows], c)
                    taken += len(rows)
                    better = (d < best[rows]) | ((d == best[rows]) & (c < number[rows]))
                    best[rows[better]], number[rows[better]] = d[better], c
                radius[rows] = np.sqrt(best[rows].astype(np.float64)) * (1 + SLACK)
                if "vantage" in node:
                    at = np.sqrt(d.astype(np.float64))
                    for half in (node["near"], node["far"]):
                        gap = np.maximum(half["lo"] - at, at - half["hi"]) - SLACK * (half["hi"] + at)
                        bounds[rows, half["node"]] = np.maximum(np.maximum(gap, low), 0.0)
        return number, best, taken


def _chunks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            piece = batch.slice(at, CHUNK)
            flat = piece.column(1).flatten().to_numpy(zero_copy_only=False)
            yield piece.column(0), flat.reshape(-1, dim).astype(np.int64)


def first_centroids(rows: DataFrame, k: int) -> list[list[int]]:
    """The k rows of smallest hash of `1:<vec_id>`, in hash order."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    found = rows.select("v", key.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k)
    return [r["v"] for r in found.collect()]


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: exact floored means of their vectors; empty ones stay."""
    dim = len(centroids[0])
    tree = rows.sparkSession.sparkContext.broadcast(CentroidTree(np.array(centroids, dtype=np.int64)))
    k = len(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for _, x in _chunks(batches, dim):
            number, _, _ = tree.value.nearest(x)
            for c in np.unique(number):
                total[c] += x[number == c].sum(axis=0)
                count[c] += (number == c).sum()
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.array(count[held], pa.int64()),
             *[pa.array(total[held, i], pa.int64()) for i in range(dim)]],
            names=["cluster", "n", *[f"s{i}" for i in range(dim)]])

    schema = "cluster int, n long, " + ", ".join(f"s{i} long" for i in range(dim))
    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *[f"s{i}" for i in range(dim)])]
    out = [list(c) for c in centroids]
    for r in rows.mapInArrow(sums, schema).groupBy("cluster").agg(*whole).collect():      # at most k rows
        out[r["cluster"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(dim)]
    tree.unpersist()
    return out


def assigned(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster and squared distance of every row."""
    dim = len(centroids[0])
    tree = rows.sparkSession.sparkContext.broadcast(CentroidTree(np.array(centroids, dtype=np.int64)))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _chunks(batches, dim):
            number, distance, _ = tree.value.nearest(x)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(number, pa.int32()), pa.array(distance, pa.int64())],
                names=["vec_id", "cluster", "distance"])

    return rows.mapInArrow(nearest, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64,
            column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector.

    The vectors are read again in every round instead of being copied: a round is one pass
    without a shuffle of rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, dim, scale, column)
    centroids = first_centroids(rows, k)
    kept = "vec_id long, cluster int, distance long"
    if not centroids:
        return spark.createDataFrame([], kept + ", cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    found = materialise(assigned(rows, centroids), "clusters")
    per = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}        # at most k rows
    facts = spark.createDataFrame(
        [(i, per[i], sum(per.values()), hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest())
         for i in per], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row per centroid, so at most k rows are broadcast.
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> str:
    """The same rows in SQL: every vector against every centroid."""
    near = ("SELECT v.row, v.vec_id, v.x, min_by(c.cluster, (d, c.cluster)) AS cluster, min(d) AS distance "
            "FROM v CROSS JOIN {c} AS c, LATERAL (SELECT list_sum(list_transform(list_zip(v.x, c.x), "
            "lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d) AS far GROUP BY ALL")
    steps = [f"""v AS (SELECT row_number() OVER () AS row, vec_id,
            list_transform(embedding, lambda y: floor({scale} * y::DOUBLE)::BIGINT) AS x FROM embeddings
        WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {dim}
          AND list_max(list_transform(embedding, lambda y: abs({scale} * y::DOUBLE))) < {int(LARGEST)}),
    c0 AS (SELECT (row_number() OVER (ORDER BY h NULLS LAST, x) - 1)::INTEGER AS cluster, x
        FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {k}))"""]
    for r in range(rounds):
        steps.append(f"""a{r} AS ({near.format(c=f'c{r}')}),
    m{r} AS (SELECT cluster, list(m ORDER BY i) AS x FROM (
            SELECT cluster, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m
            FROM a{r} CROSS JOIN range(1, {dim + 1}) AS t(i) GROUP BY cluster, i) GROUP BY cluster),
    c{r + 1} AS (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} AS c LEFT JOIN m{r} AS m USING (cluster))""")
    return "WITH " + ",\n    ".join(steps) + f""",
    final AS ({near.format(c=f'c{rounds}')})
    SELECT vec_id, f.cluster, distance,
        (sum(distance) OVER (PARTITION BY f.cluster))::BIGINT AS cluster_inertia,
        (sum(distance) OVER ())::BIGINT AS inertia,
        sha256(array_to_string(c.x, ',')) AS centroid_sha256
    FROM final AS f JOIN c{rounds} AS c ON c.cluster = f.cluster"""


SQL = sql()
