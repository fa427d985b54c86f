"""Exact largest inner products by retrieval from length buckets.

Candidates are ordered by length and packed into buckets of vectors of nearly equal length. A
task holds some of the queries and lets its buckets pass, longest first. The k-th best score a
query has so far, over its length and that of the bucket's longest vector, is the cosine that
a vector of this bucket must reach: the local threshold.

* Above one: the bucket is skipped for that query.
* Where the live queries' thresholds are high in the middle, the bucket is pruned by coordinate:
  a query's largest coordinates each allow a range, found in the bucket's sorted lists, and what
  lies in the narrowest range is bounded by these coordinates and the lengths of the rest.
* Else by length: only the bucket's vectors that are long enough for the query.

What is left is verified with exact whole-number products. Bounds have room for rounding and
are strict, so ties are never cut off.

What is copied: every bucket once per block of queries (a stated query set), every query once
per group of buckets. A task holds one block of queries and one bucket, whatever the size of
the group. Of equal vectors that lie together, only the k + 1 smallest ids are kept: the others
cannot be among the k best of any query.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor
do those with a component of 2^26 or more after scaling, whose products would not fit a long; zero
and empty vectors do; vectors are compared with those of their own length only; rows that repeat
a vec_id count once (the smallest vector); null ids take no part; ties go to the smaller
vec_id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from twinsift.session import materialise

BUCKET_ROWS = 4_096
QUERY_ROWS = 8_192          # queries of a task
QUERY_PIECE = 256           # queries multiplied at a time
GROUP_BUCKETS = 256         # buckets of a task
PARTITION_ROWS = 65_536     # rows sorted in a task
LARGEST = float(2 ** 26)
COORDINATE_FROM = 0.85      # median local threshold from which a bucket is pruned by coordinate
FOCUS = 4                   # coordinates looked at
SLACK = 1e-9
NONE = np.iinfo(np.int64).min

PACKED = "dim int, number long, n int, top double, ids binary, v binary"
FOUND = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, scale: int, column: str = "embedding") -> DataFrame:
    """vec_id, v (whole numbers), dim and squared length of the rows that take part, one per vec_id."""
    v = F.col(column)
    # Not a number counts as larger than any number, so the comparison leaves it out as well.
    whole = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double") * scale) < LARGEST, F.lit(False)))
    rows = (vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull() & whole)
            .groupBy(F.col("vec_id").cast("bigint").alias("vec_id"))
            .agg(F.min(v.cast("array<double>")).alias("v")))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("v")).select(
        "vec_id", "v", F.size("v").alias("dim"),
        F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("squares"))


def _pack(rows_each: int, copies: int | None):
    """Sorted rows (dim, squares, vec_id, v) to packed rows of one dim and up to `rows_each` vectors.

    `copies`: of equal vectors that follow each other, only so many are kept.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        ids, vs, dim, last, seen = [], [], None, None, 0

        def packed() -> pa.RecordBatch:
            v = np.array(vs, dtype=np.int32).reshape(len(ids), dim)
            top = math.sqrt((v[0].astype(np.float64) ** 2).sum())
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([number], pa.int64()), pa.array([len(ids)], pa.int32()),
                 pa.array([top]), pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()),
                 pa.array([v.tobytes()], pa.binary())],
                names=["dim", "number", "n", "top", "ids", "v"])

        for batch in batches:
            for d, vec_id, values in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                v = values.values.to_numpy(zero_copy_only=False)
                if ids and (d != dim or len(ids) == rows_each):
                    yield packed()
                    ids, vs = [], []
                    number += 1
                seen = seen + 1 if last is not None and d == dim and np.array_equal(v, last) else 1
                dim, last = d, v
                if copies is None or seen <= copies:
                    ids.append(vec_id)
                    vs.append(v)
        if ids:
            yield packed()

    return run


def packed_rows(rows: DataFrame, rows_each: int, copies: int | None = None) -> DataFrame:
    """Packed rows in order of length, longest first; equal vectors lie together."""
    parts = max(1, math.ceil(rows.count() / PARTITION_ROWS))
    order = [F.col("dim"), F.col("squares").desc(), F.xxhash64("v"), F.col("vec_id")]
    return (rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .select("dim", "squares", "vec_id", "v").mapInArrow(_pack(rows_each, copies), PACKED))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of the rows of two whole-number matrices."""
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))


class Bucket:
    """Vectors by falling length, with sorted lists of their normalised coordinates when asked for."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v, self.length = ids, v, lengths(v)
        self.unit = self.order = self.sorted = None

    def lists(self) -> None:
        if self.unit is None:
            self.unit = self.v / np.where(self.length > 0, self.length, 1.0)[:, None]
            self.order = np.argsort(self.unit, axis=0)
            self.sorted = np.take_along_axis(self.unit, self.order, axis=0)

    def by_coordinate(self, q: np.ndarray, t: float) -> np.ndarray:
        """Rows that may have cosine t (above 0) or more with the unit vector q."""
        self.lists()
        focus = np.argsort(-np.abs(q))[:FOCUS]
        half = np.sqrt(np.maximum((1 - q[focus] ** 2) * (1 - t * t), 0.0)) + SLACK
        ranges = [(np.searchsorted(self.sorted[:, f], t * q[f] - h), np.searchsorted(self.sorted[:, f], t * q[f] + h, "right"))
                  for f, h in zip(focus, half)]
        lo, hi = min(ranges, key=lambda r: r[1] - r[0])
        rows = self.order[lo:hi, focus[ranges.index((lo, hi))]]
        part = self.unit[np.ix_(rows, focus)]
        rest = math.sqrt(max(0.0, 1 - float((q[focus] ** 2).sum())))
        bound = part @ q[focus] + rest * np.sqrt(np.maximum(1 - (part ** 2).sum(axis=1), 0.0))
        return rows[bound >= t - SLACK]


class Search:
    """The k best of a block of queries over the buckets seen so far."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, v, k
        self.length = lengths(v)
        self.unit = v / np.where(self.length > 0, self.length, 1.0)[:, None]
        self.score = np.full((len(ids), k), NONE)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.used = {"skipped": 0, "coordinate": 0, "length": 0, "verified": 0}

    def visit(self, bucket: Bucket) -> None:
        least = self.score[:, -1]                                   # k-th best so far, or NONE
        reach = self.length * bucket.length[0] * (1 + SLACK)
        live = np.flatnonzero((least == NONE) | (reach >= least))
        self.used["skipped"] += len(self.ids) - len(live)
        if not len(live):
            return
        t = np.where((least[live] > 0) & (reach[live] > 0), least[live] / np.maximum(reach[live], 1e-300), -1.0)
        if np.median(t) >= COORDINATE_FROM:
            self.used["coordinate"] += len(live)
            self._coordinates(bucket, live, np.minimum(t, 1.0))
        else:
            self.used["length"] += len(live)
            for at in range(0, len(live), QUERY_PIECE):
                self._prefix(bucket, live[at:at + QUERY_PIECE])

    def _coordinates(self, bucket: Bucket, live: np.ndarray, t: np.ndarray) -> None:
        for q, threshold in zip(live, t):
            if threshold <= 0:
                self._prefix(bucket, np.array([q]))
                continue
            rows = bucket.by_coordinate(self.unit[q], threshold)
            self.used["verified"] += len(rows)
            score = products(self.v[q:q + 1], bucket.v[rows])[0]
            keep = (score >= self.score[q, -1]) & (bucket.ids[rows] != self.ids[q])
            self._merge(np.full(keep.sum(), q), score[keep], bucket.ids[rows][keep])

    def _prefix(self, bucket: Bucket, queries: np.ndarray) -> None:
        least = self.score[queries, -1]
        # Vectors shorter than this cannot reach the k-th best; at 0 or below any length may.
        shortest = np.where(least > 0, least / np.maximum(self.length[queries], 1e-300) * (1 - SLACK), 0.0)
        n = np.searchsorted(-bucket.length, -shortest.min(), "right")
        score = products(self.v[queries], bucket.v[:n])
        self.used["verified"] += score.size
        score[self.ids[queries][:, None] == bucket.ids[None, :n]] = NONE
        floor = least
        if n > self.k:
            floor = np.maximum(floor, np.partition(score, n - self.k, axis=1)[:, n - self.k])
        row, col = np.nonzero((score >= floor[:, None]) & (score != NONE))
        self._merge(queries[row], score[row, col], bucket.ids[col])

    def _merge(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        touched = np.unique(query)
        query = np.concatenate([query, np.repeat(touched, self.k)])
        score = np.concatenate([score, self.score[touched].ravel()])
        ids = np.concatenate([ids, self.found[touched].ravel()])
        order = np.lexsort((ids, ~score, query))        # ~score falls as score rises, without overflow
        query, score, ids = query[order], score[order], ids[order]
        starts = np.searchsorted(query, touched)
        rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        keep = rank < self.k
        self.score[query[keep], rank[keep]] = score[keep]
        self.found[query[keep], rank[keep]] = ids[keep]

    def rows(self) -> pa.RecordBatch:
        row, col = np.nonzero(self.score != NONE)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[row]), pa.array(self.found[row, col]), pa.array(self.score[row, col])],
            names=["query_id", "vec_id", "score"])


def _matrix(ids: pa.Scalar, v: pa.Scalar, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids.as_buffer(), dtype=np.int64)
    return ids, np.frombuffer(v.as_buffer(), dtype=np.int32).reshape(len(ids), dim)


def _tiles(k: int):
    """Rows sorted by (dim, part, piece, kind, top falling): queries of a tile, then its buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, search, parts = None, None, []
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                dim = col["dim"][i].as_py()
                here = (dim, col["part"][i].as_py(), col["piece"][i].as_py())
                ids, v = _matrix(col["ids"][i], col["v"][i], dim)
                if here != tile:
                    if search:
                        yield search.rows()
                    tile, search, parts = here, None, []
                if col["kind"][i].as_py() == 0:
                    parts.append((ids.copy(), v.copy()))
                    continue
                if parts:
                    search = Search(*(np.concatenate(x) for x in zip(*parts)), k)
                    parts = []
                if search:
                    search.visit(Bucket(ids, v))
        if search:
            yield search.rows()

    return run


def top_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256,
                 column: str = "embedding", bucket_rows: int = BUCKET_ROWS,
                 query_rows: int = QUERY_ROWS, groups: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k largest products of each query, ties to smaller ids.

    Queries are the rows whose vec_id is divisible by `every`, candidates all rows but their own.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors, scale, column), "whole-vectors")
    buckets = materialise(packed_rows(rows, bucket_rows, copies=k + 1), "buckets")
    asked = materialise(packed_rows(rows.filter(F.col("vec_id") % every == 0), min(query_rows, 1024)), "queries")
    n_buckets, n_asked = buckets.count(), asked.agg(F.sum("n")).first()[0] or 0
    pieces = max(1, math.ceil(n_asked / query_rows))
    if groups is None:
        groups = max(math.ceil(n_buckets / GROUP_BUCKETS),
                     min(n_buckets, math.ceil(spark.sparkContext.defaultParallelism / pieces)), 1)
    held = buckets.withColumn("part", F.pmod("number", F.lit(groups)).cast("int")).withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))).withColumn("kind", F.lit(1))
    queries = asked.withColumn("piece", F.pmod("number", F.lit(pieces)).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("kind", F.lit(0))
    tile = ["dim", "part", "piece"]
    found = (queries.unionByName(held).repartition(groups * pieces, *tile)
             .sortWithinPartitions(*tile, "kind", F.col("top").desc(), "number")
             .mapInArrow(_tiles(k), FOUND))
    best = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


#: Every query against every row.
SQL = f"""
WITH good AS (
    SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y)
                                            OR abs(256 * y::DOUBLE) >= {int(LARGEST)})) = 0
    GROUP BY vec_id),
v AS (SELECT vec_id, list_transform(e, lambda y: floor(256 * y)::BIGINT) AS x FROM good),
pairs AS (
    SELECT q.vec_id AS query_id, v.vec_id,
        coalesce(list_sum(list_transform(list_zip(q.x, v.x), lambda z: z[1] * z[2])), 0)::BIGINT AS score
    FROM v AS q JOIN v ON len(q.x) = len(v.x) AND q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
        vec_id, score FROM pairs)
SELECT * FROM ranked WHERE rank <= 5"""
