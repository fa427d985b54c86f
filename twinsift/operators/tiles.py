"""All vectors of a group against each other in square tiles, skipping what a bound rules out.

Vectors of a (crop, bucket) are ordered by class and, within it, by their dominant coordinate,
and packed into blocks. A block is made of segments, runs of one class with a centroid and a
radius: no vector of a segment has a larger product with x than x . centroid + |x| * radius. The
blocks of a group are dealt in order to about as many block groups as each of these holds blocks,
so n blocks are copied sqrt(n) times each, and a task holds two block groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from twinsift.session import materialise

BLOCK_ROWS = 2048
SEGMENT_ROWS = 256
GROUP_BLOCKS = 64           # most blocks of one block group
SLACK = 2e-9                # for rounding in bounds; more than the decimals that ties are decided on
DENSE = 0.5                 # share of (vector, segment) pairs from which a block is multiplied whole
SELF = -1.0                 # similarity given to an image and itself

PACKED = ("crop string, bucket string, number long, classes array<string>, imgs array<string>, "
          "codes binary, vecs binary")


class Block:
    """Vectors with ids and dictionary-coded classes; segments with centroids and radii."""

    def __init__(self, imgs: pa.Array, classes: list, codes: np.ndarray, vecs: np.ndarray, number: int,
                 segment_rows: int):
        self.imgs, self.classes, self.codes, self.number = imgs, classes, codes, number
        self.v = vecs.astype(np.float64)
        self.norm = np.sqrt((self.v ** 2).sum(axis=1))
        n = len(codes)
        # Places of each row in its run of equal codes; a segment starts every `segment_rows` of them.
        start = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        place = np.arange(n) - np.repeat(start, np.diff(np.r_[start, n]))
        self.lo = np.flatnonzero(place % segment_rows == 0)
        self.hi = np.r_[self.lo[1:], n]
        self.segment_class = codes[self.lo]
        size = (self.hi - self.lo)[:, None]
        self.centroid = np.add.reduceat(self.v, self.lo, axis=0) / size
        away = np.sqrt(((self.v - np.repeat(self.centroid, size[:, 0], axis=0)) ** 2).sum(axis=1))
        self.radius = np.maximum.reduceat(away, self.lo)
        self.class_start = np.flatnonzero(np.r_[True, self.segment_class[1:] != self.segment_class[:-1]])

    def __len__(self) -> int:
        return len(self.codes)

    def bounds(self, other: "Block") -> np.ndarray:
        """Largest product each vector can have with each segment of `other`."""
        return self.v @ other.centroid.T + self.norm[:, None] * other.radius + SLACK

    def products(self, other: "Block", rows: np.ndarray | slice, lo: int, hi: int) -> np.ndarray:
        """Products of some rows with a range of `other`; a vector and itself get SELF."""
        sims = self.v[rows] @ other.v[lo:hi].T
        if self.number == other.number:
            at = np.arange(len(self))[rows]
            own = np.flatnonzero((at >= lo) & (at < hi))
            sims[own, at[own] - lo] = SELF
        return sims


def class_maxima(x: Block, y: Block, held: dict[str, np.ndarray], counts: dict[str, int]) -> dict[str, np.ndarray]:
    """Best product of each vector of x with each class of y, given the best so far (`held`).

    The segment with the best bound comes first, per vector and class; of the others those are
    opened that can still beat the maximum.
    """
    best = np.stack([held.get(c, np.full(len(x), -np.inf)) for c in y.classes], axis=1)
    bounds = x.bounds(y)
    top = np.maximum.reduceat(bounds, y.class_start, axis=1)

    def open_(mask: np.ndarray) -> None:
        counts["opened"] += int(mask.sum())
        if mask.mean() > DENSE:
            counts["opened"] += int((~mask).sum())
            segment = np.maximum.reduceat(x.products(y, slice(None), 0, len(y)), y.lo, axis=1)
            np.maximum(best, np.maximum.reduceat(segment, y.class_start, axis=1), out=best)
            mask[:] = True
            return
        for s in np.flatnonzero(mask.any(axis=0)):
            rows, c = np.flatnonzero(mask[:, s]), y.segment_class[s]
            found = x.products(y, rows, y.lo[s], y.hi[s]).max(axis=1)
            best[rows, c] = np.maximum(best[rows, c], found)

    lead = (bounds >= top[:, y.segment_class]) & (bounds > best[:, y.segment_class])
    open_(lead)
    rest = (bounds > best[:, y.segment_class]) & ~lead
    if rest.any():
        open_(rest)
    counts["all"] += bounds.size
    return {c: best[:, i] for i, c in enumerate(y.classes)}


def packed_blocks(emb: DataFrame, by_class: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of each (crop, bucket) in order; `by_class=False` orders by dominant coordinate alone."""
    size = F.transform("embedding", F.abs)
    place = F.array_position(size, F.array_max(size))
    code = F.when(F.element_at("embedding", place.cast("int")) < 0, -place).otherwise(place)
    keys = ["crop", "bucket", *(["disease"] if by_class else []), "code", "img"]
    rows = (emb.select("crop", "bucket", "disease", "img", "embedding", code.alias("code"))
            .repartitionByRange(*keys).sortWithinPartitions(*keys))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        parts: list[pa.RecordBatch] = []        # rows of the block that is not full yet

        def packed() -> pa.RecordBatch:
            nonlocal number
            t = pa.Table.from_batches(parts).combine_chunks()
            parts.clear()
            classes = t["disease"].combine_chunks().dictionary_encode()
            vecs = t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            number += 1
            codes = classes.indices.to_numpy().astype(np.int32)
            if not by_class:
                codes = np.zeros_like(codes)
            return pa.RecordBatch.from_arrays(
                [t["crop"].combine_chunks()[:1], t["bucket"].combine_chunks()[:1], pa.array([number], pa.int64()),
                 pa.array([classes.dictionary.to_pylist()], pa.list_(pa.string())),
                 pa.array([t["img"].to_pylist()], pa.list_(pa.string())), pa.array([codes.tobytes()], pa.binary()),
                 pa.array([vecs.astype(np.float64).tobytes()], pa.binary())],
                names=["crop", "bucket", "number", "classes", "imgs", "codes", "vecs"])

        group, held = None, 0
        for batch in batches:
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            at = 0
            while at < len(names):
                if names[at] != group or held == block_rows:
                    if held:
                        yield packed()
                    group, held = names[at], 0
                end = at
                while end < len(names) and names[end] == group and held + end - at < block_rows:
                    end += 1
                parts.append(batch.slice(at, end - at))
                held += end - at
                at = end
        if held:
            yield packed()

    return rows.mapInArrow(pack, PACKED)


def tiles(blocks: DataFrame) -> DataFrame:
    """Copies of the blocks keyed by unordered pairs (a, b) of block groups, sorted by key and number.

    `grp` is the block group of the row.
    """
    keys = ["crop", "bucket"]
    group = W.Window.partitionBy(*keys)
    at, n = F.row_number().over(group.orderBy("number")) - 1, F.count("*").over(group)
    width = F.greatest(F.ceil(F.sqrt(n)), F.ceil(n / GROUP_BLOCKS))
    places = blocks.select(*keys, "number").withColumns({"grp": F.floor(at * width / n).cast("int"),
                                                         "width": width.cast("int")})
    other = F.explode(F.sequence(F.lit(0), F.col("width") - 1))
    copies = (places.withColumn("other", other)
              .select(*keys, "number", "grp", F.least("grp", "other").alias("a"), F.greatest("grp", "other").alias("b")))
    tile = [*keys, "a", "b"]
    return (blocks.join(copies, [*keys, "number"]).repartition(*tile).sortWithinPartitions(*tile, "number"))


def read_tiles(batches: Iterator[pa.RecordBatch], segment_rows: int) -> Iterator[tuple]:
    """(crop, bucket, [(x blocks, y blocks), ...]) of each tile: both directions, or one where a = b."""
    tile, held = None, ([], [])

    def directions() -> list[tuple]:
        a, b = held
        return [(a, b), (b, a)] if tile[2] != tile[3] else [(a, a)]

    for batch in batches:
        col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            here = tuple(col[c][i].as_py() for c in ("crop", "bucket", "a", "b"))
            if here != tile:
                if tile:
                    yield tile[0], tile[1], directions()
                tile, held = here, ([], [])
            codes = np.frombuffer(col["codes"][i].as_buffer(), dtype=np.int32)
            vecs = np.frombuffer(col["vecs"][i].as_buffer(), dtype=np.float64).reshape(len(codes), -1)
            block = Block(col["imgs"][i].values, col["classes"][i].as_py(), codes, vecs,
                          col["number"][i].as_py(), segment_rows)
            held[0 if col["grp"][i].as_py() == here[2] else 1].append(block)
    if tile:
        yield tile[0], tile[1], directions()


def constant(value: str, n: int) -> pa.Array:
    return pa.DictionaryArray.from_arrays(np.zeros(n, dtype=np.int32), pa.array([value], pa.string())).cast(pa.string())


BEST_SCHEMA = "crop string, bucket string, img string, disease string, other string, best double"


def best_by_class(emb: DataFrame, decimals: int, block_rows: int = BLOCK_ROWS,
                  segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Columns of BEST_SCHEMA: the best similarity of every image to every class of its (crop, bucket)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {"opened": 0, "all": 0}
        for crop, bucket, pairs in read_tiles(batches, segment_rows):
            def rows_of(x: Block, found: dict[str, np.ndarray]) -> pa.RecordBatch:
                n, k = len(x), len(found)
                own = pa.DictionaryArray.from_arrays(np.repeat(x.codes, k), pa.array(x.classes, pa.string()))
                other = pa.DictionaryArray.from_arrays(np.tile(np.arange(k, dtype=np.int32), n),
                                                       pa.array(list(found), pa.string()))
                best = np.round(np.stack(list(found.values()), axis=1), decimals)
                return pa.RecordBatch.from_arrays(
                    [constant(crop, n * k), constant(bucket, n * k), x.imgs.take(pa.array(np.repeat(np.arange(n), k))),
                     own.cast(pa.string()), other.cast(pa.string()), pa.array(best.ravel())],
                    names=["crop", "bucket", "img", "disease", "other", "best"])

            for xs, ys in pairs:
                for x in xs:
                    held: dict[str, np.ndarray] = {}
                    for y in ys:                                # in order of class: a class ends where it is not held on
                        done = {c: m for c, m in held.items() if c not in y.classes}
                        if done:
                            yield rows_of(x, done)
                        held = class_maxima(x, y, held, counts)
                    yield rows_of(x, held)

    blocks = materialise(packed_blocks(emb, True, block_rows), "blocks")
    return (tiles(blocks).mapInArrow(run, BEST_SCHEMA)
            .groupBy("crop", "bucket", "img", "disease", "other").agg(F.max("best").alias("best")))


def best_others(emb: DataFrame, k: int, decimals: int, block_rows: int = BLOCK_ROWS,
                segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """img, found, score: at least the k best other images of each image, ties by smaller id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, pairs in read_tiles(batches, segment_rows):
            for xs, ys in pairs:
                for x in xs:
                    row, sim, name = (np.empty(0, dtype=d) for d in (np.int64, np.float64, object))
                    kth = np.full(len(x), -np.inf)
                    for y in ys:
                        bounds, names = x.bounds(y), np.array(y.imgs.to_pylist(), dtype=object)
                        for s in range(len(y.lo)):
                            rows = np.flatnonzero(bounds[:, s] >= kth)      # equals stay: ties go by id
                            if not len(rows):
                                continue
                            lo, hi = y.lo[s], y.hi[s]
                            sims = np.round(x.products(y, rows, lo, hi), decimals)
                            if x.number == y.number:
                                inside = np.flatnonzero((rows >= lo) & (rows < hi))
                                sims[inside, rows[inside] - lo] = -np.inf
                            least = kth[rows]
                            if hi - lo > k:
                                least = np.maximum(least, np.partition(sims, hi - lo - k, axis=1)[:, hi - lo - k])
                            r, c = np.nonzero((sims >= least[:, None]) & (sims > -np.inf))
                            row = np.concatenate([row, rows[r]])
                            sim = np.concatenate([sim, sims[r, c]])
                            name = np.concatenate([name, names[lo + c]])
                            order = np.lexsort((name, -sim, row))
                            row, sim, name = row[order], sim[order], name[order]
                            start = np.searchsorted(row, np.arange(len(x)))
                            place = np.arange(len(row)) - start[row]
                            row, sim, name = row[place < k], sim[place < k], name[place < k]
                            last = place[place < k] == k - 1
                            kth[row[last]] = sim[last]
                    yield pa.RecordBatch.from_arrays(
                        [x.imgs.take(pa.array(row)), pa.array(name.tolist(), pa.string()), pa.array(sim)],
                        names=["img", "found", "score"])

    blocks = materialise(packed_blocks(emb, False, block_rows), "blocks")
    return tiles(blocks).mapInArrow(run, "img string, found string, score double")
