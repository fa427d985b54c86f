"""The trie of all prefixes of conversations, built from sorted shards and a splitter skeleton.

A turn is a unit of 20 bytes (hash of role and text, code points of the text), a conversation
the string of its units. Equal strings are counted once and range-partitioned, so every subtree
lies in neighbouring shards. Only a node on the path that two neighbouring shards share can lie
in more than one: the trie of these paths, the skeleton, is broadcast. A task walks its shard
in order with a stack of open nodes and finishes every node outside the skeleton; of a skeleton
node it returns partial sums, which one aggregation by node adds up.

What is bounded: the driver sees two paths per shard, the broadcast holds at most one path per
shard, a row holds at most `segment` turns. Longer conversations are cut into segments: what
follows a segment is a trie of its own below the node that the segment ends in, and the tries are
joined level by level. Ids that end in one node are hashed as a stream over chunks of ids.

Defined cases: rows with a null conv_id take no part; null role and text are empty; turns of
equal number are ordered by the hash of role and text; repeated rows are turns of their own;
`conv_id % 100` keeps the sign of conv_id; an empty table gives no rows; other columns are not
read. Turns are told apart by their 128-bit hash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.operators.skew import row_number_in_group
from twinsift.session import materialise

UNIT = 20
SEGMENT = 512               # turns of one path row
SHARD_BYTES = 16 << 20      # path bytes of one shard
CHUNK_IDS = 4096            # conversation ids of one chunk
PIECE_ROWS = 1000
TOP = b"\0" * UNIT
NO_ENDS = hashlib.sha256(b"").hexdigest()
HEAD = 6                    # heads have fewer turns than this

ROWS = ("skel int, pskel int, depth int, p binary, top_conv long, conv_id long, parent_conv_id long, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
NAMES = [c.split()[0] for c in ROWS.split(", ")]
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def unit() -> Column:
    """Hash of (role, text), then the code points of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    n = F.char_length(text)
    whole = F.concat_ws(":", F.char_length(role).cast("string"), role, text)
    return F.concat(F.unhex(F.md5(whole)), F.unhex(F.lpad(F.hex(n), 8, "0")))


def node_id(key: Column) -> Column:
    return F.concat(F.unhex(F.md5(key)), F.lit(bytearray(4)))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1) and unit of every turn; a conversation with most turns is split by ranges."""
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", unit().alias("unit"))
    order = [F.col("turn").asc_nulls_first(), F.col("unit")]
    ranged = materialise(rows.repartitionByRange("conv_id", *order)
                         .withColumn("range", F.spark_partition_id()), "turns")
    return row_number_in_group(ranged, ["conv_id"], F.col("range"), order, "pos").select("conv_id", "pos", "unit")


def rebuilt(turns: DataFrame, segment: int) -> DataFrame:
    """conv_id, seg, path and n_segs of the rebuilt conversations, a row per segment.

    The head of conversation c - c % 100 replaces the conversation's own head of
    crc32(c) % 6 turns.
    """
    base = F.col("conv_id") - F.col("conv_id") % 100
    heads = (turns.filter((F.col("conv_id") % 100 == 0) & (F.col("pos") < HEAD)).groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("pos", "unit"))).alias("head"))      # at most HEAD - 1 turns
             .select(F.col("conv_id").alias("base"), F.col("head.unit").alias("head")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    empty = F.array().cast("array<binary>")
    convs = (turns.groupBy("conv_id").agg(F.count("*").alias("n_own"))
             .withColumn("base", base).withColumn("h", h).join(heads, "base", "left")
             .withColumn("head", F.slice(F.coalesce("head", empty), F.lit(1), F.col("h")))
             .withColumn("n_head", F.size("head"))
             .withColumn("n", F.col("n_head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0)))
             .select("conv_id", "h", "head", "n_head",
                     F.greatest(F.ceil(F.col("n") / segment), F.lit(1)).cast("int").alias("n_segs")))
    convs = materialise(convs, "conversations")
    first = convs.select("conv_id", F.posexplode("head").alias("pos", "unit")).withColumn(
        "pos", F.col("pos").cast("bigint"))
    rest = (turns.join(convs.select("conv_id", "h", "n_head"), "conv_id").filter(F.col("pos") > F.col("h"))
            .select("conv_id", (F.col("n_head") + F.col("pos") - F.col("h") - 1).alias("pos"), "unit"))
    paths = (first.unionByName(rest).withColumn("seg", F.floor(F.col("pos") / segment).cast("int"))
             .groupBy("conv_id", "seg")                                                     # at most `segment` turns
             .agg(F.sort_array(F.collect_list(F.struct("pos", "unit"))).alias("u"))
             .select("conv_id", "seg", F.unhex(F.array_join(
                 F.transform("u.unit", lambda x: F.hex(x)), "")).alias("path")))
    empty_path = F.lit(bytearray())
    return (convs.select("conv_id", "n_segs").join(paths, "conv_id", "left")
            .select("conv_id", F.coalesce("seg", F.lit(0)).alias("seg"),
                    F.coalesce("path", empty_path).alias("path"), "n_segs"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (pid, conv_id) to rows of up to CHUNK_IDS ids of one pid."""
    pid, ids, out = None, [], []

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.string()))],
            names=["pid", "first", "ids"])

    for batch in batches:
        for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (p != pid or len(ids) == CHUNK_IDS):
                out.append((pid, ids[0], ",".join(map(str, ids))))
                ids = []
            pid = p
            ids.append(c)
        if len(out) >= PIECE_ROWS:
            yield batch_of(out)
            out = []
    if ids:
        out.append((pid, ids[0], ",".join(map(str, ids))))
    if out:
        yield batch_of(out)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (pid, first) to one SHA-256 per pid; only the state of the hash is held."""
    pid, sha = None, None
    for batch in batches:
        out = []
        for p, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if p == pid:
                sha.update(b"," + text.encode())
            else:
                if sha:
                    out.append((pid, sha.hexdigest()))
                pid, sha = p, hashlib.sha256(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()),
                                          pa.array([r[1] for r in out], pa.string())], names=["pid", "ends"])
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([pid], pa.binary()), pa.array([sha.hexdigest()])],
                                         names=["pid", "ends"])


def ends_digests(ended: DataFrame) -> DataFrame:
    """pid and the digest of its conversation ids in numeric order, for (pid, conv_id) rows."""
    chunks = (ended.repartitionByRange("pid", "conv_id").sortWithinPartitions("pid", "conv_id")
              .mapInArrow(_chunks, "pid binary, first long, ids string"))
    return (chunks.repartition("pid").sortWithinPartitions("pid", "first")
            .mapInArrow(_digests, "pid binary, ends string"))


class Skeleton:
    """The trie of the paths that neighbouring shards share: `children[parent, unit]` is a node's number."""

    def __init__(self, bounds: list[tuple[bytes, bytes]]):
        """`bounds`: smallest and largest key of every shard, in order."""
        self.children: dict[tuple[int, bytes], int] = {}
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.length: list[int] = []
        for (_, last), (first, _) in zip(bounds, bounds[1:]):
            at = -1
            for i in range(0, min(len(last), len(first)), UNIT):
                step = first[i:i + UNIT]
                if last[i:i + UNIT] != step:
                    break
                if (at, step) not in self.children:
                    self.children[at, step] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(i // UNIT)
                    self.length.append(int.from_bytes(step[16:], "big"))
                at = self.children[at, step]

    def rows(self) -> list[tuple]:
        """number, parent, depth, skeleton children, and text lengths of the skeleton nodes of the subtree."""
        kids, below = [0] * len(self.parent), list(self.length)
        for n in reversed(range(len(self.parent))):            # children have larger numbers
            if self.parent[n] >= 0:
                kids[self.parent[n]] += 1
                below[self.parent[n]] += below[n]
        return [(n, self.parent[n] if self.parent[n] >= 0 else None, self.depth[n], kids[n], below[n])
                for n in range(len(self.parent))]


class _Open:
    """A node on the stack: what its shard has shown of it so far."""

    __slots__ = ("skel", "p", "top", "length", "conv", "n", "children", "leaves", "saved", "ends", "pending")

    def __init__(self, skel: int | None, length: int, p: bytes | None, top: int | None):
        self.skel, self.length, self.p, self.top = skel, length, p, top
        self.conv = self.ends = None
        self.n = self.children = self.leaves = self.saved = 0
        self.pending: list[list] = []


class _Walk:
    """One shard in key order. Finished rows (in the order of NAMES) gather in `out`."""

    def __init__(self, children: dict[tuple[int, bytes], int]):
        self.skeleton, self.out = children, []
        self.stack: list[_Open] = []
        self.units: list[bytes] = []

    def path(self, key: bytes, n: int, conv: int, ends: str | None, top: int | None, below: tuple | None) -> None:
        units = [key[i:i + UNIT] for i in range(0, len(key), UNIT)]
        same = 0
        for a, b in zip(units, self.units):
            if a != b:
                break
            same += 1
        self.close(same)
        for i in range(same, len(units)):
            above = self.stack[-1].skel if self.stack else -1
            skel = self.skeleton.get((above, units[i])) if above is not None else None
            self.stack.append(_Open(skel, int.from_bytes(units[i][16:], "big"),
                                    units[i] if i == 0 else None, top if i == 0 else None))
        self.units = units
        last = self.stack[-1]
        last.n, last.conv, last.ends = last.n + n, conv, ends
        if below:
            last.leaves, last.saved, last.children = last.leaves + below[0], last.saved + below[1], below[2]

    def close(self, depth: int = 0) -> None:
        while len(self.stack) > depth:
            node = self.stack.pop()
            above = self.stack[-1] if self.stack else None
            if node.skel is None:
                node.leaves = node.leaves if node.children else 1
                node.saved += (node.n - 1) * node.length
            else:
                node.saved += node.n * node.length       # the one to take off follows after the reduction
            row = [node.skel, above.skel if above else None, len(self.stack), node.p, node.top, node.conv, None,
                   node.n, node.children, node.leaves, node.saved, node.ends]
            for child in node.pending:
                child[6] = node.conv if node.top is None else node.top
            self.out += node.pending
            if node.skel is None and above is not None and above.skel is None:
                above.pending.append(row)                # its parent's smallest conversation is not known yet
            else:
                self.out.append(row)
            if above:
                above.n += node.n
                above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
                above.leaves += node.leaves
                above.saved += node.saved
                above.children += node.skel is None


def _walked(skeleton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[t])
                            for n, t in (c.split() for c in ROWS.split(", "))])

        def taken(walk) -> pa.RecordBatch:
            rows, walk.out = walk.out, []
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        shard, walk = None, _Walk(skeleton.value)
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS):
                piece = batch.slice(at, PIECE_ROWS).to_pydict()
                for s, key, n, conv, ends, top, leaves, saved, children in zip(
                        *(piece[c] for c in ("shard", "key", "n", "conv", "ends", "top_conv", "leaves", "saved", "children"))):
                    if s != shard:
                        walk.close()
                        walk.units = []
                        shard = s
                    walk.path(key, n, conv, ends, top, None if children is None else (leaves, saved, children))
                if len(walk.out) >= PIECE_ROWS:
                    yield taken(walk)
        walk.close()
        yield taken(walk)

    return run


def forest(paths: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All nodes (columns of ROWS, skel and pskel apart) of the tries over distinct path rows.

    A path row has key, n, conv (smallest), ends, top_conv, and leaves, saved, children of
    what is known to follow it. The first unit of a key is the node its trie stands below.
    """
    spark = paths.sparkSession
    size = paths.agg(F.sum(F.length("key"))).first()[0] or 0
    shards = max(math.ceil(size / shard_bytes), spark.sparkContext.defaultParallelism)
    placed = materialise(paths.repartitionByRange(shards, "key").withColumn("shard", F.spark_partition_id()), "shards")
    bounds = placed.groupBy("shard").agg(F.min("key").alias("a"), F.max("key").alias("b")).orderBy("shard").collect()
    skeleton = Skeleton([(bytes(r["a"]), bytes(r["b"])) for r in bounds])
    known = spark.sparkContext.broadcast(skeleton.children)
    rows = materialise(placed.repartition(max(len(bounds), 1), "shard").sortWithinPartitions("shard", "key")
                       .mapInArrow(_walked(known), ROWS), "nodes")
    facts = spark.createDataFrame(skeleton.rows(), "skel int, pskel int, depth int, kids int, lengths long")
    sums = (rows.filter("skel IS NOT NULL").groupBy("skel")
            .agg(F.max("p").alias("p"), F.max("top_conv").alias("top_conv"), F.min("conv_id").alias("conv_id"),
                 *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
                 F.max("ends_sha256").alias("ends_sha256"))
            .join(facts, "skel")
            .withColumn("n_children", F.col("n_children") + F.col("kids"))
            .withColumn("saved_tokens", F.col("saved_tokens") - F.col("lengths")).drop("kids", "lengths"))
    sums = materialise(sums, "skeleton")
    # One row per skeleton node: no more than the trie that was broadcast to the tasks.
    above = F.broadcast(sums.select(F.col("skel").alias("pskel"),
                                    F.coalesce("top_conv", "conv_id").alias("above_conv")))
    both = rows.filter("skel IS NULL").drop("skel").unionByName(sums.drop("skel"), allowMissingColumns=True)
    return (both.join(above, "pskel", "left")
            .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above_conv"))
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
            .drop("pskel", "above_conv"))


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = materialise(numbered_turns(conversations), "numbered")
    segs = materialise(rebuilt(turns, segment), "segments")
    n_levels = segs.agg(F.max("n_segs")).first()[0] or 0
    if not n_levels:
        return segs.sparkSession.createDataFrame([], ", ".join(
            f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in NODE))
    levels = []
    rows = segs.filter("seg = 0").withColumn("p", F.lit(TOP)).withColumn("top_conv", F.lit(None).cast("bigint"))
    for k in range(n_levels):
        rows = rows.withColumn("key", F.concat("p", "path")).withColumn("pid", node_id(F.col("key")))
        if k:
            rows = materialise(rows, f"level-{k}")
        distinct = (rows.groupBy("pid").agg(F.min("key").alias("key"), F.count("*").alias("n"),
                                            F.min("conv_id").alias("conv"), F.min("top_conv").alias("top_conv"))
                    .join(ends_digests(rows.filter(F.col("n_segs") == k + 1).select("pid", "conv_id")), "pid", "left"))
        distinct = materialise(distinct, f"paths-{k}")
        levels.append(distinct)
        if k + 1 < n_levels:
            went_on = rows.filter(F.col("n_segs") > k + 1).select("conv_id", F.col("pid").alias("p"))
            rows = (segs.filter(F.col("seg") == k + 1).join(went_on, "conv_id")
                    .join(distinct.select(F.col("pid").alias("p"), F.col("conv").alias("top_conv")), "p"))
    below, out = None, None
    for k in reversed(range(n_levels)):
        paths = levels[k]
        if below is not None:
            paths = paths.join(below, "pid", "left")
        else:
            paths = paths.withColumns({c: F.lit(None).cast("bigint") for c in ("leaves", "saved", "children")})
        nodes = forest(paths, shard_bytes)
        if k:
            nodes = materialise(nodes, f"forest-{k}")
            below = nodes.filter("depth = 0").select(
                F.col("p").alias("pid"), F.col("n_leaves").alias("leaves"),
                F.col("saved_tokens").alias("saved"), F.col("n_children").alias("children"))
            nodes = nodes.filter("depth > 0")
        level = nodes.withColumn("depth", (F.col("depth") + k * segment).cast("bigint")).select(*NODE)
        out = level if out is None else level.unionByName(out)
    return out


#: Every prefix as a list of turns; the checksum bit by bit, as the SQL dialect has none.
SQL = """
WITH t AS (
    SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said, turn
    FROM conversations WHERE conv_id IS NOT NULL),
o AS (
    SELECT conv_id, list(said ORDER BY turn NULLS FIRST, said) AS turns,
        xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
            string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
            lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1)))) % 6 AS h
    FROM t GROUP BY conv_id),
r AS (
    SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), coalesce(o.turns[o.h + 1:], [])) AS path
    FROM o LEFT JOIN o AS b ON b.conv_id = o.conv_id - o.conv_id % 100),
p AS (
    SELECT conv_id, d, path[1:d] AS prefix, len(path) = d AS ends
    FROM r, LATERAL (SELECT unnest(range(0, len(path) + 1)) AS d) AS depths),
n AS (
    SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM p GROUP BY d, prefix),
c AS (SELECT d - 1 AS d, prefix[1:d - 1] AS prefix, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
s AS (
    SELECT a AS d, prefix[1:a] AS prefix, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves,
        sum(CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(prefix[d].text) END) AS saved_tokens
    FROM n LEFT JOIN c USING (d, prefix), LATERAL (SELECT unnest(range(0, d + 1)) AS a) AS above
    GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs,
    coalesce(c.n_children, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
    s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (d, prefix) LEFT JOIN c USING (d, prefix)
LEFT JOIN n AS up ON up.d = n.d - 1 AND up.prefix = n.prefix[1:n.d - 1]"""
