"""Norm buckets, centroid clustering and the prefix trie against brute force and their SQL."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.compare import connect, difference
from twinsift.llm import normbuckets, prefixtrie, queries, vpclusters

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_norm_buckets", "op12_vp_clusters", "op13_prefix_trie"])
def test_matches_sql(spark, name):
    df = queries.queries()[name](spark, FOLDER)
    assert difference(df, connect(FOLDER), queries.oracle_sql()[name]) is None


# ---- largest products

def odd_vectors(dim=6):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=dim) * rng.choice([0.01, 0.3, 1, 1, 5])).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]                       # one very common vector
    rows += [(2000, [0.0] * dim), (2050, [-1.0] * dim), (2100, None), (2150, [None] + [1.0] * (dim - 1)),
             (2200, [math.nan] * dim), (2250, [math.inf] * dim), (2300, []), (2350, [1.0]), (2351, [2.0]),
             (2352, [-3.0]), (None, [1.0] * dim), (2400, [1e9] * dim), (50, rows[50][1]), (50, [9.0] * dim)]
    return rows


def slow_products(rows, every, k, scale=256):
    first = {}
    for i, v in rows:
        if i is not None and v is not None and all(
                x is not None and abs(x * scale) < normbuckets.LARGEST for x in v):
            first[i] = min(first.get(i, v), v)
    whole = {i: [math.floor(scale * x) for x in v] for i, v in first.items()}
    out = []
    for q, a in whole.items():
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole.items()
                           if i != q and len(a) == len(b))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"bucket_rows": 50, "query_rows": 20, "groups": 3}, {"bucket_rows": 7, "groups": 1}])
def test_top_products(spark, sizes):
    rows = odd_vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = normbuckets.top_products(df.repartition(3), every=10, **sizes)
    assert sorted(map(tuple, got.collect())) == slow_products(rows, 10, 5)
    assert normbuckets.top_products(df.limit(0)).count() == 0


def search_all(v, ids, queries_, k, rows_each):
    order = np.argsort(-normbuckets.lengths(v), kind="stable")
    search = normbuckets.Search(ids[queries_], v[queries_], k)
    for at in range(0, len(v), rows_each):
        part = order[at:at + rows_each]
        search.visit(normbuckets.Bucket(ids[part], v[part]))
    for row, q in enumerate(np.flatnonzero(queries_)):
        score = v @ v[q]
        want = sorted((-int(s), int(i)) for s, i in zip(score, ids) if i != ids[q])[:k]
        assert [(-int(s), int(i)) for s, i in zip(search.score[row], search.found[row])] == want
    return search.used


def test_buckets_are_pruned_by_length_or_by_coordinate():
    rng = np.random.default_rng(1)
    ids = np.arange(3000)
    # Lengths that fall quickly: later buckets are skipped, and prefixes are verified.
    v = (rng.normal(size=(3000, 8)) * np.exp(-np.arange(3000) / 400)[:, None] * 5000).astype(np.int64)
    used = search_all(v, ids, ids % 50 == 0, 5, 200)
    assert used["skipped"] > 10 * 60 and used["length"] > 0
    assert used["verified"] < 0.5 * 60 * 3000
    # Tight clusters of equal length: thresholds are near one, and coordinates leave few to verify.
    centers = rng.normal(size=(30, 8))
    v = centers[ids % 30] + 0.02 * rng.normal(size=(3000, 8))
    v = (v / np.linalg.norm(v, axis=1)[:, None] * 4096).astype(np.int64)
    used = search_all(v, ids, ids % 50 == 0, 5, 600)
    assert used["coordinate"] > 3 * 60
    assert used["verified"] < 0.5 * 60 * 3000


def test_products_beyond_doubles_are_exact():
    a, b = np.array([[2 ** 26 - 1] * 64]), np.array([[2 ** 26 - 1] * 63 + [1]])
    assert normbuckets.products(a, b)[0, 0] == sum(int(x) * int(y) for x, y in zip(a[0], b[0]))


# ---- centroid clustering

def slow_clusters(rows, k, rounds, dim, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(
                x is not None and abs(x * scale) < vpclusters.LARGEST for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if groups[j] else m for j, m in enumerate(c)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    per, total = defaultdict(int), sum(d for *_, d in found)
    for _, j, d in found:
        per[j] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted([(i, j, d, per[j], total, sha[j]) for i, j, d in found], key=str)


@pytest.mark.parametrize("k", [5, 16, 5000])
def test_clusters(spark, k):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=4) * 3).round(1).tolist()) for i in range(500)]
    rows += [(600 + i, rows[3][1]) for i in range(200)] + [(3, rows[3][1]), (4, rows[9][1])]      # copies, repeated ids
    rows += [(None, [1.0] * 4), (None, [2.0] * 4), (900, None), (901, [1.0]), (902, [None] * 4), (903, [math.nan] * 4),
             (904, [math.inf] * 4), (905, [1e12] * 4), (906, [])]
    if k == 5000:
        rows = rows[:40] + rows[-9:]                       # fewer vectors than centroids
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cluster int")
    got = vpclusters.cluster(df.repartition(3), k=k, dim=4, scale=4)
    assert sorted(map(tuple, got.collect()), key=str) == slow_clusters(rows, k, 3, 4, 4)
    assert vpclusters.cluster(df.limit(0)).count() == 0
    assert vpclusters.cluster(df.filter("vec_id = 906"), dim=4).count() == 0


def test_tree_saves_distances_and_keeps_ties():
    rng = np.random.default_rng(8)
    centroids = np.repeat(rng.integers(-50, 50, size=(60, 3)), 2, axis=0)         # every centroid stands twice
    x = np.concatenate([rng.integers(-50, 50, size=(2000, 3)), centroids])
    number, distance, taken = vpclusters.CentroidTree(centroids).nearest(x)
    all_ = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (number == all_.argmin(axis=1)).all() and (distance == all_.min(axis=1)).all()
    assert (number % 2 == 0).all()                                               # the smaller of two equals
    assert taken < 0.5 * len(x) * len(centroids)


# ---- prefix trie

def slow_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in turns.items()}
    paths = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        paths[c] = tuple(said.get(base, [])[:h] + said[c][h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                kids[path[:d - 1]].add(path[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    return sorted([(min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves[node],
                    saved[node], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(node))
                                                .encode()).hexdigest()) for node, m in members.items()], key=str)


def odd_conversations():
    rng = random.Random(3)
    say = lambda: rng.choice(["a", "b", "c", "dé", "x" * 50])
    rows = []
    for c in [*range(0, 260), 1000, 1001, -1, -100, -150, 10 ** 15 + 3]:
        n = rng.choice([1, 2, 3, 8, 12])
        rows += [(c, t, rng.choice(["user", "bot"]), say()) for t in range(n)]
    rows += [(300 + i, t, "user", f"same {t}") for i in range(90) for t in range(9)]           # a group of copies
    rows += [(400 + i, t, "user", f"same {t % 7}") for i in range(3) for t in range(70)]       # long ones
    rows += [(500, None, None, None), (500, 1, None, "t"), (501, None, "r", None), (None, 1, "user", "a"),
             (502, 1, "user", "q"), (502, 2, "user", "y" * 20_000)]
    rows += [(503, t, "user", "again") for t in (5, 5, 5, 6, 7, 8, 9, 10)]                    # repeated rows
    return rows


@pytest.mark.parametrize("sizes", [{}, {"segment": 4}, {"segment": 1, "shard_bytes": 400}, {"segment": 30, "shard_bytes": 2000}])
def test_prefix_trie(spark, monkeypatch, sizes):
    monkeypatch.setattr(prefixtrie, "CHUNK_IDS", 7)
    rows = odd_conversations()
    if sizes.get("segment") == 1:                      # one level per turn
        rows = [r for r in rows if r[0] is not None and r[0] < 20 or r[0] in (500, 501, 503)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string")
    got = prefixtrie.prefix_trie(df.repartition(4), **sizes)
    assert sorted(map(tuple, got.collect()), key=str) == slow_trie(rows)


def test_empty_trie(spark):
    df = spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, turn long, role string, text string")
    out = prefixtrie.prefix_trie(df)
    assert out.columns == prefixtrie.NODE and out.count() == 0


def test_skeleton_holds_shared_paths_only():
    u = [bytes([i]) * 16 + (5).to_bytes(4, "big") for i in range(6)]
    s = prefixtrie.Skeleton([(u[0] + u[1], u[0] + u[2]), (u[0] + u[3], u[0] + u[3] + u[4]), (u[0] + u[3] + u[5], u[1])])
    assert s.parent == [-1, 0] and s.depth == [0, 1]               # u0, and u0 u3
    assert s.rows() == [(0, None, 0, 1, 10), (1, 0, 1, 0, 5)]
