"""Blocked nearest-neighbour scores against the direct matrix computation."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinsift.operators import similarity, tiles


def directional(a, b):
    """Nearest neighbour in the stacked matrix, self excluded, first index on ties."""
    x = np.vstack([a, b]).astype(np.float64)
    sims = np.round(x @ x.T, 9)
    np.fill_diagonal(sims, -1.0)
    other = sims.argmax(1) >= len(a)
    return other[:len(a)].mean(), (~other[len(a):]).mean()


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    rows, vectors = [], {}
    sizes = {"hot": 120, "b": 9, "c": 5, "d": 3, "single": 1}
    for name, n in sizes.items():
        center = rng.normal(size=8)
        for i in range(n):
            # Every fourth vector repeats the one before it, so that ties occur.
            if i % 4 == 3:
                v = vectors[f"{name}{i - 1}"]
            else:
                v = rng.normal(size=8) + 0.5 * center
                v = (v / np.linalg.norm(v)).astype(np.float32)
            vectors[f"{name}{i}"] = v
            rows.append(("crop", f"o{i % 2}", name, f"{name}{i}", [float(x) for x in v]))
    df = spark.createDataFrame(rows, "crop string, bucket string, disease string, img string, "
                                     "embedding array<float>")
    return df, rows


def matrix(rows, disease, bucket=None):
    return np.array([r[4] for r in rows if r[2] == disease and bucket in (None, r[1])], dtype=np.float32)


@pytest.mark.parametrize("block_rows", [5, 40, 2048])
def test_bucket_scores(data, block_rows):
    df, rows = data
    got = {(r["bucket"], r["member_a"], r["member_b"]): (r["entail_ab"], r["entail_ba"])
           for r in similarity.bucket_scores(similarity.nn_by_class(df, block_rows), min_side=1).collect()}
    want = {}
    for bucket in ("o0", "o1"):
        names = sorted({r[2] for r in rows if r[1] == bucket})
        for i, a in enumerate(names):
            for b in names[i + 1:]:
                want[(bucket, a, b)] = directional(matrix(rows, a, bucket), matrix(rows, b, bucket))
    assert got.keys() == want.keys()
    for key, rates in want.items():
        assert got[key] == pytest.approx(rates), key


def test_block_size_does_not_change_the_result(data):
    df, _ = data

    def bag(n):
        return sorted(map(tuple, similarity.nn_by_class(df, n).collect()))

    assert bag(3) == bag(2048)


def test_scores_are_bounded_and_bidirectional(data):
    df, _ = data
    scores = similarity.matched_scores(similarity.nn_by_class(df), similarity.class_pairs(df)).collect()
    assert len(scores) == 10
    for r in scores:
        if r["matched_cross_knn"] is None:
            assert r["reason"] == "no shared-organ support" and not r["ok"]
        else:
            assert 0 <= r["matched_cross_knn"] <= min(r["matched_entail_ab"], r["matched_entail_ba"])
            assert r["ok"] == (r["matched_support"] >= 5)


def test_separation(data):
    df, rows = data
    got = {(r["member_a"], r["member_b"]): r for r in
           similarity.separation(df, similarity.class_pairs(df)).collect()}
    a, b = matrix(rows, "b"), matrix(rows, "hot")
    within = []
    for m in (a, b):
        sims = m.astype(np.float64) @ m.T.astype(np.float64)
        within += list(sims[np.triu_indices(len(m), 1)])
    cross = float((a.astype(np.float64) @ b.T.astype(np.float64)).mean())
    assert got[("b", "hot")]["within_sim"] == pytest.approx(np.mean(within), abs=1e-4)
    assert got[("b", "hot")]["cross_sim"] == pytest.approx(cross, abs=1e-4)
    assert ("b", "single") not in got


@pytest.mark.parametrize("block_rows", [6, 2048])
def test_top_k(data, block_rows):
    df, rows = data
    made = df.withColumn("climate", F.array(F.lit(0.6), F.length("disease") / 10.0))
    got = {}
    for r in similarity.weighted_top_k(made, 3, block_rows=block_rows).collect():
        got.setdefault(r["img"], []).append((r["rank"], r["found"]))
    img, bucket = "b3", "o1"
    climate = {r[3]: np.array([0.6, len(r[2]) / 10]) for r in rows}
    vec = {r[3]: np.array(r[4], dtype=np.float32).astype(np.float64) for r in rows if r[1] == bucket}

    def score(other):
        c, d = climate[img], climate[other]
        return round(0.7 * vec[img] @ vec[other] + 0.3 * (c @ d) / np.linalg.norm(c) / np.linalg.norm(d), 9)

    best = sorted((o for o in vec if o != img), key=lambda o: (-score(o), o))[:3]
    assert [f for _, f in sorted(got[img])] == best


def made_block(v, codes, number, segment_rows):
    imgs = pa.array([f"{number}-{i}" for i in range(len(v))])
    return tiles.Block(imgs, [f"c{i}" for i in range(codes.max() + 1)], codes.astype(np.int32), v, number, segment_rows)


def test_bounds_skip_segments_of_clustered_vectors():
    """Most segments of a class in many clusters are never opened, and the maxima are exact."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 16))
    centers /= np.linalg.norm(centers, axis=1)[:, None]
    v = np.repeat(centers, 40, axis=0) + 0.01 * rng.normal(size=(1600, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    codes = np.repeat([0, 1], 800)
    x, y = (made_block(v, codes, number, 40) for number in (1, 2))
    for a, b in ((x, y), (x, x)):
        sims = a.v @ b.v.T
        if a is b:
            np.fill_diagonal(sims, -1.0)
        counts = {"opened": 0, "all": 0}
        got = tiles.class_maxima(a, b, {}, counts)
        for c in (0, 1):
            assert np.allclose(got[f"c{c}"], sims[:, codes == c].max(axis=1), atol=1e-12)
        assert counts["opened"] < 0.25 * counts["all"]
        # With the maxima already held, nothing is opened again.
        again = {"opened": 0, "all": 0}
        tiles.class_maxima(a, b, {k: m + 1e-6 for k, m in got.items()}, again)
        assert again["opened"] < 0.25 * again["all"]


def test_tiles_equal_brute_force(spark):
    """Several partitions, blocks and segments per class, repeated images, and a class with one image."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 8))
    rows = []
    for i in range(700):
        v = centers[i % 12] + 0.1 * rng.normal(size=8)
        rows.append(("k", f"b{i % 2}", f"d{i % 3}" if i else "alone", f"i{i}", (v / np.linalg.norm(v)).tolist()))
    rows.append(rows[5])                                    # a repeated row
    df = spark.createDataFrame(rows, "crop string, bucket string, disease string, img string, embedding array<double>")
    want = {}
    for bucket in ("b0", "b1"):
        part = [r for r in rows if r[1] == bucket]
        v = np.array([r[4] for r in part])
        sims = np.round(v @ v.T, 9)
        np.fill_diagonal(sims, -1.0)
        for i, r in enumerate(part):
            for j, o in enumerate(part):
                key = (bucket, r[3], o[2])
                want[key] = max(want.get(key, -9), sims[i, j])
    for sizes in ({"block_rows": 16, "segment_rows": 4}, {"block_rows": 64, "segment_rows": 16}, {}):
        got = {(r["bucket"], r["img"], r["other"]): r["best"]
               for r in tiles.best_by_class(df.repartition(5), 9, **sizes).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[key] - best) < 2e-9 for key, best in want.items())


def test_copies_grow_with_the_square_root_of_the_blocks(spark):
    for n in (1, 16, 100):
        blocks = spark.range(n).selectExpr("'k' AS crop", "'b' AS bucket", "id AS number")
        copies = tiles.tiles(blocks).groupBy("number").count().collect()
        assert len(copies) == n and {r["count"] for r in copies} == {int(n ** 0.5)}
    held = tiles.tiles(spark.range(100).selectExpr("'k' AS crop", "'b' AS bucket", "id AS number"))
    assert held.groupBy("a", "b").count().agg(F.max("count")).first()[0] == 20
