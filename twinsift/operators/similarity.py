"""Nearest-neighbour confusability from embeddings.

All scores need one thing per image: its best similarity to each class it is compared with.
`tiles` multiplies blocks of a (crop, bucket) inside tasks, leaves out what a bound rules out, and
returns per-image, per-class maxima. No pair of images leaves a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from twinsift import fixed_values as fv
from twinsift.functions import geo, text
from twinsift.operators import tiles
from twinsift.operators.skew import checked_join, salted_join

BLOCK_ROWS = tiles.BLOCK_ROWS
ROUND_SIM = 9        # vectors are float32, so ties are decided on nine decimals


def nn_by_class(emb: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Best similarity of every image to every class of its (crop, bucket), self excluded.

    `emb` has crop, bucket, disease, img, embedding. The result adds `own`, the best
    similarity to the image's own class.
    """
    image = ["crop", "bucket", "img"]
    best = tiles.best_by_class(emb, ROUND_SIM, block_rows)
    own = F.max(F.when(F.col("disease") == F.col("other"), F.col("best")))
    return best.withColumn("own", own.over(W.Window.partitionBy(*image)))


def weighted_top_k(emb: DataFrame, k: int, image_weight: float = 0.7,
                   climate_weight: float = 0.3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k best other images of the same (crop, bucket) by image and climate similarity.

    The weighted sum of two cosines is one dot product of the joined, scaled vectors, so the
    tiles apply; each tile passes on k rows per image. Ties go by image id.
    """
    unit_climate = F.when(geo.norm(F.col("climate")) > 0, F.transform(
        "climate", lambda x: x / geo.norm(F.col("climate")))).otherwise(F.col("climate"))
    a, b = float(np.sqrt(image_weight)), float(np.sqrt(climate_weight))
    joined = F.concat(F.transform("embedding", lambda x: x.cast("double") * a),
                      F.transform(unit_climate, lambda x: x * b))
    found = tiles.best_others(emb.withColumn("embedding", joined), k, ROUND_SIM, block_rows)
    order = W.Window.partitionBy("img").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _directional(nn: DataFrame, by_bucket: bool) -> DataFrame:
    """Counts and cross-class hits per unordered class pair.

    For an image of the first member the other class must be strictly closer; for the second
    member a tie goes to the first.
    """
    first = F.col("disease") < F.col("other")
    hit = F.when(first, F.col("best") > F.col("own")).otherwise(F.col("best") >= F.col("own"))
    keys = ["crop"] + (["bucket"] if by_bucket else [])
    return (nn.filter(F.col("disease") != F.col("other"))
            .groupBy(*keys, F.least("disease", "other").alias("member_a"),
                     F.greatest("disease", "other").alias("member_b"))
            .agg(F.count_if(first).alias("n_a"), F.count_if(~first).alias("n_b"),
                 F.count_if(first & hit).alias("hits_ab"),
                 F.count_if(~first & hit).alias("hits_ba"))
            .withColumn("entail_ab", F.try_divide("hits_ab", "n_a"))
            .withColumn("entail_ba", F.try_divide("hits_ba", "n_b")))


PAIR = ["crop", "member_a", "member_b"]


def bucket_scores(nn: DataFrame, min_side: int = fv.MIN_SIDE) -> DataFrame:
    """Directional rates per shared organ bucket with enough images on both sides."""
    return (_directional(nn, by_bucket=True)
            .filter((F.col("n_a") >= min_side) & (F.col("n_b") >= min_side))
            .withColumn("weight", F.least("n_a", "n_b")))


def class_pairs(emb: DataFrame) -> DataFrame:
    """All unordered class pairs of each crop that have embeddings."""
    classes = emb.groupBy("crop", "disease").agg(F.count("*").alias("n"))
    a = classes.select("crop", F.col("disease").alias("member_a"), F.col("n").alias("n_a"))
    b = classes.select("crop", F.col("disease").alias("member_b"), F.col("n").alias("n_b"))
    return (salted_join(a, b, ["crop"], ["member_a"])
            .filter(F.col("member_a") < F.col("member_b")))


def matched_scores(nn: DataFrame, pairs: DataFrame, min_side: int = fv.MIN_SIDE,
                   min_support: int = fv.MIN_SUPPORT) -> DataFrame:
    """Organ-matched scores per pair, with support, buckets and reason.

    `matched_cross_knn` is the bidirectional score (both directions must hold);
    `pooled_cross_knn` is the symmetric baseline, the share of the pooled images whose
    neighbour is the other class.
    """
    w = F.col("weight")

    def weighted(rate):
        return F.sum(w * rate) / F.sum(w)

    pooled = (F.col("hits_ab") + F.col("hits_ba")) / (F.col("n_a") + F.col("n_b"))
    per_pair = (bucket_scores(nn, min_side).groupBy(*PAIR)
                .agg(weighted(F.col("entail_ab")).alias("ab"),
                     weighted(F.col("entail_ba")).alias("ba"),
                     weighted(pooled).alias("pooled"),
                     F.sum(w).alias("matched_support"),
                     F.array_sort(F.collect_set("bucket")).alias("shared_buckets")))
    enough = F.col("matched_support") >= min_support
    reason = (F.when(F.col("matched_support").isNull(), "no shared-organ support")
              .when(~enough, "insufficient matched support"))
    return (pairs.select(*PAIR).join(per_pair, PAIR, "left")
            .select(*PAIR, F.coalesce(enough, F.lit(False)).alias("ok"), reason.alias("reason"),
                    F.round("ab", 4).alias("matched_entail_ab"),
                    F.round("ba", 4).alias("matched_entail_ba"),
                    F.round(F.least("ab", "ba"), 4).alias("matched_cross_knn"),
                    F.round("pooled", 4).alias("pooled_cross_knn"),
                    "matched_support", "shared_buckets"))


def vector_sums(emb: DataFrame) -> DataFrame:
    """Size, sum vector and sum of squared lengths per class: dense sums, combined on the map side."""
    vec = F.col("embedding").cast("array<double>")
    return (emb.select("crop", "disease", array_to_vector(vec).alias("_v"), _dot(vec, vec).alias("_q"))
            .groupBy("crop", "disease")
            .agg(F.count("*").alias("n"), F.sum("_q").alias("squares"), Summarizer.sum(F.col("_v")).alias("_s"))
            .withColumn("total", vector_to_array("_s")).drop("_s"))


def _with_sums(pairs: DataFrame, sums: DataFrame) -> DataFrame:
    out = pairs.select(*PAIR)
    for side in ("a", "b"):
        out = out.join(sums.select(
            "crop", F.col("disease").alias(f"member_{side}"), F.col("n").alias(f"n_{side}"),
            F.col("total").alias(f"total_{side}"), F.col("squares").alias(f"squares_{side}")),
            ["crop", f"member_{side}"])
    return out


def _dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def whole_scores(nn_whole: DataFrame, emb: DataFrame, pairs: DataFrame,
                 minimum: int = fv.MIN_WHOLE) -> DataFrame:
    """Whole-class bidirectional score and centroid cosine; `nn_whole` ignores buckets."""
    sums = _with_sums(pairs, vector_sums(emb))
    norm_a = F.sqrt(_dot("total_a", "total_a")) / F.col("n_a") + F.lit(1e-8)
    norm_b = F.sqrt(_dot("total_b", "total_b")) / F.col("n_b") + F.lit(1e-8)
    centroid = _dot("total_a", "total_b") / (F.col("n_a") * F.col("n_b")) / norm_a / norm_b
    rates = _directional(nn_whole, by_bucket=False).select(*PAIR, "entail_ab", "entail_ba")
    ok = (F.col("n_a") >= minimum) & (F.col("n_b") >= minimum)

    def if_ok(value):
        return F.when(ok, F.round(value, 4))

    return (sums.join(rates, PAIR, "left")
            .select(*PAIR, ok.alias("ok"), F.when(~ok, "too few embeddings").alias("reason"),
                    "n_a", "n_b", if_ok(centroid).alias("centroid_sim"),
                    if_ok(F.col("entail_ab")).alias("entail_ab"),
                    if_ok(F.col("entail_ba")).alias("entail_ba"),
                    if_ok(F.least("entail_ab", "entail_ba")).alias("cross_knn_rate")))


def separation(emb: DataFrame, pairs: DataFrame, minimum: int = fv.MIN_WHOLE) -> DataFrame:
    """Mean within-class and cross-class similarity over unordered image pairs, and their ratio.

    The mean of all dot products of two sets is the dot product of their sums over the number
    of pairs, so no pair of images is ever formed.
    """
    s = _with_sums(pairs, vector_sums(emb)).filter(
        (F.col("n_a") >= minimum) & (F.col("n_b") >= minimum))

    def inside(side: str):
        return (_dot(f"total_{side}", f"total_{side}") - F.col(f"squares_{side}")) / 2

    def couples(side: str):
        n = F.col(f"n_{side}")
        return n * (n - 1) / 2

    within = (inside("a") + inside("b")) / (couples("a") + couples("b"))
    cross = _dot("total_a", "total_b") / (F.col("n_a") * F.col("n_b"))
    ratio = F.when(within > 0, cross / within).otherwise(F.lit(0.0))
    return s.select(*PAIR, F.round(within, 4).alias("within_sim"),
                    F.round(cross, 4).alias("cross_sim"), F.round(ratio, 4).alias("sep_ratio"))


def confusable(scores: DataFrame, score: str, gate: float,
               name: str = "image_confusable") -> DataFrame:
    """Flag pairs whose score is ok and reaches the gate."""
    flag = F.coalesce(F.col("ok") & (F.col(score) >= gate), F.lit(False))
    return scores.withColumn(name, flag)


def class_head_sample(emb: DataFrame, cap: int) -> DataFrame:
    """First `cap` image ids per class in sorted order (a sampling operator)."""
    order = W.Window.partitionBy("crop", "disease").orderBy("img")
    return (emb.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= cap).drop("_r"))


def member_worklist(images: DataFrame, members: DataFrame) -> DataFrame:
    """Images of the classes that take part in some pair."""
    return checked_join(images, members.select("crop", "disease").distinct(),
                        ["crop", "disease"], "left_semi")


def pair_members(pairs: DataFrame) -> DataFrame:
    """Both classes of every pair as (pair_id, crop, side, disease)."""
    side = F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.col("member_a").alias("disease")),
        F.struct(F.lit("b").alias("side"), F.col("member_b").alias("disease"))))
    return pairs.withColumn("_m", side).select("pair_id", "crop", "_m.side", "_m.disease")


def with_pair_id(scores: DataFrame) -> DataFrame:
    return scores.withColumn("pair_id", text.pair_id(
        F.col("crop"), F.col("member_a"), F.col("member_b")))
