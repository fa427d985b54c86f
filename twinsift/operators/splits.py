"""Leak-free split assignment and its audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from twinsift import fixed_values as fv
from twinsift.functions import hashing
from twinsift.operators.skew import attach_group, rank_by_hash


def held_out_states(rows: DataFrame, seed, n: int = fv.HELD_OUT_STATES,
                    shares: tuple[float, float] = fv.HELD_OUT_STATE_SHARES,
                    counts: tuple[int, int] | None = None) -> DataFrame:
    """At most `n` states of middling size, in seeded hash order.

    Size is meant as a share of all rows, so that it holds for tables of any size; `counts`
    (fewest and most rows) takes its place where it is given.
    """
    sizes = rows.groupBy("state").agg(F.count("*").alias("n_rows"))
    total = F.sum("n_rows").over(W.Window.partitionBy(F.lit(0)))
    low, high = counts if counts else (F.lit(s) * total for s in shares)
    return (sizes.withColumns({"_low": F.lit(low), "_high": F.lit(high)})
            .filter(F.col("n_rows").between(F.col("_low"), F.col("_high")))
            .withColumn("_key", hashing.order_key(seed, F.col("state")))
            .orderBy("_key").limit(n).select("state"))


def held_out_crops(rows: DataFrame, seed, share: float = fv.HELD_OUT_CROP_SHARE) -> DataFrame:
    """The first max(1, floor(share * crops)) crops in seeded hash order, with their hash `_key`."""
    crops = (rows.select("crop").distinct()
             .withColumn("_key", hashing.order_key(seed, F.col("crop"))))
    ranked = rank_by_hash(crops, "_key", "_rank", "_n")
    quota = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(share)))
    return ranked.filter(F.col("_rank") < quota).select("crop", "_key")


def assign_splits(rows: DataFrame, seed=fv.DEFAULT_SEED,
                  random_share: float = fv.RANDOM_TEST_SHARE) -> DataFrame:
    """Split per row: held-out region, then held-out crop, then random test, else train.

    Membership comes from seeded hashes, so it does not depend on row order or partitioning.
    """
    region = held_out_states(rows, seed).withColumn("_region", F.lit(True))
    joined = rows.join(F.broadcast(region), "state", "left")     # at most six rows
    # Held-out crops come first in hash order, so the last of their keys is all that rows need.
    last = held_out_crops(rows, seed).agg(F.max("_key")).scalar()
    species = F.col("crop").isNotNull() & (hashing.order_key(seed, F.col("crop")) <= last)
    random = hashing.seeded_uniform(seed, F.col("row_id")) < random_share
    split = (F.when(F.col("_region"), "test_heldout_region")
             .when(species, "test_heldout_species")
             .when(random, "test_random").otherwise("train"))
    return joined.withColumn("split", split).drop("_region")


def collapse_splits(rows: DataFrame) -> DataFrame:
    """One split per image: that of its first row. Rows without an image keep their own."""
    named = F.coalesce(F.col("img"), F.lit("")) != ""
    key = F.when(named, F.concat(F.lit("i"), "img")).otherwise(
        F.concat(F.lit("r"), F.col("row_id").cast("string")))
    first = F.min_by("split", "row_id").alias("_split")
    return (attach_group(rows.withColumn("_key", key), ["_key"], [first], ["row_id"])
            .withColumn("split", F.col("_split")).drop("_key", "_split"))


def split_leaks(rows: DataFrame) -> DataFrame:
    """Images found in more than one split."""
    return (rows.filter(F.coalesce(F.col("img"), F.lit("")) != "").groupBy("img")
            .agg(F.array_sort(F.collect_set("split")).alias("splits"))
            .filter(F.size("splits") > 1))


def split_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count("*").alias("n_items"),
                                     F.countDistinct("img").alias("n_images"))
