"""Geographic priors and evaluation measures over answered items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from twinsift.functions import geo
from twinsift.operators.skew import exact_median


def geo_prior(rows: DataFrame) -> DataFrame:
    """Disease x region distribution from the train split, one vote per contributor."""
    votes = (rows.filter(F.col("split") == "train")
             .select("disease", "region", "contributor").distinct()
             .groupBy("disease", "region").agg(F.count("*").alias("votes")))
    total = F.sum("votes").over(W.Window.partitionBy("disease"))
    return votes.withColumn("prior", F.round(F.col("votes") / total, 4))


def locations_per_disease(rows: DataFrame) -> DataFrame:
    """Number of diseases by their number of distinct regions; single-region ones flagged."""
    pairs = rows.filter(F.col("region").isNotNull()).select("disease", "region").distinct()
    per = pairs.groupBy("disease").agg(F.count("*").alias("n_regions"))
    return (per.groupBy("n_regions").agg(F.count("*").alias("n_diseases"))
            .withColumn("single_region", F.col("n_regions") == 1))


def tier_accuracy(answers: DataFrame) -> DataFrame:
    """Accuracy at each tier; `answers` has true_<tier> and said_<tier> columns."""
    tiers = ("country", "admin1", "zone")
    hits = F.explode(F.array(*[
        F.struct(F.lit(t).alias("tier"),
                 (F.col(f"true_{t}") == F.col(f"said_{t}")).cast("int").alias("hit"))
        for t in tiers]))
    return (answers.select(hits.alias("h")).groupBy(F.col("h.tier").alias("tier"))
            .agg(F.count("*").alias("n"), F.round(F.avg("h.hit"), 4).alias("accuracy")))


def geodesic_error(answers: DataFrame, limits_km=(25, 200, 750, 2500)) -> DataFrame:
    """Median distance and share of answers within each limit, per split."""
    km = geo.haversine_km(F.col("true_lat"), F.col("true_lon"), F.col("said_lat"),
                          F.col("said_lon"))
    measured = answers.withColumn("km", F.round(km, 6))
    shares = measured.groupBy("split").agg(F.count("*").alias("n"), *[
        F.round(F.count_if(F.col("km") <= limit) / F.count("*"), 4).alias(f"within_{limit}_km")
        for limit in limits_km])
    median = exact_median(measured, ["split"], "km", "median_km")
    return shares.join(median.withColumn("median_km", F.round("median_km", 3)), "split")


def split_gap(answers: DataFrame) -> DataFrame:
    """In-distribution accuracy minus that of each held-out split."""
    acc = answers.groupBy("split").agg(F.avg(F.col("correct").cast("int")).alias("acc"))
    one = acc.agg(
        F.max(F.when(F.col("split") == "test_random", F.col("acc"))).alias("in_distribution"),
        F.max(F.when(F.col("split") == "test_heldout_region", F.col("acc"))).alias("region"),
        F.max(F.when(F.col("split") == "test_heldout_species", F.col("acc"))).alias("species"))
    base = F.col("in_distribution")
    return one.select(F.round(base, 4).alias("in_distribution_accuracy"),
                      F.round(base - F.col("region"), 4).alias("region_gap"),
                      F.round(base - F.col("species"), 4).alias("species_gap"))


def chain_grounding(chains: DataFrame, prior: DataFrame, known_fields: list[str]) -> DataFrame:
    """Share of chain steps that cite a known field, and of conclusions backed by the prior.

    `chains` has item_id, region, concluded and cot, an array of (step, cites, text).
    """
    known = F.array(*[F.lit(k) for k in known_fields])
    cited = F.size(F.filter("cot", lambda s: F.array_contains(known, s["cites"])))
    backed = prior.select("region", F.col("disease").alias("concluded"), F.lit(1).alias("_b"))
    return (chains.select("region", "concluded", cited.alias("cited"), F.size("cot").alias("steps"))
            .join(backed, ["region", "concluded"], "left")
            .agg(F.count("*").alias("n_chains"),
                 F.round(F.sum("cited") / F.sum("steps"), 4).alias("cited_share"),
                 F.round(F.avg(F.coalesce("_b", F.lit(0))), 4).alias("backed_share")))


def best_by_region(prior: DataFrame, crops: DataFrame) -> DataFrame:
    """Most likely disease per (crop, region); ties to the alphabetically first."""
    joined = prior.join(crops.select("crop", "disease").distinct(), "disease")
    order = W.Window.partitionBy("crop", "region").orderBy(F.desc("votes"), "disease")
    return (joined.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == 1)
            .select("crop", "region", F.col("disease").alias("likely")))


def region_swap(items: DataFrame, best: DataFrame, localizable: DataFrame) -> DataFrame:
    """Does the prior's answer change when an item is moved to another region?

    Localizable diseases should flip, the others stay. Answers are per (crop, disease, region),
    so items are counted per class and region before regions are swapped; the number of
    regions is that of the prior.
    """
    classes = items.groupBy("crop", "disease", "region").agg(F.count("*").alias("n_items"))
    here = best.withColumnRenamed("likely", "here")
    there = best.select("crop", F.col("region").alias("moved_to"), F.col("likely").alias("there"))
    swapped = (classes.join(here, ["crop", "region"]).join(there, "crop")
               .filter(F.col("region") != F.col("moved_to"))
               .join(localizable.select("disease", "localizable"), "disease", "left"))
    flips = F.col("here") != F.col("there")
    local = F.coalesce(F.col("localizable"), F.lit(False))
    return (swapped.groupBy("region", "moved_to")
            .agg(F.sum("n_items").alias("n_items"),
                 F.coalesce(F.sum(F.when(flips, F.col("n_items"))), F.lit(0)).alias("n_flipped"),
                 F.coalesce(F.sum(F.when(flips == local, F.col("n_items"))), F.lit(0))
                 .alias("n_expected")))
