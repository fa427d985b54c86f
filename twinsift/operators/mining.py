"""Candidate look-alike pairs: class aggregates first, then a class-level self-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from twinsift import dims
from twinsift import fixed_values as fv
from twinsift.functions import labels, text
from twinsift.operators.skew import row_number_in_group, salted_join
from twinsift.session import materialise

CLASS = ["crop", "disease"]


def class_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*CLASS).agg(F.count("*").alias("n_images"))


def class_registry(rows: DataFrame, minimum: int = fv.MIN_ROWS_PER_CLASS) -> DataFrame:
    return class_counts(rows).filter(F.col("n_images") >= minimum)


def descriptor_counts(rows: DataFrame) -> DataFrame:
    """Rows and first row id per (crop, disease, descriptor)."""
    return rows.groupBy(*CLASS, "descriptor").agg(
        F.count("*").alias("n"), F.min("row_id").alias("first_row"))


def top_descriptors(rows: DataFrame, k: int = 4) -> DataFrame:
    """The k most common descriptors of each class; ties go to the one seen first."""
    order = W.Window.partitionBy(*CLASS).orderBy(F.desc("n"), "first_row")
    return (descriptor_counts(rows).withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k).drop("first_row"))


def dominant_name(rows: DataFrame) -> DataFrame:
    """Most common organism name per class; ties go to the one seen first."""
    name = F.coalesce(text.present(F.col("path_sci")), text.present(F.col("path_common")))
    counts = (rows.withColumn("sci_name", name).filter(F.col("sci_name").isNotNull())
              .groupBy(*CLASS, "sci_name")
              .agg(F.count("*").alias("n"), F.min("row_id").alias("first_row")))
    order = W.Window.partitionBy(*CLASS).orderBy(F.desc("n"), "first_row")
    return (counts.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == 1)
            .select(*CLASS, "sci_name", "n"))


def class_features(rows: DataFrame, minimum: int = fv.MIN_ROWS_PER_CLASS) -> DataFrame:
    """One row per eligible class. Sets hold closed vocabularies (descriptors, states).

    A missing state is the empty string and counts as a state of its own.
    """
    first_name = F.min_by(
        F.coalesce(F.when(F.col("path_sci") != "", F.col("path_sci")), F.col("path_common")),
        F.col("row_id"))
    return (rows.groupBy(*CLASS)
            .agg(F.count("*").alias("n_imgs"),
                 F.collect_set("descriptor").alias("descriptors"),
                 F.collect_set("state").alias("states"),
                 first_name.alias("first_name"))
            .filter(F.col("n_imgs") >= minimum)
            .withColumn("pathogen_class", labels.pathogen_class(F.col("first_name")))
            .drop("first_name"))


def mine_pairs(rows: DataFrame, minimum: int = fv.MIN_ROWS_PER_CLASS) -> DataFrame:
    """Every unordered pair of eligible classes of a crop, with its look-alike prior.

    The self-join input is one row per class. Rows of a crop with very many classes are
    spread by salt, since that join multiplies rather than its input being large.
    """
    features = class_features(rows, minimum)
    a = features.select(
        "crop", F.col("disease").alias("member_a"), F.col("n_imgs").alias("n_imgs_a"),
        F.col("descriptors").alias("_da"), F.col("states").alias("_sa"),
        F.col("pathogen_class").alias("class_a"))
    b = features.select(
        "crop", F.col("disease").alias("member_b"), F.col("n_imgs").alias("n_imgs_b"),
        F.col("descriptors").alias("_db"), F.col("states").alias("_sb"),
        F.col("pathogen_class").alias("class_b"))
    pairs = (salted_join(a, b, ["crop"], ["member_a"])
             .filter(F.col("member_a") < F.col("member_b"))
             .withColumn("shared_descriptors",
                         F.array_sort(F.array_intersect("_da", "_db")))
             .withColumn("shared_states", F.array_sort(F.array_intersect("_sa", "_sb"))))
    same = F.col("class_a") == F.col("class_b")
    prior = (F.size("shared_descriptors") + F.when(same, 2).otherwise(0)
             + F.size("shared_states") / 10.0)
    return pairs.select(
        text.pair_id(F.col("crop"), F.col("member_a"), F.col("member_b")).alias("pair_id"),
        "crop", "member_a", "member_b", "n_imgs_a", "n_imgs_b", "class_a", "class_b",
        "shared_descriptors", same.alias("same_pathogen_class"), "shared_states",
        F.round(prior, 3).alias("lookalike_prior"))


def with_shared_regions(pairs: DataFrame) -> DataFrame:
    """Census regions of the shared states, as a sorted array without repeats."""
    regions = {r[0]: fv.CENSUS_REGIONS[r[5]] for r in fv.US_STATES if r[5]}
    found = F.transform("shared_states", lambda s: text.lookup(s, regions))
    return pairs.withColumn("shared_regions", F.array_sort(F.array_distinct(F.array_compact(found))))


def rank_pairs(pairs: DataFrame, top: int | None = None) -> DataFrame:
    """Pairs by falling prior, pair id as the tie-break; the top report if `top` is given."""
    ordered = pairs.orderBy(F.desc("lookalike_prior"), "pair_id")
    return ordered.limit(top) if top else ordered


def placed_pairs(pairs: DataFrame) -> DataFrame:
    """All pairs with their `place` in the order of rank_pairs.

    Places come from ranges of the order: each is numbered on its own and the sizes of the ranges
    before it are added.
    """
    order = [F.desc("lookalike_prior"), F.col("pair_id")]
    ranged = materialise(pairs.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranked")
    return row_number_in_group(ranged.withColumn("_all", F.lit(0)), ["_all"], F.col("_range"), order, "place").drop(
        "_all", "_range")


def nested_pairs(pairs: DataFrame, rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Pair records in their nested form, members with their top descriptors.

    With `names` (crop, disease, sci_name) members have their scientific name, too.
    """
    top = (top_descriptors(rows).groupBy(*CLASS)
           .agg(F.array_sort(F.collect_list(F.struct("rank", "descriptor", "n"))).alias("_t"))
           .select(*CLASS, F.transform("_t", lambda t: F.struct(
               t["descriptor"].alias("name"), t["n"].alias("n"))).alias("descriptors")))

    extra = [] if names is None else ["sci_name"]
    if extra:
        top = top.join(names.select(*CLASS, *extra), CLASS, "left")

    def member(side: str) -> DataFrame:
        return top.select("crop", F.col("disease").alias(f"member_{side}"),
                          F.col("descriptors").alias(f"_desc_{side}"),
                          *[F.col(n).alias(f"_{n}_{side}") for n in extra])

    out = with_shared_regions(pairs)
    for side in ("a", "b"):
        out = out.join(member(side), ["crop", f"member_{side}"], "left")
        out = out.withColumn(f"_m_{side}", F.struct(
            F.col(f"member_{side}").alias("disease"), F.col(f"n_imgs_{side}").alias("n_imgs"),
            F.col(f"class_{side}").alias("pathogen_class"),
            F.col(f"_desc_{side}").alias("descriptors"),
            *[F.col(f"_{n}_{side}").alias(n) for n in extra]))
    return out.select("pair_id", "crop", F.col("_m_a").alias("member_a"),
                      F.col("_m_b").alias("member_b"), "shared_descriptors",
                      "same_pathogen_class", "shared_states", "shared_regions",
                      "lookalike_prior")


def same_organism_drop(confirmed: DataFrame, names: DataFrame) -> DataFrame:
    """Withdraw confirmation from pairs whose members are one organism, with the reason."""
    a = names.select("crop", F.col("disease").alias("member_a"), F.col("sci_name").alias("_na"))
    b = names.select("crop", F.col("disease").alias("member_b"), F.col("sci_name").alias("_nb"))
    joined = (confirmed.join(a, ["crop", "member_a"], "left")
              .join(b, ["crop", "member_b"], "left"))
    same = F.col("confirmed") & labels.same_organism(F.col("_na"), F.col("_nb"))
    return (joined.withColumn("dropped_reason", F.when(same, "same organism (synonym)"))
            .withColumn("confirmed", F.col("confirmed") & F.col("dropped_reason").isNull())
            .drop("_na", "_nb"))


def state_centroids(df: DataFrame, state_col: str) -> DataFrame:
    """Add state_lat and state_lon by name; one retry without dots and with "saint "."""
    key = F.lower(text.strip(F.coalesce(F.col(state_col), F.lit(""))))
    retry = F.replace(F.replace(key, F.lit("."), F.lit("")), F.lit("st "), F.lit("saint "))
    table = dims.states(df.sparkSession).select("state_key", "state_lat", "state_lon")
    again = table.toDF("_retry", "_lat2", "_lon2")
    return (df.withColumn("state_key", key).withColumn("_retry", retry)
            .join(F.broadcast(table), "state_key", "left")
            .join(F.broadcast(again), "_retry", "left")
            .withColumn("state_lat", F.coalesce("state_lat", "_lat2"))
            .withColumn("state_lon", F.coalesce("state_lon", "_lon2"))
            .drop("state_key", "_retry", "_lat2", "_lon2"))


def decode_states(df: DataFrame, code_col: str, name: str) -> DataFrame:
    """Canonical state name from a "us_<FIPS>" token, a bare FIPS number or a known name."""
    raw = text.strip(F.coalesce(F.col(code_col), F.lit("")))
    names = [r[0].lower() for r in fv.US_STATES]
    is_name = F.lower(raw).isin(*names)
    as_given = F.when(raw == F.lower(raw), F.initcap(raw)).otherwise(raw)
    digits = F.regexp_replace(F.replace(F.lower(raw), F.lit("us_"), F.lit("")),
                              r"\A[us]+|\A[us]*[ _]+|[ _]+\z", "")
    number = F.when(digits.rlike(r"\A[0-9]+\z"), digits.try_cast("int"))
    table = dims.states(df.sparkSession).select(
        F.col("fips").alias("_fips"), F.col("name").alias("_name"))
    return (df.withColumn("_fips", number).join(F.broadcast(table), "_fips", "left")
            .withColumn(name, F.when(is_name, as_given).otherwise(F.col("_name")))
            .drop("_fips", "_name"))
