"""Geographic range facets: how well a place can be told from a name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from twinsift import fixed_values as fv
from twinsift.functions import labels


FACETS = ("country", "continent", "us_state")


def facet_counts(records: DataFrame) -> DataFrame:
    """(name, facet, value, n): records per name, and per country, continent and US state of a name.

    Records have name, country, continent and us_state. They are read once: grouping sets count
    all facets from the distinct combinations. Blank and `n/a` values make no facet.
    """
    known = records.select("name", *[F.when(~F.lower(F.coalesce(f, F.lit(""))).isin("", "n/a"), F.col(f)).alias(f)
                                     for f in FACETS])
    combined = known.groupBy("name", *FACETS).agg(F.count("*").alias("n"))
    sets = combined.groupingSets([["name"], *[["name", f] for f in FACETS]], "name", *FACETS).agg(
        F.sum("n").alias("n"), *[F.grouping(f).alias(f"_{f}") for f in FACETS])
    facet, value = F.lit("total"), F.lit("")
    for f in FACETS:
        facet = F.when(F.col(f"_{f}") == 0, f).otherwise(facet)
        value = F.when(F.col(f"_{f}") == 0, F.col(f)).otherwise(value)
    return sets.select("name", facet.alias("facet"), value.alias("value"), "n").filter("value is not null")


def range_profiles(facets: DataFrame) -> DataFrame:
    """One row per name: total, countries (largest first), effective countries, continents and US states.

    The array holds one entry per country of the world at most.
    """
    def per(facet: str, value):
        return F.when(F.col("facet") == facet, value)

    share = F.greatest(F.lit(1), F.col("total"))
    return (facets.groupBy("name")
            .agg(F.coalesce(F.max(per("total", F.col("n"))), F.lit(0)).alias("total"),
                 F.collect_list(per("country", F.struct((-F.col("n")).alias("k"), F.col("value").alias("country")))).alias("_c"),
                 F.count_if((F.col("facet") == "continent") & (F.col("n") >= fv.MIN_COUNTRY_RECORDS)).alias("n_continents"),
                 F.count_if(F.col("facet") == "us_state").alias("n_us_states"))
            .withColumn("countries", F.transform(F.array_sort("_c"), lambda x: F.struct(
                x["country"].alias("country"), (-x["k"]).alias("n"), (-x["k"] / share).alias("share"))))
            .withColumn("effective", F.filter("countries", lambda x: (x["n"] >= fv.MIN_COUNTRY_RECORDS)
                                              & (x["share"] >= fv.MIN_COUNTRY_SHARE)))
            .withColumn("n_countries", F.size("countries")).withColumn("eff_countries", F.size("effective"))
            .drop("_c"))


def effective_countries(profiles: DataFrame) -> DataFrame:
    """Country facets with enough records and share."""
    return profiles.select("name", F.explode("effective").alias("e")).select(
        "name", "e.country", "e.n", F.round("e.share", 4).alias("share"))


def top_countries(profiles: DataFrame, k: int = 8) -> DataFrame:
    """The k largest country facets of each name; ties by country."""
    return profiles.select("name", F.posexplode(F.slice("countries", 1, k)).alias("rank", "e")).select(
        "name", "e.country", "e.n", (F.col("rank") + 1).alias("rank"))


def classify_ranges(names: DataFrame, top: int = 8) -> DataFrame:
    """Restriction class, descriptive counts, nested top countries and reason per name.

    `names` are profiles with status, match_type, usage_key, rank and generalist; a name
    without a usage key has no reliable match.
    """
    joined = names.withColumn("top_countries", F.transform(
        F.slice("countries", 1, top), lambda x: F.struct(x["country"].alias("country"), x["n"].alias("n"))))
    n, c = F.col("eff_countries"), F.col("n_continents")
    generalist = labels.is_generalist(F.col("name")) | F.coalesce(F.col("generalist"), F.lit(False))
    unmatched = (~F.col("status").eqNullSafe("ok")) | F.col("match_type").isNull() | (
        F.col("match_type") == "NONE") | F.col("usage_key").isNull()
    coarse = (F.col("match_type") == "HIGHERRANK") | F.coalesce(
        (F.col("rank") != "") & ~F.col("rank").isin("SPECIES", "SUBSPECIES", "VARIETY", "FORM"),
        F.lit(False))
    sparse = F.col("total") < fv.MIN_RECORDS
    wide = (n >= fv.COSMOPOLITAN_MIN_COUNTRIES) | (c >= fv.COSMOPOLITAN_MIN_CONTINENTS)
    narrow = (n <= fv.LOCALIZED_MAX_COUNTRIES) & (c <= fv.LOCALIZED_MAX_CONTINENTS)
    rule = (F.when(generalist, "generalist").when(unmatched, "unmatched").when(coarse, "coarse")
            .when(sparse, "sparse").when(wide, "wide").when(narrow, "narrow").otherwise("between"))
    spread = F.concat(n.cast("string"), F.lit(" countries / "), c.cast("string"),
                      F.lit(" continents"))
    r = F.col("_rule")
    return (joined.withColumn("_rule", rule)
            .withColumn("restriction_class",
                        F.when(r.isin("generalist", "wide"), "cosmopolitan")
                        .when(r.isin("unmatched", "coarse", "sparse"), "data_poor")
                        .when(r == "narrow", "localized").otherwise("regional"))
            .withColumn("reason",
                        F.when(r == "generalist", "named generalist")
                        .when(r == "unmatched", "no reliable match")
                        .when(r == "coarse", "match only at a higher rank")
                        .when(r == "sparse", F.concat(F.col("total").cast("string"),
                                                      F.lit(" records are too few")))
                        .when(r == "wide", F.concat(F.lit("present in "), spread))
                        .when(r == "narrow", F.concat(F.lit("restricted to "), spread))
                        .otherwise(F.concat(F.lit("intermediate spread: "), spread)))
            .drop("_rule"))


def is_localizable(restriction_class):
    return restriction_class.isin("localized", "regional")


def range_distribution(verdicts: DataFrame, examples: int = 4) -> DataFrame:
    """Names per class, with the alphabetically first examples as joined text."""
    order = W.Window.partitionBy("restriction_class").orderBy("name")
    shown = (verdicts.withColumn("_r", F.row_number().over(order))
             .filter(F.col("_r") <= examples).groupBy("restriction_class")
             .agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("examples")))
    return (verdicts.groupBy("restriction_class").agg(F.count("*").alias("n_names"))
            .join(shown, "restriction_class"))
