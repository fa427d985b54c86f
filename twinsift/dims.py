"""Small fixed dimensions as DataFrames.

Each is built from the fixed tables (at most 60 rows), which is the proven bound behind the
broadcast hints used with them. They are built once per session.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift import fixed_values as fv


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """An inline table: its exact size is known to the optimizer, and no job builds it."""
    def literal(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return "'" + value.replace("'", "\\'") + "'"
        return f"{value}D" if isinstance(value, float) else str(value)

    names, types = zip(*(field.split() for field in schema.split(", ")))
    values = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
    return table.select(*[F.col(n).cast(k).alias(n) for n, k in zip(names, types)])


@cache
def states(spark: SparkSession) -> DataFrame:
    rows = [(name, name.lower(), fips, usps, lat, lon, division, fv.CENSUS_REGIONS.get(division))
            for name, fips, usps, lat, lon, division in fv.US_STATES]
    return _frame(spark, rows, "name string, state_key string, fips int, usps string, "
                               "state_lat double, state_lon double, division string, region string")


@cache
def koppen(spark: SparkSession) -> DataFrame:
    rows = [(i, code, fv.KOPPEN_MAJOR_NAMES[code[0]]) for i, code in fv.KOPPEN_CODES.items()]
    return _frame(spark, rows, "class_id int, koppen_code string, koppen_name string")


@cache
def legend(spark: SparkSession) -> DataFrame:
    """All legends in one long table: (legend, code, label)."""
    rows = [("koppen", str(i), code) for i, code in fv.KOPPEN_CODES.items()]
    rows += [("land_cover", str(k), v) for k, v in fv.LAND_COVER.items()]
    rows += [("bioclim", k, v) for k, v in fv.BIOCLIM_NAMES.items()]
    rows += [("division_region", k, v) for k, v in fv.CENSUS_REGIONS.items()]
    rows += [("fips_state", str(r[1]), r[0]) for r in fv.US_STATES]
    return _frame(spark, rows, "legend string, code string, label string")


@cache
def personas(spark: SparkSession) -> DataFrame:
    """The curated personas in id order, with their position.

    A neutral baseline per personality plus single-axis stressors, cut to the fixed count.
    """
    axis = _frame(spark, [(p,) for p in fv.PERSONALITIES], "personality string")
    base = (fv.BASE_LANGUAGE, fv.BASE_RECALL, fv.BASE_CONFUSION)
    variants = [base]
    variants += [(x, base[1], base[2]) for x in fv.STRESS_LANGUAGES]
    variants += [(base[0], x, base[2]) for x in fv.STRESS_RECALLS]
    variants += [(base[0], base[1], x) for x in fv.STRESS_CONFUSIONS]
    levels = F.explode(F.array(*[
        F.struct(F.lit(a).alias("language_proficiency"), F.lit(b).alias("recall"),
                 F.lit(c).alias("confusion")) for a, b, c in variants]))
    rows = (axis.withColumn("v", levels).select("personality", "v.*")
            .withColumn("persona_id", F.concat_ws(
                ".", "personality", "language_proficiency", "recall", "confusion"))
            .dropDuplicates(["persona_id"]).orderBy("persona_id").limit(fv.N_PERSONAS))
    ids = F.array_sort(F.collect_list("persona_id"))
    order = rows.agg(ids.alias("ids")).select(F.posexplode("ids").alias("position", "persona_id"))
    return rows.join(F.broadcast(order), "persona_id")
