"""Geocoding ladder, grid sampling, zonal and temporal reduction, zone joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift import dims
from twinsift import fixed_values as fv
from twinsift.functions import geo, text
from twinsift.operators.skew import checked_join, exact_median, lookup

POINT = ["lat", "lon"]


def gazetteer(raw: DataFrame) -> DataFrame:
    """(usps, county) -> centroid from raw text columns; the last row per key wins.

    `raw` has row_id, USPS, NAME, INTPTLAT, INTPTLONG as text. Rows without readable
    coordinates are skipped; the county suffix is dropped.
    """
    name = F.lower(text.strip(F.regexp_replace(
        text.strip(F.col("NAME")), r"(?i)\s+(County|Parish|Borough|Census Area|Municipio)\z", "")))
    rows = raw.select(
        "row_id", text.strip(F.col("USPS")).alias("usps"), name.alias("county"),
        text.strip(F.col("INTPTLAT")).try_cast("double").alias("county_lat"),
        text.strip(F.col("INTPTLONG")).try_cast("double").alias("county_lon"))
    return (rows.filter((F.col("usps") != "") & (F.col("county") != "")
                        & F.col("county_lat").isNotNull() & F.col("county_lon").isNotNull())
            .groupBy("usps", "county")
            .agg(F.max_by(F.struct("county_lat", "county_lon"), "row_id").alias("p"))
            .select("usps", "county", "p.county_lat", "p.county_lon"))


def geo_ladder(rows: DataFrame, counties: DataFrame) -> DataFrame:
    """Resolve every row to a point by the ladder point > county > state > none.

    `rows` has row_id, lat_text, lon_text, state, county, location; `counties` is a gazetteer.
    A coordinate of exactly zero counts as missing.
    """
    lat, lon = F.col("_lat"), F.col("_lon")
    has_point = F.coalesce((lat != 0) & (lon != 0), F.lit(False))
    names = [r[0].lower() for r in fv.US_STATES]
    # Blank text is sorted out before the cast: a failing cast is slow.
    parted = rows.withColumns({
        "_lat": text.present(F.col("lat_text")).try_cast("double"),
        "_lon": text.present(F.col("lon_text")).try_cast("double"),
        "_parts": F.transform(F.split(F.coalesce(F.col("location"), F.lit("")), ","), text.strip)})
    lowered = F.transform("_parts", lambda p: F.lower(p))
    own_state = F.lower(text.strip(F.coalesce(F.col("state"), F.lit(""))))
    state_key = F.when(own_state.isin(*names), own_state).otherwise(
        F.get(F.filter(lowered, lambda p: p.isin(*names)), F.lit(0)))
    given = F.regexp_replace(F.lower(text.strip(F.coalesce(F.col("county"), F.lit("")))),
                             r"\s+(county|parish|borough)\z", "")
    named = F.get(F.filter("_parts", lambda p: F.lower(p).contains("county")
                           & p.rlike(r"(?i)\bcounty\b")), F.lit(0))
    recovered = F.lower(F.regexp_replace(named, r"(?i)\s+county\z", ""))
    keyed = parted.withColumns({
        "state_key": state_key,
        "_county": F.when(given != "", given).otherwise(recovered)}).drop("_parts")
    states = dims.states(rows.sparkSession)
    with_state = keyed.join(
        F.broadcast(states.select("state_key", "usps", "state_lat", "state_lon")),
        "state_key", "left")
    found = checked_join(with_state, counties.withColumnRenamed("county", "_county"),
                         ["usps", "_county"], "left")
    in_county = F.col("county_lat").isNotNull()
    in_state = F.col("state_lat").isNotNull()

    def pick(point, county, state):
        return F.when(has_point, point).when(in_county, county).when(in_state, state)

    return found.withColumns({
        "geo_lat": F.round(pick(lat, F.col("county_lat"), F.col("state_lat")), 6),
        "geo_lon": F.round(pick(lon, F.col("county_lon"), F.col("state_lon")), 6),
        "geo_precision": F.coalesce(
            pick(F.lit("point"), F.lit("county"), F.lit("state")), F.lit("none")),
        "geo_source": pick(F.lit("given_point"), F.lit("county_centroid"),
                           F.lit("state_centroid")),
    }).drop("_lat", "_lon", "_county", "usps", "state_key", "county_lat", "county_lon",
            "state_lat", "state_lon")


def distinct_points(rows: DataFrame) -> DataFrame:
    """Each point once, rounded to six decimals."""
    return (rows.select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))
            .filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).distinct())


def wide_cells(cells: DataFrame, layers: Sequence[str]) -> DataFrame:
    """One row per cell with a column per layer; nodata becomes null."""
    value = F.when(~F.col("value").eqNullSafe(F.col("nodata")), F.col("value"))
    return (cells.filter(F.col("layer").isin(*layers)).groupBy("row", "col")
            .agg(*[F.max(F.when(F.col("layer") == name, value)).alias(name) for name in layers]))


def grid_sample(points: DataFrame, cells: DataFrame, layers: Sequence[str],
                res: float) -> DataFrame:
    """Value of every layer in the cell under each point.

    Only cells under some point are made wide, so the raster is cut down before it moves.
    """
    keyed = (points.withColumn("row", geo.cell_row(F.col("lat"), res))
             .withColumn("col", geo.cell_col(F.col("lon"), res)))
    met = cells.join(keyed.select("row", "col").distinct(), ["row", "col"], "left_semi")
    return keyed.join(wide_cells(met, layers), ["row", "col"], "left").drop("row", "col")


def grid_sample_fallback(points: DataFrame, fine: DataFrame, fine_res: float,
                         coarse: DataFrame, coarse_res: float, layer: str) -> DataFrame:
    """Fine value, or the coarse one where the fine grid holds zero or nothing."""
    f = grid_sample(points, fine, [layer], fine_res).withColumnRenamed(layer, "_fine")
    both = grid_sample(f, coarse, [layer], coarse_res)
    return (both.withColumn("source", F.when(F.coalesce("_fine", F.lit(0.0)) != 0, "fine")
                            .when(F.col(layer).isNotNull(), "coarse").otherwise("none"))
            .withColumn(layer, F.coalesce(F.nullif("_fine", F.lit(0.0)), layer)).drop("_fine"))


def attach_features(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Features of each distinct point back on all rows; missing where there are none."""
    keyed = rows.withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))
    return lookup(keyed, features, POINT, ["row_id"])


def temporal_composite(samples: DataFrame, start: str, end: str, hows: Sequence[str],
                       scale_factor: float = 1.0) -> DataFrame:
    """Per-cell composites of a time layer (cell, ts, value) over [start, end), and its n_days.

    Each of `hows` gives a column: mean, median, or mosaic (the latest value, by ts then sample
    id). All but the median come from one aggregation.
    """
    span = samples.filter((F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
                          & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
    known = {"mean": F.avg("value"), "mosaic": F.max_by("value", F.struct("ts", "sample_id"))}
    out = span.groupBy("cell").agg(
        F.countDistinct(F.to_date("ts")).alias("n_days"),
        *[known[how].alias(how) for how in hows if how in known])
    if "median" in hows:
        out = out.join(exact_median(span, ["cell"], "value", "median"), "cell", "left")
    return out.select("cell", "n_days", *[(F.col(how) * scale_factor).alias(how) for how in hows])


@dataclass(frozen=True)
class LayerSpec:
    """Bands of one layer with their output names, and how its samples become one image.

    `how` is mean, median, mosaic (the latest sample by ts, then sample id) or "" for an image
    without times; start and end (exclusive) may be left out.
    """

    layer: str
    bands: dict[str, str]
    how: str = ""
    start: str | None = None
    end: str | None = None
    scale_factor: float = 1.0


def composite_layers(samples: DataFrame, specs: Sequence[LayerSpec]) -> DataFrame:
    """One row per cell with a column for every band of every spec, renamed and scaled.

    Samples are (layer, band, cell, ts, sample_id, value). Bands that no spec names are left out
    before anything moves; all but the medians come from one aggregation.
    """
    def chosen(spec: LayerSpec) -> Column:
        rule = (F.col("layer") == spec.layer) & F.col("band").isin(*spec.bands)
        for edge, bound in ((spec.start, F.col("ts").__ge__), (spec.end, F.col("ts").__lt__)):
            if edge:
                rule = rule & bound(F.lit(edge).cast("timestamp_ntz"))
        return rule

    used = samples.filter(reduce(or_, map(chosen, specs)))
    plain, medians, order = [], [], []
    for spec in specs:
        for band, out in spec.bands.items():
            order.append((out, spec.scale_factor))
            hit = chosen(spec) & (F.col("band") == band)
            value, latest = F.when(hit, F.col("value")), F.when(hit, F.struct("ts", "sample_id"))
            if spec.how == "median":
                medians.append(F.when(hit, F.struct(F.lit(out).alias("out"), F.col("value").alias("v"))))
            else:
                plain.append((F.avg(value) if spec.how == "mean" else F.max_by("value", latest)).alias(out))
    wide = used.groupBy("cell").agg(F.count("*").alias("n_samples"), *plain)
    if medians:
        long = used.select("cell", F.explode(F.array_compact(F.array(*medians))).alias("m")).select("cell", "m.out", "m.v")
        found = exact_median(long, ["cell", "out"], "v", "v").groupBy("cell").agg(
            *[F.max(F.when(F.col("out") == out, F.col("v"))).alias(out)
              for spec in specs if spec.how == "median" for out in spec.bands.values()])
        wide = wide.join(found, "cell", "left")
    return wide.select("cell", *[(F.col(out) * factor).alias(out) for out, factor in order])


def zonal_reduce(points: DataFrame, cells: DataFrame, res: float, reach: int,
                 reducers: Sequence[str], mode_step: float | None = None) -> DataFrame:
    """Reduce the cells within `reach` rows and columns of each point; nodata is left out.

    One join serves all reducers, each of which gives a column of its name. A group holds at most
    (2 * reach + 1) squared cells. Ties of the mode go to the smallest value; `mode_step` floors
    continuous values to its multiples first. An unknown reducer means mean; `first` is the
    northernmost, then westernmost cell.
    """
    offsets = F.sequence(F.lit(-reach), F.lit(reach))
    around = (points.withColumn("row", F.explode(F.transform(
                  offsets, lambda d: geo.cell_row(F.col("lat"), res) + d)))
              .withColumn("col", F.explode(F.transform(
                  offsets, lambda d: geo.cell_col(F.col("lon"), res) + d))))
    valued = cells.filter(~F.col("value").eqNullSafe(F.col("nodata"))).select("row", "col", "value")
    stepped = F.floor(F.col("value") / mode_step) * mode_step if mode_step else F.col("value")
    known = {
        "median": F.median("value"),
        "mode": F.mode(stepped, True),
        "first": F.min_by("value", F.struct("row", "col")),
    }
    return around.join(valued, ["row", "col"]).groupBy(*POINT).agg(
        F.count("*").alias("n_cells"),
        *[known.get(name, F.avg("value")).alias(name) for name in reducers])


def zone_polygon_join(points: DataFrame, polygons: DataFrame, res: float = 10.0) -> DataFrame:
    """First polygon (by priority) that contains each point; null where there is none.

    `polygons` has priority (unique), zone and ring, an array of (lat, lon) structs. Polygons are
    laid on a grid by their bounding box, so candidates meet by cell instead of by nested loops;
    rings are fetched for the candidates only.
    """
    lats, lons = F.transform("ring", lambda v: v["lat"]), F.transform("ring", lambda v: v["lon"])
    boxed = (polygons
             .withColumn("row", F.explode(F.sequence(
                 geo.cell_row(F.array_max(lats), res), geo.cell_row(F.array_min(lats), res))))
             .withColumn("col", F.explode(F.sequence(
                 geo.cell_col(F.array_min(lons), res), geo.cell_col(F.array_max(lons), res)))))
    keyed = (points.withColumn("row", geo.cell_row(F.col("lat"), res))
             .withColumn("col", geo.cell_col(F.col("lon"), res)))
    candidates = keyed.join(boxed.select("row", "col", "priority"), ["row", "col"])
    hits = (candidates.join(polygons, "priority")
            .filter(geo.in_ring(F.col("lat"), F.col("lon"), F.col("ring")))
            .groupBy(*POINT).agg(F.min_by("zone", "priority").alias("zone")))
    return points.join(hits, POINT, "left")
