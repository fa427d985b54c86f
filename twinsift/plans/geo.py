"""Geocoding, zones, grids and composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsift.functions import geo as gx
from twinsift.operators import audit, geo
from twinsift.plans import lenses
from twinsift.plans import sqltext as s
from twinsift.plans.registry import query
from twinsift.session import scratch_path
from twinsift.sources import readers

c = F.col

s.add_lens("v_gaz", """v_gaz AS (
  SELECT s.usps, lower(n_name) AS county, n_nationkey + 20.5::DOUBLE AS county_lat,
    -70.25::DOUBLE - n_nationkey AS county_lon FROM nation JOIN us_states s ON s.fips = n_nationkey + 1
  WHERE n_nationkey % 6 <> 5 AND s.usps IS NOT NULL)""", ("us_states",))


@query("read_gazetteer", s.with_lenses("v_gaz", "SELECT usps, county, county_lat, county_lon FROM v_gaz"))
def read_gazetteer(t):
    path = scratch_path(t.spark, "gazetteer")
    raw = lenses.gazetteer_raw(t)
    (raw.select("USPS", F.lit("0").alias("GEOID"), F.lit("9").alias("ANSICODE"), "NAME", F.lit("1").alias("ALAND"),
                F.lit("2").alias("AWATER"), "INTPTLAT", c("INTPTLONG").alias("INTPTLONG "))
     .write.option("sep", "\t").option("header", "true").option("encoding", "ISO-8859-1")
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))
    return geo.gazetteer(readers.gazetteer_tsv(t.spark, path))


# County is found by the given "parish" county or by a "... County" part of the location.
s.add_lens("v_ladder", """v_ladder AS (
  SELECT g.row_id, g.o_orderdate, has_point AND plat <> 0 AND plon <> 0 AS p, plat, plon, county_lat, county_lon,
    CASE WHEN g.row_id % 7 <> 0 THEN g.state_lat END AS slat, CASE WHEN g.row_id % 7 <> 0 THEN g.state_lon END AS slon,
    CASE WHEN has_point AND plat <> 0 AND plon <> 0 THEN 'point' WHEN county_lat IS NOT NULL THEN 'county'
      WHEN g.row_id % 7 <> 0 AND g.state_lat IS NOT NULL THEN 'state' ELSE 'none' END AS geo_precision
  FROM v_geo g LEFT JOIN v_gaz z ON g.row_id % 7 <> 0 AND z.usps = g.usps AND z.county = lower(g.n_name)
    AND (g.row_id % 5 = 0 OR contains(location, 'County')))""", ("v_geo", "v_gaz"))


def _laddered(t):
    return geo.geo_ladder(lenses.geo_rows(t), geo.gazetteer(lenses.gazetteer_raw(t)))


@query("geo_ladder", s.with_lenses("v_ladder", """
SELECT row_id, geo_precision, round(CASE geo_precision WHEN 'point' THEN plat WHEN 'county' THEN county_lat
    WHEN 'state' THEN slat END, 6) AS geo_lat,
  round(CASE geo_precision WHEN 'point' THEN plon WHEN 'county' THEN county_lon WHEN 'state' THEN slon END, 6)
    AS geo_lon, CASE geo_precision WHEN 'point' THEN 'given_point' WHEN 'county' THEN 'county_centroid'
    WHEN 'state' THEN 'state_centroid' END AS geo_source FROM v_ladder"""))
def geo_ladder(t):
    return _laddered(t).select("row_id", "geo_precision", "geo_lat", "geo_lon", "geo_source")


@query("temporal_fields", s.with_lenses("v_ladder", """
SELECT row_id, year(o_orderdate) AS year, month(o_orderdate) AS month,
  ['winter','spring','summer','autumn'][(month(o_orderdate) % 12 // 3 + CASE WHEN geo_precision = 'point' AND plat < 0
    THEN 2 ELSE 0 END) % 4 + 1] AS season FROM v_ladder"""))
def temporal_fields(t):
    day = gx.parse_date(F.date_format("o_orderdate", "MM/dd/yyyy"))
    return _laddered(t).select("row_id", F.year(day).alias("year"), F.month(day).alias("month"),
                               gx.season(F.month(day), c("geo_lat")).alias("season"))


@query("precision_distribution", s.with_lenses("v_ladder", """
SELECT geo_precision, count(*) AS n, count(DISTINCT CASE geo_precision WHEN 'point' THEN (plat, plon)
  WHEN 'county' THEN (county_lat, county_lon) WHEN 'state' THEN (slat, slon) END) AS n_points
FROM v_ladder GROUP BY ALL"""))
def precision_distribution(t):
    return _laddered(t).groupBy("geo_precision").agg(
        F.count("*").alias("n"), F.countDistinct("geo_lat", "geo_lon").alias("n_points"))


@query("distinct_points", s.with_lenses("v_points", """
SELECT DISTINCT round(lat, 6) AS lat, round(lon, 6) AS lon FROM v_points"""))
def distinct_points(t):
    return geo.distinct_points(lenses.points(t))


_CELL = "CAST(floor((90 - lat) / 10) AS INT) AS r, CAST(floor((lon + 180) / 10) AS INT) AS k"
s.add_lens("v_sampled", f"""v_keyed AS (
  SELECT row_id, round(lat, 6) AS lat, round(lon, 6) AS lon, {_CELL} FROM v_points),
v_sampled AS (SELECT p.row_id, p.lat, p.lon, max(CASE WHEN value <> -9999 AND layer = 'bio1' THEN value END) AS bio1,
    max(CASE WHEN value <> -9999 AND layer = 'bio2' THEN value END) AS bio2,
    max(CASE WHEN value <> -9999 AND layer = 'bio3' THEN value END) AS bio3
  FROM v_keyed p LEFT JOIN v_cells x ON x.row = r AND x.col = k GROUP BY ALL)""", ("v_points", "v_cells"))
LAYERS = ["bio1", "bio2", "bio3"]


@query("grid_sample", s.with_lenses("v_sampled", "SELECT DISTINCT lat, lon, bio1, bio2, bio3 FROM v_sampled"))
def grid_sample(t):
    return geo.grid_sample(geo.distinct_points(lenses.points(t)), lenses.cells(t), LAYERS, 10.0)


@query("attach_features", s.with_lenses("v_sampled", "SELECT row_id, lat, lon, bio1, bio2, bio3 FROM v_sampled"))
def attach_features(t):
    rows = lenses.points(t)
    features = geo.grid_sample(geo.distinct_points(rows), lenses.cells(t), LAYERS, 10.0)
    return geo.attach_features(rows, features).select("row_id", "lat", "lon", *LAYERS)


@query("grid_sample_fallback", s.with_lenses("v_sampled", """
, coarse AS (SELECT row // 2 AS r2, col // 2 AS k2, max(value) AS v FROM v_cells WHERE layer = 'bio2' GROUP BY ALL)
SELECT DISTINCT lat, lon, coalesce(nullif(bio1, 0), nullif(v, -9999)) AS bio1, CASE WHEN coalesce(bio1, 0) <> 0 THEN 'fine'
  WHEN nullif(v, -9999) IS NOT NULL THEN 'coarse' ELSE 'none' END AS source
FROM v_sampled LEFT JOIN coarse ON r2 = CAST(floor((90 - lat) / 20) AS INT)
  AND k2 = CAST(floor((lon + 180) / 20) AS INT)"""))
def grid_sample_fallback(t):
    cells = lenses.cells(t)
    coarse = (cells.filter("layer = 'bio2'")
              .groupBy(F.floor(c("row") / 2).cast("int").alias("row"), F.floor(c("col") / 2).cast("int").alias("col"))
              .agg(F.max("value").alias("value"), F.first("nodata").alias("nodata"))
              .withColumn("layer", F.lit("bio1")))
    return geo.grid_sample_fallback(geo.distinct_points(lenses.points(t)), cells, 10.0, coarse, 20.0,
                                    "bio1").select("lat", "lon", "bio1", "source")


def _samples(t):
    return t.events.select(c("event_id").alias("sample_id"), "ts", "value", c("event_type").alias("band"),
                           F.when(c("event_id") % 3 == 0, "hot").otherwise(
                               F.concat(F.lit("cell"), (c("user_id") % 40).cast("string"))).alias("cell"))


@query("temporal_composite", """
SELECT cell, n_days, round(mean, 4) AS mean, round(median, 4) AS median, round(mosaic, 4) AS mosaic FROM (
  SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE 'cell' || (user_id % 40) END AS cell, avg(value) * 0.5 AS mean,
    median(value) * 0.5 AS median, arg_max(value, (ts, event_id)) * 0.5 AS mosaic,
    count(DISTINCT CAST(ts AS DATE)) AS n_days
  FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' GROUP BY ALL)""")
def temporal_composite(t):
    hows = ("mean", "median", "mosaic")
    out = geo.temporal_composite(_samples(t), "2024-01-05 00:00:00", "2024-01-25 00:00:00", hows, 0.5)
    return out.select("cell", "n_days", *[F.round(how, 4).alias(how) for how in hows])


SPECS = (
    geo.LayerSpec("events", {"click": "click_mean", "view": "view_mean"}, "mean", "2024-01-05", "2024-01-25", 0.5),
    geo.LayerSpec("events", {"view": "view_median", "error": "error_median"}, "median", "2024-01-05", "2024-01-25"),
    geo.LayerSpec("events", {"purchase": "last_purchase"}, "mosaic", scale_factor=0.1),
)


@query("composite_layers", """
WITH e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE 'cell' || (user_id % 40) END AS cell,
    ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' AS inside FROM events)
SELECT cell, round(0.5 * avg(value) FILTER (inside AND event_type = 'click'), 4) AS click_mean,
  round(0.5 * avg(value) FILTER (inside AND event_type = 'view'), 4) AS view_mean,
  round(median(value) FILTER (inside AND event_type = 'view'), 4) AS view_median,
  round(median(value) FILTER (inside AND event_type = 'error'), 4) AS error_median,
  round(0.1 * arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase'), 4) AS last_purchase
FROM e WHERE (inside AND event_type IN ('click', 'view', 'error')) OR event_type = 'purchase' GROUP BY ALL""")
def composite_layers(t):
    out = geo.composite_layers(_samples(t).withColumn("layer", F.lit("events")), SPECS)
    return out.select("cell", *[F.round(n, 4).alias(n) for n in out.columns if n != "cell"])


@query("zonal_reduce", s.with_lenses("v_sampled", """
, hits AS (SELECT DISTINCT p.lat, p.lon, x.row, x.col, x.value FROM v_keyed p JOIN v_cells x ON layer = 'bio1'
  AND x.row BETWEEN r - 1 AND r + 1 AND x.col BETWEEN k - 1 AND k + 1 WHERE value <> -9999),
m AS (SELECT lat, lon, arg_min(v, (-n, v)) AS mode FROM (SELECT lat, lon, floor(value / 50) * 50 AS v, count(*) AS n
  FROM hits GROUP BY ALL) GROUP BY ALL)
SELECT lat, lon, count(*) AS n_cells, round(avg(value), 4) AS mean, round(median(value), 4) AS median,
  round(arg_min(value, (row, col)), 4) AS first, max(mode) AS mode FROM hits JOIN m USING (lat, lon) GROUP BY ALL"""))
def zonal_reduce(t):
    points = geo.distinct_points(lenses.points(t))
    cells = lenses.cells(t).filter("layer = 'bio1'")
    out = geo.zonal_reduce(points, cells, 10.0, 1, ["mean", "median", "first", "mode"], mode_step=50.0)
    return out.select("lat", "lon", "n_cells", *[F.round(k, 4).alias(k) for k in ("mean", "median", "first", "mode")])


@query("zone_band_join", s.with_lenses("v_points", f"""
SELECT row_id, {s.zone('lat', 'lon', 2)} AS zone, {s.zone('lat', 'lon', 3)} AS climate FROM v_points"""))
def zone_band_join(t):
    return lenses.zones(lenses.points(t)).select("row_id", "zone", "climate")


@query("zone_distribution", s.with_lenses("v_points", f"""
SELECT zone, count(*) AS n FROM (SELECT DISTINCT lat, lon, {s.zone('lat', 'lon', 2)} AS zone FROM v_points) GROUP BY ALL"""))
def zone_distribution(t):
    return audit.counts(lenses.zones(geo.distinct_points(lenses.points(t))), "zone")


@query("zone_polygon_join", s.with_lenses("v_points", """
, boxes AS (SELECT s_suppkey AS priority, 'zone' || s_suppkey AS zone, s_suppkey * 13 % 150 - 80 + 0.25 AS la,
    s_suppkey * 29 % 320 - 170 + 0.25 AS lo FROM supplier)
SELECT lat, lon, arg_min(zone, priority) AS zone FROM (SELECT DISTINCT round(lat, 6) AS lat, round(lon, 6) AS lon FROM v_points)
LEFT JOIN boxes ON lat >= la AND lat < la + 20 AND lon >= lo AND lon < lo + 15 + 0 * priority
  AND NOT (priority % 2 = 1 AND (lon - lo) / 15 > 1 - (lat - la) / 20) GROUP BY ALL"""))
def zone_polygon_join(t):
    la = (c("s_suppkey") * 13) % 150 - 80 + 0.25
    lo = (c("s_suppkey") * 29) % 320 - 170 + 0.25

    def vertex(lat, lon):
        return F.struct(lat.alias("lat"), lon.alias("lon"))

    box = F.array(vertex(la, lo), vertex(la, lo + 15), vertex(la + 20, lo + 15), vertex(la + 20, lo))
    triangle = F.array(vertex(la, lo), vertex(la, lo + 15), vertex(la + 20, lo))
    polygons = t.supplier.select(
        c("s_suppkey").alias("priority"), F.concat(F.lit("zone"), c("s_suppkey").cast("string")).alias("zone"),
        F.when(c("s_suppkey") % 2 == 1, triangle).otherwise(box).alias("ring"))
    return geo.zone_polygon_join(geo.distinct_points(lenses.points(t)), polygons)
