"""Geographic priors and evaluation measures (documented aims without shipped code)."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsift import dims
from twinsift import fixed_values as fv
from twinsift.functions import geo as gx
from twinsift.operators import geoeval, items, similarity, splits
from twinsift.plans import lenses, pipeline
from twinsift.plans import sqltext as s
from twinsift.plans.registry import query
from twinsift.session import materialise

c = F.col

s.add_lens("v_placed", """v_placed AS (
  SELECT v.*, s.region, s.state_lat AS true_lat, s.state_lon AS true_lon, s.division,
    s2.state_lat AS said_lat, s2.state_lon AS said_lon, s2.division AS said_division, s2.name AS said_state,
    row_id % 4 <> 0 AS correct
  FROM v_split v JOIN us_states s ON s.name = v.state
  LEFT JOIN us_states s2 ON s2.fips = CASE WHEN row_id % 4 <> 0 THEN s.fips ELSE row_id % 48 + 1 END)""",
    ("v_split",))
s.add_lens("v_prior", """v_prior AS (
  SELECT disease, region, count(DISTINCT contributor) AS votes FROM v_placed
  WHERE split = 'train' AND region IS NOT NULL GROUP BY ALL)""", ("v_placed",))


def placed(t):
    """Rows with their split and state; answers name the right state three times in four."""
    state = dims.states(t.spark)
    true = state.select(c("name").alias("state"), c("fips").alias("_f"), "region", "division",
                        c("state_lat").alias("true_lat"), c("state_lon").alias("true_lon"))
    said = state.select(c("fips").alias("_s"), c("name").alias("said_state"), c("division").alias("said_division"),
                        c("state_lat").alias("said_lat"), c("state_lon").alias("said_lon"))
    rows = splits.assign_splits(lenses.image_rows(t)).join(F.broadcast(true), "state")
    correct = c("row_id") % 4 != 0
    return (rows.withColumn("correct", correct)
            .withColumn("_s", F.when(correct, c("_f")).otherwise((c("row_id") % 48 + 1).cast("int")))
            .join(F.broadcast(said), "_s", "left").drop("_s", "_f"))


def prior(t):
    return geoeval.geo_prior(placed(t).filter(c("region").isNotNull()))


@query("geo_prior", s.with_lenses("v_prior", """
SELECT disease, region, votes, round(votes / sum(votes) OVER (PARTITION BY disease), 4) AS prior FROM v_prior"""))
def geo_prior(t):
    return prior(t)


@query("locations_per_disease", s.with_lenses("v_placed", """
SELECT n_regions, count(*) AS n_diseases, n_regions = 1 AS single_region FROM (
  SELECT disease, count(DISTINCT region) AS n_regions FROM (SELECT crop || disease || descriptor AS disease, region
    FROM v_placed WHERE region IS NOT NULL) GROUP BY disease) GROUP BY ALL"""))
def locations_per_disease(t):
    return geoeval.locations_per_disease(placed(t).withColumn("disease", F.concat("crop", "disease", "descriptor")))


@query("tier_accuracy", s.with_lenses("v_placed", """
SELECT 'country' AS tier, count(*) AS n, round(avg(CAST(said_state IS NOT NULL AS INT)), 4) AS accuracy FROM v_placed
UNION ALL SELECT 'admin1', count(*), round(avg(CAST(said_state = state AS INT)), 4) FROM v_placed
UNION ALL SELECT 'zone', count(*), round(avg(CAST(said_division = division AS INT)), 4) FROM v_placed"""))
def tier_accuracy(t):
    answers = placed(t).select(
        F.lit(True).alias("true_country"), c("said_state").isNotNull().alias("said_country"),
        c("state").alias("true_admin1"), c("said_state").alias("said_admin1"),
        c("division").alias("true_zone"), c("said_division").alias("said_zone"))
    return geoeval.tier_accuracy(answers)


_KM = """2 * 6371 * asin(least(1, sqrt(pow(sin(radians(said_lat - true_lat) / 2), 2) + cos(radians(true_lat))
  * cos(radians(said_lat)) * pow(sin(radians(said_lon - true_lon) / 2), 2))))"""


@query("geodesic_error", s.with_lenses("v_placed", f"""
SELECT split, count(*) AS n, round(count(*) FILTER (km <= 25) / count(*), 4) AS within_25_km,
  round(count(*) FILTER (km <= 200) / count(*), 4) AS within_200_km,
  round(count(*) FILTER (km <= 750) / count(*), 4) AS within_750_km,
  round(count(*) FILTER (km <= 2500) / count(*), 4) AS within_2500_km, round(median(km), 3) AS median_km
FROM (SELECT split, round({_KM}, 6) AS km FROM v_placed) GROUP BY ALL"""))
def geodesic_error(t):
    return geoeval.geodesic_error(placed(t))


@query("split_gap", s.with_lenses("v_placed", """
, a AS (SELECT split, avg(CAST(correct AS INT)) AS acc FROM v_placed GROUP BY ALL)
SELECT round(i, 4) AS in_distribution_accuracy, round(i - r, 4) AS region_gap, round(i - p, 4) AS species_gap
FROM (SELECT max(acc) FILTER (split = 'test_random') AS i, max(acc) FILTER (split = 'test_heldout_region') AS r,
  max(acc) FILTER (split = 'test_heldout_species') AS p FROM a)"""))
def split_gap(t):
    return geoeval.split_gap(placed(t))


def _unclear(step, i):
    """Some steps cite something unknown, by the lengths of the image and pair ids."""
    lost = ((i == 0) & (F.length("img") % 3 == 0)) | ((i == 2) & (F.length("pair_id") % 2 == 0))
    return step.withField("cites", F.when(lost, "hearsay").otherwise(step["cites"]))


@query("chain_grounding", s.with_lenses("v_ground v_prior", """
, g AS (SELECT v_ground.*, s.region FROM v_ground LEFT JOIN us_states s ON s.name = v_ground.state)
SELECT count(*) AS n_chains, round((3 * count(*) - count(*) FILTER (length(img) % 3 = 0)
    - count(*) FILTER (length(pair_id) % 2 = 0)) / (4 * count(*)), 4) AS cited_share,
  round(avg(CASE WHEN p.disease IS NULL THEN 0 ELSE 1 END), 4) AS backed_share
FROM g LEFT JOIN v_prior p ON p.region = g.region AND p.disease = g.true_label"""))
def chain_grounding(t):
    state = dims.states(t.spark).select(c("name").alias("state"), "region")
    chains = (items.item_skeleton(pipeline.grounded(t)).join(F.broadcast(state), "state", "left")
              .withColumn("_cot", F.transform("cot", _unclear)).withColumn("cot", c("_cot"))
              .select("item_id", "region", c("gold.diagnosis").alias("concluded"), "cot"))
    return geoeval.chain_grounding(chains, prior(t), ["image", "decision graph", "image (VLM lay observation)"])


@query("region_swap", s.with_lenses("v_prior", """
, crops AS (SELECT DISTINCT crop, disease FROM v_rows),
best AS (SELECT crop, region, arg_min(disease, (-votes, disease)) AS likely FROM v_prior JOIN crops USING (disease)
  GROUP BY ALL),
local AS (SELECT disease, count(*) < 4 OR max(votes) > 2 * min(votes) AS localizable FROM v_prior GROUP BY ALL)
SELECT i.region, t.region AS moved_to, count(*) AS n_items, count(*) FILTER (h.likely <> t.likely) AS n_flipped,
  count(*) FILTER ((h.likely <> t.likely) = coalesce(localizable, false)) AS n_expected
FROM v_placed i JOIN best h ON h.crop = i.crop AND h.region = i.region
JOIN best t ON t.crop = i.crop AND t.region <> i.region LEFT JOIN local l ON l.disease = i.disease
GROUP BY ALL"""))
def region_swap(t):
    rows = placed(t).filter(c("region").isNotNull())
    p = materialise(geoeval.geo_prior(rows), "prior")
    local = p.groupBy("disease").agg(
        ((F.count("*") < 4) | (F.max("votes") > 2 * F.min("votes"))).alias("localizable"))
    best = geoeval.best_by_region(p, lenses.image_rows(t))
    return geoeval.region_swap(rows, best, local)


_CLIMATE = "CASE climate " + " ".join(
    f"WHEN '{k}' THEN [{', '.join(map(str, v))}]" for k, v in fv.CLIMATE_VECTORS.items()) + " END"


@query("climate_weighted_retrieval", "WITH " + s.V_EMB + f""",
zone_vectors AS (SELECT lat, CAST({_CLIMATE} AS DOUBLE[]) AS v FROM (SELECT lat, {s.zone('lat', '0', 3)} AS climate
  FROM range(-90, 90) r(lat))),
z AS (SELECT *, (vec_id * 37) % 180 - 90 AS lat FROM v_emb),
sims AS (SELECT i.img, j.img AS found, 0.7 * list_dot_product(i.embedding, j.embedding)
    + 0.3 * list_cosine_similarity(ci.v, cj.v) AS score
  FROM z i JOIN z j ON i.crop = j.crop AND i.bucket = j.bucket AND i.img <> j.img
  JOIN zone_vectors ci ON ci.lat = i.lat JOIN zone_vectors cj ON cj.lat = j.lat)
SELECT img, found, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY img
  ORDER BY round(score, 9) DESC, found) AS rank FROM sims) WHERE rank <= 3""")
def climate_weighted_retrieval(t):
    lat = ((c("vec_id") * 37) % 180 - 90).cast("double")
    emb = lenses.embeddings(t).withColumn("climate", gx.climate_vector(gx.zone_climate(lat, F.lit(0.0))))
    return similarity.weighted_top_k(emb, k=3).select("img", "found", F.round("score", 4).alias("score"), "rank")
