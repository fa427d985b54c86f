"""Class counts, candidate pairs, their features and their ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsift.operators import audit, mining
from twinsift.plans import lenses
from twinsift.plans import sqltext as s
from twinsift.plans.registry import query
from twinsift.sources import readers, writers
from twinsift.session import scratch_path

c = F.col


@query("class_counts", s.with_lenses("v_rows", """
SELECT crop, disease, count(*) AS n_images FROM v_rows GROUP BY ALL"""))
def class_counts(t):
    return mining.class_counts(lenses.image_rows(t))


@query("class_registry", s.with_lenses("v_rows", """
SELECT crop, disease, count(*) AS n_images FROM v_rows GROUP BY ALL HAVING count(*) >= 12"""))
def class_registry(t):
    return mining.class_registry(lenses.image_rows(t))


@query("class_report", s.with_lenses("v_rows", """
SELECT crop, disease, count(*) AS candidate_rows, least(count(*), 12) AS kept_rows FROM v_rows GROUP BY ALL
HAVING count(*) >= 10"""))
def class_report(t):
    return audit.class_report(lenses.image_rows(t), cap=12)


@query("write_registry", s.with_lenses("v_rows", """
SELECT crop AS "Crop", disease AS "Disease", CAST(count(*) AS VARCHAR) AS n_images FROM v_rows GROUP BY ALL
HAVING count(*) >= 12"""))
def write_registry(t):
    path = scratch_path(t.spark, "registry")
    writers.write_registry(mining.class_registry(lenses.image_rows(t)), path)
    return readers.metadata_csv(t.spark, path, ["Crop", "Disease", "n_images"])


@query("top_descriptors", s.with_lenses("v_rows", """
SELECT crop, disease, descriptor, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY crop, disease
  ORDER BY n DESC, f) AS rank FROM (SELECT crop, disease, descriptor, count(*) AS n, min(row_id) AS f
  FROM v_rows GROUP BY ALL)) WHERE rank <= 4"""))
def top_descriptors(t):
    return mining.top_descriptors(lenses.image_rows(t))


@query("dominant_name", s.with_lenses("v_rows", """
SELECT crop, disease, sci_name, n FROM (SELECT crop, disease, CASE WHEN path_sci <> '' THEN path_sci
    ELSE path_common END AS sci_name, count(*) AS n, min(row_id) AS f FROM v_rows GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY crop, disease ORDER BY n DESC, f) = 1"""))
def dominant_name(t):
    return mining.dominant_name(lenses.image_rows(t))


@query("mine_candidate_pairs", s.with_lenses("v_pairs", """
SELECT pair_id, crop, member_a, member_b, n_imgs_a, n_imgs_b, class_a, class_b, same_pathogen_class,
  lookalike_prior FROM v_pairs"""))
def mine_candidate_pairs(t):
    return lenses.candidate_pairs(t).drop("shared_descriptors", "shared_states")


@query("shared_sets", s.with_lenses("v_pairs", """
SELECT pair_id, array_to_string(shared_descriptors, ',') AS descriptors, len(shared_descriptors) AS n_descriptors,
  array_to_string(shared_states, ',') AS states, len(shared_states) AS n_states FROM v_pairs"""))
def shared_sets(t):
    return lenses.candidate_pairs(t).select(
        "pair_id", F.array_join("shared_descriptors", ",").alias("descriptors"),
        F.size("shared_descriptors").alias("n_descriptors"),
        F.array_join("shared_states", ",").alias("states"), F.size("shared_states").alias("n_states"))


@query("lookalike_prior", s.with_lenses("v_pairs", "SELECT pair_id, lookalike_prior FROM v_pairs"))
def lookalike_prior(t):
    return lenses.candidate_pairs(t).select("pair_id", "lookalike_prior")


@query("shared_region_set", s.with_lenses("v_pairs", """
SELECT pair_id, coalesce(string_agg(DISTINCT region, ',' ORDER BY region), '') AS regions
FROM (SELECT pair_id, unnest(CASE WHEN len(shared_states) > 0 THEN shared_states ELSE [''] END) AS state
  FROM v_pairs) LEFT JOIN us_states s ON s.name = state GROUP BY pair_id"""))
def shared_region_set(t):
    return mining.with_shared_regions(lenses.candidate_pairs(t)).select(
        "pair_id", F.array_join("shared_regions", ",").alias("regions"))


@query("nested_pairs", s.with_lenses("v_pairs", """
, d AS (SELECT crop, disease, string_agg(descriptor || '=' || n, ',' ORDER BY n DESC, f) AS top FROM (
    SELECT * FROM (SELECT crop, disease, descriptor, count(*) AS n, min(row_id) AS f FROM v_rows GROUP BY ALL)
    WHERE true QUALIFY row_number() OVER (PARTITION BY crop, disease ORDER BY n DESC, f) <= 4) GROUP BY crop, disease)
SELECT pair_id, class_a, n_imgs_b, a.top AS top_a, b.top AS top_b, lookalike_prior FROM v_pairs p
JOIN d a ON a.crop = p.crop AND a.disease = member_a JOIN d b ON b.crop = p.crop AND b.disease = member_b"""))
def nested_pairs(t):
    rows = lenses.image_rows(t)
    nested = mining.nested_pairs(mining.mine_pairs(rows), rows)

    def shown(member):
        return F.array_join(F.transform(c(member)["descriptors"], lambda d: F.concat(
            d["name"], F.lit("="), d["n"].cast("string"))), ",")

    return nested.select("pair_id", c("member_a.pathogen_class").alias("class_a"),
                         c("member_b.n_imgs").alias("n_imgs_b"), shown("member_a").alias("top_a"),
                         shown("member_b").alias("top_b"), "lookalike_prior")


@query("rank_pairs", s.with_lenses("v_pairs", """
SELECT pair_id, lookalike_prior FROM v_pairs ORDER BY lookalike_prior DESC, pair_id LIMIT 40"""))
def rank_pairs(t):
    return mining.rank_pairs(lenses.candidate_pairs(t), top=40).select("pair_id", "lookalike_prior")


@query("rank_all_pairs", s.with_lenses("v_pairs", """
SELECT pair_id, lookalike_prior, row_number() OVER (ORDER BY lookalike_prior DESC, pair_id) AS place FROM v_pairs"""))
def rank_all_pairs(t):
    return mining.placed_pairs(lenses.candidate_pairs(t)).select("pair_id", "lookalike_prior", "place")
