"""Embedding-based confusability scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsift import fixed_values as fv
from twinsift.functions import labels
from twinsift.operators import mining, similarity
from twinsift.plans import lenses, pipeline
from twinsift.plans import sqltext as s
from twinsift.plans.registry import query

c = F.col
PAIR = similarity.PAIR


@query("nn_by_class", s.with_lenses("v_nn", """
SELECT crop, bucket, img, disease, other, round(best, 4) AS best, round(max(CASE WHEN disease = other THEN best END)
  OVER (PARTITION BY crop, bucket, img), 4) AS own FROM v_nn"""))
def nn_by_class(t):
    return similarity.nn_by_class(lenses.embeddings(t)).withColumn("best", F.round("best", 4)).withColumn(
        "own", F.round("own", 4))


def _scored(t):
    emb = lenses.embeddings(t)
    return similarity.nn_by_class(emb), similarity.class_pairs(emb)


@query("bidirectional_confusability", s.with_lenses("v_nn", """
SELECT crop, member_a, member_b, coalesce(support >= 5, false) AS ok, round(ab, 4) AS matched_entail_ab,
  round(ba, 4) AS matched_entail_ba, round(least(ab, ba), 4) AS matched_cross_knn, support AS matched_support,
  array_to_string(buckets, ',') AS buckets FROM v_epairs LEFT JOIN v_match USING (crop, member_a, member_b)"""))
def bidirectional_confusability(t):
    return similarity.matched_scores(*_scored(t)).select(
        *PAIR, "ok", "matched_entail_ab", "matched_entail_ba", "matched_cross_knn", "matched_support",
        F.array_join("shared_buckets", ",").alias("buckets"))


@query("bucket_scores", s.with_lenses("v_nn", """
SELECT crop, bucket, member_a, member_b, n_a, n_b, round(hits_ab / n_a, 4) AS entail_ab,
  round(hits_ba / n_b, 4) AS entail_ba, round(least(hits_ab / n_a, hits_ba / n_b), 4) AS bidir
FROM v_dir WHERE n_a >= 4 AND n_b >= 4"""))
def bucket_scores(t):
    scores = similarity.bucket_scores(similarity.nn_by_class(lenses.embeddings(t)))
    return scores.select("crop", "bucket", "member_a", "member_b", "n_a", "n_b",
                         F.round("entail_ab", 4).alias("entail_ab"), F.round("entail_ba", 4).alias("entail_ba"),
                         F.round(F.least("entail_ab", "entail_ba"), 4).alias("bidir"))


_WHOLE = s.V_NN.replace("i.bucket = j.bucket", "true").replace("i.bucket", "'all' AS bucket")


@query("whole_confusability", "WITH " + s.V_EMB + ",\n" + _WHOLE + """
, k AS (SELECT crop, disease, count(*) AS n, list(embedding) AS v FROM v_emb GROUP BY ALL),
m AS (SELECT crop, disease, n, list_transform(range(1, 65), lambda d: list_avg(list_transform(v, lambda x: x[d])))
  AS mean FROM k)
SELECT d.crop, d.member_a, d.member_b, d.n_a, d.n_b, round(list_cosine_similarity(a.mean, b.mean), 3) AS centroid_sim,
  round(hits_ab / n_a, 4) AS entail_ab, round(hits_ba / n_b, 4) AS entail_ba,
  round(least(hits_ab / n_a, hits_ba / n_b), 4) AS cross_knn_rate
FROM v_dir d JOIN m a ON a.crop = d.crop AND a.disease = member_a JOIN m b ON b.crop = d.crop AND b.disease = member_b""")
def whole_confusability(t):
    emb = lenses.embeddings(t)
    whole = similarity.nn_by_class(emb.withColumn("bucket", F.lit("all")))
    scores = similarity.whole_scores(whole, emb, similarity.class_pairs(emb))
    return scores.drop("ok", "reason").withColumn("centroid_sim", F.round("centroid_sim", 3))


@query("pooled_cross_knn", s.with_lenses("v_nn", """
SELECT crop, member_a, member_b, coalesce(support >= 5, false) AS ok, round(pooled, 4) AS pooled_cross_knn,
  support AS matched_support FROM v_epairs LEFT JOIN v_match USING (crop, member_a, member_b)"""))
def pooled_cross_knn(t):
    return similarity.matched_scores(*_scored(t)).select(*PAIR, "ok", "pooled_cross_knn", "matched_support")


@query("separation_ratio", s.with_lenses("v_emb", """
, sims AS (SELECT i.crop, i.disease AS di, j.disease AS dj, list_dot_product(i.embedding, j.embedding) AS sim
  FROM v_emb i JOIN v_emb j ON i.crop = j.crop AND i.vec_id < j.vec_id),
w AS (SELECT crop, di AS d, sum(sim) AS s, count(*) AS n FROM sims WHERE di = dj GROUP BY ALL),
x AS (SELECT crop, least(di, dj) AS a, greatest(di, dj) AS b, avg(sim) AS m FROM sims WHERE di <> dj GROUP BY ALL)
SELECT x.crop, a AS member_a, b AS member_b, round((wa.s + wb.s) / (wa.n + wb.n), 4) AS within_sim,
  round(m, 4) AS cross_sim, round(CASE WHEN (wa.s + wb.s) > 0 THEN m / ((wa.s + wb.s) / (wa.n + wb.n)) ELSE 0 END, 4)
    AS sep_ratio FROM x JOIN w wa ON wa.crop = x.crop AND wa.d = a JOIN w wb ON wb.crop = x.crop AND wb.d = b"""))
def separation_ratio(t):
    emb = lenses.embeddings(t)
    return similarity.separation(emb, similarity.class_pairs(emb))


@query("confusable_flag", s.with_lenses("v_nn", """
SELECT crop, member_a, member_b, coalesce(support >= 5 AND round(least(ab, ba), 4) >= 0.2, false) AS image_confusable,
  coalesce(support >= 5 AND round(pooled, 4) >= 0.12, false) AS pooled_confusable
FROM v_epairs LEFT JOIN v_match USING (crop, member_a, member_b)"""))
def confusable_flag(t):
    scores = similarity.matched_scores(*_scored(t))
    flagged = similarity.confusable(scores, "matched_cross_knn", fv.LANE_GATE)
    return similarity.confusable(flagged, "pooled_cross_knn", fv.POOLED_GATE, "pooled_confusable").select(
        *PAIR, "image_confusable", "pooled_confusable")


@query("lane_hint", s.with_lenses("v_scores", """
SELECT pair_id, matched_cross_knn, CASE WHEN matched_cross_knn >= 0.2 THEN 'image_ambiguous'
  WHEN matched_cross_knn < 0.2 THEN 'image_decisive' END AS lane FROM v_scores"""))
def lane_hint(t):
    return pipeline.scores(t).select("pair_id", "matched_cross_knn",
                                     labels.lane_hint(c("matched_cross_knn")).alias("lane"))


@query("class_image_worklist", s.with_lenses("v_emb v_pairs", """
SELECT img, crop, disease FROM v_emb e WHERE EXISTS (SELECT 1 FROM v_pairs p WHERE p.crop = e.crop
  AND e.disease IN (p.member_a, p.member_b)) """))
def class_image_worklist(t):
    members = similarity.pair_members(lenses.candidate_pairs(t))
    images = lenses.embeddings(t)
    return similarity.member_worklist(images, members).select("img", "crop", "disease")


@query("restrict_to_scored", s.with_lenses("v_pairs v_scores", """
SELECT pair_id, lookalike_prior FROM v_pairs WHERE pair_id IN (SELECT pair_id FROM v_scores
  WHERE ok AND matched_cross_knn >= 0.2)"""))
def restrict_to_scored(t):
    flagged = similarity.confusable(pipeline.scores(t), "matched_cross_knn", fv.LANE_GATE)
    kept = lenses.candidate_pairs(t).join(flagged.filter("image_confusable"), "pair_id", "left_semi")
    return mining.rank_pairs(kept).select("pair_id", "lookalike_prior")
