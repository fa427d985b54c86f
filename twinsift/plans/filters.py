"""Gates, validators and first-N filters."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from twinsift.functions import labels, text
from twinsift.operators import audit, evidence, gates, mining, ranges, similarity, splits
from twinsift.plans import lenses, pipeline
from twinsift.plans import sqltext as s
from twinsift.plans.registry import query

c = F.col


@query("label_gate", s.with_lenses("v_gated", """
SELECT img, crop, disease, CASE gate_status WHEN 'renamed' THEN 'Small grain' ELSE host_common END AS host_common
FROM v_gated WHERE gate_status IN ('kept', 'renamed')"""))
def label_gate(t):
    return gates.label_gate(lenses.image_rows(t), lenses.label_report(t)).select(
        "img", "crop", "disease", "host_common")


@query("gate_stats", s.with_lenses("v_gated", """
SELECT count(*) FILTER (gate_status IN ('kept', 'renamed')) AS kept,
  count(*) FILTER (gate_status = 'bad_crop') AS dropped_bad_crop,
  count(*) FILTER (gate_status = 'incorrect_disease') AS dropped_incorrect_disease,
  count(*) FILTER (gate_status = 'x') AS dropped_questionable,
  count(*) FILTER (gate_status = 'renamed') AS renamed_misspelled FROM v_gated"""))
def gate_stats(t):
    return gates.gate_stats(gates.judge_rows(lenses.image_rows(t), lenses.label_report(t)))


@query("judge_apply", s.with_lenses("v_gated", """
SELECT crop, disease, CASE WHEN gate_status IN ('kept', 'renamed') AND questionable THEN 'questionable_disease'
  ELSE gate_status END AS outcome, count(*) AS n_rows FROM (
    SELECT * REPLACE (CASE WHEN questionable AND crop = 'Small grain' THEN 'SMALL' ELSE crop END AS crop) FROM v_gated
    JOIN (SELECT host_common AS hc, disease AS d FROM v_rows GROUP BY ALL HAVING count(*) >= 10)
      ON hc = host_common AND d = disease)
GROUP BY ALL"""))
def judge_apply(t):
    survivors = gates.class_threshold(lenses.image_rows(t))
    judged = gates.judge_rows(survivors, lenses.label_report(t), drop_questionable=True)
    return judged.groupBy("crop", "disease", c("gate_status").alias("outcome")).agg(
        F.count("*").alias("n_rows"))


def _scraped(t):
    key = c("p_partkey")
    subject = F.when(key % 10 == 1, " (sp.) ").otherwise(F.concat("disease", F.lit(" ("), "path_common", F.lit(")")))
    rows = lenses.image_rows(t).withColumn("p_partkey", c("row_id"))
    return rows.select("row_id", "img", c("crop").alias("host_name"), subject.alias("subject"),
                       F.when(key % 11 == 2, "Atlantis").otherwise(F.upper("state")).alias("location"))


def _aliases(t):
    return (t.part.select(c("p_type").alias("host_name")).distinct()
            .withColumn("crop", F.when(c("host_name") != "STANDARD", F.lower("host_name"))))


s.add_lens("v_usable", f"""v_usable AS (
  SELECT row_id, img, CASE WHEN crop <> 'STANDARD' THEN lower(crop) END AS norm_crop,
    CASE WHEN row_id % 10 <> 1 THEN disease END AS norm_disease,
    CASE WHEN row_id % 11 <> 2 THEN s.state_lat END AS lat,
    CASE WHEN row_id % 11 <> 2 THEN s.state_lon END AS lon,
    CASE WHEN crop = 'STANDARD' THEN 'no_crop' WHEN row_id % 10 = 1 THEN 'no_disease'
      WHEN row_id % 11 = 2 OR s.state_lat IS NULL THEN 'no_state' END AS drop_reason
  FROM v_rows r LEFT JOIN us_states s ON s.name = r.state)""", ("v_rows",))


@query("usable_rows", s.with_lenses("v_usable", f"""
SELECT row_id, norm_crop, norm_disease, lat AS state_lat, {s.zone('lat', 'lon', 2)} AS zone,
  drop_reason FROM v_usable"""))
def usable_rows(t):
    return gates.usable_status(_scraped(t), _aliases(t)).select(
        "row_id", "norm_crop", "norm_disease", "state_lat", "zone", "drop_reason")


@query("drop_report", s.with_lenses("v_usable", """
, k AS (SELECT norm_crop, norm_disease, count(*) AS n FROM v_usable WHERE drop_reason IS NULL GROUP BY ALL)
SELECT * FROM (SELECT count(*) FILTER (drop_reason = 'no_crop') AS no_crop,
  count(*) FILTER (drop_reason = 'no_disease') AS no_disease,
  count(*) FILTER (drop_reason = 'no_state') AS no_state FROM v_usable),
 (SELECT CAST(coalesce(sum(n) FILTER (n < 10), 0) AS BIGINT) AS rows_under_threshold,
  count(*) FILTER (n < 10) AS classes_under_threshold, count(*) FILTER (n >= 10) AS classes_kept,
  CAST(coalesce(sum(greatest(0, n - 12)) FILTER (n >= 10), 0) AS BIGINT) AS rows_trimmed FROM k)"""))
def drop_report(t):
    return audit.drop_report(gates.usable_status(_scraped(t), _aliases(t)), cap=12)


@query("class_threshold", s.with_lenses("v_rows", """
SELECT img, crop, disease, class_rows FROM (SELECT *, count(*) OVER (PARTITION BY crop, disease) AS class_rows
  FROM v_rows) WHERE class_rows >= 10"""))
def class_threshold(t):
    return gates.class_threshold(lenses.image_rows(t)).select("img", "crop", "disease", "class_rows")


@query("visibility_gate", s.with_lenses("v_rows v_label", """
SELECT r.img, CASE WHEN l.img IS NULL THEN 'no_label' WHEN NOT is_closeup THEN 'not_closeup'
  WHEN NOT decisive_sign_visible THEN 'sign_not_visible' WHEN row_id % 7 = 0 THEN 'no_lay_layer'
  ELSE 'usable' END AS visibility FROM v_rows r LEFT JOIN v_label l ON l.img = r.img"""))
def visibility_gate(t):
    seen = lenses.visibility_labels(t).select("img", "is_closeup", "decisive_sign_visible")
    status = gates.visibility_status(c("is_closeup").isNotNull(), c("is_closeup"),
                                     c("decisive_sign_visible"), c("row_id") % 7 != 0)
    return lenses.image_rows(t).join(seen, "img", "left").select("img", status.alias("visibility"))


_LOWER, _UPPER = string.ascii_lowercase, string.ascii_uppercase
_SAID = s.strip_tail(f"""CASE WHEN turn % 2 = 0 AND sign <> '' THEN 'I see ' || translate(sign, '{_LOWER}', '{_UPPER}')
  WHEN turn % 3 = 0 THEN farmer_lay_report ELSE 'spots on ' || crop || '. . ' END""")


@query("lay_leak_guard", s.with_lenses("v_graph", f"""
SELECT conv_id, turn, CASE WHEN sign <> '' AND contains(lower(said), lower(sign))
  THEN {s.strip_tail('farmer_lay_report')} ELSE said END AS observation
FROM (SELECT *, {_SAID} AS said FROM (SELECT *, coalesce({s.half('lines[2]', 'a')}, '') AS sign FROM v_graph))"""))
def lay_leak_guard(t):
    g = lenses.graph_records(t).select(
        "conv_id", "turn", "crop", gates.decisive_fork(c("graph.forks")).alias("fork"),
        F.concat(F.lit("Look closely for "), c("graph.narrative_a")).alias("report"))
    plain = F.when(c("turn") % 3 == 0, "").otherwise(F.concat(F.lit("spots on "), "crop", F.lit(". . ")))
    said = F.when((c("turn") % 2 == 0) & (c("fork.a_signal") != ""), F.concat(
        F.lit("I see "), F.translate("fork.a_signal", _LOWER, _UPPER))).otherwise(plain)
    signs = F.array_compact(F.array("fork.a_signal"))
    return g.select("conv_id", "turn", gates.guarded_observation(said, c("report"), signs)
                    .alias("observation"))


@query("validate_graph", s.with_lenses("v_gstore", f"""
, v_bent AS (SELECT *, conv_id % 23 = 1 AS said_yes, conv_id % 31 = 3 AS bent_fork FROM v_gstore),
v_docerr AS (SELECT pair_id, CASE WHEN conv_id % 37 = 4 THEN ['graph is not an object']
  WHEN management_b IS NULL THEN ['missing key: management_b'] ELSE list_filter(list_concat(
    [CASE WHEN said_yes THEN 'confusable must be bool' END,
     CASE WHEN confusable_reason = ' ' THEN 'confusable_reason empty' END,
     CASE WHEN len(lines) NOT BETWEEN 3 AND 7 THEN 'forks must be a list of 3..7 items' END],
    CASE WHEN len(lines) BETWEEN 3 AND 7 THEN flatten(list_transform(range(len(lines)), lambda i:
      CASE WHEN bent_fork AND i = 0 THEN ['fork[0] not an object'] ELSE [
        CASE WHEN conv_id % 11 = 0 AND i = 0 THEN 'fork[0].axis invalid: ''colour''' END,
        CASE WHEN {s.strip('lines[i + 1]')} = '' THEN 'fork[' || i || '].question empty' END,
        CASE WHEN {s.strip(s.half('lines[i + 1]', 'a'))} = '' THEN 'fork[' || i || '].a_signal empty' END,
        CASE WHEN {s.strip(s.half('lines[i + 1]', 'b'))} = '' THEN 'fork[' || i || '].b_signal empty' END] END)) ELSE [] END,
    [CASE WHEN (confusable OR said_yes) AND len(lines) NOT BETWEEN 3 AND 7
       THEN 'need exactly 1 decisive fork, found 0' END,
     CASE WHEN conv_id % 29 = 2 THEN 'geo_localizable_a must be bool' END]), lambda e: e IS NOT NULL) END AS errors
  FROM v_bent)
SELECT pair_id, array_to_string(errors, '; ') AS errors, len(errors) AS n_errors FROM v_docerr"""))
def validate_graph(t):
    return lenses.graph_documents(t).select("pair_id", gates.document_errors(c("doc")).alias("e")).select(
        "pair_id", F.array_join("e", "; ").alias("errors"), F.size("e").alias("n_errors"))


@query("decisive_fork", s.with_lenses("v_graph", f"""
SELECT conv_id, turn, lines[2] AS question, {s.half('lines[2]', 'a')} AS a_signal FROM v_graph"""))
def decisive_fork(t):
    fork = gates.decisive_fork(c("graph.forks"))
    return lenses.graph_records(t).select("conv_id", "turn", fork["question"].alias("question"),
                                          fork["a_signal"].alias("a_signal"))


@query("pair_disposition", s.with_lenses("v_disp", "SELECT pair_id, crop, status FROM v_disp"))
def pair_disposition(t):
    return pipeline.dispositions(t).select("pair_id", "crop", "status")


@query("credible_evidence", s.with_lenses("v_evid", """
SELECT event_id, documented AND quote <> '' AND source_type <> 'other' AS verified FROM v_evid"""))
def credible_evidence(t):
    return evidence.verified_evidence(lenses.evidence(t)).select("event_id", "verified")


s.add_lens("v_names", """v_names AS (
  SELECT crop, disease, sci_name, n FROM (SELECT crop, disease, CASE WHEN path_sci <> '' THEN path_sci
      ELSE path_common END AS sci_name, count(*) AS n, min(row_id) AS f FROM v_rows GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY crop, disease ORDER BY n DESC, f) = 1)""", ("v_rows",))


@query("same_organism_drop", s.with_lenses("v_store v_names", """
SELECT e.pair_id, e.verified AND NOT same AS confirmed,
  CASE WHEN e.verified AND same THEN 'same organism (synonym)' END AS dropped_reason
FROM (SELECT v_store.*, coalesce(split_part(a.sci_name, ' ', 1) = split_part(b.sci_name, ' ', 1)
    AND split_part(a.sci_name, ' ', 2)[1:5] = split_part(b.sci_name, ' ', 2)[1:5], false) AS same
  FROM v_store LEFT JOIN v_names a ON a.crop = v_store.crop AND a.disease = member_a
  LEFT JOIN v_names b ON b.crop = v_store.crop AND b.disease = member_b) e"""))
def same_organism_drop(t):
    names = mining.dominant_name(lenses.image_rows(t))
    return mining.same_organism_drop(pipeline.stored_evidence(t), names).select(
        "pair_id", "confirmed", "dropped_reason")


@query("organ_support_gate", s.with_lenses("v_nn", """
SELECT crop, member_a, member_b, coalesce(support >= 90, false) AS ok, support AS matched_support,
  CASE WHEN support IS NULL THEN 'no shared-organ support' WHEN support < 90 THEN 'insufficient matched support' END
    AS reason, array_to_string(buckets, ',') AS buckets
FROM v_epairs LEFT JOIN (SELECT crop, member_a, member_b, CAST(sum(least(n_a, n_b)) AS BIGINT) AS support,
  list_sort(list(bucket)) AS buckets FROM v_dir WHERE n_a >= 14 AND n_b >= 14 GROUP BY ALL)
  USING (crop, member_a, member_b)"""))
def organ_support_gate(t):
    emb = lenses.embeddings(t)
    out = similarity.matched_scores(similarity.nn_by_class(emb), similarity.class_pairs(emb),
                                    min_side=14, min_support=90)
    return out.select("crop", "member_a", "member_b", "ok", "matched_support", "reason",
                      F.array_join("shared_buckets", ",").alias("buckets"))


_FAILS = """SELECT item_id, unnest(list_filter([
    CASE WHEN tech <> '' AND contains(lower(f1 || ' ' || f2), tech) THEN 'LEAK: technical decisive sign in farmer turn' END,
    CASE WHEN turn % 4 = 1 THEN 'no CONCLUDE' END, CASE WHEN turn % 4 = 2 THEN 'no READ_SIGN step' END,
    CASE WHEN conv_id % 9 = 0 THEN 'diagnosis == distractor' END,
    CASE WHEN conv_id % 5 = 4 THEN 'not answerable-from-image' END,
    CASE WHEN turn % 3 = 2 THEN 'F1 has no image' END,
    CASE WHEN conv_id % 2 = 0 AND (turn % 2 = 0 OR conv_id % 8 = 0)
      THEN 'look-alike evidence incomplete (web source missing)' END], lambda e: e IS NOT NULL)) AS failure"""


@query("selfcheck", f"""
{_FAILS} FROM (SELECT conv_id, turn, conv_id || '-' || turn AS item_id, text AS f1, role AS f2,
  CASE WHEN turn % 2 = 0 THEN lower(split_part(text, ' ', 2)) ELSE '' END AS tech
  FROM conversations)""")
def selfcheck(t):
    def step(name):
        return F.struct(F.lit(name).alias("step"), F.lit("image").alias("cites"), c("role").alias("text"))

    def turn(name, speaker, line, has_image):
        return F.struct(F.lit(name).alias("turn"), F.lit(speaker).alias("speaker"), line.alias("text"),
                        has_image.alias("has_image"))

    kind = c("turn") % 4
    cot = (F.when(kind == 1, F.array(step("CONCLUDE"), step("READ_SIGN")))
           .when(kind == 2, F.array(step("PERCEIVE"), step("CONCLUDE")))
           .otherwise(F.array(step("READ_SIGN"), step("CONCLUDE"))))
    first = c("text")
    word = F.split_part(first, F.lit(" "), F.lit(2))
    made = t.conversations.select(
        F.concat_ws("-", c("conv_id").cast("string"), c("turn").cast("string")).alias("item_id"), cot.alias("cot"),
        F.array(turn("F1", "farmer", first, c("turn") % 3 != 2),
                turn("E1", "expert", c("text"), F.lit(False)),
                turn("F2", "farmer", c("role"), F.lit(False))).alias("dialogue"),
        F.struct(F.when(c("conv_id") % 9 == 0, "x").otherwise("y").alias("diagnosis"),
                 (c("conv_id") % 5 != 4).alias("answerable_from_image")).alias("gold"),
        F.struct(F.lit("x").alias("distractor")).alias("lookalike"),
        F.when(c("turn") % 2 == 0, F.concat(F.lit(" "), word, F.lit(".."))).otherwise("").alias("tech_sign"),
        (c("conv_id") % 2 == 0).alias("has_evidence"), (c("turn") % 2 != 0).alias("web_verified"),
        F.when(c("conv_id") % 8 == 0, "").otherwise("https://x").alias("web_source_url"))
    return gates.selfcheck(made)


@query("split_assign", s.with_lenses("v_split", "SELECT row_id, split FROM v_split"))
def split_assign(t):
    return splits.assign_splits(lenses.image_rows(t)).select("row_id", "split")


def _repeated_images(t):
    """Rows in which several share an image: a third of them share a single one."""
    rows = splits.assign_splits(lenses.image_rows(t))
    img = F.when(c("row_id") % 3 == 0, "hot").when(c("row_id") % 50 == 1, "").otherwise(
        F.concat(F.lit("i"), F.floor(c("row_id") / 4).cast("string")))
    return rows.withColumn("img", img)


s.add_lens("v_repeat", """v_repeat AS (
  SELECT * REPLACE (CASE WHEN row_id % 3 = 0 THEN 'hot' WHEN row_id % 50 = 1 THEN ''
    ELSE 'i' || (row_id // 4) END AS img) FROM v_split)""", ("v_split",))


@query("split_collapse", s.with_lenses("v_repeat", """
SELECT row_id, img, CASE WHEN img = '' THEN split ELSE first_value(split) OVER (PARTITION BY img ORDER BY row_id)
  END AS split FROM v_repeat"""))
def split_collapse(t):
    return splits.collapse_splits(_repeated_images(t)).select("row_id", "img", "split")


@query("split_audit", s.with_lenses("v_repeat", """
SELECT img, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM v_repeat WHERE img <> ''
GROUP BY img HAVING count(DISTINCT split) > 1"""))
def split_audit(t):
    return splits.split_leaks(_repeated_images(t)).select("img", F.array_join("splits", ",").alias("splits"))


@query("per_class_cap", s.with_lenses("v_rows", """
SELECT row_id, crop, disease FROM v_rows QUALIFY row_number() OVER (PARTITION BY crop, disease
  ORDER BY CASE WHEN row_id % 6 = 0 THEN 0 ELSE row_id % 1000 END, row_id) <= 8"""))
def per_class_cap(t):
    odd = F.when(c("row_id") % 6 == 0, F.concat(F.lit("x"), "img")).otherwise((c("row_id") % 1000).cast("string"))
    return audit.per_class_cap(lenses.image_rows(t).withColumn("img", odd), 8).select(
        "row_id", "crop", "disease")


@query("class_head_sample", s.with_lenses("v_rows", """
SELECT img, crop, disease FROM v_rows QUALIFY row_number() OVER (PARTITION BY crop, disease ORDER BY img) <= 10"""))
def class_head_sample(t):
    return similarity.class_head_sample(lenses.image_rows(t), 10).select("img", "crop", "disease")


@query("cap_items", s.with_lenses("v_rows", """
SELECT img, crop FROM v_rows WHERE state <> '' ORDER BY crop || img LIMIT 100"""))
def cap_items(t):
    rows = lenses.image_rows(t).filter(c("state") != "")
    return rows.withColumn("item_id", F.concat("crop", "img")).orderBy("item_id").limit(100).select("img", "crop")


@query("localizable", "SELECT n_name, n_regionkey < 2 AS localizable, count(*) AS n_customers "
                      "FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def localizable(t):
    kind = F.get(F.array(*[F.lit(x) for x in ("localized", "regional", "cosmopolitan", "data_poor", "none")]),
                 c("n_regionkey"))
    nations = t.nation.select(c("n_nationkey").alias("c_nationkey"), "n_name",
                              ranges.is_localizable(kind).alias("localizable"))
    counts = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n_customers"))
    return counts.join(nations, "c_nationkey").select("n_name", "localizable", "n_customers")
