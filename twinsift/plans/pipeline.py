"""The item pipeline from rows to grounded items, shared by several queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.operators import evidence, gates, items, mining, similarity, splits
from twinsift.plans import lenses
from twinsift.plans import sqltext as s
from twinsift.plans.registry import Tables
from twinsift.session import materialise

c = F.col


def scores(t: Tables) -> DataFrame:
    emb = lenses.embeddings(t)
    pairs = similarity.class_pairs(emb)
    return similarity.with_pair_id(similarity.matched_scores(similarity.nn_by_class(emb), pairs))


def confirmed(t: Tables) -> DataFrame:
    """Evidence merged with scores; `confirmed` is the web gate."""
    return evidence.merge_evidence(scores(t), lenses.latest_evidence(t))


def stored_evidence(t: Tables) -> DataFrame:
    return lenses.latest_evidence(t).withColumnRenamed("verified", "confirmed")


def rows(t: Tables) -> DataFrame:
    """Image rows that passed the label gate; everything below starts from these.

    They are written once for all parts of a plan that start from them.
    """
    return t.once("gated rows", lambda: materialise(
        gates.label_gate(lenses.image_rows(t), lenses.label_report(t)), "gated"))


def dispositions(t: Tables, gated: DataFrame | None = None) -> DataFrame:
    pairs = mining.mine_pairs(rows(t) if gated is None else gated)
    return gates.pair_disposition(pairs, lenses.graph_store(t), stored_evidence(t))


def used_pairs(disposed: DataFrame) -> DataFrame:
    """Records of the pairs that become items."""
    return disposed.filter(c("status") == "used").select(
        "pair_id", "crop", "member_a", "member_b", "kind", "graph",
        c("member_a").alias("member_a_label"), c("member_b").alias("member_b_label"))


def selected(t: Tables, disposed: DataFrame | None = None,
             gated: DataFrame | None = None) -> DataFrame:
    """(pair, member, image) rows of used pairs with graph, label and split."""
    gated = rows(t) if gated is None else gated
    used = used_pairs(dispositions(t, gated) if disposed is None else disposed)
    placed = splits.collapse_splits(splits.assign_splits(gated))
    return items.select_items(placed, used, lenses.visibility_labels(t), gated)


def grounded(t: Tables, disposed: DataFrame | None = None,
             gated: DataFrame | None = None) -> DataFrame:
    return items.ground_items(selected(t, disposed, gated), lenses.lay_observations(t))


def said_lines(df: DataFrame) -> DataFrame:
    """Farmer lines standing in for generated text: clean, leaking and blank ones."""
    n = F.length("img") + F.length("pair_id")
    return (df.withColumn("said_open", F.concat("observation", F.lit(" - can you help?")))
            .withColumn("said_react", F.when(n % 3 == 0, F.concat(F.lit("So it is "), F.upper("true_label")))
                        .otherwise("What now"))
            .withColumn("said_follow", F.when(n % 4 == 0, "").otherwise("Are you sure..."))
            .withColumn("said_close", F.when(n % 5 == 0, F.concat(F.lit("Not "), "distractor", F.lit("!")))
                        .otherwise("Thanks!")))


# -- the same pipeline in SQL ----------------------------------------------------------

_MD5 = "CAST('0x' || substr(md5('20260613|' || {k}), 1, 8) AS BIGINT) / 4294967296"


def _split_lens(name: str, rows: str) -> str:
    return f"""{name} AS (
  SELECT *, CASE WHEN state IN (SELECT state FROM {rows} GROUP BY state
        HAVING count(*) BETWEEN CAST(0.005 AS DOUBLE) * (SELECT count(*) FROM {rows})
          AND CAST(0.035 AS DOUBLE) * (SELECT count(*) FROM {rows}) ORDER BY md5('20260613|' || state) LIMIT 6)
      THEN 'test_heldout_region'
    WHEN crop IN (SELECT crop FROM (SELECT crop, row_number() OVER (ORDER BY md5('20260613|' || crop)) AS k,
        count(*) OVER () AS n FROM (SELECT DISTINCT crop FROM {rows})) WHERE k <= greatest(1, floor(n * 0.12)))
      THEN 'test_heldout_species'
    WHEN {_MD5.format(k='row_id')} < 0.12 THEN 'test_random' ELSE 'train' END AS split FROM {rows})"""


# Names starting with v_g stand for the rows and pairs after the label gate.
s.add_lens("v_split", _split_lens("v_split", "v_rows"), ("v_rows",))
s.add_lens("v_grows", """v_grows AS (SELECT * EXCLUDE (gate_status, questionable, host_common),
  CASE gate_status WHEN 'renamed' THEN 'Small grain' ELSE host_common END AS host_common
  FROM v_gated WHERE gate_status IN ('kept', 'renamed'))""", ("v_gated",))
s.add_lens("v_gsplit", _split_lens("v_gsplit", "v_grows"), ("v_grows",))
s.add_lens("v_gpairs", s.V_CLASS.replace("v_class AS", "v_gclass AS").replace("v_rows", "v_grows") + ",\n"
           + s.V_PAIRS.replace("v_pairs AS", "v_gpairs AS").replace("v_class", "v_gclass"), ("v_grows",))
s.add_lens("v_disp", """v_disp AS (
  SELECT p.*, g.errors, g.confusable, g.sign_a, g.sign_b, g.management_a, g.management_b, g.has_lay,
    g.farmer_lay_report, g.decisive_lay_a, g.decisive_lay_b, e.source_url, e.quote,
    CASE WHEN g.pair_id IS NULL THEN 'pending' WHEN len(g.errors) > 0 THEN 'pending_invalid_graph'
      WHEN NOT g.confusable THEN 'non_confusable' WHEN e.pair_id IS NULL THEN 'no_evidence'
      WHEN NOT e.verified THEN 'web_rejected' ELSE 'used' END AS status
  FROM v_gpairs p LEFT JOIN v_gerr g ON g.pair_id = p.pair_id LEFT JOIN v_store e ON e.pair_id = p.pair_id)""",
    ("v_gpairs", "v_gerr", "v_store"))
s.add_lens("v_sel", """v_sel AS (
  SELECT d.* EXCLUDE (crop), r.*, l.* EXCLUDE (img), side
  FROM v_disp d, (VALUES ('a'), ('b')) m(side), v_gsplit r LEFT JOIN v_label l ON l.img = r.img
  WHERE d.status = 'used' AND r.crop = d.crop
    AND r.disease = CASE side WHEN 'a' THEN d.member_a ELSE d.member_b END)""",
    ("v_disp", "v_gsplit", "v_label"))
_OBS = s.strip_tail("CASE WHEN lay_observation <> '' THEN lay_observation ELSE farmer_lay_report END")
s.add_lens("v_ground", f"""v_g0 AS (
  SELECT *, CASE side WHEN 'a' THEN member_a ELSE member_b END AS true_label,
    CASE side WHEN 'a' THEN member_b ELSE member_a END AS distractor,
    CASE side WHEN 'a' THEN decisive_lay_a ELSE decisive_lay_b END AS sign_true_full,
    CASE side WHEN 'a' THEN decisive_lay_b ELSE decisive_lay_a END AS sign_other_full,
    CASE side WHEN 'a' THEN sign_a ELSE sign_b END AS tech_sign, host_common AS host,
    anatomical_part AS part, {_OBS} AS said FROM v_sel
  WHERE is_closeup AND decisive_sign_visible AND has_lay),
v_g1 AS ({s.head_sign('sign_true_full', 'v_g0')}),
v_g2 AS (SELECT * EXCLUDE (s0, s1, s2, s3, s4, s5, sign), sign AS sign_true FROM v_g1),
v_g3 AS ({s.head_sign('sign_other_full', 'v_g2')}),
v_ground AS (SELECT * EXCLUDE (s0, s1, s2, s3, s4, s5, sign, management_a, management_b), sign AS sign_other,
  CASE WHEN (sign_a <> '' AND contains(lower(said), lower(sign_a)))
    OR (sign_b <> '' AND contains(lower(said), lower(sign_b)))
    THEN {s.strip_tail('farmer_lay_report')} ELSE said END AS observation,
  CASE side WHEN 'a' THEN {s.strip_tail(s.strip("regexp_replace(management_a, '(?s)^[^:]*:', '')"))}
    ELSE {s.strip_tail(s.strip('management_b'))} END AS management FROM v_g3)""", ("v_sel",))
