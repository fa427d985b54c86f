"""Journals, evidence and graph stores, merging, manifests and work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsift.operators import audit, evidence, gates
from twinsift.plans import lenses, pipeline
from twinsift.plans import sqltext as s
from twinsift.plans.registry import query
from twinsift.session import scratch_path
from twinsift.sources import readers
from twinsift.streaming import journal

c = F.col
ORDER = ["ts", "event_id"]


def _results(lines):
    """Parsed journal: kind, pair and payload of every result line, with its place in the journal."""
    results = readers.journal_results(lines)
    event = F.try_variant_get("record", "$.event_id", "bigint")
    flags = readers.has_field(["confusable_documented", "forks", "farmer_lay_report"])
    return results.select(
        F.struct(F.try_variant_get("record", "$.ts", "string").alias("ts"), event.alias("event_id")).alias("seq"),
        event.alias("event_id"), evidence.result_kind(*flags).alias("kind"),
        readers.result_field("pair_id").alias("pair_id"),
        readers.result_field("source_type").alias("source_type"), readers.result_field("quote").alias("quote"),
        "result",
        readers.result_field("farmer_lay_report").alias("farmer_lay_report"),
        readers.result_field("confusable_documented", "boolean").alias("documented"))


def _typed(t):
    return _results(lenses.journal(t))


@query("ingest_journal", s.with_lenses("v_evid", """
SELECT event_id, pair_id, CASE event_type WHEN 'click' THEN 'evidence' WHEN 'view' THEN 'graph' ELSE 'lay' END AS kind
FROM v_evid WHERE event_type IN ('click', 'view', 'error')"""))
def ingest_journal(t):
    return _typed(t).filter("kind is not null").select("event_id", "pair_id", "kind")


_KINDS = """(SELECT *, CASE event_type WHEN 'click' THEN 'evidence' WHEN 'view' THEN 'graph' WHEN 'error' THEN 'lay' END
  AS kind FROM v_evid WHERE event_type IN ('click', 'view', 'error'))"""


_FIRST = f"""v_first AS (
  SELECT *, event_id % 4 AS form FROM {_KINDS} WHERE pair_id IN (SELECT pair_id FROM v_pairs)
  QUALIFY row_number() OVER (PARTITION BY kind, pair_id ORDER BY ts, event_id) = 1),
v_checked AS (SELECT *, CASE WHEN kind = 'graph' AND form > 0 THEN 'rejected' ELSE 'kept' END AS status,
  CASE WHEN kind <> 'graph' OR form = 0 THEN '' WHEN form = 1 THEN 'not confusable'
    WHEN form = 2 THEN 'confusable must be bool'
    ELSE 'missing key: confusable_reason; missing key: shared_presentation; missing key: narrative_a; '
      || 'missing key: narrative_b; missing key: management_a; missing key: management_b; '
      || 'missing key: geo_localizable_a; missing key: geo_localizable_b' END AS reasons FROM v_first)"""


def _checked(t):
    return evidence.checked_journal(evidence.typed_journal(_typed(t), lenses.candidate_pairs(t)))


@query("journal_typed", s.with_lenses("v_evid v_pairs", f""", {_FIRST}
SELECT kind, pair_id, event_id, CASE kind WHEN 'evidence' THEN source_type END AS source_type, status, reasons
FROM v_checked"""))
def journal_typed(t):
    return _checked(t).select("kind", "pair_id", "event_id", "source_type", "status",
                              F.array_join("reasons", "; ").alias("reasons"))


@query("journal_kept", s.with_lenses("v_evid v_pairs", f""", {_FIRST}
SELECT pair_id, event_id, kind FROM v_checked WHERE status = 'kept'"""))
def journal_kept(t):
    path = scratch_path(t.spark, "journal-store")
    evidence.persist_journal(_checked(t).drop("result"), path)
    return t.spark.read.parquet(f"{path}/status=kept").select("pair_id", "event_id", "kind")


@query("journal_counts", s.with_lenses("v_evid v_pairs", f""", {_FIRST}
SELECT count_if(kind = 'evidence') AS n_web,
  count_if(kind = 'evidence' AND documented AND quote <> '' AND source_type <> 'other') AS n_web_ok,
  count_if(kind = 'graph' AND status = 'kept') AS n_graph, count_if(kind = 'graph' AND status = 'rejected') AS n_graph_bad
FROM v_checked"""))
def journal_counts(t):
    counts = evidence.persist_journal(_checked(t).drop("result"), scratch_path(t.spark, "journal-store"))
    return t.spark.createDataFrame([counts], "n_web long, n_web_ok long, n_graph long, n_graph_bad long")


@query("dedupe_first", s.with_lenses("v_evid", """
SELECT event_type AS kind, pair_id, event_id FROM v_evid
QUALIFY row_number() OVER (PARTITION BY event_type, pair_id ORDER BY ts, event_id) = 1"""))
def dedupe_first(t):
    return evidence.first_per_key(lenses.evidence(t), ["event_type", "pair_id"], ORDER).select(
        c("event_type").alias("kind"), "pair_id", "event_id")


PARTS = 3           # journal parts of the stream, a micro-batch each
PART_FILES = 8


@query("journal_stream", s.with_lenses("v_evid", f"""
SELECT kind, pair_id, event_id FROM {_KINDS}
QUALIFY row_number() OVER (PARTITION BY kind, pair_id ORDER BY ts, event_id) = 1"""))
def journal_stream(t):
    """The journal grows by ranges of time; each is a micro-batch of a stream over its folder."""
    lines = lenses.journal_lines(t)
    folder, store, marks = (scratch_path(t.spark, f"journal-{n}") for n in ("lines", "store", "checkpoint"))
    at = F.unix_micros(c("ts").cast("timestamp"))
    cuts = t.events.agg(F.approx_percentile(at, [i / PARTS for i in range(1, PARTS)])).first()[0] or []
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:]):
        part = lines if low is None else lines.filter(at > low)
        part = part if high is None else part.filter(at <= high)
        part.select("value").repartition(PART_FILES).write.mode("append").text(folder)
    stream = t.spark.readStream.option("maxFilesPerTrigger", PART_FILES).text(folder)
    results = _results(stream).filter("kind is not null").select("kind", "pair_id", "seq", "event_id")
    journal.ingest(results, store, marks, ["kind", "pair_id"], ["seq"]).awaitTermination()
    return t.spark.read.parquet(store).select("kind", "pair_id", "event_id")


@query("upsert_store", s.with_lenses("v_evid", """
SELECT pair_id, event_id, source_url FROM v_evid
QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY event_type <> 'click', ts DESC, event_id DESC) = 1"""))
def upsert_store(t):
    e = lenses.evidence(t)
    return evidence.upsert(e.filter("event_type <> 'click'"), e.filter("event_type = 'click'"),
                           ["pair_id"], ORDER).select("pair_id", "event_id", "source_url")


@query("evidence_struct", s.with_lenses("v_store", """
SELECT pair_id, verified AS web_verified, quote AS web_quote, source_url AS web_source_url,
  source_type || '/' || member_a AS web_source_title FROM v_store"""))
def evidence_struct(t):
    record = F.struct(
        c("verified").alias("web_verified"), c("quote").alias("web_quote"),
        c("source_url").alias("web_source_url"),
        F.concat_ws("/", "source_type", "member_a").alias("web_source_title"))
    return lenses.latest_evidence(t).select("pair_id", record.alias("evidence")).select("pair_id", "evidence.*")


@query("evidence_merge", s.with_lenses("v_scores v_store", """
SELECT coalesce(s.pair_id, e.pair_id) AS pair_id, e.crop, coalesce(verified, false) AS confirmed,
  coalesce(matched_cross_knn >= 0.2, false) AS image_confusable,
  CASE WHEN matched_cross_knn >= 0.2 THEN 'image_ambiguous' WHEN matched_cross_knn < 0.2 THEN 'image_decisive' END
    AS lane_hint, matched_cross_knn IS NOT NULL AS scored, quote, source_type
FROM v_scores s FULL JOIN v_store e ON s.pair_id = e.pair_id"""))
def evidence_merge(t):
    return pipeline.confirmed(t).select("pair_id", "crop", "confirmed", "image_confusable", "lane_hint",
                                        "scored", "quote", "source_type")


s.add_lens("v_manifest", """v_manifest AS (
  SELECT p.pair_id, p.crop, p.member_a, p.member_b, n_imgs_a, n_imgs_b, n_imgs_a + n_imgs_b AS n_imgs_total, lookalike_prior,
    array_to_string(shared_descriptors, ',') AS descriptors,
    e.pair_id IS NOT NULL AS web_checked, coalesce(verified, false) AS web_verified, source_url,
    matched_cross_knn, CASE WHEN matched_cross_knn >= 0.2 THEN 'image_ambiguous'
      WHEN matched_cross_knn < 0.2 THEN 'image_decisive' END AS lane_hint
  FROM v_pairs p LEFT JOIN v_store e USING (pair_id) LEFT JOIN v_scores s USING (pair_id))""",
    ("v_pairs", "v_store", "v_scores"))


def manifest(t):
    return evidence.pair_manifest(lenses.candidate_pairs(t), lenses.latest_evidence(t), pipeline.scores(t))


@query("pair_manifest", s.with_lenses("v_manifest", """
SELECT pair_id, crop, member_a, member_b, n_imgs_a, n_imgs_b, n_imgs_total, lookalike_prior, descriptors, web_checked,
  web_verified, source_url, matched_cross_knn, lane_hint, NOT web_checked AS needs_web FROM v_manifest"""))
def pair_manifest(t):
    return manifest(t).select("pair_id", "crop", "member_a", "member_b", "n_imgs_a", "n_imgs_b", "n_imgs_total",
                              "lookalike_prior", F.array_join("shared_descriptors", ",").alias("descriptors"),
                              "web_checked", "web_verified", "source_url", "matched_cross_knn", "lane_hint",
                              "needs_web")


@query("manifest_summary", s.with_lenses("v_manifest", """
SELECT count(*) AS n_pairs, count(*) FILTER (web_checked) AS n_checked, count(*) FILTER (web_verified) AS n_confirmed,
  count(*) FILTER (web_verified AND lane_hint = 'image_ambiguous') AS lane_ambiguous,
  count(*) FILTER (web_verified AND lane_hint = 'image_decisive') AS lane_decisive,
  count(*) FILTER (web_verified AND lane_hint IS NULL) AS lane_unscored,
  count(*) FILTER (NOT web_checked) AS n_needs_web,
  CAST(coalesce(sum(n_imgs_total) FILTER (web_verified), 0) AS BIGINT) AS n_images,
  round(count(*) FILTER (web_verified) / nullif(count(*) FILTER (web_checked), 0), 4) AS pass_rate,
  CAST(round(count(*) FILTER (web_verified) / nullif(count(*) FILTER (web_checked), 0) * count(*)) AS BIGINT)
    AS projected_confirmed FROM v_manifest"""))
def manifest_summary(t):
    return audit.manifest_summary(manifest(t))


@query("needs_web_worklist", s.with_lenses("v_pairs v_evid", """
SELECT pair_id, crop, member_a, member_b, lookalike_prior FROM v_pairs
WHERE pair_id NOT IN (SELECT pair_id FROM v_evid WHERE event_type = 'click')"""))
def needs_web_worklist(t):
    clicks = lenses.evidence(t).filter("event_type = 'click'")
    return evidence.needs_web(evidence.pending(lenses.candidate_pairs(t), clicks, ["pair_id"]))


@query("pending_work", s.with_lenses("v_pairs v_evid", """
SELECT pair_id, crop FROM v_pairs WHERE pair_id NOT IN (SELECT pair_id FROM v_evid WHERE event_type = 'view')"""))
def pending_work(t):
    done = lenses.evidence(t).filter("event_type = 'view'")
    return evidence.pending(lenses.candidate_pairs(t), done, ["pair_id"]).select("pair_id", "crop")


@query("set_difference_new", s.with_lenses("v_evid", """
SELECT DISTINCT pair_id FROM v_evid WHERE ts >= TIMESTAMP '2024-01-20'
  AND pair_id NOT IN (SELECT pair_id FROM v_evid WHERE ts < TIMESTAMP '2024-01-20')"""))
def set_difference_new(t):
    e = lenses.evidence(t)
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    fresh = e.filter(c("ts") >= cut).select("pair_id").distinct()
    return evidence.pending(fresh, e.filter(c("ts") < cut), ["pair_id"])


@query("read_keyed_json", """
SELECT event_id, 'k' AS key, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS value FROM events
UNION ALL SELECT event_id, event_type, user_id FROM events""")
def read_keyed_json(t):
    document = F.concat(F.lit('{"n":1,"scores":{"'), "event_type", F.lit('":'), c("user_id").cast("string"),
                        F.lit(","), F.regexp_replace("props", r"^\{|\}$", ""), F.lit("}}"))
    return t.events.select("event_id", *readers.keyed_json(document, "bigint", sub_key="scores"))


@query("graph_union", s.with_lenses("v_gstore", "SELECT pair_id, source, conv_id, turn FROM v_gstore"))
def graph_union(t):
    return lenses.graph_store(t).select("pair_id", "source", "conv_id", "turn")


def _lay_results(t):
    """Every lay result of the journal: the layer is overwritten line by line."""
    lay = _typed(t).filter("kind = 'lay'")
    return lay.select("pair_id", "seq", "farmer_lay_report", F.lit("see a").alias("decisive_lay_a"),
                      F.lit("see b").alias("decisive_lay_b"), F.lit(True).alias("decisive_micro_a"),
                      F.lit(None).cast("boolean").alias("decisive_micro_b"))


s.add_lens("v_lay", """v_lay AS (SELECT pair_id, 'seen in event ' || event_id AS report FROM v_evid
  WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY ts DESC, event_id DESC) = 1)""",
    ("v_evid",))


@query("lay_merge", s.with_lenses("v_gstore v_lay", """
SELECT g.pair_id, coalesce(report, CASE WHEN has_lay THEN farmer_lay_report END) AS farmer_lay_report,
  CASE WHEN report IS NOT NULL THEN 'see b' WHEN has_lay THEN decisive_lay_b END AS decisive_lay_b
FROM v_gstore g LEFT JOIN v_lay l ON l.pair_id = g.pair_id"""))
def lay_merge(t):
    merged = evidence.merge_lay(lenses.graph_store(t), _lay_results(t))
    return merged.select("pair_id", "graph.lay.farmer_lay_report", "graph.lay.decisive_lay_b")


@query("lay_missing_graphs", s.with_lenses("v_gstore v_evid", """
SELECT count(*) AS n_missing FROM v_evid
WHERE event_type = 'error' AND pair_id NOT IN (SELECT pair_id FROM v_gstore)"""))
def lay_missing_graphs(t):
    missing = evidence.pending(_lay_results(t), lenses.graph_store(t), ["pair_id"])
    return missing.agg(F.count("*").alias("n_missing"))


@query("member_signs", s.with_lenses("v_store v_gerr", """
SELECT crop, disease, arg_max(sign, pair_id) AS sign FROM (
  SELECT e.crop, e.member_a AS disease, g.sign_a AS sign, e.pair_id FROM v_store e JOIN v_gerr g ON g.pair_id = e.pair_id
    WHERE verified AND sign_a IS NOT NULL
  UNION ALL SELECT e.crop, e.member_b, g.sign_b, e.pair_id FROM v_store e JOIN v_gerr g ON g.pair_id = e.pair_id
    WHERE verified AND sign_a IS NOT NULL) GROUP BY ALL"""))
def member_signs(t):
    fork = gates.decisive_fork(c("graph.forks"))
    graphs = lenses.graph_store(t).select("pair_id", fork["a_signal"].alias("sign_a"),
                                          fork["b_signal"].alias("sign_b"))
    return evidence.member_signs(pipeline.stored_evidence(t), graphs)


@query("read_graph_store", s.with_lenses("v_gstore", """
SELECT pair_id, len(lines) AS n_forks, confusable, has_lay, management_b FROM v_gstore"""))
def read_graph_store(t):
    path = scratch_path(t.spark, "graphs")
    fields = ["pair_id", "kind", "crop", "member_a_label", "member_b_label", "source", "graph"]
    lenses.graph_store(t).select(*fields).write.json(path)
    return readers.graph_store(t.spark, path).select(
        "pair_id", F.size("graph.forks").alias("n_forks"), "graph.confusable",
        c("graph.lay").isNotNull().alias("has_lay"), "graph.management_b")
