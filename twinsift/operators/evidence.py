"""Evidence records: journal typing, keyed stores, merging with scores, work lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import window as W

from twinsift import fixed_values as fv
from twinsift.functions import labels
from twinsift.operators import gates


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key in the given order. Every map task passes on one row per key."""
    number = F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", number).filter(F.col("_r") == 1).drop("_r")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_per_key(df, keys, [F.desc(c) for c in order])


def upsert(store: DataFrame, changes: DataFrame, keys: Sequence[str],
           order: Sequence[str]) -> DataFrame:
    """Store after adding or replacing records by key; the latest change wins."""
    base = store.withColumn("_age", F.lit(0))
    newer = changes.withColumn("_age", F.lit(1))
    return latest_per_key(base.unionByName(newer), keys, ["_age", *order]).drop("_age")


def result_kind(has_documented: Column, has_forks: Column, has_lay: Column) -> Column:
    """Kind of a journal result, told apart by which key it carries."""
    return (F.when(has_documented, "evidence").when(has_forks, "graph").when(has_lay, "lay"))


def typed_journal(results: DataFrame, known_pairs: DataFrame) -> DataFrame:
    """Journal results of known pairs, first one per (kind, pair_id) in journal order.

    Repeats go first, so that the join sees each pair once per kind.
    """
    first = first_per_key(results.filter(F.col("kind").isNotNull()), ["kind", "pair_id"], ["seq"])
    return first.join(known_pairs.select("pair_id").distinct(), "pair_id", "left_semi")


def checked_journal(typed: DataFrame, graph: str = "result") -> DataFrame:
    """Add `status` and `reasons` to first-wins journal results.

    A graph result is kept if it has no faults and says that its pair is confusable; else it is
    set aside with the reasons. Evidence and lay results are kept.
    """
    errors = gates.document_errors(F.col(graph))
    confusable = F.try_variant_get(graph, "$.confusable", "boolean")
    reasons = F.when(F.col("kind") == "graph", F.when(F.size(errors) > 0, errors).when(
        ~F.coalesce(confusable, F.lit(False)), F.array(F.lit("not confusable"))))
    reasons = F.coalesce(reasons, F.array().cast("array<string>"))
    return (typed.withColumn("reasons", reasons)
            .withColumn("status", F.when(F.size("reasons") > 0, "rejected").otherwise("kept")))


def persist_journal(checked: DataFrame, path: str) -> dict[str, int]:
    """Write kept and rejected results to folders of their own, and count them in the same pass."""
    counts = Observation("journal")
    evidence, graph = F.col("kind") == "evidence", F.col("kind") == "graph"
    kept = F.col("status") == "kept"
    verified = labels.credible(F.col("documented"), F.col("quote"),
                               F.coalesce(F.col("source_type"), F.lit(fv.SOURCE_TYPE_DEFAULT)))
    (checked.observe(counts, F.count_if(evidence).alias("n_web"), F.count_if(evidence & verified).alias("n_web_ok"),
                     F.count_if(graph & kept).alias("n_graph"), F.count_if(graph & ~kept).alias("n_graph_bad"))
     .write.partitionBy("status").parquet(path))
    return counts.get


def verified_evidence(evidence: DataFrame) -> DataFrame:
    """Add `verified`: documented, quoted, credible type; untyped sources count as other."""
    kind = F.coalesce(F.col("source_type"), F.lit(fv.SOURCE_TYPE_DEFAULT))
    return evidence.withColumn("source_type", kind).withColumn(
        "verified", labels.credible(F.col("documented"), F.col("quote"), kind))


def merge_evidence(scores: DataFrame, evidence: DataFrame,
                   gate: float = fv.LANE_GATE) -> DataFrame:
    """Full outer merge: web evidence is the gate, the image score only routes to a lane.

    `lane_hint` uses the score as it is; `lane_hint_supported` only where its support is ok.
    """
    s = scores.select("pair_id", "matched_cross_knn", "matched_support", "ok")
    e = evidence.select("pair_id", "crop", "member_a", "member_b", "verified", "quote",
                        "source_url", "source_type")
    score = F.col("matched_cross_knn")
    verified = F.coalesce(F.col("verified"), F.lit(False))
    return (s.join(e, "pair_id", "full_outer")
            .select("pair_id", "crop", "member_a", "member_b",
                    verified.alias("confirmed"), verified.alias("web_verified"),
                    F.coalesce(score >= gate, F.lit(False)).alias("image_confusable"),
                    labels.lane_hint(score, gate).alias("lane_hint"),
                    F.when(F.col("ok"), labels.lane_hint(score, gate)).alias("lane_hint_supported"),
                    score.isNotNull().alias("scored"), score, "matched_support",
                    "quote", "source_url", "source_type"))


def pair_manifest(pairs: DataFrame, evidence: DataFrame, scores: DataFrame,
                  gate: float = fv.LANE_GATE) -> DataFrame:
    """Candidate pairs with the state of their evidence and score."""
    e = evidence.select("pair_id", F.lit(True).alias("_checked"), "verified", "source_url")
    s = scores.select("pair_id", "matched_cross_knn")
    checked = F.coalesce(F.col("_checked"), F.lit(False))
    verified = F.coalesce(F.col("verified"), F.lit(False))
    return (pairs.join(e, "pair_id", "left").join(s, "pair_id", "left")
            .select("pair_id", "crop", "member_a", "member_b", "n_imgs_a", "n_imgs_b",
                    (F.col("n_imgs_a") + F.col("n_imgs_b")).alias("n_imgs_total"),
                    "lookalike_prior", "same_pathogen_class", "shared_descriptors", checked.alias("web_checked"),
                    verified.alias("web_verified"), verified.alias("confirmed"), "source_url",
                    F.col("matched_cross_knn").isNotNull().alias("scored"), "matched_cross_knn",
                    labels.lane_hint(F.col("matched_cross_knn"), gate).alias("lane_hint"),
                    (~checked).alias("needs_web")))


def needs_web(unchecked: DataFrame) -> DataFrame:
    """Unchecked pairs with minimal context, most promising first."""
    return (unchecked.select("pair_id", "crop", "member_a", "member_b", "lookalike_prior")
            .orderBy(F.desc("lookalike_prior"), "pair_id"))


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work that has no result yet."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def merge_lay(graphs: DataFrame, lay: DataFrame) -> DataFrame:
    """Graphs with their lay layer replaced where a lay result exists; the last one wins."""
    newest = latest_per_key(lay, ["pair_id"], ["seq"]).select(
        "pair_id", F.struct(*fv.LAY_FIELDS).alias("_lay"))
    merged = F.coalesce(F.col("_lay"), F.col("graph.lay"))
    return (graphs.join(newest, "pair_id", "left")
            .withColumn("graph", F.col("graph").withField("lay", merged)).drop("_lay"))


def graph_union(gold: DataFrame, generated: DataFrame) -> DataFrame:
    """Gold and generated graphs; on a conflict the generated one wins."""
    both = gold.withColumn("_precedence", F.lit(1)).unionByName(
        generated.withColumn("_precedence", F.lit(0)))
    return first_per_key(both, ["pair_id"], ["_precedence", F.desc("seq")]).drop("_precedence")


def member_signs(confirmed: DataFrame, graphs: DataFrame) -> DataFrame:
    """Decisive sign per (crop, disease) over confirmed pairs; a later pair overwrites.

    Pairs are ordered by pair id, as they are stored.
    """
    joined = confirmed.filter("confirmed").join(
        graphs.select("pair_id", "sign_a", "sign_b").filter(F.col("sign_a").isNotNull()), "pair_id")
    members = F.explode(F.array(
        F.struct(F.col("member_a").alias("disease"), F.col("sign_a").alias("sign")),
        F.struct(F.col("member_b").alias("disease"), F.col("sign_b").alias("sign"))))
    return (joined.withColumn("_m", members).groupBy("crop", F.col("_m.disease").alias("disease"))
            .agg(F.max_by(F.col("_m.sign"), F.col("pair_id")).alias("sign")))
