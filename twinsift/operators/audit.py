"""Reports: coverage, fill rates, drop reasons, distributions, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from twinsift import fixed_values as fv


def counts(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def class_report(rows: DataFrame, minimum: int = fv.CLASS_THRESHOLD,
                 cap: int | None = None) -> DataFrame:
    """Candidate and kept rows per class, largest classes first."""
    kept = F.least(F.col("candidate_rows"), F.lit(cap)) if cap else F.col("candidate_rows")
    return (counts(rows, "crop", "disease", name="candidate_rows")
            .filter(F.col("candidate_rows") >= minimum)
            .withColumn("kept_rows", kept.cast("bigint"))
            .orderBy(F.desc("candidate_rows"), "crop", "disease"))


def fill_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, filled, total, whole percent) in one pass over the table."""
    sums = df.agg(F.count("*").alias("total"), *[
        F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(c)
        for c in columns])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in columns]))
    percent = F.floor(100 * F.col("filled") / F.greatest(F.col("total"), F.lit(1)))
    return (sums.select("total", pairs.alias("p")).select("p.*", "total")
            .withColumn("percent", percent.cast("bigint")))


def drop_report(statuses: DataFrame, minimum: int = fv.CLASS_THRESHOLD,
                cap: int = 0) -> DataFrame:
    """Rows lost per reason, classes and rows under the threshold, rows trimmed by a cap.

    `statuses` has drop_reason, norm_crop, norm_disease.
    """
    per_class = (statuses.groupBy("norm_crop", "norm_disease", "drop_reason")
                 .agg(F.count("*").alias("n")))
    reason, n = F.col("drop_reason"), F.col("n")
    usable, small = reason.isNull(), F.col("n") < minimum
    trimmed = F.greatest(F.lit(0), n - cap) if cap else F.lit(0)

    def total(cond, value=n):
        return F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("bigint")

    return per_class.agg(
        total(reason == "no_crop").alias("no_crop"),
        total(reason == "no_disease").alias("no_disease"),
        total(reason == "no_state").alias("no_state"),
        total(usable & small).alias("rows_under_threshold"),
        F.count_if(usable & small).alias("classes_under_threshold"),
        F.count_if(usable & ~small).alias("classes_kept"),
        total(usable & ~small, trimmed).alias("rows_trimmed"))


def coverage_summary(dispositions: DataFrame, checked: DataFrame) -> DataFrame:
    """(section, key, n): pairs by status, items by split, failed checks, overall result.

    `checked` has split and failures, an array of failed checks. Items are counted in one pass;
    the overall result is derived from the counts.
    """
    def entry(section: str, key):
        return F.struct(F.lit(section).alias("section"), key.alias("key"))

    marks = F.concat(F.array(entry("splits", F.col("split"))),
                     F.transform("failures", lambda f: entry("failures", f)))
    counted = (checked.select(F.explode(marks).alias("m")).groupBy("m.section", "m.key")
               .agg(F.count("*").alias("n")))
    # A row per split and per kind of failure; their list is as short as these vocabularies.
    listed = counted.agg(
        F.collect_list(F.struct("section", "key", "n")).alias("_all"),
        F.coalesce(F.sum(F.when(F.col("section") == "failures", F.col("n"))), F.lit(0)).alias("_failed"))
    verdict = F.struct(F.lit("selfcheck").alias("section"),
                       F.when(F.col("_failed") == 0, "PASS").otherwise("FAIL").alias("key"),
                       F.col("_failed").alias("n"))
    of_items = listed.select(F.inline(F.concat("_all", F.array(verdict))))
    pairs = counts(dispositions, "status").select(
        F.lit("pairs").alias("section"), F.col("status").alias("key"), "n")
    return pairs.unionByName(of_items)


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """Checked, confirmed and lane counts, image total, pass rate and projection."""
    c = F.col
    confirmed = F.coalesce(c("confirmed"), F.lit(False))
    out = manifest.agg(
        F.count("*").alias("n_pairs"), F.count_if("web_checked").alias("n_checked"),
        F.count_if(confirmed).alias("n_confirmed"),
        F.count_if(confirmed & (c("lane_hint") == "image_ambiguous")).alias("lane_ambiguous"),
        F.count_if(confirmed & (c("lane_hint") == "image_decisive")).alias("lane_decisive"),
        F.count_if(confirmed & c("lane_hint").isNull()).alias("lane_unscored"),
        F.count_if("needs_web").alias("n_needs_web"),
        F.coalesce(F.sum(F.when(confirmed, c("n_imgs_total"))), F.lit(0)).alias("n_images"))
    rate = F.try_divide(c("n_confirmed"), c("n_checked"))
    return (out.withColumn("pass_rate", F.round(rate, 4))
            .withColumn("projected_confirmed", F.round(rate * c("n_pairs"), 0).cast("bigint")))


def label_quality_summary(report: DataFrame) -> DataFrame:
    """Crops by verdict and diseases by verdict over the whole label report."""
    verdict = F.col("crop_validation.verdict")
    bad = F.coalesce(verdict.isin(*fv.BAD_CROP_VERDICTS), F.lit(False))
    skipped = F.coalesce(F.col("disease_check.skipped"), F.lit(False))
    judged = F.when(~skipped, F.col("disease_check.disease_verdicts"))

    def having(name: str):
        return F.coalesce(F.sum(F.size(F.filter(judged, lambda v: v["verdict"] == name))),
                          F.lit(0)).alias(f"diseases_{name.lower()}")

    renamed = F.coalesce(verdict == fv.RENAME_VERDICT, F.lit(False))
    return report.agg(
        F.count("*").alias("records"), F.count_if(bad).alias("crops_invalid"),
        F.count_if(renamed).alias("crops_misspelled"),
        F.count_if(~bad & ~renamed).alias("crops_valid"),
        F.coalesce(F.sum(F.when(judged.isNotNull(), F.size(judged))), F.lit(0)).alias("diseases"),
        having("INCORRECT"), having("QUESTIONABLE"))


def visibility_summary(labels: DataFrame) -> DataFrame:
    """Labels, close-ups and visible signs per part."""
    return labels.groupBy("anatomical_part").agg(
        F.count("*").alias("n_labels"), F.count_if("is_closeup").alias("n_closeup"),
        F.count_if("decisive_sign_visible").alias("n_visible"))


def dialogue_stats(dialogues: DataFrame) -> DataFrame:
    """Dialogues and repairs per personality and length."""
    return dialogues.groupBy("personality", "n_turns").agg(
        F.count("*").alias("n_dialogues"), F.sum("leak_repairs").alias("leak_repairs"))


def review_sample(items: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """One line per pair for a manual review sheet.

    The representative is the first item of the pair. The other member is shown by its own
    first item, else by its first raw image.
    """
    # A pair has two labels, so its list of first items has two entries.
    entry = F.struct("item_id", "img", "true_label", "distractor")
    firsts = (items.groupBy("pair_id", "true_label").agg(F.min(entry).alias("e"))
              .groupBy("pair_id").agg(F.min("e").alias("r"), F.collect_list("e").alias("_by_label")))
    own = F.get(F.filter("_by_label", lambda e: e["true_label"] == F.col("r.distractor")), F.lit(0))
    rep = firsts.select("pair_id", "r.*", own["img"].alias("item_img"))
    raw = (rows.groupBy("crop", F.col("disease").alias("distractor"))
           .agg(F.min_by("img", "row_id").alias("raw_img")))
    return (rep.join(pairs.select("pair_id", "crop"), "pair_id", "left")
            .join(raw, ["crop", "distractor"], "left")
            .select("pair_id", "crop", "true_label", F.col("img").alias("true_img"), "distractor",
                    F.coalesce("item_img", "raw_img").alias("distractor_img"),
                    F.when(F.col("item_img").isNotNull(), "item")
                    .when(F.col("raw_img").isNotNull(), "raw").alias("distractor_source")))


def per_class_cap(rows: DataFrame, cap: int) -> DataFrame:
    """First `cap` rows per class by numeric image number (other texts count as zero).

    Map tasks pass on at most `cap` rows per class, so a hot class stays small in the shuffle.
    """
    number = F.when(F.col("img").rlike(r"\A[0-9]+\z"), F.col("img").try_cast("bigint"))
    order = W.Window.partitionBy("crop", "disease").orderBy(
        F.coalesce(number, F.lit(0)), "row_id")
    return (rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= cap).drop("_r"))
