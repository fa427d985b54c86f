"""Filters, gates and validators. Rows are never dropped silently: statuses carry the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift import dims
from twinsift import fixed_values as fv
from twinsift.functions import geo, labels, text
from twinsift.operators.skew import attach_class, checked_join
from twinsift.session import materialise

CLASS = ["crop", "disease"]


# -- label gate ------------------------------------------------------------------------

def verdict_table(report: DataFrame, drop_questionable: bool = False) -> DataFrame:
    """Verdicts of the label report per crop (of_crop = 1) and per judged (crop, disease).

    Crops have bad_crop and canonical_crop; `incorrect` is null for what is not flagged. Records of
    bad crops judge no diseases. One pass over the report gives both levels.
    """
    wanted = ["INCORRECT"] + (["QUESTIONABLE"] if drop_questionable else [])
    verdict = F.col("crop_validation.verdict")
    canonical = text.present(F.col("crop_validation.canonical_name"))
    judged = report.select(
        "crop", F.coalesce(verdict.isin(*fv.BAD_CROP_VERDICTS), F.lit(False)).alias("_bad"),
        F.when(verdict == fv.RENAME_VERDICT, canonical).alias("_canonical"),
        F.explode_outer("disease_check.disease_verdicts").alias("_v"))
    flagged = F.when(~F.col("_bad") & F.col("_v.verdict").isin(*wanted), F.col("_v.verdict") == "INCORRECT")
    return (judged.select("crop", "_bad", "_canonical", F.col("_v.disease").alias("disease"), flagged.alias("_flag"))
            .groupingSets([["crop"], CLASS], *CLASS)
            .agg(F.grouping("disease").alias("of_crop"), F.bool_or("_bad").alias("bad_crop"),
                 F.max("_canonical").alias("canonical_crop"), F.bool_or("_flag").alias("incorrect")))


def judge_rows(rows: DataFrame, report: DataFrame, drop_questionable: bool = False) -> DataFrame:
    """Add `gate_status` to every row and rename misspelled crops on surviving rows.

    Statuses: bad_crop, incorrect_disease, questionable_disease (only if asked for), renamed,
    kept. Disease verdicts are looked up under the crop name before renaming.
    """
    # The table is one row per class, written once, so the planner knows its bytes.
    verdicts = materialise(verdict_table(report, drop_questionable), "verdicts")
    crops = verdicts.filter("of_crop = 1").select("crop", "bad_crop", "canonical_crop")
    flagged = verdicts.filter("of_crop = 0 AND incorrect IS NOT NULL").select(*CLASS, "incorrect")
    joined = rows.join(crops, "crop", "left").join(flagged, CLASS, "left")
    status = (F.when(F.coalesce(F.col("bad_crop"), F.lit(False)), "bad_crop")
              .when(F.col("incorrect"), "incorrect_disease")
              .when(F.col("incorrect").isNotNull(), "questionable_disease")
              .when(F.col("canonical_crop").isNotNull(), "renamed").otherwise("kept"))
    renamed = F.col("gate_status") == "renamed"
    return (joined.withColumn("gate_status", status)
            .withColumn("crop", F.when(renamed, F.col("canonical_crop")).otherwise(F.col("crop")))
            .withColumn("host_common", F.when(renamed, F.col("canonical_crop"))
                        .otherwise(F.col("host_common")))
            .drop("bad_crop", "canonical_crop", "incorrect"))


def label_gate(rows: DataFrame, report: DataFrame | None,
               drop_questionable: bool = False) -> DataFrame:
    """Rows that pass the label report, misspelled crops renamed; all rows without a report."""
    if report is None:
        return rows
    judged = judge_rows(rows, report, drop_questionable)
    return judged.filter(F.col("gate_status").isin("kept", "renamed")).drop("gate_status")


def gate_stats(judged: DataFrame) -> DataFrame:
    status = F.col("gate_status")
    return judged.agg(
        F.count_if(status.isin("kept", "renamed")).alias("kept"),
        F.count_if(status == "bad_crop").alias("dropped_bad_crop"),
        F.count_if(status == "incorrect_disease").alias("dropped_incorrect_disease"),
        F.count_if(status == "questionable_disease").alias("dropped_questionable"),
        F.count_if(status == "renamed").alias("renamed_misspelled"))


# -- usable rows -----------------------------------------------------------------------

def usable_status(scraped: DataFrame, aliases: DataFrame) -> DataFrame:
    """Normalised labels, state centroid and zone for every scraped row, with `drop_reason`.

    `scraped` needs host_name, subject, location; `aliases` maps host_name to crop (null for
    hosts that are no crops).
    """
    joined = checked_join(scraped, aliases, ["host_name"], "left")
    located = joined.withColumn("state_key", F.lower(text.strip(
        F.coalesce(F.col("location"), F.lit("")))))
    state = dims.states(scraped.sparkSession).select("state_key", "state_lat", "state_lon")
    located = located.join(F.broadcast(state), "state_key", "left")
    disease = text.present(labels.strip_parenthetical(F.col("subject")))
    reason = (F.when(F.col("crop").isNull(), "no_crop")
              .when(F.col("norm_disease").isNull(), "no_disease")
              .when(F.col("state_lat").isNull(), "no_state"))
    return (located.withColumn("norm_disease", disease)
            .withColumn("zone", geo.zone_code(F.col("state_lat"), F.col("state_lon")))
            .withColumn("drop_reason", reason)
            .withColumnRenamed("crop", "norm_crop").drop("state_key"))


def class_threshold(rows: DataFrame, minimum: int = fv.CLASS_THRESHOLD,
                    keys=tuple(CLASS)) -> DataFrame:
    """Rows of classes with at least `minimum` rows, with the class size attached."""
    sized = attach_class(rows, list(keys), [F.count("*").alias("class_rows")])
    return sized.filter(F.col("class_rows") >= minimum)


# -- visibility and leakage ------------------------------------------------------------

def visibility_status(label_present: Column, is_closeup: Column, sign_visible: Column,
                      has_lay: Column) -> Column:
    def no(flag: Column) -> Column:
        return ~F.coalesce(flag, F.lit(False))

    return (F.when(no(label_present), "no_label").when(no(is_closeup), "not_closeup")
            .when(no(sign_visible), "sign_not_visible").when(no(has_lay), "no_lay_layer")
            .otherwise("usable"))


def guarded_observation(observation: Column, lay_report: Column, signs: Column) -> Column:
    """Farmer's observation; the graph's lay report when a technical sign would leak."""
    said = text.strip_tail(F.coalesce(F.when(observation != "", observation), lay_report))
    return F.when(text.mentions_any(said, signs), text.strip_tail(lay_report)).otherwise(said)


# -- decision graphs -------------------------------------------------------------------

def graph_errors(graph: Column) -> Column:
    """Array of problems of a decision graph struct; empty when it is valid.

    A null field is a missing key, and missing keys end the check.
    """
    missing = F.filter(
        F.array(*[F.when(graph[f].isNull(), F.lit(f"missing key: {f}")) for f in fv.GRAPH_FIELDS]),
        lambda e: e.isNotNull())
    forks = graph["forks"]
    sized = F.size(forks).between(fv.MIN_FORKS, fv.MAX_FORKS)
    checked = F.when(sized, forks).otherwise(F.filter(forks, lambda f: F.lit(False)))

    def fork_errors(fork: Column, index: Column) -> Column:
        def problem(bad: Column, *message: Column) -> Column:
            return F.when(F.coalesce(bad, F.lit(True)), F.concat(
                F.lit("fork["), index.cast("string"), F.lit("]."), *message))

        def shown(value: Column) -> Column:
            return F.coalesce(F.concat(F.lit("'"), value, F.lit("'")), F.lit("None"))

        def blank(name: str) -> Column:
            filled = text.strip(F.coalesce(fork[name], F.lit(""))) == ""
            return problem(filled, F.lit(f"{name} empty"))

        return F.array(
            problem(~fork["axis"].isin(*fv.FORK_AXES), F.lit("axis invalid: "),
                    shown(fork["axis"])),
            problem(~fork["weight"].isin(*fv.FORK_WEIGHTS), F.lit("weight invalid: "),
                    shown(fork["weight"])),
            blank("question"), blank("a_signal"), blank("b_signal"))

    decisive = F.size(F.filter(checked, lambda f: f["weight"] == "decisive"))
    own = F.array(
        F.when(text.strip(graph["confusable_reason"]) == "", "confusable_reason empty"),
        F.when(~sized, f"forks must be a list of {fv.MIN_FORKS}..{fv.MAX_FORKS} items"))
    last = F.array(F.when(graph["confusable"] & (decisive != 1), F.concat(
        F.lit("need exactly 1 decisive fork, found "), decisive.cast("string"))))
    found = F.filter(
        F.concat(own, F.flatten(F.transform(checked, fork_errors)), last),
        lambda e: e.isNotNull())
    return F.when(F.size(missing) > 0, missing).otherwise(found)


def _kind(value: Column) -> Column:
    """Type name of a variant without its element types: BOOLEAN, STRING, ARRAY, OBJECT, VOID, ..."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _said(value: Column) -> Column:
    """Text of a variant: a string as it is, anything else as JSON."""
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def _shown(value: Column) -> Column:
    """A variant as messages show it; a missing one as None."""
    said = _said(value)
    quote = F.when(F.contains(said, F.lit("'")) & ~F.contains(said, F.lit('"')), '"').otherwise("'")
    return (F.when(value.isNull() | (_kind(value) == "VOID"), "None")
            .when(_kind(value) == "BOOLEAN", F.initcap(said))
            .when(_kind(value) == "STRING", F.concat(quote, said, quote)).otherwise(said))


def _holds(value: Column) -> Column:
    """Does the variant count as true: true, a number but zero, anything that is not empty?"""
    said = _said(value)
    return (F.when(_kind(value) == "VOID", False).when(_kind(value) == "BOOLEAN", said == "true")
            .when(_kind(value) == "STRING", said != "").when(_kind(value).isin("ARRAY", "OBJECT"), ~said.isin("[]", "{}"))
            .otherwise(F.try_variant_get(value, "$", "double") != 0))


def document_errors(doc: Column) -> Column:
    """Array of problems of a decision graph as parsed JSON (a variant); empty when it is valid.

    Types are read from the values, so an ill-typed field differs from a missing one. Missing
    keys end the check; a JSON null is a value.
    """
    def field(name: str, of: Column = doc) -> Column:
        return F.try_variant_get(of, f"$.{name}", "variant")

    def bad(condition: Column, *message: Column | str) -> Column:
        return F.when(F.coalesce(condition, F.lit(True)),
                      F.concat(*[m if isinstance(m, Column) else F.lit(m) for m in message]))

    def found(*problems: Column) -> Column:
        return F.filter(F.array(*problems), lambda e: e.isNotNull())

    missing = found(*[F.when(field(f).isNull(), F.lit(f"missing key: {f}")) for f in fv.GRAPH_FIELDS])
    forks = F.try_variant_get(doc, "$.forks", "array<variant>")
    sized = F.coalesce(F.size(forks).between(fv.MIN_FORKS, fv.MAX_FORKS), F.lit(False))
    checked = F.when(sized, forks).otherwise(F.array().cast("array<variant>"))

    def fork_errors(fork: Column, i: Column) -> Column:
        at = F.concat(F.lit("fork["), i.cast("string"), F.lit("]"))

        def outside(name: str, values: tuple[str, ...]) -> Column:
            value = field(name, fork)
            return bad((_kind(value) != "STRING") | ~_said(value).isin(*values),
                       at, f".{name} invalid: ", _shown(value))

        def blank(name: str) -> Column:
            return bad(text.strip(F.coalesce(_said(field(name, fork)), F.lit(""))) == "", at, f".{name} empty")

        return F.when(_kind(fork) != "OBJECT", F.array(F.concat(at, F.lit(" not an object")))).otherwise(
            found(outside("axis", fv.FORK_AXES), outside("weight", fv.FORK_WEIGHTS),
                  *[blank(n) for n in ("question", "a_signal", "b_signal")]))

    decisive = F.size(F.filter(checked, lambda f: F.try_variant_get(f, "$.weight", "string") == "decisive"))
    own = found(
        bad(_kind(field("confusable")) != "BOOLEAN", "confusable must be bool"),
        bad(text.strip(_said(field("confusable_reason"))) == "", "confusable_reason empty"),
        bad(~sized, f"forks must be a list of {fv.MIN_FORKS}..{fv.MAX_FORKS} items"))
    last = found(
        bad(_holds(field("confusable")) & (decisive != 1), "need exactly 1 decisive fork, found ",
            decisive.cast("string")),
        *[bad(_kind(field(f)) != "BOOLEAN", f"{f} must be bool") for f in ("geo_localizable_a", "geo_localizable_b")])
    return (F.when(F.coalesce(_kind(doc) != "OBJECT", F.lit(True)), F.array(F.lit("graph is not an object")))
            .when(F.size(missing) > 0, missing)
            .otherwise(F.concat(own, F.flatten(F.transform(checked, fork_errors)), last)))


def decisive_fork(forks: Column) -> Column:
    """First fork of decisive weight, else null."""
    return F.get(F.filter(forks, lambda f: f["weight"] == "decisive"), F.lit(0))


def pair_disposition(pairs: DataFrame, graphs: DataFrame, confirmed: DataFrame,
                     require_evidence: bool = True) -> DataFrame:
    """Exactly one status per candidate pair, cheapest reason first."""
    known = graphs.select("pair_id", "kind", "graph")
    evidence = confirmed.select("pair_id", F.lit(True).alias("has_evidence"),
                                F.col("confirmed"))
    joined = pairs.join(known, "pair_id", "left").join(evidence, "pair_id", "left")
    status = (F.when(F.col("graph").isNull(), "pending")
              .when(F.size(graph_errors(F.col("graph"))) > 0, "pending_invalid_graph")
              .when(~F.col("graph.confusable"), "non_confusable"))
    if require_evidence:
        status = (status.when(F.col("has_evidence").isNull(), "no_evidence")
                  .when(~F.coalesce(F.col("confirmed"), F.lit(False)), "web_rejected"))
    return joined.withColumn("status", status.otherwise("used"))


# -- self-check ------------------------------------------------------------------------

def item_failures() -> Column:
    """Array of failed checks of an item row (columns as in the item schema plus tech_sign,
    has_evidence, web_verified, web_source_url)."""
    dialogue, cot = F.col("dialogue"), F.col("cot")
    farmer = F.array_join(F.transform(
        F.filter(dialogue, lambda t: t["speaker"] == "farmer"), lambda t: F.lower(t["text"])), " ")
    tech = F.rtrim(text.strip(F.lower(F.coalesce(F.col("tech_sign"), F.lit("")))), F.lit("."))
    steps = F.transform(cot, lambda s: s["step"])
    concluded = F.coalesce(F.try_element_at(steps, F.lit(-1)) == "CONCLUDE", F.lit(False))
    complete = F.coalesce(F.col("web_verified"), F.lit(False)) & (
        F.coalesce(F.col("web_source_url"), F.lit("")) != "")
    checks = [
        ((tech != "") & F.contains(farmer, tech), "LEAK: technical decisive sign in farmer turn"),
        (~concluded, "no CONCLUDE"),
        (~F.array_contains(steps, "READ_SIGN"), "no READ_SIGN step"),
        (F.col("gold.diagnosis") == F.col("lookalike.distractor"), "diagnosis == distractor"),
        (~F.coalesce(F.col("gold.answerable_from_image"), F.lit(False)),
         "not answerable-from-image"),
        (~F.coalesce(F.get(dialogue, F.lit(0))["has_image"], F.lit(False)), "F1 has no image"),
        (F.coalesce(F.col("has_evidence"), F.lit(False)) & ~complete,
         "look-alike evidence incomplete (web source missing)"),
    ]
    return F.filter(F.array(*[F.when(bad, F.lit(msg)) for bad, msg in checks]),
                    lambda e: e.isNotNull())


def selfcheck(items: DataFrame) -> DataFrame:
    """(item_id, failure) for every failed check."""
    return (items.withColumn("_failures", item_failures())
            .select("item_id", F.explode("_failures").alias("failure")))
