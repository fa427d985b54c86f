"""Item selection and assembly: grounding, reasoning chain, dialogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift import dims
from twinsift import fixed_values as fv
from twinsift.functions import hashing, text
from twinsift.operators import gates
from twinsift.operators.skew import spread_join


def select_items(rows: DataFrame, used_pairs: DataFrame, labels: DataFrame,
                 seen: DataFrame | None = None) -> DataFrame:
    """Images of both members of every used pair, with split, visibility label and pair record.

    One image yields an item per pair it takes part in. Pair records meet the images of their
    classes in one join, spread so that a class with very many images uses many tasks. `seen` is
    as in `spread_join`.
    """
    labelled = rows.join(labels, "img", "left")
    side = F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.col("member_a").alias("disease")),
        F.struct(F.lit("b").alias("side"), F.col("member_b").alias("disease"))))
    members = used_pairs.withColumn("_m", side).select("*", "_m.*").drop("_m")
    return spread_join(labelled, members, ["crop", "disease"], ["img"], seen)


def _lowered(col: Column) -> Column:
    return text.lower_first(text.strip_tail(col))


def ground_items(items: DataFrame, observations: DataFrame | None = None) -> DataFrame:
    """Signs, labels, management and lay observation per item; only usable images remain.

    Needs side, graph, member_a_label, member_b_label, crop, host_common and the visibility
    columns anatomical_part, is_closeup, decisive_sign_visible. lay_observation is a column too,
    or comes from `observations` (img, lay_observation; one row per image): then texts move once,
    and only after images are chosen and records are cut down to what an item keeps of them.
    """
    is_a = F.col("side") == "a"
    lay = F.col("graph.lay")
    fork = gates.decisive_fork(F.col("graph.forks"))
    signs = F.array_compact(F.array(fork["a_signal"], fork["b_signal"]))

    def by_side(a: Column, b: Column) -> Column:
        return F.when(is_a, a).otherwise(b)

    status = gates.visibility_status(
        F.col("is_closeup").isNotNull(), F.col("is_closeup"), F.col("decisive_sign_visible"),
        lay.isNotNull())
    a, b = F.col("member_a_label"), F.col("member_b_label")
    kept = items.filter(status == "usable").withColumns({
        "true_label": by_side(a, b), "distractor": by_side(b, a),
        "sign_true_full": by_side(lay["decisive_lay_a"], lay["decisive_lay_b"]),
        "sign_other_full": by_side(lay["decisive_lay_b"], lay["decisive_lay_a"]),
        "tech_signs": signs, "tech_sign": by_side(fork["a_signal"], fork["b_signal"]),
        "_managed": by_side(F.col("graph.management_a"), F.col("graph.management_b")),
        "_report": lay["farmer_lay_report"]})
    if observations is not None:
        kept = kept.join(observations, "img", "left")
    host = F.coalesce(F.when(F.col("host_common") != "", F.col("host_common")), F.col("crop"))
    return kept.withColumns({
        "host": host, "part": F.coalesce(F.col("anatomical_part"), F.lit("")),
        "observation": gates.guarded_observation(
            F.col("lay_observation"), F.col("_report"), F.col("tech_signs")),
        "sign_true": text.head_sign(F.col("sign_true_full")),
        "sign_other": text.head_sign(F.col("sign_other_full")),
        "management": text.strip_tail(text.clean_management(F.col("_managed"), F.col("true_label"))),
    }).drop("_managed", "_report")


def reasoning_chain(host: Column, part: Column, observation: Column, sign_true: Column,
                    sign_other: Column, true: Column, distractor: Column) -> Column:
    """The four-step chain as an array of (step, cites, text)."""
    texts = [
        F.format_string(fv.PERCEIVE_FORMAT, host, part, text.lower_first(observation)),
        F.format_string(fv.READ_SIGN_FORMAT, _lowered(sign_true)),
        F.format_string(fv.RULE_OUT_FORMAT, distractor, _lowered(sign_other)),
        F.format_string(fv.CONCLUDE_FORMAT, true, distractor),
    ]
    return F.array(*[
        F.struct(F.lit(step).alias("step"), F.lit(cites).alias("cites"), line.alias("text"))
        for (step, cites), line in zip(fv.CHAIN_STEPS, texts)])


def item_skeleton(grounded: DataFrame) -> DataFrame:
    """The nested item without its dialogue, next to the grounding columns."""
    c = F.col
    chain = reasoning_chain(c("host"), c("part"), c("observation"), c("sign_true"),
                            c("sign_other"), c("true_label"), c("distractor"))
    return grounded.withColumns({
        "item_id": F.concat_ws("-", F.lit("item"), c("img"), c("pair_id"), c("side")),
        "image": F.struct(
            c("url"), c("img").alias("image_number"), c("cite").alias("attribution"),
            F.lit(fv.LICENSE_NOTE).alias("license_note")),
        "lookalike": F.struct(
            c("pair_id"), c("crop"), c("true_label").alias("true"), c("distractor")),
        "grounding": F.struct(
            c("host"), c("true_label").alias("disease"), c("part").alias("anatomical_part"),
            c("descriptor"), c("state")),
        "cot": chain,
        "gold": F.struct(
            c("true_label").alias("diagnosis"), c("distractor").alias("ruled_out"),
            text.strip_tail(c("sign_true_full")).alias("evidence_from_image"),
            c("management"), F.lit(True).alias("answerable_from_image"))})


# -- dialogue --------------------------------------------------------------------------

def opening_line(host: Column, part: Column, observation: Column) -> Column:
    shown = F.when(F.coalesce(part, F.lit("")) != "", part).otherwise(F.lit("plant"))
    return F.format_string(fv.OPENING_FORMAT, host, shown, text.lower_first(observation))


def diagnose_line(sign_true: Column, true: Column, distractor: Column, sign_other: Column) -> Column:
    return F.format_string(fv.DIAGNOSE_FORMAT, _lowered(sign_true), true, distractor,
                           _lowered(sign_other))


def reaffirm_line(sign_true: Column, true: Column, distractor: Column) -> Column:
    return F.format_string(fv.REAFFIRM_FORMAT, _lowered(sign_true), true, distractor)


def _turn(name: str, speaker: str, line: Column, has_image: bool = False) -> Column:
    return F.struct(F.lit(name).alias("turn"), F.lit(speaker).alias("speaker"),
                    line.alias("text"), F.lit(has_image).alias("has_image"))


def pushback_line(key: Column) -> Column:
    choice = hashing.digest_modulo(key, len(fv.PUSHBACK_LINES)).cast("int")
    return F.get(F.array(*[F.lit(x) for x in fv.PUSHBACK_LINES]), choice)


def template_dialogue(df: DataFrame, seed=fv.DEFAULT_SEED) -> Column:
    """The fixed six-turn dialogue from the grounding columns."""
    c = F.col
    weather = F.format_string(fv.WEATHER_FORMAT, _lowered(c("sign_true")), c("true_label"),
                              c("distractor"))
    pushed = pushback_line(F.concat(c("img"), F.lit("|"), F.lit(str(seed))))
    return F.array(
        _turn("F1", "farmer", opening_line(c("host"), c("part"), c("observation")), True),
        _turn("E1", "expert", diagnose_line(c("sign_true"), c("true_label"), c("distractor"),
                                            c("sign_other"))),
        _turn("F2", "farmer", F.lit(fv.SPREAD_QUESTION)),
        _turn("E2", "expert", text.management_sentence(c("management"))),
        _turn("F3", "farmer", pushed),
        _turn("E3", "expert", weather))


def assign_persona(df: DataFrame, item_id: str, seed=fv.DEFAULT_SEED) -> DataFrame:
    """Add persona_id and its axes by a stable hash of the item."""
    position = hashing.digest_modulo(
        F.concat(F.lit(f"{seed}|"), F.col(item_id)), fv.N_PERSONAS).cast("int")
    return (df.withColumn("position", position)
            .join(F.broadcast(dims.personas(df.sparkSession)), "position").drop("position"))


def reaffirms(personality: Column) -> Column:
    return ~personality.isin(*fv.SHORT_PERSONALITIES)


def closes(personality: Column) -> Column:
    return personality.isin(*fv.CLOSING_PERSONALITIES)


def planned_turns(personality: Column) -> Column:
    return F.lit(5) + reaffirms(personality).cast("int") + closes(personality).cast("int")


def farmer_line(said: Column, fallback: Column, banned: Column) -> Column:
    """(text, repaired): the given line with an end mark, or the fallback when it leaks."""
    bare = text.strip_tail(said)
    ended = F.rtrim(F.coalesce(said, F.lit("")), F.lit(text.SPACE_CHARS)).rlike(r"[.?!]\z")
    line = F.when((F.coalesce(said, F.lit("")) == "") | ended, bare).otherwise(
        F.concat(bare, F.lit(".")))
    bad = text.leaks(line, banned)
    return F.struct(F.when(bad, fallback).otherwise(line).alias("text"), bad.alias("repaired"))


def assemble_dialogue(df: DataFrame) -> DataFrame:
    """Persona-paced dialogue from given farmer lines.

    Needs the grounding columns, personality, tech_signs and the farmer lines said_open,
    said_react, said_follow, said_close. Adds dialogue, n_turns and leak_repairs. Everything is
    built within the row; no rows are gathered.
    """
    c = F.col
    banned = F.concat(F.array(c("true_label"), c("distractor")), c("tech_signs"))
    fallbacks = {"open": opening_line(c("host"), c("part"), c("observation")),
                 **{k: F.lit(v) for k, v in fv.FALLBACK_LINES.items()}}
    kinds = ("open", "react", "follow", "close")
    out = df.withColumns({
        f"_{k}": farmer_line(c(f"said_{k}"), fallbacks[k], banned) for k in kinds})
    p = c("personality")
    none = F.array().cast("array<struct<turn:string,speaker:string,text:string,has_image:boolean>>")
    turns = F.concat(
        F.array(
            _turn("F1", "farmer", c("_open.text"), True),
            _turn("E1", "expert", diagnose_line(c("sign_true"), c("true_label"),
                                                c("distractor"), c("sign_other"))),
            _turn("F2", "farmer", c("_react.text")),
            _turn("E2", "expert", text.management_sentence(c("management"))),
            _turn("F3", "farmer", c("_follow.text"))),
        F.when(reaffirms(p), F.array(_turn("E3", "expert", reaffirm_line(
            c("sign_true"), c("true_label"), c("distractor"))))).otherwise(none),
        F.when(closes(p), F.array(_turn("F4", "farmer", c("_close.text")))).otherwise(none))
    repairs = sum((c(f"_{k}.repaired").cast("int") for k in ("open", "react", "follow")),
                  F.when(closes(p), c("_close.repaired").cast("int")).otherwise(F.lit(0)))
    return (out.withColumns({"dialogue": turns, "leak_repairs": repairs})
            .withColumn("n_turns", F.size("dialogue")).drop(*[f"_{k}" for k in kinds]))
