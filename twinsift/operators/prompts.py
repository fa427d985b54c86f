"""Prompt texts per row, from joined columns. The instructions around them are the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift import fixed_values as fv
from twinsift.functions import text


def fork_lines(forks: Column, label_a: Column, label_b: Column) -> Column:
    """Forks of a graph as one line each, for use as a worked example."""
    def line(fork: Column) -> Column:
        return F.concat(
            F.lit("    - ["), fork["weight"], F.lit("/"), fork["axis"], F.lit("] "),
            fork["question"], F.lit(" | A("), label_a, F.lit("): "), fork["a_signal"],
            F.lit(" | B("), label_b, F.lit("): "), fork["b_signal"])

    return F.array_join(F.transform(forks, line), "\n")


def pair_context(pairs: DataFrame) -> Column:
    """Facts about a candidate pair: crop, members with class and size, shared descriptors."""
    c = F.col

    def member(side: str) -> Column:
        return F.format_string(
            f"MEMBER_{side.upper()}: %s (class: %s; %d images)", c(f"member_{side}"),
            c(f"class_{side}"), c(f"n_imgs_{side}"))

    shared = F.when(F.size("shared_descriptors") > 0,
                    F.array_join("shared_descriptors", ", ")).otherwise(F.lit("none"))
    return F.concat_ws("\n", F.concat(F.lit("CROP: "), c("crop")), member("a"), member("b"),
                       F.concat(F.lit("shared image descriptors: "), shared))


def graph_context(pairs: DataFrame) -> Column:
    """Facts about a nested pair with scientific names: both members, where and how they meet."""
    c = F.col

    def member(side: str) -> Column:
        m = c(f"member_{side}")
        names = F.array_join(F.transform(m["descriptors"], lambda d: d["name"]), ", ")
        return F.format_string(
            f"MEMBER_{side.upper()}: %s (scientific: %s; class: %s; %d images; descriptors: %s)",
            m["disease"], F.coalesce(text.present(m["sci_name"]), F.lit("n/a")), m["pathogen_class"],
            m["n_imgs"], F.coalesce(names, F.lit("")))

    def listed(column: str, none: str) -> Column:
        return F.when(F.size(column) > 0, F.array_join(column, ", ")).otherwise(F.lit(none))

    return F.concat_ws(
        "\n", F.concat(F.lit("CROP: "), c("crop")), member("a"), member("b"),
        F.concat(F.lit("regions of both: "), listed("shared_regions", "little overlap")),
        F.concat(F.lit("shared image descriptors: "), listed("shared_descriptors", "none")))


def exemplar(records: DataFrame) -> Column:
    """A stored graph as a worked example: heading, shared look, forks and a narrative."""
    c = F.col
    return F.concat_ws(
        "\n",
        F.format_string("EXAMPLE (%s): %s (A) and %s (B), crop %s", c("kind"), c("member_a_label"),
                        c("member_b_label"), c("crop")),
        F.concat(F.lit("shared look: "), c("graph.shared_presentation")), F.lit("forks:"),
        fork_lines(c("graph.forks"), c("member_a_label"), c("member_b_label")),
        F.concat(F.lit("narrative A: "), c("graph.narrative_a")))


def photo_question(crop: Column, disease: Column, sign: Column) -> Column:
    """What to ask about one photograph: its part, framing, decisive sign and plain look."""
    parts = ", ".join(fv.ANATOMICAL_PARTS)
    return F.concat_ws(
        "\n", F.concat(F.lit("This photo is filed under "), disease, F.lit(" on "), crop, F.lit(".")),
        F.lit(f"anatomical_part: the part shown ({parts})"),
        F.lit("is_closeup: whether plant tissue fills the view"),
        F.concat(F.lit("decisive_sign_visible: whether this can be seen here: "), sign),
        F.lit("lay_observation: one plain sentence about what looks wrong"))


def label_question(rows: DataFrame) -> DataFrame:
    """(crop, prompt): the disease names of each crop, to be judged. Classes combine before they move."""
    classes = rows.select("crop", "disease").distinct()
    names = F.array_join(F.transform(F.array_sort(F.collect_list("disease")),
                                     lambda d: F.concat(F.lit("- "), d)), "\n")
    return classes.groupBy("crop").agg(names.alias("_names")).select(
        "crop", F.concat(F.lit("Crop: "), F.col("crop"), F.lit("\n\nDiseases:\n"), F.col("_names")).alias("prompt"))


def persona_behaviour(wording: dict[str, dict[str, str]] | None = None) -> Column:
    """How a persona speaks, a line per axis: the caller's `wording[axis][value]`, else the value."""
    def line(axis: str) -> Column:
        said = text.lookup(F.col(axis), (wording or {}).get(axis, {}))
        return F.coalesce(said, F.concat(F.lit(f"{axis}: "), F.col(axis)))

    return F.concat_ws("\n", *[line(a) for a in fv.PERSONA_AXES])


def farmer_grounding(host: Column, part: Column, observation: Column) -> Column:
    """What a farmer agent may know: crop, part and its own observation."""
    shown = F.when(F.coalesce(part, F.lit("")) != "", part).otherwise(F.lit("plant"))
    return F.format_string(
        "Your crop: %s. Affected part: %s.\nWhat you can see (in your own words): %s",
        host, shown, observation)
