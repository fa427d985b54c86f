"""Label hygiene expressions: names, organisms, organ buckets, lanes, evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinsift import fixed_values as fv
from twinsift.functions import text as tx


def pathogen_class(name: Column) -> Column:
    rules = [(hint, cls) for cls, hints in fv.PATHOGEN_RULES for hint in hints]
    return tx.first_rule(name, rules, fv.PATHOGEN_DEFAULT)


def strip_parenthetical(label: Column) -> Column:
    """Disease label without its Latin name in brackets."""
    return tx.strip(F.regexp_replace(label, r"\s*\([^)]*\)", ""))


def clean_display(name: Column) -> Column:
    """Label without a leading "Genus", author citations or a trailing bracketed authority."""
    out = F.regexp_replace(tx.strip(F.coalesce(name, F.lit(""))), r"\AGenus\s+", "")
    for citation in sorted(fv.AUTHOR_CITATIONS, key=len, reverse=True):
        out = F.replace(out, F.lit(" " + citation), F.lit(""))
    out = F.regexp_replace(out, r"\s*\([A-Z][^)]*\.\)\s*\z", "")
    return tx.strip(F.regexp_replace(out, r"\s{2,}", " "))


def _token(name: Column, index: int) -> Column:
    word = tx.NOT_SPACE + "+"
    before = f"{word}{tx.SPACE}+" * index
    return F.regexp_extract(F.coalesce(name, F.lit("")), rf"\A{tx.SPACE}*{before}({word})", 1)


def genus(name: Column) -> Column:
    return F.lower(_token(name, 0))


def species(name: Column) -> Column:
    """Second word, only when it starts with a lower-case letter."""
    word = _token(name, 1)
    return F.when(word.rlike(r"\A\p{Ll}"), F.lower(word)).otherwise(F.lit(""))


def accepted_genus(name: Column) -> Column:
    found = genus(name)
    return F.coalesce(tx.lookup(found, fv.GENUS_SYNONYMS), found)


def same_organism(a: Column, b: Column) -> Column:
    """Same genus up to synonyms, and species equal, absent or alike in five letters."""
    sa, sb = species(a), species(b)
    species_agree = (sa == "") | (sb == "") | (F.substring(sa, 1, 5) == F.substring(sb, 1, 5))
    return (genus(a) != "") & (accepted_genus(a) == accepted_genus(b)) & species_agree


def organ_bucket(descriptor: Column) -> Column:
    trimmed = tx.strip(F.coalesce(descriptor, F.lit("")))
    fallback = F.when(F.coalesce(descriptor, F.lit("")) == "", F.lit("other")).otherwise(
        F.lower(trimmed))
    return F.coalesce(tx.lookup(trimmed, fv.ORGAN_BUCKETS), fallback)


def lane_hint(score: Column, gate: float = fv.LANE_GATE) -> Column:
    return F.when(score >= gate, "image_ambiguous").when(score < gate, "image_decisive")


def credible(documented: Column, quote: Column, kind: Column) -> Column:
    """Evidence counts when it is documented, quoted and of a credible source type."""
    return F.coalesce(
        documented & (F.coalesce(quote, F.lit("")) != "") & kind.isin(*fv.CREDIBLE_TYPES),
        F.lit(False))


def is_generalist(name: Column) -> Column:
    return F.lower(tx.strip(name)).isin(*fv.GENERALIST_SPECIES) | genus(name).isin(
        *fv.GENERALIST_GENERA)
