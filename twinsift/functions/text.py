"""String expressions: labels, locations, HTML, sentences, JSON replies."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinsift import fixed_values as fv

# Unicode white space, spelled out so that Java and other regex engines agree on it.
SPACE = (
    r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NOT_SPACE = "[^" + SPACE[1:]
SPACE_CHARS = ("\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b)))
               + "\u2028\u2029\u202f\u205f\u3000")


def strip(text: Column) -> Column:
    """Remove white space of any kind on both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def present(text: Column) -> Column:
    """Stripped text, with blank text as null."""
    stripped = strip(text)
    return F.when(stripped != "", stripped)


def first_present(*texts: Column) -> Column:
    """First text that is not blank."""
    return F.coalesce(*[present(t) for t in texts])


def display_name(folder: Column) -> Column:
    return F.trim(F.translate(folder, "_", " "))


def file_stem(name: Column) -> Column:
    """File name without its last extension; a leading dot does not start an extension."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*\z", "")


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)\z", 1))


def image_identity(host: Column, disease: Column, stem: Column) -> Column:
    return F.concat_ws("__", host, disease, stem)


def source_prefix(stem: Column) -> Column:
    return F.substring_index(stem, "_", 1)


def slug(text: Column) -> Column:
    """Lower case with every non-alphanumeric character as a dash, trimmed of dashes."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "-"), F.lit("-"))


def pair_id(crop: Column, a: Column, b: Column) -> Column:
    """Key of an unordered class pair; the alphabetically first member leads."""
    return F.concat_ws("__", slug(crop), slug(F.least(a, b)), slug(F.greatest(a, b)))


def strip_html(html: Column) -> Column:
    text = F.regexp_replace(html, r"<[^>]+>", "")
    text = F.replace(text, F.lit("&nbsp;"), F.lit(" "))
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def location_parts(location: Column) -> Column:
    """Comma-separated parts, stripped, without the blank ones."""
    return F.filter(F.transform(F.split(location, ","), strip), lambda p: p != "")


def country(location: Column) -> Column:
    return F.get(location_parts(location), F.lit(0))


def state(location: Column) -> Column:
    return F.get(location_parts(location), F.lit(1))


def county(location: Column) -> Column:
    return strip(F.regexp_replace(F.get(location_parts(location), F.lit(2)),
                                  r"(?i)\s+County\z", ""))


def first_rule(text: Column, rules: Iterable[tuple[str, str]], default: str) -> Column:
    """Value of the first (substring, value) rule that matches the lower-cased text."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    result = F.lit(default)
    for hint, value in reversed(list(rules)):
        result = F.when(lowered.contains(hint), F.lit(value)).otherwise(result)
    return result


def source_type(url: Column, rules=fv.SOURCE_TYPE_RULES) -> Column:
    return first_rule(url, rules, fv.SOURCE_TYPE_DEFAULT)


def lookup(key: Column, mapping: Mapping) -> Column:
    """Value of a small fixed mapping, null when the key is unknown."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 2**31 - 1))


def upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2**31 - 1))


def strip_tail(text: Column) -> Column:
    """Drop trailing full stops and spaces."""
    return strip(F.rtrim(F.coalesce(text, F.lit("")), F.lit(". ")))


def head_sign(instruction: Column) -> Column:
    """The sign named by a lay instruction, as a short phrase.

    Takes the first clause, the part after a colon, and drops "flip the leaf over" and
    "look ... for" openings; a long head clause before a comma is enough.
    """
    clause = strip(F.get(F.split(strip(F.coalesce(instruction, F.lit(""))), "[;.]", 2), F.lit(0)))
    # Column expressions cannot name their own intermediate, so the steps are chained through
    # one-element arrays: each lambda sees the value of the step before it.
    steps = [
        lambda s: F.when(s.contains(":"), strip(F.regexp_replace(s, r"(?s)\A[^:]*:", ""))).otherwise(s),
        lambda s: F.regexp_replace(s, r"(?i)\Aflip\s+the\s+lea\w+\s+over[, ]*(and\s+)?", ""),
        lambda s: F.regexp_replace(
            s, r"(?i)\A(?:look|check|examine|inspect|search)\b[^\n]*?\bfor\b\s+([^\n]*)\z", "$1"),
        lambda s: F.btrim(strip(s), F.lit(",")),
        lambda s: F.when(
            s.contains(",") & (F.length(F.substring_index(s, ",", 1)) >= 20),
            F.substring_index(s, ",", 1)).otherwise(s),
        lower_first,
    ]
    value = F.array(clause)
    for step in steps:
        value = F.transform(value, step)
    return F.get(value, F.lit(0))


def clean_management(text: Column, label: Column) -> Column:
    """Drop a leading "<label>:" from a management sentence."""
    stripped = strip(F.coalesce(text, F.lit("")))
    head = strip(F.substring_index(stripped, ":", 1))
    named = stripped.contains(":") & (F.lower(head) == F.lower(strip(label)))
    return F.when(named, strip(F.regexp_replace(stripped, r"(?s)\A[^:]*:", ""))).otherwise(stripped)


def management_sentence(text: Column) -> Column:
    stem = strip_tail(text)
    return F.when(stem != "", F.concat(upper_first(stem), F.lit("."))).otherwise(
        F.lit(fv.MANAGE_DEFAULT))


def mentions_any(text: Column, phrases: Column) -> Column:
    """True when any phrase occurs in the text, by plain case-insensitive substring."""
    lowered = F.lower(text)
    return F.exists(
        F.filter(phrases, lambda p: F.coalesce(p, F.lit("")) != ""),
        lambda p: F.contains(lowered, F.lower(p)))


def leaks(text: Column, banned: Column) -> Column:
    """True for blank text and for text that names a banned phrase."""
    filled = F.coalesce(text, F.lit(""))
    return (strip(filled) == "") | mentions_any(filled, banned)


def json_reply(reply: Column) -> Column:
    """A model reply as a variant: without code fences, else its widest {...} span, else null."""
    bare = F.regexp_replace(strip(reply), r"(?i)\A```(?:json)?\s*", "")
    bare = strip(F.regexp_replace(bare, r"```\z", ""))
    span = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(span))


def orientation(view: Column, width: Column, height: Column) -> Column:
    """Explicit view, else landscape or portrait from the size, else null."""
    named = F.lower(strip(F.coalesce(view, F.lit(""))))
    w, h = width.try_cast("int"), height.try_cast("int")
    sized = F.when((w != 0) & (h != 0), F.when(w >= h, "landscape").otherwise("portrait"))
    return F.when(named.isin("landscape", "portrait", "square"), named).otherwise(sized)


def image_url(base: str, image_number: Column, resolution: Column) -> Column:
    code = F.coalesce(resolution.try_cast("int"), F.lit(fv.DEFAULT_RESOLUTION))
    path = F.coalesce(lookup(code, fv.RESOLUTION_PATHS),
                      F.lit(fv.RESOLUTION_PATHS[fv.DEFAULT_RESOLUTION]))
    return F.when(image_number != "", F.concat(F.lit(base + "/"), path, F.lit("/"),
                                               image_number, F.lit(".jpg")))
