"""Cross-site boilerplate lines, by distinct-site spread.

Per line hash one aggregation keeps the number of rows, a HyperLogLog sketch of the sites and
the first occurrence; sketches merge on the map side, so a line that stands in a third of all
rows is one small row per task. A line in fewer rows than the threshold cannot reach it. An
estimate well above the threshold decides; near it the sites of just those lines are counted
exactly. All but the first occurrence (smallest doc_id, then line) of a line on at least
`min_sites` sites are removed. Lines of fewer than `min_words` words recur by chance more often: for
each word that one lacks it must stand on `short_percent` percent of all sites (and on `min_sites`).
With `short_percent=None` short lines stay.

All steps are DataFrame operations. In joins on line hashes the rows of hot lines stay where they
are: there are at most `HOT` hot lines, so those are broadcast. Texts move once, when the line numbers to drop meet them.

Defined cases: null text has no lines and stays null; a null source counts as the empty one;
null doc_ids come last and, like repeated rows, are alike: if one of them holds the first
occurrence, all keep it; white space around a line does not matter, and a line without a word is
no line; an empty table gives no rows; other columns are kept by `drop_lines` and not read by `line_dedup`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.llm.frames import SPACES
from twinsift.session import materialise

MIN_SITES = 3
MIN_WORDS = 5
SHORT_PERCENT = 10   # of all sites, for each word that a line has less than MIN_WORDS
SKETCH_BITS = 9      # 512 registers, a standard error of 4.6 %
HOT = 1000           # a line in one of so many rows is hot; there can be no more such lines
NEAR = 0.2           # exact counts for estimates within so much of the threshold


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _first() -> Column:
    return F.struct(F.col("__id").isNull().alias("last"), F.col("__id"), F.col("__pos"))


def counted_lines(docs: DataFrame, min_words: int = MIN_WORDS, short: bool = False) -> DataFrame:
    """Key, site, place and words (at most `min_words`) of every line; the lines stay behind.

    Lines of fewer than `min_words` words are among them if `short` is set.
    """
    line = F.btrim(F.col("__line"), F.lit(SPACES))
    enough = line.rlike(r"^[^\x20\x09-\x0D]+([\x20\x09-\x0D]+[^\x20\x09-\x0D]+){%d}"
                        % max(min_words - 1, 0))
    words = F.when(enough, F.lit(min_words)).otherwise(F.size(F.split(line, r"[\x20\x09-\x0D]+")))
    return (docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__hash"),
                        F.coalesce("source", F.lit("")).alias("__site"),
                        F.posexplode(_lines(F.col("text"))).alias("__pos", "__line"))
            .filter((line != "") if short else enough)
            .select("__id", "__hash", "__site", "__pos",
                    (words if short else F.lit(min_words)).cast("int").alias("__words"),
                    F.unhex(F.md5(line.cast("binary"))).alias("__key")))


def _meet(lines: DataFrame, hot: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """Join lines with facts of some keys; the rows of the `hot` keys are not shuffled."""
    cold = lines.join(F.broadcast(hot), "__key", "left_anti")
    found_hot = F.broadcast(found.join(F.broadcast(hot), "__key", "left_semi"))
    return lines.join(found_hot, "__key", how).unionByName(cold.join(found, "__key", how))


def needed_sites(words: Column, all_sites: int, min_sites: int, min_words: int,
                 short_percent: int) -> Column:
    """On so many sites a line of so many words is boilerplate."""
    by_words = [max(min_sites, -(-short_percent * (min_words - w) * all_sites // 100))
                for w in range(1, min_words)]
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in by_words]), words - 1),
                      F.lit(min_sites)) if by_words else F.lit(min_sites)


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS,
                short_percent: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Key and first occurrence of the lines on as many sites as they need; keys of hot lines."""
    need = F.lit(min_sites)
    if short_percent is not None:
        all_sites = lines.select("__site").distinct().count()
        need = needed_sites(F.col("words"), all_sites, min_sites, min_words, short_percent)
    spread = materialise(
        lines.groupBy("__key").agg(
            F.min("__words").alias("words"), F.count("*").alias("rows"), F.min(_first()).alias("first"),
            # Hashes, since the sketch passes over empty strings.
            F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64("__site"), SKETCH_BITS)).alias("sites"))
        .withColumn("need", need).filter(F.col("rows") >= F.col("need")), "spread")
    hot = spread.filter(F.col("rows") * HOT >= lines.count()).select("__key")
    sure = spread.filter(F.col("sites") > F.col("need") * (1 + NEAR))
    near = spread.filter(F.col("sites").between(F.col("need") * (1 - NEAR), F.col("need") * (1 + NEAR)))
    counted = (_meet(lines, hot, near.select("__key"), "left_semi")
               .groupBy("__key", "__site").count().groupBy("__key").count())
    enough = near.join(counted, "__key").filter(F.col("count") >= F.col("need")).drop("count")
    return materialise(sure.unionByName(enough).select("__key", "first"), "boilerplate"), hot


def _dropped(docs: DataFrame, min_sites: int, min_words: int, short_percent: int | None) -> DataFrame:
    """Per document the numbers of the lines to drop."""
    lines = materialise(counted_lines(docs, min_words, short_percent is not None), "lines")
    found, hot = boilerplate(lines, min_sites, min_words, short_percent)
    return (_meet(lines, hot, found)
            .filter(~_first().eqNullSafe(F.col("first")))
            .groupBy("__id", "__hash").agg(F.collect_set("__pos").alias("__drop")))


def _cleaned(docs: DataFrame, min_sites: int, min_words: int, short_percent: int | None) -> DataFrame:
    """`docs` with __text (cleaned), __total and __removed (numbers of lines)."""
    dropped = _dropped(docs.select("doc_id", "text", "source"), min_sites, min_words, short_percent)
    joined = docs.withColumn("__h", F.xxhash64("text")).join(
        dropped, F.col("doc_id").eqNullSafe(F.col("__id"))
        & (F.col("__h") == F.col("__hash")), "left")
    lines = _lines(F.col("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
    text = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    removed = F.coalesce(F.size("__drop"), F.lit(0)).cast("bigint")
    return joined.withColumns({
        "__text": F.when(F.col("__drop").isNull(), F.col("text")).otherwise(text),
        "__total": F.coalesce(F.size(lines), F.lit(0)).cast("bigint"),
        "__removed": F.when(F.col("__drop").isNull(), F.lit(0)).otherwise(removed).cast("bigint")})


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS,
               short_percent: int | None = SHORT_PERCENT) -> DataFrame:
    """doc_id, text without repeated boilerplate, n_lines and n_removed of every row."""
    rows = _cleaned(docs.select("doc_id", "text", "source"), min_sites, min_words, short_percent)
    return rows.select(
        "doc_id", F.col("__text").alias("text"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col("__total")).cast("bigint").alias("n_lines"),
        F.col("__removed").alias("n_removed"))


def drop_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS,
               short_percent: int | None = SHORT_PERCENT) -> DataFrame:
    """`docs` with cleaned texts and n_chars; rows that lost lines and have no word left go."""
    rows = _cleaned(docs, min_sites, min_words, short_percent)
    gone = (F.col("__removed") > 0) & (F.btrim("__text", F.lit(SPACES)) == "")
    changed = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__removed") > 0, F.length("__text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.filter(~gone).select(*[
        changed[c].alias(c) if c in changed else docs[c] for c in docs.columns])


SQL = r"""
WITH lines AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents),
worded AS (
  SELECT doc_id, coalesce(source, '') AS site, pos, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line,
    least(5, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS words
  FROM lines WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 0),
spread AS (
  SELECT line, min(struct_pack(last := doc_id IS NULL, id := doc_id, pos := pos)) AS first
  FROM worded GROUP BY line
  HAVING count(DISTINCT site) >= greatest(3, (10 * (5 - min(words)) * (SELECT count(DISTINCT site) FROM worded) + 99) // 100)),
dropped AS (
  SELECT l.doc_id, l.pos FROM worded l JOIN spread s USING (line)
  WHERE struct_pack(last := l.doc_id IS NULL, id := l.doc_id, pos := l.pos) IS DISTINCT FROM s.first)
SELECT l.doc_id,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE d.doc_id IS NULL), '') AS text,
       CAST(count(*) AS BIGINT) AS n_lines, CAST(count(d.doc_id) AS BIGINT) AS n_removed
FROM lines l LEFT JOIN (SELECT DISTINCT doc_id, pos FROM dropped) d USING (doc_id, pos)
GROUP BY l.doc_id
"""
