"""Mixing of sources to target weights.

Words are summed per source, targets are filled up by weight (none above twice its source),
and a source's repetition rate is its target over its size. Every document is emitted
floor(rate) times, and once more by a hash-seeded draw of the rate's fraction. The draws of a
source are calibrated: the threshold is moved from the fraction to the place in draw order
where the words taken come nearest to the target, so small sources meet it too. Rows that share
a draw are alike; of those at the threshold so many are taken as come nearest to the target.

Hot sources: sums combine before the shuffle; the threshold is found by two passes over 1,024
buckets of draws, and only the draws of one bucket of a bucket are ordered. Rows that share the
draw at the threshold are counted per partition and numbered there.

Defined cases: null text has size 0; a null source is a source of its own, the last; a source
without words has target 0; rows with equal doc_id and text share their draw; an empty table
gives no rows; other columns are not read (`expand` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from twinsift.llm.frames import running_sums, word_count
from twinsift.operators.skew import row_number_in_group
from twinsift.session import materialise

WEIGHTS = (5, 2, 1)
SEED = "mix-1"
SHARE = 1.5          # all targets together, as a share of all sizes
LIMIT = 2            # a target is at most so many times its source's size
DRAW_BITS = 52
SOURCE = "__source"


def draw(doc_id: Column, text: Column) -> Column:
    """A whole number below 2**52 seeded by the document."""
    digest = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")),
                               F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source (null included): source, source_size, target.

    Doubled numbers keep the comparisons whole: the budget is 3/2 of all words.
    """
    sums = materialise(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    by_name = running_sums(sums, [F.col("source").isNull(), F.col("source")],
                           {"rank": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]),
                          (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighted = by_name.withColumn("weight", weight.cast("bigint")).withColumn(
        "cap", F.col("source_size") * LIMIT)
    scale = 1
    for w in WEIGHTS:
        scale *= w
    # In the order of cap per weight, a prefix of the sources is full at the common level.
    filled = materialise(running_sums(
        weighted.withColumn("fill", F.col("cap") * (F.lit(scale) / F.col("weight")).cast("bigint")),
        [F.col("fill"), F.col("source").isNull(), F.col("source")],
        {"caps": F.col("cap"), "weights": F.col("weight")}), "filled")
    total, all_weights = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    budget2 = int(2 * SHARE) * (total or 0)
    w = F.col("weight")
    level2 = 2 * ((F.col("caps") - F.col("cap")) * w
                  + F.col("cap") * (F.lit(all_weights or 0) - F.col("weights") + w))
    marked = filled.withColumn("full", level2 <= F.lit(budget2) * w)
    capped, full_weights = marked.filter("full").agg(F.sum("cap"), F.sum("weight")).first()
    free2 = budget2 - 2 * (capped or 0)
    free_weights = 2 * ((all_weights or 0) - (full_weights or 0))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        (F.lit(free2).cast("bigint") * w).cast("double") / F.lit(float(free_weights or 1)))
    return marked.select("source", "source_size", target.alias("target"))


def _with_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Join facts of the sources; the plan is a written table, so its size decides how."""
    return rows.join(plan, F.col("source").eqNullSafe(F.col(SOURCE)))


def _last_open(found: DataFrame, bucket: str, before: str) -> DataFrame:
    """Per source the last bucket whose earlier words do not pass the need."""
    sums = found.groupBy(SOURCE, "need", before, bucket).agg(F.sum("size").alias("words"))
    w = W.Window.partitionBy(SOURCE).orderBy(bucket)
    return (sums.withColumn("before", F.col(before) + F.sum("words").over(w) - F.col("words"))
            .filter(F.col("before") <= F.col("need"))
            .groupBy(F.col(SOURCE).alias("__s"))
            .agg(F.max_by(F.struct(bucket, "before"), bucket).alias("at"))
            .select("__s", F.col(f"at.{bucket}").alias(f"{bucket}_cut"),
                    F.col("at.before").alias(f"{bucket}_done")))


def _add(plan: DataFrame, facts: DataFrame) -> DataFrame:
    return plan.join(facts, F.col(SOURCE).eqNullSafe(F.col("__s")), "left").drop("__s")


def rates(sizes: DataFrame) -> DataFrame:
    """Per source: source_size, target, base copies, the last draw all of whose rows give one more,
    and the draw of which only the first `tie_take` rows do (null where there is none).

    `sizes` has source, size and draw of every row.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = materialise(
        source_targets(sizes).withColumn("base", F.floor(rate).cast("bigint"))
        .withColumn("need", F.col("target") - F.col("base") * F.col("source_size"))
        .withColumn("zero", F.lit(0).cast("bigint"))
        .withColumnRenamed("source", SOURCE), "targets")
    rows = sizes.withColumns({"b1": F.shiftright("draw", DRAW_BITS - 10),
                              "b2": F.shiftright("draw", DRAW_BITS - 20) % 1024})
    plan = materialise(_add(plan, _last_open(_with_source(rows, plan), "b1", "zero")), "cut")
    inside = _with_source(rows, plan).filter(F.col("b1") == F.col("b1_cut"))
    plan = materialise(_add(plan, _last_open(inside, "b2", "b1_done")), "cut")
    draws = (_with_source(rows, plan)
             .filter((F.col("b1") == F.col("b1_cut")) & (F.col("b2") == F.col("b2_cut")))
             .groupBy(SOURCE, "need", "b2_done", "draw")
             .agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.max("size").alias("each")))
    upto = F.sum("words").over(W.Window.partitionBy(SOURCE).orderBy("draw"))
    # A row is taken if that brings the words nearer to the need: the middle of row m of a draw,
    # earlier + each * (m - 1/2), may not pass it.
    left = F.col("need") - (F.col("b2_done") + upto - F.col("words"))
    most = F.when(F.col("each") > 0, F.floor((2 * left / F.col("each") + 1) / 2)).otherwise(
        F.when(left >= 0, F.col("n")).otherwise(0))
    taken = draws.withColumn("m", F.greatest(F.lit(0), F.least(most, F.col("n"))).cast("bigint"))
    last = taken.groupBy(F.col(SOURCE).alias("__s")).agg(
        F.max(F.when(F.col("m") == F.col("n"), F.col("draw"))).alias("last_draw"),
        F.min(F.when((F.col("m") > 0) & (F.col("m") < F.col("n")), F.struct("draw", "m"))).alias("tie"))
    start = (F.shiftleft("b1_cut", DRAW_BITS - 10) + F.shiftleft("b2_cut", DRAW_BITS - 20))
    return materialise(_add(plan, last).select(
        SOURCE, "source_size", "target", "base", F.coalesce("last_draw", start - 1, F.lit(-1)).alias("last_draw"),
        F.col("tie.draw").alias("tie_draw"), F.col("tie.m").alias("tie_take")), "rates")


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """`rows` (joined with the renamed rates, their draw as __draw) with how often each is taken."""
    more = F.col("__base") < LIMIT
    plain = rows.withColumn("__copies", F.col("__base") + (more & (F.col("__draw") <= F.col("__last_draw"))).cast("bigint"))
    if plan.filter("__tie_draw IS NOT NULL").isEmpty():
        return plain
    tied = F.coalesce(F.col("__draw") == F.col("__tie_draw"), F.lit(False))
    ties = materialise(plain.filter(tied).withColumns({
        "__part": F.spark_partition_id(), "__key": F.coalesce(F.concat(F.lit("s"), F.col(SOURCE)), F.lit(""))}), "ties")
    numbered = row_number_in_group(ties, ["__key"], F.col("__part"), [F.lit(0)], "__n")
    some = numbered.withColumn("__copies", F.col("__base") + (more & (F.col("__n") <= F.col("__tie_take"))).cast("bigint"))
    return plain.filter(~tied).unionByName(some.drop("__n", "__part", "__key"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies x size) of all rows."""
    sizes = materialise(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text")).alias("draw")), "sizes")
    plan = _renamed(rates(sizes))
    rows = _taken(_with_source(sizes.withColumnRenamed("draw", "__draw"), plan), plan)
    return rows.select(
        "doc_id", "source", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        F.col("__copies").alias("copies"), (F.col("__copies") * F.col("size")).alias("taken"))


def _renamed(plan: DataFrame) -> DataFrame:
    return plan.withColumnsRenamed({c: f"__{c}" for c in plan.columns if c != SOURCE})


def expand(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of `docs` as often as the mix takes it, with its columns."""
    drawn = draw(F.col("doc_id"), F.col("text"))
    sizes = materialise(docs.select("source", word_count(F.col("text")).alias("size"), drawn.alias("draw")), "sizes")
    plan = _renamed(rates(sizes))
    rows = _taken(docs.withColumn("__draw", drawn).join(plan, docs["source"].eqNullSafe(plan[SOURCE])), plan)
    return (rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int"))))
            .select(*docs.columns))


SQL = """
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_hash,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
drawn AS (
  SELECT *, CAST('0x' || substr(md5(concat('mix-1|', coalesce(CAST(doc_id AS VARCHAR), ''), '|',
         text_hash)), 1, 13) AS BIGINT) AS draw, row_number() OVER () AS n FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
              WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM drawn GROUP BY source),
caps AS (SELECT *, 2 * source_size AS cap, sum(source_size) OVER () AS total FROM sources),
levels AS (  -- words given out when the level stands where this source is full
  SELECT a.source, sum(least(CAST(b.cap AS DOUBLE), CAST(a.cap AS DOUBLE) * b.w / a.w)) AS given
  FROM caps a, caps b GROUP BY a.source),
filled AS (SELECT c.*, 2 * l.given <= 3 * total AS is_full
           FROM caps c JOIN levels l ON c.source IS NOT DISTINCT FROM l.source),
targets AS (
  SELECT source, source_size, CAST(CASE WHEN is_full THEN cap ELSE
    CAST((3 * total - 2 * coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0)) * w AS DOUBLE)
    / (2 * sum(w) FILTER (WHERE NOT is_full) OVER ()) END AS DOUBLE) AS target
  FROM filled),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END
            AS base FROM targets),
placed AS (
  SELECT d.*, r.source_size, r.target, r.base, r.target - r.base * r.source_size AS need,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.n ROWS UNBOUNDED PRECEDING) AS upto
  FROM drawn d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
copied AS (
  SELECT *, base + CASE WHEN base < 2 AND 2 * upto - size <= 2 * need THEN 1 ELSE 0 END AS copies
  FROM placed)
SELECT doc_id, source, size, source_size, target, CAST(copies AS BIGINT) AS copies,
       CAST(copies * size AS BIGINT) AS taken FROM copied
"""
