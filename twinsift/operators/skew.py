"""Building blocks that keep one hot key from landing in one task.

Every helper returns the same rows as the plain operator it stands for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from twinsift.session import materialise

SALTS = 16
SALT = "_salt"


def salt_of(*cols: str | Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread_by: Sequence[str],
                how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join where the left side may hold a hot key and the right side is the smaller one.

    Left rows of one key are spread over `salts` partitions by the hash of `spread_by`; the
    right side is repeated once per salt. `how` may be inner, left, left_semi or left_anti.
    Where the right side turns out small, adaptive execution still makes it a broadcast.
    """
    spread = left.withColumn(SALT, salt_of(*spread_by, salts=salts))
    repeated = right.withColumn(
        SALT, F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return spread.join(repeated, [*on, SALT], how).drop(SALT)


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str],
                 how: str = "inner") -> DataFrame:
    """Join of a large table with one that is expected to be small, like one row per class.

    The right side is written out first, so the planner knows its bytes: below its broadcast
    threshold the large side is not shuffled at all, beyond it adaptive execution splits hot keys.
    """
    return left.join(materialise(right, "lookup"), list(on), how)


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], spread_by: Sequence[str],
           salts: int = SALTS) -> DataFrame:
    """Left join to a table of any size with unique keys, where few keys may hold most rows.

    Only the (key, salt) combinations that occur in `df` are formed, so the table is not
    repeated for keys that are rare.
    """
    salted = df.withColumn(SALT, salt_of(*spread_by, salts=salts))
    found = (salted.groupBy(*keys).agg(F.collect_set(SALT).alias("_salts"))
             .join(table, list(keys))
             .withColumn(SALT, F.explode("_salts")).drop("_salts"))
    return salted.join(found, [*keys, SALT], "left").drop(SALT)


def spread_join(df: DataFrame, table: DataFrame, keys: Sequence[str], spread_by: Sequence[str],
                seen: DataFrame | None = None, salts: int = SALTS) -> DataFrame:
    """Inner join of rows with hot keys to records of any width, several per key.

    A record is repeated only for the (key, salt) combinations that occur, so no more of it is
    shuffled than the result holds. `seen` has the keys of `df` where it is cheaper to read.
    """
    salt = salt_of(*spread_by, salts=salts)
    found = ((df if seen is None else seen).groupBy(*keys).agg(F.collect_set(salt).alias("_salts"))
             .join(table, list(keys)).withColumn(SALT, F.explode("_salts")).drop("_salts"))
    return df.withColumn(SALT, salt).join(found, [*keys, SALT]).drop(SALT)


def attach_class(df: DataFrame, keys: Sequence[str],
                 aggregates: Sequence[Column]) -> DataFrame:
    """Add per-group aggregates to every row where groups are expected to be few (classes)."""
    return checked_join(df, df.groupBy(*keys).agg(*aggregates), keys)


def attach_group(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column],
                 spread_by: Sequence[str], salts: int = SALTS) -> DataFrame:
    """Add per-group aggregates to every row, as a window over the group would.

    The aggregate combines on the map side, and only the (group, salt) combinations that
    occur are joined back, so a group with a third of all rows is handled by `salts` tasks.
    Keys must not be null.
    """
    salted = df.withColumn(SALT, salt_of(*spread_by, salts=salts))
    groups = (salted.groupBy(*keys)
              .agg(*aggregates, F.collect_set(SALT).alias("_salts"))
              .withColumn(SALT, F.explode("_salts")).drop("_salts"))
    return salted.join(groups, [*keys, SALT]).drop(SALT)


def row_number_in_group(df: DataFrame, keys: Sequence[str], bucket: Column,
                        order: Sequence[Column | str], name: str,
                        total: str | None = None) -> DataFrame:
    """1-based position of each row in its group, also for groups too big for one task.

    `bucket` must not decrease along `order`; each (group, bucket) is numbered on its own and
    the sizes of the earlier buckets are added. The prefix sums run over bucket counts only.
    `total` names a column for the group size.
    """
    b = "_bucket"
    tagged = df.withColumn(b, bucket)
    sizes = tagged.groupBy(*keys, b).agg(F.count("*").alias("_size"))
    before = W.Window.partitionBy(*keys).orderBy(b).rowsBetween(W.Window.unboundedPreceding, -1)
    group = W.Window.partitionBy(*keys)
    extra = [F.sum("_size").over(group).alias(total)] if total else []
    offsets = sizes.select(
        *keys, b, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), *extra)
    inside = F.row_number().over(W.Window.partitionBy(*keys, b).orderBy(*order))
    return (tagged.withColumn("_inside", inside)
            .join(offsets, [*keys, b])
            .withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint"))
            .drop(b, "_inside", "_before"))


def rank_by_hash(df: DataFrame, digest: str, name: str, total: str) -> DataFrame:
    """0-based rank of every row by a hex digest column, and the row count, without a global sort.

    Digests are spread evenly, so the first three hex digits cut the rows into at most 4,096
    ordered buckets; only their counts meet in one place.
    """
    ranked = row_number_in_group(
        df.withColumn("_all", F.substring(digest, 1, 0)), ["_all"], F.substring(digest, 1, 3), [digest], name,
        total)
    return ranked.withColumn(name, F.col(name) - 1).drop("_all")


#: Entries that the quantile sketch of a group keeps, about; ranks are off by n / SKETCH at most.
SKETCH = 4000


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str, sketch: int = SKETCH) -> DataFrame:
    """Exact median per group (mean of the middle two), also for a group of any size, in two passes.

    The first pass merges quantile sketches into a bracket around the middle of every group. The
    second counts the rows below the bracket and, by distinct value, those inside it; only these,
    some thousandths of a group, are ordered. That the bracket holds the middle is checked.
    """
    rows = (df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull()))
    margin = 4 / sketch
    sides = F.percentile_approx("_v", [max(0.0, 0.5 - margin), min(1.0, 0.5 + margin)], sketch)
    brackets = rows.groupBy(*keys).agg(F.count("*").alias("_n"), sides.alias("_b"))
    # Rows below the bracket fall together under null, so a map task passes on one row for them.
    inside = F.when(F.col("_v") >= F.col("_b")[0], F.col("_v"))
    counted = (rows.join(brackets, list(keys)).filter(F.col("_v") <= F.col("_b")[1])
               .groupBy(*keys, inside.alias("_v")).agg(F.count("*").alias("_c"), F.first("_n").alias("_n")))
    order = W.Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
    upto = F.sum("_c").over(order.rowsBetween(W.Window.unboundedPreceding, 0))
    placed = counted.withColumn("_upto", upto)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_c") < rank) & (F.col("_upto") >= rank), F.col("_v")))

    low, high = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    missed = F.raise_error(F.lit("the bracket misses the middle; take a larger sketch")).cast("double")
    return (placed.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(name))
            .withColumn(name, F.coalesce(name, missed)))
