"""Skew helpers give what the plain operator gives, with one key holding most rows."""

import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql import window as W

from twinsift.operators import skew


@pytest.fixture(scope="module")
def rows(spark):
    key = F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 41).cast("string")))
    return spark.range(3000).select("id", key.alias("k"), ((F.col("id") * 7919) % 613 / 7).alias("v"))


def bag(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(rows, how):
    right = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k <> 'k3'")
    salted = skew.salted_join(rows, right, ["k"], ["id"], how)
    assert bag(salted.select(sorted(salted.columns))) == bag(
        (lambda d: d.select(sorted(d.columns)))(rows.join(right, "k", how)))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_checked_join(rows, how):
    right = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k <> 'k3'")
    got = skew.checked_join(rows, right, ["k"], how)
    want = rows.join(right, "k", how)
    assert bag(got.select(sorted(got.columns))) == bag(want.select(sorted(want.columns)))
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_lookup(rows):
    table = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k <> 'k3'")
    got, want = skew.lookup(rows, table, ["k"], ["id"]), rows.join(table, "k", "left")
    assert bag(got.select("id", "k", "n")) == bag(want.select("id", "k", "n"))


@pytest.mark.parametrize("attach", [skew.attach_group, skew.attach_class])
def test_attach_group(rows, attach):
    spread = [["id"]] if attach is skew.attach_group else []
    got = attach(rows, ["k"], [F.count("*").alias("n"), F.max("v").alias("top")], *spread)
    w = W.Window.partitionBy("k")
    want = rows.withColumn("n", F.count("*").over(w)).withColumn("top", F.max("v").over(w))
    assert bag(got.select("id", "n", "top")) == bag(want.select("id", "n", "top"))


def test_row_number_in_group(rows):
    got = skew.row_number_in_group(rows, ["k"], F.floor(F.col("id") / 100), ["id"], "n", "total")
    w = W.Window.partitionBy("k")
    want = (rows.withColumn("n", F.row_number().over(w.orderBy("id")))
            .withColumn("total", F.count("*").over(w)))
    assert bag(got.select("id", "n", "total")) == bag(want.select("id", "n", "total"))


def test_rank_by_hash(rows):
    hashed = rows.withColumn("h", F.md5(F.col("id").cast("string").cast("binary")))
    got = skew.rank_by_hash(hashed, "h", "r", "n").orderBy("r").select("r", "h", "n").collect()
    assert [r["r"] for r in got] == list(range(3000))
    assert [r["h"] for r in got] == sorted(r["h"] for r in got)
    assert {r["n"] for r in got} == {3000}


@pytest.mark.parametrize("sketch", [8, 100, 4000])
def test_exact_median(rows, sketch):
    got = dict(map(tuple, skew.exact_median(rows, ["k"], "v", "m", sketch).select("k", "m").collect()))
    groups = {}
    for r in rows.collect():
        groups.setdefault(r["k"], []).append(r["v"])
    assert got == pytest.approx({k: statistics.median(v) for k, v in groups.items()})


def test_exact_median_of_equal_and_missing_values(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", None), ("b", 5.0), ("c", None)], "k string, v double")
    assert bag(skew.exact_median(df, ["k"], "v", "m").select("k", "m")) == [("a", 2.0), ("b", 5.0)]


def test_exact_median_with_a_heavy_tail(spark):
    """One outlier puts all other values of a hot group into one slice of the first level."""
    rows = [("hot", i / 3000.0) for i in range(3001)] + [("hot", 1e12), ("hot", -1e12), ("hot", 2e12)]
    rows += [("even", 1.0), ("even", 9e9), ("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["m"] for r in skew.exact_median(df, ["k"], "v", "m").collect()}
    want = {r["k"]: r["m"] for r in df.filter("v is not null").groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert got == want


def test_exact_median_orders_the_bracket_only(spark):
    """A hot key over several partitions: the plan is built without a job, and the bracket is small."""
    df = spark.range(0, 200_000, 1, 8).selectExpr(
        "CASE WHEN id % 3 > 0 THEN 'hot' ELSE concat('k', id % 50) END AS k",
        "CASE WHEN id % 7 = 0 THEN 1.5 ELSE pow(10, (hash(id) % 1000) / 100.0) END AS v")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    out = skew.exact_median(df, ["k"], "v", "m", sketch=500)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert {r["k"]: r["m"] for r in out.collect()} == pytest.approx(want)


def test_spread_join(rows):
    table = rows.select("k").distinct().filter("k <> 'k3'").withColumn(
        "w", F.explode(F.array(F.lit("x" * 100), F.lit("y"))))
    got, want = skew.spread_join(rows, table, ["k"], ["id"]), rows.join(table, "k")
    assert bag(got.select("id", "k", "w")) == bag(want.select("id", "k", "w"))
