"""Plans hold no nested-loop or cross joins, and Python only where blocks are multiplied."""

import pytest

from twinsift.plans import load_all

FOLDER = "/root/testdata/sf0.01"
REGISTRY = load_all()
# These write and read files while they are built, which other tests already do.
EAGER = {"files"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.section not in EAGER])
def test_no_nested_loops(spark, name):
    plan = plan_of(REGISTRY[name].run(spark, FOLDER))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    for row_python in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert row_python not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(REGISTRY["mine_candidate_pairs"].run(spark, FOLDER))
    assert "p_retailprice" not in plan
    assert "ReadSchema" in plan


def test_first_n_is_cut_before_the_shuffle(spark):
    for name in ("per_class_cap", "class_head_sample", "dedupe_first"):
        assert "WindowGroupLimit" in plan_of(REGISTRY[name].run(spark, FOLDER)), name


def test_filter_reaches_the_scan(spark):
    from twinsift.plans.registry import Tables
    from twinsift.operators import geo
    events = Tables(spark, FOLDER).events.selectExpr("user_id as cell", "ts", "value", "event_id as sample_id")
    plan = plan_of(geo.temporal_composite(events, "2024-01-05 00:00:00", "2024-01-06 00:00:00", ["mean"]))
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_vector_sums_make_no_row_per_dimension(spark):
    from twinsift.operators import similarity
    from twinsift.plans import lenses
    from twinsift.plans.registry import Tables
    assert "Generate" not in plan_of(similarity.vector_sums(lenses.embeddings(Tables(spark, FOLDER))))


def test_ranges_scan_their_table_once(spark):
    for name in ("effective_countries", "top_countries", "range_class"):
        plan = REGISTRY[name].run(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
        assert sum("Relation" in line and "l_orderkey" in line for line in plan.splitlines()) == 1, name


def test_items_read_texts_once_after_images_are_chosen(spark):
    def texts_joined(name):
        plan = REGISTRY[name].run(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count(" AS lay_observation#")

    assert texts_joined("assemble_dialogue") == 1
    assert texts_joined("select_items") == 0
