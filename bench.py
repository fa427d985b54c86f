"""Wall time of the headline queries: prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local cores, BENCH_ONLY an
optional comma-separated list of queries (or "all").
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from twinsift.plans import load_all  # noqa: E402
from twinsift.session import build_session  # noqa: E402

HEADLINE = (
    "mine_candidate_pairs", "rank_pairs", "label_gate", "class_threshold", "per_class_cap",
    "split_assign", "split_collapse", "nn_by_class", "bidirectional_confusability",
    "separation_ratio", "pair_manifest", "evidence_merge", "journal_typed", "journal_stream",
    "geo_ladder", "attach_features", "temporal_composite", "zone_polygon_join", "range_class",
    "strip_html", "lay_sign", "select_items", "item_skeleton", "assemble_dialogue",
    "coverage_summary", "geo_prior", "geodesic_error",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_ONLY", "")
    registry = load_all()
    names = list(registry) if only == "all" else (only.split(",") if only else HEADLINE)
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
        "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false"})
    # One untimed query starts the session, its executors and the Python workers.
    registry["rank_pairs"].run(spark, folder).write.format("noop").mode("overwrite").save()
    registry["nn_by_class"].run(spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        registry[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{times[name]:8.3f}  {name}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(folder)}))
    spark.stop()


if __name__ == "__main__":
    main()
