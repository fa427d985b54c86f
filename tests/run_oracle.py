"""Run registered queries against their SQL: `python tests/run_oracle.py [folder] [name ...]`."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from tests.compare import connect, difference  # noqa: E402
from twinsift.plans import load_all  # noqa: E402
from twinsift.session import build_session  # noqa: E402

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
wanted = sys.argv[2:]
spark = build_session("oracle", "local[8]", **{
    "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
    "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false"})
con = connect(folder)
failed = []
registry = load_all()
for name, q in registry.items():
    if wanted and not any(name.startswith(w) or q.section == w for w in wanted):
        continue
    start = time.time()
    try:
        df = q.run(spark, folder)
        problem = difference(df, con, q.sql) if q.sql else (None if df.count() else "no rows")
    except Exception as e:  # noqa: BLE001 - a report of every failing query is wanted
        problem = f"{type(e).__name__}: {str(e)[:1500]}"
    print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:6.2f}s {name}"
          f"{'' if q.sql else ' (no SQL)'}", flush=True)
    if problem:
        print("   ", problem, flush=True)
        failed.append(name)
print(f"{len(failed)} failed of {len(registry)}: {failed}")
