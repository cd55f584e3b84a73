"""Compares registered queries with their SQL: run_oracle.py [sf] [names...]."""

import sys
import time
import traceback
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from compare import difference, duck  # noqa: E402
import __spark_entry__ as entry  # noqa: E402
from tidewarden.session import build_session  # noqa: E402


def main(argv):
    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", extra={
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracle = duck(folder), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            problem = difference(queries[name](spark, folder), con, oracle[name]) if name in oracle \
                else f"no oracle, rows {queries[name](spark, folder).count()}"
        except Exception:
            problem = traceback.format_exc()[-1500:]
        bad += problem is not None
        print(f"{name:32s} {time.time() - start:6.2f}s {'ok' if problem is None else problem}", flush=True)
    print("differences:", bad)


main(sys.argv[1:])
