"""Runs the registered queries against their check SQL: python tests/check.py [folder] [names]."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tests import oracle  # noqa: E402
from tidemark import build_session  # noqa: E402


def main(folder: str, wanted: list[str]) -> int:
    spark = build_session("check", "local[8]", 8, "8g")
    spark.sparkContext.setLogLevel("OFF")
    con = oracle.connect(folder)
    checks = entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in checks:
                good, note = oracle.compare(df, checks[name], con)
            else:
                good, note = True, f"{df.count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            good, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += not good
        print(f"{'ok  ' if good else 'FAIL'} {name:34s} {time.time() - start:6.1f}s  {note}",
              flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01",
                       sys.argv[2:])))
