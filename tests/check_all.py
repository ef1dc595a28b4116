"""Command line: check some or all queries against their SQL twins.

python tests/check_all.py [name-prefix ...]   (SF_DIR selects the tables, SESSION_TZ another session time zone)
"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from govspark.session import local_session  # noqa: E402
from govspark.suite import ORACLES, QUERIES  # noqa: E402
from tests.compare import connect, difference  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = [n for n in QUERIES if not sys.argv[1:] or any(n.startswith(a) for a in sys.argv[1:])]
    spark = local_session(os.environ.get("TEST_CPUS", "8"))
    spark.sparkContext.setLogLevel("OFF")
    spark.conf.set("spark.sql.session.timeZone", os.environ.get("SESSION_TZ", "UTC"))
    con = connect(sf_dir)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                verdict = difference(df, con, ORACLES[name]) or "ok"
            else:
                verdict = f"rows-only {df.count()}"
        except Exception as error:  # noqa: BLE001
            verdict = f"{type(error).__name__}: {str(error)[:500]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += not (verdict == "ok" or verdict.startswith("rows-only"))
        print(f"{name:28s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print(f"{len(wanted)} checked, {bad} bad", flush=True)


if __name__ == "__main__":
    main()
