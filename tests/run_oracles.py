"""Command line check: python tests/run_oracles.py [sf_dir] [name part ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from peerlens.session import local_session  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = local_session("8", 8, "peerlens-oracles")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf_dir)
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in sqls:
                why = oracle.compare(spark, con, fn, sqls[name], sf_dir)
            else:
                why = None if fn(spark, sf_dir).count() else "no rows"
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:700]}"
        bad += why is not None
        print(f"{'ok  ' if why is None else 'FAIL'} {name} {'' if name in sqls else '(rows only) '}"
              f"{time.time() - start:.2f}s {why or ''}", flush=True)
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
