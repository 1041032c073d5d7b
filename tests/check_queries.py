"""Run registered queries against their SQL twins: check_queries.py SF [name ...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import differences, duck  # noqa: E402

from dwellframe import plans  # noqa: E402
from dwellframe.session import local_session  # noqa: E402


def main():
    sf, names = sys.argv[1], sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    registry = plans.load_all()
    chosen = [n for n in registry if not names or n in names
              or registry[n].build.__module__.split(".")[-1] in names]
    bad = 0
    for name in chosen:
        q = registry[name]
        t = time.time()
        try:
            df = q.build(spark, sf_dir)
            if q.sql is None:
                rows = df.count()
                line = f"rows-only {rows}"
            else:
                diff = differences(df, con, q.sql)
                line = "ok" if not diff else "DIFF " + "; ".join(diff)
                bad += bool(diff)
        except Exception as e:  # report and go on with the next query
            line, bad = f"ERROR {type(e).__name__}: {str(e)[:600]}", bad + 1
        print(f"{name:32s} {time.time() - t:6.2f}s {line}"[:1500], flush=True)
    print("failed", bad, "of", len(chosen))


main()
