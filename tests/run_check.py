"""Run registered queries against their SQL: run_check.py [sf_dir] [name or prefix*...]."""

import sys
import time
import traceback

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")
from compare import connect, differences  # noqa: E402

import __spark_entry__ as catalog  # noqa: E402
from tabstat.session import local_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session("check", 8)
    con = connect(sf)
    qs, sql = catalog.queries(), catalog.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) or fn.__module__.endswith("." + w) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in sql:
                msg = differences(df, con, sql[name])
            else:
                rows = df.collect()
                msg = None if rows else "no rows"
                if len(rows) <= 6 and wanted:
                    for r in rows:
                        print("     ", r)
        except Exception as e:
            msg = "ERROR " + str(e)[:600]
            if len(wanted) == 1 and not wanted[0].endswith("*"):
                traceback.print_exc()
        bad += msg is not None
        print(f"{'ok  ' if msg is None else 'FAIL'} {'S' if name in sql else 'R'} {time.time() - t:6.2f}s {name} {msg or ''}", flush=True)
        spark.catalog.clearCache()
    print("failures:", bad)


main()
