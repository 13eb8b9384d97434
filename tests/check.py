"""Command line check: python -m tests.check [name ...]  (folder from $CHECK_DIR)."""

from __future__ import annotations

import os
import sys
import time
import traceback

from tests.compare import connect, difference
from waymark.plans import load
from waymark.session import local_session


def main(argv):
    folder = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    queries, oracles = load()
    names = []
    for a in argv or ["*"]:
        names += [n for n in queries if a == "*" or n == a or (a.endswith("*") and n.startswith(a[:-1]))]
    spark = local_session()
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                diff = difference(df, con, oracles[name])
                note = "ok" if diff is None else "DIFF " + diff
                if diff is None:
                    note += f" rows={df.sparkSession and con.execute('select count(*) from (' + oracles[name] + ')').fetchall()[0][0]}"
            else:
                note = f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            note = "ERROR " + (str(e)[:900] if not os.environ.get("TRACE") else traceback.format_exc())
        bad += note.startswith(("DIFF", "ERROR"))
        print(f"{name:24s} {time.time() - start:6.1f}s {note}", flush=True)
    print("failed:", bad, flush=True)
    os._exit(1 if bad else 0)


if __name__ == "__main__":
    main(sys.argv[1:])
