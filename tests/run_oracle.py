"""``python tests/run_oracle.py [folder] [name …]``: compare registered queries with their SQL."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

from oracle import connect, differences  # noqa: E402
from sitelode.plans import PLANS  # noqa: E402
from sitelode.session import local_session  # noqa: E402


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(PLANS)
    names = [n for n in PLANS if any(n.startswith(w) for w in wanted)]
    spark, con, bad = local_session(8), connect(folder), 0
    for name in names:
        plan, started = PLANS[name], time.perf_counter()
        try:
            df = plan.run(spark, folder)
            found = differences(df, con, plan.sql) if plan.sql else [] if df.count() else ["no rows"]
        except Exception as error:  # noqa: BLE001
            found = [f"{type(error).__name__}: {str(error)[:1500]}", traceback.format_exc(limit=-2)[-600:]]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.perf_counter() - started:.1f}s {'' if plan.sql else '(rows only)'}", flush=True)
        for line in found:
            print("     ", line, flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
