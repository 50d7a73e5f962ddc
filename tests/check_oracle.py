"""Run every registered query against its oracle SQL and print the verdicts.

usage: python tests/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from shiftwise.session import build_session  # noqa: E402
from tests.harness import compare, duck_connect  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck_connect(sf_dir)
    qs, oracle = E.queries(), E.oracle_sql()
    bad = 0
    for name, q in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        if name not in oracle:
            n = q(spark, sf_dir).count()
            print(f"{name:32s} NO-ORACLE rows={n} {time.time() - t0:.1f}s")
            continue
        try:
            ok, msg = compare(q(spark, sf_dir), con, oracle[name])
        except Exception as exc:  # report and continue
            ok, msg = False, f"ERROR {type(exc).__name__}: {str(exc)[:800]}"
        bad += not ok
        print(f"{name:32s} {'OK ' if ok else 'BAD'} {msg[:2500]} {time.time() - t0:.1f}s")
    print(f"{bad} mismatches")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
