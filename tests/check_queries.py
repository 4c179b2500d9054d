"""Command line: run all queries (or those named) on a folder, compare with SQL, print times."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from signalcheck.queries import ORACLE, QUERIES  # noqa: E402
from signalcheck.session import build_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main(folder: str, names: list[str]) -> int:
    spark = build_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failed = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            result = QUERIES[name](spark, folder)
            if name in ORACLE:
                problem = compare(result, connection, ORACLE[name]) or "agrees"
            else:
                problem = f"{result.count()} rows, no SQL"
        except Exception:
            problem = "ERROR " + traceback.format_exc()[-1500:]
        bad = name in ORACLE and problem != "agrees" or problem.startswith("ERROR")
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {time.time() - start:6.1f}s {name}: {problem}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
