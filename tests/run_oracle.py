"""``python tests/run_oracle.py SF_DIR [name-prefix ...]``: check registered queries against SQL."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, connect  # noqa: E402

from ledgerscope.plans.catalog import load  # noqa: E402
from ledgerscope.session import local_session  # noqa: E402


def main() -> int:
    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    con = connect(sf_dir)
    failed = 0
    for name, (job, sql) in load().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        started = time.time()
        try:
            df = job(spark, sf_dir)
            problems = compare(df, con, sql) if sql else []
            rows = "" if sql else f" rows={df.count()}"
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
            if os.environ.get("TRACE"):
                traceback.print_exc()
            rows = ""
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - started:.2f}s{rows}", *problems, sep="\n      " if problems else " ", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
