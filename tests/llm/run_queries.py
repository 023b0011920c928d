"""Compare the operators' queries with their SQL: ``python tests/llm/run_queries.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), os.path.dirname(os.path.dirname(HERE))]


def main(argv):
    import __spark_entry__
    from harness import compare, duck

    from folio.session import local_session
    sf = f"/root/testdata/{argv[0] if argv else 'sf0.001'}"
    spark, con = local_session(os.environ.get("CORES", "8")), duck(sf)
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for n in queries:
        if (n.startswith("op") or n == "pipeline") and (not argv[1:] or any(n.startswith(p) for p in argv[1:])):
            said, a, b = compare(spark, con, n, queries[n], sql.get(n), sf)
            print(f"{n:28s} {a:6.2f}s {b:6.2f}s {said[:1500]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
