"""Run registered queries and write their results.

    spark-submit --py-files marketspark.zip -m marketspark \\
        --input <folder with the source tables> --output <folder> [query ...]

With no query names every batch query runs. Results are written as parquet
to <output>/<query> (overwrite). `--explain` prints the formatted physical
plan instead of writing. The session comes from the cluster configuration
(spark-submit); `--master` is for local runs.
"""

from __future__ import annotations

import argparse
import sys
import time


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="marketspark")
    ap.add_argument("queries", nargs="*", help="query keys (default: all batch queries)")
    ap.add_argument("--input", required=True, help="folder with the source tables (<name>.parquet)")
    ap.add_argument("--output", help="folder for the results (required unless --explain/--list)")
    ap.add_argument("--master", default=None, help="only for local runs, e.g. local[8]")
    ap.add_argument("--explain", action="store_true", help="print the formatted plan, write nothing")
    ap.add_argument("--list", action="store_true", help="list query keys and exit")
    a = ap.parse_args(argv)

    from .plans.queries import all_queries
    qs = all_queries()
    if a.list:
        for k in sorted(qs):
            print(k)
        return 0
    names = a.queries or sorted(k for k in qs if not k.startswith("stream_"))
    unknown = [n for n in names if n not in qs]
    if unknown:
        ap.error(f"unknown queries: {', '.join(unknown)}")
    if not a.explain and not a.output:
        ap.error("--output is required")

    from .session import get_spark
    spark = get_spark(a.master)
    for n in names:
        t0 = time.time()
        df = qs[n](spark, a.input)
        if a.explain:
            print(f"== {n} ==")
            df.explain("formatted")
            continue
        df.write.mode("overwrite").parquet(f"{a.output.rstrip('/')}/{n}")
        print(f"{n}: {time.time() - t0:.1f}s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
