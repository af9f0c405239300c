"""Command line: list queries, run one, evaluate a frozen run. Exit codes: 0 done, 1 failed, 2 wrong arguments."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="penduline")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("query", help="run a query over a folder of tables")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("--out", help="parquet folder; without it the first rows are shown")
    again = commands.add_parser("evaluate", help="evaluate a frozen run")
    again.add_argument("path")
    given = parser.parse_args(argv)

    from penduline.queries import load, problems

    queries = {**problems.QUERIES, **load()[0]}
    if given.command == "list":
        print("\n".join(sorted(queries)))
        return 0
    spark = SparkSession.builder.appName("penduline").getOrCreate()
    try:
        if given.command == "evaluate":
            from penduline.plans import runs

            runs.evaluate(spark, runs.Run(given.path)).show(truncate=False)
            return 0
        if given.name not in queries:
            print(f"unknown query {given.name}", file=sys.stderr)
            return 2
        df = queries[given.name](spark, given.tables)
        df.write.parquet(given.out) if given.out else df.show(truncate=False)
        return 0
    except Exception as fault:  # noqa: BLE001
        print(fault, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
