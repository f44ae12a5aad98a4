"""python -m tessella list | run NAME SF_DIR [--out FOLDER] [--show N]: the registered queries from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tessella import plans


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessella", description="Run the library's queries.")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="run one query")
    run.add_argument("name", choices=sorted(plans.QUERIES), metavar="NAME")
    run.add_argument("sf_dir", help="folder of the tables")
    run.add_argument("--out", help="write the result there as Parquet")
    run.add_argument("--show", type=int, default=20, help="rows to print (default 20)")
    given = parser.parse_args(argv)
    if given.command == "list":
        print("\n".join(sorted(plans.QUERIES)))
        return
    spark = SparkSession.builder.appName(f"tessella {given.name}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = plans.QUERIES[given.name](spark, given.sf_dir)
    if given.out:
        found.write.mode("overwrite").parquet(given.out)
    else:
        found.show(given.show, truncate=False)


if __name__ == "__main__":
    main()
