"""python -m cellweave list | run NAME TABLES | convert CSV [OUTPUT]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from cellweave.plans import catalog
from cellweave.sources.files import convert_dense_csv


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cellweave", description="Queries over cell-by-feature matrices and intervals.")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="run a query and show its first rows, or write them all")
    run.add_argument("name", choices=sorted(catalog.queries()))
    run.add_argument("tables", help="folder of the Parquet tables")
    run.add_argument("--output", help="folder to write the result to, as Parquet")
    convert = commands.add_parser("convert", help="a dense CSV of genes by cells to a matrix")
    convert.add_argument("input")
    convert.add_argument("output", nargs="?")
    chosen = parser.parse_args(args)
    if chosen.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return 0
    spark = SparkSession.builder.appName("cellweave").getOrCreate()
    if chosen.command == "convert":
        print(convert_dense_csv(spark, chosen.input, chosen.output))
        return 0
    result = catalog.queries()[chosen.name](spark, chosen.tables)
    if chosen.output:
        result.write.parquet(chosen.output)
    else:
        result.show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
