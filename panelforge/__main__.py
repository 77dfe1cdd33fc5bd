"""Runs one panel query: python -m panelforge --data DIR --output DIR --query NAME [--threads N]."""

from __future__ import annotations

import argparse


def threads(text: str) -> int:
    n = int(text)
    if not 1 <= n <= 10:
        raise argparse.ArgumentTypeError("1 to 10")
    return n


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    from .plans.catalogue import QUERIES

    parser = argparse.ArgumentParser(prog="panelforge", description=__doc__)
    parser.add_argument("--data", required=True, help="folder of the tables")
    parser.add_argument("--output", required=True, help="folder for the result, as Parquet")
    parser.add_argument("--query", required=True, choices=sorted(QUERIES))
    parser.add_argument("--threads", type=threads, default=8, help="of local mode; a cluster's own setting stays")
    return parser.parse_args(given)


def main(given: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from .plans.catalogue import QUERIES

    args = arguments(given)
    spark = SparkSession.getActiveSession() or SparkSession.builder.master(f"local[{args.threads}]").getOrCreate()
    QUERIES[args.query](spark, args.data).write.mode("overwrite").parquet(args.output)


if __name__ == "__main__":
    main()
