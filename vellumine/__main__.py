"""python -m vellumine --annotation-dir IN --output-dir OUT: extracts annotated posters, scores them, prints the report and its summary."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from vellumine.operators.metrics import summary
from vellumine.plans.evaluate import run_eval
from vellumine.session import prepare


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="vellumine", description=__doc__)
    parser.add_argument("--annotation-dir", required=True)
    parser.add_argument("--output-dir", required=True)
    parser.add_argument("--generator", default="rules")
    given = parser.parse_args(args)
    report = run_eval(prepare(SparkSession.builder.getOrCreate()), given.annotation_dir, given.output_dir, given.generator)
    report.show(100, truncate=False)
    summary(report).show(truncate=False)


if __name__ == "__main__":
    main()
