"""Command line: ``python -m quantloom analyze|status|schedule [--data DIR] [--out DIR]``."""

from __future__ import annotations

import argparse
import datetime
import os
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from quantloom.plans.analyze import LINEAGE, analyze, full_analysis
from quantloom.sources import sinks


def next_run(now: datetime.datetime, hour: int = 8, minute: int = 0) -> datetime.datetime:
    """The next daily run: today if its time is still to come, else tomorrow."""
    today = now.replace(hour=hour, minute=minute, second=0, microsecond=0)
    return today if today > now else today + datetime.timedelta(days=1)


def run_batch(spark: SparkSession, data: str, out: str) -> str:
    """The full batch as JSON and as an HTML report, in a folder named by the time of the run."""
    folder = f"{out}/analysis_{datetime.datetime.now():%Y%m%d_%H%M%S}"
    sinks.write_json(full_analysis(spark, data), f"{folder}/json")
    done = sinks.write_report(spark.read.json(f"{folder}/json"), [*LINEAGE], f"{folder}/html")
    if "error" in done:
        raise OSError(done["error"])
    return folder


def schedule(job: Callable[[], object], *, runs: int | None = None, now=datetime.datetime.now, sleep=time.sleep) -> None:
    """``job`` every day at 08:00, for ever or ``runs`` times; a failed run is told and does not end the schedule."""
    while runs is None or runs > 0:
        sleep((next_run(at := now()) - at).total_seconds())
        try:
            job()
        except Exception as e:  # noqa: BLE001 - tomorrow's run is not to depend on today's
            print(f"run failed: {e}")
        runs = None if runs is None else runs - 1


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quantloom")
    parser.add_argument("command", nargs="?", choices=("analyze", "status", "schedule"))
    parser.add_argument("--data", default=os.environ.get("QUANTLOOM_DATA", "."))
    parser.add_argument("--out", default="reports")
    given = parser.parse_args(args)
    if not given.command:
        parser.print_help()
        return 0
    spark = spark or SparkSession.builder.appName("quantloom").getOrCreate()
    if given.command == "analyze":
        print(run_batch(spark, given.data, given.out))
    elif given.command == "status":
        row = sinks.status(analyze(spark, given.data)).first()
        print(", ".join(f"{k}: {v}" for k, v in row.asDict().items()))
        return int(row["health"] != "OPERATIONAL")
    else:
        schedule(lambda: print(run_batch(spark, given.data, given.out)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
