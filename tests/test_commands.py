"""The command line, the schedule, and indicators kept as streaming state."""

import datetime
import glob
import json

import pytest
from pyspark.sql import functions as F

from quantloom import __main__ as cli
from quantloom.operators import indicators as batch
from quantloom.plans.analyze import analyze
from quantloom.sources import sinks, tables
from quantloom.streaming import indicators

SF = "/root/testdata/sf0.001"


def test_schedule_waits_for_eight_and_survives_a_failure():
    at = datetime.datetime(2024, 2, 28, 8, 0)
    assert cli.next_run(at) == datetime.datetime(2024, 2, 29, 8, 0)
    assert cli.next_run(at - datetime.timedelta(seconds=1)) == at
    waits, ran = [], []

    def job():
        ran.append(1)
        if len(ran) == 1:
            raise ValueError("no data")

    cli.schedule(job, runs=3, now=lambda: at.replace(hour=7), sleep=waits.append)
    assert len(ran) == 3 and waits == [3600.0] * 3


def test_commands(spark, tmp_path, capsys):
    assert cli.main([], spark) == 0 and "usage" in capsys.readouterr().out
    assert cli.main(["status", "--data", SF], spark) == 0 and "health: OPERATIONAL" in capsys.readouterr().out
    assert cli.main(["analyze", "--data", SF, "--out", str(tmp_path)], spark) == 0
    folder = capsys.readouterr().out.strip()
    rows = [json.loads(x) for f in glob.glob(f"{folder}/json/*.json") for x in open(f)]
    pages = [x for f in glob.glob(f"{folder}/html/*.txt") for x in open(f)]
    assert len(rows) == len(pages) == analyze(spark, SF).count() > 0 and all(x.startswith("<section>") for x in pages)


def test_an_empty_batch_is_degraded(spark):
    empty = spark.createDataFrame([], "ticker string, signal string, combined double")
    assert sinks.status(empty).first().asDict() == {"tickers": 0, "buys": 0, "errors": 0, "health": "DEGRADED"}


def test_streamed_indicators_equal_the_batch(spark, tmp_path):
    prices = tables.bars(spark, SF).select("ticker", "bar_date", "close")
    one, two = [r[0] for r in prices.select("ticker").distinct().orderBy("ticker").limit(2).collect()]
    prices = prices.where(F.col("ticker").isin(one, two))
    days = [r[0] for r in prices.select("bar_date").distinct().orderBy("bar_date").limit(60).collect()]
    prices = prices.where(F.col("bar_date").isin(days)).cache()
    source, out = str(tmp_path / "bars"), str(tmp_path / "out")
    odd = spark.createDataFrame([(one, None, 1.0), (two, days[0], None), (None, days[3], 2.0)], prices.schema)
    parts = [(days[0], days[9]), (days[10], days[20]), (days[0], days[5]), (days[21], days[-1])]  # the third comes again and changes nothing
    for a, b in parts:
        prices.where(F.col("bar_date").between(a, b)).union(odd).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(prices.schema).parquet(source)
        written = indicators.indicators(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        written.start(out).awaitTermination(120)
    got = spark.read.parquet(out).where("ticker is not null").toPandas()
    assert len(got) == prices.count() and not got.duplicated(["ticker", "bar_date"]).any()
    for end in (days[7], days[14], days[15], days[-1]):
        series = batch.closes(prices.where(F.col("bar_date") <= end))
        for r in batch.rsi_wilder(batch.macd(series)).collect():
            x = got[(got.ticker == r.ticker) & (got.bar_date == r.bar_date)].iloc[0]
            assert [x.macd, x.signal_line, x.rsi] == pytest.approx([r.macd, r.signal_line, r.rsi], rel=1e-9)
