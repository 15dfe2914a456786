"""Loaders: market tables and the tables that play their part in the test data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``l_suppkey`` to ``ticker`` and ``sector``; the join strategy is left to the sizes that Spark sees."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("ticker"), F.col("n_regionkey").alias("sector"))
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "ticker", "sector", "s_acctbal")


def traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_quantity <> 0")


def turn() -> Column:
    """A trade's place in its day, by order, line, part and supplier: one fixed-width number, so that bars aggregate by hash. A key too long for its digits is an error."""
    key = F.lit(0)
    for name, digits in (("l_orderkey", 13), ("l_linenumber", 4), ("l_partkey", 11), ("l_suppkey", 10)):
        key = (key * F.lit(10**digits).cast("decimal(14,0)") + F.col(name).cast(f"decimal({digits},0)")).cast("decimal(38,0)")
    return key


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: ``ticker, bar_date, open, high, low, close, volume``. The first and the last trade of a day are those by ``turn``."""
    px = F.col("l_extendedprice") / F.col("l_quantity")
    trades = traded(spark, sf_dir).select("l_suppkey", F.to_date("l_shipdate").alias("bar_date"), "l_quantity", px.alias("px"), turn().alias("turn"))
    named = trades.join(supplier_nations(spark, sf_dir).select("l_suppkey", "ticker"), "l_suppkey")
    return named.groupBy("ticker", "bar_date").agg(F.min_by("px", "turn").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "turn").alias("close"), F.sum("l_quantity").cast("long").alias("volume"))


def as_of(spark: SparkSession, sf_dir: str):
    """The date of the newest trade, from a scan of the two columns it needs: the clock of everything that looks back from today."""
    return traded(spark, sf_dir).agg(F.to_date(F.max("l_shipdate"))).first()[0]


def latest_date(frame: DataFrame, date_col: str = "bar_date"):
    """The newest date, as a literal date or None: the run's ``as_of``."""
    return frame.agg(F.max(date_col)).first()[0]


def history(prices: DataFrame, as_of, days: int, least: int = 1) -> DataFrame:
    """Rows of the ``days`` calendar days to ``as_of``, of tickers with ``least`` rows there."""
    recent = prices.where((F.col("bar_date") >= F.date_sub(F.lit(as_of), days)) & (F.col("bar_date") <= F.lit(as_of)))
    return recent.withColumn("n_rows", F.count("*").over(Window.partitionBy("ticker"))).where(F.col("n_rows") >= least)


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ticker, revenue, de_ratio, insiders`` (small counts played by the number of suppliers)."""
    lines = table(spark, sf_dir, "lineitem").join(supplier_nations(spark, sf_dir).select("l_suppkey", "ticker"), "l_suppkey")
    revenue = lines.groupBy("ticker").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    debt = supplier_nations(spark, sf_dir).groupBy("ticker").agg((F.abs(F.avg("s_acctbal")) / 5000).alias("de_ratio"), F.count("*").alias("insiders"))
    return revenue.join(debt, "ticker")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ticker, form, filed``: events by user; purchases play form 4."""
    form = F.when(F.col("event_type") == "purchase", "4").when(F.col("event_type") == "view", "10-Q").when(F.col("event_type") == "click", "10-K").otherwise("8-K")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), form.alias("form"), F.to_date("ts").alias("filed"), F.col("event_id"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``indicator, data_date, value``: monthly mean order value by priority."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("indicator"), F.trunc("o_orderdate", "month").alias("data_date")).agg(F.avg("o_totalprice").alias("value"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("ticker"), "doc_id", "text")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select("conv_id", F.concat_ws(" ", F.transform("t", lambda x: x["text"])).alias("text"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ticker, sector, trailing_pe, gross_margin, operating_margin, profit_margin``."""
    lines = table(spark, sf_dir, "lineitem").join(supplier_nations(spark, sf_dir).select("l_suppkey", "ticker", "sector"), "l_suppkey")
    margin = lines.groupBy("ticker", "sector").agg(F.avg("l_discount").alias("gross_margin"), F.avg("l_tax").alias("operating_margin"), (F.avg("l_discount") - F.avg("l_tax") - 0.01).alias("profit_margin"))
    pe = supplier_nations(spark, sf_dir).groupBy("ticker").agg((F.avg("s_acctbal") / 100).alias("trailing_pe"))
    return margin.join(pe, "ticker")


def source_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``metric, source, value, as_of``: one price of each part by each supplier, the newest by the full row."""
    lines = table(spark, sf_dir, "lineitem")
    key = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return lines.where("l_quantity <> 0").groupBy(F.col("l_partkey").alias("metric"), F.col("l_suppkey").alias("source")).agg(F.max_by(F.col("l_extendedprice") / F.col("l_quantity"), key).alias("value"), F.to_date(F.max("l_shipdate")).alias("as_of"))
