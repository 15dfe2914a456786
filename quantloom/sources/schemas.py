"""Schemas of the engine's tables, and loaders of the two JSON documents that providers deliver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, IntegerType, LongType, StringType, StructType, TimestampType

LINEAGE = "source STRING, retrieval_timestamp TIMESTAMP, publication_timestamp TIMESTAMP"
#: Column lists by table. Keys are enforced by the sinks' upserts, not by the storage.
DDL = {
    "bars": "ticker STRING, bar_date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, adjusted_close DOUBLE, volume BIGINT",
    "fundamentals": "ticker STRING, period STRING, data_date DATE, revenue DOUBLE, operating_income DOUBLE, net_income DOUBLE, free_cash_flow DOUBLE, total_debt DOUBLE, cash_and_equivalents DOUBLE, data_confidence INT",
    "insider_transactions": "ticker STRING, insider_name STRING, insider_role STRING, transaction_type STRING, transaction_date DATE, filing_date DATE, shares DOUBLE, price DOUBLE, amount DOUBLE, confidence INT",
    "calendar_events": "ticker STRING, event_type STRING, event_date DATE, event_time STRING, description STRING",
    "metrics": "ticker STRING, metric STRING, value STRING, confidence INT, timestamp TIMESTAMP",
    "macro": "indicator STRING, data_date DATE, value DOUBLE, confidence INT",
    "backtest_results": "ticker STRING, date DATE, predicted_signal STRING, actual_direction STRING, accuracy_5d INT, profit_loss DOUBLE, split_type STRING",
}
#: Tables whose rows carry their lineage.
WITH_LINEAGE = ("bars", "fundamentals", "insider_transactions", "calendar_events", "macro")
FILINGS = "filings STRUCT<recent: STRUCT<form: ARRAY<STRING>, filingDate: ARRAY<STRING>>>"
NEWS = "articles ARRAY<STRUCT<title: STRING, description: STRING, source: STRUCT<name: STRING>, publishedAt: STRING>>, totalResults INT"


_TYPES = {"STRING": StringType, "DATE": DateType, "DOUBLE": DoubleType, "INT": IntegerType, "BIGINT": LongType, "TIMESTAMP": TimestampType}


def schema(table: str) -> StructType:
    """The table's type; known without a session."""
    out = StructType()
    for column in (DDL[table] + (", " + LINEAGE if table in WITH_LINEAGE else "")).split(", "):
        name, kind = column.split(" ")
        out = out.add(name, _TYPES[kind]())
    return out


def create(spark: SparkSession, table: str, path: str) -> DataFrame:
    """The table at ``path``, written empty if there is none yet."""
    spark.createDataFrame([], schema(table)).write.mode("ignore").parquet(path)
    return spark.read.schema(schema(table)).parquet(path)


def filings_json(spark: SparkSession, path: str) -> DataFrame:
    """``ticker, pos, form, filed`` of one submissions document a company; the file's name is the ticker. Unreadable documents give no row."""
    docs = spark.read.schema(FILINGS).json(path, multiLine=True).withColumn("ticker", F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.json)?$", 1))
    rows = docs.select("ticker", F.posexplode(F.arrays_zip("filings.recent.form", "filings.recent.filingDate")).alias("pos", "f"))
    return rows.select("ticker", "pos", F.col("f.form").alias("form"), F.to_date("f.filingDate").alias("filed"))


def news_json(spark: SparkSession, path: str) -> DataFrame:
    """``ticker, pos, title, description, publisher, published`` of one article list a ticker, named as above."""
    docs = spark.read.schema(NEWS).json(path, multiLine=True).withColumn("ticker", F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.json)?$", 1))
    rows = docs.select("ticker", F.posexplode("articles").alias("pos", "a"))
    return rows.select("ticker", "pos", "a.title", "a.description", F.col("a.source.name").alias("publisher"), F.to_timestamp("a.publishedAt").alias("published"))
