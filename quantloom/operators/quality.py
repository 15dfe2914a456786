"""Data quality, and conflicts between sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import lexicons as lex
from quantloom.functions.columns import exact_round, ladder


def price_errors(price: Column, date: Column) -> tuple[Column, Column]:
    """Lists of errors and warnings of one price and its date string. NaN and infinity are told before ranges."""
    finite = ~F.isnan(price) & (price != float("inf"))
    bad_date = F.try_to_timestamp(date, F.lit("yyyy-M-d")).isNull()
    errors = F.array_compact(F.array(F.when(price.isNull(), "not numeric"), F.when(~F.isnan(price) & (price < 0.01), "below minimum"), F.when(price.isNotNull() & bad_date, "bad date"), F.when(F.isnan(price), "nan"), F.when(price == float("inf"), "infinite")))
    warnings = F.array_compact(F.array(F.when((finite | (price == float("inf"))) & (price > 1e5) & ~F.isnan(price), "above usual")))
    return errors, warnings


def metric_score(frame: DataFrame, rules: DataFrame) -> DataFrame:
    """``quality`` of ``metric, value``: 100 less 25 beyond either limit, 0 for null, NaN or infinity of a known metric; unknown metrics pass."""
    out = frame.join(rules, "metric", "left")
    v = F.col("value")
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    score = F.when(v.isNull(), 0).when(F.col("low").isNotNull() & odd, 0).otherwise(100 - F.when(v < F.col("low"), 25).otherwise(0) - F.when(v > F.col("high"), 25).otherwise(0))
    return out.withColumn("quality", score).drop("low", "high")


def metric_rules(spark) -> DataFrame:
    return spark.createDataFrame([(k, a, b) for k, (a, b) in lex.METRIC_LIMITS.items()], "metric string, low double, high double")


def anomaly(stats: DataFrame) -> DataFrame:
    """``z, anomaly, severity`` from ``current, n, mean, std`` (population): none with under two values or no spread."""
    z = F.when(F.col("n") >= 2, F.abs(F.col("current") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0)))
    out = stats.withColumn("z", z)
    return out.withColumn("anomaly", F.coalesce(F.col("z") > 2, F.lit(False))).withColumn("severity", ladder("z", (">", 3, "CRITICAL"), (">", 2, "WARNING"), other="NORMAL", missing="NORMAL"))


def stale(as_of: Column, date: Column, most: int = 7) -> Column:
    return F.when(F.datediff(as_of, date) > most, "STALE").otherwise("FRESH")


def price_conflict(values: DataFrame, keys: list[str]) -> DataFrame:
    """Spread over the smallest value of all sources of a key."""
    got = values.groupBy(*keys).agg(F.count("value").alias("sources"), F.min("value").alias("low"), F.max("value").alias("high"))
    out = got.withColumn("spread", F.when(F.col("sources") >= 2, (F.col("high") - F.col("low")) / F.nullif(F.col("low"), F.lit(0.0)) * 100))
    return out.withColumn("severity", ladder("spread", (">", 20, "CRITICAL"), (">", 10, "WARNING"), other="MINOR")).withColumn("conflict", F.coalesce(F.col("spread") > 10, F.lit(False)))


def metric_conflict(values: DataFrame, keys: list[str], official: int | str | None = None) -> DataFrame:
    """Spread over the mean, outliers beyond 15 % of it, and the source recommended for a critical spread: ``official`` where it reports, else the one with the largest value (the smaller name of equals)."""
    got = values.groupBy(*keys).agg(
        F.count("value").alias("sources"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"),
        F.min_by("source", F.struct(-F.col("value"), "source")).alias("largest"), F.bool_or(F.col("source") == F.lit(official)).alias("has"),
    )
    out = got.withColumn("spread", F.coalesce((F.col("high") - F.col("low")) / F.nullif(F.abs("mean"), F.lit(0.0)) * 100, F.lit(0.0)))
    out = out.withColumn("severity", ladder("spread", (">", 20, "CRITICAL"), (">", 10, "WARNING"), other="MINOR"))
    off = F.lit(official)
    out = out.withColumn("recommended", F.when(F.col("severity") == "CRITICAL", F.when(F.col("has"), off).otherwise(F.col("largest"))).when((F.col("severity") == "WARNING") & F.col("has"), off))
    return out.drop("largest", "has")


def outliers(values: DataFrame, means: DataFrame, keys: list[str]) -> DataFrame:
    """Values that deviate from their key's mean by more than 15 %."""
    out = values.join(means.select(*keys, "mean"), keys).withColumn("deviation", F.abs(F.col("value") - F.col("mean")) / F.nullif(F.abs("mean"), F.lit(0.0)) * 100)
    return out.where("deviation > 15").withColumn("deviation", exact_round("deviation"))


def date_conflict(values: DataFrame, keys: list[str]) -> DataFrame:
    got = values.groupBy(*keys).agg(F.datediff(F.max("as_of"), F.min("as_of")).alias("days"))
    return got.withColumn("severity", ladder("days", (">", 90, "CRITICAL"), (">", 30, "WARNING"), other="MINOR")).withColumn("stale", F.coalesce(F.col("days") > 30, F.lit(False)))


def conflict_report(found: DataFrame, keys: list[str]) -> DataFrame:
    """``criticals, warnings, reliability, status`` over rows with ``severity``."""
    out = found.groupBy(*keys).agg(F.count_if(F.col("severity") == "CRITICAL").alias("criticals"), F.count_if(F.col("severity") == "WARNING").alias("warnings"))
    return out.withColumn("reliability", F.greatest(F.lit(0), 100 - 10 * F.col("criticals") - 5 * F.col("warnings"))).withColumn("status", F.when(F.col("criticals") > 0, "ISSUES_FOUND").otherwise("CLEAN"))
