"""News and earnings-call text rules. Words match as substrings, without word boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import lexicons as lex
from quantloom.functions.columns import clamp, exact_round, ladder, phrase_count, phrase_hits


def news_sentiment(text: Column) -> Column:
    low = F.lower(text)
    p, n = phrase_hits(low, lex.NEWS_POSITIVE), phrase_hits(low, lex.NEWS_NEGATIVE)
    return F.when(text.isNull() | (text == ""), 50.0).otherwise(clamp(50.0 + 3.0 * (p - n)))


def news_sentiment_v1(text: Column) -> Column:
    low = F.lower(text)
    p, n = phrase_hits(low, lex.NEWS1_POSITIVE), phrase_hits(low, lex.NEWS1_NEGATIVE)
    return F.coalesce((p - n) / F.nullif(p + n, F.lit(0)), F.lit(0.0))


def news_by_ticker(news: DataFrame) -> DataFrame:
    """``articles, score, signal, confidence`` of each ticker."""
    out = news.groupBy("ticker").agg(F.count("*").alias("articles"), exact_round(F.coalesce(F.avg(news_sentiment(F.col("text"))), F.lit(50.0))).alias("score"))
    return out.withColumn("signal", ladder("score", (">=", 65, "BUY"), ("<=", 40, "SELL"), other="HOLD")).withColumn("confidence", F.when(F.col("articles") > 0, 70).otherwise(40))


def news_by_ticker_v1(news: DataFrame, most: int = 20) -> DataFrame:
    """First variant: the ``most`` first articles by id of each ticker; score and signal from the mean, confidence from their number. Keeps no more than that many ids a group."""
    from pyspark.sql.window import Window

    first = news.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy("doc_id", "text"))).where(F.col("k") <= most)
    out = first.groupBy("ticker").agg(F.count("*").alias("articles"), F.avg(news_sentiment_v1(F.col("text"))).alias("sentiment"))
    s = F.col("sentiment")
    out = out.withColumn("score", exact_round(clamp(F.when((s > 0.5) & (F.col("articles") > 0), 70 + 20 * s).when(s < -0.5, 30 - 20 * F.abs(s)).otherwise(50 + 20 * s))))
    out = out.withColumn("signal", F.when((s > 0.5) & (F.col("articles") > 0), "BUY").when(s < -0.5, "SELL").otherwise("HOLD"))
    return out.withColumn("confidence", F.when(F.col("articles") > 0, F.least(F.lit(100), 5 * F.col("articles"))).otherwise(30))


def call_sentiment(calls: DataFrame) -> DataFrame:
    low = F.lower("text")
    out = calls.withColumn("positive", phrase_count(low, lex.CALL_POSITIVE)).withColumn("negative", phrase_count(low, lex.CALL_NEGATIVE))
    raw = (F.col("positive") - F.col("negative")) / F.nullif(F.col("positive") + F.col("negative"), F.lit(0)) * 100
    out = out.withColumn("_raw", F.coalesce(raw, F.lit(0.0)))
    return out.withColumn("sentiment", exact_round("_raw")).withColumn("signal", ladder("_raw", (">", 30, "VERY_POSITIVE"), (">", 10, "POSITIVE"), ("<", -30, "VERY_NEGATIVE"), ("<", -10, "NEGATIVE"), other="NEUTRAL")).drop("_raw")


def guidance(text: Column) -> Column:
    low = F.lower(text)
    any_of = lambda words: phrase_hits(low, words) > 0
    return F.when(~any_of(lex.GUIDANCE), "NOT_PROVIDED").when(any_of(lex.RAISED), "RAISED").when(any_of(lex.LOWERED), "LOWERED").otherwise("MAINTAINED")


def topics(calls: DataFrame) -> DataFrame:
    """A map of the topics that occur to their number of phrases."""
    low = F.lower("text")
    pairs = F.create_map(*(x for k, v in lex.TOPICS.items() for x in (F.lit(k), phrase_count(low, v))))
    return calls.withColumn("topics", F.map_filter(pairs, lambda k, v: v > 0))
