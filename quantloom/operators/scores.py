"""Rule scores as column functions: technical, fundamental, macro, options, analysts, shorts, sector, calendar, signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import clamp, exact_round, given, ladder

D = F.lit


def safe(x: Column, default: float) -> Column:
    """``default`` in place of null and NaN."""
    return F.coalesce(F.nanvl(x, D(None).cast("double")), D(default))


def rsi_score(rsi: Column) -> Column:
    return ladder(rsi, ("<", 30, 80.0), (">", 70, 20.0), ("<", 50, 40.0), other=60.0)


def macd_score(histogram: Column) -> Column:
    return ladder(histogram, (">", 0, 65.0), ("<", 0, 35.0), other=50.0)


def band_score(price: Column, upper: Column, middle: Column, lower: Column) -> Column:
    known = price.isNotNull() & upper.isNotNull() & lower.isNotNull()
    return F.when(known, F.when(price > upper, 25.0).when(price < lower, 75.0).when(price > middle, 60.0).otherwise(40.0))


def technical(frame: DataFrame, *, least: int = 70) -> DataFrame:
    """Adds ``score``, ``signal``, ``confidence`` from ``rsi, histogram, close, upper, sma, lower, n_rows``; too few rows or a missing part: 50, HOLD, 40."""
    raw = exact_round(0.40 * rsi_score(F.col("rsi")) + 0.35 * macd_score(F.col("histogram")) + 0.25 * band_score(F.col("close"), F.col("upper"), F.col("sma"), F.col("lower")))
    out = frame.withColumn("_raw", F.when(F.col("n_rows") >= least, raw))
    out = out.withColumn("score", F.coalesce("_raw", D(50.0))).withColumn("signal", F.when(F.col("_raw").isNull(), "HOLD").otherwise(buy_sell(F.col("_raw"), 65, 35)))
    return out.withColumn("confidence", F.when(F.col("_raw").isNull(), 40).otherwise(85)).drop("_raw")


def buy_sell(x: Column, buy: float, sell: float) -> Column:
    return ladder(x, (">=", buy, "BUY"), ("<=", sell, "SELL"), other="HOLD")


def technical_v1(frame: DataFrame) -> DataFrame:
    """First variant, from ``rsi, macd, signal_line, atr_pct``: 50 with bonuses; where the score decides nothing, the RSI's signal stays."""
    score = clamp(50.0 + ladder("rsi", ("<", 30, 20.0), (">", 70, -20.0), other=0.0, missing=0.0) + F.when(F.col("macd") > F.col("signal_line"), 15.0).otherwise(-15.0) + ladder("atr_pct", ("<", 2, 10.0), (">", 4, -10.0), other=0.0, missing=0.0))
    by_rsi = ladder("rsi", ("<", 30, "BUY"), (">", 70, "SELL"), other="HOLD", missing="HOLD")
    return frame.withColumn("score", score).withColumn("signal", F.when(F.col("score") >= 65, "BUY").when(F.col("score") <= 35, "SELL").otherwise(by_rsi))


def profit_score(revenue: Column | str) -> Column:
    x = F.col(revenue) if isinstance(revenue, str) else revenue
    return F.when(given(x), ladder(x, (">", 1e9, 80.0), (">", 5e8, 70.0), (">", 2e8, 60.0), other=45.0)).otherwise(50.0)


def leverage_score(x: Column | str) -> Column:
    return ladder(x, ("<", 0.5, 90.0), ("<", 1, 75.0), ("<", 1.5, 60.0), ("<", 2, 45.0), other=30.0, missing=50.0)


def insider_score(x: Column | str) -> Column:
    return ladder(x, (">", 10, 75.0), (">", 5, 65.0), (">", 2, 55.0), other=40.0, missing=50.0)


def fundamental(frame: DataFrame) -> DataFrame:
    """Adds ``profit, leverage, insider, score, signal, confidence`` from ``revenue, de_ratio, insiders``; all missing: 50, HOLD, 20."""
    none = F.col("revenue").isNull() & F.col("de_ratio").isNull() & F.col("insiders").isNull()
    out = frame.withColumn("profit", profit_score("revenue")).withColumn("leverage", leverage_score("de_ratio")).withColumn("insider", insider_score("insiders"))
    out = out.withColumn("score", F.when(none, 50.0).otherwise(exact_round(0.40 * F.col("profit") + 0.35 * F.col("leverage") + 0.25 * F.col("insider"))))
    return out.withColumn("signal", F.when(none, "HOLD").otherwise(buy_sell(F.col("score"), 70, 40))).withColumn("confidence", F.when(none, 20).otherwise(95))


def macro_text(indicator: Column, value: Column) -> Column:
    cases = {
        "CPI": F.when((value > 2) & (value < 4), "Normal").when(value >= 4, "High inflation").otherwise("Low"),
        "UNEMPLOYMENT": ladder(value, ("<", 4.5, "Good"), (">", 5.5, "Rising"), other="Moderate"),
        "FED_RATE": F.format_string("Current rate: %.2f%%", value),
        "T10Y2Y": ladder(value, ("<", 0, "INVERTED"), ("<", 0.5, "FLAT"), other="NORMAL"),
        "VIX": ladder(value, ("<", 15, "Low volatility"), ("<", 25, "Moderate"), other="High fear"),
    }
    out = F.when(value.isNull(), F.lit(None))
    for name, text in cases.items():
        out = out.when(indicator == name, text)
    return out.otherwise("")


def options(frame: DataFrame) -> DataFrame:
    """``score, sentiment, iv_signal, bias`` from ``put_call, iv_percentile``; 0 counts as missing."""
    pc, iv = F.when(given("put_call"), F.col("put_call")), F.when(given("iv_percentile"), F.col("iv_percentile"))
    score = clamp(50.0 + ladder(pc, (">", 1.2, -20.0), ("<", 0.8, 20.0), other=0.0, missing=0.0) + ladder(iv, (">", 80, 15.0), ("<", 20, -10.0), other=0.0, missing=0.0))
    out = frame.withColumn("score", score).withColumn("sentiment", ladder(pc, (">", 1.2, "BEARISH"), ("<", 0.8, "BULLISH"), other="NEUTRAL"))
    return out.withColumn("iv_signal", ladder(iv, (">", 80, "HIGH"), ("<", 20, "LOW"), other="NORMAL")).withColumn("bias", ladder("score", (">", 60, "BULLISH_BIAS"), ("<", 40, "BEARISH_BIAS"), other="NEUTRAL"))


def analysts(frame: DataFrame) -> DataFrame:
    """``score, signal, components`` (a map of what moved the score) from ``buy_pct, sell_pct, upside, trend``; 0 counts as missing."""
    buy, up = F.when(given("buy_pct"), F.col("buy_pct")), F.when(given("upside"), F.col("upside"))
    total = 50.0 + ladder(buy, (">", 70, 40.0), (">", 50, 30.0), other=-15.0, missing=0.0) + F.when(F.col("buy_pct").isNotNull() & (F.col("sell_pct") > 30), -30.0).otherwise(0.0)
    total = total + ladder(up, (">", 20, 20.0), (">", 10, 10.0), ("<", -10, -20.0), other=0.0, missing=0.0) + F.when(F.col("trend") == "UPGRADING", 15.0).when(F.col("trend") == "DOWNGRADING", -15.0).otherwise(0.0)
    parts = {
        "buy_pct": ladder(buy, (">", 70, "VERY_BULLISH_CONSENSUS"), (">", 50, "BULLISH_CONSENSUS"), other="MIXED_CONSENSUS", missing=None),
        "sell_pct": F.when(F.col("sell_pct") > 30, "BEARISH_CONSENSUS"),
        "upside": ladder(up, (">", 20, "HIGH_UPSIDE"), (">", 10, "MODERATE_UPSIDE"), ("<", -10, "DOWNSIDE_RISK"), other=None, missing=None),
        "trend": F.when(F.col("trend") == "UPGRADING", "POSITIVE_MOMENTUM").when(F.col("trend") == "DOWNGRADING", "NEGATIVE_MOMENTUM"),
    }
    named = F.map_filter(F.create_map(*(x for k, v in parts.items() for x in (F.lit(k), v.cast("string")))), lambda k, v: v.isNotNull())
    return frame.withColumn("score", clamp(total)).withColumn("components", named).withColumn("signal", ladder("score", (">", 65, "STRONG_BUY"), (">", 55, "BUY"), ("<", 35, "SELL"), ("<", 45, "REDUCE"), other="HOLD"))


def short_squeeze(frame: DataFrame) -> DataFrame:
    """``risk_score, signal, factors`` (in the order of evaluation) from ``short_pct, days_to_cover, momentum``."""
    si, dtc, mom = F.col("short_pct"), F.col("days_to_cover"), F.col("momentum")
    total = ladder(si, (">", 25, 40), (">", 15, 30), (">", 10, 20), other=10, missing=0) + ladder(dtc, ("<", 1, 10), ("<", 3, 20), ("<", 7, 30), other=40, missing=0) + ladder(mom, (">", 10, 20), (">", 5, 10), other=0, missing=0)
    names = F.array_compact(F.array(
        ladder(si, (">", 25, "VERY_HIGH_SHORT_INTEREST"), (">", 15, "HIGH_SHORT_INTEREST"), (">", 10, "MODERATE_SHORT_INTEREST"), other="LOW_SHORT_INTEREST"),
        ladder(dtc, ("<", 1, "VERY_EASY_COVER"), ("<", 3, "EASY_COVER"), ("<", 7, "MODERATE_COVER_TIME"), other="DIFFICULT_COVER"),
        ladder(mom, (">", 10, "STRONG_UPWARD_MOMENTUM"), (">", 5, "MODERATE_UPWARD_MOMENTUM")),
    ))
    out = frame.withColumn("risk_score", total).withColumn("factors", names)
    return out.withColumn("signal", ladder("risk_score", (">=", 70, "HIGH_SQUEEZE_RISK"), (">=", 40, "MODERATE_SQUEEZE_RISK"), other="LOW_SQUEEZE_RISK"))


def peer_valuation(quotes: DataFrame) -> DataFrame:
    """Adds ``peer_pe`` (mean of the other positive ones of the sector), ``premium`` and ``valuation``. Sums by sector, not pairs."""
    sector = quotes.where("trailing_pe > 0").groupBy("sector").agg(F.sum("trailing_pe").alias("_s"), F.count("*").alias("_n"))
    out = quotes.join(sector, "sector", "left")
    mine = F.when(F.col("trailing_pe") > 0, 1).otherwise(0)
    peers = F.col("_n") - mine
    out = out.withColumn("peer_pe", F.when(peers > 0, (F.col("_s") - F.when(mine == 1, F.col("trailing_pe")).otherwise(0.0)) / peers))
    out = out.withColumn("premium", (F.col("trailing_pe") / F.nullif(F.col("peer_pe"), D(0.0)) - 1) * 100)
    return out.withColumn("valuation", ladder("premium", ("<", -15, "UNDERVALUED"), ("<", -5, "SLIGHT_DISCOUNT"), ("<", 5, "FAIRLY_VALUED"), ("<", 15, "SLIGHT_PREMIUM"), other="EXPENSIVE")).drop("_s", "_n")


def attractiveness(frame: DataFrame) -> DataFrame:
    """``attract_score, attract_signal`` from ``premium, profit_margin``."""
    score = clamp(50.0 + ladder("premium", ("<", -15, 25.0), ("<", 0, 12.0), ("<", 15, -12.0), other=-25.0, missing=0.0) + ladder("profit_margin", (">", 0, 15.0), ("<", 0, -15.0), other=0.0, missing=0.0))
    return frame.withColumn("attract_score", score).withColumn("attract_signal", ladder("attract_score", (">", 65, "ATTRACTIVE"), (">", 50, "NEUTRAL"), other="LESS_ATTRACTIVE"))


def combined(tech: Column, fund: Column, news: Column) -> Column:
    return exact_round(0.25 * tech + 0.50 * fund + 0.25 * news)


def agreement(tech: Column, fund: Column, news: Column) -> Column:
    spread = F.greatest(tech, fund, news) - F.least(tech, fund, news)
    strength = F.least(D(100.0), F.abs(combined(tech, fund, news) - 50.0) / 50.0 * 100.0)
    return exact_round(clamp(0.6 * F.greatest(D(0.0), 100.0 - spread) + 0.4 * strength))


def signal(frame: DataFrame) -> DataFrame:
    """``combined, signal, agreement`` from ``tech, fund, news``; a missing module counts 50."""
    t, f, n = (F.coalesce(F.col(c), D(50.0)) for c in ("tech", "fund", "news"))
    return frame.withColumn("combined", combined(t, f, n)).withColumn("signal", buy_sell(F.col("combined"), 65, 40)).withColumn("agreement", agreement(t, f, n))


def signal_v3(frame: DataFrame) -> DataFrame:
    """Weights 25, 55, 10, 10 of ``tech, fund, reliability, confidence``; votes of the three signals for the final one."""
    out = frame.withColumn("combined", exact_round(0.25 * F.col("tech") + 0.55 * F.col("fund") + 0.10 * F.col("reliability") + 0.10 * F.col("confidence"))).withColumn("signal", buy_sell(F.col("combined"), 68, 35))
    votes = F.size(F.filter(F.array("tech_signal", "fund_signal", "news_signal"), lambda x: x == F.col("signal")))
    return out.withColumn("confidence_pct", exact_round(votes / 3.0 * 100))


def freshness(hours: Column | str) -> Column:
    return ladder(hours, ("<", 24, 95.0), ("<", 72, 80.0), ("<", 168, 60.0), other=30.0, missing=50.0)


def signal_conflict(*signals: str) -> Column:
    n = F.size(F.array_distinct(F.array(*signals)))
    return F.when(n <= 1, 100.0).when(n == 2, 70.0).otherwise(40.0)


def reliability(fresh: Column, conflict: Column) -> Column:
    return exact_round(0.40 * fresh + 0.35 * conflict + D(25.0))


def accuracy_score(x: Column | str) -> Column:
    return ladder(x, (">=", 65, 90.0), (">=", 55, 75.0), (">=", 45, 60.0), (">=", 35, 45.0), other=30.0, missing=60.0)


def confidence(accuracy: Column, quality: Column) -> Column:
    return exact_round(0.65 * accuracy_score(accuracy) + 0.35 * quality)


def confidence_level(x: Column | str) -> Column:
    return ladder(x, (">=", 70, "HIGH"), (">=", 50, "MEDIUM"), other="LOW")


def threshold_score(win: Column, sharpe: Column, drawdown: Column) -> Column:
    return 0.40 * F.coalesce(win, D(50.0)) + 30.0 * F.coalesce(sharpe, D(0.0)) + 0.5 * F.greatest(D(0.0), 20.0 - F.coalesce(drawdown, D(20.0)))


def holding_score(win: Column, sharpe: Column, drawdown: Column) -> Column:
    return 0.50 * F.coalesce(win, D(50.0)) + 30.0 * F.coalesce(sharpe, D(0.0)) - 0.5 * F.coalesce(drawdown, D(0.0))


def best_param(grid: DataFrame, score: Column, default: float) -> DataFrame:
    """``param``, ``score`` of the first best row by ``ordinal``; an empty grid gives the default."""
    top = grid.agg(F.max_by(F.struct("param", score.alias("score")), F.struct(score, -F.col("ordinal"))).alias("b"))
    return top.select(F.coalesce("b.param", D(default)).alias("param"), F.col("b.score").alias("score"))


def normalised_weights(weights: DataFrame) -> DataFrame:
    """``source, weight``: unchanged where they sum to 1 within 0.01, else divided by their sum."""
    total = weights.agg(F.sum("weight").alias("total"))
    return weights.join(total).select("source", F.when(F.abs(F.col("total") - 1) < 0.01, F.col("weight")).otherwise(F.col("weight") / F.nullif(F.col("total"), D(0.0))).alias("weight"))


def readiness(frame: DataFrame) -> DataFrame:
    """``readiness, ready`` from ``threshold_score, holding_score, win_rate, max_drawdown``."""
    dd = F.abs("max_drawdown")
    total = F.when(F.col("threshold_score") > 50, 25).otherwise(10) + F.when(F.col("holding_score") > 50, 25).otherwise(10) + ladder("win_rate", (">", 65, 25), (">", 55, 15), other=5, missing=5) + ladder(dd, ("<", 15, 25), ("<", 25, 15), other=5, missing=25)
    notes = F.array_compact(F.array(F.when(~(F.col("threshold_score") > 50), "threshold"), F.when(~(F.col("holding_score") > 50), "holding"), F.when(~(F.col("win_rate") > 55), "win rate"), F.when(~(dd < 25), "drawdown")))
    return frame.withColumn("readiness", total).withColumn("ready", F.col("readiness") > 70).withColumn("notes", F.concat_ws("|", notes))
