"""Queries of single steps: each applies one operator of the larger plans by itself, beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.functions import columns
from quantloom.functions import lexicons as lex
from quantloom.functions.columns import clamp, rounded
from quantloom.operators import backtest, indicators, quality, relative, scores, text
from quantloom.plans import queries as q
from quantloom.plans.analyze import analyze, full_analysis
from quantloom.plans.queries import COMBINED, EVAL, FOLDS, FUND, METRICS, NEWS, ORACLE, PLACEHOLDERS, QUERIES, REL, SPLIT, SV, TECH, WALK, B, Query, W, exact, q6, query, r6
from quantloom.sources import schemas, sinks, tables

SQL_DAY = "CAST(bar_date AS VARCHAR) AS bar_date"


def _day() -> Column:
    return F.col("bar_date").cast("string").alias("bar_date")


def named(name: str, sql: str, f: Query) -> None:
    QUERIES[name], ORACLE[name] = f, exact(sql)


# Scans


@query(q._history(730, 1))
def src_prices_period(spark, sf_dir):
    return q._recent(spark, sf_dir, 730, 1)


@query(f"WITH {B}, d AS (SELECT * FROM (VALUES (90), (365), (252)) t(days)) SELECT ticker, days, count(*) AS n, CAST(min(bar_date) AS VARCHAR) AS first, CAST(max(bar_date) AS VARCHAR) AS last FROM bars JOIN d ON bar_date >= (SELECT max(bar_date) FROM bars) - days GROUP BY 1, 2")
def src_rel(spark, sf_dir):
    """The three calendar windows of the relative measures, from one scan."""
    prices = q._bars(spark, sf_dir)
    age = F.datediff(F.lit(tables.as_of(spark, sf_dir)), F.col("bar_date"))
    spans = F.explode(F.filter(F.array(F.lit(90), F.lit(365), F.lit(252)), lambda d: d >= age)).alias("days")
    return prices.where(age <= 365).select("ticker", "bar_date", spans).groupBy("ticker", "days").agg(F.count("*").alias("n"), F.min("bar_date").cast("string").alias("first"), F.max("bar_date").cast("string").alias("last"))


@query("SELECT user_id AS ticker, event_id, CASE event_type WHEN 'purchase' THEN '4' WHEN 'view' THEN '10-Q' WHEN 'click' THEN '10-K' ELSE '8-K' END AS form, CAST(CAST(ts AS DATE) AS VARCHAR) AS filed FROM events")
def src_filings(spark, sf_dir):
    """Filings as JSON records, parsed with a schema (``schemas.filings_json`` reads the provider's documents)."""
    rows = tables.filings(spark, sf_dir)
    raw = rows.select("ticker", "event_id", F.to_json(F.struct("form", F.col("filed").alias("filingDate"))).alias("j"))
    parsed = raw.withColumn("p", F.from_json("j", "form string, filingDate string"))
    return parsed.select("ticker", "event_id", F.col("p.form").alias("form"), F.col("p.filingDate").alias("filed"))


@query("SELECT source AS ticker, doc_id, CAST(length(text) AS INTEGER) AS chars FROM documents")
def src_news(spark, sf_dir):
    return tables.news(spark, sf_dir).select("ticker", "doc_id", F.length("text").alias("chars"))


@query("SELECT user_id AS ticker, event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS published FROM events WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) FROM events) - 7")
def src_news_7d(spark, sf_dir):
    """Items of the last seven days; events play the dated items."""
    e = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), "event_id", F.to_date("ts").alias("d"))
    return e.where(F.col("d") >= F.date_sub(F.lit(tables.latest_date(e, "d")), 7)).select("ticker", "event_id", F.col("d").cast("string").alias("published"))


def _placeholder(item: str) -> None:
    def f(spark, sf_dir):
        return QUERIES["src_placeholders"](spark, sf_dir).where(F.col("item") == item).drop("item")

    named(item, "SELECT n_name AS ticker, CAST(NULL AS DOUBLE) AS value, 'UNAVAILABLE' AS status FROM nation", f)


for _item in PLACEHOLDERS:
    _placeholder(_item)


_columns = [(t, f.name, f.dataType.simpleString()) for t in schemas.DDL for f in schemas.schema(t)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _columns) + ") t(table_name, column_name, data_type)")
def ddl(spark, sf_dir):
    """Columns of all tables, from empty frames of their schemas."""
    found = [(t, f.name, f.dataType.simpleString()) for t in schemas.DDL for f in spark.createDataFrame([], schemas.schema(t)).schema]
    return spark.createDataFrame(found, "table_name string, column_name string, data_type string")


@query("SELECT * FROM (VALUES ('horizons', '1,5,20,60'), ('threshold', '60'), ('holding', '5'), ('data_length', '252'), ('train_pct', '0.7')) t(parameter, value)")
def constructors(spark, sf_dir):
    """Defaults of the keyword parameters, read from the operators' signatures."""
    h, w = backtest.horizons.__defaults__, backtest.walk_windows.__defaults__
    grid = spark.createDataFrame([], "param double, ordinal int, score double")
    best = [int(scores.best_param(grid, F.col("score"), x).first()["param"]) for x in (60.0, 5.0)]
    got = [("horizons", ",".join(map(str, h[0]))), ("threshold", str(best[0])), ("holding", str(best[1])), ("data_length", str(w[0])), ("train_pct", str(w[1]))]
    return spark.createDataFrame(got, "parameter string, value string")


# Filters and row rules


@query(f"WITH {B}, h AS (SELECT * FROM bars WHERE bar_date >= (SELECT max(bar_date) FROM bars) - 180) SELECT ticker, count(*) AS n_rows, CASE WHEN count(*) < 70 THEN 50 END AS score, CASE WHEN count(*) < 70 THEN 'HOLD' END AS signal, CASE WHEN count(*) < 70 THEN 40 END AS confidence FROM h GROUP BY 1")
def min_rows_guard(spark, sf_dir):
    """The default result of tickers with under 70 rows; null where the rules decide."""
    prices = q._bars(spark, sf_dir)
    n = tables.history(prices, tables.as_of(spark, sf_dir), 180).groupBy("ticker").agg(F.count("*").alias("n_rows"))
    short = F.col("n_rows") < 70
    return n.select("ticker", "n_rows", F.when(short, 50).alias("score"), F.when(short, "HOLD").alias("signal"), F.when(short, 40).alias("confidence"))


@query("WITH r AS (SELECT user_id AS ticker, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS pos FROM events) SELECT ticker, event_id, CAST(pos AS INTEGER) AS pos FROM r WHERE pos <= 10")
def head_n(spark, sf_dir):
    """The ten newest filings of each company: a group-limited window, so that no list of all is built."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return tables.table(spark, sf_dir, "events").withColumn("pos", F.row_number().over(w)).where("pos <= 10").select(F.col("user_id").alias("ticker"), "event_id", "pos")


MOVES = f"{B}, mv AS (SELECT *, CASE WHEN count(close) OVER w = 20 THEN (close / avg(close) OVER w - 1) * 100 END AS momentum, lead(close, 5) OVER {W}) / close - 1 AS fwd FROM bars WINDOW w AS {W} ROWS 19 PRECEDING))"


def _moves(spark, sf_dir) -> DataFrame:
    return indicators.momentum(indicators.forward_return(q._bars(spark, sf_dir), 5))


@query(f"WITH {MOVES} SELECT ticker, {SQL_DAY}, {q6('momentum', 'fwd')} FROM mv WHERE momentum IS NOT NULL AND fwd IS NOT NULL")
def dropna_any(spark, sf_dir):
    return _moves(spark, sf_dir).select("ticker", _day(), *r6("momentum", "fwd")).na.drop("any")


@query(f"WITH {MOVES} SELECT ticker, {SQL_DAY}, CASE WHEN momentum < -2 THEN 'SELL' WHEN momentum > 2 THEN 'BUY' ELSE 'HOLD' END AS signal FROM mv")
def mask_assign(spark, sf_dir):
    """Later assignments win: the last condition is tested first."""
    m = F.col("momentum")
    return _moves(spark, sf_dir).select("ticker", _day(), F.when(m < -2, "SELL").when(m > 2, "BUY").otherwise("HOLD").alias("signal"))


@query(f"WITH {SPLIT}, k AS (SELECT *, row_number() OVER {q.WS}) AS p, count(*) OVER (PARTITION BY ticker, split) AS m FROM sp) SELECT ticker, {SQL_DAY} FROM k WHERE split = 'test' AND p <= m - 5")
def tail_trim(spark, sf_dir):
    """Test rows without the last five."""
    return backtest.split(q._bars(spark, sf_dir)).where((F.col("split") == "test") & (F.col("rn") <= F.col("n") - 5)).select("ticker", _day())


@query(f"WITH {SPLIT} SELECT ticker, {SQL_DAY}, split FROM sp")
def positional_split(spark, sf_dir):
    return backtest.split(q._bars(spark, sf_dir)).select("ticker", _day(), "split")


@query("SELECT o_orderkey, greatest(0.0::DOUBLE, least(100.0::DOUBLE, o_totalprice / 1000 - 50)) AS score FROM orders")
def _clamp(spark, sf_dir):
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", clamp(F.col("o_totalprice") / 1000 - 50).alias("score"))


for _d in (QUERIES, ORACLE):
    _d["clamp"] = _d.pop("_clamp")


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 50.0::DOUBLE WHEN 1 THEN NULL ELSE s_acctbal END AS value FROM supplier")
def null_default(spark, sf_dir):
    """A map's default is for a missing key; an entry that is null stays null."""
    k = F.col("s_suppkey") % 3
    m = F.when(k == 0, F.expr("map('other', s_acctbal)")).when(k == 1, F.expr("map('tech', cast(null as double))")).otherwise(F.expr("map('tech', s_acctbal)"))
    return tables.table(spark, sf_dir, "supplier").select("s_suppkey", m.alias("m")).select("s_suppkey", F.when(F.map_contains_key("m", F.lit("tech")), F.try_element_at("m", F.lit("tech"))).otherwise(50.0).alias("value"))


@query(f"WITH {B}, h AS (SELECT ticker, close, row_number() OVER {W}) AS rn FROM bars) SELECT ticker, count(*) AS n, floor(sum(close) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS total FROM h WHERE rn <= 176 GROUP BY 1")
def _slice(spark, sf_dir):
    """The first part of a walk window by position."""
    first = backtest.numbered(q._bars(spark, sf_dir)).where(F.col("rn") <= int(252 * 0.7))
    return first.groupBy("ticker").agg(F.count("*").alias("n"), rounded(F.sum("close"), 6).alias("total"))


for _d in (QUERIES, ORACLE):
    _d["slice"] = _d.pop("_slice")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 3 WHEN 2 THEN l_extendedprice ELSE 100.0::DOUBLE END AS close FROM lineitem")
def safe_float(spark, sf_dir):
    """Null and NaN give the default."""
    n = F.col("l_linenumber") % 3
    v = F.when(n == 0, F.lit(None)).when(n == 1, float("nan")).otherwise(F.col("l_extendedprice"))
    return tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scores.safe(v, 100.0).alias("close"))


# Joins


@query(f"WITH {B}, etf AS (SELECT sector, bar_date, avg(close) AS etf_close FROM bars GROUP BY 1, 2) SELECT ticker, CASE WHEN sector IN (0, 1, 2) THEN 'ETF' || sector ELSE 'XLK' END AS etf, {SQL_DAY}, {q6('etf_close')} FROM (SELECT b.ticker, b.sector, b.bar_date, e.etf_close FROM bars b JOIN etf e ON e.bar_date = b.bar_date AND e.sector = CASE WHEN b.sector IN (0, 1, 2) THEN b.sector ELSE 0 END)")
def join_sector_etf(spark, sf_dir):
    """Each bar with its sector's fund; sectors without one fall back to the default fund."""
    prices = q._sectors(spark, sf_dir)
    etf = relative.market(prices, "sector").select(F.col("sector").alias("at"), "bar_date", F.col("close").alias("etf_close"))
    funds = spark.createDataFrame([(0, "ETF0"), (1, "ETF1"), (2, "ETF2")], "sector int, etf string")
    out = prices.join(funds, "sector", "left").withColumn("at", F.when(F.col("etf").isNull(), 0).otherwise(F.col("sector")))
    return out.join(etf, ["at", "bar_date"]).select("ticker", F.coalesce("etf", F.lit("XLK")).alias("etf"), _day(), *r6("etf_close"))


@query(f"WITH {B}, m AS (SELECT bar_date, close / lag(close) OVER (ORDER BY bar_date) - 1 AS m FROM (SELECT bar_date, avg(close) AS close FROM bars GROUP BY 1)), x AS (SELECT ticker, bar_date, close / lag(close) OVER {W}) - 1 AS r FROM bars) SELECT ticker, {SQL_DAY}, {q6('r', 'm')} FROM x JOIN m USING (bar_date) WHERE r IS NOT NULL AND m IS NOT NULL")
def join_market(spark, sf_dir):
    """Returns of each ticker beside the market's of the same day."""
    return relative.with_market(q._bars(spark, sf_dir)).select("ticker", _day(), *r6("r", "m"))


@query(f"WITH {q.PEERS} SELECT ticker, (SELECT count(*) FROM q p WHERE p.sector = x.sector AND p.ticker <> x.ticker AND p.trailing_pe > 0) AS peers, floor(peer_pe * 1000 + 0.5::DOUBLE) / 1000 AS peer_pe FROM x")
def join_peers(spark, sf_dir):
    """The other tickers of the sector with a positive ratio: sums by sector less the own value, not pairs."""
    quotes = tables.quotes(spark, sf_dir)
    n = quotes.where("trailing_pe > 0").groupBy("sector").agg(F.count("*").alias("n"))
    out = scores.peer_valuation(quotes).join(n, "sector", "left")
    return out.select("ticker", (F.coalesce("n", F.lit(0)) - F.when(F.col("trailing_pe") > 0, 1).otherwise(0)).alias("peers"), rounded("peer_pe", 3).alias("peer_pe"))


@query(f"{COMBINED} SELECT ticker, tech, fund, news FROM cs")
def join_modules(spark, sf_dir):
    return analyze(spark, sf_dir).select("ticker", *(F.coalesce(c, F.lit(50.0)).alias(c) for c in ("tech", "fund", "news")))


@query(f"{COMBINED}, mc AS (SELECT indicator, arg_max(v, d) AS value FROM (SELECT o_orderpriority AS indicator, date_trunc('month', o_orderdate) AS d, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2) GROUP BY 1) SELECT ticker, indicator, floor(value * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS value FROM sg, mc")
def cross_macro(spark, sf_dir):
    """The one macro row, a map, beside every ticker."""
    return analyze(spark, sf_dir).select("ticker", F.explode("macro").alias("indicator", "v")).select("ticker", "indicator", rounded("v", 6).alias("value"))


@query(f"WITH {q._trained(0)}, b AS (SELECT ev.ticker, ev.bar_date, th.hi AS upper, th.lo AS lower FROM ev JOIN th USING (ticker)) SELECT ticker, {SQL_DAY}, {q6('upper', 'lower')} FROM b")
def join_train_stats(spark, sf_dir):
    """Bounds from the train rows beside each test row, by window over the ticker."""
    return backtest.trained(q._bars(spark, sf_dir)).select("ticker", _day(), rounded("high", 6).alias("upper"), rounded("low", 6).alias("lower"))


@query("WITH e AS (SELECT user_id AS ticker, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_type FROM events) SELECT DISTINCT ticker, date FROM e WHERE event_type <> 'view' AND NOT EXISTS (SELECT 1 FROM e o WHERE o.event_type = 'view' AND o.ticker = e.ticker AND o.date = e.date)")
def anti_existing(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), F.to_date("ts").cast("string").alias("date"), "event_type")
    keys = ["ticker", "date"]
    return e.where("event_type <> 'view'").select(*keys).distinct().join(e.where("event_type = 'view'").select(*keys), keys, "left_anti")


@query(f"WITH {METRICS} SELECT o_orderkey, m.metric, low, high FROM m LEFT JOIN l ON m.metric = l.metric")
def join_rules(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, "eps").when(k % 4 == 1, "pe_ratio").when(k % 4 == 2, "inflation").otherwise("unknown")
    return tables.table(spark, sf_dir, "orders").select(k, name.alias("metric")).join(quality.metric_rules(spark), "metric", "left").select("o_orderkey", "metric", "low", "high")


# Scalar functions


@query("SELECT doc_id, coalesce(lang, 'None') || ' ' || coalesce(source, 'None') AS said, substring(text, 1, 80) AS shown FROM documents")
def fn_text(spark, sf_dir):
    """A text made of two fields, a null one told as None, and the first 80 characters of another for display."""
    d = tables.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws(" ", columns.told("lang"), columns.told("source")).alias("said"), F.substring("text", 1, 80).alias("shown"))


@query("SELECT o_orderkey, o_totalprice, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS thousands, printf('%.2f', CAST(o_orderkey AS DOUBLE)) AS fixed FROM orders")
def fn_number_format(spark, sf_dir):
    """Whole numbers with thousands separators, and two decimals."""
    whole = F.format_number(F.floor("o_totalprice"), 0)
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", whole.alias("thousands"), F.format_string("%.2f", F.col("o_orderkey").cast("double")).alias("fixed"))


@query("""WITH e AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS t FROM events), a AS (SELECT event_id, t, (epoch_us((SELECT max(t) FROM e)) - epoch_us(t)) / 3600000000::DOUBLE AS hours FROM e)
SELECT event_id, strftime(t, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(t, '%Y%m%d_%H%M%S') AS stamp, hours, CASE WHEN hours < 24 THEN 95 WHEN hours < 72 THEN 80 WHEN hours < 168 THEN 60 ELSE 30 END AS fresh FROM a""")
def fn_age(spark, sf_dir):
    """When each event was, as ISO text and as a file stamp, its age in hours at the newest event and what that is worth."""
    e = tables.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    aged = e.withColumn("hours", columns.age_hours("at", e.agg(F.unix_micros(F.max("at"))).first()[0]))
    iso = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss")
    return aged.select("event_id", iso.alias("iso"), F.date_format("at", "yyyyMMdd_HHmmss").alias("stamp"), "hours", scores.freshness("hours").alias("fresh"))


# Aggregates


def _column_of(name: str, source: str, key: str, *columns: str) -> None:
    """One step of a wider query: its rows with the columns of this step only; its SQL selects the same of the wider SQL."""
    listed = ", ".join((key, *columns))

    def f(spark, sf_dir):
        return QUERIES[source](spark, sf_dir).select(*listed.split(", "))

    QUERIES[name], ORACLE[name] = f, f"SELECT {listed} FROM ({ORACLE[source]}) whole"


for _step in (
    ("agg_accuracy", "bt_metrics", "ticker", "accuracy"), ("agg_win_rate", "bt_metrics", "ticker", "win_rate"), ("agg_total", "bt_metrics", "ticker", "total_return"),
    ("agg_max_dd", "bt_metrics", "ticker", "worst"), ("agg_sharpe", "bt_metrics", "ticker", "sharpe"), ("agg_count", "bt_metrics", "ticker", "periods"),
    ("agg_p_up", "pred_horizons", "ticker, horizon", "p_up"), ("agg_e_ret", "pred_horizons", "ticker, horizon", "e_ret"), ("agg_cov_beta", "rs_beta", "ticker", "beta"),
    ("agg_peer_mean", "sector_pe", "ticker", "peer_pe"), ("agg_pop_std", "dq_anomaly", "ticker", "mean", "std"), ("win_frame_all", "dq_anomaly", "ticker", "z"),
    ("agg_severity_counts", "cf_report", "ticker", "criticals", "warnings"), ("agg_weights", "cal_weights", "source", "weight"),
    ("agg_wf", "wf_run", "ticker", "in_sample", "out_sample", "spread", "stability"), ("wf_assess", "wf_run", "ticker", "confidence", "verdict"),
    ("win_sma20", "win_bollinger", "ticker, bar_date", "sma"), ("win_std20", "win_bollinger", "ticker, bar_date", "std"), ("win_ema", "win_macd", "ticker", "ema_fast", "ema_slow"),
    ("win_diff", "win_returns", "ticker, bar_date", "diff"), ("win_pct_change", "win_returns", "ticker, bar_date", "pct"), ("win_walk", "wf_split", "ticker, window_num, part", "rows"),
    ("fund_profit", "fund_composite", "ticker", "profit"), ("fund_leverage", "fund_composite", "ticker", "leverage"), ("fund_insider", "fund_composite", "ticker", "insider"),
    ("fund_signal", "fund_composite", "ticker", "score", "signal", "confidence"), ("news_result", "news_agg", "ticker", "articles", "score", "signal", "confidence"),
    ("news_signal", "news_agg", "ticker", "score", "signal"), ("news_v1_signal", "news_v1", "ticker", "score", "signal"), ("sig_combine", "sig_result", "ticker", "combined"),
    ("sig_final", "sig_result", "ticker", "signal"), ("sig_agreement", "sig_result", "ticker", "agreement"), ("rel_freshness", "rel_score", "s_suppkey", "fresh"), ("rel_conflict", "rel_score", "s_suppkey", "conflict"),
    ("sec_revenue", "fund_fetch", "ticker", "revenue"),
):
    _column_of(*_step)


@query(f"WITH {SV} SELECT metric, floor(max(value) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS high, floor(min(value) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS low, arg_max(source, row(value, source)) AS high_source, arg_min(source, row(value, source)) AS low_source FROM sv GROUP BY 1")
def agg_minmax(spark, sf_dir):
    at = F.struct("value", "source")
    got = tables.source_values(spark, sf_dir).groupBy("metric").agg(F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("source", at).alias("high_source"), F.min_by("source", at).alias("low_source"))
    return got.select("metric", *r6("high", "low"), "high_source", "low_source")


@query(f"WITH {SV} SELECT metric, arg_min(source, row(-value, source)) AS source FROM sv GROUP BY 1")
def argmax(spark, sf_dir):
    """The source of the largest value, of equals the first."""
    return tables.source_values(spark, sf_dir).groupBy("metric").agg(F.min_by("source", F.struct(-F.col("value"), "source")).alias("source"))


@query(f"WITH {REL} SELECT s_suppkey, CAST(len(list_distinct([a, b, c])) AS INTEGER) AS signals FROM re")
def agg_set_size(spark, sf_dir):
    return q._trust(spark, sf_dir).select("s_suppkey", F.size(F.array_distinct(F.array("tech_signal", "fund_signal", "news_signal"))).alias("signals"))


@query(f"WITH {REL} SELECT s_suppkey, CAST(a = signal AS INTEGER) + CAST(b = signal AS INTEGER) + CAST(c = signal AS INTEGER) AS votes FROM vs")
def agg_vote(spark, sf_dir):
    out = scores.signal_v3(q._trust(spark, sf_dir))
    return out.select("s_suppkey", F.size(F.filter(F.array("tech_signal", "fund_signal", "news_signal"), lambda x: x == F.col("signal"))).alias("votes"))


@query(f"WITH {REL} SELECT s_suppkey, base FROM rf")
def conf_map(spark, sf_dir):
    return q._trust(spark, sf_dir).select("s_suppkey", scores.accuracy_score("fund").alias("base"))


@query(f"WITH {NEWS} SELECT n_name AS ticker, floor(coalesce(avg(s), 50) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS sentiment FROM nation LEFT JOIN ns ON ns.ticker = replace(n_name, 'NATION_', 'src') GROUP BY 1")
def agg_article_mean(spark, sf_dir):
    """The mean sentiment of each ticker, 50 with no article; aggregated before it meets the tickers."""
    mean = tables.news(spark, sf_dir).groupBy("ticker").agg(F.avg(text.news_sentiment(F.col("text"))).alias("s"))
    nation = tables.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    out = nation.join(mean, F.regexp_replace("name", "^NATION_", "src") == F.col("ticker"), "left")
    return out.select(F.col("name").alias("ticker"), rounded(F.coalesce("s", F.lit(50.0)), 6).alias("sentiment"))


@query(f"""WITH p AS (SELECT l_suppkey, {q.PRICE_CASES} AS v, l_partkey % 9 = 0 AS odd FROM lineitem)
SELECT l_suppkey, CAST(sum(CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 1 ELSE 0 END + CASE WHEN NOT isnan(v) AND v < 0.01::DOUBLE THEN 1 ELSE 0 END + CASE WHEN v IS NOT NULL AND odd THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(CASE WHEN NOT isnan(v) AND v > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS warnings FROM p GROUP BY 1""")
def agg_errors(spark, sf_dir):
    """Sums of the lengths of the error and warning lists."""
    nth = F.col("l_linenumber") % 7
    v = F.when(nth == 0, F.lit(None)).when(nth == 1, float("nan")).when(nth == 2, float("inf")).when(nth == 3, 0.001).otherwise(F.col("l_extendedprice") * 2)
    d = F.when(F.col("l_partkey") % 9 == 0, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    errors, warnings = quality.price_errors(F.col("v"), F.col("d"))
    p = tables.table(spark, sf_dir, "lineitem").select("l_suppkey", v.alias("v"), d.alias("d"))
    return p.groupBy("l_suppkey").agg(F.sum(F.size(errors)).alias("errors"), F.sum(F.size(warnings)).alias("warnings"))


@query(f"WITH {q.GRID} SELECT coalesce(arg_max(param, row(win, -ordinal)), 60) AS param FROM gr")
def agg_argmax(spark, sf_dir):
    """The best parameter; of equals the first in order."""
    return scores.best_param(q._grid(spark, sf_dir), F.col("win"), 60.0).select("param")


@query("WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT n_name AS ticker, floor(coalesce(avg(CASE WHEN value > 25 THEN 1.0::DOUBLE WHEN value IS NOT NULL THEN 0 END) * 100, 50) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS win_rate FROM nation LEFT JOIN (SELECT * FROM r WHERE k <= 100) ON user_id = n_nationkey GROUP BY 1")
def agg_wins_last100(spark, sf_dir):
    """Share of successes among the newest 100 results of each ticker, 50 without any."""
    wins = QUERIES["scan_latest_n"](spark, sf_dir).select(F.col("ticker").alias("k"), "accuracy")
    nation = tables.table(spark, sf_dir, "nation").select(F.col("n_name").alias("ticker"), "n_nationkey")
    return nation.join(wins, F.col("n_nationkey") == F.col("k"), "left").select("ticker", F.coalesce("accuracy", F.lit(50.0)).alias("win_rate"))


# Windows


@query(f"WITH {SPLIT}, f AS (SELECT ticker, bar_date, split, " + ", ".join(f"lead(close, {h}) OVER w / close - 1 AS r{h}" for h in (1, 5, 20, 60)) + f" FROM sp WINDOW w AS {q.WS})) SELECT ticker, {SQL_DAY}, split, {q6('r1', 'r5', 'r20', 'r60')} FROM f")
def win_fwd_return(spark, sf_dir):
    """Forward returns within each part of the split, so that none looks across it."""
    out = backtest.split(q._bars(spark, sf_dir))
    for h in (1, 5, 20, 60):
        out = indicators.forward_return(out, h, "split", name=f"r{h}")
    return out.select("ticker", _day(), "split", *r6("r1", "r5", "r20", "r60"))


@query(f"WITH {B}, {q._ret(365, 'ticker', 'bars', 'o')} SELECT ticker, {q6('ret')} FROM o")
def win_first_last(spark, sf_dir):
    prices = q._bars(spark, sf_dir)
    return relative.period_return(prices, tables.as_of(spark, sf_dir), 365, "ticker").select("ticker", *r6("ret"))


@query(f"WITH {B} SELECT ticker, CAST(max(bar_date) AS VARCHAR) AS bar_date, floor(arg_max(close, bar_date) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS close FROM bars GROUP BY 1")
def win_rank_latest(spark, sf_dir):
    """The newest bar by an aggregate: no sort of the histories."""
    return q._bars(spark, sf_dir).groupBy("ticker").agg(F.max("bar_date").cast("string").alias("bar_date"), rounded(F.max_by("close", "bar_date"), 6).alias("close"))


# Technical rules

SIGNED = "CASE WHEN {0} >= 65 THEN 'BUY' WHEN {0} <= 35 THEN 'SELL' ELSE 'HOLD' END"


def _part(name: str, part: str, buy: float, sell: float) -> None:
    """One part's score and signal; only the outer bands of a part are a signal."""

    def f(spark, sf_dir):
        return QUERIES["tech_parts"](spark, sf_dir).select("ticker", F.col(part).alias("score"), scores.buy_sell(F.col(part), buy, sell).alias("signal"))

    named(name, f"{TECH} SELECT ticker, {part} AS score, CASE WHEN {part} >= {buy} THEN 'BUY' WHEN {part} <= {sell} THEN 'SELL' ELSE 'HOLD' END AS signal FROM tech", f)


_part("tech_rsi_score", "rsi_part", 80, 20)
_part("tech_macd_score", "macd_part", 65, 35)
_part("tech_bb_score", "band_part", 75, 25)

LONG = FOLDS.replace("WHERE back <= 150", "WHERE bar_date >= (SELECT max(bar_date) FROM bars) - 730")


def _long_macd(spark, sf_dir) -> DataFrame:
    prices = q._bars(spark, sf_dir)
    return indicators.macd(indicators.closes(tables.history(prices, tables.as_of(spark, sf_dir), 730)))


@query(f"{LONG} SELECT ticker, {q6('macd', 'signal_line')} FROM f")
def tech_v1_macd(spark, sf_dir):
    """The averages over two years in place of the newest rows."""
    return _long_macd(spark, sf_dir).select("ticker", *r6("macd", "signal_line"))


V1 = f"""{LONG}, hb AS (SELECT * FROM bars WHERE bar_date >= (SELECT max(bar_date) FROM bars) - 730), hd AS (SELECT *, lag(close) OVER {W}) AS p FROM hb),
ht AS (SELECT *, close - p AS x, CASE WHEN p IS NOT NULL THEN greatest(high - low, abs(high - p), abs(low - p)) END AS tr FROM hd),
ha AS (SELECT ticker, bar_date, close, CASE WHEN count(tr) OVER w = 14 THEN avg(tr) OVER w END AS atr, CASE WHEN count(x) OVER w = 14 THEN avg(CASE WHEN x IS NOT NULL THEN greatest(x, 0) END) OVER w END AS g, CASE WHEN count(x) OVER w = 14 THEN avg(CASE WHEN x IS NOT NULL THEN greatest(-x, 0) END) OVER w END AS l FROM ht WINDOW w AS {W} ROWS 13 PRECEDING)),
hl AS (SELECT ticker, arg_max(struct_pack(rsi := coalesce(100 - 100 / (1 + g / nullif(l, 0)), 50), pct := coalesce(atr, 0) / close * 100), bar_date) AS z FROM ha GROUP BY 1),
hv AS (SELECT f.ticker, z.rsi AS rsi, z.pct AS pct, macd, signal_line FROM f JOIN hl ON hl.ticker = f.ticker),
hs AS (SELECT *, greatest(0, least(100, 50 + CASE WHEN rsi < 30 THEN 20 WHEN rsi > 70 THEN -20 ELSE 0 END + CASE WHEN macd > signal_line THEN 15 ELSE -15 END + CASE WHEN pct < 2 THEN 10 WHEN pct > 4 THEN -10 ELSE 0 END))::DOUBLE AS score FROM hv)"""


@query(f"{V1} SELECT ticker, {q6('rsi', 'pct')}, score, CASE WHEN score >= 65 THEN 'BUY' WHEN score <= 35 THEN 'SELL' WHEN rsi < 30 THEN 'BUY' WHEN rsi > 70 THEN 'SELL' ELSE 'HOLD' END AS signal FROM hs")
def tech_v1(spark, sf_dir):
    """First variant over two years; missing indicators take their defaults."""
    prices = q._bars(spark, sf_dir)
    recent = tables.history(prices, tables.as_of(spark, sf_dir), 730)
    last = indicators.true_range(indicators.rsi_sma(recent)).groupBy("ticker").agg(F.max_by(F.struct("rsi", "atr", "close"), "bar_date").alias("z"))
    folds = indicators.macd(indicators.closes(recent)).select("ticker", "macd", "signal_line")
    rows = last.join(folds, "ticker").select("ticker", scores.safe(F.col("z.rsi"), 50.0).alias("rsi"), (scores.safe(F.col("z.atr"), 0.0) / scores.safe(F.col("z.close"), 100.0) * 100).alias("atr_pct"), scores.safe(F.col("macd"), 0.0).alias("macd"), scores.safe(F.col("signal_line"), 0.0).alias("signal_line"))
    return scores.technical_v1(rows).select("ticker", *r6("rsi"), rounded("atr_pct", 6).alias("pct"), "score", "signal")


# Fundamental, news and macro rules


@query("SELECT user_id AS ticker, count(CASE WHEN event_type = 'purchase' AND CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events) - 90 THEN 1 END) AS form4 FROM events GROUP BY 1")
def sec_form4(spark, sf_dir):
    f = tables.filings(spark, sf_dir)
    return f.groupBy("ticker").agg(F.count_if((F.col("form") == "4") & (F.col("filed") > F.date_sub(F.lit(tables.latest_date(f, "filed")), 90))).alias("form4"))


@query(f"WITH {FUND} SELECT n_name AS ticker, floor(coalesce(de_ratio, 0.15::DOUBLE) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS de_ratio FROM nation LEFT JOIN fd ON ticker = n_name")
def sec_de(spark, sf_dir):
    """Debt to equity, 0.15 where nothing is known."""
    known = tables.fundamentals(spark, sf_dir).select("ticker", "de_ratio")
    return tables.table(spark, sf_dir, "nation").select(F.col("n_name").alias("ticker")).join(known, "ticker", "left").select("ticker", rounded(F.coalesce("de_ratio", F.lit(0.15)), 6).alias("de_ratio"))


@query(f"WITH {FUND} SELECT n_name AS ticker, floor(revenue * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS revenue, floor(coalesce(de_ratio, 0.15::DOUBLE) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS de_ratio, coalesce(insiders, 0) AS insiders, 95 AS confidence FROM nation LEFT JOIN fd ON ticker = n_name")
def sec_run(spark, sf_dir):
    """The three facts as one record a ticker."""
    known = tables.table(spark, sf_dir, "nation").select(F.col("n_name").alias("ticker")).join(tables.fundamentals(spark, sf_dir), "ticker", "left")
    return known.select("ticker", *r6("revenue"), rounded(F.coalesce("de_ratio", F.lit(0.15)), 6).alias("de_ratio"), F.coalesce("insiders", F.lit(0)).alias("insiders"), F.lit(95).alias("confidence"))


@query(f"WITH nw AS (SELECT doc_id, lower(text) AS low FROM documents), n1 AS (SELECT doc_id, ({q._hits(lex.NEWS1_POSITIVE)}) AS p, ({q._hits(lex.NEWS1_NEGATIVE)}) AS n FROM nw) SELECT doc_id, floor(coalesce((p - n) / nullif(p + n, 0), 0) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS sentiment FROM n1")
def news_v1_sentiment(spark, sf_dir):
    return tables.news(spark, sf_dir).select("doc_id", rounded(text.news_sentiment_v1(F.col("text")), 6).alias("sentiment"))


@query(f"SELECT w.*, t.top FROM ({ORACLE['news_v1']}) w JOIN (SELECT ticker, string_agg(CAST(doc_id AS VARCHAR), '|' ORDER BY k) AS top FROM (SELECT source AS ticker, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id, text) AS k FROM documents) WHERE k <= 3 GROUP BY 1) t ON t.ticker IS NOT DISTINCT FROM w.ticker")
def news_v1_result(spark, sf_dir):
    """The first variant's record, with the ids of the three first articles."""
    news = tables.news(spark, sf_dir)
    first = news.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy("doc_id", "text"))).where("k <= 3")
    top = first.groupBy(F.col("ticker").alias("of")).agg(F.concat_ws("|", F.transform(F.sort_array(F.collect_list(F.struct("k", "doc_id"))), lambda x: x["doc_id"].cast("string"))).alias("top"))
    return QUERIES["news_v1"](spark, sf_dir).join(top, F.col("ticker").eqNullSafe(F.col("of"))).drop("of")


INDICATORS = ("CPI", "UNEMPLOYMENT", "FED_RATE", "T10Y2Y", "VIX", "OTHER")


@query("""WITH x AS (SELECT o_orderkey, ['CPI', 'UNEMPLOYMENT', 'FED_RATE', 'T10Y2Y', 'VIX', 'OTHER'][o_orderkey % 6 + 1] AS indicator, (o_orderkey % 131) / 4.0::DOUBLE - 1 AS value FROM orders)
SELECT o_orderkey, indicator, CASE indicator WHEN 'CPI' THEN CASE WHEN value > 2 AND value < 4 THEN 'Normal' WHEN value >= 4 THEN 'High inflation' ELSE 'Low' END WHEN 'UNEMPLOYMENT' THEN CASE WHEN value < 4.5 THEN 'Good' WHEN value > 5.5 THEN 'Rising' ELSE 'Moderate' END
 WHEN 'FED_RATE' THEN printf('Current rate: %.2f%%', value) WHEN 'T10Y2Y' THEN CASE WHEN value < 0 THEN 'INVERTED' WHEN value < 0.5 THEN 'FLAT' ELSE 'NORMAL' END WHEN 'VIX' THEN CASE WHEN value < 15 THEN 'Low volatility' WHEN value < 25 THEN 'Moderate' ELSE 'High fear' END ELSE '' END AS meaning FROM x""")
def macro_interpret(spark, sf_dir):
    """The meaning of a value of each indicator, over a grid of values."""
    k = F.col("o_orderkey")
    x = tables.table(spark, sf_dir, "orders").select(k, F.element_at(F.array(*map(F.lit, INDICATORS)), (k % 6 + 1).cast("int")).alias("indicator"), ((k % 131) / 4.0 - 1).alias("value"))
    return x.select("o_orderkey", "indicator", scores.macro_text(F.col("indicator"), F.col("value")).alias("meaning"))


# The batch and its sinks


@query(q.FULL)
def run_full_analysis(spark, sf_dir):
    """All nine modules of every ticker: one plan for the universe."""
    return q._full(full_analysis(spark, sf_dir))


@query(f"{COMBINED} SELECT ticker, combined, signal, agreement, 5 AS indicators FROM sg")
def run_daily_batch(spark, sf_dir):
    return analyze(spark, sf_dir).select("ticker", "combined", "signal", "agreement", F.size("macro").alias("indicators"))


@query(f"{COMBINED} SELECT ticker, combined, signal, agreement FROM sg")
def sink_json_ticker(spark, sf_dir):
    """A folder of JSON for each ticker, written and read back."""
    return sinks.json_round_trip(analyze(spark, sf_dir).select("ticker", "combined", "signal", "agreement"), by="ticker")


def _cells(*names: str) -> str:
    return " || ".join(f"'<td>' || {n} || '</td>'" for n in names)


@query(f"{COMBINED} SELECT '<tr>' || {_cells('ticker', 'signal', "printf('%.2f', combined)", "printf('%.2f', agreement)")} || '</tr>' AS value FROM sg")
def sink_html_report(spark, sf_dir):
    """The report's rows, formatted on the executors, written and read back."""
    b = analyze(spark, sf_dir)
    return sinks.page_round_trip(b.select(sinks.html_row(F.col("ticker"), F.col("signal"), F.format_string("%.2f", "combined"), F.format_string("%.2f", "agreement")).alias("value")))


@query(f"{COMBINED} SELECT ticker, '<h1>' || ticker || '</h1><table><tr>' || {_cells('CAST(CAST(tech AS DECIMAL(9,2)) AS VARCHAR)', 'CAST(CAST(fund AS DECIMAL(9,2)) AS VARCHAR)', 'CAST(CAST(news AS DECIMAL(9,2)) AS VARCHAR)', 'signal')} || '</tr></table>' AS page FROM cs JOIN sg USING (ticker, combined)")
def sink_html_ticker(spark, sf_dir):
    """A small page a ticker with its three scores and the action."""
    b = analyze(spark, sf_dir)
    parts = [F.coalesce(c, F.lit(50.0)).cast("decimal(9,2)").cast("string") for c in ("tech", "fund", "news")]
    return b.select("ticker", F.concat(F.lit("<h1>"), sinks.escaped(F.col("ticker")), F.lit("</h1><table>"), sinks.html_row(*parts, F.col("signal")), F.lit("</table>")).alias("page"))


DASH = f"SELECT '<h1>Status</h1><table><tr>' || {_cells('tickers', 'buys', 'errors', 'health')} || '</tr></table>' AS page FROM ({ORACLE['dash_status']}) d"


def _dashboard(spark, sf_dir) -> DataFrame:
    row = sinks.html_row(*(F.col(c).cast("string") for c in ("tickers", "buys", "errors", "health")))
    return QUERIES["dash_status"](spark, sf_dir).select(F.concat(F.lit("<h1>Status</h1><table>"), row, F.lit("</table>")).alias("page"))


@query(DASH)
def sink_dashboard(spark, sf_dir):
    """The status page from measured counts."""
    return _dashboard(spark, sf_dir)


@query(f"SELECT page AS value, length(page) AS chars FROM ({DASH}) p")
def sink_dashboard_file(spark, sf_dir):
    """The page as it is read back from its file, and its length."""
    return sinks.page_round_trip(_dashboard(spark, sf_dir)).select("value", F.length("value").cast("long").alias("chars"))
