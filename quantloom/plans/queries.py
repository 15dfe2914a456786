"""Registered queries of the analytics engine, each beside its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType
from pyspark.sql.window import Window

from quantloom.functions import lexicons as lex
from quantloom.functions.columns import rounded
from quantloom.operators import backtest, indicators, quality, relative, scores, text
from quantloom.plans.analyze import analyze, full_analysis, technical_modules
from quantloom.sources import sinks, tables
from quantloom.streaming import bars as stream_bars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def exact(sql: str) -> str:
    """Writes the short forms of rounding out: ``floor(E * 100 + 0.5::DOUBLE) / 100`` as rounding of the binary value, others with the border of ``rounded``."""
    mark = " * 100 + 0.5::DOUBLE) / 100"
    while (end := sql.find(mark + " ")) >= 0 or (end := sql.find(mark + ")")) >= 0 or (end := sql.find(mark + ",")) >= 0 or (end := sql.find(mark + "\n")) >= 0:
        start, depth = end, 1
        while depth:
            start -= 1
            depth += {")": 1, "(": -1}.get(sql[start], 0)
        head = start - len("floor")
        y, high = "x * 100.0::DOUBLE", "(x * 134217729.0::DOUBLE - (x * 134217729.0::DOUBLE - x))"
        lost = f"(({high} * 100.0::DOUBLE - {y}) + (x - {high}) * 100.0::DOUBLE)"
        tie = f"CASE WHEN {lost} > 0 THEN floor({y}) + 1 WHEN {lost} < 0 THEN floor({y}) ELSE floor({y}) + floor({y}) % 2 END"
        body = f"CASE WHEN {y} - floor({y}) = 0.5::DOUBLE THEN {tie} ELSE floor({y} + 0.5::DOUBLE) END / 100.0::DOUBLE"
        sql = f"{sql[:head]}list_transform([CAST({sql[start + 1 : end]} AS DOUBLE)], lambda x: {body})[1]{sql[end + len(mark) :]}"
    return re.sub(r"(\* 10+(?:::DOUBLE)? \+ 0\.5)(::DOUBLE)", r"\g<1>0001\2", sql)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = exact(sql)
        return f

    return add


def r6(*names: str) -> list:
    return [rounded(n, 6).alias(n) for n in names]


def q6(*names: str) -> str:
    return ", ".join(f"floor(({n}) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS {n}" for n in names)


B = """trades AS (SELECT n_name AS ticker, n_regionkey AS sector, CAST(l_shipdate AS DATE) AS bar_date, l_extendedprice / l_quantity AS px, l_quantity,
  row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity <> 0),
bars AS (SELECT ticker, any_value(sector) AS sector, bar_date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume FROM trades GROUP BY ticker, bar_date)"""
W = "(PARTITION BY ticker ORDER BY bar_date"


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bars(spark, sf_dir)


def _sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(spark, sf_dir).join(tables.supplier_nations(spark, sf_dir).select("ticker", "sector").distinct(), "ticker")


# Scans and filters


def _history(days: int, least: int) -> str:
    return f"WITH {B}, h AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS n_rows FROM bars WHERE bar_date >= (SELECT max(bar_date) FROM bars) - {days}) SELECT ticker, CAST(bar_date AS VARCHAR) AS bar_date, {q6('close')}, volume, n_rows FROM h WHERE n_rows >= {least}"


def _recent(spark: SparkSession, sf_dir: str, days: int, least: int) -> DataFrame:
    prices = _bars(spark, sf_dir)
    return tables.history(prices, tables.as_of(spark, sf_dir), days, least).select("ticker", F.col("bar_date").cast("string").alias("bar_date"), *r6("close"), "volume", "n_rows")


@query(_history(180, 70))
def src_prices_6m(spark, sf_dir):
    return _recent(spark, sf_dir, 180, 70)


@query(_history(730, 1))
def src_prices_2y(spark, sf_dir):
    return _recent(spark, sf_dir, 730, 1)


@query(_history(730, 100))
def src_prices_2y_min100(spark, sf_dir):
    return _recent(spark, sf_dir, 730, 100)


@query(_history(730, 51))
def src_walk_prices(spark, sf_dir):
    return _recent(spark, sf_dir, 730, 51)


@query(f"WITH {B} SELECT ticker, CAST(bar_date AS VARCHAR) AS bar_date, {q6('open', 'high', 'low', 'close')}, volume FROM bars")
def src_bars(spark, sf_dir):
    return _bars(spark, sf_dir).select("ticker", F.col("bar_date").cast("string").alias("bar_date"), *r6("open", "high", "low", "close"), "volume")


@query(f"WITH {B}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY bar_date DESC) AS back FROM bars) SELECT ticker, CAST(bar_date AS VARCHAR) AS bar_date, {q6('close')} FROM r WHERE back <= 150")
def last_n(spark, sf_dir):
    return indicators.last_rows(_bars(spark, sf_dir), 150).select("ticker", F.col("bar_date").cast("string").alias("bar_date"), *r6("close"))


@query("SELECT user_id AS ticker, count(*) AS filings, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS form4, count(CASE WHEN event_type = 'purchase' AND CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events) - 90 THEN 1 END) AS recent_form4 FROM events GROUP BY user_id")
def agg_filtered_count(spark, sf_dir):
    """Form-4 count of the newest 90 days by company."""
    f = tables.filings(spark, sf_dir)
    as_of = tables.latest_date(f, "filed")
    return f.groupBy("ticker").agg(F.count("*").alias("filings"), F.count_if(F.col("form") == "4").alias("form4"), F.count_if((F.col("form") == "4") & (F.col("filed") > F.date_sub(F.lit(as_of), 90))).alias("recent_form4"))


@query("""WITH f AS (SELECT user_id AS ticker, CASE event_type WHEN 'purchase' THEN '4' WHEN 'view' THEN '10-Q' WHEN 'click' THEN '10-K' ELSE '8-K' END AS form, CAST(CAST(ts AS DATE) AS VARCHAR) AS filed, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS pos FROM events)
SELECT ticker, arg_min(form, pos) AS form, arg_min(filed, pos) AS filed FROM f WHERE pos <= 10 AND form IN ('10-K', '10-Q') GROUP BY ticker""")
def first_match(spark, sf_dir):
    """The newest 10-K or 10-Q among a company's ten newest filings, from parallel arrays in JSON."""
    events = tables.table(spark, sf_dir, "events")
    form = F.when(F.col("event_type") == "purchase", "4").when(F.col("event_type") == "view", "10-Q").when(F.col("event_type") == "click", "10-K").otherwise("8-K")
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    newest = events.withColumn("pos", F.row_number().over(w)).where("pos <= 10").select(F.col("user_id").alias("ticker"), "pos", form.alias("form"), F.to_date("ts").cast("string").alias("filed"))
    packed = newest.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("pos", "form", "filed"))).alias("a"))
    as_json = packed.select("ticker", F.to_json(F.struct(F.transform("a", lambda x: x["form"]).alias("form"), F.transform("a", lambda x: x["filed"]).alias("filingDate"))).alias("j"))
    parsed = as_json.withColumn("p", F.from_json("j", "form array<string>, filingDate array<string>"))
    hits = F.filter(F.slice(F.arrays_zip("p.form", "p.filingDate"), 1, 10), lambda x: x["form"].isin("10-K", "10-Q"))
    return parsed.withColumn("h", F.get(hits, F.lit(0))).where("h is not null").select("ticker", F.col("h.form").alias("form"), F.col("h.filingDate").alias("filed"))


@query("SELECT o_orderpriority AS indicator, CAST(max(d) AS VARCHAR) AS data_date, floor(arg_max(v, d) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS value FROM (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2) GROUP BY 1")
def src_fred(spark, sf_dir):
    return tables.macro(spark, sf_dir).groupBy("indicator").agg(F.max("data_date").cast("string").alias("data_date"), rounded(F.max_by("value", "data_date"), 6).alias("value"))


@query("SELECT page_id, CASE WHEN contains(html, 'Earnings Date') OR contains(html, 'earnings-date') THEN 'PENDING' END AS status FROM pages")
def src_earnings_page(spark, sf_dir):
    html = F.col("html")
    return tables.table(spark, sf_dir, "pages").select("page_id", F.when(html.contains("Earnings Date") | html.contains("earnings-date"), "PENDING").alias("status"))


@query("""WITH a AS (SELECT CAST(max(l_shipdate) AS DATE) AS day FROM lineitem WHERE l_quantity <> 0), f AS (SELECT * FROM (VALUES ('10-K', 3, 60), ('10-K', 4, 60), ('10-Q', 5, 45), ('10-Q', 8, 45), ('10-Q', 11, 45)) t(form, month, days))
SELECT n_name AS ticker, form, month, days, CAST(e AS VARCHAR) AS period_end, CAST(e + days AS VARCHAR) AS due, 'SEC Filing Calendar' AS source, 1 AS source_tier, 0.95::DOUBLE AS confidence
 FROM (SELECT *, CAST(date_trunc(CASE form WHEN '10-K' THEN 'year' ELSE 'quarter' END, day) AS DATE) - 1 AS e FROM a, f) x, nation""")
def src_sec_deadlines(spark, sf_dir):
    """The usual months and delays of every ticker's filings, and when those of the last ended year and quarter are due."""
    day = F.lit(tables.as_of(spark, sf_dir))
    ended = F.date_sub(F.when(F.col("form") == "10-K", F.trunc(day, "year")).otherwise(F.trunc(day, "quarter")), 1)
    rules = F.explode(F.array(*(F.struct(F.lit(f).alias("form"), F.lit(m).alias("month"), F.lit(d).alias("days")) for f, m, d in lex.FILING_DEADLINES))).alias("r")
    known = tables.table(spark, sf_dir, "nation").select(F.col("n_name").alias("ticker"), rules).select("ticker", "r.*").withColumn("ended", ended)
    due = F.date_add("ended", F.col("days")).cast("string").alias("due")
    return known.select("ticker", "form", "month", "days", F.col("ended").cast("string").alias("period_end"), due, F.lit("SEC Filing Calendar").alias("source"), F.lit(1).alias("source_tier"), F.lit(0.95).alias("confidence"))


PLACEHOLDERS = ("src_dividend_page", "src_short", "src_short_exempt", "src_short_trend", "src_ratings", "src_targets", "src_estimates", "src_rating_trend", "src_transcript", "src_next_earnings", "src_iv", "src_pcr", "src_oi", "src_skew", "src_flow", "sector_growth")


@query("SELECT n_name AS ticker, p AS item, CAST(NULL AS DOUBLE) AS value, 'UNAVAILABLE' AS status FROM nation, (VALUES " + ", ".join(f"('{p}')" for p in PLACEHOLDERS) + ") t(p)")
def src_placeholders(spark, sf_dir):
    """Items without a provider: a typed null and a status, one row a ticker and item."""
    nation = tables.table(spark, sf_dir, "nation").select(F.col("n_name").alias("ticker"))
    return nation.select("ticker", F.explode(F.array(*map(F.lit, PLACEHOLDERS))).alias("item"), F.lit(None).cast("double").alias("value"), F.lit("UNAVAILABLE").alias("status"))


@query("SELECT DISTINCT n_name AS ticker, 'NEUTRAL' AS signal, 0 AS transactions FROM nation")
def src_insider(spark, sf_dir):
    return tables.table(spark, sf_dir, "nation").select(F.col("n_name").alias("ticker")).distinct().select("ticker", F.lit("NEUTRAL").alias("signal"), F.lit(0).alias("transactions"))


QUOTES = """q AS (SELECT a.ticker, a.sector, gross_margin, operating_margin, profit_margin, trailing_pe FROM
 (SELECT n_name AS ticker, n_regionkey AS sector, avg(l_discount) AS gross_margin, avg(l_tax) AS operating_margin, avg(l_discount) - avg(l_tax) - 0.01::DOUBLE AS profit_margin FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2) a
 JOIN (SELECT n_name AS ticker, avg(s_acctbal) / 100 AS trailing_pe FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) b USING (ticker))"""


@query(f"WITH {QUOTES} SELECT ticker, {q6('trailing_pe', 'gross_margin', 'operating_margin', 'profit_margin')} FROM q")
def src_quote_info(spark, sf_dir):
    return tables.quotes(spark, sf_dir).select("ticker", *r6("trailing_pe", "gross_margin", "operating_margin", "profit_margin"))




@query("WITH c AS (SELECT user_id AS ticker, event_type AS metric, arg_max(value, row(ts, event_id)) AS value, max(ts) AS newest FROM events GROUP BY 1, 2) SELECT ticker, metric, value FROM c WHERE newest > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def cache_get(spark, sf_dir):
    """The newest value of each (ticker, metric), if it is younger than a day."""
    e = tables.table(spark, sf_dir, "events")
    as_of = e.agg(F.max("ts")).first()[0]
    got = e.groupBy(F.col("user_id").alias("ticker"), F.col("event_type").alias("metric")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("at"))
    return got.where(F.col("at") > F.lit(as_of) - F.expr("INTERVAL 24 HOURS")).select("ticker", "metric", "value")


@query("WITH r AS (SELECT user_id AS ticker, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT ticker, CAST(count(*) AS BIGINT) AS n, floor(avg(CASE WHEN value > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 * 1000000 + 0.5::DOUBLE) / 1000000 AS accuracy FROM r WHERE k <= 100 GROUP BY 1")
def scan_latest_n(spark, sf_dir):
    """Share of successes (values over 25) among the newest 100 rows of each ticker."""
    e = tables.table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    newest = e.withColumn("k", F.row_number().over(w)).where("k <= 100")
    return newest.groupBy(F.col("user_id").alias("ticker")).agg(F.count("*").alias("n"), rounded(F.avg(F.when(F.col("value") > 25, 1.0).otherwise(0.0)) * 100, 6).alias("accuracy"))


@query("SELECT CAST(max(ts) AS VARCHAR) AS newest FROM events")
def scan_any_ts(spark, sf_dir):
    """The newest time as SQL's cast writes it: without the fraction's last zeros, or any fraction of a whole second; an instant (a UTC column) with the session's offset."""
    events = tables.table(spark, sf_dir, "events")
    newest = F.ltrim(F.max("ts").cast("string"), F.lit("+"))  # Spark's sign before years of five digits
    if isinstance(events.schema["ts"].dataType, TimestampType):
        newest = F.concat(newest, F.regexp_replace(F.date_format(F.max("ts"), "xxx"), ":00$", ""))
    return events.agg(newest.alias("newest"))


@query("SELECT t AS name FROM (VALUES ('benchmark'), ('conversations'), ('customer'), ('documents'), ('embeddings'), ('events'), ('labels'), ('lineitem'), ('nation'), ('orders'), ('pages'), ('part'), ('region'), ('supplier')) v(t)")
def scan_catalog(spark, sf_dir):
    """Tables of the catalog after registering the data folder's as temporary views."""
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
    for n in names:
        tables.table(spark, sf_dir, n).createOrReplaceTempView(n)
    return spark.createDataFrame([(t.name,) for t in spark.catalog.listTables() if t.isTemporary and t.name in names], "name string")


# Sinks


@query("""WITH e AS (SELECT user_id AS ticker, event_type AS metric, CAST(value AS VARCHAR) AS value, ts, event_id FROM events)
SELECT ticker, metric, arg_max(value, row(ts, event_id)) AS value FROM e GROUP BY 1, 2""")
def sink_upsert_sec(spark, sf_dir):
    """Old rows (first half of the month) with new ones put over them, newest by time."""
    e = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), F.col("event_type").alias("metric"), F.col("value").cast("string").alias("value"), F.struct("ts", "event_id").alias("at"))
    middle = F.expr("TIMESTAMP '2024-01-16 00:00:00'")
    return sinks.upsert(e.where(F.col("at.ts") < middle), e.where(F.col("at.ts") >= middle), ["ticker", "metric"], "at").select("ticker", "metric", "value")


@query("SELECT o_orderpriority AS indicator, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS data_date, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1, 2")
def sink_upsert_macro(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("indicator"), F.to_date("o_orderdate").cast("string").alias("data_date"), F.col("o_totalprice").alias("value"), "o_orderkey")
    half = F.expr("o_orderkey % 2 = 0")
    return sinks.upsert(o.where(half), o.where(~half), ["indicator", "data_date"], "o_orderkey").drop("o_orderkey")


@query("""WITH e AS (SELECT user_id AS ticker, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, value, event_id, event_type FROM events), o AS (SELECT * FROM e WHERE event_type = 'view'), n AS (SELECT * FROM e WHERE event_type <> 'view')
SELECT ticker, date, arg_min(value, event_id) AS value FROM o GROUP BY 1, 2 UNION ALL SELECT ticker, date, arg_min(value, event_id) AS value FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.ticker = n.ticker AND o.date = n.date) GROUP BY 1, 2""")
def sink_insert_ignore(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), F.to_date("ts").cast("string").alias("date"), "event_id", "value", "event_type")
    old = e.where("event_type = 'view'").drop("event_type")
    old = old.groupBy("ticker", "date").agg(F.min("event_id").alias("event_id"), F.min_by("value", "event_id").alias("value"))
    return sinks.insert_ignore(old, e.where("event_type <> 'view'").drop("event_type"), ["ticker", "date"]).drop("event_id")


# Windows


@query(f"WITH {B}, r AS (SELECT *, count(close) OVER w AS c, avg(close) OVER w AS a, stddev_samp(close) OVER w AS s FROM bars WINDOW w AS {W} ROWS 19 PRECEDING)), v AS (SELECT ticker, bar_date, CASE WHEN c = 20 THEN a END AS sma, CASE WHEN c = 20 THEN s END AS std FROM r) SELECT ticker, CAST(bar_date AS VARCHAR) AS bar_date, {q6('sma', 'std')}, floor((sma + 2 * std) * 1000000 + 0.5::DOUBLE) / 1000000 AS upper, floor((sma - 2 * std) * 1000000 + 0.5::DOUBLE) / 1000000 AS lower FROM v")
def win_bollinger(spark, sf_dir):
    """20-day mean, sample deviation and bands; null until the frame is full."""
    return indicators.bollinger(_bars(spark, sf_dir)).select("ticker", F.col("bar_date").cast("string").alias("bar_date"), *r6("sma", "std", "upper", "lower"))


@query(f"WITH {B}, r AS (SELECT *, count(close) OVER w AS c, avg(close) OVER w AS a FROM bars WINDOW w AS {W} ROWS 19 PRECEDING)), v AS (SELECT ticker, bar_date, CASE WHEN c = 20 THEN (close / a - 1) * 100 END AS momentum FROM r) SELECT ticker, CAST(bar_date AS VARCHAR) AS bar_date, {q6('momentum')} FROM v")
def win_momentum(spark, sf_dir):
    return indicators.momentum(_bars(spark, sf_dir)).select("ticker", F.col("bar_date").cast("string").alias("bar_date"), *r6("momentum"))


@query(f"WITH {B}, d AS (SELECT *, lag(close) OVER {W}) AS p FROM bars), t AS (SELECT *, CASE WHEN p IS NOT NULL THEN greatest(high - low, abs(high - p), abs(low - p)) END AS tr FROM d), a AS (SELECT ticker, bar_date, tr, CASE WHEN count(tr) OVER w = 14 THEN avg(tr) OVER w END AS atr FROM t WINDOW w AS {W} ROWS 13 PRECEDING)) SELECT ticker, CAST(bar_date AS VARCHAR) AS bar_date, {q6('tr', 'atr')} FROM a")
def win_atr(spark, sf_dir):
    return indicators.true_range(_bars(spark, sf_dir)).select("ticker", F.col("bar_date").cast("string").alias("bar_date"), *r6("tr", "atr"))


@query(f"WITH {B}, d AS (SELECT *, close - lag(close) OVER {W}) AS x FROM bars), a AS (SELECT ticker, bar_date, CASE WHEN count(x) OVER w = 14 THEN avg(CASE WHEN x IS NOT NULL THEN greatest(x, 0) END) OVER w END AS g, CASE WHEN count(x) OVER w = 14 THEN avg(CASE WHEN x IS NOT NULL THEN greatest(-x, 0) END) OVER w END AS l FROM d WINDOW w AS {W} ROWS 13 PRECEDING)), v AS (SELECT *, 100 - 100 / (1 + g / nullif(l, 0)) AS rsi FROM a) SELECT ticker, CAST(bar_date AS VARCHAR) AS bar_date, {q6('rsi')} FROM v")
def win_rsi_sma(spark, sf_dir):
    return indicators.rsi_sma(_bars(spark, sf_dir)).select("ticker", F.col("bar_date").cast("string").alias("bar_date"), *r6("rsi"))


@query(f"WITH {B}, v AS (SELECT ticker, bar_date, close - lag(close) OVER w AS diff, close / lag(close) OVER w - 1 AS pct, lead(close, 5) OVER w / close - 1 AS fwd FROM bars WINDOW w AS {W})) SELECT ticker, CAST(bar_date AS VARCHAR) AS bar_date, {q6('diff', 'pct', 'fwd')} FROM v")
def win_returns(spark, sf_dir):
    """Difference, change and 5-day forward return of each close."""
    before = F.lag("close").over(indicators.over())
    out = indicators.forward_return(_bars(spark, sf_dir), 5).withColumn("diff", F.col("close") - before).withColumn("pct", F.col("close") / before - 1)
    return out.select("ticker", F.col("bar_date").cast("string").alias("bar_date"), *r6("diff", "pct", "fwd"))


FOLDS = f"""WITH RECURSIVE {B}, r AS (SELECT ticker, bar_date, close, row_number() OVER (PARTITION BY ticker ORDER BY bar_date DESC) AS back, count(*) OVER (PARTITION BY ticker) AS n_rows FROM bars),
s AS MATERIALIZED (SELECT ticker, bar_date, close, n_rows, row_number() OVER {W}) AS i, count(*) OVER (PARTITION BY ticker) AS n FROM r WHERE back <= 150),
c AS MATERIALIZED (SELECT *, close - lag(close) OVER {W}) AS d FROM s),
seed AS MATERIALIZED (SELECT ticker, sum(CASE WHEN d >= 0 THEN d ELSE 0 END ORDER BY i) / 14 AS u, -sum(CASE WHEN d < 0 THEN d ELSE 0 END ORDER BY i) / 14 AS l FROM c WHERE i BETWEEN 2 AND 16 GROUP BY ticker),
rs AS (SELECT ticker, 14::BIGINT AS i, u, l FROM seed UNION ALL SELECT c.ticker, c.i, (rs.u * 13 + greatest(c.d, 0)) / 14, (rs.l * 13 + greatest(-c.d, 0)) / 14 FROM rs JOIN c ON c.ticker = rs.ticker AND c.i = rs.i + 1),
em AS (SELECT ticker, 0::BIGINT AS i, 0::DOUBLE AS fn, 0::DOUBLE AS fd, 0::DOUBLE AS sn, 0::DOUBLE AS sd, 0::DOUBLE AS gn, 0::DOUBLE AS gd, 0::DOUBLE AS m FROM (SELECT DISTINCT ticker FROM s)
 UNION ALL SELECT ticker, i, fn, fd, sn, sd, gn * (1 - 2.0::DOUBLE / 10) + (fn / fd - sn / sd), gd * (1 - 2.0::DOUBLE / 10) + 1, fn / fd - sn / sd FROM
 (SELECT s.ticker, s.i, em.fn * (1 - 2.0::DOUBLE / 13) + s.close AS fn, em.fd * (1 - 2.0::DOUBLE / 13) + 1 AS fd, em.sn * (1 - 2.0::DOUBLE / 27) + s.close AS sn, em.sd * (1 - 2.0::DOUBLE / 27) + 1 AS sd, em.gn AS gn, em.gd AS gd FROM em JOIN s ON s.ticker = em.ticker AND s.i = em.i + 1)),
f AS (SELECT s.ticker, s.n_rows, s.close, CASE WHEN rs.l <> 0 THEN 100 - 100 / (1 + rs.u / rs.l) ELSE 50 END AS rsi, em.fn / em.fd AS ema_fast, em.sn / em.sd AS ema_slow, em.m AS macd, em.gn / em.gd AS signal_line, em.m - em.gn / em.gd AS histogram
 FROM s JOIN rs ON rs.ticker = s.ticker AND rs.i = s.n JOIN em ON em.ticker = s.ticker AND em.i = s.n WHERE s.i = s.n)"""


@query(f"{FOLDS} SELECT ticker, {q6('rsi')} FROM f")
def win_rsi_wilder(spark, sf_dir):
    return indicators.rsi_wilder(indicators.closes(indicators.last_rows(_bars(spark, sf_dir)))).select("ticker", *r6("rsi"))


@query(f"{FOLDS} SELECT ticker, {q6('ema_fast', 'ema_slow', 'macd', 'signal_line', 'histogram')} FROM f")
def win_macd(spark, sf_dir):
    """Both averages, their difference, its signal line and the histogram at the newest close."""
    return indicators.macd(indicators.closes(indicators.last_rows(_bars(spark, sf_dir)))).select("ticker", *r6("ema_fast", "ema_slow", "macd", "signal_line", "histogram"))


BANDS = f"""b AS (SELECT ticker, avg(close) AS sma, avg(close) + 2 * stddev_samp(close) AS upper, avg(close) - 2 * stddev_samp(close) AS lower FROM r WHERE back <= 20 GROUP BY ticker)"""
TECH = f"""{FOLDS}, {BANDS}, t AS (SELECT f.ticker, f.n_rows, CASE WHEN rsi < 30 THEN 80.0 WHEN rsi > 70 THEN 20.0 WHEN rsi < 50 THEN 40.0 ELSE 60.0 END::DOUBLE AS rsi_part, CASE WHEN histogram > 0 THEN 65.0 WHEN histogram < 0 THEN 35.0 ELSE 50.0 END::DOUBLE AS macd_part,
 CASE WHEN close > upper THEN 25.0 WHEN close < lower THEN 75.0 WHEN close > sma THEN 60.0 ELSE 40.0 END::DOUBLE AS band_part FROM f JOIN b USING (ticker)),
tech AS (SELECT *, CASE WHEN n_rows >= 70 THEN floor((0.40::DOUBLE * rsi_part + 0.35::DOUBLE * macd_part + 0.25::DOUBLE * band_part) * 100 + 0.5::DOUBLE) / 100 ELSE 50 END AS score FROM t)"""


@query(f"{TECH} SELECT ticker, score, CASE WHEN n_rows < 70 THEN 'HOLD' WHEN score >= 65 THEN 'BUY' WHEN score <= 35 THEN 'SELL' ELSE 'HOLD' END AS signal, CASE WHEN n_rows < 70 THEN 40 ELSE 85 END AS confidence FROM tech")
def tech_score(spark, sf_dir):
    return technical_modules(_bars(spark, sf_dir)).select("ticker", "score", "signal", "confidence")


@query(f"{TECH} SELECT ticker, rsi_part, macd_part, band_part FROM tech")
def tech_parts(spark, sf_dir):
    """The three part scores: RSI, MACD histogram, bands."""
    t = technical_modules(_bars(spark, sf_dir))
    return t.select("ticker", scores.rsi_score(F.col("rsi")).alias("rsi_part"), scores.macd_score(F.col("histogram")).alias("macd_part"), scores.band_score(F.col("close"), F.col("upper"), F.col("sma"), F.col("lower")).alias("band_part"))


# Relative strength


def _ret(days: int, key: str, frm: str, name: str) -> str:
    return f"{name} AS (SELECT {key}, CASE WHEN count(*) >= 2 THEN (arg_max(close, bar_date) / arg_min(close, bar_date) - 1) * 100 END AS ret FROM {frm} WHERE bar_date >= (SELECT max(bar_date) FROM bars) - {days} GROUP BY {key})"


@query(f"WITH {B}, etf AS (SELECT sector, bar_date, avg(close) AS close FROM bars GROUP BY 1, 2), {_ret(90, 'ticker, sector', 'bars', 'o')}, {_ret(90, 'sector', 'etf', 'e')}, v AS (SELECT ticker, o.ret, coalesce(e.ret, 0) AS sector_ret, o.ret - coalesce(e.ret, 0) AS relative FROM o LEFT JOIN e USING (sector)) SELECT ticker, {q6('ret', 'sector_ret', 'relative')}, CASE WHEN relative > 5 THEN 'OUTPERFORMING' WHEN relative < -5 THEN 'UNDERPERFORMING' WHEN relative IS NOT NULL THEN 'IN_LINE' END AS signal FROM v")
def rs_relative(spark, sf_dir):
    prices = _sectors(spark, sf_dir)
    return relative.relative_strength(prices, tables.as_of(spark, sf_dir)).select("ticker", *r6("ret", "sector_ret", "relative"), "signal")


@query(f"WITH {B}, h AS (SELECT * FROM bars WHERE bar_date >= (SELECT max(bar_date) FROM bars) - 365), m AS (SELECT bar_date, close / lag(close) OVER (ORDER BY bar_date) - 1 AS m FROM (SELECT bar_date, avg(close) AS close FROM h GROUP BY 1)), x AS (SELECT ticker, bar_date, close / lag(close) OVER {W}) - 1 AS r FROM h), v AS (SELECT ticker, coalesce(covar_samp(r, m) / nullif(var_pop(m), 0), 0) AS beta FROM x JOIN m USING (bar_date) WHERE r IS NOT NULL AND m IS NOT NULL GROUP BY 1) SELECT ticker, {q6('beta')}, CASE WHEN beta > 1.2 THEN 'HIGH_VOLATILITY' WHEN beta > 0.8 THEN 'MARKET_CORRELATED' ELSE 'LOW_VOLATILITY' END AS signal FROM v")
def rs_beta(spark, sf_dir):
    prices = _bars(spark, sf_dir)
    return relative.beta(prices, tables.as_of(spark, sf_dir)).select("ticker", *r6("beta"), "signal")


@query(f"WITH {B}, {_ret(252, 'ticker', 'bars', 'o')}, v AS (SELECT ticker, ret AS momentum FROM o) SELECT ticker, {q6('momentum')}, CASE WHEN momentum > 20 THEN 'STRONG_UP' WHEN momentum > 5 THEN 'MODERATE_UP' WHEN momentum < -20 THEN 'STRONG_DOWN' WHEN momentum < -5 THEN 'MODERATE_DOWN' WHEN momentum IS NOT NULL THEN 'SIDEWAYS' END AS trend, CASE WHEN momentum IS NULL THEN 'not enough rows' END AS error FROM v")
def rs_momentum(spark, sf_dir):
    prices = _bars(spark, sf_dir)
    return relative.momentum(prices, tables.as_of(spark, sf_dir)).select("ticker", *r6("momentum"), "trend", "error")


# Fundamentals and macro

FUND = """fd AS (SELECT a.ticker, revenue, de_ratio, insiders FROM (SELECT n_name AS ticker, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) a
 JOIN (SELECT n_name AS ticker, abs(avg(s_acctbal)) / 5000 AS de_ratio, count(*) AS insiders FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) b USING (ticker)),
fp AS (SELECT *, CASE WHEN coalesce(revenue, 0) = 0 THEN 50.0 WHEN revenue > 1e9 THEN 80.0 WHEN revenue > 5e8 THEN 70.0 WHEN revenue > 2e8 THEN 60.0 ELSE 45.0 END::DOUBLE AS profit,
 CASE WHEN de_ratio IS NULL THEN 50.0 WHEN de_ratio < 0.5 THEN 90.0 WHEN de_ratio < 1 THEN 75.0 WHEN de_ratio < 1.5 THEN 60.0 WHEN de_ratio < 2 THEN 45.0 ELSE 30.0 END::DOUBLE AS leverage,
 CASE WHEN insiders IS NULL THEN 50.0 WHEN insiders > 10 THEN 75.0 WHEN insiders > 5 THEN 65.0 WHEN insiders > 2 THEN 55.0 ELSE 40.0 END::DOUBLE AS insider FROM fd),
fund AS (SELECT *, floor((0.40::DOUBLE * profit + 0.35::DOUBLE * leverage + 0.25::DOUBLE * insider) * 100 + 0.5::DOUBLE) / 100 AS score FROM fp)"""


@query(f"WITH {FUND} SELECT ticker, {q6('revenue', 'de_ratio')}, insiders FROM fd")
def fund_fetch(spark, sf_dir):
    return tables.fundamentals(spark, sf_dir).select("ticker", *r6("revenue", "de_ratio"), "insiders")


@query(f"WITH {FUND} SELECT ticker, profit, leverage, insider, score, CASE WHEN score >= 70 THEN 'BUY' WHEN score <= 40 THEN 'SELL' ELSE 'HOLD' END AS signal, 95 AS confidence FROM fund")
def fund_composite(spark, sf_dir):
    return scores.fundamental(tables.fundamentals(spark, sf_dir)).select("ticker", "profit", "leverage", "insider", "score", "signal", "confidence")


@query("""WITH m AS (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate) AS d, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), l AS (SELECT p, arg_max(v, d) AS v FROM m GROUP BY 1),
x AS (SELECT CASE substr(p, 1, 1) WHEN '1' THEN 'CPI' WHEN '2' THEN 'UNEMPLOYMENT' WHEN '3' THEN 'T10Y2Y' WHEN '4' THEN 'VIX' ELSE 'OTHER' END AS indicator, floor(v / 50000 * 1000000 + 0.5::DOUBLE) / 1000000 AS value FROM l)
SELECT indicator, value, CASE indicator WHEN 'CPI' THEN CASE WHEN value > 2 AND value < 4 THEN 'Normal' WHEN value >= 4 THEN 'High inflation' ELSE 'Low' END WHEN 'UNEMPLOYMENT' THEN CASE WHEN value < 4.5 THEN 'Good' WHEN value > 5.5 THEN 'Rising' ELSE 'Moderate' END
 WHEN 'T10Y2Y' THEN CASE WHEN value < 0 THEN 'INVERTED' WHEN value < 0.5 THEN 'FLAT' ELSE 'NORMAL' END WHEN 'VIX' THEN CASE WHEN value < 15 THEN 'Low volatility' WHEN value < 25 THEN 'Moderate' ELSE 'High fear' END ELSE '' END AS meaning FROM x""")
def macro_run(spark, sf_dir):
    """The newest value of each indicator and what it means."""
    latest = tables.macro(spark, sf_dir).groupBy("indicator").agg(F.max_by("value", "data_date").alias("v"))
    names = F.create_map(*(F.lit(x) for x in ("1", "CPI", "2", "UNEMPLOYMENT", "3", "T10Y2Y", "4", "VIX")))
    out = latest.select(F.coalesce(F.try_element_at(names, F.substring("indicator", 1, 1)), F.lit("OTHER")).alias("indicator"), rounded(F.col("v") / 50000, 6).alias("value"))
    return out.withColumn("meaning", scores.macro_text(F.col("indicator"), F.col("value")))


# Text


def _hits(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(low, '{w}') AS INTEGER)" for w in words)


def _counts(words: list[str]) -> str:
    return " + ".join(f"CAST((length(low) - length(replace(low, '{w}', ''))) / {len(w)} AS INTEGER)" for w in words)


NEWS = f"""nw AS (SELECT source AS ticker, doc_id, text, lower(text) AS low FROM documents), ns AS (SELECT *, CASE WHEN text IS NULL OR text = '' THEN 50 ELSE greatest(0, least(100, 50 + 3 * (({_hits(lex.NEWS_POSITIVE)}) - ({_hits(lex.NEWS_NEGATIVE)})))) END::DOUBLE AS s FROM nw),
news AS (SELECT ticker, count(*) AS articles, floor(avg(s) * 100 + 0.5::DOUBLE) / 100 AS score FROM ns GROUP BY 1)"""


@query(f"WITH {NEWS} SELECT doc_id, s AS sentiment, CASE WHEN s >= 65 THEN 'BUY' WHEN s <= 40 THEN 'SELL' ELSE 'HOLD' END AS signal FROM ns")
def news_sentiment(spark, sf_dir):
    out = tables.news(spark, sf_dir).select("doc_id", text.news_sentiment(F.col("text")).alias("sentiment"))
    return out.withColumn("signal", scores.buy_sell(F.col("sentiment"), 65, 40))


@query(f"WITH {NEWS} SELECT ticker, articles, score, CASE WHEN score >= 65 THEN 'BUY' WHEN score <= 40 THEN 'SELL' ELSE 'HOLD' END AS signal, 70 AS confidence FROM news")
def news_agg(spark, sf_dir):
    return text.news_by_ticker(tables.news(spark, sf_dir))


@query(f"""WITH nw AS (SELECT source AS ticker, lower(text) AS low, row_number() OVER (PARTITION BY source ORDER BY doc_id, text) AS k FROM documents), n1 AS (SELECT ticker, ({_hits(lex.NEWS1_POSITIVE)}) AS p, ({_hits(lex.NEWS1_NEGATIVE)}) AS n FROM nw WHERE k <= 20),
a AS (SELECT ticker, count(*) AS articles, avg(coalesce((p - n) / nullif(p + n, 0), 0)) AS sentiment FROM n1 GROUP BY 1)
SELECT ticker, articles, {q6('sentiment')}, floor(greatest(0, least(100, CASE WHEN sentiment > 0.5 THEN 70 + 20 * sentiment WHEN sentiment < -0.5 THEN 30 - 20 * abs(sentiment) ELSE 50 + 20 * sentiment END)) * 100 + 0.5::DOUBLE) / 100 AS score,
 CASE WHEN sentiment > 0.5 THEN 'BUY' WHEN sentiment < -0.5 THEN 'SELL' ELSE 'HOLD' END AS signal, least(100, 5 * articles) AS confidence FROM a""")
def news_v1(spark, sf_dir):
    return text.news_by_ticker_v1(tables.news(spark, sf_dir)).select("ticker", "articles", *r6("sentiment"), "score", "signal", "confidence")


CALLS = "calls AS (SELECT conv_id, lower(string_agg(text, ' ' ORDER BY turn, role, text)) AS low FROM conversations GROUP BY 1)"


@query(f"""WITH {CALLS}, c AS (SELECT conv_id, {_counts(lex.CALL_POSITIVE)} AS positive, {_counts(lex.CALL_NEGATIVE)} AS negative FROM calls), r AS (SELECT *, coalesce((positive - negative) / nullif(positive + negative, 0) * 100, 0) AS raw FROM c)
SELECT conv_id, positive, negative, floor(raw * 100 + 0.5::DOUBLE) / 100 AS sentiment, CASE WHEN raw > 30 THEN 'VERY_POSITIVE' WHEN raw > 10 THEN 'POSITIVE' WHEN raw < -30 THEN 'VERY_NEGATIVE' WHEN raw < -10 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS signal FROM r""")
def earn_sentiment(spark, sf_dir):
    return text.call_sentiment(tables.transcripts(spark, sf_dir)).select("conv_id", "positive", "negative", "sentiment", "signal")


@query(f"WITH {CALLS} SELECT conv_id, CASE WHEN ({_hits(lex.GUIDANCE)}) = 0 THEN 'NOT_PROVIDED' WHEN ({_hits(lex.RAISED)}) > 0 THEN 'RAISED' WHEN ({_hits(lex.LOWERED)}) > 0 THEN 'LOWERED' ELSE 'MAINTAINED' END AS guidance FROM calls")
def earn_guidance(spark, sf_dir):
    return tables.transcripts(spark, sf_dir).select("conv_id", text.guidance(F.col("text")).alias("guidance"))


@query(f"WITH {CALLS}, t AS (" + " UNION ALL ".join(f"SELECT conv_id, '{k}' AS topic, {_counts(v)} AS n FROM calls" for k, v in lex.TOPICS.items()) + ") SELECT conv_id, topic, n FROM t WHERE n > 0")
def earn_topics(spark, sf_dir):
    return text.topics(tables.transcripts(spark, sf_dir)).select("conv_id", F.explode("topics").alias("topic", "n"))


# Options, analysts, shorts, sector, calendar


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_size / 25.0::DOUBLE END AS put_call, CAST(p_partkey * 7 % 101 AS DOUBLE) AS iv FROM part),
s AS (SELECT *, CAST(greatest(0, least(100, 50 + CASE WHEN put_call = 0 THEN 0 WHEN put_call > 1.2::DOUBLE THEN -20 WHEN put_call < 0.8::DOUBLE THEN 20 ELSE 0 END + CASE WHEN iv = 0 THEN 0 WHEN iv > 80 THEN 15 WHEN iv < 20 THEN -10 ELSE 0 END)) AS DOUBLE) AS score FROM p)
SELECT p_partkey, score, CASE WHEN put_call = 0 THEN NULL WHEN put_call > 1.2::DOUBLE THEN 'BEARISH' WHEN put_call < 0.8::DOUBLE THEN 'BULLISH' ELSE 'NEUTRAL' END AS sentiment, CASE WHEN iv = 0 THEN NULL WHEN iv > 80 THEN 'HIGH' WHEN iv < 20 THEN 'LOW' ELSE 'NORMAL' END AS iv_signal, CASE WHEN score > 60 THEN 'BULLISH_BIAS' WHEN score < 40 THEN 'BEARISH_BIAS' ELSE 'NEUTRAL' END AS bias FROM s""")
def opt_score(spark, sf_dir):
    p = tables.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 11 == 0, 0.0).otherwise(F.col("p_size") / 25.0).alias("put_call"), (F.col("p_partkey") * 7 % 101).cast("double").alias("iv_percentile"))
    return scores.options(p).select("p_partkey", "score", "sentiment", "iv_signal", "bias")


def _rated(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    s = tables.table(spark, sf_dir, "supplier").select(k, (k * 37 % 101).cast("double").alias("buy_pct"), (k * 13 % 61).cast("double").alias("sell_pct"), (k * 11 % 53 - 20).cast("double").alias("upside"), F.when(k % 3 == 0, "UPGRADING").when(k % 3 == 1, "DOWNGRADING").otherwise("STABLE").alias("trend"))
    return scores.analysts(s)


@query("""WITH s AS (SELECT s_suppkey, CAST(s_suppkey * 37 % 101 AS DOUBLE) AS buy, CAST(s_suppkey * 13 % 61 AS DOUBLE) AS sell, CAST(s_suppkey * 11 % 53 - 20 AS DOUBLE) AS up, s_suppkey % 3 AS t FROM supplier),
r AS (SELECT *, CAST(greatest(0, least(100, 50 + CASE WHEN buy = 0 THEN 0 WHEN buy > 70 THEN 40 WHEN buy > 50 THEN 30 ELSE -15 END + CASE WHEN sell > 30 THEN -30 ELSE 0 END + CASE WHEN up = 0 THEN 0 WHEN up > 20 THEN 20 WHEN up > 10 THEN 10 WHEN up < -10 THEN -20 ELSE 0 END + CASE t WHEN 0 THEN 15 WHEN 1 THEN -15 ELSE 0 END)) AS DOUBLE) AS score FROM s)
SELECT s_suppkey, score, CASE WHEN score > 65 THEN 'STRONG_BUY' WHEN score > 55 THEN 'BUY' WHEN score < 35 THEN 'SELL' WHEN score < 45 THEN 'REDUCE' ELSE 'HOLD' END AS signal FROM r""")
def analyst_score(spark, sf_dir):
    return _rated(spark, sf_dir).select("s_suppkey", "score", "signal")


@query("""WITH s AS (SELECT s_suppkey, s_suppkey * 37 % 101 AS buy, s_suppkey * 13 % 61 AS sell, s_suppkey * 11 % 53 - 20 AS up, s_suppkey % 3 AS t FROM supplier)
SELECT s_suppkey, concat_ws(',', CASE WHEN buy = 0 THEN NULL WHEN buy > 70 THEN 'buy_pct=VERY_BULLISH_CONSENSUS' WHEN buy > 50 THEN 'buy_pct=BULLISH_CONSENSUS' ELSE 'buy_pct=MIXED_CONSENSUS' END, CASE WHEN sell > 30 THEN 'sell_pct=BEARISH_CONSENSUS' END,
 CASE WHEN up > 20 THEN 'upside=HIGH_UPSIDE' WHEN up > 10 THEN 'upside=MODERATE_UPSIDE' WHEN up < -10 THEN 'upside=DOWNSIDE_RISK' END, CASE t WHEN 0 THEN 'trend=POSITIVE_MOMENTUM' WHEN 1 THEN 'trend=NEGATIVE_MOMENTUM' END) AS components FROM s""")
def analyst_components(spark, sf_dir):
    """What moved each rating, in the order of evaluation."""
    shown = F.transform(F.map_entries("components"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return _rated(spark, sf_dir).select("s_suppkey", F.concat_ws(",", shown).alias("components"))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size * 0.6::DOUBLE END AS si, CAST(p_partkey % 10 AS DOUBLE) AS dtc, CAST(p_partkey % 31 - 10 AS DOUBLE) AS mom FROM part),
s AS (SELECT *, CASE WHEN si IS NULL THEN 0 WHEN si > 25 THEN 40 WHEN si > 15 THEN 30 WHEN si > 10 THEN 20 ELSE 10 END + CASE WHEN dtc < 1 THEN 10 WHEN dtc < 3 THEN 20 WHEN dtc < 7 THEN 30 ELSE 40 END + CASE WHEN mom > 10 THEN 20 WHEN mom > 5 THEN 10 ELSE 0 END AS risk_score FROM p)
SELECT p_partkey, risk_score, CASE WHEN risk_score >= 70 THEN 'HIGH_SQUEEZE_RISK' WHEN risk_score >= 40 THEN 'MODERATE_SQUEEZE_RISK' ELSE 'LOW_SQUEEZE_RISK' END AS signal,
 concat_ws('|', CASE WHEN si > 25 THEN 'VERY_HIGH_SHORT_INTEREST' WHEN si > 15 THEN 'HIGH_SHORT_INTEREST' WHEN si > 10 THEN 'MODERATE_SHORT_INTEREST' WHEN si IS NOT NULL THEN 'LOW_SHORT_INTEREST' END, CASE WHEN dtc < 1 THEN 'VERY_EASY_COVER' WHEN dtc < 3 THEN 'EASY_COVER' WHEN dtc < 7 THEN 'MODERATE_COVER_TIME' ELSE 'DIFFICULT_COVER' END, CASE WHEN mom > 10 THEN 'STRONG_UPWARD_MOMENTUM' WHEN mom > 5 THEN 'MODERATE_UPWARD_MOMENTUM' END) AS factors FROM s""")
def short_squeeze(spark, sf_dir):
    k = F.col("p_partkey")
    p = tables.table(spark, sf_dir, "part").select(k, F.when(k % 17 != 0, F.col("p_size") * 0.6).alias("short_pct"), (k % 10).cast("double").alias("days_to_cover"), (k % 31 - 10).cast("double").alias("momentum"))
    return scores.short_squeeze(p).select("p_partkey", "risk_score", "signal", F.concat_ws("|", "factors").alias("factors"))


PEERS = f"{QUOTES}, v AS (SELECT q.*, (SELECT avg(p.trailing_pe) FROM q p WHERE p.sector = q.sector AND p.ticker <> q.ticker AND p.trailing_pe > 0) AS peer_pe FROM q), x AS (SELECT *, (trailing_pe / nullif(peer_pe, 0) - 1) * 100 AS premium FROM v)"


@query(f"WITH {PEERS} SELECT ticker, floor(peer_pe * 1000 + 0.5::DOUBLE) / 1000 AS peer_pe, floor(premium * 1000 + 0.5::DOUBLE) / 1000 AS premium, CASE WHEN premium < -15 THEN 'UNDERVALUED' WHEN premium < -5 THEN 'SLIGHT_DISCOUNT' WHEN premium < 5 THEN 'FAIRLY_VALUED' WHEN premium < 15 THEN 'SLIGHT_PREMIUM' WHEN premium IS NOT NULL THEN 'EXPENSIVE' END AS valuation FROM x")
def sector_pe(spark, sf_dir):
    return scores.peer_valuation(tables.quotes(spark, sf_dir)).select("ticker", rounded("peer_pe", 3).alias("peer_pe"), rounded("premium", 3).alias("premium"), "valuation")


@query(f"WITH {QUOTES} SELECT ticker, {q6('gross_margin', 'operating_margin', 'profit_margin')}, CAST(NULL AS DOUBLE) AS sector_average, 'REQUIRES_PARSING' AS status FROM q")
def sector_margin(spark, sf_dir):
    return tables.quotes(spark, sf_dir).select("ticker", *r6("gross_margin", "operating_margin", "profit_margin"), F.lit(None).cast("double").alias("sector_average"), F.lit("REQUIRES_PARSING").alias("status"))


@query(f"WITH {PEERS}, s AS (SELECT ticker, CAST(greatest(0, least(100, 50 + CASE WHEN premium IS NULL THEN 0 WHEN premium < -15 THEN 25 WHEN premium < 0 THEN 12 WHEN premium < 15 THEN -12 ELSE -25 END + CASE WHEN profit_margin > 0 THEN 15 WHEN profit_margin < 0 THEN -15 ELSE 0 END)) AS DOUBLE) AS attract_score FROM x) SELECT ticker, attract_score, CASE WHEN attract_score > 65 THEN 'ATTRACTIVE' WHEN attract_score > 50 THEN 'NEUTRAL' ELSE 'LESS_ATTRACTIVE' END AS attract_signal FROM s")
def sector_attract(spark, sf_dir):
    return scores.attractiveness(scores.peer_valuation(tables.quotes(spark, sf_dir))).select("ticker", "attract_score", "attract_signal")


@query("SELECT n_name AS ticker, coalesce(n, 0) AS events, CASE WHEN n > 0 THEN 'MEDIUM' ELSE 'NONE' END AS impact FROM nation LEFT JOIN (SELECT user_id % 40 AS k, count(*) AS n FROM events GROUP BY 1) ON n_nationkey = k")
def event_impact(spark, sf_dir):
    n = tables.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 40).alias("k")).agg(F.count("*").alias("n"))
    out = tables.table(spark, sf_dir, "nation").join(n, F.col("n_nationkey") == F.col("k"), "left")
    return out.select(F.col("n_name").alias("ticker"), F.coalesce("n", F.lit(0)).alias("events"), F.when(F.col("n") > 0, "MEDIUM").otherwise("NONE").alias("impact"))


# Quality and conflicts

PRICE_CASES = "CASE l_linenumber % 7 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 'infinity'::DOUBLE WHEN 3 THEN 0.001::DOUBLE ELSE l_extendedprice * 2 END"


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {PRICE_CASES} AS v, l_partkey % 9 = 0 AS odd FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws('|', CASE WHEN v IS NULL THEN 'not numeric' END, CASE WHEN NOT isnan(v) AND v < 0.01::DOUBLE THEN 'below minimum' END, CASE WHEN v IS NOT NULL AND odd THEN 'bad date' END, CASE WHEN isnan(v) THEN 'nan' END, CASE WHEN isinf(v) THEN 'infinite' END) AS errors,
 CASE WHEN NOT isnan(v) AND v > 100000 THEN 'above usual' ELSE '' END AS warnings FROM p""")
def dq_price(spark, sf_dir):
    nth = F.col("l_linenumber") % 7
    v = F.when(nth == 0, F.lit(None)).when(nth == 1, float("nan")).when(nth == 2, float("inf")).when(nth == 3, 0.001).otherwise(F.col("l_extendedprice") * 2)
    p = tables.table(spark, sf_dir, "lineitem").withColumn("v", v).withColumn("d", F.when(F.col("l_partkey") % 9 == 0, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")))
    errors, warnings = quality.price_errors(F.col("v"), F.col("d"))
    return p.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat_ws("|", errors).alias("errors"), F.concat_ws("|", warnings).alias("warnings"))


METRICS = """m AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'eps' WHEN 1 THEN 'pe_ratio' WHEN 2 THEN 'inflation' ELSE 'unknown' END AS metric, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 'nan'::DOUBLE ELSE o_totalprice / 10000 - 10 END AS value FROM orders),
l AS (SELECT * FROM (VALUES ('eps', -1000.0::DOUBLE, 1e4::DOUBLE), ('pe_ratio', 0.0, 1000.0), ('inflation', -5.0, 30.0)) t(metric, low, high)),
dq AS (SELECT o_orderkey, m.metric, CASE WHEN value IS NULL THEN 0 WHEN low IS NOT NULL AND (isnan(value) OR isinf(value)) THEN 0 ELSE 100 - CASE WHEN value < low THEN 25 ELSE 0 END - CASE WHEN value > high THEN 25 ELSE 0 END END AS quality FROM m LEFT JOIN l ON m.metric = l.metric)"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, "eps").when(k % 4 == 1, "pe_ratio").when(k % 4 == 2, "inflation").otherwise("unknown")
    value = F.when(k % 13 == 0, F.lit(None)).when(k % 17 == 0, float("nan")).otherwise(F.col("o_totalprice") / 10000 - 10)
    return quality.metric_score(tables.table(spark, sf_dir, "orders").select(k, name.alias("metric"), value.alias("value")), quality.metric_rules(spark))


@query(f"WITH {METRICS} SELECT o_orderkey, metric, quality FROM dq")
def dq_metric(spark, sf_dir):
    return _metrics(spark, sf_dir).select("o_orderkey", "metric", "quality")


@query(f"WITH {METRICS} SELECT metric, count(*) AS values, count(CASE WHEN quality = 0 THEN 1 END) AS errors, count(CASE WHEN quality BETWEEN 1 AND 99 THEN 1 END) AS warnings, floor(avg(quality) * 10 + 0.5::DOUBLE) / 10 AS quality, CASE WHEN count(CASE WHEN quality = 0 THEN 1 END) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM dq GROUP BY 1")
def dq_report(spark, sf_dir):
    q = F.col("quality")
    out = _metrics(spark, sf_dir).groupBy("metric").agg(F.count("*").alias("values"), F.count_if(q == 0).alias("errors"), F.count_if(q.between(1, 99)).alias("warnings"), rounded(F.avg(q), 1).alias("quality"))
    return out.withColumn("status", F.when(F.col("errors") > 0, "FAIL").otherwise("PASS"))


@query(f"WITH {B}, l AS (SELECT ticker, max(bar_date) AS d FROM bars GROUP BY 1), a AS (SELECT b.ticker, max(CASE WHEN bar_date = d THEN close END) AS current, count(CASE WHEN bar_date < d THEN close END) AS n, avg(CASE WHEN bar_date < d THEN close END) AS mean, stddev_pop(CASE WHEN bar_date < d THEN close END) AS std FROM bars b JOIN l USING (ticker) GROUP BY 1), z AS (SELECT *, CASE WHEN n >= 2 THEN abs(current - mean) / nullif(std, 0) END AS z FROM a) SELECT ticker, {q6('mean', 'std', 'z')}, coalesce(z > 2, false) AS anomaly, CASE WHEN z > 3 THEN 'CRITICAL' WHEN z > 2 THEN 'WARNING' ELSE 'NORMAL' END AS severity FROM z")
def dq_anomaly(spark, sf_dir):
    """The newest close against the earlier ones."""
    w = Window.partitionBy("ticker")
    prices = _bars(spark, sf_dir).withColumn("newest", F.max("bar_date").over(w))
    before = F.when(F.col("bar_date") < F.col("newest"), F.col("close"))
    stats = prices.groupBy("ticker").agg(F.max_by("close", "bar_date").alias("current"), F.count(before).alias("n"), F.avg(before).alias("mean"), F.stddev_pop(before).alias("std"))
    return quality.anomaly(stats).select("ticker", *r6("mean", "std", "z"), "anomaly", "severity")


@query(f"WITH {B} SELECT ticker, CAST(max(bar_date) AS VARCHAR) AS newest, CASE WHEN (SELECT max(bar_date) FROM bars) - max(bar_date) > 7 THEN 'STALE' ELSE 'FRESH' END AS freshness FROM bars GROUP BY 1")
def dq_freshness(spark, sf_dir):
    prices = _bars(spark, sf_dir)
    as_of = tables.as_of(spark, sf_dir)
    return prices.groupBy("ticker").agg(F.max("bar_date").alias("d")).select("ticker", F.col("d").cast("string").alias("newest"), quality.stale(F.lit(as_of), F.col("d")).alias("freshness"))


SV = "sv AS (SELECT l_partkey AS metric, l_suppkey AS source, arg_max(l_extendedprice / l_quantity, row(l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS value, CAST(max(l_shipdate) AS DATE) AS as_of FROM lineitem WHERE l_quantity <> 0 GROUP BY 1, 2)"


@query(f"WITH {SV}, g AS (SELECT metric, count(*) AS sources, min(value) AS low, max(value) AS high, CASE WHEN count(*) >= 2 THEN (max(value) - min(value)) / nullif(min(value), 0) * 100 END AS spread FROM sv GROUP BY 1) SELECT metric, sources, {q6('low', 'high', 'spread')}, CASE WHEN spread > 20 THEN 'CRITICAL' WHEN spread > 10 THEN 'WARNING' WHEN spread IS NOT NULL THEN 'MINOR' END AS severity, coalesce(spread > 10, false) AS conflict FROM g")
def cf_price(spark, sf_dir):
    return quality.price_conflict(tables.source_values(spark, sf_dir), ["metric"]).select("metric", "sources", *r6("low", "high", "spread"), "severity", "conflict")


CF = f"{SV}, g AS (SELECT metric, count(*) AS sources, avg(value) AS mean, (max(value) - min(value)) / nullif(abs(avg(value)), 0) * 100 AS spread, arg_min(source, row(-value, source)) AS largest, bool_or(source = 7) AS has FROM sv GROUP BY 1), c AS (SELECT *, CASE WHEN spread > 20 THEN 'CRITICAL' WHEN spread > 10 THEN 'WARNING' ELSE 'MINOR' END AS severity FROM g)"


@query(f"WITH {CF} SELECT metric, sources, {q6('mean', 'spread')}, severity, CASE WHEN severity = 'CRITICAL' THEN CASE WHEN has THEN 7 ELSE largest END WHEN severity = 'WARNING' AND has THEN 7 END AS recommended FROM c")
def cf_metric(spark, sf_dir):
    return quality.metric_conflict(tables.source_values(spark, sf_dir), ["metric"], 7).select("metric", "sources", *r6("mean", "spread"), "severity", F.col("recommended").cast("long").alias("recommended"))


@query(f"WITH {CF}, d AS (SELECT sv.metric, source, value, abs(value - mean) / nullif(abs(mean), 0) * 100 AS deviation FROM sv JOIN g USING (metric)) SELECT metric, source, {q6('value')}, floor(deviation * 100 + 0.5::DOUBLE) / 100 AS deviation FROM d WHERE deviation > 15")
def cf_outliers(spark, sf_dir):
    values = tables.source_values(spark, sf_dir)
    return quality.outliers(values, quality.metric_conflict(values, ["metric"]), ["metric"]).select("metric", "source", *r6("value"), "deviation")


@query(f"WITH {SV}, d AS (SELECT metric, CAST(max(as_of) - min(as_of) AS INTEGER) AS days FROM sv GROUP BY 1) SELECT metric, days, CASE WHEN days > 90 THEN 'CRITICAL' WHEN days > 30 THEN 'WARNING' ELSE 'MINOR' END AS severity, days > 30 AS stale FROM d")
def cf_stale(spark, sf_dir):
    return quality.date_conflict(tables.source_values(spark, sf_dir), ["metric"])


@query(f"WITH {CF} SELECT metric % 25 AS ticker, count(CASE WHEN severity = 'CRITICAL' THEN 1 END) AS criticals, count(CASE WHEN severity = 'WARNING' THEN 1 END) AS warnings, greatest(0, 100 - 10 * count(CASE WHEN severity = 'CRITICAL' THEN 1 END) - 5 * count(CASE WHEN severity = 'WARNING' THEN 1 END)) AS reliability, CASE WHEN count(CASE WHEN severity = 'CRITICAL' THEN 1 END) > 0 THEN 'ISSUES_FOUND' ELSE 'CLEAN' END AS status FROM c GROUP BY 1")
def cf_report(spark, sf_dir):
    found = quality.metric_conflict(tables.source_values(spark, sf_dir), ["metric"]).withColumn("ticker", F.col("metric") % 25)
    return quality.conflict_report(found, ["ticker"])


# Backtests

SPLIT = f"{B}, n AS (SELECT *, row_number() OVER {W}) AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM bars), sp AS (SELECT *, CASE WHEN rn <= floor(n * 0.8::DOUBLE)::BIGINT THEN 'train' ELSE 'test' END AS split FROM n)"
WS = "(PARTITION BY ticker, split ORDER BY bar_date"
EVAL = f"""{SPLIT}, mo AS (SELECT *, CASE WHEN count(close) OVER w = 20 THEN (close / avg(close) OVER w - 1) * 100 END AS momentum, lead(close, 5) OVER {WS}) / close - 1 AS fwd FROM sp WINDOW w AS {WS} ROWS 19 PRECEDING)),
ev AS (SELECT *, CASE WHEN momentum > 2 THEN 'BUY' WHEN momentum < -2 THEN 'SELL' ELSE 'HOLD' END AS predicted, CASE WHEN fwd > 0.02::DOUBLE THEN 'UP' WHEN fwd < -0.02::DOUBLE THEN 'DOWN' ELSE 'FLAT' END AS actual FROM mo WHERE split = 'test' AND momentum IS NOT NULL AND fwd IS NOT NULL)"""
OK = "((predicted = 'BUY' AND actual = 'UP') OR (predicted = 'SELL' AND actual = 'DOWN') OR (predicted = 'HOLD' AND actual = 'FLAT'))"


def _metrics_sql(frm: str, ok: str = OK) -> str:
    return f"""mt AS (SELECT ticker, count(*) AS periods, avg(CASE WHEN {ok} THEN 1.0::DOUBLE ELSE 0 END) * 100 AS accuracy, avg(CASE WHEN fwd > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100 AS win_rate, sum(fwd * 100) AS total_return, min(fwd * 100) AS worst, CASE WHEN count(*) > 1 AND stddev_pop(fwd * 100) > 0 THEN avg(fwd * 100) / stddev_pop(fwd * 100) * sqrt(252.0::DOUBLE) ELSE 0 END AS sharpe FROM {frm} GROUP BY 1)
SELECT ticker, periods, {q6('accuracy', 'win_rate', 'total_return', 'worst', 'sharpe')} FROM mt"""


def _metrics_out(rows: DataFrame) -> DataFrame:
    return backtest.metrics(rows).select("ticker", "periods", *r6("accuracy", "win_rate", "total_return", "worst", "sharpe"))


@query(f"WITH {EVAL} SELECT ticker, CAST(bar_date AS VARCHAR) AS bar_date, predicted, actual, {OK} AS correct, {q6('fwd')} FROM ev")
def bt_main(spark, sf_dir):
    return backtest.run(_bars(spark, sf_dir)).select("ticker", F.col("bar_date").cast("string").alias("bar_date"), "predicted", "actual", "correct", *r6("fwd"))


@query(f"WITH {EVAL}, {_metrics_sql('ev')}")
def bt_metrics(spark, sf_dir):
    return _metrics_out(backtest.run(_bars(spark, sf_dir)))


@query(f"WITH {EVAL.replace(WS, W).replace(chr(39) + 'test' + chr(39) + ' AND', 'split AND')}, {_metrics_sql('ev')}")
def bt_v1(spark, sf_dir):
    """Over all rows, without a split."""
    return _metrics_out(backtest.run_whole(_bars(spark, sf_dir)))


def _trained(trim: int) -> str:
    frm = "sp" if not trim else f"(SELECT * FROM (SELECT *, row_number() OVER {WS}) AS k, count(*) OVER (PARTITION BY ticker, split) AS m FROM sp) WHERE split = 'train' OR k <= m - {trim})"
    return f"""{SPLIT}, mo AS (SELECT *, CASE WHEN count(close) OVER w = 20 THEN (close / avg(close) OVER w - 1) * 100 END AS momentum, lead(close, 5) OVER {WS}) / close - 1 AS fwd FROM {frm} WINDOW w AS {WS} ROWS 19 PRECEDING)),
th AS (SELECT ticker, avg(momentum) + stddev_samp(momentum) AS hi, avg(momentum) - stddev_samp(momentum) AS lo FROM mo WHERE split = 'train' GROUP BY 1),
ev AS (SELECT mo.*, CASE WHEN momentum > hi THEN 'BUY' WHEN momentum < lo THEN 'SELL' ELSE 'HOLD' END AS predicted, CASE WHEN fwd > 0.02::DOUBLE THEN 'UP' WHEN fwd < -0.02::DOUBLE THEN 'DOWN' ELSE 'FLAT' END AS actual, fwd - 0.0005::DOUBLE AS net FROM mo JOIN th USING (ticker) WHERE split = 'test' AND momentum IS NOT NULL AND fwd IS NOT NULL)"""


@query(f"WITH {_trained(0)}, {_metrics_sql('ev', '((predicted = ' + chr(39) + 'BUY' + chr(39) + ' AND net > 0) OR (predicted = ' + chr(39) + 'SELL' + chr(39) + ' AND net < 0) OR (predicted = ' + chr(39) + 'HOLD' + chr(39) + ' AND abs(net) <= 0.01::DOUBLE))')}")
def bt_fixed(spark, sf_dir):
    return _metrics_out(backtest.run_fixed(_bars(spark, sf_dir)))


@query(f"WITH {_trained(5)}, {_metrics_sql('ev')}")
def bt_no_bias(spark, sf_dir):
    return _metrics_out(backtest.run_no_bias(_bars(spark, sf_dir)))


WALK = f"""{B}, n AS (SELECT *, row_number() OVER {W}) AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM bars),
wk AS (SELECT *, CAST((rn - 1) // 252 AS INTEGER) AS window_num, CASE WHEN (rn - 1) % 252 < 176 THEN 'train' ELSE 'test' END AS part FROM n WHERE ((rn - 1) // 252) * 252 < n - 252),
wm AS (SELECT *, CASE WHEN count(close) OVER w = 20 THEN (close / avg(close) OVER w - 1) * 100 END AS momentum FROM wk WINDOW w AS (PARTITION BY ticker, window_num, part ORDER BY bar_date ROWS 19 PRECEDING)),
wsc AS (SELECT *, greatest(0, least(100, 50 + 5 * coalesce(momentum, 0))) AS score FROM wm),
wa AS (SELECT ticker, window_num, avg(CASE WHEN part = 'train' THEN CASE WHEN score > 60 OR score < 40 THEN 1.0::DOUBLE ELSE 0 END END) * 100 AS train, avg(CASE WHEN part = 'test' THEN CASE WHEN score > 60 OR score < 40 THEN 1.0::DOUBLE ELSE 0 END END) * 100 AS test FROM wsc GROUP BY 1, 2),
wr AS (SELECT ticker, count(*) AS windows, avg(train) AS in_sample, avg(test) AS out_sample, stddev_pop(test) AS spread, avg(CASE WHEN train - test <= 15 THEN 1.0::DOUBLE ELSE 0 END) * 100 AS stability FROM wa GROUP BY 1),
wv AS (SELECT *, greatest(0, 100 - 5 * spread) AS consistency FROM wr),
wc AS (SELECT *, CAST(100 - CASE WHEN out_sample < 55 THEN 30 WHEN out_sample < 60 THEN 15 ELSE 0 END - CASE WHEN consistency < 60 THEN 20 ELSE 0 END - CASE WHEN stability < 70 THEN 25 ELSE 0 END AS INTEGER) AS confidence FROM wv)"""


def _walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.walk_scores(backtest.walk_windows(_bars(spark, sf_dir)))


@query(f"WITH {WALK} SELECT ticker, window_num, part, count(*) AS rows, CAST(min(bar_date) AS VARCHAR) AS first, CAST(max(bar_date) AS VARCHAR) AS last FROM wk GROUP BY 1, 2, 3")
def wf_split(spark, sf_dir):
    return backtest.walk_windows(_bars(spark, sf_dir)).groupBy("ticker", "window_num", "part").agg(F.count("*").alias("rows"), F.min("bar_date").cast("string").alias("first"), F.max("bar_date").cast("string").alias("last"))


@query(f"WITH {WALK} SELECT ticker, window_num, CAST(bar_date AS VARCHAR) AS bar_date, {q6('score')} FROM wsc WHERE part = 'test'")
def wf_score(spark, sf_dir):
    return _walk(spark, sf_dir).where("part = 'test'").select("ticker", "window_num", F.col("bar_date").cast("string").alias("bar_date"), *r6("score"))


@query(f"WITH {WALK} SELECT ticker, window_num, {q6('train', 'test')}, train - test > 15 AS overfit FROM wa")
def wf_accuracy(spark, sf_dir):
    return backtest.walk_accuracy(_walk(spark, sf_dir)).select("ticker", "window_num", *r6("train", "test"), "overfit")


@query(f"WITH {WALK} SELECT ticker, windows, {q6('in_sample', 'out_sample', 'spread', 'stability', 'consistency')}, confidence, CASE WHEN confidence = 100 THEN 'READY_FOR_LIVE' WHEN confidence > 50 THEN 'NEEDS_TUNING' ELSE 'REQUIRES_REDESIGN' END AS verdict FROM wc")
def wf_run(spark, sf_dir):
    """Summary of the windows and the verdict on how well it generalises."""
    return backtest.walk_summary(backtest.walk_accuracy(_walk(spark, sf_dir))).select("ticker", "windows", *r6("in_sample", "out_sample", "spread", "stability", "consistency"), "confidence", "verdict")


@query(f"WITH {SPLIT}, h AS (" + " UNION ALL ".join(f"SELECT ticker, {h} AS horizon, lead(close, {h}) OVER {W}) / close - 1 AS r FROM sp WHERE split = 'test' AND n >= 100" for h in (1, 5, 20, 60)) + f"), p AS (SELECT ticker, horizon, avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100 AS p_up, coalesce(avg(CASE WHEN r > 0 THEN r END), 0) * 100 AS e_ret, count(*) AS samples FROM h WHERE r IS NOT NULL GROUP BY 1, 2) SELECT ticker, horizon, {q6('p_up', 'e_ret')}, samples FROM p")
def pred_horizons(spark, sf_dir):
    return backtest.horizons(_bars(spark, sf_dir)).select("ticker", "horizon", *r6("p_up", "e_ret"), "samples")


# Combined signal

COMBINED = f"""{TECH.replace('WITH RECURSIVE', 'WITH RECURSIVE ' + NEWS + ', ' + FUND + ',', 1)},
js AS (SELECT coalesce(t.ticker, f.ticker) AS ticker, coalesce(t.score, 50) AS tech, coalesce(f.score, 50) AS fund, coalesce(n.score, 50) AS news FROM tech t FULL JOIN fund f ON t.ticker = f.ticker LEFT JOIN news n ON n.ticker = replace(coalesce(t.ticker, f.ticker), 'NATION_', 'src')),
cs AS (SELECT *, floor((0.25::DOUBLE * tech + 0.50::DOUBLE * fund + 0.25::DOUBLE * news) * 100 + 0.5::DOUBLE) / 100 AS combined FROM js),
sg AS (SELECT ticker, combined, CASE WHEN combined >= 65 THEN 'BUY' WHEN combined <= 40 THEN 'SELL' ELSE 'HOLD' END AS signal, floor(greatest(0, least(100, 0.6::DOUBLE * greatest(0, 100 - (greatest(tech, fund, news) - least(tech, fund, news))) + 0.4::DOUBLE * least(100, abs(combined - 50) / 50 * 100))) * 100 + 0.5::DOUBLE) / 100 AS agreement FROM cs)"""


@query(f"{COMBINED} SELECT ticker, combined, signal, agreement FROM sg")
def sig_result(spark, sf_dir):
    """The batch: weighted combination, final signal and agreement of each ticker."""
    return analyze(spark, sf_dir).select("ticker", "combined", "signal", "agreement")


BT, WF, PH = ("periods", "accuracy", "win_rate", "total_return", "worst", "sharpe"), ("windows", "in_sample", "out_sample", "consistency", "confidence", "verdict"), (1, 5, 20, 60)
FULL = f"""SELECT s.ticker, s.combined, s.signal, s.agreement, f.revenue, f.de_ratio, f.insiders, {', '.join(f'b.{c} AS bt_{c}' for c in BT)}, {', '.join(f'w.{c} AS wf_{c}' for c in WF)}, {', '.join(f'p.up_{h}, p.n_{h}' for h in PH)}
FROM ({ORACLE['sig_result']}) s LEFT JOIN ({ORACLE['fund_fetch']}) f ON f.ticker = s.ticker LEFT JOIN ({ORACLE['bt_metrics']}) b ON b.ticker = s.ticker LEFT JOIN ({ORACLE['wf_run']}) w ON w.ticker = s.ticker
LEFT JOIN (SELECT ticker, {', '.join(f'max(CASE WHEN horizon = {h} THEN p_up END) AS up_{h}, max(CASE WHEN horizon = {h} THEN samples END) AS n_{h}' for h in PH)} FROM ({ORACLE['pred_horizons']}) GROUP BY ticker) p ON p.ticker = s.ticker"""


def _full(batch: DataFrame) -> DataFrame:
    """The modules' main values side by side."""
    six = {"accuracy", "win_rate", "total_return", "worst", "sharpe", "in_sample", "out_sample", "consistency"}
    value = lambda m, c, name: (rounded(F.col(f"{m}.{c}")) if c in six else F.col(f"{m}.{c}")).alias(name)
    ahead = [x for h in PH for x in (rounded(F.col("prediction")[str(h)]["p_up"]).alias(f"up_{h}"), F.col("prediction")[str(h)]["samples"].alias(f"n_{h}"))]
    return batch.select("ticker", "combined", "signal", "agreement", rounded(F.col("sec.revenue")).alias("revenue"), rounded(F.col("sec.de_ratio")).alias("de_ratio"), F.col("insider.insiders").alias("insiders"), *(value("backtest", c, f"bt_{c}") for c in BT), *(value("walk_forward", c, f"wf_{c}") for c in WF), *ahead)


@query(FULL)
def sink_json_batch(spark, sf_dir):
    """All nine modules written as JSON and read back."""
    return _full(sinks.json_round_trip(full_analysis(spark, sf_dir)))


@query(f"{COMBINED} SELECT printf('%s: %s (%.2f, agreement %.2f)', ticker, signal, combined, agreement) AS line FROM sg")
def sink_text_summary(spark, sf_dir):
    return sinks.summary_lines(analyze(spark, sf_dir))


@query(f"{COMBINED} SELECT count(*) AS tickers, count(CASE WHEN signal = 'BUY' THEN 1 END) AS buys, count(CASE WHEN combined IS NULL THEN 1 END) AS errors, 'OPERATIONAL' AS health FROM sg")
def dash_status(spark, sf_dir):
    return sinks.status(analyze(spark, sf_dir))


REL = "re AS (SELECT s_suppkey, CAST(s_suppkey * 7 % 200 AS DOUBLE) AS hours, CASE s_suppkey % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' ELSE 'HOLD' END AS a, CASE s_suppkey % 2 WHEN 0 THEN 'BUY' ELSE 'HOLD' END AS b, CASE s_suppkey % 5 WHEN 0 THEN 'SELL' ELSE 'HOLD' END AS c, CAST(s_suppkey * 3 % 101 AS DOUBLE) AS acc, CAST(s_suppkey * 9 % 101 AS DOUBLE) AS tech FROM supplier), rf AS (SELECT *, CAST(CASE WHEN hours < 24 THEN 95 WHEN hours < 72 THEN 80 WHEN hours < 168 THEN 60 ELSE 30 END AS DOUBLE) AS fresh, CAST(CASE len(list_distinct([a, b, c])) WHEN 1 THEN 100 WHEN 2 THEN 70 ELSE 40 END AS DOUBLE) AS conflict, CAST(CASE WHEN acc >= 65 THEN 90 WHEN acc >= 55 THEN 75 WHEN acc >= 45 THEN 60 WHEN acc >= 35 THEN 45 ELSE 30 END AS DOUBLE) AS base FROM re), rr AS (SELECT *, floor((0.40::DOUBLE * fresh + 0.35::DOUBLE * conflict + 25) * 100 + 0.5::DOUBLE) / 100 AS reliability FROM rf), rc AS (SELECT *, floor((0.65::DOUBLE * base + 0.35::DOUBLE * reliability) * 100 + 0.5::DOUBLE) / 100 AS confidence FROM rr), v3 AS (SELECT *, floor((0.25::DOUBLE * tech + 0.55::DOUBLE * acc + 0.10::DOUBLE * reliability + 0.10::DOUBLE * confidence) * 100 + 0.5::DOUBLE) / 100 AS combined FROM rc), vs AS (SELECT *, CASE WHEN combined >= 68 THEN 'BUY' WHEN combined <= 35 THEN 'SELL' ELSE 'HOLD' END AS signal FROM v3)"


def _trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = tables.table(spark, sf_dir, "supplier").select(
        k, (k * 7 % 200).cast("double").alias("hours"), F.when(k % 3 == 0, "BUY").when(k % 3 == 1, "SELL").otherwise("HOLD").alias("tech_signal"), F.when(k % 2 == 0, "BUY").otherwise("HOLD").alias("fund_signal"),
        F.when(k % 5 == 0, "SELL").otherwise("HOLD").alias("news_signal"), (k * 3 % 101).cast("double").alias("fund"), (k * 9 % 101).cast("double").alias("tech"),
    )
    s = s.withColumn("fresh", scores.freshness("hours")).withColumn("conflict", scores.signal_conflict("tech_signal", "fund_signal", "news_signal"))
    s = s.withColumn("reliability", scores.reliability(F.col("fresh"), F.col("conflict")))
    return s.withColumn("confidence", scores.confidence(F.col("fund"), F.col("reliability")))


@query(f"WITH {REL} SELECT s_suppkey, fresh, conflict, reliability FROM rr")
def rel_score(spark, sf_dir):
    """Freshness by age, conflict by distinct signals, and their weighted score."""
    return _trust(spark, sf_dir).select("s_suppkey", "fresh", "conflict", "reliability")


@query(f"WITH {REL} SELECT s_suppkey, confidence, CASE WHEN confidence >= 70 THEN 'HIGH' WHEN confidence >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM rc")
def conf_score(spark, sf_dir):
    return _trust(spark, sf_dir).select("s_suppkey", "confidence", scores.confidence_level("confidence").alias("level"))


@query(f"WITH {REL} SELECT s_suppkey, combined, signal, floor((CAST(a = signal AS INTEGER) + CAST(b = signal AS INTEGER) + CAST(c = signal AS INTEGER)) / 3.0::DOUBLE * 100 * 100 + 0.5::DOUBLE) / 100 AS confidence_pct FROM vs")
def sig_v3(spark, sf_dir):
    return scores.signal_v3(_trust(spark, sf_dir)).select("s_suppkey", "combined", "signal", "confidence_pct")


# Calibration

GRID = "gr AS (SELECT CAST(p_size AS DOUBLE) AS param, p_size AS ordinal, avg(p_retailprice % 100) AS win, avg(p_partkey % 13) / 10 AS sharpe, avg(p_partkey % 29) AS dd FROM part GROUP BY p_size)"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return tables.table(spark, sf_dir, "part").groupBy("p_size").agg(F.avg(F.col("p_retailprice") % 100).alias("win"), (F.avg(k % 13) / 10).alias("sharpe"), F.avg(k % 29).alias("dd")).select(F.col("p_size").cast("double").alias("param"), F.col("p_size").alias("ordinal"), "win", "sharpe", "dd")


@query(f"WITH {GRID}, s AS (SELECT param, ordinal, 0.40::DOUBLE * win + 30 * sharpe + 0.5::DOUBLE * greatest(0, 20 - dd) AS score FROM gr) SELECT coalesce(arg_max(param, row(score, -ordinal)), 60) AS param, floor(max(score) * 1000000 + 0.5::DOUBLE) / 1000000 AS score FROM s")
def cal_threshold(spark, sf_dir):
    return scores.best_param(_grid(spark, sf_dir), scores.threshold_score(F.col("win"), F.col("sharpe"), F.col("dd")), 60.0).select("param", *r6("score"))


@query(f"WITH {GRID}, s AS (SELECT param, ordinal, 0.50::DOUBLE * win + 30 * sharpe - 0.5::DOUBLE * dd AS score FROM gr) SELECT coalesce(arg_max(param, row(score, -ordinal)), 5) AS param, floor(max(score) * 1000000 + 0.5::DOUBLE) / 1000000 AS score FROM s")
def cal_holding(spark, sf_dir):
    return scores.best_param(_grid(spark, sf_dir), scores.holding_score(F.col("win"), F.col("sharpe"), F.col("dd")), 5.0).select("param", *r6("score"))


@query("SELECT s_suppkey, s_acctbal * 2.0::DOUBLE / 100 AS position_limit, s_acctbal * 5.0::DOUBLE / 100 AS daily_limit, s_acctbal * 10.0::DOUBLE / 100 AS monthly_limit, 2.5::DOUBLE AS stop_loss_pct FROM supplier")
def cal_risk(spark, sf_dir):
    v = F.col("s_acctbal")
    return tables.table(spark, sf_dir, "supplier").select("s_suppkey", (v * 2.0 / 100).alias("position_limit"), (v * 5.0 / 100).alias("daily_limit"), (v * 10.0 / 100).alias("monthly_limit"), F.lit(2.5).alias("stop_loss_pct"))


@query("WITH w AS (SELECT r_name AS source, CAST(r_regionkey + 1 AS DOUBLE) AS weight FROM region) SELECT source, floor(weight / sum(weight) OVER () * 1000000 + 0.5::DOUBLE) / 1000000 AS weight FROM w")
def cal_weights(spark, sf_dir):
    w = tables.table(spark, sf_dir, "region").select(F.col("r_name").alias("source"), (F.col("r_regionkey") + 1).cast("double").alias("weight"))
    return scores.normalised_weights(w).select("source", *r6("weight"))


@query(f"""WITH {GRID}, s AS (SELECT param, 0.40::DOUBLE * win + 30 * sharpe + 0.5::DOUBLE * greatest(0, 20 - dd) AS t, 0.50::DOUBLE * win + 30 * sharpe - 0.5::DOUBLE * dd AS h, win, dd FROM gr),
r AS (SELECT *, CASE WHEN t > 50 THEN 25 ELSE 10 END + CASE WHEN h > 50 THEN 25 ELSE 10 END + CASE WHEN win > 65 THEN 25 WHEN win > 55 THEN 15 ELSE 5 END + CASE WHEN dd < 15 THEN 25 WHEN dd < 25 THEN 15 ELSE 5 END AS readiness FROM s)
SELECT param, readiness, readiness > 70 AS ready, concat_ws('|', CASE WHEN NOT t > 50 THEN 'threshold' END, CASE WHEN NOT h > 50 THEN 'holding' END, CASE WHEN NOT win > 55 THEN 'win rate' END, CASE WHEN NOT dd < 25 THEN 'drawdown' END) AS notes FROM r""")
def cal_report(spark, sf_dir):
    g = _grid(spark, sf_dir)
    args = (F.col("win"), F.col("sharpe"), F.col("dd"))
    g = g.withColumn("threshold_score", scores.threshold_score(*args)).withColumn("holding_score", scores.holding_score(*args)).withColumnRenamed("win", "win_rate").withColumnRenamed("dd", "max_drawdown")
    return scores.readiness(g).select("param", "readiness", "ready", "notes")


# Joins and streaming forms


@query(f"WITH {B}, f AS (SELECT n_name AS ticker, s_suppkey, CAST('1995-01-01' AS DATE) + CAST(s_suppkey * 37 % 2400 AS INTEGER) AS published, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey), j AS (SELECT b.ticker, b.bar_date, arg_max(f.s_acctbal, row(f.published, f.s_suppkey)) AS known FROM bars b LEFT JOIN f ON f.ticker = b.ticker AND f.published <= b.bar_date GROUP BY 1, 2) SELECT ticker, CAST(bar_date AS VARCHAR) AS bar_date, known FROM j")
def asof_publication(spark, sf_dir):
    """What was last published at each bar: union by time and the last known value, without a range join."""
    s = tables.supplier_nations(spark, sf_dir).select("ticker", F.expr("DATE '1995-01-01'").alias("d0"), "l_suppkey", F.col("s_acctbal").alias("known"))
    facts = s.select("ticker", F.date_add("d0", (F.col("l_suppkey") * 37 % 2400).cast("int")).alias("at"), F.lit(0).alias("kind"), "l_suppkey", "known")
    bars_ = _bars(spark, sf_dir).select("ticker", F.col("bar_date").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("l_suppkey"), F.lit(None).cast("double").alias("known"))
    w = Window.partitionBy("ticker").orderBy("at", "kind", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    seen = facts.unionByName(bars_).withColumn("known", F.last("known", ignorenulls=True).over(w)).where("kind = 1")
    return seen.select("ticker", F.col("at").cast("string").alias("bar_date"), "known")


@query("SELECT event_type AS ticker, CAST(date_trunc('hour', ts) AS VARCHAR) AS bar_start, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2")
def stream_bars_hourly(spark, sf_dir):
    """The batch form of the streaming bars (an extension)."""
    return stream_bars.bars(tables.table(spark, sf_dir, "events")).withColumn("bar_start", F.date_format("bar_start", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH e AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, CAST(count(*) AS BIGINT) AS sessions, CAST(sum(n) AS BIGINT) AS events, max(n) AS longest FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1""")
def stream_sessions(spark, sf_dir):
    """Sessions of each user with a gap of 30 minutes (an extension)."""
    return stream_bars.sessions(tables.table(spark, sf_dir, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"), F.max("events").alias("longest"))
