"""Sinks: keyed upserts on plain Parquet, JSON and HTML reports."""

from __future__ import annotations

import html
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both, the newest by ``order`` for each key; of equals, the new side's and then the greatest row wins. Aggregated before it is shuffled."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    top = F.max(F.struct(order, "_side", *[c for c in rest if c != order])).alias("_top")
    return both.groupBy(*keys).agg(top).select(*keys, *(F.col(f"_top.{c}").alias(c) for c in rest))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks, the first by all columns of each key."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti"))


def write_json(batch: DataFrame, path: str, *, by: str | None = None) -> None:
    """One JSON object a row; with ``by``, a folder for each of its values."""
    out = batch.write.mode("overwrite")
    (out.partitionBy(by) if by else out).json(path)


def stamped(folder: str, ticker: str, when) -> str:
    """The path of one ticker's file: its name and the time, to the second, at which it was made."""
    return f"{folder}/{ticker}_{when:%Y%m%d_%H%M%S}.json"


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share; a temporary folder in local mode where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='quantloom-sink-')}/sink-{uuid.uuid4().hex}"


def json_round_trip(batch: DataFrame, *, by: str | None = None) -> DataFrame:
    """Write the batch as JSON and read it back with its own schema: what a reader of the files gets."""
    path = scratch(batch.sparkSession)
    write_json(batch, path, by=by)
    return batch.sparkSession.read.schema(batch.schema).json(path)


def page_round_trip(page: DataFrame) -> DataFrame:
    """Write a one-column page and read it back, one row a line: ``value``."""
    path = scratch(page.sparkSession)
    done = write_page(page, path)
    if "error" in done:
        raise OSError(done["error"])
    return page.sparkSession.read.text(path)


def ticker_section(modules: list[str]) -> Column:
    """One ticker's part of the report: a heading and a row for each module with its values as JSON, ``N/A`` where it has none."""
    rows = (F.concat(F.lit(f"<tr><th>{html.escape(m)}</th><td>"), F.coalesce(escaped(F.to_json(m)), F.lit("N/A")), F.lit("</td></tr>")) for m in modules)
    return F.concat(F.lit("<section><h2>"), escaped(F.col("ticker")), F.lit("</h2><p>"), escaped(F.col("signal")), F.lit(" "), F.format_number("combined", 2), F.lit("</p><table>"), *rows, F.lit("</table></section>"))


def write_report(batch: DataFrame, modules: list[str], path: str) -> dict[str, str]:
    """The report as HTML files of sections, a line each, formatted and written by the executors: ``{path}``, or ``{error}``."""
    try:
        batch.select(ticker_section(modules).alias("value")).write.mode("overwrite").text(path)
    except Exception as e:  # noqa: BLE001 - the caller gets the reason, as for any report
        return {"error": str(e).splitlines()[0]}
    return {"path": path}


def summary_lines(batch: DataFrame) -> DataFrame:
    """``line``: one text line a ticker."""
    return batch.select(F.format_string("%s: %s (%.2f, agreement %.2f)", "ticker", "signal", "combined", "agreement").alias("line"))


def html_report(batch: DataFrame, *, title: str = "Daily signals", most: int = 10_000) -> str:
    """A table of at most ``most`` tickers, formatted on the driver; a larger batch is refused, not cut."""
    rows = batch.orderBy("ticker").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for one page; write JSON instead")
    head = "".join(f"<th>{html.escape(c)}</th>" for c in batch.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>"


def status(batch: DataFrame) -> DataFrame:
    """``tickers``, ``buys``, ``errors`` and ``health``: OPERATIONAL, or DEGRADED when empty."""
    return batch.agg(F.count("*").alias("tickers"), F.count_if(F.col("signal") == "BUY").alias("buys"), F.count_if(F.col("combined").isNull()).alias("errors")).withColumn("health", F.when(F.col("tickers") > 0, "OPERATIONAL").otherwise("DEGRADED"))


def escaped(x: Column) -> Column:
    """Text for HTML: the five special characters as entities."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(plain), F.lit(entity))
    return x


def html_row(*cells: Column) -> Column:
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), F.coalesce(escaped(c), F.lit("")), F.lit("</td>")) for c in cells), F.lit("</tr>"))


def write_page(page: DataFrame, path: str) -> dict[str, str]:
    """Write the single text column of ``page`` below ``path``: ``{path}``, or ``{error}`` where that fails."""
    try:
        page.coalesce(1).write.mode("overwrite").text(path)
    except Exception as e:  # noqa: BLE001 - the caller gets the reason, as for any report
        return {"error": str(e).splitlines()[0]}
    return {"path": path}
