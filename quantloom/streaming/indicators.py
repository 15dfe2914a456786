"""Indicators kept as state: EMA, MACD and Wilder's RSI of each ticker, carried on bar by bar. An extension; the batch form is the measure."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FAST, SLOW, SIGNAL, CHANGES = 12, 26, 9, 14
RESULT = "ticker string, bar_date date, close double, macd double, signal_line double, histogram double, rsi double"
#: Last date and close, weighted sums and weights of the three averages, the first changes, their number, and the smoothed gain and loss.
STATE = "day date, close double, fn double, fd double, sn double, sd double, gn double, gd double, seed array<double>, u double, d double"


def _seed(changes: list[float]) -> tuple[float, float]:
    """Gain and loss after at most CHANGES + 1 changes: sums by CHANGES, and the smoothing that begins at change CHANGES."""
    u, d = sum(x for x in changes if x >= 0) / CHANGES, -sum(x for x in changes if x < 0) / CHANGES
    for x in changes[CHANGES - 1 :]:
        u, d = _smooth(u, d, x)
    return u, d


def _smooth(u: float, d: float, x: float) -> tuple[float, float]:
    return (u * (CHANGES - 1) + max(x, 0.0)) / CHANGES, (d * (CHANGES - 1) + max(-x, 0.0)) / CHANGES


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    day, close, fn, fd, sn, sd, gn, gd, seed, u, d = state.get if state.exists else (None, None, *[0.0] * 6, [], None, None)
    seed = list(seed)
    new = pd.concat(frames).dropna(subset=["bar_date", "close"]).sort_values(["bar_date", "close"]).drop_duplicates("bar_date")
    out = []
    for at, x in zip(new["bar_date"], new["close"].astype(float), strict=True):
        if day is not None and at <= day:
            continue
        a, b, c = (1 - 2.0 / (n + 1) for n in (FAST, SLOW, SIGNAL))
        fn, fd, sn, sd = fn * a + x, fd * a + 1, sn * b + x, sd * b + 1
        line = fn / fd - sn / sd
        gn, gd = gn * c + line, gd * c + 1
        if close is not None:
            if len(seed) <= CHANGES:
                seed.append(x - close)
                u, d = _seed(seed)
            else:
                u, d = _smooth(u, d, x - close)
        day, close = at, x
        out.append((key[0], at, x, line, gn / gd, line - gn / gd, 100 - 100 / (1 + u / d) if d else 50.0))
    if day is not None:
        state.update((day, close, fn, fd, sn, sd, gn, gd, seed, u, d))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])


def indicators(bars: DataFrame) -> DataFrame:
    """MACD and RSI at every new bar of a stream of ``ticker, bar_date, close``.

    A ticker's state has a fixed size whatever its history. A bar that is not later than the ticker's last one, or has a
    null date or close, changes nothing; of two bars of one day in a batch the lower close counts. Bars of one ticker must come in the order of their days.
    """
    keyed = bars.select("ticker", "bar_date", "close").groupBy("ticker")
    return keyed.applyInPandasWithState(_step, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)
