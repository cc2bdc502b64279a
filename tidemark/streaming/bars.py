"""Structured Streaming: bars by event time with late data, and a running variance for each ticker."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bars(stream: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Open, high, low, close and count in tumbling windows over (ts, ticker, price, event_id); readings later than `late` are dropped by
    the watermark, which also bounds the state."""
    k = F.struct("ts", "event_id")
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "ticker").agg(F.min_by("price", k).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", k).alias("close"), F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), "ticker", "open", "high", "low", "close", "n")


def running_variance(stream: DataFrame, lam: float = 0.94) -> DataFrame:
    """After each micro-batch the exponentially weighted variance of log returns of every ticker that had readings in it."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, var, n = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for p in rows["price"]:
            if last is not None and last > 0 and p > 0:
                r2 = math.log(p / last) ** 2
                var = r2 if var is None else lam * var + (1 - lam) * r2
                n += 1
            last = float(p)
        state.update((last, var, n))
        yield pd.DataFrame({"ticker": [key[0]], "variance": [var], "n": [n]})

    return stream.groupBy("ticker").applyInPandasWithState(update, "ticker string, variance double, n long", "last double, variance double, n long", "update", GroupStateTimeout.NoTimeout)
