"""Range-based variance measures of daily bars, their splice over two eras, trailing and forward windows.

Everything is keyed by symbol and ordered by date; windows count rows. Frames end at the current row, but for the forward ones, which are
for evaluation only and live in evaluation_targets.
"""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from tidemark.functions import calendars
from tidemark.functions.stats import gated, rows_back


def ordered(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("date")


def returns(bars: DataFrame) -> DataFrame:
    """Log and simple close-to-close returns; null on a symbol's first day."""
    w = ordered(["symbol"])
    prev = F.lag("close").over(w)
    return bars.withColumn("log_ret", F.log("close") - F.log(prev)).withColumn("ret", F.col("close") / prev - 1)


def daily_measures(bars: DataFrame, n: int = 21) -> DataFrame:
    """rs (Rogers-Satchell), overnight_var, rv_daily (falls back to rs on the first day, flagged), log_rv and the n-day Yang-Zhang variance."""
    if n < 2:
        raise ValueError("n must be at least 2")
    w = ordered(["symbol"])
    ho, lo, co = F.log(F.col("high") / F.col("open")), F.log(F.col("low") / F.col("open")), F.log(F.col("close") / F.col("open"))
    m = bars.withColumn("rs", ho * (ho - co) + lo * (lo - co)).withColumn("on_ret", F.log(F.col("open") / F.lag("close").over(w))).withColumn("oc_ret", co)
    m = m.withColumn("overnight_var", F.col("on_ret") * F.col("on_ret"))
    m = m.withColumn("rv_daily", F.coalesce(F.col("overnight_var") + F.col("rs"), F.col("rs"))).withColumn("overnight_is_na", F.col("overnight_var").isNull())
    m = m.withColumn("log_rv", F.log(F.when(F.col("rv_daily") > 0, F.col("rv_daily"))))
    f = rows_back(["symbol"], "date", n)
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    yz = gated(F.var_samp, F.col("on_ret"), f, n) + k * gated(F.var_samp, F.col("oc_ret"), f, n) + (1 - k) * gated(F.avg, F.col("rs"), f, n)
    return m.withColumn("yz", yz)


def trailing_mean(m: DataFrame, col: str, n: int, name: str) -> DataFrame:
    return m.withColumn(name, gated(F.avg, F.col(col), rows_back(["symbol"], "date", n), n))


def expanding_mean(m: DataFrame, col: str, name: str) -> DataFrame:
    return m.withColumn(name, F.avg(col).over(ordered(["symbol"]).rowsBetween(Window.unboundedPreceding, 0)))


def seed_scalar(seed: DataFrame, until: str) -> DataFrame:
    """One row: variance of close-to-close log returns over mean rv_daily, on the days that have both, before `until`."""
    both = seed.where((F.col("date") < F.lit(until).cast("date")) & F.col("log_ret").isNotNull() & F.col("rv_daily").isNotNull())
    return both.agg((F.var_samp("log_ret") / F.avg("rv_daily")).alias("c"))


def splice(seed: DataFrame, traded: DataFrame, scalar: DataFrame, takeover: str) -> DataFrame:
    """The seed's four variances times the scalar strictly before the takeover, the traded symbol's own from it. Each era was measured on
    its own, so no window straddles the two."""
    cols = ["overnight_var", "rs", "rv_daily", "yz"]
    at = F.lit(takeover).cast("date")
    a = seed.where(F.col("date") < at).crossJoin(scalar).select("date", F.lit("seed").alias("source"), *[(F.col(c) * F.col("c")).alias(c) for c in cols])
    b = traded.where(F.col("date") >= at).select("date", F.lit("traded").alias("source"), *cols)
    return a.unionByName(b).withColumn("log_rv", F.log(F.when(F.col("rv_daily") > 0, F.col("rv_daily"))))


def splice_returns(seed: DataFrame, traded: DataFrame, takeover: str) -> DataFrame:
    """Log returns of both eras. The traded era's returns begin within it, so no return bridges the splice."""
    at = F.lit(takeover).cast("date")
    b = returns(traded.where(F.col("date") >= at))
    a = (seed if "log_ret" in seed.columns else returns(seed)).where(F.col("date") < at)
    return a.select("date", "log_ret", F.lit("seed").alias("source")).unionByName(b.select("date", "log_ret", F.lit("traded").alias("source"))).where(F.col("log_ret").isNotNull())


def rebalance_dates(bars: DataFrame) -> DataFrame:
    """Last bar of each complete month, numbered. The last month observed is complete if a bar stands on or after its last session by the
    exchange calendar."""
    m = bars.groupBy(F.trunc("date", "MM").alias("month")).agg(F.max("date").alias("date"))
    last = m.agg(F.max("month").alias("last"), F.max("date").alias("seen")).select("last", (F.col("seen") >= last_session("last")).alias("whole"))
    w = Window.partitionBy(F.lit(1)).orderBy("month")
    return m.join(F.broadcast(last), (F.col("month") < F.col("last")) | F.col("whole")).select("date", F.row_number().over(w).alias("seq"))


@F.pandas_udf(DateType())
def last_session(month: pd.Series) -> pd.Series:
    """Last session of the month of a date."""

    def one(d: dt.date | None) -> dt.date | None:
        if d is None:
            return None
        end = dt.date(d.year + d.month // 12, d.month % 12 + 1, 1) - dt.timedelta(1)
        return calendars.sessions(end - dt.timedelta(10), end)[-1]

    known = {d: one(d) for d in set(month.dropna())}
    return month.map(known)


def mechanical_opens(bars: DataFrame) -> DataFrame:
    """Share of days by year whose open equals the close before, and the first year from which it stays below 5 %."""
    w = ordered(["symbol"])
    b = bars.withColumn("prev", F.lag("close").over(w)).where(F.col("prev").isNotNull())
    y = b.groupBy("symbol", F.year("date").alias("year")).agg(F.avg((F.col("open") == F.col("prev")).cast("int")).alias("rate"), F.count(F.lit(1)).alias("days"))
    after = Window.partitionBy("symbol").orderBy("year").rowsBetween(0, Window.unboundedFollowing)
    y = y.withColumn("clean", F.max("rate").over(after) < 0.05)
    return y.withColumn("first_clean_year", F.min(F.when(F.col("clean"), F.col("year"))).over(Window.partitionBy("symbol"))).drop("clean")
