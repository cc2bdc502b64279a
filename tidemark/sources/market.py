"""Market series derived from the driver's tables, as they ship no prices: daily bars, a rate series and minute bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table

TAKEOVER = "1998-01-02"
SEED, TRADED = "SEED", "TRADED"


def daily_bars(spark: SparkSession, folder: str, by: str = "status") -> DataFrame:
    """Daily bars (symbol, date, open, high, low, close, volume, n). by: `status` (a seed and a traded index) or `flag` (a panel of symbols).

    One aggregation with map-side combination over the whole of lineitem; what leaves it is a row for each symbol and day.
    """
    l = table(spark, folder, "lineitem")
    symbol = F.when(F.col("l_linestatus") == "O", SEED).otherwise(TRADED) if by == "status" else F.col("l_returnflag")
    px = l.select(
        symbol.alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), (F.lit(100.0) * F.pow(F.col("l_extendedprice") / F.col("l_quantity"), F.lit(0.003))).alias("px"), "l_quantity",
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("k"),
    )
    return px.groupBy("symbol", "date").agg(
        F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"), F.sum("l_quantity").alias("volume"), F.count(F.lit(1)).alias("n")
    )


def rates(spark: SparkSession, folder: str) -> DataFrame:
    """(date, rate_pct): a rate for most days, with gaps."""
    o = table(spark, folder, "orders")
    return o.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg((3.0 + (F.avg("o_totalprice") - 250000.0) / 50000.0).alias("rate_pct"))


def minute_bars(spark: SparkSession, folder: str) -> DataFrame:
    """(ts, ticker, price, event_id) of positive readings."""
    e = table(spark, folder, "events")
    if dict(e.dtypes)["ts"] == "timestamp_ntz":  # wall-clock times of the file are UTC, whatever the session's zone
        e = e.withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    return e.where(F.col("value") > 0).select("ts", F.col("event_type").alias("ticker"), F.col("value").alias("price"), "event_id")
