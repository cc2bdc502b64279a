"""Quality checks and resampling of minute bars (ts, ticker, price, event_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import DAY_US, US, floor_div, local_micros

NEW_YORK = "America/New_York"


def prepared(minute: DataFrame, zone: str = NEW_YORK) -> DataFrame:
    """`day` and `tod` (minutes) on the clock of `zone`, `rth` for 09:30-16:00."""
    local = local_micros(F.col("ts"), zone)
    d = minute.withColumn("day", F.date_from_unix_date(floor_div(local, DAY_US).cast("int"))).withColumn("tod", floor_div(F.pmod(local, F.lit(DAY_US)), 60 * US).cast("int"))
    return d.withColumn("rth", (F.col("tod") >= 570) & (F.col("tod") < 960))


def daily_from_minutes(d: DataFrame) -> DataFrame:
    k = F.struct("ts", "event_id")
    return d.groupBy("ticker", "day").agg(F.min_by("price", k).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", k).alias("close"), F.count(F.lit(1)).alias("bars"))


def bars_per_month(d: DataFrame, thin: int = 8000) -> DataFrame:
    """Bars by month over the full range of months, empty ones as zero."""
    m = d.groupBy(F.trunc("day", "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    axis = m.agg(F.min("month").alias("a"), F.max("month").alias("z")).select(F.explode(F.expr("sequence(a, z, interval 1 month)")).alias("month"))
    return axis.join(m, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n")).withColumn("thin", F.col("n") < thin)


def sessions(d: DataFrame, full: int = 390) -> DataFrame:
    """Regular-hours bars of each day, its last minute, half days (last bar before 13:00), missing minutes."""
    s = d.where("rth").groupBy("day").agg(F.count(F.lit(1)).alias("bars"), F.count_distinct("tod").alias("minutes"), F.max("tod").alias("last_tod"))
    return s.withColumn("half_day", F.col("last_tod") < 780).withColumn("expected", F.when(F.col("half_day"), 210).otherwise(full)).withColumn("missing", F.greatest(F.col("expected") - F.col("minutes"), F.lit(0)))


def ticker_by_day_of_week(d: DataFrame, tickers: list[str]) -> DataFrame:
    """Cross-tab of bars, empty cells zero."""
    return d.groupBy(F.dayofweek("day").alias("dow")).pivot("ticker", tickers).count().na.fill(0)


def overlaps(d: DataFrame, seconds: int = 60) -> DataFrame:
    """Spans of time in which more than one ticker has bars."""
    return d.withColumn("slot", floor_div(F.unix_micros("ts"), seconds * US)).groupBy("slot").agg(F.count_distinct("ticker").alias("tickers")).where(F.col("tickers") > 1)


def last_in_slots(d: DataFrame, widths: list[int]) -> DataFrame:
    """Last price in each slot of k minutes, for all widths in one pass."""
    e = d.select("ticker", "day", "tod", "ts", "event_id", "price", F.explode(F.array(*[F.lit(k) for k in widths])).alias("k"))
    return e.groupBy("k", "ticker", "day", F.floor(F.col("tod") / F.col("k")).alias("slot")).agg(F.max_by("price", F.struct("ts", "event_id")).alias("price"))


def realised_variance(d: DataFrame, widths: list[int], least: int) -> DataFrame:
    """Sum of squared log returns between slots within a day; days with fewer than `least` slots are left out."""
    w = Window.partitionBy("k", "ticker", "day").orderBy("slot")
    s = last_in_slots(d, widths).withColumn("r", F.log("price") - F.log(F.lag("price").over(w)))
    return s.groupBy("k", "ticker", "day").agg(F.sum(F.col("r") * F.col("r")).alias("rv"), F.count(F.lit(1)).alias("slots")).where(F.col("slots") >= least)


def signature(rv: DataFrame) -> DataFrame:
    """Annualised volatility by slot width."""
    return rv.groupBy("k", "ticker").agg(F.sqrt(F.avg("rv") * 252).alias("vol"), F.count(F.lit(1)).alias("days"))


def integrity(bars: DataFrame) -> DataFrame:
    """Counts of what can't be in daily or minute bars."""
    f = {
        "nulls": "open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL", "high_below_low": "high < low", "high_below_body": "high < greatest(open, close)",
        "low_above_body": "low > least(open, close)", "not_positive": "least(open, high, low, close) <= 0", "zero_volume": "volume = 0", "flat": "high = low",
    }
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.expr(e)).alias(n) for n, e in f.items()])


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count(F.lit(1)).alias("keys"))


def split_candidates(bars: DataFrame, jump: float = 0.2, within: float = 0.15) -> DataFrame:
    """Days whose log return exceeds `jump`: implied ratio, open against the close before, and whether prices look adjusted."""
    w = Window.partitionBy("symbol").orderBy("date")
    b = bars.withColumn("prev", F.lag("close").over(w)).withColumn("r", F.log(F.col("close") / F.col("prev"))).where(F.abs("r") > jump)
    ratio = F.exp(-F.col("r"))
    seen = F.col("prev") / F.col("open")
    return b.select("symbol", "date", ratio.alias("implied"), seen.alias("observed"), F.when(F.abs(seen / ratio - 1) < within, "unadjusted").when(F.abs(seen - 1) < within, "adjusted").otherwise("inconclusive").alias("verdict"))


def ticker_by_year(d: DataFrame, tickers: list[str]) -> DataFrame:
    """Cross-tab of bars by year, empty cells zero."""
    return d.groupBy(F.year("day").alias("year")).pivot("ticker", tickers).count().na.fill(0)


def missing_by_year(s: DataFrame) -> DataFrame:
    """Of the sessions: how many by year, and their mean of missing minutes."""
    return s.groupBy(F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("sessions"), F.avg("missing").alias("mean_missing"))


def unexplained_short(s: DataFrame, explained: DataFrame, share: float = 0.9) -> DataFrame:
    """Sessions with fewer than `share` of the expected minutes that aren't among the `explained` days (early closes, holidays)."""
    short = s.where(F.col("minutes") < share * F.col("expected"))
    return short.join(explained.select(F.col("day").alias("known")), F.col("day") == F.col("known"), "left_anti").select("day", "minutes", "expected")


def signature_by_year(rv: DataFrame) -> DataFrame:
    """Annualised volatility by slot width and year."""
    return rv.groupBy("k", "ticker", F.year("day").alias("year")).agg(F.sqrt(F.avg("rv") * 252).alias("vol"), F.count(F.lit(1)).alias("days"))


def against_close_to_close(rv: DataFrame, daily: DataFrame) -> DataFrame:
    """Volatility from realised variance within the day plus the squared return over night, against that of close-to-close returns."""
    w = Window.partitionBy("ticker").orderBy("day")
    d = daily.withColumn("night", F.log("open") - F.log(F.lag("close").over(w))).withColumn("cc", F.log("close") - F.log(F.lag("close").over(w)))
    j = rv.join(d.where(F.col("cc").isNotNull()).select("ticker", "day", "night", "cc"), ["ticker", "day"]).withColumn("n2", F.col("night") * F.col("night"))
    g = j.groupBy("ticker").agg(F.sqrt(F.avg(F.col("rv") + F.col("n2")) * 252).alias("full_vol"), F.sqrt(F.var_samp("cc") * 252).alias("cc_vol"), (F.avg("n2") / F.avg(F.col("rv") + F.col("n2"))).alias("overnight_share"), F.count(F.lit(1)).alias("days"))
    return g.withColumn("ratio", F.col("full_vol") / F.col("cc_vol"))


def split_events(bars: DataFrame, jump: float = 0.2, ratios: tuple[float, ...] = (2.0, 3.0, 4.0, 1.5, 0.5, 0.1)) -> DataFrame:
    """The listing of split candidates with the nearest usual ratio and the return that is left once the close is multiplied by it."""
    w = Window.partitionBy("symbol").orderBy("date")
    b = bars.withColumn("prev", F.lag("close").over(w)).withColumn("r", F.log(F.col("close") / F.col("prev"))).where(F.abs("r") > jump)
    near = F.array_sort(F.array(*[F.struct(F.abs(F.log(F.col("prev") / F.col("close") / x)).alias("far"), F.lit(x).alias("ratio")) for x in ratios]))[0]["ratio"]
    return b.select("symbol", "date", "prev", "close", near.alias("ratio")).withColumn("adjusted_ret", F.log(F.col("close") * F.col("ratio") / F.col("prev")))
