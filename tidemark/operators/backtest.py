"""Target-volatility portfolios: sizing, the backtest in closed form, and what is measured on it.

A holding period runs from the day after a rebalance to the next rebalance day. Within it equity is w * prod(1+r) + (1-w) * prod(1+fin) times
the equity it began with, so two window products replace the day-by-day loop, for all strategies at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import kurt_corrected, skew_corrected


@dataclass(frozen=True)
class Rules:
    target: float = 0.20
    floor: float = 0.0
    cap: float = 2.0
    spread: float = 0.015
    cost: float = 0.0002
    capital: float = 100_000.0
    eval_start: str = "1996-01-02"


def sizing_weight(v: Column, rules: Rules) -> Column:
    """Target over annualised forecast, clipped; null for a null or non-positive forecast."""
    w = F.lit(rules.target) / F.sqrt(252.0 * F.when(v > 0, v))
    return F.when(w.isNotNull(), F.least(F.greatest(w, F.lit(rules.floor)), F.lit(rules.cap)))


def schedules(forecasts: DataFrame, rets: DataFrame, rules: Rules) -> DataFrame:
    """(strategy, date, w) of the forecasts (strategy, date, v) and of two benchmarks: buy and hold, and constant leverage that hits the
    target over the full sample (known only afterwards)."""
    sized = forecasts.select("strategy", "date", sizing_weight(F.col("v"), rules).alias("w")).where(F.col("w").isNotNull())
    dates = forecasts.select("date").distinct()
    k = rets.where(F.col("date") >= F.lit(rules.eval_start).cast("date")).agg((F.lit(rules.target) / (F.stddev_samp("ret") * F.sqrt(F.lit(252.0)))).alias("w"))
    hold = dates.select(F.lit("bench_buy_hold").alias("strategy"), "date", F.lit(1.0).alias("w"))
    const = dates.crossJoin(k).select(F.lit("bench_const_lev").alias("strategy"), "date", "w")
    return sized.unionByName(hold).unionByName(const)


def asof_rate(days: DataFrame, rates: DataFrame, at: str, name: str) -> DataFrame:
    """Last non-null rate at or before `at`: one union and one ordered window, no join that multiplies rows."""
    r = rates.where(F.col("rate_pct").isNotNull()).select(F.col("date").alias("_at"), F.col("rate_pct").alias("_rate"), F.lit(0).alias("_side"))
    d = days.withColumn("_at", F.col(at)).withColumn("_side", F.lit(1))
    w = Window.partitionBy(F.lit(1)).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = d.unionByName(r, allowMissingColumns=True).withColumn(name, F.last("_rate", ignorenulls=True).over(w))
    return both.where(F.col("_side") == 1).drop("_at", "_side", "_rate")


def backtest(weights: DataFrame, rets: DataFrame, rates: DataFrame, rules: Rules) -> DataFrame:
    """Daily rows: strategy, date, period, r, cash_ret, lev (drifted, before a rebalance), w_target (on rebalance days), turnover, cost
    (share of equity), equity, ret, financing, active_w (weight at the day's start)."""
    start = F.lit(rules.eval_start).cast("date")
    days = rets.where((F.col("date") >= start) & F.col("ret").isNotNull()).select("date", F.col("ret").alias("r"))
    warm = weights.where(F.col("date") < start).groupBy("strategy").agg(F.max_by("w", "date").alias("w0"), F.max("date").alias("warm_date"))
    one = Window.partitionBy(F.lit(1)).orderBy("date")
    first = weights.where(F.col("date") < start).agg(F.max("date").alias("warm"))
    d = days.crossJoin(first).withColumn("prev", F.coalesce(F.lag("date").over(one), F.col("warm"))).withColumn("dc", F.datediff("date", "prev"))
    d = asof_rate(d, rates, "prev", "rate_pct").withColumn("base", F.col("rate_pct") / 100)
    # strategies and their schedules are few: every strategy meets every day
    s = warm.select("strategy", "w0").crossJoin(d).join(weights.select("strategy", "date", F.col("w").alias("w_target")), ["strategy", "date"], "left")
    by_day = Window.partitionBy("strategy").orderBy("date")
    reb = F.col("w_target").isNotNull().cast("int")
    s = s.withColumn("period", F.coalesce(F.sum(reb).over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("w", F.coalesce(F.last("w_target", ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.col("w0")))
    s = s.withColumn("cash_ret", F.col("base") * F.col("dc") / 360).withColumn("fin", (F.col("base") + F.when(F.col("w") > 1, rules.spread).otherwise(0.0)) * F.col("dc") / 360)
    inside = Window.partitionBy("strategy", "period").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("a", F.product(1 + F.col("r")).over(inside)).withColumn("b", F.product(1 + F.col("fin")).over(inside))
    s = s.withColumn("g", F.col("w") * F.col("a") + (1 - F.col("w")) * F.col("b")).withColumn("lev", F.col("w") * F.col("a") / F.col("g"))
    s = s.withColumn("turnover", F.abs(F.col("w_target") - F.col("lev"))).withColumn("keep", F.coalesce(1 - rules.cost * F.col("turnover"), F.lit(1.0)))
    # growth of the whole periods before: their last day's factor, net of cost
    upto = by_day.rowsBetween(Window.unboundedPreceding, -1)
    closed = F.when(F.col("w_target").isNotNull(), F.col("g") * F.col("keep")).otherwise(F.lit(1.0))
    s = s.withColumn("before", F.coalesce(F.product(closed).over(upto), F.lit(1.0)))
    s = s.withColumn("gross", rules.capital * F.col("before") * F.col("g")).withColumn("equity", F.col("gross") * F.col("keep")).withColumn("cost", F.col("gross") - F.col("equity"))
    before = F.coalesce(F.lag("equity").over(by_day), F.lit(rules.capital))
    s = s.withColumn("ret", F.col("equity") / before - 1)
    active = F.coalesce(F.lag(F.coalesce("w_target", "lev")).over(by_day), F.col("w0"))
    s = s.withColumn("active_w", active).withColumn("financing", before * (1 - F.col("active_w")) * F.col("fin"))
    return s.select("strategy", "date", "dc", "period", "r", "cash_ret", "lev", "w_target", "turnover", "cost", "equity", "ret", "financing", "active_w")


def with_rolling(bt: DataFrame, n: int = 21) -> DataFrame:
    """roll: annualised n-day volatility; dd: drawdown."""
    w = Window.partitionBy("strategy").orderBy("date")
    f = w.rowsBetween(-(n - 1), 0)
    return bt.withColumn("roll", F.when(F.count("ret").over(f) == n, F.stddev_samp("ret").over(f)) * F.sqrt(F.lit(252.0))).withColumn("dd", F.col("equity") / F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)


def metrics(bt: DataFrame, rules: Rules, since: str | None = None) -> DataFrame:
    """Sixteen figures for each strategy; with `since` the drawdown's peak starts anew there."""
    if since:
        bt = bt.where(F.col("date") >= F.lit(since).cast("date"))
    x = with_rolling(bt).withColumn("ex", F.col("ret") - F.col("cash_ret"))
    first, last = F.min_by("equity", "date"), F.max_by("equity", "date")
    years = F.datediff(F.max("date"), F.min("date")) / 365.25
    vol = F.stddev_samp("ret") * F.sqrt(F.lit(252.0))
    month = F.when(F.col("lev") > 4, F.trunc("date", "MM"))
    return x.groupBy("strategy").agg(
        last.alias("final_equity"), (F.pow(last / first, 1 / years) - 1).alias("cagr"), vol.alias("realized_vol"), (vol - rules.target).alias("vol_target_gap"),
        F.avg(F.abs(F.col("roll") - rules.target)).alias("mad_roll_vol_from_target"), F.stddev_samp("roll").alias("vol_of_vol"),
        (F.avg("ex") / F.stddev_samp("ex") * F.sqrt(F.lit(252.0))).alias("sharpe_excess"), F.min("dd").alias("max_drawdown"), skew_corrected(F.col("ret")).alias("skew"), kurt_corrected(F.col("ret")).alias("kurtosis"),
        (F.sum("turnover") / years).alias("avg_annual_turnover"), (F.sum("cost") / first / years).alias("cost_drag_annual"),
        F.avg((F.col("w_target") >= rules.cap - 1e-9).cast("int")).alias("pct_months_at_cap"), F.avg("w_target").alias("mean_leverage"), F.sum("financing").alias("financing_total"),
        F.count_distinct(month).cast("int").alias("regt_breach_months"),
    )


def blocks(bt: DataFrame, n: int = 21) -> DataFrame:
    """Non-overlapping blocks of n days from each strategy's first, the incomplete tail dropped: volatility and compounded return."""
    w = Window.partitionBy("strategy").orderBy("date")
    b = bt.withColumn("block", F.floor((F.row_number().over(w) - 1) / n).cast("int"))
    g = b.groupBy("strategy", "block").agg(F.count(F.lit(1)).alias("days"), (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("bvol"), (F.product(1 + F.col("ret")) - 1).alias("bret"))
    return g.where(F.col("days") == n).drop("days")


def adherence(bt: DataFrame, rules: Rules) -> DataFrame:
    gap = F.abs(F.col("bvol") - rules.target)
    by_block = blocks(bt).groupBy("strategy").agg(
        F.avg(gap).alias("mad_nonoverlap"), F.stddev_samp("bvol").alias("vol_of_vol"), F.avg((gap <= 0.10 * rules.target).cast("int")).alias("frac_within_10pct"),
        F.avg((gap <= 0.25 * rules.target).cast("int")).alias("frac_within_25pct"), F.count(F.lit(1)).alias("n_blocks"),
    )
    vol = F.stddev_samp("ret") * F.sqrt(F.lit(252.0))
    by_day = with_rolling(bt).groupBy("strategy").agg(vol.alias("realized_vol"), (vol - rules.target).alias("vol_target_gap"), F.avg(F.abs(F.col("roll") - rules.target)).alias("mad_roll_overlap"))
    return by_day.join(by_block, "strategy")


def underwater(bt: DataFrame) -> DataFrame:
    """Runs of days below an earlier peak (by more than 1e-9): strategy, first and last day, length."""
    w = Window.partitionBy("strategy").orderBy("date")
    x = bt.withColumn("below", F.col("equity") < F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1e-9)
    x = x.withColumn("island", F.row_number().over(w) - F.row_number().over(Window.partitionBy("strategy", "below").orderBy("date")))
    return x.where("below").groupBy("strategy", "island").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count(F.lit(1)).alias("days")).drop("island")


def longest_underwater(bt: DataFrame) -> DataFrame:
    """Of each strategy the longest run, the first of equally long ones, and all days below."""
    u = underwater(bt)
    best = F.max_by(F.struct("first_day", "last_day"), F.struct(F.col("days"), -F.unix_date("first_day")))
    return u.groupBy("strategy").agg(best.alias("b"), F.max("days").alias("days_underwater_longest"), F.sum("days").alias("days_underwater_total")).select("strategy", "b.first_day", "b.last_day", "days_underwater_longest", "days_underwater_total")


def risk_return(bt: DataFrame, rules: Rules) -> DataFrame:
    x = with_rolling(bt).withColumn("ex", F.col("ret") - F.col("cash_ret"))
    first, last = F.min_by("equity", "date"), F.max_by("equity", "date")
    years = F.datediff(F.max("date"), F.min("date")) / 365.25
    cagr = F.pow(last / first, 1 / years) - 1
    q = lambda p: F.percentile("w_target", p)
    day = x.groupBy("strategy").agg(
        (F.avg("ex") * 252).alias("ann_mean_excess"), (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("ann_vol"), (F.avg("ex") / F.stddev_samp("ex") * F.sqrt(F.lit(252.0))).alias("sharpe_excess"),
        F.min("dd").alias("max_drawdown"), cagr.alias("cagr"), (cagr / F.abs(F.min("dd"))).alias("calmar"), skew_corrected(F.col("ret")).alias("skew"), kurt_corrected(F.col("ret")).alias("excess_kurtosis"),
        F.avg("w_target").alias("mean_weight"), q(0.05).alias("w_q05"), F.median("w_target").alias("w_q50"), q(0.95).alias("w_q95"),
        F.avg((F.col("w_target") >= rules.cap - 1e-9).cast("int")).alias("pct_months_at_cap"), F.avg((F.col("w_target") <= 1e-9).cast("int")).alias("pct_months_at_zero"), F.avg("turnover").alias("mean_monthly_turnover"),
        (F.sum("cost") / first / years).alias("cost_drag_annual"), F.coalesce(F.sum(F.when(F.col("financing") > 0, F.col("financing"))), F.lit(0.0)).alias("cash_credit_usd"),
        F.coalesce(F.sum(F.when(F.col("financing") < 0, F.col("financing"))), F.lit(0.0)).alias("borrow_paid_usd"),
    )
    tail = blocks(bt).groupBy("strategy").agg(F.percentile("bret", 0.05).alias("monthly_q05"), F.percentile("bret", 0.01).alias("monthly_q01"))
    water = longest_underwater(bt).select("strategy", "days_underwater_total", "days_underwater_longest")
    return day.join(tail, "strategy").join(water, "strategy", "left").na.fill(0, ["days_underwater_total", "days_underwater_longest"])


def _active(bt: DataFrame, rules: Rules) -> DataFrame:
    w = Window.partitionBy("strategy").orderBy("date")
    x = bt.withColumn("x", F.col("r") - F.col("cash_ret")).withColumn("gap", F.coalesce(F.datediff("date", F.lag("date").over(w)), F.lit(3)))
    x = x.withColumn("drag", F.greatest(F.col("active_w") - 1, F.lit(0.0)) * rules.spread * F.col("gap") / 360)
    return x.withColumn("gross_ex", F.col("active_w") * F.col("x") - F.col("drag")).withColumn("net_ex", F.col("ret") - F.col("cash_ret"))


def return_gap(bt: DataFrame, rules: Rules) -> DataFrame:
    """The excess return over buy and hold, split into market exposure, timing, financing and trading cost, with the residual."""
    x = _active(bt, rules)
    g = x.groupBy("strategy").agg(
        ((F.avg("active_w") - 1) * F.avg("x") * 252).alias("market_exposure"), (F.covar_pop("active_w", "x") * 252).alias("vol_timing"), (-F.avg("drag") * 252).alias("financing"),
        (-F.avg(F.col("gross_ex") - F.col("net_ex")) * 252).alias("transaction_cost"), (F.avg("net_ex") * 252).alias("net_ann"), (F.avg("x") * 252).alias("hold_ann"),
    )
    gap = F.col("net_ann") - F.col("hold_ann")
    return g.select("strategy", gap.alias("gap_ann"), "market_exposure", "vol_timing", "financing", "transaction_cost", (gap - F.col("market_exposure") - F.col("vol_timing") - F.col("financing") - F.col("transaction_cost")).alias("residual"))


def sharpe_decomposition(bt: DataFrame, rules: Rules) -> DataFrame:
    x = _active(bt, rules)
    root = F.sqrt(F.lit(252.0))
    g = x.groupBy("strategy").agg(
        (F.avg("net_ex") / F.stddev_samp("net_ex") * root).alias("sharpe_excess"), (F.avg("ret") / F.stddev_samp("ret") * root).alias("sharpe_total"), F.avg("active_w").alias("w_bar"),
        (F.avg("active_w") * F.avg("x") * 252).alias("term_wbar_ann"), (F.covar_pop("active_w", "x") * 252).alias("term_cov_ann"), (F.avg("drag") * 252).alias("term_drag_ann"), (F.avg("gross_ex") * 252).alias("mean_gross_ann"),
    )
    return g.withColumn("recon_residual", F.col("mean_gross_ann") - (F.col("term_wbar_ann") + F.col("term_cov_ann") - F.col("term_drag_ann")))


def subperiods(bt: DataFrame, spans: list[tuple[str, str, str]], rules: Rules, least: int = 21) -> DataFrame:
    """Adherence and Sharpe in labelled spans; spans with fewer than `least` rows are left out."""
    label = F.lit(None).cast("string")
    for name, a, b in spans:
        label = F.when(F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date")), name).otherwise(label)
    x = bt.withColumn("subperiod", label).where(F.col("subperiod").isNotNull()).withColumn("ex", F.col("ret") - F.col("cash_ret"))
    w = Window.partitionBy("subperiod", "strategy").orderBy("date")
    x = x.withColumn("block", F.floor((F.row_number().over(w) - 1) / 21))
    g = x.groupBy("subperiod", "strategy").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.trunc("date", "MM")).alias("n_months"), (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("realized_vol"), (F.avg("ex") / F.stddev_samp("ex") * F.sqrt(F.lit(252.0))).alias("sharpe_excess"))
    b = x.groupBy("subperiod", "strategy", "block").agg(F.count(F.lit(1)).alias("k"), (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("bvol")).where(F.col("k") == 21)
    b = b.groupBy("subperiod", "strategy").agg(F.avg(F.abs(F.col("bvol") - rules.target)).alias("mad_nonoverlap"))
    return g.where(F.col("n") >= least).join(b, ["subperiod", "strategy"], "left").drop("n")


def signed_adherence(bt: DataFrame, rules: Rules) -> DataFrame:
    """Signed deviation from the target, split into level and concavity (vov^2 over twice the mean)."""
    g = blocks(bt).groupBy("strategy").agg(F.avg("bvol").alias("mean_bvol"), F.sqrt(F.avg(F.col("bvol") * F.col("bvol"))).alias("rms_bvol"), F.stddev_pop("bvol").alias("vov"))
    return g.select("strategy", "mean_bvol", "rms_bvol", "vov", (F.col("mean_bvol") - rules.target).alias("signed_dev"), (F.col("rms_bvol") - rules.target).alias("level"), (-F.col("vov") * F.col("vov") / (2 * F.col("mean_bvol"))).alias("concavity"))
