"""Variance forecasts from expanding sufficient statistics: trailing means, EWMA, HAR, rough volatility, term structures.

Inputs are daily measures keyed by symbol. Every value at a date uses rows up to that date only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.stats import fbm_constant, gated, rows_back


def _w(keys: list[str] | None = None):
    return Window.partitionBy(*(keys or ["symbol"])).orderBy("date")


def _upto(keys: list[str] | None = None):
    return _w(keys).rowsBetween(Window.unboundedPreceding, 0)


def ewma(rets: DataFrame, lam: float = 0.94, col: str = "log_ret", name: str = "ewma", chunk: int = 256) -> DataFrame:
    """Next day's variance: the recursion s <- lam s + (1 - lam) r^2 started at the mean square of all returns so far. In closed form
    lam^n mean + (1 - lam) L(n) with L(n) = sum lam^(n-i) r_i^2, for histories of any length: L is a sum of scaled squares within chunks
    of `chunk` rows plus what earlier chunks carry over, whose weights fall by lam^chunk each (those below 1e-18 add nothing to a double)."""
    r = rets.where(F.col(col).isNotNull()).withColumn("i", F.row_number().over(_w())).withColumn("q", F.col(col) * F.col(col))
    r = r.withColumn("chunk", F.floor((F.col("i") - 1) / chunk).cast("int")).withColumn("j", F.col("i") - 1 - F.col("chunk") * chunk)
    inside = Window.partitionBy("symbol", "chunk").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    # one square of a chunk is at most lam^-chunk times another's weight, which a double holds
    r = r.withColumn("part", F.pow(F.lit(lam), F.col("j")) * F.sum(F.col("q") * F.pow(F.lit(1 / lam), F.col("j"))).over(inside)).withColumn("mean", F.avg("q").over(_upto()))
    reach = max(1, math.ceil(-41.5 / (chunk * math.log(lam))))
    ends = r.groupBy("symbol", "chunk").agg(F.max_by("part", "j").alias("end"))
    back = Window.partitionBy("symbol").orderBy("chunk").rowsBetween(-reach, -1)
    ends = ends.select("symbol", "chunk", F.aggregate(F.collect_list("end").over(back), F.lit(0.0), lambda acc, x: acc * lam**chunk + x).alias("carried"))
    r = r.join(ends, ["symbol", "chunk"])
    total = F.col("part") + F.pow(F.lit(lam), F.col("j") + 1) * F.col("carried")
    return r.withColumn(name, F.pow(F.lit(lam), F.col("i")) * F.col("mean") + (1 - lam) * total).drop("q", "i", "chunk", "j", "part", "mean", "carried")


def har_pairs(m: DataFrame, h: int = 21) -> DataFrame:
    """At each row the training pair that becomes complete there: features of h rows ago and the log mean of the h rows since."""
    w = _w()
    x = m.withColumn("x1", F.log(F.when(F.col("rv_daily") > 0, F.col("rv_daily"))))
    for name, n in (("x2", 5), ("x3", 22)):
        g = gated(F.avg, F.col("rv_daily"), rows_back(["symbol"], "date", n), n)
        x = x.withColumn(name, F.log(F.when(g > 0, g)))
    back = gated(F.avg, F.col("rv_daily"), rows_back(["symbol"], "date", h), h)
    x = x.withColumn("y", F.log(F.when(back > 0, back)))
    # the row h ago needs its 22-row feature, so pairs start once there are that many rows
    return x.select("symbol", "date", "x1", "x2", "x3", "y", *[F.lag(f"x{i}", h).over(w).alias(f"p{i}") for i in (1, 2, 3)])


HAR_SUMS = {"n": "1", "s1": "p1", "s2": "p2", "s3": "p3", "s11": "p1*p1", "s12": "p1*p2", "s13": "p1*p3", "s22": "p2*p2", "s23": "p2*p3", "s33": "p3*p3", "sy": "y", "s1y": "p1*y", "s2y": "p2*y", "s3y": "p3*y", "syy": "y*y"}


def har_normal_equations(m: DataFrame, h: int = 21) -> DataFrame:
    """Running sums of the regression's cross products by date: all a refit on an expanding window needs."""
    p = har_pairs(m, h).withColumn("ok", F.col("p1").isNotNull() & F.col("p2").isNotNull() & F.col("p3").isNotNull() & F.col("y").isNotNull())
    return p.select("symbol", "date", "x1", "x2", "x3", *[F.sum(F.when(F.col("ok"), F.expr(e).cast("double"))).over(_upto()).alias(n) for n, e in HAR_SUMS.items()])


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("b0", "b1", "b2", "b3", "s2")]))
def _solve_har(s: pd.DataFrame) -> pd.DataFrame:
    v = {k: s[k].to_numpy(dtype=float) for k in HAR_SUMS}
    rows = [["n", "s1", "s2", "s3"], ["s1", "s11", "s12", "s13"], ["s2", "s12", "s22", "s23"], ["s3", "s13", "s23", "s33"]]
    a = np.stack([np.stack([v[c] for c in r], axis=-1) for r in rows], axis=1)
    b = np.stack([v[c] for c in ("sy", "s1y", "s2y", "s3y")], axis=-1)
    out = np.full((len(s), 5), np.nan)
    good = np.isfinite(a).all(axis=(1, 2)) & (v["n"] > 4)
    ag, bg = a[good], b[good]
    beta = np.einsum("nij,nj->ni", np.linalg.pinv(ag, rcond=4 * np.finfo(float).eps, hermitian=True), bg)
    rss = v["syy"][good] - np.einsum("ni,ni->n", beta, bg)
    out[good] = np.column_stack([beta, np.maximum(rss, 0.0) / (v["n"][good] - 4)])
    return pd.DataFrame(out, columns=["b0", "b1", "b2", "b3", "s2"])


def har_forecast(m: DataFrame, h: int = 21, least: int = 1000) -> DataFrame:
    """Direct-h HAR forecast with lognormal retransformation, its coefficients, residual variance, pairs used and retransformation share."""
    s = har_normal_equations(m, h).where((F.col("n") >= least) & F.col("x1").isNotNull() & F.col("x2").isNotNull() & F.col("x3").isNotNull())
    s = s.withColumn("f", _solve_har(F.struct(*HAR_SUMS)))
    fit = F.col("f.b0") + F.col("f.b1") * F.col("x1") + F.col("f.b2") * F.col("x2") + F.col("f.b3") * F.col("x3")
    return s.select("symbol", "date", F.exp(fit + F.col("f.s2") / 2).alias("v"), "f.b0", "f.b1", "f.b2", "f.b3", F.col("f.s2").alias("sigma2_resid"), (F.exp(F.col("f.s2") / 2) - 1).alias("retransform_pct"), F.col("n").cast("int").alias("n_train"))


def variogram(m: DataFrame, max_lag: int = 40) -> DataFrame:
    """Expanding mean square increment of log variance by lag (symbol, date, lag, m2). The last `max_lag` values come along in one window."""
    tail = F.collect_list("log_rv").over(_w().rowsBetween(-max_lag, -1))
    x = m.where(F.col("log_rv").isNotNull()).select("symbol", "date", "log_rv", F.reverse(tail).alias("past"))
    d = x.select("symbol", "date", F.posexplode(F.transform("past", lambda p: F.pow(F.col("log_rv") - p, F.lit(2.0)))).alias("k", "q"))
    w = Window.partitionBy("symbol", "lag").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("symbol", "date", (F.col("k") + 1).alias("lag"), "q").select("symbol", "date", "lag", F.avg("q").over(w).alias("m2"))


def hurst(vg: DataFrame, max_lag: int = 40) -> DataFrame:
    """H (half the slope of log m2 on log lag), its standard error, nu^2; rows where all lags exist."""
    y, x = F.log("m2"), F.log("lag")
    g = vg.where(F.col("m2") > 0).groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("lags"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("icept"), F.regr_r2(y, x).alias("r2"), F.regr_syy(y, x).alias("syy"), F.regr_sxx(y, x).alias("sxx"))
    g = g.where(F.col("lags") == max_lag)
    se = F.sqrt(F.greatest(F.col("syy") * (1 - F.col("r2")), F.lit(0.0)) / (F.col("lags") - 2) / F.col("sxx"))
    return g.select("symbol", "date", (F.col("slope") / 2).alias("h"), (se / 2).alias("h_se"), F.exp("icept").alias("nu2"))


def nu2_given_h(vg: DataFrame, h: float, max_lag: int = 40) -> DataFrame:
    """nu^2 with the slope pinned at 2h."""
    g = vg.where(F.col("m2") > 0).groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("lags"), F.exp(F.avg(F.log("m2") - 2 * h * F.log("lag"))).alias("nu2"))
    return g.where(F.col("lags") == max_lag).select("symbol", "date", "nu2")


def rough_points(past: np.ndarray, mean: float, var: float, h: float, nu2: float, horizon: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Forecasts for 1..horizon days from the centred log variances, latest first; the same without the lognormal correction; and how often
    the variance's cap binds."""
    h = min(max(h, 0.02), 0.49)
    u, d, a = np.arange(1.0, len(past) + 1), np.arange(1.0, horizon + 1), h + 0.5
    kernel = np.cos(np.pi * h) / np.pi * d[:, None] ** a / ((u[None, :] + d[:, None]) * u[None, :] ** a)
    raw = fbm_constant(h) * nu2 * d ** (2 * h)
    plain = mean + kernel @ past
    return np.exp(plain + np.minimum(raw, var) / 2), np.exp(plain), int((raw >= var).sum())


def rough_forecast(m: DataFrame, params: DataFrame, horizon: int = 21, reach: int = 1500) -> DataFrame:
    """Rough-volatility forecasts at the dates of `params` (symbol, date, h, nu2): mean of the points, what the lognormal correction adds, and the count of capped points. One
    task for each date gets the at most `reach` + 1 rows it weighs and the running mean and variance, so no task holds a whole history."""
    x = m.where(F.col("log_rv").isNotNull())
    x = x.select("symbol", "date", F.collect_list("log_rv").over(_w().rowsBetween(-reach, 0)).alias("tail"), F.avg("log_rv").over(_upto()).alias("mu"), F.var_samp("log_rv").over(_upto()).alias("var"))
    j = x.join(params, ["symbol", "date"])

    @F.pandas_udf("v double, retransform_pct double, capped int")
    def run(tail: pd.Series, mu: pd.Series, var: pd.Series, h: pd.Series, nu2: pd.Series) -> pd.DataFrame:
        out = []
        for t, mean, s2, h0, n2 in zip(tail, mu, var, h, nu2):
            x_ = np.asarray(t, dtype=float)
            points, plain, capped = rough_points((x_ - mean)[::-1][: min(reach, len(x_) - 1)], mean, s2, h0, n2, horizon)
            out.append((float(points.mean()), float(points.mean() / plain.mean() - 1), capped))
        return pd.DataFrame(out, columns=["v", "retransform_pct", "capped"])

    return j.withColumn("f", run("tail", "mu", "var", "h", "nu2")).select("symbol", "date", "h", "f.v", "f.retransform_pct", "f.capped")


def rough_path(m: DataFrame, params: DataFrame, horizon: int = 63, reach: int = 1500) -> DataFrame:
    """Like rough_forecast, but every day ahead: (symbol, date, h, pt)."""
    x = m.where(F.col("log_rv").isNotNull())
    x = x.select("symbol", "date", F.collect_list("log_rv").over(_w().rowsBetween(-reach, 0)).alias("tail"), F.avg("log_rv").over(_upto()).alias("mu"), F.var_samp("log_rv").over(_upto()).alias("var"))

    @F.pandas_udf("array<double>")
    def run(tail: pd.Series, mu: pd.Series, var: pd.Series, h: pd.Series, nu2: pd.Series) -> pd.Series:
        out = []
        for t, mean, s2, h0, n2 in zip(tail, mu, var, h, nu2):
            x_ = np.asarray(t, dtype=float)
            out.append(rough_points((x_ - mean)[::-1][: min(reach, len(x_) - 1)], mean, s2, h0, n2, horizon)[0].tolist())
        return pd.Series(out)

    j = x.join(params, ["symbol", "date"]).select("symbol", "date", F.posexplode(run("tail", "mu", "var", "h", "nu2")).alias("k", "pt"))
    return j.select("symbol", "date", (F.col("k") + 1).alias("h"), "pt")


def lambda_h(phi: Column, h: Column) -> Column:
    """Share of the distance to the long-run variance that is left, on average over h days."""
    return F.when(F.abs(phi - 1) < 1e-12, 1.0).otherwise((1 - F.pow(phi, h)) / (h * (1 - phi)))


def closed_form_term_structure(params: DataFrame, hmax: int = 63) -> DataFrame:
    """V(h) for h = 1..hmax from (key, sig2bar, sigma2_next, persistence) without a refit."""
    p = params.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(hmax))))
    return p.withColumn("v", F.col("sig2bar") + lambda_h(F.col("persistence"), F.col("h")) * (F.col("sigma2_next") - F.col("sig2bar")))


def running_mean_term_structure(points: DataFrame, keys: list[str]) -> DataFrame:
    """From forecasts for each day ahead (h, pt) to means over the first h days."""
    w = Window.partitionBy(*keys).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("v", F.avg("pt").over(w))



def har_daily(m: DataFrame, dates: DataFrame, h: int = 21, least: int = 1000) -> DataFrame:
    """Daily forecasts with coefficients frozen at the last refit date before or on the day, and features of the day."""
    f = har_forecast(m, h, least).join(dates.select("date"), "date", "left_semi").select("symbol", F.col("date").alias("refit"), "b0", "b1", "b2", "b3", "sigma2_resid")
    x = har_pairs(m, h).select("symbol", "date", "x1", "x2", "x3").where(F.col("x1").isNotNull() & F.col("x2").isNotNull() & F.col("x3").isNotNull())
    both = x.withColumn("at", F.col("date")).withColumn("side", F.lit(1)).unionByName(f.withColumn("at", F.col("refit")).withColumn("side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("c", F.last(F.when(F.col("side") == 0, F.struct("refit", "b0", "b1", "b2", "b3", "sigma2_resid")), ignorenulls=True).over(w)).where((F.col("side") == 1) & F.col("c").isNotNull())
    v = F.exp(F.col("c.b0") + F.col("c.b1") * F.col("x1") + F.col("c.b2") * F.col("x2") + F.col("c.b3") * F.col("x3") + F.col("c.sigma2_resid") / 2)
    return both.select("symbol", "date", F.col("c.refit").alias("refit"), v.alias("v"))
