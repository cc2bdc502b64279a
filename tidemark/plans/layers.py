"""More queries of the volatility library: minute data by year, calendars, lookups, daily evaluation, term structures and checks of the fits."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import calendars, stats
from tidemark.operators import backtest as B
from tidemark.operators import evaluation as E
from tidemark.operators import fits, forecasts, intraday
from tidemark.operators import measures as M
from tidemark.plans import volatility as V
from tidemark.plans.volatility import RULES, C, add, hac_sql
from tidemark.session import cut
from tidemark.sources.tables import table

YEARS = range(1992, 2031)
#: The order in which strategies stand in tables.
ORDER = ["rv21", "rv5", "ewma", "uncond", "bench_const_lev", "bench_buy_hold"]


def _dates(days: list[dt.date]) -> str:
    """Dates as an SQL table x(day)."""
    return "SELECT DATE '1992-01-01' + CAST(unnest([" + ", ".join(str((d - dt.date(1992, 1, 1)).days) for d in days) + "]) AS INTEGER) AS day"


def _explained() -> list[dt.date]:
    """Days on which a short session is no surprise."""
    return sorted(d for y in YEARS for d in [*calendars.early_closes(y), *calendars.holidays(y)])


# ---------------------------------------------------------------- minute data
C |= {
    "sess": "SELECT *, CASE WHEN half_day THEN 210 ELSE 390 END AS expected, greatest(CASE WHEN half_day THEN 210 ELSE 390 END - minutes, 0) AS missing FROM (SELECT day, count(*) AS bars, count(DISTINCT tod) AS minutes, max(tod) < 780 AS half_day FROM mprep WHERE rth GROUP BY day)",
    "mdaily": "SELECT ticker, day, arg_min(price, row(ts, event_id)) AS open, arg_max(price, row(ts, event_id)) AS close FROM mprep GROUP BY 1, 2",
    "mcc": "SELECT *, ln(open) - ln(lag(close) OVER w) AS night, ln(close) - ln(lag(close) OVER w) AS cc FROM mdaily WINDOW w AS (PARTITION BY ticker ORDER BY day)",
    "explained": _dates(_explained()),
    "known_sessions": _dates(calendars.sessions(dt.date(1992, 1, 1), dt.date(1998, 12, 31))),
}
add("ticker_by_year", "year:i click:i view:i purchase:i", "(SELECT year(day) AS year, count_if(ticker = 'click') AS click, count_if(ticker = 'view') AS view, count_if(ticker = 'purchase') AS purchase FROM mprep GROUP BY 1)",
    lambda s, d: intraday.ticker_by_year(V._minute(s, d), ["click", "view", "purchase"]))
add("missing_by_year", "year:i sessions:i mean_missing:6", "(SELECT year(day) AS year, count(*) AS sessions, avg(missing) AS mean_missing FROM sess GROUP BY 1)", lambda s, d: intraday.missing_by_year(intraday.sessions(V._minute(s, d))))
add("unexplained_short", "day:d minutes:i expected:i", "(SELECT day, minutes, expected FROM sess WHERE minutes < 0.9 * expected AND day NOT IN (SELECT day FROM explained))",
    lambda s, d: intraday.unexplained_short(intraday.sessions(V._minute(s, d)), s.createDataFrame([(x,) for x in _explained()], "day date")))
add("signature_by_year", "k:i ticker year:i vol:6 days:i", "(SELECT k, ticker, year(day) AS year, sqrt(avg(rv) * 252) AS vol, count(*) AS days FROM mrv GROUP BY 1, 2, 3)", lambda s, d: intraday.signature_by_year(intraday.realised_variance(V._minute(s, d), V.WIDTHS, 3)))
add("against_close_to_close", "ticker full_vol:6 cc_vol:6 overnight_share:6 days:i ratio:6",
    "(SELECT *, full_vol / cc_vol AS ratio FROM (SELECT r.ticker, sqrt(avg(r.rv + c.night * c.night) * 252) AS full_vol, sqrt(var_samp(c.cc) * 252) AS cc_vol, avg(c.night * c.night) / avg(r.rv + c.night * c.night) AS overnight_share, count(*) AS days FROM mrv r JOIN mcc c ON r.ticker = c.ticker AND r.day = c.day WHERE r.k = 5 AND c.cc IS NOT NULL GROUP BY 1))",
    lambda s, d: intraday.against_close_to_close(intraday.realised_variance(V._minute(s, d), [5], 3), intraday.daily_from_minutes(V._minute(s, d))))

# ---------------------------------------------------------------- daily bars
add("mechanical_opens_by_decade", "symbol decade:i rate:8 days:i",
    "(SELECT symbol, year(date) // 10 * 10 AS decade, avg(CASE WHEN open = prev THEN 1 ELSE 0 END) AS rate, count(*) AS days FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM flagbars) WHERE prev IS NOT NULL GROUP BY 1, 2)",
    lambda s, d: V._flags(s, d).withColumn("prev", F.lag("close").over(M.ordered(["symbol"]))).where("prev IS NOT NULL").groupBy("symbol", (F.floor(F.year("date") / 10) * 10).alias("decade")).agg(F.avg((F.col("open") == F.col("prev")).cast("int")).alias("rate"), F.count(F.lit(1)).alias("days")))
add("calendar_sessions", "symbol year:i days:i sessions:i far",
    """(SELECT symbol, year, days, sessions, abs(days - sessions) > 2 AS far FROM (SELECT b.symbol, year(k.day) AS year, count(f.date) AS days, count(*) AS sessions FROM (SELECT symbol, min(date) AS a, max(date) AS z FROM flagbars GROUP BY 1) b
      JOIN known_sessions k ON k.day BETWEEN b.a AND b.z LEFT JOIN flagbars f ON f.symbol = b.symbol AND f.date = k.day GROUP BY 1, 2))""",
    lambda s, d: _calendar_sessions(V._flags(s, d), s.createDataFrame([(x,) for x in calendars.sessions(dt.date(1992, 1, 1), dt.date(1998, 12, 31))], "day date")))


def _calendar_sessions(bars: DataFrame, known: DataFrame) -> DataFrame:
    """Days with a bar among the exchange's sessions within each symbol's span, by year."""
    span = bars.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("z"))
    due = span.join(F.broadcast(known), F.col("day").between(F.col("a"), F.col("z"))).select("symbol", "day")
    j = due.join(bars.select("symbol", F.col("date").alias("day"), F.lit(1).alias("seen")), ["symbol", "day"], "left")
    return j.groupBy("symbol", F.year("day").alias("year")).agg(F.count("seen").alias("days"), F.count(F.lit(1)).alias("sessions")).withColumn("far", F.abs(F.col("days") - F.col("sessions")) > 2)


add("split_events", "symbol date:d prev:6 close:6 ratio:2 adjusted_ret:8",
    "(SELECT symbol, date, prev, close, ratio, ln(close * ratio / prev) AS adjusted_ret FROM (SELECT *, (SELECT arg_min(x, row(abs(ln(prev / close / x)), x)) FROM (SELECT unnest([2.0e0, 3.0e0, 4.0e0, 1.5e0, 0.5e0, 0.1e0]) AS x)) AS ratio FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM flagbars) WHERE abs(ln(close / prev)) > 0.012))",
    lambda s, d: intraday.split_events(V._flags(s, d), jump=0.012))
C |= {"std": "SELECT r.symbol, r.date, r.log_ret / sqrt(lag(e.ewma) OVER (PARTITION BY r.symbol ORDER BY r.date)) AS z FROM rets r JOIN ewma e ON e.symbol = r.symbol AND e.date = r.date"}
add("residual_normality", "symbol n:i skew:5 kurt:4 jb:2 p:6",
    "(SELECT *, exp(-jb / 2) AS p FROM (SELECT *, n / 6e0 * (skew * skew + kurt * kurt / 4) AS jb FROM (SELECT symbol, any_value(n) AS n, sum(pow(z - m, 3)) / any_value(n) / pow(sum(pow(z - m, 2)) / any_value(n), 1.5e0) AS skew, sum(pow(z - m, 4)) / any_value(n) / pow(sum(pow(z - m, 2)) / any_value(n), 2) - 3 AS kurt FROM (SELECT symbol, z, avg(z) OVER p AS m, count(*) OVER p AS n FROM std WHERE z IS NOT NULL WINDOW p AS (PARTITION BY symbol)) GROUP BY symbol)))",
    lambda s, d: E.normality(forecasts.ewma(M.returns(V._bars(s, d))).withColumn("z", F.col("log_ret") / F.sqrt(F.lag("ewma").over(M.ordered(["symbol"])))), "z", ["symbol"]))

# ---------------------------------------------------------------- tables and lookups
add("strategy_order", "strategy place:i final_equity:2", "(SELECT strategy, row_number() OVER (ORDER BY coalesce(nullif(list_position([" + ", ".join(f"'{x}'" for x in ORDER) + "], strategy), 0), 99), strategy) AS place, final_equity FROM metrics)",
    lambda s, d: E.canonical(B.metrics(V._bt(s, d), RULES), "strategy", ORDER))
C |= {"lookkeys": "SELECT strategy AS model FROM metrics UNION SELECT 'absent'", "fallv": "SELECT strategy AS model, avg(w) AS qlike_mean FROM weights GROUP BY 1"}
add("lookup_with_fallback", "model qlike_mean:7 origin", "(SELECT k.model, coalesce(l.qlike_mean, f.qlike_mean) AS qlike_mean, CASE WHEN l.qlike_mean IS NOT NULL THEN 'primary' WHEN f.qlike_mean IS NOT NULL THEN 'fallback' ELSE 'none' END AS origin FROM lookkeys k LEFT JOIN losst l ON l.model = k.model LEFT JOIN fallv f ON f.model = k.model)",
    lambda s, d: E.looked_up(V._bt(s, d).select(F.col("strategy").alias("model")).distinct().unionByName(s.createDataFrame([("absent",)], "model string")), E.loss_table(V._losses(s, d)),
        B.schedules(V._forecasts(s, d).withColumnRenamed("model", "strategy"), V._traded(M.returns(V._bars(s, d))), RULES).groupBy(F.col("strategy").alias("model")).agg(F.avg("w").alias("qlike_mean")), "model", "qlike_mean"))
add("path_means", "model dist n_valid:i alpha:8 beta:8 gamma:8 persistence:8", "(SELECT model, dist, count(*) AS n_valid, avg(CASE WHEN NOT isnan(alpha) THEN alpha END) AS alpha, avg(CASE WHEN NOT isnan(beta) THEN beta END) AS beta, avg(CASE WHEN NOT isnan(gamma) THEN gamma END) AS gamma, avg(CASE WHEN NOT isnan(persistence) THEN persistence END) AS persistence FROM param_paths WHERE converged GROUP BY 1, 2)",
    lambda s, d: table(s, d, "param_paths").where("converged").groupBy("model", "dist").agg(F.count(F.lit(1)).alias("n_valid"), *[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in ("alpha", "beta", "gamma", "persistence")]))
add("effective_units", "strategy block_days:i blocks:i units:i", "(SELECT strategy, block_days, blocks, blocks // (block_days // 21) AS units FROM (SELECT strategy, count(*) AS blocks FROM blocks GROUP BY 1), (SELECT unnest([42, 105, 210]) AS block_days))",
    lambda s, d: B.blocks(V._bt(s, d)).groupBy("strategy").agg(F.count(F.lit(1)).alias("blocks")).withColumn("block_days", F.explode(F.array(*map(F.lit, (42, 105, 210))))).withColumn("units", F.floor(F.col("blocks") / F.floor(F.col("block_days") / 21))))
add("undershoot_by_cap", "corr_dev_cap:6 const_dev:7 const_vov:7", f"(SELECT corr(q.signed_dev, m.pct_months_at_cap) AS corr_dev_cap, max(CASE WHEN q.strategy = 'bench_const_lev' THEN q.signed_dev END) AS const_dev, max(CASE WHEN q.strategy = 'bench_const_lev' THEN q.vov END) AS const_vov FROM signedq q JOIN metrics m ON m.strategy = q.strategy)",
    lambda s, d: B.signed_adherence(V._bt(s, d), RULES).join(B.metrics(V._bt(s, d), RULES).select("strategy", "pct_months_at_cap"), "strategy").agg(F.corr("signed_dev", "pct_months_at_cap").alias("corr_dev_cap"), *[F.max(F.when(F.col("strategy") == "bench_const_lev", F.col(c))).alias(n) for c, n in (("signed_dev", "const_dev"), ("vov", "const_vov"))]))
add("cross_layer_spearman", "pair rho:6", """(SELECT unnest(['qlike|adherence', 'qlike|sharpe']) AS pair, unnest([corr(rq, ra), corr(rq, rs)]) AS rho FROM (SELECT CAST(rank() OVER (ORDER BY qlike) AS DOUBLE) AS rq, CAST(rank() OVER (ORDER BY adherence_mad) AS DOUBLE) AS ra, CAST(rank() OVER (ORDER BY sharpe) AS DOUBLE) AS rs FROM ranksx))""",
    lambda s, d: E.spearman(V._cross(s, d).select("qlike", F.col("adherence_mad").alias("adherence"), "sharpe"), ["qlike", "adherence", "sharpe"]).where("a = 'qlike'").select(F.concat_ws("|", "a", "b").alias("pair"), "rho"))

# ---------------------------------------------------------------- daily evaluation and term structures
DAILY = ["rv21", "rv5", "uncond", "ewma"]
C |= {
    "dfc": f"""SELECT date, unnest(['rv21', 'rv5', 'uncond', 'ewma']) AS model, unnest([m.rv21, m.rv5, m.uncond, e.ewma]) AS v, m.fwd21 AS rv FROM meas m JOIN ewma e USING (symbol, date) WHERE m.symbol = 'TRADED' AND rn >= {V.LEAST} AND m.fwd21 IS NOT NULL AND m.rv21 IS NOT NULL AND m.rv5 IS NOT NULL""",
    "dql": "SELECT date, model, rv / v - ln(rv / v) - 1 AS value FROM dfc",
    "dqh": hac_sql("dql", "model", "value"),
}


def _daily(s: SparkSession, d: str) -> DataFrame:
    """(date, model, v) of the closed-form forecasts on every day with enough history."""
    m = V._traded(V._meas(s, d))
    x = M.expanding_mean(M.trailing_mean(M.trailing_mean(m, "rv_daily", 21, "rv21"), "rv_daily", 5, "rv5"), "rv_daily", "uncond").withColumn("rn", F.row_number().over(M.ordered(["symbol"])))
    x = x.join(forecasts.ewma(V._traded(M.returns(V._bars(s, d)))).select("symbol", "date", "ewma"), ["symbol", "date"]).where(F.col("rn") >= V.LEAST)
    return x.unpivot(["date"], DAILY, "model", "v")


add("daily_loss_table", "model n:i mean:8 hac_var:12 lag:i", "dqh", lambda s, d: E.hac_mean(E.losses(E.complete_cases(_daily(s, d), V._target(s, d))), ["model"], "qlike"))
add("flat_term_structures", "model date:d h:i v:10", "(SELECT model, date, h, v FROM fc, (SELECT unnest(generate_series(1, 63)) AS h) WHERE model IN ('rv21', 'ewma'))",
    lambda s, d: V._forecasts(s, d).where(F.col("model").isin("rv21", "ewma")).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(63)))))
add("secondary_frame", "date:d model v:8 rv:10", None, lambda s, d: _secondary(s, d))
add("secondary_loss_table", "model n:i mean:8 hac_var:12 lag:i", None, lambda s, d: E.hac_mean(E.losses(_secondary(s, d)), ["model"], "qlike"))


def _secondary(s: SparkSession, d: str) -> DataFrame:
    """The daily frame with the frozen-parameter forecasts and the simulated ones joined in by day."""
    r = V._traded(M.returns(V._bars(s, d)))
    eg = fits.egarch_daily(cut(fits.refit(r, V._reb(s, d), models=("egarch",), dists=("normal",), least=V.LEAST)), r).select("date", F.col("v").alias("egarch"))
    har = forecasts.har_daily(V._traded(V._meas(s, d)), V._reb(s, d), least=V.LEAST).select("date", F.col("v").alias("har"))
    wide = _daily(s, d).groupBy("date").pivot("model", DAILY).agg(F.max("v")).join(har, "date", "left").join(eg, "date", "left")
    return cut(E.complete_cases(wide.dropna(subset=["har", "egarch"]).unpivot(["date"], [*DAILY, "har", "egarch"], "model", "v"), V._target(s, d)))


def _rough_structure(s: SparkSession, d: str) -> DataFrame:
    """Rough-volatility forecasts for each day ahead and their running means, h = 1..63."""
    m = V._traded(V._meas(s, d))
    est = forecasts.hurst(forecasts.variogram(m)).select("symbol", "date", "h", "nu2").join(V._reb(s, d).select("date"), "date", "left_semi")
    points = forecasts.rough_path(m, est, 63)
    return forecasts.running_mean_term_structure(points, ["symbol", "date"])


add("rough_term_structure", "date:d h:i pt:10 v:10", None, _rough_structure)


def _har_structure(s: SparkSession, d: str) -> DataFrame:
    """Direct forecasts of the mean variance over h days, each horizon with a regression of its own."""
    m = cut(V._traded(V._meas(s, d)))
    out = None
    for h in (1, 5, 10, 21, 42, 63):
        x = forecasts.har_forecast(m, h, V.LEAST).join(V._reb(s, d).select("date"), "date", "left_semi").select("date", F.lit(h).alias("h"), "v", "n_train")
        out = x if out is None else out.unionByName(x)
    return out


add("har_term_structure", "date:d h:i v:10 n_train:i", None, _har_structure)

# ---------------------------------------------------------------- checks of the fits and the confidence sets
add("garch_level", "symbol level:8 level_without:8 change:5 flag converged", None, lambda s, d: fits.level_sensitivity(M.returns(V._bars(s, d)), "1994-10"))
add("fit_failures", "model dist fits:i failed:i carried:i no_forecast:i", None, lambda s, d: V._fits(s, d).groupBy("model", "dist").agg(F.count(F.lit(1)).alias("fits"), F.count_if(~F.col("converged")).alias("failed"), F.count_if("carried").alias("carried"), F.count_if(F.col("v21").isNull()).alias("no_forecast")))
add("retained_everywhere", "loss model sets:i kept:i in_all", None, lambda s, d: E.retained_everywhere(E.model_confidence_sets(V._losses(s, d), [2, 5, 10]), ["loss"]))
add("retained_changes", "loss a:i b:i differ", None, lambda s, d: E.retained_changes(cut(E.model_confidence_sets(V._losses(s, d), [2, 5, 10])), ["loss"]))
add("models_crisis_sets", "loss block:i model mcs_p:4 retained", None, lambda s, d: E.model_confidence_sets(E.calm(V._primary(V._model_losses(s, d)), V.CRISES), [2, 5, 10]))
add("adherence_second_seed", "block_days:i strategy point:6 ci90_lo:6 ci90_hi:6 p_best:4", None, lambda s, d: E.adherence_bootstrap(V._bt(s, d), RULES.target, [42, 105, 210], seed=1))


def _closed_against_simulated(s: SparkSession, d: str) -> DataFrame:
    """GARCH parameter rows: the closed form at 21 days against the mean of 20,000 simulated paths, in standard errors."""
    ok = "model = 'garch' AND dist = 'normal' AND NOT isnan(alpha) AND NOT isnan(beta) AND NOT isnan(sig2bar) AND alpha + beta < 0.995 AND sigma2_next > 0 AND sig2bar > 0"
    p = table(s, d, "param_paths").where(ok).groupBy("source", "date").agg(F.max_by(F.struct("param_id", "alpha", "beta", "sig2bar", "sigma2_next"), "known_at").alias("p")).where("p IS NOT NULL").select("source", "date", "p.*")
    # the last parameters of each source
    p = p.groupBy("source").agg(F.max_by(F.struct("param_id", "alpha", "beta", "sig2bar", "sigma2_next"), "date").alias("p")).select("p.*")

    def run(batches):
        import numpy as np

        for g in batches:
            rows = []
            for x in g.itertuples():
                mean, se = fits.simulate_garch_mean(x.alpha, x.beta, x.sig2bar, x.sigma2_next, 21, 20_000, np.random.default_rng(x.param_id))
                closed = fits.closed_form(x.sig2bar, x.sigma2_next, x.alpha + x.beta, 21)
                rows.append((x.param_id, closed, mean, (closed - mean) / se))
            yield pd.DataFrame(rows, columns=["param_id", "closed", "simulated", "z"])

    return p.repartition(4 * s.sparkContext.defaultParallelism, "param_id").mapInPandas(run, "param_id long, closed double, simulated double, z double")


add("closed_against_simulated", "param_id:i closed:9 simulated:9 z:4", None, _closed_against_simulated)

QUERIES: dict = {}
ORACLE: dict = {}
