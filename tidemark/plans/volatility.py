"""Queries of the volatility library's own operators over the driver's tables, each with its DuckDB counterpart where SQL expresses it."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import calendars, stats
from tidemark.operators import backtest as B
from tidemark.operators import evaluation as E
from tidemark.operators import fits, forecasts, intraday
from tidemark.operators import measures as M
from tidemark.operators.evaluation_targets import forward_mean, forward_value
from tidemark.plans.shape import shaped, shaped_sql
from tidemark.session import cut
from tidemark.sources import files, market
from tidemark.sources.tables import table

RULES = B.Rules()
#: Rows a forecast needs; the operators' own gate is 1,000, but the derived series have some 1,260 days in all.
LEAST = 250
WIDTHS = [1, 2, 3, 5, 10, 15, 20, 30]
SPANS = [("1996-1997", "1996-01-01", "1997-12-31"), ("1998", "1998-01-01", "1998-12-31"), ("1999-2001", "1999-01-01", "2001-12-31")]
CRISES = [("1997-07-01", "1997-12-31"), ("1998-08-01", "1998-10-31")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------- SQL building blocks, in order of dependence
_W = "(PARTITION BY symbol ORDER BY date)"
_BARS = """SELECT symbol, date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(l_quantity) AS volume, count(*) AS n
  FROM (SELECT {symbol} AS symbol, CAST(l_shipdate AS DATE) AS date, 100e0 * pow(l_extendedprice / l_quantity, 0.003e0) AS px, l_quantity,
    row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k FROM lineitem) GROUP BY symbol, date"""
#: The exchange's sessions in the years of the data, as the calendar's rules give them.
_SESSIONS = "SELECT DATE '1992-01-01' + CAST(unnest([" + ", ".join(str((x - dt.date(1992, 1, 1)).days) for x in calendars.sessions(dt.date(1992, 1, 1), dt.date(1998, 12, 31))) + "]) AS INTEGER) AS x"
C: dict[str, str] = {
    "bars": _BARS.format(symbol="CASE WHEN l_linestatus = 'O' THEN 'SEED' ELSE 'TRADED' END"),
    "flagbars": _BARS.format(symbol="l_returnflag"),
    "rates": "SELECT CAST(o_orderdate AS DATE) AS date, 3 + (avg(o_totalprice) - 250000) / 50000 AS rate_pct FROM orders GROUP BY 1",
    "rets": f"SELECT *, ln(close) - ln(lag(close) OVER {_W}) AS log_ret, close / lag(close) OVER {_W} - 1 AS ret FROM bars",
    "flagrets": f"SELECT *, ln(close) - ln(lag(close) OVER {_W}) AS log_ret, close / lag(close) OVER {_W} - 1 AS ret FROM flagbars",
    "meas0": f"SELECT *, ln(high / open) AS ho, ln(low / open) AS lo, ln(close / open) AS oc_ret, ln(open / lag(close) OVER {_W}) AS on_ret FROM rets",
    "meas1": "SELECT *, ho * (ho - oc_ret) + lo * (lo - oc_ret) AS rs, on_ret * on_ret AS overnight_var FROM meas0",
    "meas2": "SELECT *, coalesce(overnight_var + rs, rs) AS rv_daily, overnight_var IS NULL AS overnight_is_na FROM meas1",
    "meas3": f"""SELECT *, CASE WHEN rv_daily > 0 THEN ln(rv_daily) END AS log_rv,
      CASE WHEN count(on_ret) OVER w = 21 THEN var_samp(on_ret) OVER w + {0.34 / (1.34 + 22 / 20)!r} * var_samp(oc_ret) OVER w + {1 - 0.34 / (1.34 + 22 / 20)!r} * avg(rs) OVER w END AS yz
      FROM meas2 WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""",
    "meas": """SELECT *, row_number() OVER s AS rn, CASE WHEN count(rv_daily) OVER w21 = 21 THEN avg(rv_daily) OVER w21 END AS rv21, CASE WHEN count(rv_daily) OVER w5 = 5 THEN avg(rv_daily) OVER w5 END AS rv5,
      avg(rv_daily) OVER ex AS uncond, CASE WHEN count(rv_daily) OVER f21 = 21 THEN avg(rv_daily) OVER f21 END AS fwd21, lead(yz, 21) OVER s AS fwd_yz, CASE WHEN count(rv_daily) OVER w22 = 22 THEN avg(rv_daily) OVER w22 END AS rv22
      FROM meas3 WINDOW s AS (PARTITION BY symbol ORDER BY date), w21 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), w22 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 21 PRECEDING AND CURRENT ROW),
      w5 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ex AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      f21 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING)""",
    "ewma": """SELECT symbol, date, pow(0.94e0, i) * avg(q) OVER w + 0.06e0 * pow(0.94e0, i) * sum(q * pow(1 / 0.94e0, i)) OVER w AS ewma
      FROM (SELECT symbol, date, log_ret * log_ret AS q, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM rets WHERE log_ret IS NOT NULL)
      WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "scalar": f"SELECT var_samp(log_ret) / avg(rv_daily) AS c FROM meas WHERE symbol = 'SEED' AND date < DATE '{market.TAKEOVER}' AND log_ret IS NOT NULL AND rv_daily IS NOT NULL",
    "panel": f"""SELECT date, 'seed' AS source, overnight_var * c AS overnight_var, rs * c AS rs, rv_daily * c AS rv_daily, yz * c AS yz FROM meas, scalar WHERE symbol = 'SEED' AND date < DATE '{market.TAKEOVER}'
      UNION ALL SELECT date, 'traded', overnight_var, rs, rv_daily, yz FROM meas WHERE symbol = 'TRADED' AND date >= DATE '{market.TAKEOVER}'""",
    "spliced": f"""SELECT date, log_ret, 'seed' AS source FROM rets WHERE symbol = 'SEED' AND date < DATE '{market.TAKEOVER}' AND log_ret IS NOT NULL
      UNION ALL SELECT date, log_ret, 'traded' FROM (SELECT date, ln(close) - ln(lag(close) OVER (ORDER BY date)) AS log_ret FROM bars WHERE symbol = 'TRADED' AND date >= DATE '{market.TAKEOVER}') WHERE log_ret IS NOT NULL""",
    "reb": f"SELECT date, row_number() OVER (ORDER BY date) AS seq FROM (SELECT date_trunc('month', date) AS m, max(date) AS date, max(date_trunc('month', max(date))) OVER () AS z FROM bars WHERE symbol = 'TRADED' GROUP BY 1) WHERE m < z OR date >= (SELECT max(x) FROM ({_SESSIONS}) WHERE date_trunc('month', x) = m)",
    "fc": f"""SELECT model, date, v FROM (SELECT 'rv21' AS model, m.date, m.rv21 AS v FROM meas m JOIN reb r ON m.date = r.date WHERE symbol = 'TRADED' AND rn >= {LEAST} UNION ALL SELECT 'rv5', m.date, m.rv5 FROM meas m JOIN reb r ON m.date = r.date WHERE symbol = 'TRADED' AND rn >= {LEAST}
      UNION ALL SELECT 'uncond', m.date, m.uncond FROM meas m JOIN reb r ON m.date = r.date WHERE symbol = 'TRADED' AND rn >= {LEAST} UNION ALL SELECT 'ewma', e.date, e.ewma FROM ewma e JOIN reb r ON e.date = r.date JOIN meas m ON m.symbol = e.symbol AND m.date = e.date WHERE e.symbol = 'TRADED' AND rn >= {LEAST})""",
    "weights": f"""SELECT model AS strategy, date, least(greatest({RULES.target} / sqrt(252 * v), {RULES.floor}), {RULES.cap}) AS w FROM fc WHERE v > 0
      UNION ALL SELECT 'bench_buy_hold', date, 1.0 FROM (SELECT DISTINCT date FROM fc)
      UNION ALL SELECT 'bench_const_lev', date, (SELECT {RULES.target} / (stddev_samp(ret) * sqrt(252)) FROM rets WHERE symbol = 'TRADED' AND date >= DATE '{RULES.eval_start}') FROM (SELECT DISTINCT date FROM fc)""",
    "warm": f"SELECT strategy, arg_max(w, date) AS w0 FROM weights WHERE date < DATE '{RULES.eval_start}' GROUP BY strategy",
    "days0": f"SELECT date, ret AS r, coalesce(lag(date) OVER (ORDER BY date), (SELECT max(date) FROM weights WHERE date < DATE '{RULES.eval_start}')) AS prev FROM rets WHERE symbol = 'TRADED' AND date >= DATE '{RULES.eval_start}' AND ret IS NOT NULL",
    "days": "SELECT d.date, d.r, d.prev, date_diff('day', d.prev, d.date) AS dc, x.rate_pct / 100 AS base FROM days0 d ASOF LEFT JOIN rates x ON d.prev >= x.date",
    "s1": """SELECT m.strategy, m.w0, d.*, t.w AS w_target FROM warm m CROSS JOIN days d LEFT JOIN weights t ON t.strategy = m.strategy AND t.date = d.date""",
    "s2": """SELECT *, coalesce(sum(CASE WHEN w_target IS NOT NULL THEN 1 ELSE 0 END) OVER u, 0) AS period, coalesce(last_value(w_target IGNORE NULLS) OVER u, w0) AS w
      FROM s1 WINDOW u AS (PARTITION BY strategy ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "s3": f"SELECT *, base * dc / 360 AS cash_ret, (base + CASE WHEN w > 1 THEN {RULES.spread} ELSE 0 END) * dc / 360 AS fin FROM s2",
    "s4": "SELECT *, product(1 + r) OVER p AS a, product(1 + fin) OVER p AS b FROM s3 WINDOW p AS (PARTITION BY strategy, period ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "s5": "SELECT *, w * a + (1 - w) * b AS g, w * a / (w * a + (1 - w) * b) AS lev FROM s4",
    "s6": f"SELECT *, abs(w_target - lev) AS turnover, coalesce(1 - {RULES.cost} * abs(w_target - lev), 1.0) AS keep FROM s5",
    "s7": "SELECT *, coalesce(product(CASE WHEN w_target IS NOT NULL THEN g * keep ELSE 1 END) OVER (PARTITION BY strategy ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS before FROM s6",
    "s8": f"SELECT *, {RULES.capital} * before * g AS gross, {RULES.capital} * before * g * keep AS equity FROM s7",
    "bt": f"""SELECT *, gross - equity AS cost, equity / coalesce(lag(equity) OVER u, {RULES.capital}) - 1 AS ret, coalesce(lag(coalesce(w_target, lev)) OVER u, w0) AS active_w,
      coalesce(lag(equity) OVER u, {RULES.capital}) * (1 - coalesce(lag(coalesce(w_target, lev)) OVER u, w0)) * fin AS financing FROM s8 WINDOW u AS (PARTITION BY strategy ORDER BY date)""",
    "roll": """SELECT *, ret - cash_ret AS ex, CASE WHEN count(ret) OVER f = 21 THEN stddev_samp(ret) OVER f * sqrt(252) END AS roll, equity / max(equity) OVER u - 1 AS dd, max(equity) OVER u AS peak, row_number() OVER o AS rn
      FROM bt WINDOW f AS (PARTITION BY strategy ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), u AS (PARTITION BY strategy ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), o AS (PARTITION BY strategy ORDER BY date)""",
    "metrics": f"""SELECT strategy, arg_max(equity, date) AS final_equity, pow(arg_max(equity, date) / arg_min(equity, date), 1 / (date_diff('day', min(date), max(date)) / 365.25e0)) - 1 AS cagr,
      stddev_samp(ret) * sqrt(252) AS realized_vol, stddev_samp(ret) * sqrt(252) - {RULES.target} AS vol_target_gap, avg(abs(roll - {RULES.target})) AS mad_roll_vol_from_target, stddev_samp(roll) AS vol_of_vol,
      avg(ex) / stddev_samp(ex) * sqrt(252) AS sharpe_excess, min(dd) AS max_drawdown, skewness(ret) AS skew, kurtosis(ret) AS kurtosis, sum(turnover) / (date_diff('day', min(date), max(date)) / 365.25e0) AS avg_annual_turnover,
      sum(cost) / arg_min(equity, date) / (date_diff('day', min(date), max(date)) / 365.25e0) AS cost_drag_annual, avg(CASE WHEN w_target >= {RULES.cap - 1e-9!r} THEN 1 WHEN w_target IS NOT NULL THEN 0 END) AS pct_months_at_cap,
      avg(CASE WHEN w_target <= 1e-9 THEN 1 WHEN w_target IS NOT NULL THEN 0 END) AS pct_months_at_zero, avg(w_target) AS mean_leverage, sum(financing) AS financing_total, count(DISTINCT CASE WHEN lev > 4 THEN date_trunc('month', date) END) AS regt_breach_months,
      avg(ex) * 252 AS ann_mean_excess, quantile_cont(w_target, 0.05) AS w_q05, median(w_target) AS w_q50, quantile_cont(w_target, 0.95) AS w_q95, avg(turnover) AS mean_monthly_turnover,
      coalesce(sum(CASE WHEN financing > 0 THEN financing END), 0) AS cash_credit_usd, coalesce(sum(CASE WHEN financing < 0 THEN financing END), 0) AS borrow_paid_usd FROM roll GROUP BY strategy""",
    "blocks": "SELECT strategy, (rn - 1) // 21 AS block, stddev_samp(ret) * sqrt(252) AS bvol, product(1 + ret) - 1 AS bret FROM roll GROUP BY 1, 2 HAVING count(*) = 21",
    "adherence": f"""SELECT m.strategy, m.realized_vol, m.vol_target_gap, m.mad_roll_vol_from_target AS mad_roll_overlap, b.* EXCLUDE (strategy) FROM metrics m JOIN
      (SELECT strategy, avg(abs(bvol - {RULES.target})) AS mad_nonoverlap, stddev_samp(bvol) AS vol_of_vol, avg(CASE WHEN abs(bvol - {RULES.target}) <= {0.10 * RULES.target!r} THEN 1 ELSE 0 END) AS frac_within_10pct,
       avg(CASE WHEN abs(bvol - {RULES.target}) <= {0.25 * RULES.target!r} THEN 1 ELSE 0 END) AS frac_within_25pct, count(*) AS n_blocks FROM blocks GROUP BY strategy) b ON m.strategy = b.strategy""",
    "below": "SELECT strategy, date, equity < peak - 1e-9 AS below, rn - row_number() OVER (PARTITION BY strategy, equity < peak - 1e-9 ORDER BY date) AS island FROM roll",
    "islands": "SELECT strategy, min(date) AS first_day, max(date) AS last_day, count(*) AS days FROM below WHERE below GROUP BY strategy, island",
    "longest": "SELECT strategy, arg_max(first_day, row(days, -epoch(first_day))) AS first_day, arg_max(last_day, row(days, -epoch(first_day))) AS last_day, max(days) AS days_underwater_longest, sum(days) AS days_underwater_total FROM islands GROUP BY strategy",
    "riskret": """SELECT m.* EXCLUDE (kurtosis), m.kurtosis AS excess_kurtosis, m.realized_vol AS ann_vol, m.cagr / abs(m.max_drawdown) AS calmar, m.mean_leverage AS mean_weight, t.monthly_q05, t.monthly_q01, coalesce(l.days_underwater_total, 0) AS days_underwater_total, coalesce(l.days_underwater_longest, 0) AS days_underwater_longest
      FROM metrics m JOIN (SELECT strategy, quantile_cont(bret, 0.05) AS monthly_q05, quantile_cont(bret, 0.01) AS monthly_q01 FROM blocks GROUP BY strategy) t ON m.strategy = t.strategy LEFT JOIN longest l ON l.strategy = m.strategy""",
    "act": f"SELECT *, r - cash_ret AS x, greatest(active_w - 1, 0) * {RULES.spread} * coalesce(date_diff('day', lag(date) OVER (PARTITION BY strategy ORDER BY date), date), 3) / 360 AS drag FROM roll",
    "gapq": f"""SELECT *, net_ann - hold_ann AS gap_ann, net_ann - hold_ann - market_exposure - vol_timing - financing - transaction_cost AS residual FROM (SELECT strategy, (avg(active_w) - 1) * avg(x) * 252 AS market_exposure, covar_pop(active_w, x) * 252 AS vol_timing, -avg(drag) * 252 AS financing,
      -avg(active_w * x - drag - ex) * 252 AS transaction_cost, avg(ex) * 252 AS net_ann, avg(x) * 252 AS hold_ann FROM act GROUP BY strategy)""",
    "sharped": """SELECT *, mean_gross_ann - (term_wbar_ann + term_cov_ann - term_drag_ann) AS recon_residual FROM (SELECT strategy, avg(ex) / stddev_samp(ex) * sqrt(252) AS sharpe_excess, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe_total, avg(active_w) AS w_bar, avg(active_w) * avg(x) * 252 AS term_wbar_ann,
      covar_pop(active_w, x) * 252 AS term_cov_ann, avg(drag) * 252 AS term_drag_ann, avg(active_w * x - drag) * 252 AS mean_gross_ann FROM act GROUP BY strategy)""",
    "subp0": "SELECT *, row_number() OVER (PARTITION BY subperiod, strategy ORDER BY date) AS k FROM (SELECT *, CASE " + " ".join(f"WHEN date BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, a, b in SPANS) + " END AS subperiod FROM roll) WHERE subperiod IS NOT NULL",
    "subp": f"""SELECT g.*, b.mad_nonoverlap FROM (SELECT subperiod, strategy, count(DISTINCT date_trunc('month', date)) AS n_months, stddev_samp(ret) * sqrt(252) AS realized_vol, avg(ex) / stddev_samp(ex) * sqrt(252) AS sharpe_excess FROM subp0 GROUP BY 1, 2 HAVING count(*) >= 21) g
      LEFT JOIN (SELECT subperiod, strategy, avg(abs(bvol - {RULES.target})) AS mad_nonoverlap FROM (SELECT subperiod, strategy, (k - 1) // 21 AS block, stddev_samp(ret) * sqrt(252) AS bvol FROM subp0 GROUP BY 1, 2, 3 HAVING count(*) = 21) GROUP BY 1, 2) b ON g.subperiod = b.subperiod AND g.strategy = b.strategy""",
    "signedq": f"SELECT strategy, avg(bvol) AS mean_bvol, sqrt(avg(bvol * bvol)) AS rms_bvol, stddev_pop(bvol) AS vov, avg(bvol) - {RULES.target} AS signed_dev, sqrt(avg(bvol * bvol)) - {RULES.target} AS level, -stddev_pop(bvol) * stddev_pop(bvol) / (2 * avg(bvol)) AS concavity FROM blocks GROUP BY strategy",
    "frame": "SELECT f.date, f.model, f.v, m.fwd21 AS rv FROM fc f JOIN meas m ON m.symbol = 'TRADED' AND m.date = f.date WHERE m.fwd21 IS NOT NULL AND f.v IS NOT NULL AND f.date IN (SELECT date FROM fc WHERE v IS NOT NULL GROUP BY date HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM fc WHERE v IS NOT NULL))",
    "losses": "SELECT *, rv / v - ln(rv / v) - 1 AS qlike, (rv - v) * (rv - v) AS mse FROM frame",
    "longl": "SELECT date, model, 'qlike' AS loss, qlike AS value FROM losses UNION ALL SELECT date, model, 'mse', mse FROM losses",
}


def hac_sql(source: str, keys: str, col: str) -> str:
    """Newey-West variance of the mean of `col` by `keys`, by a self-join on the row number."""
    k = [x.strip() for x in keys.split(",")]
    on = " AND ".join(f"p.{x} = q.{x}" for x in k)
    c = f"(SELECT {keys}, {col} - avg({col}) OVER (PARTITION BY {keys}) AS c, row_number() OVER (PARTITION BY {keys} ORDER BY date) AS i FROM {source})"
    base = f"(SELECT {keys}, count({col}) AS n, avg({col}) AS mean, CAST(floor(4 * pow(count({col}) / 100.0e0, 2.0e0 / 9.0e0)) AS INTEGER) AS lag FROM {source} GROUP BY {keys})"
    return f"""SELECT {', '.join('b.' + x for x in k)}, b.n, b.mean, b.lag, (g.g0 + 2 * coalesce(s.gk, 0)) / b.n / b.n AS hac_var, t.g1 / nullif(g.g0, 0) AS acf1 FROM {base} b
      JOIN (SELECT {keys}, sum(c * c) AS g0 FROM {c} GROUP BY {keys}) g USING ({keys})
      LEFT JOIN (SELECT {', '.join('p.' + x for x in k)}, sum((1 - (p.i - q.i) / (b2.lag + 1.0e0)) * p.c * q.c) AS gk FROM {c} p JOIN {c} q ON {on} AND p.i > q.i JOIN {base} b2 ON {' AND '.join(f'b2.{x} = p.{x}' for x in k)} AND p.i - q.i <= b2.lag GROUP BY ALL) s USING ({keys})
      LEFT JOIN (SELECT {', '.join('p.' + x for x in k)}, sum(p.c * q.c) AS g1 FROM {c} p JOIN {c} q ON {on} AND p.i = q.i + 1 GROUP BY ALL) t USING ({keys})"""


C |= {
    "ranks": "SELECT rank() OVER (ORDER BY overnight_var) + (count(*) OVER (PARTITION BY overnight_var) - 1) / 2e0 AS ro, rank() OVER (ORDER BY rs) + (count(*) OVER (PARTITION BY rs) - 1) / 2e0 AS rr, rank() OVER (ORDER BY rv_daily) + (count(*) OVER (PARTITION BY rv_daily) - 1) / 2e0 AS rv FROM meas2 WHERE symbol = 'TRADED' AND overnight_var IS NOT NULL AND rs IS NOT NULL AND rv_daily IS NOT NULL",
    "hacl": hac_sql("longl", "model, loss", "value"),
    "lossm": "SELECT l.model, min(l.v) AS min_forecast, max(CASE WHEN h.loss = 'qlike' THEN h.mean END) AS qlike_mean, max(CASE WHEN h.loss = 'qlike' THEN sqrt(greatest(h.hac_var, 0)) END) AS qlike_se, max(CASE WHEN h.loss = 'mse' THEN h.mean END) AS mse_mean, max(CASE WHEN h.loss = 'mse' THEN sqrt(greatest(h.hac_var, 0)) END) AS mse_se FROM losses l JOIN hacl h ON h.model = l.model GROUP BY l.model",
    "losst": "SELECT *, floor(rank() OVER (ORDER BY qlike_mean) + (count(*) OVER (PARTITION BY qlike_mean) - 1) / 2e0) AS qlike_rank, floor(rank() OVER (ORDER BY mse_mean) + (count(*) OVER (PARTITION BY mse_mean) - 1) / 2e0) AS mse_rank FROM lossm",
    "dmd": "SELECT x.date, x.loss, x.model AS a, y.model AS b, x.value - y.value AS d FROM longl x JOIN longl y ON x.date = y.date AND x.loss = y.loss AND x.model < y.model",
    "dmh": hac_sql("dmd", "loss, a, b", "d"),
    "conc0": "SELECT *, (" + " OR ".join(f"date BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in CRISES) + ") AS crisis, row_number() OVER (PARTITION BY model, loss ORDER BY value DESC, date) AS i, count(*) OVER (PARTITION BY model, loss) AS n FROM longl",
    "conc1": "SELECT loss, model, avg(value) AS full_mean, avg(CASE WHEN NOT crisis THEN value END) AS calm_mean, sum(CASE WHEN i <= greatest(ceil(n * 0.01e0), 1) THEN value END) / sum(value) AS top_share FROM conc0 GROUP BY 1, 2",
    "conc": "SELECT *, floor(rank() OVER (PARTITION BY loss ORDER BY full_mean) + (count(*) OVER (PARTITION BY loss, full_mean) - 1) / 2e0) AS rank_full, floor(rank() OVER (PARTITION BY loss ORDER BY calm_mean) + (count(*) OVER (PARTITION BY loss, calm_mean) - 1) / 2e0) AS rank_calm FROM conc1",
    "mzf": "SELECT model, regr_intercept(rv, v) AS a, regr_slope(rv, v) AS b, regr_r2(rv, v) AS r2, count(*) AS n FROM frame GROUP BY model",
    "mze": "SELECT f.model, f.date, f.v, z.a, z.b, z.r2, z.n, f.rv - z.a - z.b * f.v AS s1, (f.rv - z.a - z.b * f.v) * f.v AS s2, row_number() OVER (PARTITION BY f.model ORDER BY f.date) AS i FROM frame f JOIN mzf z ON f.model = z.model",
    "mzs": """SELECT p.model, p.lag, sum(w * p.s1 * q.s1) AS s11, sum(w * p.s1 * q.s2) AS s12, sum(w * p.s2 * q.s2) AS s22 FROM (SELECT p0.*, lags.lag, unnest(range(-lags.lag, lags.lag + 1)) AS k FROM mze p0, (SELECT unnest([3, 5, 8]) AS lag) lags) p JOIN mze q ON p.model = q.model AND q.i = p.i + p.k, LATERAL (SELECT 1 - abs(p.k) / (p.lag + 1e0) AS w) GROUP BY p.model, p.lag""",
    "mzd": "SELECT e.model, max(a) AS a, max(b) AS b, max(r2) AS r2, max(n) AS n, max(n) * sum(v * v) - sum(v) * sum(v) AS det, sum(v) AS sv, sum(v * v) AS svv FROM mze e GROUP BY e.model",
    "mzv0": "SELECT d.*, s.lag, s.s11, s.s12, s.s22, svv / det AS i11, -sv / det AS i12, n / det AS i22 FROM mzd d JOIN mzs s ON d.model = s.model",
    "mzv": """SELECT *, i11 * (s11 * i11 + s12 * i12) + i12 * (s12 * i11 + s22 * i12) AS v11, i11 * (s11 * i12 + s12 * i22) + i12 * (s12 * i12 + s22 * i22) AS v12, i12 * (s11 * i12 + s12 * i22) + i22 * (s12 * i12 + s22 * i22) AS v22 FROM mzv0""",
    "mz": "SELECT *, exp(-wald / 2) AS wald_p FROM (SELECT model, lag, a, b, r2, sqrt(v11) AS se_a, sqrt(v22) AS se_b, (a * a * v22 - 2 * a * (b - 1) * v12 + (b - 1) * (b - 1) * v11) / (v11 * v22 - v12 * v12) AS wald, n FROM mzv)",
    "lw0": "SELECT date, strategy, ex, avg(ex) OVER p AS m, avg(ex * ex) OVER p AS q FROM roll WINDOW p AS (PARTITION BY strategy)",
    "lw1": "SELECT date, strategy, m / sqrt(q - m * m) AS sr, q / pow(sqrt(q - m * m), 3) * ex - m / (2 * pow(sqrt(q - m * m), 3)) * ex * ex AS f FROM lw0",
    "lw2": "SELECT x.date, x.strategy AS i, y.strategy AS j, x.sr - y.sr AS diff, x.f - y.f AS d FROM lw1 x JOIN lw1 y ON x.date = y.date AND x.strategy < y.strategy",
    "lwr": "SELECT date, i AS a, j AS b, d FROM lw2",
    "lwh": hac_sql("lwr", "a, b", "d"),
    "lw": "SELECT h.a AS i, h.b AS j, g.diff, CASE WHEN h.hac_var > 0 THEN g.diff / sqrt(h.hac_var) WHEN g.diff = 0 THEN 0 END AS z, h.lag FROM lwh h JOIN (SELECT i, j, max(diff) AS diff FROM lw2 GROUP BY 1, 2) g ON g.i = h.a AND g.j = h.b",
    "dsr": "SELECT strategy, avg(ex) / stddev_samp(ex) AS sr, skewness_pop AS g3, kurt AS g4, n FROM (SELECT strategy, any_value(n) AS n, sum(pow(ex - m, 3)) / any_value(n) / pow(sum(pow(ex - m, 2)) / any_value(n), 1.5e0) AS skewness_pop, sum(pow(ex - m, 4)) / any_value(n) / pow(sum(pow(ex - m, 2)) / any_value(n), 2) AS kurt FROM (SELECT strategy, ex, avg(ex) OVER (PARTITION BY strategy) AS m, count(*) OVER (PARTITION BY strategy) AS n FROM roll) GROUP BY strategy) JOIN roll USING (strategy) GROUP BY ALL",
    "harp": """SELECT symbol, date, x1, x2, x3, y, lag(x1, 21) OVER w AS p1, lag(x2, 21) OVER w AS p2, lag(x3, 21) OVER w AS p3 FROM (SELECT symbol, date, CASE WHEN rv_daily > 0 THEN ln(rv_daily) END AS x1, CASE WHEN rv5 > 0 THEN ln(rv5) END AS x2, CASE WHEN rv22 > 0 THEN ln(rv22) END AS x3, CASE WHEN rv21 > 0 THEN ln(rv21) END AS y FROM meas) WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    "vgx": "SELECT symbol, date, log_rv, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM meas WHERE log_rv IS NOT NULL",
    "vg": "SELECT x.symbol, x.date, y.lag, avg(pow(x.log_rv - p.log_rv, 2)) OVER (PARTITION BY x.symbol, y.lag ORDER BY x.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m2 FROM vgx x CROSS JOIN (SELECT unnest(range(1, 41)) AS lag) y JOIN vgx p ON p.symbol = x.symbol AND p.i = x.i - y.lag",
    "hurstq": "SELECT symbol, date, slope / 2 AS h, sqrt(greatest(syy * (1 - r2), 0) / 38 / sxx) / 2 AS h_se, exp(icept) AS nu2 FROM (SELECT symbol, date, count(*) AS lags, regr_slope(ln(m2), ln(lag)) AS slope, regr_intercept(ln(m2), ln(lag)) AS icept, regr_r2(ln(m2), ln(lag)) AS r2, regr_syy(ln(m2), ln(lag)) AS syy, regr_sxx(ln(m2), ln(lag)) AS sxx FROM vg WHERE m2 > 0 GROUP BY 1, 2) WHERE lags = 40",
    "minute": "SELECT event_id, ts, event_type AS ticker, value AS price, timezone('America/New_York', timezone('UTC', CAST(ts AS TIMESTAMP))) AS lt FROM events WHERE value > 0",
    "mprep": "SELECT *, CAST(lt AS DATE) AS day, hour(lt) * 60 + minute(lt) AS tod, hour(lt) * 60 + minute(lt) BETWEEN 570 AND 959 AS rth FROM minute",
    "mlast": f"SELECT k, ticker, day, tod // k AS slot, arg_max(price, row(ts, event_id)) AS price FROM mprep, (SELECT unnest({WIDTHS}) AS k) GROUP BY ALL",
    "mrv": "SELECT k, ticker, day, sum(r * r) AS rv, count(*) AS slots FROM (SELECT *, ln(price) - ln(lag(price) OVER (PARTITION BY k, ticker, day ORDER BY slot)) AS r FROM mlast) GROUP BY ALL HAVING count(*) >= 3",
}


_memo: dict[str, DataFrame] = {}


def once(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Within one query a shared input is built once, so that its scan and shuffle aren't repeated."""

    def g(s: SparkSession, d: str) -> DataFrame:
        if f.__name__ not in _memo:
            _memo[f.__name__] = f(s, d)
        return _memo[f.__name__]

    return g


def add(name: str, spec: str, source: str | None, f: Callable[[SparkSession, str], DataFrame]) -> None:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        _memo.clear()
        try:
            return shaped(f(spark, folder), spec)
        finally:
            _memo.clear()

    QUERIES[name] = query
    if source is not None:
        ORACLE[name] = shaped_sql(C, source, spec)


# ---------------------------------------------------------------- shared inputs
@once
def _bars(s: SparkSession, d: str) -> DataFrame:
    return cut(market.daily_bars(s, d))  # a row for each symbol and day; the scan below it is the whole cost


@once
def _flags(s: SparkSession, d: str) -> DataFrame:
    return cut(market.daily_bars(s, d, "flag"))


@once
def _meas(s: SparkSession, d: str) -> DataFrame:
    return M.daily_measures(M.returns(_bars(s, d)))


def _traded(df: DataFrame) -> DataFrame:
    return df.where(F.col("symbol") == market.TRADED)


@once
def _reb(s: SparkSession, d: str) -> DataFrame:
    return M.rebalance_dates(_traded(_bars(s, d)))


@once
def _forecasts(s: SparkSession, d: str) -> DataFrame:
    m = _traded(_meas(s, d))
    x = M.expanding_mean(M.trailing_mean(M.trailing_mean(m, "rv_daily", 21, "rv21"), "rv_daily", 5, "rv5"), "rv_daily", "uncond")
    x = x.withColumn("rn", F.row_number().over(M.ordered(["symbol"])))
    x = x.join(forecasts.ewma(_traded(M.returns(_bars(s, d)))).select("symbol", "date", "ewma"), ["symbol", "date"], "left").where(F.col("rn") >= LEAST)
    x = x.join(_reb(s, d).select("date"), "date", "left_semi")
    return x.unpivot(["date"], ["rv21", "rv5", "uncond", "ewma"], "model", "v")


@once
def _bt(s: SparkSession, d: str) -> DataFrame:
    rets = _traded(M.returns(_bars(s, d)))
    w = B.schedules(_forecasts(s, d).withColumnRenamed("model", "strategy"), rets, RULES)
    return cut(B.backtest(w, rets, market.rates(s, d), RULES))


def _target(s: SparkSession, d: str) -> DataFrame:
    return forward_mean(_traded(_meas(s, d)), "rv_daily", 21, "rv").select("date", "rv")


@once
def _frame(s: SparkSession, d: str) -> DataFrame:
    return E.complete_cases(_forecasts(s, d), _target(s, d))


@once
def _losses(s: SparkSession, d: str) -> DataFrame:
    return cut(E.losses(_frame(s, d)))


@once
def _minute(s: SparkSession, d: str) -> DataFrame:
    return intraday.prepared(market.minute_bars(s, d))


# ---------------------------------------------------------------- scans, filters, scalar estimators
add("daily_bars", "symbol date:d open:8 high:8 low:8 close:8 volume:2 n:i", "bars", market.daily_bars)
add("symbol_coverage", "symbol n_rows:i first_day:d last_day:d", "(SELECT symbol, count(*) AS n_rows, min(date) AS first_day, max(date) AS last_day FROM flagbars GROUP BY 1)",
    lambda s, d: _flags(s, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day")))
add("filtered_scan", "event_id:i ticker price:6", "(SELECT event_id, event_type AS ticker, value AS price FROM events WHERE event_type IN ('click', 'view', 'purchase') AND value > 0)",
    lambda s, d: table(s, d, "events").where(F.col("event_type").isin("click", "view", "purchase") & (F.col("value") > 0)).select("event_id", F.col("event_type").alias("ticker"), F.col("value").alias("price")))
add("month_range", "month:d", "(SELECT unnest(generate_series(date_trunc('month', a), z, INTERVAL 1 MONTH)) AS month FROM (SELECT min(date) AS a, max(date) AS z FROM bars))",
    lambda s, d: _bars(s, d).agg(F.trunc(F.min("date"), "MM").alias("a"), F.max("date").alias("z")).select(F.explode(F.expr("sequence(a, z, interval 1 month)")).alias("month")))
add("returns", "symbol date:d log_ret:8 ret:8", "flagrets", lambda s, d: M.returns(_flags(s, d)))
add("daily_measures", "symbol date:d rs:10 overnight_var:10 rv_daily:10 overnight_is_na log_rv:6 yz:10", "meas3", _meas)
add("annualised_vol", "symbol vol:8", "(SELECT symbol, sqrt(avg(rv_daily) * 252) AS vol FROM meas2 GROUP BY symbol)", lambda s, d: _meas(s, d).groupBy("symbol").agg(F.sqrt(F.avg("rv_daily") * 252).alias("vol")))
add("measure_report", "symbol excluded n:i rs_vol:8 rv_vol:8 cc_vol:8 overnight_share:8",
    "(SELECT symbol, (year(date) = 1997 AND month(date) = 10) AS excluded, count(*) AS n, sqrt(avg(rs) * 252) AS rs_vol, sqrt(avg(rv_daily) * 252) AS rv_vol, sqrt(var_samp(log_ret) * 252) AS cc_vol, avg(overnight_var) / avg(rv_daily) AS overnight_share FROM meas2 GROUP BY 1, 2)",
    lambda s, d: _meas(s, d).groupBy("symbol", ((F.year("date") == 1997) & (F.month("date") == 10)).alias("excluded")).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg("rs") * 252).alias("rs_vol"), F.sqrt(F.avg("rv_daily") * 252).alias("rv_vol"), F.sqrt(F.var_samp("log_ret") * 252).alias("cc_vol"), (F.avg("overnight_var") / F.avg("rv_daily")).alias("overnight_share")))
add("estimator_ratio", "symbol year ratio:8", "(SELECT symbol, coalesce(CAST(year(date) AS VARCHAR), 'all') AS year, avg(rv_daily) / var_samp(log_ret) AS ratio FROM meas2 GROUP BY GROUPING SETS ((symbol, year(date)), (symbol)))",
    lambda s, d: _meas(s, d).withColumn("y", F.year("date")).rollup("symbol", "y").agg((F.avg("rv_daily") / F.var_samp("log_ret")).alias("ratio"), F.grouping_id().alias("g")).where("g < 3").select("symbol", F.coalesce(F.col("y").cast("string"), F.lit("all")).alias("year"), "ratio"))
add("crisis_mask", "date:d crisis", "(SELECT date, " + " OR ".join(f"date BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in CRISES) + " AS crisis FROM bars WHERE symbol = 'TRADED')",
    lambda s, d: _traded(_bars(s, d)).select("date", (F.col("date").between(F.lit(CRISES[0][0]).cast("date"), F.lit(CRISES[0][1]).cast("date")) | F.col("date").between(F.lit(CRISES[1][0]).cast("date"), F.lit(CRISES[1][1]).cast("date"))).alias("crisis")))
add("auto_lags", "n:i lag:i", "(SELECT n, floor(4 * pow(n / 100.0e0, 2.0e0 / 9.0e0)) AS lag FROM (SELECT unnest([50, 100, 318, 1000, 6688]) AS n))",
    lambda s, d: s.createDataFrame([(n,) for n in (50, 100, 318, 1000, 6688)], "n bigint").withColumn("lag", stats.auto_lag(F.col("n"))))
add("fbm_constants", "h:4 c:8 c_alt:8", "(SELECT h, gamma(1.5e0 - h) / (gamma(h + 0.5e0) * gamma(2 - 2 * h)) AS c, gamma(1.5e0 - h) / (gamma(h + 0.5e0) * gamma(2 - 2 * h)) / (2 * h) AS c_alt FROM (SELECT unnest(range(2, 50)) / 100.0e0 AS h))",
    lambda s, d: s.range(2, 50).select((F.col("id") / 100.0).alias("h")).withColumn("c", stats.gamma_fn(1.5 - F.col("h")) / (stats.gamma_fn(F.col("h") + 0.5) * stats.gamma_fn(2 - 2 * F.col("h")))).withColumn("c_alt", F.col("c") / (2 * F.col("h"))))
add("money_labels", "symbol label", "(SELECT symbol, CASE WHEN v >= 1e6 THEN printf('$%.2fM', v / 1e6) ELSE printf('$%.0fk', v / 1e3) END AS label FROM (SELECT symbol, sum(volume) AS v FROM flagbars GROUP BY symbol))",
    lambda s, d: _flags(s, d).groupBy("symbol").agg(F.sum("volume").alias("v")).withColumn("label", F.when(F.col("v") >= 1e6, F.format_string("$%.2fM", F.col("v") / 1e6)).otherwise(F.format_string("$%.0fk", F.col("v") / 1e3))))
add("strategy_names", "model family distribution", "(SELECT DISTINCT model, split_part(model, '_', 1) AS family, CASE WHEN model LIKE '%\\_skewt' ESCAPE '\\' THEN 'skewt' WHEN model LIKE '%\\_normal' ESCAPE '\\' THEN 'normal' ELSE 'none' END AS distribution FROM (SELECT model || CASE WHEN dist = 'none' THEN '' ELSE '_' || dist END AS model FROM param_paths WHERE model IS NOT NULL AND dist IS NOT NULL))",
    lambda s, d: table(s, d, "param_paths").where("model IS NOT NULL AND dist IS NOT NULL").select(F.concat("model", F.when(F.col("dist") == "none", "").otherwise(F.concat(F.lit("_"), "dist"))).alias("model")).distinct().select("model", F.split("model", "_")[0].alias("family"), F.coalesce(F.nullif(F.regexp_extract("model", "_(skewt|normal)$", 1), F.lit("")), F.lit("none")).alias("distribution")))

# ---------------------------------------------------------------- windows, splice, calendar, alignments
add("trailing_rv", "symbol date:d rv21:10", "meas WHERE rv21 IS NOT NULL", lambda s, d: M.trailing_mean(_meas(s, d), "rv_daily", 21, "rv21").where("rv21 IS NOT NULL"))
add("expanding_variance", "symbol date:d uncond:10", "meas", lambda s, d: M.expanding_mean(_meas(s, d), "rv_daily", "uncond"))
add("forward_rv", "symbol date:d fwd21:10 fwd_yz:10", "meas", lambda s, d: forward_value(forward_mean(_meas(s, d), "rv_daily", 21, "fwd21"), "yz", 21, "fwd_yz"))
add("seed_scalar", "c:8", "scalar", lambda s, d: M.seed_scalar(_meas(s, d).where(F.col("symbol") == market.SEED), market.TAKEOVER))
def _panel(s: SparkSession, d: str) -> DataFrame:
    m = _meas(s, d)
    seed, traded = m.where(F.col("symbol") == market.SEED), _traded(m)
    return M.splice(seed, traded, M.seed_scalar(seed, market.TAKEOVER), market.TAKEOVER)
add("panel_splice", "date:d source overnight_var:10 rs:10 rv_daily:10 yz:10", "panel", _panel)
add("source_vols", "source vol:8 overnight_share:8", "(SELECT coalesce(source, 'all') AS source, sqrt(avg(rv_daily) * 252) AS vol, avg(overnight_var) / avg(rv_daily) AS overnight_share FROM panel GROUP BY ROLLUP (source))",
    lambda s, d: _panel(s, d).rollup("source").agg(F.sqrt(F.avg("rv_daily") * 252).alias("vol"), (F.avg("overnight_var") / F.avg("rv_daily")).alias("overnight_share")).select(F.coalesce("source", F.lit("all")).alias("source"), "vol", "overnight_share"))
add("return_splice", "date:d log_ret:8 source", "spliced", lambda s, d: M.splice_returns(M.returns(_bars(s, d).where(F.col("symbol") == market.SEED)), _traded(_bars(s, d)), market.TAKEOVER))
add("rebalance_dates", "date:d seq:i", "reb", _reb)
add("warmup_date", "warm:d", f"(SELECT max(date) AS warm FROM reb WHERE date < DATE '{RULES.eval_start}')", lambda s, d: _reb(s, d).where(F.col("date") < F.lit(RULES.eval_start).cast("date")).agg(F.max("date").alias("warm")))
add("day_gaps", "date:d gap:i", "(SELECT date, coalesce(date_diff('day', lag(date) OVER (ORDER BY date), date), 3) AS gap FROM bars WHERE symbol = 'TRADED')",
    lambda s, d: _traded(_bars(s, d)).select("symbol", "date").withColumn("gap", F.coalesce(F.datediff("date", F.lag("date").over(M.ordered(["symbol"]))), F.lit(3))))
add("asof_rate", "date:d rate_pct:11", "(SELECT b.date, x.rate_pct FROM (SELECT date FROM bars WHERE symbol = 'TRADED') b ASOF LEFT JOIN rates x ON b.date >= x.date)",
    lambda s, d: B.asof_rate(_traded(_bars(s, d)).select("date"), market.rates(s, d), "date", "rate_pct"))
def _governing(s: SparkSession, d: str) -> DataFrame:
    """Parameters in force by union and last value: an origin meets one row, not every version of its entity."""
    p = table(s, d, "param_paths").where(F.col("date").isNotNull() & F.col("source").isNotNull() & F.col("sigma2_next").isNotNull()).groupBy("source", "model", "dist", "date").agg(F.max_by("sigma2_next", "param_id").alias("sigma2_next"))
    p = p.select("source", "model", "dist", F.col("date").alias("at"), F.lit(0).alias("side"), F.struct(F.col("date").alias("governing"), "sigma2_next").alias("row"), F.lit(None).cast("long").alias("origin_id"))
    f = table(s, d, "forecast_v21").where(F.col("source").isNotNull() & F.col("model").isNotNull() & F.col("dist").isNotNull() & F.col("date").isNotNull())
    f = f.select("source", "model", "dist", F.col("date").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(p.schema["row"].dataType).alias("row"), "origin_id")
    # entities are cut by year; what a year begins with comes from the years before, one row each
    both = p.unionByName(f).withColumn("year", F.year("at"))
    ends = p.withColumn("year", F.year("at")).groupBy("source", "model", "dist", "year").agg(F.max("row").alias("row"))
    w = M.Window.partitionBy("source", "model", "dist").orderBy("year")
    axis = both.select("source", "model", "dist", "year").distinct().join(ends, ["source", "model", "dist", "year"], "left")
    start = axis.select("source", "model", "dist", "year", F.last("row", ignorenulls=True).over(w.rowsBetween(M.Window.unboundedPreceding, -1)).alias("start"))
    inside = M.Window.partitionBy("source", "model", "dist", "year").orderBy("at", "side").rowsBetween(M.Window.unboundedPreceding, 0)
    got = both.withColumn("seen", F.last("row", ignorenulls=True).over(inside)).where("side = 1").join(start, ["source", "model", "dist", "year"])
    return got.withColumn("seen", F.coalesce("seen", "start")).where("seen IS NOT NULL").select("origin_id", "seen.governing", "seen.sigma2_next")
add("asof_params", "origin_id:i governing:d sigma2_next:10",
    "(SELECT f.origin_id, p.date AS governing, p.sigma2_next FROM forecast_v21 f ASOF JOIN (SELECT source, model, dist, date, arg_max(sigma2_next, param_id) AS sigma2_next FROM param_paths WHERE date IS NOT NULL AND source IS NOT NULL AND sigma2_next IS NOT NULL GROUP BY ALL) p ON f.source = p.source AND f.model = p.model AND f.dist = p.dist AND f.date >= p.date)", _governing)
add("common_dates", "date:d", "(SELECT date FROM bars WHERE symbol = 'SEED' INTERSECT SELECT date FROM bars WHERE symbol = 'TRADED')",
    lambda s, d: _bars(s, d).where(F.col("symbol") == market.SEED).select("date").intersect(_traded(_bars(s, d)).select("date")))
add("calendar_difference", "date:d side", "(SELECT date, 'only_seed' AS side FROM (SELECT date FROM bars WHERE symbol = 'SEED' EXCEPT SELECT date FROM bars WHERE symbol = 'TRADED') UNION ALL SELECT date, 'only_traded' FROM (SELECT date FROM bars WHERE symbol = 'TRADED' EXCEPT SELECT date FROM bars WHERE symbol = 'SEED'))",
    lambda s, d: _bars(s, d).groupBy("date").agg(F.max((F.col("symbol") == market.SEED).cast("int")).alias("a"), F.max((F.col("symbol") == market.TRADED).cast("int")).alias("b")).where("a + b = 1").select("date", F.when(F.col("a") == 1, "only_seed").otherwise("only_traded").alias("side")))
add("missing_days", "day:d", "(SELECT day FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS day FROM rates) WHERE day NOT IN (SELECT date FROM rates))",
    lambda s, d: market.rates(s, d).agg(F.min("date").alias("a"), F.max("date").alias("z")).select(F.explode(F.sequence("a", "z")).alias("day")).join(market.rates(s, d), F.col("day") == F.col("date"), "left_anti"))
add("rate_coverage", "n_days:i weekend:i nulls:i", "(SELECT count(*) AS n_days, sum(CASE WHEN dayofweek(date) IN (0, 6) THEN 1 ELSE 0 END) AS weekend, sum(CASE WHEN rate_pct IS NULL THEN 1 ELSE 0 END) AS nulls FROM rates)",
    lambda s, d: market.rates(s, d).agg(F.count(F.lit(1)).alias("n_days"), F.count_if(F.dayofweek("date").isin(1, 7)).alias("weekend"), F.count_if(F.col("rate_pct").isNull()).alias("nulls")))
add("full_outer_alignment", "date:d seed_close:8 traded_close:8 far", "(SELECT coalesce(a.date, b.date) AS date, a.close AS seed_close, b.close AS traded_close, abs(a.close / b.close - 1) > 0.005 AS far FROM (SELECT * FROM bars WHERE symbol = 'SEED') a FULL JOIN (SELECT * FROM bars WHERE symbol = 'TRADED') b ON a.date = b.date)",
    lambda s, d: _bars(s, d).groupBy("date").agg(F.max(F.when(F.col("symbol") == market.SEED, F.col("close"))).alias("seed_close"), F.max(F.when(F.col("symbol") == market.TRADED, F.col("close"))).alias("traded_close")).withColumn("far", F.abs(F.col("seed_close") / F.col("traded_close") - 1) > 0.005))
add("relative_differences", "median:8 p95:8 most:8", "(SELECT median(x) AS median, quantile_cont(x, 0.95) AS p95, max(x) AS most FROM (SELECT abs(a.close / b.close - 1) AS x FROM bars a JOIN bars b ON a.date = b.date WHERE a.symbol = 'SEED' AND b.symbol = 'TRADED'))",
    lambda s, d: _bars(s, d).groupBy("date").pivot("symbol", [market.SEED, market.TRADED]).agg(F.max("close")).dropna().select(F.abs(F.col(market.SEED) / F.col(market.TRADED) - 1).alias("x")).agg(F.median("x").alias("median"), F.percentile("x", 0.95).alias("p95"), F.max("x").alias("most")))

# ---------------------------------------------------------------- bar quality, daily and by minute
add("mechanical_opens", "symbol year:i rate:8 days:i first_clean_year:i", "(SELECT symbol, year, rate, days, min(CASE WHEN clean THEN year END) OVER (PARTITION BY symbol) AS first_clean_year FROM (SELECT *, max(rate) OVER (PARTITION BY symbol ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) < 0.05 AS clean FROM (SELECT symbol, year(date) AS year, avg(CASE WHEN open = prev THEN 1 ELSE 0 END) AS rate, count(*) AS days FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM flagbars) WHERE prev IS NOT NULL GROUP BY 1, 2)))",
    lambda s, d: M.mechanical_opens(_flags(s, d)))
add("sessions_per_year", "symbol year:i days:i weekdays:i far", "(SELECT symbol, year, days, weekdays, abs(days - weekdays) > 2 AS far FROM (SELECT symbol, year(date) AS year, count(*) AS days, max(wk) AS weekdays FROM flagbars JOIN (SELECT year(x) AS y, count(*) AS wk FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS x FROM flagbars) WHERE dayofweek(x) BETWEEN 1 AND 5 GROUP BY 1) ON y = year(date) GROUP BY 1, 2))",
    lambda s, d: _flags(s, d).groupBy("symbol", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("days")).join(_flags(s, d).agg(F.min("date").alias("a"), F.max("date").alias("z")).select(F.explode(F.sequence("a", "z")).alias("x")).where(F.dayofweek("x").between(2, 6)).groupBy(F.year("x").alias("year")).agg(F.count(F.lit(1)).alias("weekdays")), "year").withColumn("far", F.abs(F.col("days") - F.col("weekdays")) > 2))
add("ohlc_integrity", "symbol rows:i nulls:i high_below_low:i high_below_body:i low_above_body:i not_positive:i zero_volume:i flat:i", "(SELECT symbol, count(*) AS rows, sum(CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL THEN 1 ELSE 0 END) AS nulls, count_if(high < low) AS high_below_low, count_if(high < greatest(open, close)) AS high_below_body, count_if(low > least(open, close)) AS low_above_body, count_if(least(open, high, low, close) <= 0) AS not_positive, count_if(volume = 0) AS zero_volume, count_if(high = low) AS flat FROM flagbars GROUP BY symbol)",
    lambda s, d: intraday.integrity(_flags(s, d)))
add("minute_integrity", "symbol rows:i nulls:i high_below_low:i high_below_body:i low_above_body:i not_positive:i zero_volume:i flat:i", "(SELECT ticker AS symbol, count(*) AS rows, sum(CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL THEN 1 ELSE 0 END) AS nulls, count_if(high < low) AS high_below_low, count_if(high < greatest(open, close)) AS high_below_body, count_if(low > least(open, close)) AS low_above_body, count_if(least(open, high, low, close) <= 0) AS not_positive, count_if(volume = 0) AS zero_volume, count_if(high = low) AS flat FROM qqq_1m GROUP BY ticker)",
    lambda s, d: intraday.integrity(table(s, d, "qqq_1m").withColumnRenamed("ticker", "symbol")))
add("duplicate_bars", "duplicates:i keys:i", '(SELECT coalesce(sum(n - 1), 0) AS duplicates, count(*) AS keys FROM (SELECT feed, ticker, "timestamp", count(*) AS n FROM qqq_1m GROUP BY ALL HAVING count(*) > 1))',
    lambda s, d: intraday.duplicates(table(s, d, "qqq_1m"), ["feed", "ticker", "timestamp"]))
add("split_candidates", "symbol date:d implied:6 observed:6 verdict", "(SELECT symbol, date, exp(-r) AS implied, prev / open AS observed, CASE WHEN abs(prev / open / exp(-r) - 1) < 0.15 THEN 'unadjusted' WHEN abs(prev / open - 1) < 0.15 THEN 'adjusted' ELSE 'inconclusive' END AS verdict FROM (SELECT *, ln(close / prev) AS r FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM flagbars)) WHERE abs(r) > 0.012)",
    lambda s, d: intraday.split_candidates(_flags(s, d), jump=0.012))
add("minute_daily", "ticker day:d open:6 high:6 low:6 close:6 bars:i", "(SELECT ticker, day, arg_min(price, row(ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts, event_id)) AS close, count(*) AS bars FROM mprep GROUP BY 1, 2)", lambda s, d: intraday.daily_from_minutes(_minute(s, d)))
add("bars_per_month", "month:d n:i thin", "(SELECT x.month, coalesce(y.n, 0) AS n, coalesce(y.n, 0) < 8000 AS thin FROM (SELECT unnest(generate_series(date_trunc('month', min(day)), date_trunc('month', max(day)), INTERVAL 1 MONTH)) AS month FROM mprep) x LEFT JOIN (SELECT date_trunc('month', day) AS month, count(*) AS n FROM mprep GROUP BY 1) y ON x.month = y.month)", lambda s, d: intraday.bars_per_month(_minute(s, d)))
add("minute_sessions", "day:d bars:i minutes:i last_tod:i half_day expected:i missing:i", "(SELECT *, CASE WHEN half_day THEN 210 ELSE 390 END AS expected, greatest(CASE WHEN half_day THEN 210 ELSE 390 END - minutes, 0) AS missing FROM (SELECT day, count(*) AS bars, count(DISTINCT tod) AS minutes, max(tod) AS last_tod, max(tod) < 780 AS half_day FROM mprep WHERE rth GROUP BY day))", lambda s, d: intraday.sessions(_minute(s, d)))
add("thinnest_sessions", "day:d bars:i", "(SELECT day, count(*) AS bars FROM mprep WHERE rth GROUP BY day ORDER BY 2, 1 LIMIT 10)", lambda s, d: intraday.sessions(_minute(s, d)).orderBy("bars", "day").limit(10))
add("ticker_overlaps", "slot:i tickers:i", "(SELECT epoch_us(ts) // 60000000 AS slot, count(DISTINCT ticker) AS tickers FROM mprep GROUP BY 1 HAVING count(DISTINCT ticker) > 1)", lambda s, d: intraday.overlaps(_minute(s, d)))
add("ticker_by_weekday", "dow:i click:i view:i purchase:i", "(SELECT dayofweek(day) + 1 AS dow, count_if(ticker = 'click') AS click, count_if(ticker = 'view') AS view, count_if(ticker = 'purchase') AS purchase FROM mprep GROUP BY 1)", lambda s, d: intraday.ticker_by_day_of_week(_minute(s, d), ["click", "view", "purchase"]))
add("resampled_rv", "ticker day:d rv:6 slots:i", "mrv WHERE k = 5", lambda s, d: intraday.realised_variance(_minute(s, d), [5], 3))
add("volatility_signature", "k:i ticker vol:6 days:i", "(SELECT k, ticker, sqrt(avg(rv) * 252) AS vol, count(*) AS days FROM mrv GROUP BY 1, 2)", lambda s, d: intraday.signature(intraday.realised_variance(_minute(s, d), WIDTHS, 3)))
add("rv_against_daily", "ticker rv_vol:6 cc_vol:6 days:i", "(SELECT m.ticker, sqrt(avg(m.rv) * 252) AS rv_vol, sqrt(var_samp(c.r) * 252) AS cc_vol, count(*) AS days FROM mrv m JOIN (SELECT ticker, day, ln(close) - ln(lag(close) OVER (PARTITION BY ticker ORDER BY day)) AS r FROM (SELECT ticker, day, arg_max(price, row(ts, event_id)) AS close FROM mprep GROUP BY 1, 2)) c ON m.ticker = c.ticker AND m.day = c.day WHERE m.k = 5 AND c.r IS NOT NULL GROUP BY m.ticker)",
    lambda s, d: intraday.realised_variance(_minute(s, d), [5], 3).join(M.returns(intraday.daily_from_minutes(_minute(s, d)).withColumnRenamed("ticker", "symbol").withColumnRenamed("day", "date")).select(F.col("symbol").alias("ticker"), F.col("date").alias("day"), "log_ret"), ["ticker", "day"]).where("log_ret IS NOT NULL").groupBy("ticker").agg(F.sqrt(F.avg("rv") * 252).alias("rv_vol"), F.sqrt(F.var_samp("log_ret") * 252).alias("cc_vol"), F.count(F.lit(1)).alias("days")))

# ---------------------------------------------------------------- forecasts
add("ewma_variance", "symbol date:d ewma:10", "ewma", lambda s, d: forecasts.ewma(M.returns(_bars(s, d))))
add("har_normal_equations", "symbol date:d n:i s1:4 s2:4 s3:4 s11:2 s12:2 s13:2 s22:2 s23:2 s33:2 sy:4 s1y:2 s2y:2 s3y:2 syy:2",
    "(SELECT symbol, date, " + ", ".join(f"sum(CASE WHEN p1 IS NOT NULL AND p2 IS NOT NULL AND p3 IS NOT NULL AND y IS NOT NULL THEN CAST({e} AS DOUBLE) END) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {n}" for n, e in forecasts.HAR_SUMS.items()) + " FROM harp)",
    lambda s, d: forecasts.har_normal_equations(_meas(s, d)))
add("har_forecast", "symbol date:d v:10 b0:4 b1:4 b2:4 b3:4 sigma2_resid:6 n_train:i", None, lambda s, d: forecasts.har_forecast(_meas(s, d), least=LEAST))
add("hurst_path", "symbol date:d h:6 h_se:6 nu2:6", "hurstq", lambda s, d: forecasts.hurst(forecasts.variogram(_meas(s, d))))
def _rough(s: SparkSession, d: str) -> DataFrame:
    m = _traded(_meas(s, d))
    est = forecasts.hurst(forecasts.variogram(m)).select("symbol", "date", "h", "nu2")
    vg = forecasts.variogram(m)
    for h in (0.02, 0.05, 0.10, 0.15):
        est = est.unionByName(forecasts.nu2_given_h(vg, h).withColumn("h", F.lit(h)))
    est = est.join(_reb(s, d).select("date"), "date", "left_semi")
    return forecasts.rough_forecast(m, est)
add("rough_forecasts", "symbol date:d h:6 v:10 retransform_pct:8 capped:i", None, _rough)
add("rough_retransform", "h:2 mean_pct:8 worst_pct:8 cap_share:6", None, lambda s, d: _rough(s, d).where(F.col("h").isin(0.02, 0.05, 0.10, 0.15)).groupBy("h").agg(F.avg("retransform_pct").alias("mean_pct"), F.max("retransform_pct").alias("worst_pct"), (F.avg("capped") / 21).alias("cap_share")))
def _closed_full(s: SparkSession, d: str) -> DataFrame:
    ok = "sig2bar IS NOT NULL AND NOT isnan(sig2bar) AND persistence IS NOT NULL AND NOT isnan(persistence) AND sigma2_next IS NOT NULL"
    return forecasts.closed_form_term_structure(table(s, d, "param_paths").where(ok).select("param_id", "sig2bar", "sigma2_next", "persistence"))
def _closed(s: SparkSession, d: str) -> DataFrame:
    return _closed_full(s, d).where("h IN (1, 5, 21)")
add("term_structure", "param_id:i h:i v:10", "(SELECT param_id, h, sig2bar + CASE WHEN abs(persistence - 1) < 1e-12 THEN 1 ELSE (1 - pow(persistence, h)) / (h * (1 - persistence)) END * (sigma2_next - sig2bar) AS v FROM param_paths, (SELECT unnest([1, 5, 21]) AS h) WHERE sig2bar IS NOT NULL AND NOT isnan(sig2bar) AND persistence IS NOT NULL AND NOT isnan(persistence) AND sigma2_next IS NOT NULL)", _closed)
add("term_structure_full", "param_id:i h:i v:10", "(SELECT param_id, h, sig2bar + CASE WHEN abs(persistence - 1) < 1e-12 THEN 1 ELSE (1 - pow(persistence, h)) / (h * (1 - persistence)) END * (sigma2_next - sig2bar) AS v FROM param_paths, (SELECT unnest(generate_series(1, 63)) AS h) WHERE sig2bar IS NOT NULL AND NOT isnan(sig2bar) AND persistence IS NOT NULL AND NOT isnan(persistence) AND sigma2_next IS NOT NULL)", _closed_full)
def _fits(s: SparkSession, d: str) -> DataFrame:
    return fits.refit(_traded(M.returns(_bars(s, d))), _reb(s, d), least=LEAST)
add("model_refits", "date:d model dist converged carried n:i persistence:4 sig2bar:8 sigma2_next:8 v21:8", None, _fits)
add("parameter_json", "param_id:i a:8 b:8", "(SELECT param_id, TRY_CAST(json_extract_string(params_json, '$.alpha') AS DOUBLE) AS a, TRY_CAST(json_extract_string(params_json, '$.beta') AS DOUBLE) AS b FROM param_paths)",
    lambda s, d: table(s, d, "param_paths").withColumn("m", F.from_json("params_json", "map<string,double>")).select("param_id", F.col("m")["alpha"].alias("a"), F.col("m")["beta"].alias("b")))
add("path_summary", "model dist n_rows:i converged:i first_v:10 last_v:10", "(SELECT model, dist, count(*) AS n_rows, count_if(converged) AS converged, arg_min(V21, row(date, param_id)) AS first_v, arg_max(V21, row(date, param_id)) AS last_v FROM param_paths GROUP BY 1, 2)",
    lambda s, d: table(s, d, "param_paths").groupBy("model", "dist").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("converged").alias("converged"), F.min_by("V21", F.struct("date", "param_id")).alias("first_v"), F.max_by("V21", F.struct("date", "param_id")).alias("last_v")))
add("distribution_differences", "source model pairs:i mean_diff:10", "(SELECT source, model, count(*) AS pairs, avg(a.v - b.v) AS mean_diff FROM (SELECT source, model, date, max(V21) AS v FROM param_paths WHERE dist = 'skewt' GROUP BY ALL) a JOIN (SELECT source, model, date, max(V21) AS v FROM param_paths WHERE dist = 'normal' GROUP BY ALL) b USING (source, model, date) GROUP BY 1, 2)",
    lambda s, d: table(s, d, "param_paths").where(F.col("dist").isin("skewt", "normal") & F.col("source").isNotNull()).groupBy("source", "model", "date").pivot("dist", ["skewt", "normal"]).agg(F.max("V21")).dropna(subset=["skewt", "normal"]).groupBy("source", "model").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.col("skewt") - F.col("normal")).alias("mean_diff")))
add("forecasts_positive", "model positive n:i", "(SELECT model, bool_and(v > 0) AS positive, count(*) AS n FROM fc GROUP BY model)", lambda s, d: _forecasts(s, d).groupBy("model").agg(F.every(F.col("v") > 0).alias("positive"), F.count(F.lit(1)).alias("n")))
add("forecast_matrix", "date:d rv21:10 rv5:10 uncond:10 ewma:10", "(SELECT date, max(CASE WHEN model = 'rv21' THEN v END) AS rv21, max(CASE WHEN model = 'rv5' THEN v END) AS rv5, max(CASE WHEN model = 'uncond' THEN v END) AS uncond, max(CASE WHEN model = 'ewma' THEN v END) AS ewma FROM fc GROUP BY date)", lambda s, d: _forecasts(s, d).groupBy("date").pivot("model", ["rv21", "rv5", "uncond", "ewma"]).agg(F.max("v")))
add("variant_spread", "mean_spread:8 p95:8", "(SELECT avg(x) AS mean_spread, quantile_cont(x, 0.95) AS p95 FROM (SELECT date, (max(v) - min(v)) / avg(v) AS x FROM fc GROUP BY date))", lambda s, d: _forecasts(s, d).groupBy("date").agg(((F.max("v") - F.min("v")) / F.avg("v")).alias("x")).agg(F.avg("x").alias("mean_spread"), F.percentile("x", 0.95).alias("p95")))

# ---------------------------------------------------------------- portfolio
add("sizing_weights", "strategy date:d w:8", "weights", lambda s, d: B.schedules(_forecasts(s, d).withColumnRenamed("model", "strategy"), _traded(M.returns(_bars(s, d))), RULES))
add("backtest_daily", "strategy date:d period:i lev:7 w_target:7 turnover:7 cost:3 equity:3 ret:8 financing:3 active_w:7", "bt", _bt)
add("backtest_metrics", "strategy final_equity:2 cagr:7 realized_vol:7 vol_target_gap:7 mad_roll_vol_from_target:7 vol_of_vol:7 sharpe_excess:6 max_drawdown:7 skew:5 kurtosis:4 avg_annual_turnover:6 cost_drag_annual:8 pct_months_at_cap:6 mean_leverage:7 financing_total:2 regt_breach_months:i", "metrics", lambda s, d: B.metrics(_bt(s, d), RULES))
add("adherence_blocks", "strategy block:i bvol:7 bret:7", "blocks", lambda s, d: B.blocks(_bt(s, d)))
add("adherence", "strategy realized_vol:7 vol_target_gap:7 mad_roll_overlap:7 mad_nonoverlap:7 vol_of_vol:7 frac_within_10pct:6 frac_within_25pct:6 n_blocks:i", "adherence", lambda s, d: B.adherence(_bt(s, d), RULES))
add("drawdown_islands", "strategy first_day:d last_day:d days:i", "islands", lambda s, d: B.underwater(_bt(s, d)))
add("longest_drawdown", "strategy first_day:d last_day:d days_underwater_longest:i days_underwater_total:i", "longest", lambda s, d: B.longest_underwater(_bt(s, d)))
add("risk_return", "strategy ann_mean_excess:6 ann_vol:7 sharpe_excess:6 max_drawdown:7 cagr:7 calmar:5 skew:5 excess_kurtosis:4 monthly_q05:7 monthly_q01:7 mean_weight:7 w_q05:7 w_q50:7 w_q95:7 pct_months_at_cap:6 pct_months_at_zero:6 mean_monthly_turnover:7 cost_drag_annual:8 cash_credit_usd:2 borrow_paid_usd:2 days_underwater_total:i days_underwater_longest:i", "riskret", lambda s, d: B.risk_return(_bt(s, d), RULES))
add("return_gap", "strategy gap_ann:7 market_exposure:7 vol_timing:7 financing:7 transaction_cost:7 residual:7", "gapq", lambda s, d: B.return_gap(_bt(s, d), RULES))
add("sharpe_decomposition", "strategy sharpe_excess:6 sharpe_total:6 w_bar:7 term_wbar_ann:7 term_cov_ann:7 term_drag_ann:7 mean_gross_ann:7 recon_residual:8", "sharped", lambda s, d: B.sharpe_decomposition(_bt(s, d), RULES))
add("subperiod_metrics", "subperiod strategy n_months:i realized_vol:7 mad_nonoverlap:7 sharpe_excess:5", "subp", lambda s, d: B.subperiods(_bt(s, d), SPANS, RULES))
add("signed_adherence", "strategy mean_bvol:7 rms_bvol:7 vov:7 signed_dev:7 level:7 concavity:7", "signedq", lambda s, d: B.signed_adherence(_bt(s, d), RULES))
add("rebased_equity", "strategy date:d growth:7", "(SELECT strategy, date, equity / first_value(equity) OVER (PARTITION BY strategy ORDER BY date) AS growth FROM bt)", lambda s, d: _bt(s, d).withColumn("growth", F.col("equity") / F.first("equity").over(M.ordered(["strategy"]))))
add("rolling_sharpe", "strategy date:d sharpe:5", "(SELECT strategy, date, CASE WHEN count(ex) OVER w = 504 THEN avg(ex) OVER w / stddev_samp(ex) OVER w * sqrt(252) END AS sharpe FROM roll WINDOW w AS (PARTITION BY strategy ORDER BY date ROWS BETWEEN 503 PRECEDING AND CURRENT ROW))",
    lambda s, d: (lambda b, w: b.withColumn("ex", F.col("ret") - F.col("cash_ret")).withColumn("sharpe", F.when(F.count("ex").over(w) == 504, F.avg("ex").over(w) / F.stddev_samp("ex").over(w) * F.sqrt(F.lit(252.0)))))(_bt(s, d), stats.rows_back(["strategy"], "date", 504)))

# ---------------------------------------------------------------- evaluation
add("evaluation_frame", "date:d model v:10 rv:10", "frame", _frame)
add("loss_table", "model min_forecast:10 qlike_mean:7 qlike_se:7 mse_mean:13 mse_se:13 qlike_rank:i mse_rank:i", "losst", lambda s, d: E.loss_table(_losses(s, d)))
add("loss_concentration", "loss model full_mean:12 calm_mean:12 top_share:6 rank_full:i rank_calm:i", "conc", lambda s, d: E.loss_concentration(_losses(s, d), CRISES))
add("dm_pairs", "loss a b dm:5 p:6 lag:i acf1:6 mean_diff:12 n:i", "(SELECT *, 2 * " + stats.norm_tail_sql("abs(dm)") + " AS p FROM (SELECT loss, a, b, mean / sqrt(CASE WHEN hac_var > 0 THEN hac_var END) AS dm, lag, acf1, mean AS mean_diff, n FROM dmh))", lambda s, d: E.diebold_mariano(_losses(s, d)))
def _mz(frame: DataFrame) -> DataFrame:
    frame = cut(frame)
    a, b, c = (E.mincer_zarnowitz(frame, k) for k in (3, 5, 8))
    return a.unionByName(b).unionByName(c)
add("mincer_zarnowitz", "model lag:i a:9 b:5 r2:6 se_a:9 se_b:5 wald:3 wald_p:6 n:i", "mz", lambda s, d: _mz(_frame(s, d)))
add("spearman_matrix", "a b rho:8", "(SELECT a, b, rho FROM (SELECT 'overnight_var' AS a, 'rs' AS b, corr(ro, rr) AS rho FROM ranks UNION ALL SELECT 'overnight_var', 'rv_daily', corr(ro, rv) FROM ranks UNION ALL SELECT 'rs', 'rv_daily', corr(rr, rv) FROM ranks))",
    lambda s, d: E.spearman(_traded(_meas(s, d)), ["overnight_var", "rs", "rv_daily"]))
add("ledoit_wolf", "i j diff:8 z:5 p:6 lag:i", "(SELECT *, 2 * " + stats.norm_tail_sql("abs(z)") + " AS p FROM lw)", lambda s, d: E.ledoit_wolf(_bt(s, d)))
add("deflated_sharpe_inputs", "strategy sr:8 g3:5 g4:4 n:i", "dsr", lambda s, d: E.deflated_sharpe(_bt(s, d), 19))
_BEST = (1 - stats.EULER) * NormalDist().inv_cdf(1 - 1 / 19) + stats.EULER * NormalDist().inv_cdf(1 - 1 / (19 * math.e))
add("deflated_sharpe", "strategy sr:8 sr0:8 z:5 dsr:6", "(SELECT *, CASE WHEN z > 0 THEN 1 - t ELSE t END AS dsr FROM (SELECT *, " + stats.norm_tail_sql("abs(z)") + f" AS t FROM (SELECT *, (sr - sr0) * sqrt(n - 1) / sqrt(1 - g3 * sr + (g4 - 1) / 4 * sr * sr) AS z FROM (SELECT *, sqrt(var_samp(sr) OVER ()) * {_BEST!r} AS sr0 FROM dsr))))", lambda s, d: E.deflated_sharpe(_bt(s, d), 19))
add("confidence_sets", "loss block:i model mcs_p:4 retained", None, lambda s, d: E.model_confidence_sets(_losses(s, d), [2, 5, 10]))
add("adherence_bootstrap", "block_days:i strategy point:6 ci90_lo:6 ci90_hi:6 p_best:4", None, lambda s, d: E.adherence_bootstrap(_bt(s, d), RULES.target, [42, 105, 210]))

# ---------------------------------------------------------------- combinations of the above
C |= {
    "ranksx": "SELECT l.model, l.qlike_mean AS qlike, a.mad_nonoverlap AS adherence_mad, m.sharpe_excess AS sharpe FROM losst l JOIN adherence a ON a.strategy = l.model JOIN metrics m ON m.strategy = l.model",
    "btw": "SELECT *, max(equity) OVER u AS wpeak, ret - cash_ret AS wex FROM bt WHERE date >= DATE '1999-01-01' WINDOW u AS (PARTITION BY strategy ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
}
def _cross(s: SparkSession, d: str) -> DataFrame:
    l = E.loss_table(_losses(s, d)).select("model", F.col("qlike_mean").alias("qlike"))
    a = B.adherence(_bt(s, d), RULES).select(F.col("strategy").alias("model"), F.col("mad_nonoverlap").alias("adherence_mad"))
    m = B.metrics(_bt(s, d), RULES).select(F.col("strategy").alias("model"), F.col("sharpe_excess").alias("sharpe"))
    j = l.join(a, "model").join(m, "model").withColumn("all", F.lit(1)).withColumn("neg", -F.col("sharpe"))
    return j.withColumn("qlike_rank", stats.average_rank("qlike", ["all"])).withColumn("adherence_rank", stats.average_rank("adherence_mad", ["all"])).withColumn("sharpe_rank", stats.average_rank("neg", ["all"]))
add("cross_layer_ranks", "model qlike:7 adherence_mad:7 sharpe:6 qlike_rank:2 adherence_rank:2 sharpe_rank:2", "(SELECT *, CAST(rank() OVER (ORDER BY qlike) AS DOUBLE) AS qlike_rank, CAST(rank() OVER (ORDER BY adherence_mad) AS DOUBLE) AS adherence_rank, CAST(rank() OVER (ORDER BY sharpe DESC) AS DOUBLE) AS sharpe_rank FROM ranksx)", _cross)
def _z_grid(bt: DataFrame) -> DataFrame:
    z = E.ledoit_wolf(bt).select("i", "j", "z")
    names = bt.select("strategy").distinct()
    z = z.unionByName(z.select(F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("z")).alias("z"))).unionByName(names.select(F.col("strategy").alias("i"), F.col("strategy").alias("j"), F.lit(0.0).alias("z")))
    return z.withColumn("p", stats.two_sided("z"))
add("sharpe_matrix", "i j z:5 p:6", "(SELECT *, 2 * " + stats.norm_tail_sql("abs(z)") + " AS p FROM (SELECT i, j, z FROM lw UNION ALL SELECT j, i, -z FROM lw UNION ALL SELECT DISTINCT strategy, strategy, 0 FROM roll))", lambda s, d: _z_grid(_bt(s, d)))
add("models_sharpe_matrix", "i j z:5 p:6", None, lambda s, d: _z_grid(_model_bt(s, d)))
add("undershoot", "n:i corr_dev_vov:6 mean_dev:7 bias_term:8", f"(SELECT count(*) AS n, corr(signed_dev, vov) AS corr_dev_vov, avg(signed_dev) AS mean_dev, {RULES.target} * (1 - 1 / (4 * 20e0)) - {RULES.target} AS bias_term FROM signedq)",
    lambda s, d: B.signed_adherence(_bt(s, d), RULES).agg(F.count(F.lit(1)).alias("n"), F.corr("signed_dev", "vov").alias("corr_dev_vov"), F.avg("signed_dev").alias("mean_dev"), F.lit(RULES.target * (1 - 1 / 80) - RULES.target).alias("bias_term")))
add("windowed_metrics", "strategy final_equity:2 realized_vol:7 sharpe_excess:6 max_drawdown:7 skew:5", "(SELECT strategy, arg_max(equity, date) AS final_equity, stddev_samp(ret) * sqrt(252) AS realized_vol, avg(wex) / stddev_samp(wex) * sqrt(252) AS sharpe_excess, min(equity / wpeak - 1) AS max_drawdown, skewness(ret) AS skew FROM btw GROUP BY strategy)",
    lambda s, d: B.metrics(_bt(s, d), RULES, since="1999-01-01"))
add("summary_table", "strategy final cagr vol", "(SELECT strategy, CASE WHEN final_equity >= 1e6 THEN printf('$%.2fM', final_equity / 1e6) ELSE printf('$%.0fk', final_equity / 1e3) END AS final, printf('%.1f%%', 100 * cagr) AS cagr, printf('%.1f%%', 100 * realized_vol) AS vol FROM metrics)",
    lambda s, d: B.metrics(_bt(s, d), RULES).select("strategy", F.when(F.col("final_equity") >= 1e6, F.format_string("$%.2fM", F.col("final_equity") / 1e6)).otherwise(F.format_string("$%.0fk", F.col("final_equity") / 1e3)).alias("final"), F.format_string("%.1f%%", 100 * F.col("cagr")).alias("cagr"), F.format_string("%.1f%%", 100 * F.col("realized_vol")).alias("vol")))
add("governing_groups", "governing:d origins:i", "(SELECT p.date AS governing, count(*) AS origins FROM forecast_v21 f ASOF JOIN (SELECT source, model, dist, date, arg_max(sigma2_next, param_id) AS sigma2_next FROM param_paths WHERE date IS NOT NULL AND source IS NOT NULL AND sigma2_next IS NOT NULL GROUP BY ALL) p ON f.source = p.source AND f.model = p.model AND f.dist = p.dist AND f.date >= p.date GROUP BY 1)",
    lambda s, d: _governing(s, d).groupBy("governing").agg(F.count(F.lit(1)).alias("origins")))
add("vol_ratio", "model ratio:8", "(SELECT model, avg(sqrt(v)) / avg(sqrt(rv)) AS ratio FROM frame GROUP BY model)", lambda s, d: _frame(s, d).groupBy("model").agg((F.avg(F.sqrt("v")) / F.avg(F.sqrt("rv"))).alias("ratio")))
add("open_close_correlation", "symbol r:8", "(SELECT symbol, corr(on_ret, oc_ret) AS r FROM meas0 GROUP BY symbol)", lambda s, d: _meas(s, d).groupBy("symbol").agg(F.corr("on_ret", "oc_ret").alias("r")))
add("har_daily", "date:d refit:d v:10", None, lambda s, d: forecasts.har_daily(_traded(_meas(s, d)), _reb(s, d), least=LEAST))
def _grid_spread(s: SparkSession, d: str) -> DataFrame:
    v = _rough(s, d).where(F.col("h").isin(0.02, 0.05, 0.10, 0.15))
    v = v.withColumn("sigma", F.sqrt(252 * F.col("v"))).withColumn("w_raw", RULES.target / F.col("sigma")).withColumn("w", B.sizing_weight(F.col("v"), RULES))
    long = v.unpivot(["date", "h"], ["v", "sigma", "w_raw", "w"], "stage", "x")
    per = long.groupBy("stage", "date").agg(((F.max("x") - F.min("x")) / F.avg("x")).alias("spread"))
    return per.groupBy("stage").agg(F.avg("spread").alias("mean_spread"), F.percentile("spread", 0.95).alias("p95_spread"))
add("hurst_grid_spread", "stage mean_spread:6 p95_spread:6", None, _grid_spread)
add("adherence_pairwise", "i j p_closer:4", None, lambda s, d: E.adherence_pairwise(_bt(s, d), RULES.target))
add("interval_widths", "strategy d42:6 d105:6 d210:6", None, lambda s, d: E.adherence_bootstrap(_bt(s, d), RULES.target, [42, 105, 210]).groupBy("strategy").pivot("block_days", [42, 105, 210]).agg(F.max(F.col("ci90_hi") - F.col("ci90_lo"))).select("strategy", F.col("42").alias("d42"), F.col("105").alias("d105"), F.col("210").alias("d210")))
add("parquet_footers", "file row_group:i rows:i lo hi", None, lambda s, d: files.footers(s, f"{d}/qqq_1m.parquet", "ticker"))
add("egarch_daily", "date:d refit:d dist v:8", None, lambda s, d: fits.egarch_daily(cut(fits.refit(_traded(M.returns(_bars(s, d))), _reb(s, d), models=("egarch",), least=LEAST)), _traded(M.returns(_bars(s, d)))))

# ---------------------------------------------------------------- all models in evaluation and portfolio (rows only: SQL can't follow the fits)
PRIMARY = ["garch_skewt", "egarch_skewt", "gjr_skewt", "ewma", "rv", "har", "rfsv", "trailing_rv21"]
SENSITIVITY = ["rfsv_h002", "rfsv_h005", "rfsv_h010", "rfsv_h015", "garch_normal", "gjr_normal", "egarch_normal"]


@once
def _models(s: SparkSession, d: str) -> DataFrame:
    """(date, model, v) of all primary and sensitivity models at the rebalance dates with enough history."""
    m, reb = _traded(_meas(s, d)), _reb(s, d).select("date")
    fit = _fits(s, d).select("date", F.concat_ws("_", "model", "dist").alias("model"), F.col("v21").alias("v"))
    closed = _forecasts(s, d).where(F.col("model").isin("ewma", "rv21")).select("date", F.when(F.col("model") == "rv21", "rv").otherwise(F.col("model")).alias("model"), "v")
    trailing = m.select("date", F.lit("trailing_rv21").alias("model"), F.col("yz").alias("v")).join(reb, "date", "left_semi")
    har = forecasts.har_forecast(m, least=LEAST).select("date", F.lit("har").alias("model"), "v").join(reb, "date", "left_semi")
    vg = forecasts.variogram(m)
    own = forecasts.rough_forecast(m, forecasts.hurst(vg).select("symbol", "date", "h", "nu2").join(reb, "date", "left_semi")).select("date", F.lit("rfsv").alias("model"), "v")
    fixed = [forecasts.nu2_given_h(vg, h).withColumn("h", F.lit(h)).join(reb, "date", "left_semi") for h in (0.02, 0.05, 0.10, 0.15)]
    grid = forecasts.rough_forecast(m, fixed[0].unionByName(fixed[1]).unionByName(fixed[2]).unionByName(fixed[3])).select("date", F.format_string("rfsv_h%03d", F.round(100 * F.col("h")).cast("int")).alias("model"), "v")
    out = fit.unionByName(closed).unionByName(trailing).unionByName(har).unionByName(own).unionByName(grid)
    return cut(out.where(F.col("v").isNotNull()))


@once
def _model_frame(s: SparkSession, d: str) -> DataFrame:
    t = _target(s, d).where(F.col("date") >= F.lit(RULES.eval_start).cast("date"))
    return E.complete_cases(_models(s, d), t)


@once
def _model_losses(s: SparkSession, d: str) -> DataFrame:
    return cut(E.losses(_model_frame(s, d)))


@once
def _model_bt(s: SparkSession, d: str) -> DataFrame:
    rets = _traded(M.returns(_bars(s, d)))
    return cut(B.backtest(B.schedules(_models(s, d).withColumnRenamed("model", "strategy"), rets, RULES), rets, market.rates(s, d), RULES))


def _primary(df: DataFrame) -> DataFrame:
    return df.where(F.col("model").isin(PRIMARY))


def _model_sets(s: SparkSession, d: str) -> DataFrame:
    l = _model_losses(s, d)
    one, all_ = (E.model_confidence_sets(x, [2, 5, 10]).withColumn("set", F.lit(n)) for n, x in (("primary", _primary(l)), ("sensitivity", l)))
    return one.unionByName(all_)
add("models_forecasts", "date:d model v:8", None, _models)
add("models_loss_table", "model min_forecast:8 qlike_mean:7 qlike_se:7 mse_mean:13 mse_se:13 qlike_rank:i mse_rank:i", None, lambda s, d: E.loss_table(_model_losses(s, d)))
add("models_loss_concentration", "loss model full_mean:12 calm_mean:12 top_share:6 rank_full:i rank_calm:i", None, lambda s, d: E.loss_concentration(_model_losses(s, d), CRISES))
add("models_dm_pairs", "loss a b dm:5 p:6 lag:i acf1:6 mean_diff:12 n:i", None, lambda s, d: E.diebold_mariano(_primary(_model_losses(s, d))))
add("models_mincer_zarnowitz", "model lag:i a:9 b:5 r2:6 se_a:9 se_b:5 wald:3 wald_p:6 n:i", None, lambda s, d: _mz(_model_frame(s, d)))
add("models_confidence_sets", "set loss block:i model mcs_p:4 retained", None, _model_sets)
add("models_backtest_metrics", "strategy final_equity:2 cagr:7 realized_vol:7 vol_target_gap:7 sharpe_excess:6 max_drawdown:7 mean_leverage:7", None, lambda s, d: B.metrics(_model_bt(s, d), RULES))
add("models_adherence", "strategy realized_vol:7 vol_target_gap:7 mad_nonoverlap:7 vol_of_vol:7 frac_within_10pct:6 frac_within_25pct:6 n_blocks:i", None, lambda s, d: B.adherence(_model_bt(s, d), RULES))
add("models_ledoit_wolf", "i j diff:8 z:5 p:6 lag:i", None, lambda s, d: E.ledoit_wolf(_model_bt(s, d)))
add("models_deflated_sharpe", "strategy sr:8 sr0:8 z:5 dsr:6", None, lambda s, d: E.deflated_sharpe(_model_bt(s, d), 19))
add("models_adherence_bootstrap", "block_days:i strategy point:6 ci90_lo:6 ci90_hi:6 p_best:4", None, lambda s, d: E.adherence_bootstrap(_model_bt(s, d), RULES.target, [42, 105, 210]))
add("models_adherence_sets", "block_units:i model mcs_p:4 retained", None, lambda s, d: E.adherence_confidence_sets(_model_bt(s, d).where(F.col("strategy").isin(PRIMARY)), RULES.target, [2, 5, 10]))
