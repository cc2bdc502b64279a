"""Likelihood fits of GARCH-type models on expanding windows, their filters, carry-forward, and Monte Carlo of EGARCH.

One row of the task table is one fit (date, model, dist); tasks are spread over the cluster, each with the returns up to its date. The
optimiser is Nelder and Mead's simplex in numpy on transformed parameters, so every trial point satisfies the constraints.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MODELS, DISTS = ("garch", "gjr", "egarch"), ("normal", "skewt")
ROOT_2_PI = math.sqrt(2 / math.pi)


def simplex(f: Callable[[np.ndarray], float], start: np.ndarray, *, step: float = 0.3, most: int = 400, tol: float = 1e-6) -> tuple[np.ndarray, float, bool]:
    """Minimum by the simplex method: point, value, whether it converged within `most` evaluations."""
    n = len(start)
    pts = np.vstack([start, *[start + step * np.eye(n)[i] for i in range(n)]])
    val = np.array([f(p) for p in pts])
    used = n + 1
    while used < most:
        order = np.argsort(val)
        pts, val = pts[order], val[order]
        if abs(val[-1] - val[0]) <= tol * (abs(val[0]) + tol) and np.abs(pts - pts[0]).max() < 1e-3:
            return pts[0], float(val[0]), True
        mid = pts[:-1].mean(axis=0)
        x = mid + (mid - pts[-1])
        fx = f(x)
        used += 1
        if fx < val[0]:
            y = mid + 2 * (mid - pts[-1])
            fy = f(y)
            used += 1
            pts[-1], val[-1] = (y, fy) if fy < fx else (x, fx)
        elif fx < val[-2]:
            pts[-1], val[-1] = x, fx
        else:
            y = mid + 0.5 * ((x if fx < val[-1] else pts[-1]) - mid)
            fy = f(y)
            used += 1
            if fy < min(fx, val[-1]):
                pts[-1], val[-1] = y, fy
            else:
                pts[1:] = pts[0] + 0.5 * (pts[1:] - pts[0])
                val[1:] = [f(p) for p in pts[1:]]
                used += n
    best = int(np.argmin(val))
    return pts[best], float(val[best]), False


def _sig(x: float) -> float:
    return 1 / (1 + math.exp(-max(min(x, 30), -30)))


def linear_filter(beta: float, drive: np.ndarray, first: float, width: int = 64) -> np.ndarray:
    """s[0] = first, s[t] = beta s[t-1] + drive[t-1], in blocks: one triangular product for each, the carry between them."""
    n = len(drive) + 1
    out = np.empty(n)
    out[0] = first
    k = np.arange(width)
    tri = np.where(k[:, None] >= k[None, :], beta ** np.maximum(k[:, None] - k[None, :], 0), 0.0)
    decay = beta ** (k + 1.0)
    for lo in range(0, n - 1, width):
        d = drive[lo : lo + width]
        m = len(d)
        out[lo + 1 : lo + 1 + m] = tri[:m, :m] @ d + decay[:m] * out[lo]
    return out


def variance_path(model: str, p: dict[str, float], r: np.ndarray, known: int | None = None) -> np.ndarray:
    """Conditional variances s2[0..n] of centred returns; the last is the next day's. The first is the mean square of the first `known` (or all)."""
    long_run = float((r[:known] * r[:known]).mean())
    if model in ("garch", "gjr"):
        g = p.get("gamma", 0.0) if model == "gjr" else 0.0
        omega = long_run * (1 - p["alpha"] - p["beta"] - g / 2)
        return np.maximum(linear_filter(p["beta"], omega + (p["alpha"] + g * (r < 0)) * r * r, long_run), 1e-12)
    log_s = math.log(long_run)
    out = [log_s]
    w, a, g, b = p["omega"], p["alpha"], p["gamma"], p["beta"]
    w -= a * ROOT_2_PI
    exp = math.exp
    for c in (r * (g + a * np.sign(r))).tolist():  # alpha |z| + gamma z is c / sigma
        log_s = w + c * exp(-0.5 * log_s) + b * log_s
        if not -50.0 <= log_s <= 50.0:
            log_s = 50.0 if log_s > 50.0 else -50.0
        out.append(log_s)
    return np.exp(np.array(out))


def log_density(z: np.ndarray, s2: np.ndarray, dist: str, eta: float = 8.0, lam: float = 0.0) -> float:
    """Sum of log densities of standardised returns: Gaussian, or Hansen's (1994) skewed t."""
    base = -0.5 * np.log(s2).sum()
    if dist == "normal":
        return float(base - 0.5 * (len(z) * math.log(2 * math.pi) + (z * z).sum()))
    c = math.exp(math.lgamma((eta + 1) / 2) - math.lgamma(eta / 2)) / math.sqrt(math.pi * (eta - 2))
    a = 4 * lam * c * (eta - 2) / (eta - 1)
    b = math.sqrt(1 + 3 * lam * lam - a * a)
    u = (b * z + a) / np.where(z < -a / b, 1 - lam, 1 + lam)
    return float(base + len(z) * math.log(b * c) - (eta + 1) / 2 * np.log1p(u * u / (eta - 2)).sum())


def _unpack(model: str, dist: str, x: np.ndarray) -> dict[str, float]:
    if model == "garch":
        total, share = (1 - 1e-6) * _sig(x[0]), _sig(x[1])
        p = {"alpha": total * share, "beta": total * (1 - share)}
    elif model == "gjr":
        total, share, lean = (1 - 1e-6) * _sig(x[0]), _sig(x[1]), math.tanh(x[2])
        both = total * share  # alpha + gamma / 2; |lean| < 1 keeps alpha and alpha + gamma positive
        gamma = min(max(2 * both * lean, -0.5), 1.0)
        p = {"alpha": both - gamma / 2, "gamma": gamma, "beta": total * (1 - share)}
    else:
        p = {"omega": x[0], "alpha": x[1], "gamma": x[2], "beta": math.tanh(x[3])}
    if dist == "skewt":
        p |= {"eta": 2.05 + 297.95 * _sig(x[-2]), "lambda": math.tanh(x[-1])}
    return p


def fit(model: str, dist: str, returns: np.ndarray, most: int = 8000) -> dict:
    """Maximum likelihood on percent returns, centred; variances come back in the returns' own unit. The simplex starts again from its best point
    until that gains nothing more: only then is the fit converged. `most` is a guard in evaluations of the likelihood over all starts."""
    r = (returns - returns.mean()) * 100
    level = math.log(float((r * r).mean()))
    start = {"garch": [3.0, -2.9], "gjr": [3.0, -2.9, 0.55], "egarch": [0.05 * level, 0.1, -0.05, 1.8]}[model]
    x = np.array([*start, *([-3.9, -0.05] if dist == "skewt" else [])])
    used = 0

    def loss(x: np.ndarray) -> float:
        nonlocal used
        used += 1
        p = _unpack(model, dist, x)
        s2 = variance_path(model, p, r)[:-1]
        v = -log_density(r / np.sqrt(s2), s2, dist, p.get("eta", 8.0), p.get("lambda", 0.0))
        return v if math.isfinite(v) else 1e12

    value, done = math.inf, False
    while not done and used < most:
        before = value
        x, value, ok = simplex(loss, x, most=most - used)
        done = ok and before - value <= 1e-6 * (abs(value) + 1)
    return {"params": _unpack(model, dist, x), "loglik": -value, "converged": done, "evaluations": used}


def plain_garch_level(returns: np.ndarray, most: int = 8000) -> tuple[float, bool]:
    """Long-run variance omega / (1 - alpha - beta) of a Gaussian GARCH(1,1) whose omega is free, and whether the fit converged."""
    r = (returns - returns.mean()) * 100
    q, start = (r * r).tolist(), float((r * r).mean())

    def loss(x: np.ndarray) -> float:
        total, share = (1 - 1e-6) * _sig(x[0]), _sig(x[1])
        a, b, level = total * share, total * (1 - share), math.exp(min(max(x[2], -50.0), 50.0))
        omega, s2, acc = level * (1 - total), start, 0.0
        for v in q:
            acc += math.log(s2) + v / s2
            s2 = omega + a * v + b * s2
        return acc / 2

    x, value, done, used = np.array([3.0, -2.9, math.log(start)]), math.inf, False, 0
    while not done and used < most:
        before = value
        x, value, ok = simplex(loss, x, most=most - used)
        used += most // 8
        done = ok and before - value <= 1e-6 * (abs(value) + 1)
    return math.exp(x[2]) / 1e4, done


def level_sensitivity(rets: DataFrame, month: str, threshold: float = 0.10) -> DataFrame:
    """Per symbol the plain GARCH level with all returns and without those of `month` (YYYY-MM), the relative change and a flag above `threshold`."""
    kind = rets.schema["symbol"].dataType.simpleString()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date")
        keep = ~g["date"].astype(str).str.startswith(month)
        (with_, a), (without, b) = plain_garch_level(g["log_ret"].to_numpy()), plain_garch_level(g.loc[keep, "log_ret"].to_numpy())
        change = with_ / without - 1
        return pd.DataFrame({"symbol": [g["symbol"].iloc[0]], "level": [with_], "level_without": [without], "change": [change], "flag": [abs(change) > threshold], "converged": [a and b]})

    # a symbol's history is one row a day, the input every fit needs whole
    r = rets.where(F.col("log_ret").isNotNull()).select("symbol", "date", "log_ret")
    return r.groupBy("symbol").applyInPandas(run, f"symbol {kind}, level double, level_without double, change double, flag boolean, converged boolean")


def state(model: str, params: dict[str, float], returns: np.ndarray) -> dict[str, float]:
    """Filter with fixed parameters: long-run and next variance, persistence."""
    r = (returns - returns.mean()) * 100
    nxt = float(variance_path(model, params, r)[-1]) / 1e4
    if model == "egarch":
        return {"sig2bar": float("nan"), "sigma2_next": nxt, "persistence": params["beta"]}
    return {"sig2bar": float((r * r).mean()) / 1e4, "sigma2_next": nxt, "persistence": params["alpha"] + params["beta"] + params.get("gamma", 0.0) / 2}


def closed_form(sig2bar: float, nxt: float, phi: float, h: int) -> float:
    lam = 1.0 if abs(phi - 1) < 1e-12 else (1 - phi**h) / (h * (1 - phi))
    return sig2bar + lam * (nxt - sig2bar)


def shocks(params: dict[str, float], n: int, rng: np.random.Generator) -> np.ndarray:
    """Standardised draws of the distribution the parameters were fitted under: Hansen's skewed t if they hold its shape, else Gaussian."""
    if "eta" not in params:
        return rng.standard_normal(n)
    eta, lam = params["eta"], params["lambda"]
    c = math.exp(math.lgamma((eta + 1) / 2) - math.lgamma(eta / 2)) / math.sqrt(math.pi * (eta - 2))
    a = 4 * lam * c * (eta - 2) / (eta - 1)
    b = math.sqrt(1 + 3 * lam * lam - a * a)
    # two halves of a t scaled to unit variance: the left with chance (1 - lambda) / 2 and stretched by 1 - lambda, the right by 1 + lambda
    t = np.abs(rng.standard_t(eta, n)) * math.sqrt((eta - 2) / eta)
    u = np.where(rng.random(n) < (1 - lam) / 2, -(1 - lam) * t, (1 + lam) * t)
    return (u - a) / b


def egarch_path(params: dict[str, float], sigma2_next: float, h: int, paths: int, rng: np.random.Generator) -> np.ndarray:
    """Expected variance of each of the next h days by simulation with shocks of the fitted distribution."""
    log_s = np.full(paths, math.log(sigma2_next * 1e4))
    out = []
    for k in range(h):
        out.append(float(np.exp(log_s).mean()) / 1e4)
        if k + 1 < h:
            z = shocks(params, paths, rng)
            log_s = np.clip(params["omega"] + params["alpha"] * (np.abs(z) - ROOT_2_PI) + params["gamma"] * z + params["beta"] * log_s, -50, 50)
    return np.array(out)


def simulate_garch_mean(alpha: float, beta: float, sig2bar: float, nxt: float, h: int, paths: int, rng: np.random.Generator) -> tuple[float, float]:
    """Mean of the average variance over h days and its standard error, to check the closed form."""
    s, total = np.full(paths, nxt), np.zeros(paths)
    for _ in range(h):
        total += s
        s = sig2bar * (1 - alpha - beta) + (alpha * rng.standard_normal(paths) ** 2 + beta) * s
    avg = total / h
    return float(avg.mean()), float(avg.std(ddof=1) / math.sqrt(paths))


FIELDS = "symbol string, date date, seq int, model string, dist string, converged boolean, carried boolean, n int, loglik double, persistence double, sig2bar double, sigma2_next double, v21 double, params map<string,double>"


#: Into how many pieces the tasks of a symbol are dealt; each piece gets the symbol's history once.
PIECES = 512


def _beside_history(tasks: DataFrame, rets: DataFrame, run, schema: str) -> DataFrame:
    """`run(tasks, history)` over pieces of each symbol's tasks, with the symbol's history in order of date. The count of partitions is a fixed
    one, as tasks are long and their rows small: left to itself, the planner would put them into one."""
    n = 16 * rets.sparkSession.sparkContext.defaultParallelism
    keys = ["symbol", "piece"]
    left = tasks.withColumn("piece", F.pmod(F.xxhash64(*[c for c in tasks.columns if c != "params"]), F.lit(PIECES)).cast("int")).repartition(n, *keys)
    right = rets.select(F.col("symbol").alias("of"), F.col("date").alias("at"), F.col("log_ret").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("part")).repartition(n, "of", "part")

    def both(t: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        r = r.sort_values("at")
        return run(t, r["at"].to_numpy(), r["x"].to_numpy(dtype=float))

    return left.groupBy(*keys).cogroup(right.groupBy("of", "part")).applyInPandas(both, schema)


def refit(rets: DataFrame, dates: DataFrame, *, models: tuple[str, ...] = MODELS, dists: tuple[str, ...] = DISTS, least: int = 1000, h: int = 21, paths: int = 10_000, seed: int = 0, most: int = 8000) -> DataFrame:
    """Every date x model x distribution on the returns up to the date, where there are at least `least`. A fit that doesn't converge takes the
    last converged parameters of its model before it, filtered on the data of its own date; without one it gives no forecast.

    The first pass fits in parallel; the carry is a window over (model, dist); the second pass only filters.
    """
    r = rets.where(F.col("log_ret").isNotNull()).select("symbol", "date", "log_ret")
    grid = [F.struct(F.lit(m).alias("model"), F.lit(d).alias("dist")) for m in models for d in dists]
    tasks = r.select("symbol", "date").join(dates.select("date", "seq"), "date").withColumn("t", F.explode(F.array(*grid))).select("symbol", "date", F.col("seq").cast("int").alias("seq"), "t.model", "t.dist")

    def first(t: pd.DataFrame, at: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        rows = []
        for k in t.itertuples():
            n = int(np.searchsorted(at, k.date, side="right"))
            if n >= least:
                f = fit(k.model, k.dist, x[:n], most)
                rows.append((k.symbol, k.date, k.seq, k.model, k.dist, f["converged"], f["loglik"], f["params"] if f["converged"] else None))
        return pd.DataFrame(rows, columns=["symbol", "date", "seq", "model", "dist", "converged", "loglik", "params"])

    fitted = _beside_history(tasks, r, first, "symbol string, date date, seq int, model string, dist string, converged boolean, loglik double, params map<string,double>")
    past = Window.partitionBy("symbol", "model", "dist").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    carried = fitted.withColumn("params", F.last("params", ignorenulls=True).over(past)).withColumn("carried", ~F.col("converged") & F.col("params").isNotNull())

    def second(t: pd.DataFrame, at: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        rows = []
        for k in t.itertuples():
            n = int(np.searchsorted(at, k.date, side="right"))
            p = dict(k.params) if k.params is not None else None
            s = state(k.model, p, x[:n]) if p else {"sig2bar": None, "sigma2_next": None, "persistence": None}
            v = None
            if p:
                v = float(egarch_path(p, s["sigma2_next"], h, paths, np.random.default_rng([seed, k.seq])).mean()) if k.model == "egarch" else closed_form(s["sig2bar"], s["sigma2_next"], s["persistence"], h)
            sb = s["sig2bar"]
            rows.append((k.symbol, k.date, k.seq, k.model, k.dist, k.converged, k.carried, n, k.loglik, s["persistence"], None if sb is None or sb != sb else sb, s["sigma2_next"], v, p))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.replace("map<string,double>", "map").split(", ")])

    return _beside_history(carried.select("symbol", "date", "seq", "model", "dist", "converged", "carried", "loglik", "params"), r, second, FIELDS)


def egarch_daily(refits: DataFrame, rets: DataFrame, *, h: int = 21, paths: int = 10_000, seed: int = 0) -> DataFrame:
    """EGARCH forecasts for every day with the parameters of the last refit before or on it: each refit filters the returns once, centred by
    the mean known at the refit, and simulates from each day's state, for each distribution. (symbol, date, refit, dist, v)"""
    p = refits.where((F.col("model") == "egarch") & F.col("params").isNotNull()).select("symbol", "dist", F.col("date").alias("refit"), "seq", "params")
    p = p.withColumn("upto", F.lead("refit").over(Window.partitionBy("symbol", "dist").orderBy("refit")))
    r = rets.where(F.col("log_ret").isNotNull()).select("symbol", "date", "log_ret")

    def run(t: pd.DataFrame, at: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        rows = []
        for k in t.itertuples():
            known = int(np.searchsorted(at, k.refit, side="right"))
            start = int(np.searchsorted(at, k.refit, side="left"))
            end = len(at) if k.upto is None or k.upto != k.upto else int(np.searchsorted(at, k.upto, side="left"))
            if end <= start:
                continue
            params = dict(k.params)
            path = variance_path("egarch", params, (x[:end] - x[:known].mean()) * 100, known)
            rng = np.random.default_rng([seed, int(k.seq)])
            rows += [(k.symbol, at[i], k.refit, k.dist, float(egarch_path(params, path[i + 1] / 1e4, h, paths, rng).mean())) for i in range(start, end)]
        return pd.DataFrame(rows, columns=["symbol", "date", "refit", "dist", "v"])

    return _beside_history(p, r, run, "symbol string, date date, refit date, dist string, v double")
