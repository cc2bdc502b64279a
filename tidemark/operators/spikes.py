"""Implausible readings of bar series, judged against the ordinary behaviour of their own source.

Per source a hidden Markov model with the states normal, spike, stuck and out of range runs over the prices and another over the
volume. Emissions: the deviation from the median of the bars before and of the bars after, whichever is smaller and only if both
have one sign, in units of the source's own one-minute scale (a move that lasts is near the bars after it, a surge that fades is
near them too); whether the bar repeats its predecessor, against how often the source does so; and hard bounds. Forward-backward
probabilities above one half and the hard bounds set the flags.

Hard bounds: a price <= 0, NaN or infinite, high < low, open or close outside [low, high]; a volume < 0, NaN or infinite.

No source is gathered into one task: bars get their rank within the source from day counts, and go in chunks of `chunk` ranks with
`halo` ranks on both sides, which is far more than any decision needs.

Defined cases: a null price or volume says nothing and is never flagged itself; zero volume is ordinary; bars without time or
with a null `require` key have no neighbours and are judged by the hard bounds alone; deliveries of one source and instant are one
step of the chain (the first by arrival), each then judged by its own values, so a repeated bad bar is flagged again and a corrected
one isn't; sources with few bars lean on a prior scale; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import DAY_US, floor_div

NO_KEY = "\x00none"
FIELDS = ("open", "high", "low", "close", "volume")
NORMAL, SPIKE, STUCK, OUT = range(4)
#: Chances to pass from one state to the next, by the bar.
TRANSITION = np.array([
    [1 - 3.0e-4 - 1e-10 - 1e-3, 3.0e-4, 1e-10, 1e-3],
    [0.7 - 1e-3 - 1e-10, 0.3, 1e-10, 1e-3],
    [0.02, 1e-5, 0.979, 1e-3],
    [0.9 - 1e-10, 1e-3, 1e-10, 0.1 - 1e-3],
])
#: Scale of the normal deviation's two-sided exponential tail; density of a spike's deviation; chances of a bar ending at its extreme.
TAIL, SPIKE_DENSITY, END_NORMAL, END_SPIKE = {"price": 1.0, "volume": 0.55}, 0.01, 0.02, 0.6
PRIOR_SCALE, PRIOR_WEIGHT, REPEAT_FLOOR, REPEAT_IN_STUCK, SIDE = 1.5e-3, 5.0, 0.05, 0.995, 5


def _bad(price: str) -> str:
    return f"({price} <= 0 OR isnan({price}) OR abs({price}) = double('infinity'))"


OUT_PRICE = f"coalesce({_bad('open')}, false) OR coalesce({_bad('high')}, false) OR coalesce({_bad('low')}, false) OR coalesce({_bad('close')}, false) OR coalesce(high < low, false) OR coalesce(close > high OR close < low, false) OR coalesce(open > high OR open < low, false)"
OUT_VOLUME = "coalesce(volume < 0 OR isnan(volume) OR abs(volume) = double('infinity'), false)"


def _scales(steps: DataFrame) -> DataFrame:
    """Per source: one-minute scale of log closes, scale of log volumes, chance to repeat prices or volume. Pairs within a day only, so the sort
    stays within (source, day); quantiles are mergeable sketches."""
    w = Window.partitionBy("k0", "k1", "day").orderBy("t")
    ok = ~F.col("out_price") & F.col("close").isNotNull()
    s = steps.select("k0", "k1", "day", "t", F.when(ok, F.log(F.when(F.col("close") > 0, F.col("close")))).alias("x"), F.log(F.when(F.col("volume") > 0, F.col("volume"))).alias("y"), "close", "volume")
    same_p = F.col("close") == F.lag("close").over(w)
    same_v = (F.col("volume") == F.lag("volume").over(w)) & (F.col("volume") > 0)
    minutes = (F.col("t") - F.lag("t").over(w)) / 60e6
    s = s.select("k0", "k1", "day", "t", F.abs(F.col("x") - F.lag("x").over(w)).alias("dx"), minutes.alias("dt"), F.abs(F.col("y") - F.lag("y").over(w)).alias("dy"), same_p.alias("rp"), same_v.alias("rv"))
    # repeats after four repeats on end belong to a frozen stretch, not to what the source normally does
    for r in ("rp", "rv"):
        s = s.withColumn(f"{r}4", F.coalesce(F.min(F.coalesce(F.col(r), F.lit(False)).cast("int")).over(w.rowsBetween(-4, -1)), F.lit(0)))
    near = F.col("dt").between(0, 10)

    def rate(r: str):
        free = F.col(f"{r}4") == 0
        return F.sum((free & F.col(r)).cast("int")) / F.sum((free & F.col(r).isNotNull()).cast("int"))

    return s.groupBy("k0", "k1").agg(
        F.count(F.when(near, F.col("dx"))).alias("n"),
        (F.percentile_approx(F.when(near, F.col("dx") / F.sqrt(F.greatest("dt", F.lit(1.0)))), 0.5, 2000) * 1.4826).alias("sx"),
        (F.percentile_approx("dy", 0.5, 2000) * 1.0484).alias("sy"),
        rate("rp").alias("rp"), rate("rv").alias("rv"),
    )


def _side_medians(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Medians of the SIDE values before and after each place (axis 1), of those there are."""
    n, m = x.shape
    p = np.full((n, m + 2 * SIDE), np.nan)
    p[:, SIDE : SIDE + m] = x
    w = np.sort(np.lib.stride_tricks.sliding_window_view(p, SIDE, axis=1), axis=2)
    count = np.sum(~np.isnan(w), axis=2)
    med = np.take_along_axis(w, np.maximum((count - 1) // 2, 0)[:, :, None], axis=2)[:, :, 0]
    return med[:, :m], med[:, SIDE + 1 : SIDE + 1 + m]


def _fill(x: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Missing values inside the series take the last value before them."""
    idx = np.where(np.isnan(x), 0, np.arange(x.shape[1])[None, :])
    np.maximum.accumulate(idx, axis=1, out=idx)
    out = np.take_along_axis(x, idx, axis=1)
    out[~inside] = np.nan
    return out


def _chances(b: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """For emissions b (chain, step, state): each state's chance at a step from all the other steps."""
    n, m, k = b.shape
    before, after = np.empty_like(b), np.empty_like(b)
    a = np.tile(np.array([1.0, 1e-6, 1e-6, 1e-6]), (n, 1))
    for t in range(m):
        before[:, t] = a
        a = np.where(inside[:, t, None], (a * b[:, t]) @ TRANSITION, a)
        a /= a.sum(axis=1, keepdims=True)
    a = np.ones((n, k))
    for t in range(m - 1, -1, -1):
        after[:, t] = a
        a = np.where(inside[:, t, None], (a * b[:, t]) @ TRANSITION.T, a)
        a /= a.max(axis=1, keepdims=True)
    return before * after


def _emissions(z: np.ndarray, tail: float, ends: np.ndarray | None, repeats: np.ndarray, seen: np.ndarray, rate: np.ndarray, out: np.ndarray) -> np.ndarray:
    """(.., 4) likelihoods; `seen` is False where there is no reading to judge. z beyond 100 counts as 100."""
    z = np.minimum(np.nan_to_num(z), 100.0)
    normal, spike = np.exp(-z / tail) / (2 * tail), np.where(z > 6, SPIKE_DENSITY, SPIKE_DENSITY * 1e-3)
    if ends is not None:
        normal = normal * np.where(ends, END_NORMAL, 1 - END_NORMAL)
        spike = spike * np.where(ends, END_SPIKE, 1 - END_SPIKE)
    rep_n = np.where(repeats, rate, 1 - rate)
    # a frozen stretch repeats whatever level it is at, a spike of two bars may too
    stuck = np.where(repeats, REPEAT_IN_STUCK, 1 - REPEAT_IN_STUCK) * 0.5
    e = np.stack([normal * rep_n, spike * rep_n, stuck, np.full_like(normal, 1e-12)], axis=-1)
    # a frozen close soon lies outside the bar's own range; such bars may belong to the stretch as well
    e[out] = np.stack([np.full_like(normal, 1e-12), np.full_like(normal, 1e-12), np.where(repeats, 0.5, 1e-12), np.full_like(normal, 0.1)], axis=-1)[out]
    e[~seen & ~out] = 1.0
    return e


def judge(rows: pd.DataFrame) -> pd.DataFrame:
    """Whole chunks with halo, sorted by (group, t, arrival): probabilities of spike and stuck of price and volume for each row."""
    g, t = rows["g"].to_numpy(), rows["t"].to_numpy()
    new_g = np.r_[True, g[1:] != g[:-1]]
    new_step = new_g | np.r_[True, t[1:] != t[:-1]]
    gi, si = np.cumsum(new_g) - 1, np.cumsum(new_step) - 1
    first_step = si[new_g]
    place = si - first_step[gi]
    n, m = gi[-1] + 1, place.max() + 1
    inside = np.zeros((n, m), dtype=bool)
    inside[gi, place] = True
    lead = np.flatnonzero(new_step)

    def grid(v: np.ndarray, empty: float = np.nan) -> np.ndarray:
        out = np.full((n, m), empty)
        out[gi[lead], place[lead]] = v[lead]
        return out

    of = {c: rows[c].to_numpy(dtype=float) for c in FIELDS[1:]}
    out_p, out_v = rows["out_price"].to_numpy(dtype=bool), rows["out_volume"].to_numpy(dtype=bool)
    per = rows[["n", "sx", "sy", "rp", "rv"]].astype(float).groupby(gi).max()
    k = np.nan_to_num(per["n"].to_numpy(dtype=float))
    sx = np.exp((k * np.log(np.maximum(np.nan_to_num(per["sx"].to_numpy(dtype=float)), 1e-5)) + PRIOR_WEIGHT * np.log(PRIOR_SCALE)) / (k + PRIOR_WEIGHT))
    sy = np.exp((k * np.log(np.maximum(np.nan_to_num(per["sy"].to_numpy(dtype=float)), 0.3)) + PRIOR_WEIGHT * np.log(0.8)) / (k + PRIOR_WEIGHT))
    rate_p, rate_v = (np.clip(np.nan_to_num(per[c].to_numpy(dtype=float)), REPEAT_FLOOR, 0.6) for c in ("rp", "rv"))
    minute = _fill(grid(t / 6e7), inside)
    idx = np.arange(m)
    last = np.maximum(inside.sum(axis=1) - 1, 0)[:, None]
    lo = minute - np.take_along_axis(minute, np.maximum(idx - 3, 0)[None, :].repeat(n, 0), axis=1)
    hi = np.take_along_axis(minute, np.minimum(np.minimum(idx + 3, m - 1)[None, :], last), axis=1) - minute
    pace = np.sqrt(np.clip(np.nan_to_num(np.minimum(lo, hi) / 3, nan=1.0), 1, 30))

    def logs(c: str, out: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where((of[c] > 0) & ~out & np.isfinite(of[c]), np.log(np.where(of[c] > 0, of[c], 1.0)), np.nan)

    def deviation(x_row: np.ndarray, scale: np.ndarray, up_only: bool = False) -> np.ndarray:
        """Of each row from the medians at its step. Small volumes are ordinary, so of volume only excess counts."""
        before, after = _side_medians(_fill(grid(x_row), inside))
        a, b = x_row - before[gi, place], x_row - after[gi, place]
        r = np.where(np.sign(a) == np.sign(b), np.minimum(np.abs(a), np.abs(b)), 0.0)
        if up_only:
            r = np.where(a > 0, r, 0.0)
        return np.where(np.isnan(r), 0.0, r) / scale[gi, place]

    def repeats(c: str) -> tuple[np.ndarray, np.ndarray]:
        """Row equals the last value at a step before; whether it can be told."""
        f = _fill(grid(of[c]), inside)
        prev = np.c_[np.full(n, np.nan), f[:, :-1]][gi, place]
        return of[c] == prev, ~np.isnan(of[c]) & ~np.isnan(prev)

    scale_p = sx[:, None] * pace
    z = np.max([deviation(logs(c, out_p), scale_p) for c in ("high", "low", "close")], axis=0)
    zv = deviation(logs("volume", out_v), np.repeat(sy[:, None], m, axis=1), up_only=True)
    ends = ((of["close"] == of["high"]) | (of["close"] == of["low"])) & (of["high"] > of["low"])
    rep_p, told_p = repeats("close")
    rep_v, told_v = repeats("volume")
    told_v &= of["volume"] != 0
    rep_v &= told_v
    seen_p, seen_v = ~np.isnan(of["close"]) | ~np.isnan(of["high"]) | ~np.isnan(of["low"]), ~np.isnan(of["volume"]) & (of["volume"] != 0)
    e_p = _emissions(z, TAIL["price"], ends, rep_p, seen_p, np.where(told_p, rate_p[gi], 0.5), out_p)
    e_v = _emissions(zv, TAIL["volume"], None, rep_v, seen_v, np.where(told_v, rate_v[gi], 0.5), out_v)
    chain = np.ones((2 * n, m, 4))
    chain[gi[lead], place[lead]] = e_p[lead]
    chain[n + gi[lead], place[lead]] = e_v[lead]
    rest = _chances(chain, np.concatenate([inside, inside]))
    res = {"bar": rows["bar"].to_numpy(), "own": rows["own"].to_numpy()}
    for name, e, off in (("price", e_p, 0), ("volume", e_v, n)):
        post = rest[gi + off, place] * e
        post /= np.maximum(post.sum(axis=1, keepdims=True), 1e-300)
        seen = seen_p if name == "price" else seen_v
        res[f"{name}_spike"], res[f"{name}_stuck"] = np.where(seen, post[:, SPIKE], 0.0), np.where(seen, post[:, STUCK], 0.0)
    return pd.DataFrame(res)


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rest: list[pd.DataFrame] = []
    size = 0
    for b in batches:
        rest.append(b)
        size += len(b)
        if size < 40_000:
            continue
        all_rows = pd.concat(rest, ignore_index=True)
        g = all_rows["g"].to_numpy()
        cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if (g != g[-1]).any() else 0
        if cut:
            r = judge(all_rows.iloc[:cut])
            yield r[r["own"]].drop(columns="own")
        rest, size = [all_rows.iloc[cut:]], len(all_rows) - cut
    if size:
        r = judge(pd.concat(rest, ignore_index=True))
        yield r[r["own"]].drop(columns="own")


def implausible_bars(df: DataFrame, keys: tuple[str, str] = ("feed", "ticker"), bar: str = "bar_id", ts: str = "timestamp", arrival: str = "ingested_at", *, require: tuple[str, ...] = ("ticker",), chunk: int = 512, halo: int = 64) -> tuple[DataFrame, DataFrame, list[str]]:
    """Three parts: the probabilities `price_spike`, `price_stuck`, `volume_spike`, `volume_stuck` of the bars the model has something to say about,
    every bar with its hard bounds `out_price` and `out_volume`, and the names of the probabilities."""
    base = df.select(
        F.col(bar).alias("bar"), *[F.coalesce(F.col(k).cast("string"), F.lit(NO_KEY)).alias(f"k{i}") for i, k in enumerate(keys)], F.unix_micros(ts).alias("t"), F.unix_micros(arrival).alias("ing"),
        *[F.col(c).cast("double").alias(c) for c in FIELDS],
    ).withColumn("out_price", F.expr(OUT_PRICE)).withColumn("out_volume", F.expr(OUT_VOLUME)).drop("open")
    placed = F.col("t").isNotNull()
    for i, k in enumerate(keys):
        if k in require:
            placed &= F.col(f"k{i}") != NO_KEY
    seq = base.where(placed).withColumn("day", floor_div(F.col("t"), DAY_US).cast("int"))
    w = Window.partitionBy("k0", "k1", "day").orderBy("t")
    first = F.row_number().over(w.orderBy("t", "ing", "bar")) == F.rank().over(w)
    scales = _scales(seq.select("k0", "k1", "day", "t", "ing", "bar", "close", "volume", "out_price").withColumn("first", first).where("first"))
    days = seq.select("k0", "k1", "day", "t").withColumn("step", F.dense_rank().over(w)).groupBy("k0", "k1", "day").agg(F.max("step").alias("steps"))
    upto = Window.partitionBy("k0", "k1").orderBy("day")
    starts = days.select("k0", "k1", "day", (F.sum("steps").over(upto) - F.col("steps")).alias("start"))
    about = starts.join(scales, ["k0", "k1"])
    ranked = seq.withColumn("step", F.dense_rank().over(w)).join(about, ["k0", "k1", "day"]).withColumn("rank", F.col("start") + F.col("step") - 1)
    own = floor_div(F.col("rank"), chunk)
    # the source's scales go with one rank in each `halo`, of which every chunk has one
    told = F.pmod(F.col("rank"), F.lit(halo)) == 0
    scale = ["n", "sx", "sy", "rp", "rv"]
    chunks = F.explode(F.sequence(F.greatest(floor_div(F.col("rank") - halo, chunk), F.lit(0)), floor_div(F.col("rank") + halo, chunk)))
    sent = ranked.select("k0", "k1", chunks.alias("c"), own.alias("oc"), "t", "ing", "bar", *FIELDS[1:], "out_price", "out_volume", *[F.when(told, F.col(x)).alias(x) for x in scale])
    sent = sent.select(F.xxhash64("k0", "k1", "c").alias("g"), (F.col("c") == F.col("oc")).alias("own"), "t", "ing", "bar", *FIELDS[1:], "out_price", "out_volume", *scale)
    odds = sent.repartition("g").sortWithinPartitions("g", "t", "ing", "bar").drop("ing").mapInPandas(_run, "bar bigint, price_spike double, price_stuck double, volume_spike double, volume_stuck double")
    probs = ["price_spike", "price_stuck", "volume_spike", "volume_stuck"]
    return odds, base, probs


def flagged_bars(df: DataFrame, **how) -> DataFrame:
    """The bars that can't be genuine: `bar` and its reasons."""
    odds, base, probs = implausible_bars(df, **how)
    hard = base.where(F.col("out_price") | F.col("out_volume")).select("bar", F.lit(1.0).alias("out_of_range"), *[F.lit(0.0).alias(p) for p in probs])
    soft = odds.where(F.greatest(*probs) > 0.5).select("bar", F.lit(0.0).alias("out_of_range"), *probs)
    return hard.unionByName(soft).groupBy("bar").agg(*[F.max(c).alias(c) for c in ("out_of_range", *probs)])
