"""Statistics that hold for series of any length, against plain loops."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import evaluation as E
from tidemark.operators import forecasts


def test_ewma_of_a_long_series(spark):
    n, lam = 13_000, 0.94
    r = np.random.default_rng(1).normal(0, 0.01, n)
    df = spark.createDataFrame([("a", dt.date(1950, 1, 1) + dt.timedelta(i), float(x)) for i, x in enumerate(r)], "symbol string, date date, log_ret double")
    got = [x["ewma"] for x in forecasts.ewma(df).orderBy("date").select("ewma").collect()]
    q, level = r * r, 0.0
    for i in range(n):
        level = lam * level + (1 - lam) * q[i]
        assert got[i] == pytest.approx(level + lam ** (i + 1) * q[: i + 1].mean(), rel=1e-9)


@pytest.mark.parametrize("n", [30, 400])
def test_hac_for_any_lag(spark, monkeypatch, n):
    x = np.random.default_rng(2).normal(1, 1, n).cumsum() / 10
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "i string, date int, v double")
    for lag in (0, 4, 60):
        monkeypatch.setattr(E, "auto_lag", lambda c, lag=lag: F.lit(lag))
        row = E.hac_mean(df, ["i"], "v").first()
        c = x - x.mean()
        want = (c @ c + 2 * sum((1 - k / (lag + 1)) * (c[k:] @ c[:-k]) for k in range(1, min(lag, n - 1) + 1))) / n / n
        assert row["hac_var"] == pytest.approx(want, rel=1e-9) and row["acf1"] == pytest.approx((c[1:] @ c[:-1]) / (c @ c), rel=1e-9)


def test_normal_distribution(spark):
    zs = [-40.0, -8.0, -7.0, -1.96, -0.1, 0.0, 0.3, 1.0, 3.0, 7.08, 9.0, 38.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", stats.norm_cdf("z").alias("p"), stats.two_sided("z").alias("t"))
    for z, p, t in df.collect():
        assert p == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), rel=1e-7, abs=1e-300) and t == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-7, abs=1e-300)


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    from types import SimpleNamespace

    from tidemark.session import ensure_checkpoint_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=lambda d: None)
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d)))
