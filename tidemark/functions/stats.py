"""Statistics that Spark lacks or defines otherwise."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import WindowSpec

EULER = 0.5772156649015329


def gated(agg, col: Column, w: WindowSpec, n: int) -> Column:
    """`agg` over the frame `w`, null unless the frame holds `n` values."""
    return F.when(F.count(col).over(w) == n, agg(col).over(w))


def rows_back(keys: list[str], order: str, n: int) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)


def skew_corrected(col: Column) -> Column:
    """Bias-corrected skewness; Spark's is the population's."""
    n = F.count(col).cast("double")
    return F.when(n > 2, F.skewness(col) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_corrected(col: Column) -> Column:
    n = F.count(col).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col) + 6))


def average_rank(col: str, keys: list[str]) -> Column:
    """Rank with ties sharing their mean rank."""
    w = Window.partitionBy(*keys).orderBy(col)
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, col)) - 1) / 2


def auto_lag(n: Column) -> Column:
    """Newey-West's automatic bandwidth."""
    return F.floor(4.0 * F.pow(n / 100.0, F.lit(2.0 / 9.0))).cast("int")


# Coefficients of Hart's rational approximation of the normal distribution (1968), good to about 1e-15.
_HART_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_HART_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def norm_tail(x: Column) -> Column:
    """Upper tail of the standard normal distribution for x >= 0, in the JVM."""

    def poly(cs: tuple[float, ...]) -> Column:
        acc = F.lit(cs[0])
        for c in cs[1:]:
            acc = acc * x + c
        return acc

    fraction = x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))
    e = F.exp(-x * x / 2)
    return F.when(x > 37, 0.0).when(x < 7.07106781186547, e * poly(_HART_TOP) / poly(_HART_BELOW)).otherwise(e / fraction / 2.506628274631)


def norm_cdf(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    tail = norm_tail(F.abs(x))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def two_sided(z: Column | str) -> Column:
    """Two-sided p-value of a standard normal statistic."""
    z = F.col(z) if isinstance(z, str) else z
    return 2 * norm_tail(F.abs(z))


def norm_tail_sql(x: str) -> str:
    """norm_tail as SQL of the expression `x` >= 0."""

    def poly(cs: tuple[float, ...]) -> str:
        acc = repr(cs[0])
        for c in cs[1:]:
            acc = f"({acc} * {x} + {c!r}::DOUBLE)"
        return acc

    return f"(CASE WHEN {x} > 37 THEN 0 WHEN {x} < 7.07106781186547 THEN exp(-{x} * {x} / 2) * {poly(_HART_TOP)} / {poly(_HART_BELOW)} ELSE exp(-{x} * {x} / 2) / ({x} + 1 / ({x} + 2 / ({x} + 3 / ({x} + 4 / ({x} + 0.65e0))))) / 2.506628274631e0 END)"


@F.pandas_udf(DoubleType())
def norm_ppf(p: pd.Series) -> pd.Series:
    return p.map(lambda v: NormalDist().inv_cdf(v) if 0 < v < 1 else None)


@F.pandas_udf(DoubleType())
def gamma_fn(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.gamma(v) if v == v and not (v <= 0 and v == int(v)) else None)


def fbm_constant(h: float) -> float:
    """Conditional-variance constant of fractional Brownian motion; 1 at one half, towards one half at zero."""
    return math.gamma(1.5 - h) / (math.gamma(h + 0.5) * math.gamma(2 - 2 * h))
