"""Forward windows. EVALUATION ONLY: models, forecasts and portfolios may not import this module (a test enforces it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVALUATION_ONLY = True


def forward_mean(m: DataFrame, col: str, h: int, name: str) -> DataFrame:
    """Mean over the h rows after the current one; null where they aren't all there."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(1, h)
    return m.withColumn(name, F.when(F.count(col).over(w) == h, F.avg(col).over(w)))


def forward_value(m: DataFrame, col: str, h: int, name: str) -> DataFrame:
    return m.withColumn(name, F.lead(col, h).over(Window.partitionBy("symbol").orderBy("date")))
