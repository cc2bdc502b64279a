"""Rolling totals over trailing calendar periods, days without activity included.

The window of each entity is kept by a two-stack queue over a monoid: new days are folded into the back stack, leaving days come
off the front stack, and when the front is empty the back is turned over into suffix folds. No inverse is needed, so minima and
maxima work as sums do. A dense day axis turns the queue over every `span` pushes, hence each turn is one accumulate over a block.

Defined cases: of several rows of one entity and day the one with the latest load time counts (then the larger values, so the
result doesn't depend on order); null and NaN are no values; rows without a day are left out; a null entity is an entity of its
own; a day without values has total 0, average null and day count 0; an empty table gives an empty result; further columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.times import floor_div


class TwoStackQueue:
    """Fold of a sliding window over any monoid: push, pop and fold in amortised constant time."""

    def __init__(self, op: Callable[[Any, Any], Any], identity: Any):
        self.op, self.identity = op, identity
        self.front: list[Any] = []  # suffix folds, the oldest on top
        self.back: list[Any] = []
        self.back_fold = identity

    def push(self, x: Any) -> None:
        self.back.append(x)
        self.back_fold = self.op(self.back_fold, x)

    def pop(self) -> None:
        if not self.front:
            acc = self.identity
            while self.back:
                acc = self.op(self.back.pop(), acc)
                self.front.append(acc)
            self.back_fold = self.identity
        self.front.pop()

    def fold(self) -> Any:
        return self.op(self.front[-1], self.back_fold) if self.front else self.back_fold


def slide(values: np.ndarray, span: int, op: np.ufunc, identity: float) -> np.ndarray:
    """The queue's folds on a dense axis: out[i] folds values[max(0, i - span + 1) .. i] along axis 0."""
    n = len(values)
    if n == 0:
        return values.copy()
    pad = np.full((span - 1, *values.shape[1:]), identity)
    tail = np.full((-(n + span - 1) % span, *values.shape[1:]), identity)
    x = np.concatenate([pad, values, tail])
    blocks = x.reshape(-1, span, *values.shape[1:])
    back = op.accumulate(blocks, axis=1).reshape(x.shape)
    front = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(x.shape)
    lo = np.arange(n)
    hi = lo + span - 1
    whole = (lo % span == 0).reshape(-1, *[1] * (values.ndim - 1))
    return np.where(whole, back[hi], op(front[lo], back[hi]))


def _windows(values: list[str], spans: list[int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Over partitions sorted by entity, chunk and day: each group is a marker row (the days to report) and its rows."""
    reach = max(spans) - 1

    def one(g: pd.DataFrame) -> pd.DataFrame:
        m = g[g["kind"] == 0].iloc[0]
        lo, hi = int(m["lo"]), int(m["hi"])
        base, same = lo - reach, g["entity"].isna() if pd.isna(m["entity"]) else g["entity"] == m["entity"]
        rows = g[(g["kind"] == 1) & same & (g["chunk"] == m["chunk"])]  # carried rows after an entity's last day have no marker
        x = np.full((hi - base + 1, len(values)), np.nan)
        day = rows["day"].to_numpy()
        inside = (day >= base) & (day <= hi)
        x[day[inside] - base] = rows.loc[inside, [f"v{i}" for i in range(len(values))]].to_numpy(dtype=float)
        has = ~np.isnan(x)
        zero = np.where(has, x, 0.0)
        out = []
        for s in spans:
            n, tot = slide(has.astype(float), s, np.add, 0.0)[reach:], slide(zero, s, np.add, 0.0)[reach:]
            low = slide(np.where(has, x, np.inf), s, np.minimum, np.inf)[reach:]
            high = slide(np.where(has, x, -np.inf), s, np.maximum, -np.inf)[reach:]
            cols: dict[str, Any] = {"entity": [m["entity"]] * (hi - lo + 1), "day": np.arange(lo, hi + 1, dtype=np.int32), "span": np.int32(s)}
            for i, v in enumerate(values):
                some = n[:, i] > 0
                cols |= {f"{v}_days": n[:, i].astype(np.int32), f"{v}_total": np.where(some, tot[:, i], 0.0)}
                for what, a in (("avg", tot[:, i] / np.maximum(n[:, i], 1)), ("min", low[:, i]), ("max", high[:, i])):
                    cols[f"{v}_{what}"] = pd.array(np.where(some, a, 0.0), dtype="Float64")
                    cols[f"{v}_{what}"][~some] = pd.NA
            out.append(pd.DataFrame(cols))
        return pd.concat(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for b in batches:
            if rest is not None:
                b = pd.concat([rest, b], ignore_index=True)
            starts = np.flatnonzero(b["kind"].to_numpy() == 0)  # the marker comes first in its group
            done = [one(b.iloc[i:j]) for i, j in zip(starts[:-1], starts[1:])]
            rest = b.iloc[starts[-1] :] if len(starts) else None
            if done:
                yield pd.concat(done, ignore_index=True)
        if rest is not None and len(rest):
            yield one(rest)

    return run


def latest_rows(df: DataFrame, entity: str, day: str, values: list[str], loaded: str | None) -> DataFrame:
    """One row per entity and day: `entity`, `day` (days since 1970), v0.. with NaN made null."""
    clean = [F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double")).alias(f"v{i}") for i, v in enumerate(values)]
    rows = df.where(F.col(day).isNotNull()).select(F.col(entity).alias("entity"), F.unix_date(F.col(day).cast("date")).alias("day"), (F.col(loaded) if loaded else F.lit(None).cast("timestamp")).alias("loaded"), *clean)
    vs = [f"v{i}" for i in range(len(values))]
    best = rows.groupBy("entity", "day").agg(F.max(F.struct("loaded", *vs)).alias("b"))
    return best.select("entity", "day", *[F.col(f"b.{v}").alias(v) for v in vs])


def trailing_totals(df: DataFrame, entity: str = "source", day: str = "date", values: list[str] | None = None, *, loaded: str | None = "loaded_at", spans: list[int] | None = None, chunk_days: int = 1024) -> DataFrame:
    """For every entity, calendar day from its first to its last row, and span: day count, total, average, minimum and maximum of
    each value. An entity's history is cut into chunks of `chunk_days`, each with the days before it that its windows reach, so
    a hot entity spreads over tasks and no group exceeds `chunk_days` plus the longest span.

    Columns: the entity, `day` (YYYY-MM-DD), `span`, and per value `_days`, `_total`, `_avg`, `_min`, `_max`.
    """
    values, spans = values or ["rv_daily", "yz_21"], spans or [7, 30]
    reach = max(spans) - 1
    if chunk_days <= reach:
        raise ValueError("chunk_days must exceed the longest span")
    rows = latest_rows(df, entity, day, values, loaded)
    vs = [f"v{i}" for i in range(len(values))]
    own = floor_div(F.col("day"), chunk_days)
    late = floor_div(F.col("day") + reach, chunk_days)
    data = rows.select("entity", F.explode(F.sequence(own, late)).alias("chunk"), F.lit(1).alias("kind"), "day", F.lit(0).alias("lo"), F.lit(0).alias("hi"), *vs)
    ends = rows.groupBy("entity").agg(F.min("day").alias("a"), F.max("day").alias("z"))
    marks = ends.select("entity", "a", "z", F.explode(F.sequence(floor_div(F.col("a"), chunk_days), floor_div(F.col("z"), chunk_days))).alias("chunk")).select(
        "entity", "chunk", F.lit(0).alias("kind"), F.lit(-(2**31)).cast("int").alias("day"), F.greatest("a", F.col("chunk") * chunk_days).cast("int").alias("lo"), F.least("z", (F.col("chunk") + 1) * chunk_days - 1).cast("int").alias("hi"), *[F.lit(None).cast("double").alias(v) for v in vs]
    )
    both = data.unionByName(marks).repartition("entity", "chunk").sortWithinPartitions("entity", "chunk", "kind", "day")
    kind = rows.schema["entity"].dataType
    fields = [T.StructField("entity", kind), T.StructField("day", T.IntegerType()), T.StructField("span", T.IntegerType())]
    for v in values:
        fields.append(T.StructField(f"{v}_days", T.IntegerType()))
        fields += [T.StructField(f"{v}_{x}", T.DoubleType()) for x in ("total", "avg", "min", "max")]
    out = both.mapInPandas(_windows(values, spans), T.StructType(fields))
    return out.withColumn("day", F.date_from_unix_date("day").cast("string")).withColumnRenamed("entity", entity)
