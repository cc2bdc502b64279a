"""Irregular readings onto a regular grid.

A source is identified by `keys`; its day is cut into sessions on the clock of `zone` (open included, close not) and each
session into cells of `step` seconds. Cells between the first and the last reading of a session come out, one row each.

Defined cases: rows with a null key other than the first ones, a null time or a null value are no readings (`require` names the
keys that must not be null); NaN is a reading as it stands; of several readings at one instant the one latest by `ties` counts as
last; repeated rows count once each in `n_readings` and change nothing else; an empty table gives an empty result; further
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import DAY_US, US, floor_div, local_micros, micros


def _readings(df: DataFrame, keys: list[str], ts: str, value: str, ties: list[str], require: list[str], zone: str, open_s: int, close_s: int) -> DataFrame:
    """Keys as k0.., epoch micros `t`, value `v`, tie columns, local session day `sess`."""
    keep = F.col(ts).isNotNull() & F.col(value).isNotNull()
    for k in require:
        keep &= F.col(k).isNotNull()
    local = local_micros(F.col(ts), zone)
    of_day = F.pmod(local, F.lit(DAY_US))
    return (
        df.where(keep & of_day.between(open_s * US, close_s * US - 1))
        .select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], micros(F.col(ts)).alias("t"), F.col(value).alias("v"), *[F.col(c).alias(f"tie{i}") for i, c in enumerate(ties)], local.alias("lt"))
        .withColumn("sess", floor_div(F.col("lt"), DAY_US).cast("int"))
    )


def _cell(step: int, t: str = "t", lt: str = "lt"):
    """Start of the cell in epoch seconds; cells are whole multiples of `step` on the local clock."""
    back = F.pmod(F.col(lt), F.lit(step * US))
    return floor_div(F.col(t) - back, US)


def regular_grid(
    df: DataFrame, keys: list[str], ts: str = "timestamp", value: str = "close", *, step: int = 300, zone: str = "America/New_York",
    open_s: int = 34_200, close_s: int = 57_600, ties: list[str] | None = None, require: list[str] | None = None, max_fill: int = 2,
) -> DataFrame:
    """Last reading per cell. Columns: the keys, `session` (date), `slot` (epoch seconds), `n_readings`, `last` (null where the cell
    has none), `filled` (last value carried over at most `max_fill` empty cells) and `status`: observed, filled or uncovered.

    One partial aggregate per cell before the first shuffle, so a hot source shrinks to its cells; gaps are found per source and
    session, never over a whole source.
    """
    ties, names = ties or [], [f"k{i}" for i in range(len(keys))]
    r = _readings(df, keys, ts, value, ties, require or [], zone, open_s, close_s).withColumn("slot", _cell(step))
    cells = r.groupBy(*names, "sess", "slot").agg(F.count(F.lit(1)).alias("n"), F.max_by("v", F.struct("t", *[f"tie{i}" for i in range(len(ties))], "v")).alias("last"))
    w = Window.partitionBy(*names, "sess").orderBy("slot")
    nxt = F.lead("slot").over(w)
    out = cells.withColumn("nxt", F.coalesce(nxt, F.col("slot") + step)).select("*", F.posexplode(F.sequence(F.col("slot"), F.col("nxt") - step, F.lit(step).cast("long"))).alias("gap", "cell"))
    observed = F.col("gap") == 0
    near = F.col("gap") <= max_fill
    return out.select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)],
        F.date_from_unix_date("sess").alias("session"),
        F.col("cell").alias("slot"),
        F.when(observed, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_readings"),
        F.when(observed, F.col("last")).alias("last"),
        F.when(near, F.col("last")).alias("filled"),
        F.when(observed, "observed").when(near, "filled").otherwise("uncovered").alias("status"),
    )


def empty_cells(grid: DataFrame) -> DataFrame:
    """The cells of a regular_grid or counter_grid that hold no reading."""
    return grid.where(F.col("n_readings") == 0)


def counter_grid(
    df: DataFrame, keys: list[str], ts: str = "timestamp", value: str = "close", *, step: int = 300, zone: str = "America/New_York",
    open_s: int = 34_200, close_s: int = 57_600, ties: list[str] | None = None, require: list[str] | None = None, max_gap: int = 900, carry: bool = True,
) -> DataFrame:
    """A cumulative counter onto the grid. Readings are put in order per source and session; a reading below its predecessor is a
    reset (its own value is then the increment); each increment is spread over the cells between the two readings in proportion to
    the overlap. Spans longer than `max_gap` seconds aren't spread: the seconds they cover count as uncovered, and their increment is
    the `unplaced` of the cell of the later reading, as is the step from one session to the next (unless `carry` is off). So the
    increase and the unplaced of a source add up to all its increments.

    Columns: the keys, `session`, `slot`, `n_readings`, `increase`, `unplaced`, `resets`, `covered_s`, `uncovered_s`; a row for every cell
    from that of the first to that of the last reading of a session. A NaN reading is one of its cell, but holds no counter; of several
    readings at one instant the last by `ties` counts. Spans stay within a source's session; only the ends of sessions, one row each, are
    put in order over a whole source.
    """
    ties, names = ties or [], [f"k{i}" for i in range(len(keys))]
    r = _readings(df, keys, ts, value, ties, require or [], zone, open_s, close_s)
    held = F.when(~F.isnan("v"), F.col("v"))
    one = r.groupBy(*names, "sess", "t", "lt").agg(F.count(F.lit(1)).alias("n"), F.max_by(held, F.when(held.isNotNull(), F.struct(*[f"tie{i}" for i in range(len(ties))], "v"))).alias("v"))
    w = Window.partitionBy(*names, "sess").orderBy("t")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    step_us = step * US

    def cell_of(t: str):
        return floor_div(F.col(t) + F.col("shift"), step_us)

    spans = (
        one.withColumn("shift", F.col("lt") - F.col("t")).withColumn("seen", F.lag("t").over(w))
        .withColumn("prev", F.last(F.when(F.col("v").isNotNull(), F.struct("t", "v")), ignorenulls=True).over(before))
        .withColumn("t0", F.when(F.col("v").isNotNull(), F.col("prev.t")))
        .withColumn("reset", F.coalesce(F.col("v") < F.col("prev.v"), F.lit(False)))
        .withColumn("inc", F.when(F.col("reset"), F.col("v")).otherwise(F.col("v") - F.col("prev.v")))
        .withColumn("long_gap", (F.col("t") - F.col("t0")) > max_gap * US)
        .withColumn("from", F.coalesce("t0", "seen", "t")).withColumn("own", cell_of("t"))
    )
    parts = spans.select("*", F.explode(F.sequence(cell_of("from"), F.col("own"))).alias("c"))
    over = F.greatest(F.least((F.col("c") + 1) * step_us - F.col("shift"), F.col("t")) - F.greatest(F.col("c") * step_us - F.col("shift"), F.col("t0")), F.lit(0))
    parts = parts.withColumn("over", F.when(F.col("t0").isNotNull(), over).otherwise(F.lit(0))).withColumn("slot", floor_div(F.col("c") * step_us - F.col("shift"), US))
    share = F.col("inc") * (F.col("over") / (F.col("t") - F.col("t0")))
    here = F.col("c") == F.col("own")
    cells = parts.groupBy(*names, "sess", "slot").agg(
        F.sum(F.when(here, F.col("n")).otherwise(F.lit(0))).alias("n_readings"),
        F.sum(F.when(~F.col("long_gap"), share).otherwise(F.lit(0.0))).alias("increase"),
        F.sum(F.when(F.col("long_gap") & here, F.col("inc")).otherwise(F.lit(0.0))).alias("unplaced"),
        F.sum((F.col("reset") & here).cast("long")).alias("resets"),
        (F.sum(F.when(~F.col("long_gap"), F.col("over")).otherwise(F.lit(0))) / US).alias("covered_s"),
        (F.sum(F.when(F.col("long_gap"), F.col("over")).otherwise(F.lit(0))) / US).alias("uncovered_s"),
    )
    if carry:
        ends = r.where(~F.isnan("v")).groupBy(*names, "sess").agg(*[f(F.struct("t", *[f"tie{i}" for i in range(len(ties))], F.col("v"), _cell(step).alias("slot"))).alias(n) for n, f in (("a", _first_by_time(ties)), ("z", F.max))])
        days = Window.partitionBy(*names).orderBy("sess")
        ends = ends.withColumn("v0", F.lag("z.v").over(days)).where(F.col("v0").isNotNull())
        steps = ends.select(*names, "sess", F.col("a.slot").alias("slot"), F.when(F.col("a.v") < F.col("v0"), F.col("a.v")).otherwise(F.col("a.v") - F.col("v0")).alias("night"), (F.col("a.v") < F.col("v0")).cast("long").alias("fell"))
        on = [F.col(f"l.{n}").eqNullSafe(F.col(f"s.{n}")) for n in [*names, "sess", "slot"]]
        joined = cells.alias("l").join(steps.alias("s"), on, "left")
        cells = joined.select("l.*", "s.night", "s.fell").withColumn("unplaced", F.col("unplaced") + F.coalesce("night", F.lit(0.0))).withColumn("resets", F.col("resets") + F.coalesce("fell", F.lit(0)))
    return cells.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.date_from_unix_date("sess").alias("session"), "slot", "n_readings", "increase", "unplaced", "resets", "covered_s", "uncovered_s")


def _first_by_time(ties: list[str]):
    """The earliest instant's last delivery: least time, then largest ties."""
    order = F.struct((-F.col("t")).alias("neg"), *[f"tie{i}" for i in range(len(ties))], "v")
    return lambda row: F.max_by(row, order)
