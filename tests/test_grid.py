import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemark.operators.grid import counter_grid, empty_cells, regular_grid

SCHEMA = "feed string, ticker string, timestamp timestamp, close double, ingested_at timestamp, bar_id long, slot string, session int"
NY = ZoneInfo("America/New_York")


def at(day, h, m, s=0):
    return dt.datetime(2008, 3, day, h, m, s, tzinfo=NY).astimezone(dt.timezone.utc)


def row(i, ticker, ts, close, ing=0):
    return ("f", ticker, ts, close, at(20, 1, 0, ing), i, "clash", 7)


def grid(df, **k):
    return regular_grid(df, ["feed", "ticker"], require=["ticker"], ties=["ingested_at", "bar_id"], **k)


def test_gaps_ties_nulls_and_clock_change(spark):
    rows = [
        row(1, "A", at(7, 9, 30), 1.0), row(2, "A", at(7, 9, 34, 59), 2.0), row(3, "A", at(7, 9, 34, 59), 3.0, 1), row(4, "A", at(7, 10, 0), float("nan")),
        row(5, "A", at(7, 9, 29, 59), 9.0), row(6, "A", at(7, 16, 0), 9.0), row(7, None, at(7, 9, 40), 1.0), row(8, "A", None, 1.0), row(9, "A", at(7, 9, 45), None),
        row(10, "A", at(10, 9, 30), 5.0), row(11, "A", at(10, 9, 30), 5.0), row(12, "A", at(10, 15, 59), 6.0),
    ]
    g = grid(spark.createDataFrame(rows, SCHEMA), max_fill=2)
    got = {(r["session"].day, r["slot"]): r for r in g.collect()}
    first = int(at(7, 9, 30).timestamp())
    assert len([k for k in got if k[0] == 7]) == 7 and len([k for k in got if k[0] == 10]) == 78
    assert got[7, first]["last"] == 3.0 and got[7, first]["n_readings"] == 3
    assert [got[7, first + 300 * i]["status"] for i in range(7)] == ["observed", "filled", "filled", "uncovered", "uncovered", "uncovered", "observed"]
    assert got[10, int(at(10, 9, 30).timestamp())]["n_readings"] == 2
    assert empty_cells(g).count() == 5 + 76


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert grid(df).count() == 0
    assert counter_grid(df, ["feed", "ticker"], ties=["bar_id"], require=["ticker"]).count() == 0


def test_counter_against_brute_force(spark):
    rng = random.Random(1)
    rows, v, t = [], 0.0, at(7, 9, 31)
    for i in range(60):
        rows.append(row(i, "A", t, v))
        t += dt.timedelta(seconds=rng.choice([20, 60, 200, 650, 1200]))
        v = v + rng.randint(0, 9) if rng.random() > 0.1 else float(rng.randint(0, 3))
    rows.append(rows[5])
    got = {r["slot"]: r for r in counter_grid(spark.createDataFrame(rows, SCHEMA), ["feed", "ticker"], require=["ticker"], ties=["ingested_at", "bar_id"]).collect()}
    inc, cov, unc, resets, left, counts = {}, {}, {}, {}, {}, {}
    for r in rows:
        if r[2] < at(7, 16, 0):
            counts[r[2].timestamp() // 300 * 300] = counts.get(r[2].timestamp() // 300 * 300, 0) + 1
    seen = sorted({(r[2], r[3]) for r in rows if r[2] < at(7, 16, 0)})
    total = 0.0
    for (t0, v0), (t1, v1) in zip(seen, seen[1:]):
        a, b = t0.timestamp(), t1.timestamp()
        d = v1 - v0 if v1 >= v0 else v1
        total += d
        c = a // 300 * 300
        while c < b:
            over = min(c + 300, b) - max(c, a)
            if b - a > 900:
                unc[c] = unc.get(c, 0) + over
            else:
                inc[c] = inc.get(c, 0) + d * over / (b - a)
                cov[c] = cov.get(c, 0) + over
            c += 300
        if b - a > 900:
            left[b // 300 * 300] = left.get(b // 300 * 300, 0) + d
        if v1 < v0:
            resets[b // 300 * 300] = resets.get(b // 300 * 300, 0) + 1
    assert set(got) == set(range(int(min(counts)), int(max(counts)) + 1, 300))
    for c, r in got.items():
        assert r["increase"] == pytest.approx(inc.get(c, 0.0)) and r["covered_s"] == pytest.approx(cov.get(c, 0)) and r["uncovered_s"] == pytest.approx(unc.get(c, 0))
        assert (r["resets"], r["n_readings"]) == (resets.get(c, 0), counts.get(c, 0)) and r["unplaced"] == pytest.approx(left.get(c, 0.0))
    assert sum(r["increase"] + r["unplaced"] for r in got.values()) == pytest.approx(total)


def counter(spark, rows, **k):
    return counter_grid(spark.createDataFrame(rows, SCHEMA), ["feed", "ticker"], require=["ticker"], ties=["ingested_at", "bar_id"], **k)


def test_no_increment_is_lost(spark):
    """Over a long gap, over the night, over a NaN reading; the cells are those of the regular grid."""
    rows = [row(1, "A", at(7, 9, 30), 10.0), row(2, "A", at(7, 9, 50), 50.0), row(3, "A", at(7, 9, 51), 51.0), row(4, "A", at(10, 9, 40), 60.0), row(5, "A", at(10, 9, 44), float("nan")), row(6, "A", at(10, 9, 48), 64.0), row(7, "A", at(11, 10, 0), 4.0)]
    got = counter(spark, rows).collect()
    by = {r["slot"]: r for r in got}
    assert sum(r["increase"] + r["unplaced"] for r in got) == pytest.approx(41 + 9 + 4 + 4) and sum(r["resets"] for r in got) == 1
    assert by[int(at(7, 9, 50).timestamp())]["unplaced"] == 40 and by[int(at(10, 9, 40).timestamp())]["unplaced"] == 9 and by[int(at(10, 9, 40).timestamp())]["n_readings"] == 2
    assert by[int(at(10, 9, 40).timestamp())]["increase"] == pytest.approx(2.5) and by[int(at(10, 9, 45).timestamp())]["increase"] == pytest.approx(1.5)
    same = [(r["slot"], r["n_readings"]) for r in grid(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(same) == sorted((r["slot"], r["n_readings"]) for r in got) == sorted((r["slot"], r["n_readings"]) for r in counter(spark, rows, carry=False).collect())


def test_hot_series_stays_spread(spark):
    df = spark.range(20000).select(F.lit("f").alias("feed"), F.lit("A").alias("ticker"), F.timestamp_micros(F.lit(1204900000000000) + F.col("id") * 30_000_000).alias("timestamp"), F.rand(1).alias("close"), F.current_timestamp().alias("ingested_at"), F.col("id").alias("bar_id"))
    g = grid(df)
    assert g.where("n_readings = 0").count() == 0 and g.agg(F.sum("n_readings")).first()[0] == df.where(F.expr("date_format(from_utc_timestamp(timestamp, 'America/New_York'), 'HHmm') >= '0930' AND date_format(from_utc_timestamp(timestamp, 'America/New_York'), 'HHmm') < '1600'")).count()
