import datetime as dt
import random

from tidemark.operators.spikes import flagged_bars

SCHEMA = "bar_id long, feed string, ticker string, timestamp timestamp, open double, high double, low double, close double, volume double, ingested_at timestamp, k0 string, price_spike int"
T0 = dt.datetime(2008, 3, 6, 14, 30)


def series(n=900, seed=1, feed="f", first=0):
    rng, p, rows = random.Random(seed), 50.0, []
    for i in range(n):
        o = p
        p *= 1 + rng.gauss(0, 4e-4)
        hi, lo = max(o, p) * (1 + abs(rng.gauss(0, 2e-4))), min(o, p) * (1 - abs(rng.gauss(0, 2e-4)))
        t = T0 + dt.timedelta(minutes=i)
        rows.append([first + i, feed, "A", t, o, hi, lo, p, float(round(1000 * rng.lognormvariate(0, 0.7))), t + dt.timedelta(seconds=62), "x", 1])
    return rows


def flags(spark, rows, **k):
    return {r["bar"] for r in flagged_bars(spark.createDataFrame([tuple(r) for r in rows], SCHEMA), **k).collect()}


def test_planted_cases(spark):
    rows = series()
    assert flags(spark, rows) == set()
    want = set()
    for i, n, f in ((100, 1, 1.08), (200, 3, 0.93), (300, 2, 10.0)):  # spikes of one to three bars
        for j in range(i, i + n):
            rows[j][4:8] = [x * f for x in rows[j][4:8]]
            want.add(j)
    for j in range(400, 900):  # a move that lasts
        rows[j][4:8] = [x * 1.06 for x in rows[j][4:8]]
    rows[450][7], rows[451][6], rows[452][8], rows[453][7] = -rows[450][7], rows[451][5] + 1, -5.0, float("nan")
    want |= {450, 451, 452, 453}
    for j in range(521, 545):  # frozen prices
        rows[j][4:8] = rows[520][4:8]
        want.add(j)
    for j in range(601, 630):  # frozen volume
        rows[j][8] = rows[600][8]
        want.add(j)
    rows[700][8] = 4294967295.0
    want.add(700)
    for k, j in enumerate(range(750, 760)):  # a surge that fades
        rows[j][8] *= 30 * 0.75**k
    rows[800][7], rows[801][8], rows[802][8] = None, None, 0.0
    rows.append([5000, *rows[100][1:9], rows[100][9] + dt.timedelta(hours=3), "x", 1])  # the spike delivered again
    want.add(5000)
    rows += [[5001, "f", None, T0, 1.0, 2.0, 0.5, 1.0, 1.0, T0, "x", 1], [5002, "f", "A", None, 1.0, 0.5, 2.0, 1.0, 1.0, T0, "x", 1], [5003, None, "A", T0, 1.0, 2.0, 0.5, -1.0, 1.0, T0, "x", 1]]
    want |= {5002, 5003}
    assert flags(spark, rows) == want
    assert flags(spark, rows, chunk=128, halo=64) == want  # cuts don't matter


def test_small_and_empty(spark):
    assert flags(spark, []) == set()
    assert flags(spark, series(4)) == set()
    assert flags(spark, [*series(300), *series(300, 1, "g", 1000)]) == set()
