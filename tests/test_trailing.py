import datetime as dt
import operator
import random

import numpy as np
import pytest

from tidemark.operators.trailing import TwoStackQueue, slide, trailing_totals

SCHEMA = "source string, date date, rv_daily double, yz_21 double, loaded_at timestamp, day string, span string"


@pytest.mark.parametrize("op, identity", [(operator.add, 0), (max, -1), (lambda a, b: a + b, "")])
def test_queue_is_the_window_fold(op, identity):
    rng, q, xs = random.Random(3), TwoStackQueue(op, identity), []
    for _ in range(300):
        x = str(rng.randint(0, 9)) if identity == "" else rng.randint(0, 99)
        q.push(x)
        xs.append(x)
        while len(xs) > rng.randint(1, 8):
            q.pop()
            xs.pop(0)
        want = identity
        for y in xs:
            want = op(want, y)
        assert q.fold() == want


@pytest.mark.parametrize("n, span", [(1, 7), (6, 7), (7, 7), (8, 7), (100, 30), (61, 1)])
def test_slide_is_the_queue(n, span):
    x = np.random.default_rng(0).integers(0, 50, (n, 2)).astype(float)
    for ufunc, ident in ((np.add, 0.0), (np.minimum, np.inf)):
        got = slide(x, span, ufunc, ident)
        for i in range(n):
            assert np.allclose(got[i], ufunc.reduce(x[max(0, i - span + 1) : i + 1], axis=0))


def test_against_brute_force(spark):
    rng, rows = random.Random(5), []
    base = dt.date(2003, 12, 20)
    stamp = dt.datetime(2010, 1, 1)
    for s in ("a", "b", None):
        for d in range(0, 2600 if s == "a" else 40):
            if rng.random() < (0.02 if s == "a" and 300 < d < 1800 else 0.6):
                v = rng.choice([None, float("nan"), rng.random()])
                rows.append((s, base + dt.timedelta(d), v, rng.random(), stamp, "x", "y"))
                if rng.random() < 0.2:
                    rows.append((s, base + dt.timedelta(d), rng.choice([None, rng.random()]), None, stamp + dt.timedelta(rng.randint(-1, 1) or 1), "x", "y"))
                if rng.random() < 0.2:
                    rows.append(rows[-1])
    rows += [("a", None, 1.0, 1.0, stamp, "x", "y"), ("one", base, None, 2.0, None, "x", "y")]
    got = {(r["source"], r["day"], r["span"]): r for r in trailing_totals(spark.createDataFrame(rows, SCHEMA), chunk_days=64).collect()}
    best = {}
    for s, d, rv, yz, t, *_ in rows:
        if d is None:
            continue
        clean = tuple(None if v is None or v != v else v for v in (rv, yz))
        k = (t or dt.datetime(1, 1, 1), *[(-1.0 if v is None else v) for v in clean])
        if (s, d) not in best or k > best[s, d][0]:
            best[s, d] = (k, clean)
    want = 0
    for s in {k[0] for k in best}:
        days = [d for x, d in best if x == s]
        d = min(days)
        while d <= max(days):
            for span in (7, 30):
                want += 1
                vals = [best[s, d - dt.timedelta(i)][1] for i in range(span) if (s, d - dt.timedelta(i)) in best]
                r = got[s, d.isoformat(), span]
                for i, c in enumerate(("rv_daily", "yz_21")):
                    v = [x[i] for x in vals if x[i] is not None]
                    assert r[f"{c}_days"] == len(v) and r[f"{c}_total"] == pytest.approx(sum(v))
                    if v:
                        assert (r[f"{c}_avg"], r[f"{c}_min"], r[f"{c}_max"]) == pytest.approx((sum(v) / len(v), min(v), max(v)))
                    else:
                        assert r[f"{c}_avg"] is None and r[f"{c}_min"] is None
            d += dt.timedelta(1)
    assert want == len(got)


def test_empty(spark):
    assert trailing_totals(spark.createDataFrame([], SCHEMA)).count() == 0
