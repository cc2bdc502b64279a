import datetime as dt
import random

import pytest

from tidemark.operators.asof import known_at_event

V = "param_id long, date date, source string, model string, known_at timestamp, alpha double, origin_id string"
E_ = "origin_id long, date date, source string, model string, asked_at timestamp, alpha int"
DAY, T0 = dt.date(2010, 1, 1), dt.datetime(2010, 1, 1)


def run(spark, versions, events, rows):
    return {r["origin_id"]: r["param_id"] for r in known_at_event(
        spark.createDataFrame(events, E_), spark.createDataFrame(versions, V), entity=["source", "model"], event_id="origin_id", event_valid="date", event_asked="asked_at",
        version_id="param_id", version_valid="date", version_known="known_at", required=["alpha"], rows=rows,
    ).collect()}


def brute(versions, events):
    out = {}
    for oid, d, s, m, asked, _ in events:
        ok = [(v[1], v[4], -v[0]) for v in versions if None not in (d, s, m, asked, v[1], v[2], v[3], v[4], v[5]) and v[5] == v[5] and (v[2], v[3]) == (s, m) and v[1] <= d and v[4] <= asked]
        out[oid] = -max(ok)[2] if ok else None
    return out


@pytest.mark.parametrize("rows", [20, 200_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, rows, seed):
    rng = random.Random(seed)
    versions, events = [], []
    for i in range(500):
        d = rng.randint(0, 80)
        known = None if rng.random() < 0.03 else T0 + dt.timedelta(days=d + rng.choice([0, 0, 0, 1, 5, 40, -3]), hours=rng.choice([0, 12]))
        s = rng.choice(["hot"] * 4 + ["a", "b", None])
        versions.append((i, DAY + dt.timedelta(d), s, "m", known, rng.choice([None, float("nan")] + [1.0] * 8), "clash"))
        if rng.random() < 0.1:
            versions.append((10_000 - i, *versions[-1][1:]))
    for i in range(400):
        d = rng.randint(-5, 90)
        asked = None if rng.random() < 0.02 else T0 + dt.timedelta(days=d + rng.choice([0, 0, 1, 30, 200, -2]), hours=rng.choice([0, 12]))
        events.append((i, DAY + dt.timedelta(d), rng.choice(["hot", "hot", "a", "b", "none", None]), "m", asked, 1))
    assert run(spark, versions, events, rows) == brute(versions, events)


@pytest.mark.parametrize("layout", [500_000, 0])
def test_hot_entity_and_hot_date(spark, monkeypatch, layout):
    """All rows belong to one entity and half its versions to one date; some events repeat, some have one id and other moments."""
    import tidemark.operators.asof as asof

    monkeypatch.setattr(asof, "LAYOUT", layout)
    rng = random.Random(5)
    versions = [(i, DAY + dt.timedelta(30 if i % 2 else rng.randint(0, 60)), "hot", "m", T0 + dt.timedelta(hours=rng.randint(0, 2000)), 1.0, "x") for i in range(1500)]
    events = [(i, DAY + dt.timedelta(rng.randint(-2, 70)), "hot", "m", T0 + dt.timedelta(hours=rng.randint(-5, 2100)), 1) for i in range(900)]
    events += [(900 + i, DAY, None, "m", T0, 1) for i in range(50)]
    assert run(spark, versions, events, 100) == brute(versions, events)
    twice = [(1, DAY + dt.timedelta(40), "hot", "m", T0 + dt.timedelta(hours=1500), 1)] * 3 + [(1, DAY - dt.timedelta(9), "hot", "m", T0, 1)]
    got = sorted((r["param_id"] for r in known_at_event(
        spark.createDataFrame(twice, E_), spark.createDataFrame(versions, V), entity=["source", "model"], event_id="origin_id", event_valid="date", event_asked="asked_at",
        version_id="param_id", version_valid="date", version_known="known_at", required=["alpha"], rows=100,
    ).collect()), key=str)
    want = brute(versions, twice[:1])[1]
    assert got == sorted([want, want, want, None], key=str)


def test_empty(spark):
    e = [(1, DAY, "a", "m", T0, 1)]
    assert run(spark, [], e, 100) == {1: None}
    assert run(spark, [(1, DAY, "a", "m", T0, 1.0, "x")], [], 100) == {}
    assert run(spark, [(1, DAY, "a", "m", T0, 1.0, "x")], e + e, 100) == {1: 1}
