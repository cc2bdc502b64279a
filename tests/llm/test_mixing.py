import math

import pytest

from tidemark.llm import mixing


def sized(spark, rows):
    return spark.createDataFrame(rows, "key long, source string, n_tokens long")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def rows_of(n):
    out = [(i, "big", 50 + i % 37) for i in range(n)] + [(10_000 + i, "small", 20 + i % 11) for i in range(40)] + [(20_000 + i, "unlisted", 9) for i in range(30)]
    return out + [(30_000, None, 5), (30_001, "big", 0), (30_002, "none_left", 0)]


@pytest.mark.parametrize("block_rows", [1, 100, 16_384])
def test_shares_caps_and_brute_force(spark, block_rows):
    t = targets(spark, [("big", 0.7, 2), ("small", 0.2, 3), ("none_left", 0.1, 4), ("zero", 0.0, 1), (None, 0.5, 1), ("big", None, 2)])
    s = sized(spark, rows_of(2000))
    planned = mixing.plan(s, t)
    p = {r["source"]: r for r in planned.collect()}
    assert p["big"]["reachable_share"] == pytest.approx(0.7 / 0.9) and p["none_left"]["copies"] == 0
    assert max(p["big"]["copies"] / 2, p["small"]["copies"] / 3) == pytest.approx(1.0)  # the largest mix within the caps
    drawn = mixing.draw(s, planned, block_rows=block_rows)
    got = {r["key"]: r["repeats"] for r in drawn.collect()}
    assert not set(got) & {30_000, 30_001, 30_002} and not any(20_000 <= k < 30_000 for k in got)
    for source, lo, hi, n in (("big", 0, 2000, 2000), ("small", 10_000, 10_040, 40)):
        reps = [got.get(k, 0) for k in range(lo, hi)]
        c = p[source]["copies"]
        assert set(reps) <= {math.floor(c), math.ceil(c)} and max(reps) <= p[source]["max_repeats"] and abs(sum(reps) - c * n) <= 1
    r = {x["source"]: x for x in mixing.report(drawn, planned).collect()}
    assert r["big"]["actual_share"] == pytest.approx(0.7 / 0.9, abs=0.01) and r["none_left"]["actual_share"] == 0


def test_sizes_are_drawn_in_proportion(spark):
    """A source whose documents differ a thousandfold: the tokens drawn are close to their expectation."""
    rows = [(i, "big", 1 + (i * i * 7919) % 997 * (1 + i % 3)) for i in range(3000)] + [(10_000 + i, "small", 100) for i in range(300)]
    t = targets(spark, [("big", 0.5, 1), ("small", 0.5, 2)])
    s = sized(spark, rows)
    r = {x["source"]: x for x in mixing.report(mixing.draw(s, mixing.plan(s, t)), mixing.plan(s, t)).collect()}
    assert r["big"]["actual_share"] == pytest.approx(0.5, abs=0.006)


def test_same_draw_however_spread(spark):
    t = targets(spark, [("big", 0.7, 2), ("small", 0.3, 3)])
    s = sized(spark, rows_of(500))
    a = {tuple(r) for r in mixing.draw(s, mixing.plan(s, t)).collect()}
    b = {tuple(r) for r in mixing.draw(s.repartition(7), mixing.plan(s, t)).collect()}
    assert a == b


def test_empty(spark):
    s, t = sized(spark, []), targets(spark, [("big", 1.0, 2)])
    assert mixing.draw(s, mixing.plan(s, t)).count() == 0 and mixing.report(mixing.draw(s, mixing.plan(s, t)), mixing.plan(s, t)).count() == 1
    s = sized(spark, rows_of(10))
    assert mixing.draw(s, mixing.plan(s, targets(spark, []))).count() == 0


def test_sizes_of_texts(spark):
    df = spark.createDataFrame([(1, "a", "hello world"), (2, "a", None), (3, None, "")], "doc_id long, source string, text string")
    assert {(r["key"], r["n_tokens"]) for r in mixing.sizes(df).collect()} == {(1, 2), (2, 0), (3, 0)}
