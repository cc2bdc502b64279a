import datetime as dt

import pytest

from tidemark.operators import intraday
from tidemark.sources import fetch, files
from tidemark.streaming import bars as streaming


def test_csv_sidecar_cache_and_markdown(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), 1.5), (dt.date(2020, 1, 3), None)], "date date, value double")
    files.write_csv(df.withColumnRenamed("value", " Rate Pct "), str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c")).columns == ["date", "rate_pct"]
    meta = files.write_with_sidecar(df, str(tmp_path / "p"), {"source": "test"})
    assert (meta["rows"], meta["first"], meta["last"], meta["source"]) == (2, "2020-01-01", "2020-01-03", "test")
    made = []
    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "k"), lambda: made.append(1) or df).count() == 2
    assert len(made) == 1
    assert files.markdown(df.orderBy("date")).splitlines()[-1] == "| 2020-01-03 |  |"
    with pytest.raises(ValueError):
        files.markdown(df, most=1)


def test_inventory_and_footers(spark, tmp_path):
    spark.range(0, 1000, 1, 2).selectExpr("id", "cast(id div 500 as string) AS ticker").write.parquet(str(tmp_path / "t"))
    assert files.inventory(spark, str(tmp_path / "t")).count() == 2
    g = files.footers(spark, str(tmp_path / "t"), "ticker")
    assert g.agg({"rows": "sum"}).first()[0] == 1000
    p = files.prunable(g, "0").first()
    assert 0.4 < p["prunable"] < 0.6 and p["worth_it"] and p["sorted"]


def test_local_series(spark, tmp_path):
    (tmp_path / "dff.csv").write_text("date,value\n2020-01-01,1.5\n2020-01-02,\n")
    (tmp_path / "x.csv").write_text("date,value\n2020-01-01,3\n")
    spark.dataSource.register(files.LocalSeries)
    df = spark.read.format("local_series").option("folder", str(tmp_path)).option("symbols", "dff").load()
    assert [tuple(r) for r in df.orderBy("date").collect()] == [("dff", "2020-01-01", 1.5), ("dff", "2020-01-02", None)]


def test_synthetic_minutes_pass_their_checks(spark):
    d = intraday.prepared(files.synthetic_minutes(spark, 130))
    s = intraday.sessions(d)
    assert s.where("half_day").count() >= 1 and s.where("missing > 20").count() == 0
    daily = intraday.daily_from_minutes(d).withColumnRenamed("ticker", "symbol").withColumnRenamed("day", "date")
    splits = intraday.split_candidates(daily).collect()
    assert len(splits) == 1 and splits[0]["verdict"] == "unadjusted" and 1.8 < splits[0]["implied"] < 2.2


def test_streams(spark, tmp_path):
    rows = [(dt.datetime(2020, 1, 1, 10, i), "A", 100.0 + i, i) for i in range(12)]
    spark.createDataFrame(rows, "ts timestamp, ticker string, price double, event_id long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, ticker string, price double, event_id long").parquet(str(tmp_path / "in"))
    q = streaming.bars(stream).writeStream.format("memory").queryName("b").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("b").orderBy("start").collect()
    assert [(r["open"], r["close"], r["n"]) for r in got] == [(100.0, 104.0, 5), (105.0, 109.0, 5), (110.0, 111.0, 2)]
    q = streaming.running_variance(stream).writeStream.format("memory").queryName("v").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("v").agg({"n": "max"}).first()[0] == 11


def test_retries_and_fallback(spark, tmp_path):
    calls, waits = [], []

    def remote(spec):
        calls.append(spec.symbol)
        if len(calls) < 3:
            raise OSError("busy")
        return spark.createDataFrame([("2019-12-31", 1.0), ("2020-01-02", 2.0)], "date string, close double")

    spec = fetch.Spec("^X", "x", dt.date(2020, 1, 1), str(tmp_path / "f"))
    got = fetch.fetch(spark, spec, remote, wait=2.0, sleep=waits.append).collect()
    assert [(r["date"], r["close"], r["symbol"], r["origin"]) for r in got] == [(dt.date(2020, 1, 2), 2.0, "x", "remote")] and waits == [2.0, 4.0]

    def down(spec):
        raise OSError("down")

    files.write_csv(spark.createDataFrame([("2020-01-03", 5.0)], "Date string, Close double"), str(tmp_path / "f"))
    assert fetch.fetch(spark, spec, down, sleep=waits.append).first()["origin"] == "fallback"
    with pytest.raises(OSError):
        fetch.fetch(spark, fetch.Spec("^X", "x", dt.date(2020, 1, 1)), down, sleep=waits.append)


def test_row_reader_and_resumable_months(spark, tmp_path):
    spark.range(0, 1000, 1, 2).selectExpr("id", "cast(id % 5 as string) AS ticker", "id * 2 AS other").write.parquet(str(tmp_path / "t"))
    paths = sorted(str(p) for p in (tmp_path / "t").glob("*.parquet"))
    assert fetch.read_rows(spark, paths, ["id"], "ticker", ["1", "3"], batch=64).count() == 400
    read = []

    def one(m):
        read.append(m)
        return spark.createDataFrame([(m, 1)] if m != "2020-02" else [], "m string, v int")

    wanted = fetch.months(dt.date(2019, 12, 5), dt.date(2020, 3, 1))
    assert wanted == ["2019-12", "2020-01", "2020-02", "2020-03"]
    df, said = fetch.extract_months(spark, str(tmp_path / "x"), wanted[:2], one)
    assert df.count() == 2 and set(said.values()) == {"read"}
    df, said = fetch.extract_months(spark, str(tmp_path / "x"), wanted, one)
    assert said == {"2019-12": "kept", "2020-01": "kept", "2020-02": "empty", "2020-03": "read"} and df.count() == 3
    assert fetch.extract_months(spark, str(tmp_path / "x"), wanted, one)[1]["2020-02"] == "empty" and len(read) == 4


def test_config_and_command_line(spark, tmp_path):
    from tidemark import __main__ as cli
    from tidemark import config

    (tmp_path / "c.yaml").write_text("rules:\n  target: 0.15\n  eval_start: 2000-01-03\n")
    rules = config.load(tmp_path / "c.yaml")
    assert (rules.target, rules.eval_start, rules.cap) == (0.15, "2000-01-03", 2.0)
    (tmp_path / "d.yaml").write_text("tarjet: 1\n")
    with pytest.raises(ValueError):
        config.load(tmp_path / "d.yaml")
    assert cli.selftest(spark)["splits", "unadjusted"] == 1
    assert "dm_pairs" in cli.known() and cli.main(["nonsense"]) == 2


def test_calendar():
    from tidemark.functions import calendars

    assert calendars.easter(1999) == dt.date(1999, 4, 4) and calendars.easter(2024) == dt.date(2024, 3, 31)
    assert dt.date(2021, 12, 24) in calendars.holidays(2021) and dt.date(2021, 12, 31) not in calendars.holidays(2022)
    assert len(calendars.sessions(dt.date(2023, 1, 1), dt.date(2023, 12, 31))) == 250 and dt.date(2023, 11, 24) in calendars.early_closes(2023)


def test_sets_and_lookups(spark):
    from tidemark.operators import evaluation as E

    sets = spark.createDataFrame([("q", 2, "a", True), ("q", 2, "b", True), ("q", 5, "a", True), ("q", 5, "b", False)], "loss string, block int, model string, retained boolean")
    assert {r["model"]: r["in_all"] for r in E.retained_everywhere(sets, ["loss"]).collect()} == {"a": True, "b": False}
    assert E.retained_changes(sets, ["loss"]).first()["differ"] == ["b"]
