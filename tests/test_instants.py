import datetime as dt

import pytest

from tidemark.operators.instants import FORMATS, fit_formats, normalise_instants

FEEDS = [("ny", "America/New_York", "mdy"), ("ldn", "Europe/London", "dmy"), ("tok", "Asia/Tokyo", "ymd"), ("lhi", "Australia/Lord_Howe", "dmy"), ("bad", "Mars/Base", "dmy"), ("free", "UTC", None), ("nul", None, None)]
UTC = dt.timezone.utc


def us(*a, micro=0):
    return int(dt.datetime(*a, tzinfo=UTC).timestamp()) * 1_000_000 + micro


CASES = [
    ("ny", "2025-11-02 00:30:00", us(2025, 11, 2, 4, 30), "ok"), ("ny", "2025-11-02 01:30:00", None, "twice"), ("ny", "2025-03-09 02:30", None, "never"), ("ny", "2025-03-09T03:00", us(2025, 3, 9, 7), "ok"),
    ("ny", "03/09/2025 01:59:59", us(2025, 3, 9, 6, 59, 59), "ok"), ("ldn", "03/09/2025 01:59:59", us(2025, 9, 3, 0, 59, 59), "ok"), ("ny", "13/05/2020 10:00:00", None, "unreadable"), ("tok", "23/12/05 17:23", us(2023, 12, 5, 8, 23), "ok"),
    ("tok", "2014.01.11 05:27:00 +0900", us(2014, 1, 10, 20, 27), "ok"), ("ldn", "29/03/15 05:40", us(2015, 3, 29, 4, 40), "ok"), ("lhi", "06/04/25 01:45", None, "twice"), ("lhi", "06/04/25 02:00", us(2025, 4, 5, 15, 30), "ok"),
    ("ny", "20080501T152234", us(2008, 5, 1, 19, 22, 34), "ok"), ("ny", "20080504 17:48", us(2008, 5, 4, 21, 48), "ok"), ("ny", "2009-W53-4T21:09:57Z", us(2009, 12, 31, 21, 9, 57), "ok"), ("ny", "2010-W53-1T00:00:00Z", None, "unreadable"),
    ("ny", "2008-366T00:38:09z", us(2008, 12, 31, 0, 38, 9), "ok"), ("ny", "2009-366T00:38:09Z", None, "unreadable"), ("ny", "Fri, 01 May 2009 21:15:48 +0530", us(2009, 5, 1, 15, 45, 48), "ok"), ("ny", "31 Jun 2008 10:05:00 +0000", None, "unreadable"),
    ("ny", "01-APR-2019 04:23:00 CEST", us(2019, 4, 1, 2, 23), "ok"), ("ny", "2008-05-22T22:05:00.000000375", us(2008, 5, 23, 2, 5), "ok"), ("ny", "2008-05-14 03:56:00,289+01", us(2008, 5, 14, 2, 56, micro=289000), "ok"), ("ny", "9/21/2011 12:54:19 am EDT", us(2011, 9, 21, 4, 54, 19), "ok"),
    ("ny", "9/21/2011 13:54:19 PM", None, "unreadable"), ("ny", "2020-01-01 12:00:00-05:00[America/New_York]", us(2020, 1, 1, 17), "ok"), ("ny", "2020-01-01 12:00 UTC-03:30", us(2020, 1, 1, 15, 30), "ok"), ("ny", "2020-01-01 12:00:00 XYZ", None, "unreadable"),
    ("ny", ' "1678594837777701545"\r\n', 1678594837777701, "ok"), ("ny", "1466350260", 1466350260000000, "ok"), ("ny", "1466350260123", 1466350260123000, "ok"), ("ny", "1466350260123456", 1466350260123456, "ok"), ("ny", "1289111760.123", 1289111760123000, "ok"), ("ny", "1.314307680e+09", 1314307680000000, "ok"),
    ("ny", "20080504", None, "unreadable"), ("ny", "2008-05-04", None, "unreadable"), ("ny", "10:00:00", None, "unreadable"), ("ny", "2015-06-20T24:61:00", None, "unreadable"), ("ny", "0000-00-00 00:00:00", None, "unreadable"), ("ny", "NaT", None, "unreadable"),
    ("ny", "", None, "unreadable"), ("ny", None, None, "null"), ("bad", "2020-01-01 12:00", None, "no_zone"), ("gone", "2020-01-01 12:00Z", us(2020, 1, 1, 12), "ok"), (None, "2020-01-01 12:00", None, "no_zone"), ("nul", "2020-01-01 12:00", None, "no_zone"), ("ny", "x" * 100_000, None, "unreadable"),
]


def test_each_form(spark):
    rows = [(i, f, t, "clash", 0) for i, (f, t, *_) in enumerate(CASES)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "rec_id long, feed string, timestamp string, zone string, status int")
    feeds = spark.createDataFrame(FEEDS, "feed string, zone string, date_order string")
    got = [r for r in normalise_instants(df, feeds).collect()]
    assert len(got) == len(rows)
    for r in got:
        f, t, want, status = CASES[r["rec_id"]]
        assert (r["ts_us"], r["status"]) == (want, status), (f, t, r)


def test_undeclared_orders_are_estimated_or_marked(spark):
    feeds = spark.createDataFrame(FEEDS, "feed string, zone string, date_order string")
    clear = [(i, "free", f"{13 + i % 15:02d}/0{1 + i % 9}/2020 10:00") for i in range(200)]
    df = spark.createDataFrame([*clear, (900, "free", "04/05/2020 10:00"), (901, "lone", "04/05/2020 10:00Z"), (902, "lone", "05/05/2020 10:00Z")], "rec_id long, feed string, timestamp string")
    got = {r["rec_id"]: r for r in normalise_instants(df, feeds).collect()}
    assert got[900]["status"] == "ok" and got[900]["ts_us"] == us(2020, 5, 4, 10) and got[900]["posterior"] > 0.99
    assert got[901]["status"] == "ambiguous" and got[901]["ts_us"] is None
    assert got[902]["status"] == "ok"  # both orders give one day


def test_em_weights(spark):
    i = {f: 1 << k for k, f in enumerate(FORMATS)}
    both = i["num_dmy"] | i["num_mdy"]
    m = spark.createDataFrame([("s", None, both, 50), ("s", None, i["num_dmy"], 30), ("s", None, i["ymd"], 20), ("t", "mdy", i["num_dmy"], 9), ("u", "mdy", both, 900), ("u", "mdy", i["num_dmy"], 20)], "source string, declared string, mask int, n long")
    w = {r["source"]: r for r in fit_formats(m).collect()}
    assert w["s"]["w_num_dmy"] > 0.75 and 0.15 < w["s"]["w_ymd"] < 0.25 and w["s"]["w_num_mdy"] < 0.01
    assert w["u"]["w_num_mdy"] > 0.98 and w["t"]["w_num_dmy"] > 0.3


def test_a_wrong_declaration_is_overruled_or_marked(spark):
    """A feed declared mdy whose dates can only be dmy; another with a few impossible dates keeps its declaration."""
    feeds = spark.createDataFrame([("wrong", "UTC", "mdy"), ("right", "UTC", "mdy")], "feed string, zone string, date_order string")
    rows = [(i, "wrong", f"{13 + i % 15:02d}/0{1 + i % 9}/2020 10:00") for i in range(300)] + [(900, "wrong", "04/05/2020 10:00")]
    rows += [(1000 + i, "right", f"0{1 + i % 9}/{1 + i % 28:02d}/2020 10:00") for i in range(300)] + [(2000 + i, "right", "13/05/2020 10:00") for i in range(9)]
    got = {r["rec_id"]: r for r in normalise_instants(spark.createDataFrame(rows, "rec_id long, feed string, timestamp string"), feeds).collect()}
    assert all(got[i]["status"] == "ok" and got[i]["ts_us"] == us(2020, 1 + i % 9, 13 + i % 15, 10) for i in range(300))
    assert got[900]["status"] == "ambiguous"
    assert all(got[1000 + i]["ts_us"] == us(2020, 1 + i % 9, 1 + i % 28, 10) for i in range(300)) and all(got[2000 + i]["status"] == "unreadable" for i in range(9))


def test_empty(spark):
    df = spark.createDataFrame([], "rec_id long, feed string, timestamp string")
    assert normalise_instants(df, spark.createDataFrame([], "feed string, zone string, date_order string")).count() == 0


def test_long_padding_is_trimmed(spark):
    texts = [" " * 300 + "2025-03-09T03:00" + "\t" * 300, "2008-05-22T22:05:00." + "1" * 300, "x" * 500, "7" * 400, " " * 400]
    df = spark.createDataFrame([(i, "ny", t) for i, t in enumerate(texts)], "rec_id long, feed string, timestamp string")
    got = {r["rec_id"]: (r["ts_us"], r["status"]) for r in normalise_instants(df, spark.createDataFrame(FEEDS, "feed string, zone string, date_order string")).collect()}
    assert got[0] == (us(2025, 3, 9, 7), "ok") and all(got[i] == (None, "unreadable") for i in (2, 3, 4))
    assert got[1][1] in ("ok", "unreadable") and got[1] in ((us(2008, 5, 23, 2, 5, micro=111111), "ok"), (None, "unreadable"))
