"""Queries of the general data-preparation problems (p1-p5) over the tables of a data folder, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.asof import known_at_event
from tidemark.operators.grid import counter_grid, empty_cells, regular_grid
from tidemark.operators.instants import normalise_instants
from tidemark.operators.spikes import flagged_bars
from tidemark.operators.trailing import trailing_totals
from tidemark.sources.tables import table


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    return regular_grid(table(spark, folder, "qqq_1m"), ["feed", "ticker"], require=["ticker"], ties=["ingested_at", "bar_id"])


def _counter(spark: SparkSession, folder: str, carry: bool) -> DataFrame:
    return counter_grid(table(spark, folder, "qqq_1m"), ["feed", "ticker"], require=["ticker"], ties=["ingested_at", "bar_id"], carry=carry)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return empty_cells(_counter(spark, folder, carry=False)).select("feed", "ticker", "slot")


def p1_grid(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder).withColumn("session", F.col("session").cast("string"))


def p1_counter(spark: SparkSession, folder: str) -> DataFrame:
    g = _counter(spark, folder, carry=True)
    # shares of four-digit increments often end in a tie at any digit; the offset moves them off it in both engines
    return g.select("feed", "ticker", "slot", "n_readings", *[F.round(F.col(c) + 3.14e-8, 6).alias(c) for c in ("increase", "unplaced")], "resets", F.round("covered_s", 3).alias("covered_s"), F.round("uncovered_s", 3).alias("uncovered_s"))


def p2_totals(spark: SparkSession, folder: str) -> DataFrame:
    t = trailing_totals(table(spark, folder, "rv_panel"))
    return t.select("source", "day", "span", *[F.round(c, 10).alias(c) if c.startswith(("rv_daily_", "yz_21_")) and not c.endswith("_days") else c for c in t.columns[3:]])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return trailing_totals(table(spark, folder, "rv_panel"), values=["rv_daily"]).where(F.col("rv_daily_days") == 0).select("source", "day", "span")


def p3_instants(spark: SparkSession, folder: str) -> DataFrame:
    return normalise_instants(table(spark, folder, "qqq_1m_raw"), table(spark, folder, "feeds"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_instants(spark, folder).where(F.col("status") == "ok").select("rec_id", "ts_us")


def _asof(spark: SparkSession, folder: str) -> DataFrame:
    return known_at_event(
        table(spark, folder, "forecast_v21"), table(spark, folder, "param_paths"), entity=["source", "model", "dist"], event_id="origin_id", event_valid="date", event_asked="asked_at",
        version_id="param_id", version_valid="date", version_known="known_at", required=["alpha", "beta"],
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _asof(spark, folder).where(F.col("param_id").isNotNull())


def p4_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Every origin with the attributes in force; nulls where none was."""
    p = table(spark, folder, "param_paths").select(F.col("param_id").alias("pid"), "alpha", "beta", "sig2bar")
    got = _asof(spark, folder)
    return got.join(p, got["param_id"] == p["pid"], "left").select("origin_id", "param_id", "alpha", "beta", F.when(~F.isnan("sig2bar"), F.col("sig2bar")).alias("sig2bar"))


QUERIES = {"p1_found": p1_found, "p1_grid": p1_grid, "p1_counter": p1_counter, "p2_found": p2_found, "p2_totals": p2_totals, "p3_found": p3_found, "p3_instants": p3_instants, "p4_found": p4_found, "p4_attributes": p4_attributes}

_P1_BARS = """
bars AS (
  SELECT feed, ticker, close, volume, bar_id, ingested_at, "timestamp" AS ts, epoch_us("timestamp") AS t, timezone('America/New_York', "timestamp") AS lt
  FROM qqq_1m WHERE "timestamp" IS NOT NULL AND ticker IS NOT NULL AND close IS NOT NULL),
rth AS (SELECT *, CAST(lt AS DATE) AS sess, t // 300000000 * 300 AS slot FROM bars WHERE CAST(lt AS TIME) >= TIME '09:30:00' AND CAST(lt AS TIME) < TIME '16:00:00')"""

_P1_GRID = f"""WITH {_P1_BARS},
cells AS (SELECT feed, ticker, sess, slot, count(*) AS n, arg_max(close, row(t, ingested_at, bar_id, close)) AS last FROM rth GROUP BY ALL),
ends AS (SELECT feed, ticker, sess, min(slot) AS a, max(slot) AS z FROM cells GROUP BY ALL),
axis AS (SELECT feed, ticker, sess, unnest(range(a, z + 1, 300)) AS slot FROM ends),
j AS (SELECT x.feed, x.ticker, x.sess, x.slot, c.n, c.last,
        last_value(CASE WHEN c.n IS NOT NULL THEN x.slot END IGNORE NULLS) OVER w AS seen, last_value(c.last IGNORE NULLS) OVER w AS carried
      FROM axis x LEFT JOIN cells c ON x.feed IS NOT DISTINCT FROM c.feed AND x.ticker = c.ticker AND x.sess = c.sess AND x.slot = c.slot
      WINDOW w AS (PARTITION BY x.feed, x.ticker, x.sess ORDER BY x.slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

_P2_ROWS = """WITH best AS (
  SELECT source, date, rv, yz FROM (SELECT source, date, CASE WHEN NOT isnan(rv_daily) THEN rv_daily END AS rv, CASE WHEN NOT isnan(yz_21) THEN yz_21 END AS yz,
    row_number() OVER (PARTITION BY source, date ORDER BY loaded_at DESC NULLS LAST, CASE WHEN NOT isnan(rv_daily) THEN rv_daily END DESC NULLS LAST, CASE WHEN NOT isnan(yz_21) THEN yz_21 END DESC NULLS LAST) AS i
    FROM rv_panel WHERE date IS NOT NULL) WHERE i = 1),
axis AS (SELECT source, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM best GROUP BY source),
days AS (SELECT a.source, a.date, b.rv, b.yz FROM axis a LEFT JOIN best b ON a.source IS NOT DISTINCT FROM b.source AND a.date = b.date)"""


def _p2_span(span: int) -> str:
    w = f"OVER (PARTITION BY source ORDER BY date ROWS BETWEEN {span - 1} PRECEDING AND CURRENT ROW)"

    def of(c: str, name: str) -> str:
        return f"CAST(count({c}) {w} AS INTEGER) AS {name}_days, round(coalesce(sum({c}) {w}, 0), 10) AS {name}_total, round(avg({c}) {w}, 10) AS {name}_avg, round(min({c}) {w}, 10) AS {name}_min, round(max({c}) {w}, 10) AS {name}_max"

    return f"SELECT source, CAST(date AS VARCHAR) AS day, CAST({span} AS INTEGER) AS span, {of('rv', 'rv_daily')}, {of('yz', 'yz_21')} FROM days"


_P4 = """WITH ok AS (SELECT * FROM param_paths WHERE date IS NOT NULL AND known_at IS NOT NULL AND alpha IS NOT NULL AND beta IS NOT NULL AND NOT isnan(alpha) AND NOT isnan(beta)),
found AS (SELECT f.origin_id, arg_max(p.param_id, row(p.date, p.known_at, -p.param_id)) AS param_id
  FROM forecast_v21 f JOIN ok p ON f.source = p.source AND f.model = p.model AND f.dist = p.dist AND p.date <= f.date AND p.known_at <= f.asked_at GROUP BY f.origin_id)"""

_P1_COUNTER = f"""WITH {_P1_BARS},
one AS (SELECT feed, ticker, sess, t, count(*) AS n, arg_max(close, row(ingested_at, bar_id, close)) FILTER (WHERE NOT isnan(close)) AS v FROM rth GROUP BY ALL),
held AS (SELECT feed, ticker, sess, t, v, lag(t) OVER w AS t0, lag(v) OVER w AS v0, row_number() OVER w AS i, lag(v) OVER s AS vs FROM one WHERE v IS NOT NULL
  WINDOW w AS (PARTITION BY feed, ticker, sess ORDER BY t), s AS (PARTITION BY feed, ticker ORDER BY t)),
parts AS (SELECT *, unnest(range(t0 // 300000000, t // 300000000 + 1)) AS c, CASE WHEN v < v0 THEN v ELSE v - v0 END AS inc FROM held WHERE t0 IS NOT NULL),
cut AS (SELECT *, greatest(least((c + 1) * 300000000, t) - greatest(c * 300000000, t0), 0) AS over FROM parts),
spread AS (SELECT feed, ticker, sess, c, sum(CASE WHEN t - t0 <= 900000000 THEN inc * (over / (t - t0)) ELSE 0 END) AS increase, sum(CASE WHEN t - t0 > 900000000 AND c = t // 300000000 THEN inc ELSE 0 END) AS unplaced,
  sum(CASE WHEN v < v0 AND c = t // 300000000 THEN 1 ELSE 0 END) AS resets, sum(CASE WHEN t - t0 <= 900000000 THEN over ELSE 0 END) AS covered, sum(CASE WHEN t - t0 > 900000000 THEN over ELSE 0 END) AS uncovered FROM cut GROUP BY ALL),
night AS (SELECT feed, ticker, sess, t // 300000000 AS c, CASE WHEN v < vs THEN v ELSE v - vs END AS inc, CASE WHEN v < vs THEN 1 ELSE 0 END AS fell FROM held WHERE i = 1 AND vs IS NOT NULL),
counts AS (SELECT feed, ticker, sess, t // 300000000 AS c, sum(n) AS n FROM one GROUP BY ALL),
axis AS (SELECT feed, ticker, sess, unnest(range(min(c), max(c) + 1)) AS c FROM counts GROUP BY feed, ticker, sess)
SELECT a.feed, a.ticker, a.c * 300 AS slot, CAST(coalesce(k.n, 0) AS BIGINT) AS n_readings, round(coalesce(p.increase, 0) + 3.14e-8, 6) AS increase, round(coalesce(p.unplaced, 0) + coalesce(g.inc, 0) + 3.14e-8, 6) AS unplaced,
  CAST(coalesce(p.resets, 0) + coalesce(g.fell, 0) AS BIGINT) AS resets, round(coalesce(p.covered, 0) / 1e6, 3) AS covered_s, round(coalesce(p.uncovered, 0) / 1e6, 3) AS uncovered_s
FROM axis a LEFT JOIN counts k ON a.feed IS NOT DISTINCT FROM k.feed AND a.ticker = k.ticker AND a.sess = k.sess AND a.c = k.c
  LEFT JOIN spread p ON a.feed IS NOT DISTINCT FROM p.feed AND a.ticker = p.ticker AND a.sess = p.sess AND a.c = p.c
  LEFT JOIN night g ON a.feed IS NOT DISTINCT FROM g.feed AND a.ticker = g.ticker AND a.sess = g.sess AND a.c = g.c"""

ORACLE = {
    "p1_counter": _P1_COUNTER,
    "p1_found": _P1_GRID + " SELECT feed, ticker, slot FROM j WHERE n IS NULL",
    "p1_grid": _P1_GRID + """ SELECT feed, ticker, CAST(sess AS VARCHAR) AS session, slot, coalesce(n, 0) AS n_readings, last,
        CASE WHEN slot - seen <= 600 THEN carried END AS filled, CASE WHEN n IS NOT NULL THEN 'observed' WHEN slot - seen <= 600 THEN 'filled' ELSE 'uncovered' END AS status FROM j""",
    "p2_found": _P2_ROWS + f", spans AS ({_p2_span(7)} UNION ALL {_p2_span(30)}) SELECT source, day, span FROM spans WHERE rv_daily_days = 0",
    "p2_totals": _P2_ROWS + f" {_p2_span(7)} UNION ALL {_p2_span(30)}",
    "p4_found": _P4 + " SELECT origin_id, param_id FROM found",
    "p4_attributes": _P4 + " SELECT f.origin_id, x.param_id, p.alpha, p.beta, CASE WHEN NOT isnan(p.sig2bar) THEN p.sig2bar END AS sig2bar FROM forecast_v21 f LEFT JOIN found x ON f.origin_id = x.origin_id LEFT JOIN param_paths p ON p.param_id = x.param_id",
}


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return flagged_bars(table(spark, folder, "qqq_1m")).select(F.col("bar").alias("bar_id"))


def p5_reasons(spark: SparkSession, folder: str) -> DataFrame:
    r = flagged_bars(table(spark, folder, "qqq_1m"))
    return r.select(F.col("bar").alias("bar_id"), *[(F.col(c) > 0.5).alias(c) for c in r.columns[1:]])


QUERIES |= {"p5_found": p5_found, "p5_reasons": p5_reasons}
