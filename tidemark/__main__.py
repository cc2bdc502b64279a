"""python -m tidemark VERB: `list` names the queries, `run FOLDER QUERY...` prints results, `report FOLDER OUT [QUERY...]` writes Markdown tables,
`checks FOLDER` runs the minute-data checks, `selftest` runs them on synthetic bars with planted faults."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import intraday
from tidemark.plans import data_prep, layers, volatility
from tidemark.session import build_session
from tidemark.sources import files

REPORT = ("loss_table", "dm_pairs", "mincer_zarnowitz", "loss_concentration", "backtest_metrics", "adherence", "return_gap", "sharpe_decomposition", "deflated_sharpe", "cross_layer_ranks", "subperiod_metrics")


def known() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for m in (data_prep, volatility, layers) for n, f in m.QUERIES.items()}


def report(spark: SparkSession, folder: str, out: str, names: tuple[str, ...] = REPORT) -> list[str]:
    """One Markdown file for each query; returns the paths written."""
    Path(out).mkdir(parents=True, exist_ok=True)
    done = []
    for n in names:
        df = known()[n](spark, folder)
        p = Path(out) / f"{n}.md"
        p.write_text(f"# {n}\n\n{files.markdown(df.orderBy(*[c for c, t in df.dtypes if t == 'string']), most=2000)}\n")
        done.append(str(p))
    return done


def checks(minute: DataFrame) -> DataFrame:
    """(check, metric, value) of the minute-data checks in one table."""
    d = intraday.prepared(minute)
    s = intraday.sessions(d)
    daily = intraday.daily_from_minutes(d).withColumnRenamed("ticker", "symbol").withColumnRenamed("day", "date")
    parts = {
        "sessions": s.agg(F.count(F.lit(1)).alias("days"), F.count_if("half_day").alias("half_days"), F.avg("missing").alias("mean_missing"), F.min("bars").alias("fewest_bars")),
        "duplicates": intraday.duplicates(minute, ["ticker", "ts"]),
        "overlaps": intraday.overlaps(d).agg(F.count(F.lit(1)).alias("slots")),
        "splits": intraday.split_candidates(daily).agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("verdict") == "unadjusted").alias("unadjusted")),
    }
    out = None
    for name, df in parts.items():
        long = df.select(*[F.col(c).cast("double").alias(c) for c in df.columns]).unpivot([], df.columns, "metric", "value").select(F.lit(name).alias("check"), "metric", "value")
        out = long if out is None else out.unionByName(long)
    return out


def selftest(spark: SparkSession) -> dict[tuple[str, str], float]:
    """The checks on synthetic bars find what was planted: one unadjusted split, half days, few gaps, no duplicates."""
    got = {(r["check"], r["metric"]): r["value"] for r in checks(files.synthetic_minutes(spark, 130)).collect()}
    if got["splits", "unadjusted"] != 1 or got["sessions", "half_days"] < 1 or got["duplicates", "duplicates"] != 0 or not 0 < got["sessions", "mean_missing"] < 20:
        raise AssertionError(f"planted faults not found: {got}")
    return got


def main(args: list[str]) -> int:
    if not args or args[0] not in ("list", "run", "report", "checks", "selftest"):
        print(__doc__)
        return 2
    verb, rest = args[0], args[1:]
    if verb == "list":
        print("\n".join(known()))
        return 0
    spark = build_session()
    if verb == "run":
        for n in rest[1:]:
            known()[n](spark, rest[0]).show(50, False)
    elif verb == "report":
        print("\n".join(report(spark, rest[0], rest[1], tuple(rest[2:]) or REPORT)))
    elif verb == "checks":
        from tidemark.sources import market

        checks(market.minute_bars(spark, rest[0])).show(100, False)
    else:
        print(selftest(spark))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
