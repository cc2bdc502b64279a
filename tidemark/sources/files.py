"""File sources and sinks: CSV, parquet with a sidecar, cached writes, inventories, footers, local series and synthetic minute bars."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; names are trimmed, lower-cased and joined by underscores."""
    df = spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)
    return df.toDF(*[re.sub(r"\W+", "_", c.strip().lower()).strip("_") for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_with_sidecar(df: DataFrame, path: str, about: dict | None = None, date: str = "date") -> dict:
    """Parquet, and beside it what was written: rows, columns, range of dates. The figures are read from the written files."""
    df.write.mode("overwrite").parquet(path)
    got = df.sparkSession.read.parquet(path)
    r = got.agg(F.count(F.lit(1)).alias("rows"), *([F.min(date).cast("string").alias("first"), F.max(date).cast("string").alias("last")] if date in got.columns else [])).first().asDict()
    meta = {"columns": got.columns, **r, **(about or {})}
    df.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + ".meta")
    return meta


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The parquet at `path`, made first if it isn't there or `force` is set; works on any file system Spark knows."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    if force or not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of a folder of parquet, from file metadata alone."""
    return spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size").distinct().select(F.element_at(F.split("file_path", "/"), -1).alias("file"), F.col("file_size").alias("bytes"))


def footers(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Row groups of the parquet files at `path` (a file or a folder): rows and the statistics of `column`. The files are listed by Spark, on
    any file system, and each footer is read where its file is scheduled, from the file's last bytes."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path").distinct()
    listed = listed.repartition(max(1, spark.sparkContext.defaultParallelism), "path")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pfs
        import pyarrow.parquet as pq

        for b in batches:
            out = []
            for p in b["path"]:
                fs, name = pfs.FileSystem.from_uri(p)
                with fs.open_input_file(name) as f:
                    meta = pq.ParquetFile(f).metadata
                for i in range(meta.num_row_groups):
                    g = meta.row_group(i)
                    s = next((g.column(j).statistics for j in range(g.num_columns) if g.column(j).path_in_schema == column), None)
                    out.append((p.rsplit("/", 1)[-1], i, g.num_rows, str(s.min) if s is not None and s.has_min_max else None, str(s.max) if s is not None and s.has_min_max else None))
            yield pd.DataFrame(out, columns=["file", "row_group", "rows", "lo", "hi"])

    return listed.mapInPandas(read, "file string, row_group int, rows long, lo string, hi string")


def prunable(groups: DataFrame, value: str, enough: float = 0.25) -> DataFrame:
    """Share of rows in row groups whose statistics exclude `value`, whether the groups are sorted (each begins where the one before it in its
    file ended, or later), and the verdict."""
    w = Window.partitionBy("file").orderBy("row_group")
    g = groups.withColumn("out", ~F.coalesce((F.col("lo") <= value) & (F.col("hi") >= value), F.lit(True))).withColumn("in_order", F.coalesce(F.col("lo") >= F.lag("hi").over(w), F.lit(True)))
    share = F.sum(F.when(F.col("out"), F.col("rows")).otherwise(0)) / F.sum("rows")
    return g.agg(F.count(F.lit(1)).alias("groups"), share.alias("prunable"), F.every("in_order").alias("sorted"), (share >= enough).alias("worth_it"))


def markdown(df: DataFrame, most: int = 100) -> str:
    """A small result as a Markdown table; more than `most` rows is an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def synthetic_minutes(spark: SparkSession, days: int = 520, seed: int = 7) -> DataFrame:
    """Minute bars with a planted split, half days, gaps and a ticker switch: (ts, ticker, price, event_id). One seeded generator a day, so
    the rows don't depend on the partitions."""
    schema = "ts timestamp, ticker string, price double, event_id long"

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start = pd.bdate_range("1999-03-10", periods=days)
        for b in batches:
            for i in b["id"]:
                rng, d = np.random.default_rng([seed, int(i)]), start[int(i)]
                n = 210 if d.dayofyear % 97 == 0 else 390
                price = 100 * np.exp(np.random.default_rng(seed).normal(0, 0.01, days).cumsum()[int(i)] + rng.normal(0, 0.0005, n).cumsum()) * (1.0 if i < 54 else 0.5)
                keep = rng.random(n) > 0.004
                ts = pd.date_range(d.tz_localize("America/New_York") + pd.Timedelta(minutes=570), periods=n, freq="min").tz_convert("UTC")
                yield pd.DataFrame({"ts": ts[keep], "ticker": "QQQ" if d < pd.Timestamp("2000-06-01") else "QQQQ", "price": price[keep], "event_id": np.flatnonzero(keep) + int(i) * 1000})

    return spark.range(days).mapInPandas(make, schema)


class LocalSeries(DataSource):
    """Stands in for remote price and rate services: `spark.read.format("local_series")` over a folder of CSV files named by symbol."""

    @classmethod
    def name(cls) -> str:
        return "local_series"

    def schema(self) -> str:
        return "symbol string, date string, value double"

    def reader(self, schema) -> DataSourceReader:
        return _LocalReader(self.options["folder"], self.options.get("symbols", ""))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _LocalReader(DataSourceReader):
    def __init__(self, folder: str, symbols: str):
        self.folder, self.symbols = folder, [s for s in symbols.split(",") if s]

    def partitions(self) -> list[_File]:
        files = sorted(Path(self.folder).glob("*.csv"))
        return [_File(str(f)) for f in files if not self.symbols or f.stem in self.symbols]

    def read(self, partition: _File):
        import csv

        p = Path(partition.path)
        with p.open() as f:
            for r in csv.DictReader(f):
                yield p.stem, r["date"], float(r["value"]) if r["value"] else None
