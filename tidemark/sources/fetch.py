"""Fetching by specification: retries with back-off, an offline fall-back, a row reader, and a resumable loop over months."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    """What to fetch: a symbol as its service calls it, the name it gets, its first day, and a file to fall back to."""

    symbol: str
    name: str
    start: dt.date
    fallback: str | None = None


def with_retries(call: Callable[[], DataFrame], attempts: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """The result of `call`, tried up to `attempts` times with waits that grow in step with the attempt; the last error is raised."""
    for i in range(1, attempts + 1):
        try:
            return call()
        except Exception:
            if i == attempts:
                raise
            sleep(wait * i)
    raise ValueError("attempts must be positive")


def fetch(spark: SparkSession, spec: Spec, remote: Callable[[Spec], DataFrame], **retry) -> DataFrame:
    """Rows of the spec's symbol from its first day, from the remote service or, where that fails, from the fall-back CSV; `origin` says which."""
    from tidemark.sources.files import read_csv

    try:
        df, origin = with_retries(lambda: remote(spec), **retry), "remote"
    except Exception:
        if spec.fallback is None:
            raise
        df, origin = read_csv(spark, spec.fallback), "fallback"
    df = df.withColumn("date", F.col("date").cast("date"))
    return df.where(F.col("date") >= F.lit(spec.start)).withColumn("symbol", F.lit(spec.name)).withColumn("origin", F.lit(origin))


def read_rows(spark: SparkSession, paths: list[str], columns: list[str], column: str, values: list[str], batch: int = 65_536) -> DataFrame:
    """The rows of parquet files whose `column` is among `values`, read batch by batch in each task: for files whose layout Spark's own scan
    can't take in one piece (very large row groups). One task a file; a task holds one batch at a time."""
    import pyarrow.parquet as pq

    kinds = {f.name: f.type for f in pq.read_schema(paths[0])}
    schema = spark.read.parquet(paths[0]).select(*columns).schema
    arrow = pa.schema([(c, kinds[c]) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for b in batches:
            for p in b.column(0).to_pylist():
                for part in pq.ParquetFile(p).iter_batches(batch_size=batch, columns=list(dict.fromkeys([*columns, column]))):
                    keep = part.filter(pc.is_in(part.column(column), value_set=pa.array(values, part.column(column).type)))
                    if keep.num_rows:
                        yield keep.select(columns).cast(arrow)

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(len(paths), 1), "path").mapInArrow(run, schema)


def months(first: dt.date, last: dt.date) -> list[str]:
    out, y, m = [], first.year, first.month
    while (y, m) <= (last.year, last.month):
        out.append(f"{y:04d}-{m:02d}")
        y, m = y + m // 12, m % 12 + 1
    return out


def extract_months(spark: SparkSession, folder: str, wanted: list[str], read: Callable[[str], DataFrame], force: bool = False) -> tuple[DataFrame | None, dict[str, str]]:
    """Each wanted month is read and written once, as `folder`/month=YYYY-MM; a month without rows leaves an empty marker, so a run that was
    cut off goes on where it stopped. Returns all months' rows (None if there are none) and what became of each month: kept, empty or read.
    Works on any file system Spark knows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def path(name: str):
        return jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")

    fs = path("").getFileSystem(conf)
    said: dict[str, str] = {}
    for m in wanted:
        done, empty = path(f"month={m}/_SUCCESS"), path(f"_empty/{m}")
        if not force and fs.exists(done):
            said[m] = "kept"
        elif not force and fs.exists(empty):
            said[m] = "empty"
        else:
            df = read(m)
            if df.isEmpty():
                fs.mkdirs(path("_empty"))
                fs.create(empty, True).close()
                said[m] = "empty"
            else:
                df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/month={m}")
                said[m] = "read"
    have = [f"{folder.rstrip('/')}/month={m}" for m in wanted if said[m] != "empty"]
    return (spark.read.option("basePath", folder).parquet(*have) if have else None), said
