"""One description of a query's output columns for both engines: "name" as it is, "name:8" rounded, "name:i" bigint, "name:d" date as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shaped(df: DataFrame, spec: str) -> DataFrame:
    cols = []
    for part in spec.split():
        name, _, how = part.partition(":")
        c = F.col(name)
        cols.append((c if not how else c.cast("bigint") if how == "i" else c.cast("date").cast("string") if how == "d" else F.round(c, int(how)) + F.lit(0.0)).alias(name))
    return df.select(*cols)


def shaped_sql(ctes: dict[str, str], source: str, spec: str) -> str:
    """SELECT of the shaped columns from `source` (a CTE's name, with a condition if need be), with the CTEs it needs."""
    cols = []
    for part in spec.split():
        name, _, how = part.partition(":")
        cols.append(f"{name if not how else f'CAST({name} AS BIGINT)' if how == 'i' else f'CAST(CAST({name} AS DATE) AS VARCHAR)' if how == 'd' else f'round({name}, {how}) + 0.0'} AS {name}")
    need: list[str] = []

    def add(text: str) -> None:
        import re

        for n in re.findall(r"\b\w+\b", text):
            if n in ctes and n not in need:
                need.append(n)
                add(ctes[n])

    add(source)
    named = [n for n in ctes if n in need]  # the CTEs stand in an order in which each comes after those it reads
    return ("WITH " + ",\n".join(f"{n} AS ({ctes[n]})" for n in named) + "\n" if named else "") + f"SELECT {', '.join(cols)} FROM {source}"
