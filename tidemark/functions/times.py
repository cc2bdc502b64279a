"""Time expressions that don't depend on the session's time zone: everything is arithmetic on epoch microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US = 1_000_000
DAY_US = 86_400 * US


def floor_div(a: Column, b: int) -> Column:
    """Integer floor(a / b) of a long, exact for negative values too."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def local_micros(ts: Column, zone: str | Column) -> Column:
    """Microseconds since 1970 as read on a clock in `zone`."""
    return F.unix_micros(F.from_utc_timestamp(ts, zone))


def pinned(c: Column) -> Column:
    """`c`, computed where it is written: a filter further up isn't rewritten in terms of its inputs, which for an expression used many
    times would repeat it in every place. The condition always holds."""
    return F.when(F.monotonically_increasing_id() >= 0, c)
