"""Sessions of the New York stock exchange by rule: weekends, fixed and moving holidays, and early closes."""

from __future__ import annotations

import datetime as dt
from functools import lru_cache

DAY = dt.timedelta(1)


def easter(year: int) -> dt.date:
    """Sunday of Easter by the anonymous Gregorian rule."""
    a, (b, c) = year % 19, divmod(year, 100)
    d, e = divmod(b, 4)
    h = (19 * a + b - d - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    i, k = divmod(c, 4)
    x = (32 + 2 * e + 2 * i - h - k) % 7
    m = (a + 11 * h + 22 * x) // 451
    month, day = divmod(h + x - 7 * m + 114, 31)
    return dt.date(year, month, day + 1)


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    """n-th weekday of a month; the last one for n = -1."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + DAY * ((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - DAY
    return last - DAY * ((last.weekday() - weekday) % 7)


def _observed(d: dt.date) -> dt.date | None:
    """A holiday on Sunday moves to Monday, on Saturday to Friday; New Year's Day isn't moved into the year before."""
    if d.weekday() == 6:
        return d + DAY
    if d.weekday() == 5:
        return None if (d.month, d.day) == (1, 1) else d - DAY
    return d


@lru_cache(maxsize=512)
def holidays(year: int) -> frozenset[dt.date]:
    days = [_observed(dt.date(year, 1, 1)), _nth(year, 2, 0, 3), easter(year) - 2 * DAY, _nth(year, 5, 0, -1), _observed(dt.date(year, 7, 4)), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4), _observed(dt.date(year, 12, 25))]
    if year >= 1998:
        days.append(_nth(year, 1, 0, 3))
    if year >= 2022:
        days.append(_observed(dt.date(year, 6, 19)))
    return frozenset(d for d in days if d is not None)


def is_session(d: dt.date) -> bool:
    return d.weekday() < 5 and d not in holidays(d.year)


def sessions(first: dt.date, last: dt.date) -> list[dt.date]:
    return [d for d in (first + DAY * i for i in range((last - first).days + 1)) if is_session(d)]


def early_closes(year: int) -> list[dt.date]:
    """Days that close at 13:00: before Independence Day, after Thanksgiving, Christmas Eve, where they are sessions."""
    return [d for d in (dt.date(year, 7, 3), _nth(year, 11, 3, 4) + DAY, dt.date(year, 12, 24)) if is_session(d)]
