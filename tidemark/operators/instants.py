"""Mixed timestamp formats and time zones to one UTC instant.

Every text is read under each format it fits. A source writes in a mixture of formats (layouts, each with the orders its digits allow, and
bare numbers in each unit), whose shares are estimated by expectation-maximisation: a value contributes likelihood under each valid parse,
the posterior chooses, and a value whose best posterior stays under `accept` is marked ambiguous. A declared order of the source is a
strong prior: it counts as `trust` times the source's own number of all-digit dates. An order that keeps less than `used` of the mass of its
layout isn't one the source writes in: what only reads so is an impossible date. So a declaration decides unless the dates themselves
contradict it on a large scale. Local times are placed by the source's zone; those that occur twice or never are marked.

Fixed readings: a year of four digits in front is year, month, day; two-digit years are 2000-2099; missing seconds are zero; digits
beyond microseconds are cut off; bare numbers count from 1970 in UTC in the unit (s, ms, us, ns) that puts them into 1980-2199; an
offset or zone in the text wins over the source's zone and over a zone name in brackets; the name of a weekday is not checked.

Status: ok, null, unreadable (also impossible dates, times and zones), no_zone, twice, never, ambiguous. Only ok has an instant.
Nulls in any column, empty and very long texts, repeated rows (each comes out), empty tables, sources absent
from the list (their orders are estimated, their local times are no_zone) and clashing further columns are all fine.
"""

from __future__ import annotations

import zoneinfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import DAY_US, US, pinned
from tidemark.session import cut

# Offsets of zone abbreviations in minutes, US and European use.
ABBREVIATIONS = {"Z": 0, "UTC": 0, "GMT": 0, "BST": 60, "CET": 60, "CEST": 120, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "JST": 540}
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
ORDERS = ("dmy", "mdy", "ymd")
UNITS = (1, 1000, 1_000_000, 1_000_000_000)
#: Formats of the mixture: the layouts with one reading, the all-digit layouts by order, bare numbers by unit.
FORMATS = ("ymd", "ymd8", "ymdt", "week", "nth", "mon", "num_dmy", "num_mdy", "two_dmy", "two_mdy", "two_ymd", "s", "ms", "us", "ns")
#: Instants that a bare number may mean, in seconds.
EPOCH_RANGE = (315_532_800, 7_258_118_400)

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s?([AaPp][Mm]))?"
_TAIL = r"\s*(Z|z|[A-Za-z]{3,4}|(?:UTC|GMT)?\s?[+-]\d{2}(?::?\d{2})?)?(?:\[[A-Za-z0-9_+/-]+\])?$"
#: Layout: pattern, then the date kind and its three parts as groups; all are rewritten to one form kind|a|b|c|H|M|S|f|ap|zone.
LAYOUTS = (
    (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?:[T _]|\s+)" + _CLOCK + _TAIL, "ymd|$1|$3|$4|$5|$6|$7|$8|$9|$10"),
    (r"^(\d{4})(\d{2})(\d{2})(?:[T _]|\s+)" + _CLOCK + _TAIL, "ymd8|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (r"^(\d{4})(\d{2})(\d{2})(?:[T _]|\s+)(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?()" + _TAIL, "ymdt|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})(?:[T _]|\s+)" + _CLOCK + _TAIL, "num|$1|$3|$4|$5|$6|$7|$8|$9|$10"),
    (r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{2})(?:[T _]|\s+)" + _CLOCK + _TAIL, "two|$1|$3|$4|$5|$6|$7|$8|$9|$10"),
    (r"^(\d{4})-[Ww](\d{2})-(\d)(?:[T _]|\s+)" + _CLOCK + _TAIL, "week|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (r"^(\d{4})-(\d{3})()(?:[T _]|\s+)" + _CLOCK + _TAIL, "nth|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[- ]([A-Za-z]{3})[a-z]*[- ](\d{4})(?:[T _]|\s+)" + _CLOCK + _TAIL, "mon|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
)


def _shapes() -> list[Column]:
    """For each layout a cheap condition every text it fits meets, from the first characters with digits made equal."""
    shape = F.translate(F.substring("s", 1, 9), "123456789", "000000000")
    year, fifth = shape.startswith("0000"), F.substring(shape, 5, 1)
    eight = shape.startswith("00000000")
    short = ~year & (F.substring(shape, 2, 1).isin("-", "/", ".") | F.substring(shape, 3, 1).isin("-", "/", "."))
    return [year & fifth.isin("-", "/", "."), eight, eight, short, short, year & F.upper(F.substring(shape, 6, 1)).eqNullSafe("W"), shape.startswith("0000-000"), ~year]


_NUMBER = r"^[+]?\d{1,20}(?:\.\d*)?(?:[eE][+]?\d{1,2})?$"


def _int(c: Column) -> Column:
    return F.when(c != "", c.cast("int"))


def _date(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a date in digits, null where it doesn't exist."""
    return F.unix_date(F.when(y != "0000", F.concat(y, F.lit("-"), m, F.lit("-"), d)).try_cast("date"))


def _iso_week(y: Column, w: Column, d: Column) -> Column:
    jan4 = F.unix_date(F.make_date(F.when(y.between(1, 9998), y), F.lit(1), F.lit(4)))
    monday = jan4 - F.pmod(jan4 + 3, F.lit(7))
    jan4n = F.unix_date(F.make_date(F.when(y.between(1, 9998), y) + 1, F.lit(1), F.lit(4)))
    weeks = ((jan4n - F.pmod(jan4n + 3, F.lit(7)) - monday) / 7).cast("int")
    return F.when(w.between(1, weeks) & d.between(1, 7), monday + (w - 1) * 7 + d - 1)


def read_texts(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """Each text's parses: `num_us` (a bare number's instant), `local` (seconds and fraction of the day apart from the date) by order:
    `fixed`, or `o_dmy`, `o_mdy`, `o_ymd` in days since 1970, `tod` in microseconds, `zone_min` (offset; null if none) and `zoned`."""
    s = F.regexp_replace(F.col(text), r"^[\s ﻿\"']+|[\s ﻿\"']+$", "")
    base = df.select(F.col(key).alias("key"), F.col(source).alias("source"), s.alias("s"))
    form: Column = F.lit(None).cast("string")
    for (pattern, to), fits in zip(reversed(LAYOUTS), reversed(_shapes())):
        form = F.when(fits & F.col("s").rlike(pattern), F.regexp_replace("s", pattern, to)).otherwise(form)
    base = base.withColumn("p", pinned(F.split(form, r"\|", -1)))
    p = [F.col("p")[i] for i in range(10)]
    kind, ap, zone = p[0], F.upper(p[8]), F.upper(F.regexp_replace(p[9], r"\s", ""))
    h, m, sec = _int(p[4]), _int(p[5]), F.coalesce(_int(p[6]), F.lit(0))
    hour = F.when(ap == "", F.when(h <= 23, h)).otherwise(F.when(h.between(1, 12), F.pmod(h, F.lit(12)) + F.when(ap == "PM", 12).otherwise(0)))
    tod = F.when((m <= 59) & (sec <= 59), (hour * 3600 + m * 60 + sec).cast("long") * US + F.rpad(F.substring(p[7], 1, 6), 6, "0").cast("long"))
    a, b, c = p[1:4]
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(b)).cast("string")
    fixed = (
        F.when(kind.startswith("ymd"), _date(a, b, c)).when(kind == "week", _iso_week(_int(F.when(kind == "week", a)), _int(F.when(kind == "week", b)), _int(F.when(kind == "week", c))))
        # the day of the year by counting from its first day, if that stays in the year
        .when(kind == "nth", F.when((b > "000") & (b <= F.when(_date(a, F.lit("2"), F.lit("29")).isNotNull(), "366").otherwise("365")), _date(a, F.lit("1"), F.lit("1")) + b.try_cast("int") - 1))
        .when(kind == "mon", _date(c, month, a))
    )
    full = F.when(kind == "two", F.concat(F.lit("20"), c)).when(kind == "num", c)
    off = F.regexp_extract(zone, r"^(?:UTC|GMT)?([+-])(\d{2}):?(\d{2})?$", 1)
    oh, om = F.regexp_extract(zone, r"([+-])(\d{2}):?(\d{2})?$", 2), F.regexp_extract(zone, r"([+-])(\d{2}):?(\d{2})?$", 3)
    minutes = _int(oh) * 60 + F.coalesce(_int(om), F.lit(0))
    names = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))])
    zone_min = F.when(off != "", F.when((F.coalesce(_int(om), F.lit(0)) <= 59) & (minutes <= 18 * 60), F.when(off == "-", -minutes).otherwise(minutes))).otherwise(F.try_element_at(names, zone))
    n = F.when((F.instr("s", ":") == 0) & F.col("s").rlike(_NUMBER), F.expr("try_cast(s AS decimal(38, 12))"))
    lo, hi = EPOCH_RANGE
    by_unit: Column = F.lit(None).cast("long")
    unit: Column = F.lit(None).cast("string")
    for name, per_s in zip(FORMATS[-4:], UNITS):
        inside = n.between(F.lit(lo * per_s).cast("decimal(38,12)"), F.lit(hi * per_s).cast("decimal(38,12)"))
        us = F.expr(f"try_cast(floor(try_cast(s AS decimal(38, 12)) * {US // per_s}) AS bigint)") if per_s <= US else F.expr(f"try_cast(floor(try_cast(s AS decimal(38, 12)) / {per_s // US}) AS bigint)")
        by_unit = F.when(inside, us).otherwise(by_unit)
        unit = F.when(inside, name).otherwise(unit)
    # a higher-order function keeps the step out of whole-stage code: as one method this much would pass the size up to which the JVM
    # compiles, while a projection of its own is split into methods it does compile
    is_null = F.exists(F.array("s"), lambda x: x.isNull())
    return base.select(
        "key", "source", is_null.alias("is_null"), by_unit.alias("num_us"), F.coalesce(unit, kind).alias("kind"), tod.alias("tod"), fixed.alias("fixed"),
        F.when(kind.isin("num", "two"), _date(full, b, a)).alias("o_dmy"), F.when(kind.isin("num", "two"), _date(full, a, b)).alias("o_mdy"), F.when((kind == "two") & (F.length(a) == 2), _date(F.concat(F.lit("20"), a), b, c)).alias("o_ymd"),
        (zone != "").alias("zoned"), zone_min.alias("zone_min"),
    )


def fit_formats(masks: DataFrame, *, trust: float = 2.0, smooth: float = 1.0, rounds: int = 200, tol: float = 1e-9) -> DataFrame:
    """EM per source over (source, declared, mask, n): the weights of FORMATS. A mask has bit i set where format i gives a valid reading;
    few masks occur, whatever the size of the corpus, so the grouped rows are few. The prior is `smooth` spread over the formats, and for
    a declared order `trust` times the source's all-digit dates of each layout on that order."""
    of_order = {o: np.array([f.endswith("_" + o) for f in FORMATS], dtype=float) for o in ORDERS}
    layouts = [np.array([f.startswith(x) for f in FORMATS]) for x in ("num_", "two_")]

    def em(g: pd.DataFrame) -> pd.DataFrame:
        declared = g["declared"].iloc[0]
        valid = ((g["mask"].to_numpy()[:, None] >> np.arange(len(FORMATS))) & 1).astype(float)
        n = g["n"].to_numpy(dtype=float)[:, None]
        prior = np.full(len(FORMATS), smooth / len(FORMATS))
        if declared in ORDERS:
            for layout in layouts:
                prior += trust * (n * (valid * layout).any(axis=1, keepdims=True)).sum() * of_order[declared] * layout
        w = np.full(len(FORMATS), 1 / len(FORMATS)) if declared not in ORDERS else prior / prior.sum()
        for _ in range(rounds):
            like = valid * w
            total = like.sum(axis=1, keepdims=True)
            post = np.divide(like, total, out=np.zeros_like(like), where=total > 0)
            new = (n * post).sum(axis=0) + prior
            new /= new.sum()
            done = np.abs(new - w).max() < tol
            w = new
            if done:
                break
        return pd.DataFrame({"source": [g["source"].iloc[0]], **{f"w_{f}": [x] for f, x in zip(FORMATS, w)}})

    kind = masks.schema["source"].dataType.simpleString()
    return masks.groupBy("source").applyInPandas(em, f"source {kind}, " + ", ".join(f"w_{f} double" for f in FORMATS))


def normalise_instants(
    df: DataFrame, sources: DataFrame, key: str = "rec_id", source: str = "feed", text: str = "timestamp", *, zone: str = "zone", order: str = "date_order", accept: float = 0.99, used: float = 0.2, trust: float = 2.0
) -> DataFrame:
    """Columns: the key, `ts_us` (epoch microseconds UTC, null unless ok), `status`, `posterior` of the chosen reading."""
    about = sources.groupBy(F.col(source).alias("src")).agg(F.max(zone).alias("zone"), F.max(order).alias("declared"))
    about = about.withColumn("zone", F.when(F.col("zone").isin(sorted(zoneinfo.available_timezones())), F.col("zone")))
    # read once and kept: both the fit and the choice need every parse
    r = cut(read_texts(df, key, source, text)).join(about, F.col("source") == F.col("src"), "left").drop("src")
    digits = F.col("kind").isin("num", "two")

    def valid(f: str) -> Column:
        layout, _, o = f.partition("_")
        if o:
            return (F.col("kind") == layout) & F.col(f"o_{o}").isNotNull()
        return (F.col("kind") == f) & (F.col("num_us").isNotNull() if f in FORMATS[-4:] else F.col("fixed").isNotNull())

    bits = sum((F.coalesce(valid(f), F.lit(False)).cast("int") * (1 << i) for i, f in enumerate(FORMATS)), F.lit(0))
    r = r.withColumn("mask", F.when(F.col("tod").isNotNull() | F.col("num_us").isNotNull(), bits).otherwise(0))
    masks = r.where(F.col("mask") > 0).groupBy("source", "declared", "mask").agg(F.count(F.lit(1)).alias("n"))
    weights = fit_formats(masks, trust=trust).withColumnRenamed("source", "wsrc")
    r = r.join(weights, F.col("source").eqNullSafe(F.col("wsrc")), "left")
    # an order the source writes its layout in: it keeps a share of the layout's mass
    like = {}
    for o in ORDERS:
        w = F.when(F.col("kind") == "num", F.col(f"w_num_{o}") if o != "ymd" else F.lit(0.0)).otherwise(F.col(f"w_two_{o}"))
        mass_of = F.when(F.col("kind") == "num", F.col("w_num_dmy") + F.col("w_num_mdy")).otherwise(F.col("w_two_dmy") + F.col("w_two_mdy") + F.col("w_two_ymd"))
        like[o] = F.when(F.col(f"o_{o}").isNotNull() & (w >= used * mass_of), w).otherwise(0.0)
    r = r.select("*", *[x.alias(f"l_{o}") for o, x in like.items()])
    like = {o: F.col(f"l_{o}") for o in ORDERS}
    total = like["dmy"] + like["mdy"] + like["ymd"]
    # orders that give the same day are one reading
    mass = {o: sum((F.when(F.col(f"o_{q}") == F.col(f"o_{o}"), like[q]).otherwise(0.0) for q in ORDERS), F.lit(0.0)) for o in ORDERS}
    best = F.greatest(*[F.when(like[o] > 0, mass[o]).otherwise(0.0) for o in ORDERS])
    chosen = F.coalesce(*[F.when((like[o] > 0) & (mass[o] == best), F.col(f"o_{o}")) for o in ORDERS])
    # a format with one reading has the whole posterior of its value
    one = (F.col("mask") > 0) & ~digits
    r = r.withColumn("total", total).withColumn("posterior", F.when(one, 1.0).when(digits & (F.col("total") > 0), best / F.col("total")))
    r = r.withColumn("day", F.coalesce("fixed", F.when(F.col("total") > 0, chosen)))
    local = F.col("day").cast("long") * DAY_US + F.col("tod")
    r = r.withColumn("local", local)

    def offset(at: Column) -> Column:
        return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(at), F.col("zone"))) - at

    # a clock change moves the offset between a day before and a day after; an instant counts if it reads as the local time
    r = r.withColumn("u1", F.col("local") - offset(F.col("local") - DAY_US)).withColumn("u2", F.col("local") - offset(F.col("local") + DAY_US))
    hit = {u: F.col(u) + offset(F.col(u)) == F.col("local") for u in ("u1", "u2")}
    r = r.withColumn("h1", hit["u1"]).withColumn("h2", hit["u2"] & (F.col("u1") != F.col("u2")))
    status = (
        F.when(F.col("is_null"), "null").when(F.col("num_us").isNotNull(), "ok").when(F.col("local").isNull() | (F.col("zoned") & F.col("zone_min").isNull()), "unreadable")
        .when(F.col("posterior") < accept, "ambiguous").when(F.col("zoned"), "ok").when(F.col("zone").isNull(), "no_zone")
        .when(F.col("h1") & F.col("h2"), "twice").when(F.col("h1") | F.col("h2"), "ok").otherwise("never")
    )
    ts = F.coalesce("num_us", F.when(F.col("zoned"), F.col("local") - F.col("zone_min").cast("long") * 60 * US).when(F.col("h1"), F.col("u1")).when(F.col("h2"), F.col("u2")))
    r = r.select("key", "posterior", pinned(status).alias("status"), ts.alias("ts"))
    return r.select(F.col("key").alias(key), F.when(F.col("status") == "ok", F.col("ts")).alias("ts_us"), "status", "posterior")
