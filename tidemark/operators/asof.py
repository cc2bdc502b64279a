"""Attributes as they were known at the time of an event.

An event (entity, `valid` moment D, `asked` moment A) gets the version of its entity with the latest validity <= D among those
available at <= A; then the latest availability, then the smallest id. Entities are hashed into buckets, and each bucket runs
embedded DuckDB. Equal validity and availability are settled first, by the smallest id. An ASOF LEFT JOIN on the availability-ordered
current states (the latest validity known so far) answers every event whose current state isn't newer than D. The rest, asked long
after D, must not see validities past D: the validities up to D are the union of at most log2(n) dyadic ranges, one for each binary
digit of their number, each range has current states of its own, and an ASOF LEFT JOIN on those answers them in the same way.

What one task gets: a first pass counts versions and events by entity. Entities with more than `rows` of either are cut: their
versions into blocks of about `rows` in order of (validity, day of availability), bounded by mergeable quantile sketches and prefix sums,
never by a sort of the whole entity; an event goes to the block of its D and, as a fall-back, to the latest earlier block in which
anything was known at A, so two blocks always hold its answer; the events of a block are salted into groups of about `rows`, each with
a copy of the block. Events without an entity are spread by their id. The layout of the cut entities has one entry for each `rows`
versions; it is broadcast if it has at most `LAYOUT` entries and joined by salted keys beyond that.

Defined cases: events without a match (null or unknown entity, null moments, nothing known yet) come out with nulls; versions with
a null entity part, null moments or a null or NaN `required` value are never in force; repeated events each come out, also with one id
and other moments; repeated versions resolve to the smallest id; empty tables and further columns of clashing names are fine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import DAY_US, floor_div
from tidemark.session import cut

#: Most entries of the layout of cut entities that are broadcast (about 40 bytes each).
LAYOUT = 500_000
#: Ways in which the rows of a cut entity are spread where the layout is joined.
_SPREAD = 16

_ONE = """CREATE TEMP TABLE v AS SELECT g, d, k, max(neg) AS neg FROM v_in GROUP BY g, d, k"""
_STATE = """CREATE TEMP TABLE state AS SELECT g, k, best FROM (
    SELECT g, k, max({'d': d, 'k': k, 'neg': neg}) OVER (PARTITION BY g ORDER BY k RANGE UNBOUNDED PRECEDING) AS best, row_number() OVER (PARTITION BY g, k) AS i FROM v) WHERE i = 1"""
_NOW = """CREATE TEMP TABLE now AS SELECT e.row, e.g, e.vd, e.ak, s.best FROM e_in e ASOF LEFT JOIN state s ON e.g = s.g AND e.ak >= s.k"""
_LATE = (
    "CREATE TEMP TABLE old AS SELECT * FROM now WHERE best.d > vd",
    "CREATE TEMP TABLE days AS SELECT g, d, row_number() OVER (PARTITION BY g ORDER BY d) - 1 AS i FROM (SELECT DISTINCT g, d FROM v WHERE g IN (SELECT g FROM old))",
    # r validities are <= D: the ranges of its binary digits
    """CREATE TEMP TABLE ranges AS SELECT row, g, ak, b, (r >> (b + 1)) << 1 AS node FROM (
        SELECT o.row, o.g, o.ak, y.i + 1 AS r, unnest(range(0, 40)) AS b FROM old o ASOF JOIN days y ON o.g = y.g AND o.vd >= y.d) WHERE (r >> b) & 1 = 1""",
    """CREATE TEMP TABLE members AS SELECT v.g, n.b, n.node, v.d, v.k, v.neg FROM v JOIN days y ON v.g = y.g AND v.d = y.d JOIN (SELECT DISTINCT g, b, node FROM ranges) n ON v.g = n.g AND (y.i >> n.b) = n.node""",
    """CREATE TEMP TABLE states AS SELECT g, b, node, k, best FROM (
        SELECT g, b, node, k, max({'d': d, 'k': k, 'neg': neg}) OVER (PARTITION BY g, b, node ORDER BY k RANGE UNBOUNDED PRECEDING) AS best, row_number() OVER (PARTITION BY g, b, node, k) AS i FROM members) WHERE i = 1""",
    """CREATE TEMP TABLE then_known AS SELECT r.row, max(s.best) AS best FROM ranges r ASOF LEFT JOIN states s ON r.g = s.g AND r.b = s.b AND r.node = s.node AND r.ak >= s.k GROUP BY r.row""",
)


def _solve(versions, events):
    """Arrow tables v(g, d, k, neg) and e(row, g, vd, ak) to an Arrow table (row, d, k, neg) with one row for each event."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.register("v_in", versions)
    con.register("e_in", events)
    for q in (_ONE, _STATE, _NOW):
        con.execute(q)
    if con.execute("SELECT count(*) FROM now WHERE best.d > vd").fetchone()[0]:
        for q in _LATE:
            con.execute(q)
        con.execute("CREATE TEMP TABLE answer AS SELECT n.row, CASE WHEN n.best.d > n.vd THEN t.best ELSE n.best END AS best FROM now n LEFT JOIN then_known t ON n.row = t.row")
    else:
        con.execute("CREATE TEMP TABLE answer AS SELECT row, best FROM now")
    out = con.execute("SELECT row, best.d AS d, best.k AS k, best.neg AS neg FROM answer ORDER BY row").to_arrow_table()
    con.close()
    return out


def _per_bucket(vs, es):
    """Arrow of one bucket to (event, entity, vd, ak, own, d, k, id), one row for each event sent."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(es)
    asked = pa.table({"row": pa.array(np.arange(n)), "g": es["g"], "vd": es["vd"], "ak": es["ak"]})
    got = _solve(vs.select(["g", "d", "k", "neg"]), asked)
    return pa.table({
        "eid": es["eid"], "e": es["e"], "vd": es["vd"], "ak": es["ak"], "own": es["own"],
        "d": got["d"].cast(pa.int64()), "k": got["k"].cast(pa.int64()), "id": pc.negate(got["neg"].cast(pa.int64())),
    })


_FOUND = "eid bigint, e string, vd bigint, ak bigint, own boolean, d bigint, k bigint, id bigint"


def _layout(v: DataFrame, big: DataFrame, rows: int) -> DataFrame:
    """For each cut entity (`e`) its blocks in order: first (d, day of availability), earliest availability, number."""
    cells = v.join(F.broadcast(big.select("e")), "e", "left_semi").groupBy("e", "d", floor_div(F.col("k"), DAY_US).alias("kd")).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k0"))
    # coarse pieces between quantiles of the validity, so that no window holds a whole entity
    marks = cells.groupBy("e").agg(F.percentile_approx("d", [i / 256 for i in range(1, 256)], 2560).alias("marks"))
    cells = cells.join(F.broadcast(marks), "e").withColumn("piece", F.size(F.filter("marks", lambda m: m < F.col("d")))).drop("marks")
    sums = cells.groupBy("e", "piece").agg(F.sum("n").alias("n"))
    start = sums.select("e", "piece", (F.sum("n").over(Window.partitionBy("e").orderBy("piece")) - F.col("n")).alias("start"))
    local = F.sum("n").over(Window.partitionBy("e", "piece").orderBy("d", "kd")) - F.col("n")
    numbered = cells.withColumn("local", local).join(start, ["e", "piece"]).withColumn("b", F.floor((F.col("start") + F.col("local")) / rows))
    blocks = numbered.groupBy("e", "b").agg(F.min(F.struct("d", "kd")).alias("lo"), F.min("k0").alias("k0"))
    return blocks.groupBy("e").agg(F.sort_array(F.collect_list(F.struct("lo", "k0", "b"))).alias("blocks"))


def _beside(df: DataFrame, small: DataFrame, on: list[str], by: str, entries: int) -> DataFrame:
    """`df` left-joined with a layout table: broadcast if it is small, by salted keys beyond."""
    if entries <= LAYOUT:
        return df.join(F.broadcast(small), on, "left")
    salted = small.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(_SPREAD - 1))))
    return df.withColumn("s", F.pmod(F.xxhash64(by), F.lit(_SPREAD)).cast("int")).join(salted, [*on, "s"], "left").drop("s")


def known_at_event(
    events: DataFrame, versions: DataFrame, *, entity: list[str], event_id: str, event_valid: str, event_asked: str, version_id: str, version_valid: str, version_known: str,
    required: list[str] | None = None, rows: int = 200_000,
) -> DataFrame:
    """Columns: `event_id`, `version_id` (null without a match). One row per event."""
    ok = F.lit(True)
    for c in [*entity, version_valid, version_known, version_id]:
        ok &= F.col(c).isNotNull()
    for c in required or []:
        ok &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))

    def moment(c: str, df: DataFrame):
        kind = dict(df.dtypes)[c]
        return F.unix_date(F.col(c)).cast("long") if kind == "date" else F.unix_micros(F.col(c)) if kind.startswith("timestamp") else F.col(c).cast("long")

    ent = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in entity])
    v = versions.where(ok).select(ent.alias("e"), moment(version_valid, versions).alias("d"), moment(version_known, versions).alias("k"), (-F.col(version_id).cast("long")).alias("neg"))
    known = F.lit(True)
    for c in [*entity, event_valid, event_asked]:
        known &= F.col(c).isNotNull()
    asked = events.select(F.when(known, ent).alias("e"), F.col(event_id).cast("long").alias("eid"), moment(event_valid, events).alias("vd"), moment(event_asked, events).alias("ak"))

    sizes = v.select("e", F.lit(1).alias("v"), F.lit(0).alias("a")).unionAll(asked.select("e", F.lit(0).alias("v"), F.lit(1).alias("a"))).groupBy("e").agg(F.sum("v").alias("v"), F.sum("a").alias("a"))
    sizes = cut(sizes)
    big = sizes.where(F.col("e").isNotNull() & ((F.col("v") > rows) | (F.col("a") > rows)))
    total, n_big = sizes.select(F.sum(F.col("v") + F.col("a")).alias("n"), F.count_if(F.col("e").isNotNull() & ((F.col("v") > rows) | (F.col("a") > rows))).alias("b")).first()
    n_buckets = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // rows))

    if n_big:
        v, asked = _cut_entities(v, asked, big, rows)
    else:
        v, asked = v.withColumn("g", F.col("e")), asked.withColumn("g", F.coalesce("e", F.col("eid").cast("string"))).withColumn("own", F.lit(True))
    bucket = F.pmod(F.xxhash64("g"), F.lit(n_buckets)).cast("int").alias("bucket")
    left = v.select(bucket, "g", "d", "k", "neg")
    right = asked.select(bucket, F.when(F.col("e").isNotNull(), F.col("g")).alias("g"), "eid", "e", "vd", "ak", "own")
    found = left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(_per_bucket, _FOUND)
    if n_big:
        # of an event asked in two blocks the later validity wins; as many rows as there were such events
        both = found.groupBy("eid", "e", "vd", "ak").agg(F.max_by("id", F.struct("d", "k", -F.col("id"))).alias("id"), F.count_if("own").cast("int").alias("times"))
        found = both.select("eid", "id", F.explode(F.sequence(F.lit(1), F.col("times"))))
    kind = events.schema[event_id].dataType
    return found.select(F.col("eid").cast(kind).alias(event_id), F.col("id").alias(version_id))


def _cut_entities(v: DataFrame, asked: DataFrame, big: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Versions and events with `g`, the group of (entity, block, salt) each belongs to, and whether an event's row is that of its own block."""
    blocks = cut(_layout(v, big, rows))
    entries = blocks.select(F.sum(F.size("blocks"))).first()[0] or 0
    v = _beside(v, blocks, ["e"], "neg", entries)
    at = F.struct(F.col("d"), floor_div(F.col("k"), DAY_US).alias("kd"))
    v = v.withColumn("b", F.coalesce(F.element_at(F.filter("blocks", lambda x: x["lo"] <= at), -1)["b"], F.lit(0))).drop("blocks")
    placed = _beside(asked, blocks, ["e"], "eid", entries)
    upto = F.filter("blocks", lambda x: x["lo"]["d"] <= F.col("vd"))
    placed = placed.withColumn("mine", F.try_element_at(upto, F.lit(-1))["b"])
    before = F.filter("blocks", lambda x: (x["b"] < F.col("mine")) & (x["k0"] <= F.col("ak")))
    placed = placed.withColumn("prev", F.try_element_at(before, F.lit(-1))["b"]).drop("blocks")
    visits = F.array_compact(F.array(F.struct(F.coalesce("mine", F.lit(0)).alias("b"), F.lit(True).alias("own")), F.when(F.col("prev").isNotNull(), F.struct(F.col("prev").alias("b"), F.lit(False).alias("own")))))
    asked = cut(placed.select("eid", "e", "vd", "ak", F.explode(visits).alias("z")).select("eid", "e", "vd", "ak", "z.b", "z.own"))
    load = cut(asked.where(F.col("e").isNotNull()).groupBy("e", "b").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("salts")).where(F.col("salts") > 1))
    n_load = load.count()
    asked = _beside(asked, load, ["e", "b"], "eid", n_load)
    salt = F.when(F.col("e").isNull(), F.xxhash64("eid")).otherwise(F.pmod(F.xxhash64("eid", "vd", "ak"), F.coalesce("salts", F.lit(1))))
    asked = asked.withColumn("g", F.concat_ws("\x1e", "e", F.col("b").cast("string"), salt.cast("string")))
    v = _beside(v, load, ["e", "b"], "neg", n_load).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1)))
    return v.withColumn("g", F.concat_ws("\x1e", "e", F.col("b").cast("string"), F.col("salt").cast("string"))), asked
