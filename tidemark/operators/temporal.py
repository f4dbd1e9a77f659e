"""Reads as known at a cutoff: revisions, effective dates, as-of joins and windows over sessions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder (``spark.checkpoint.dir``), which driver and executors share; a local session without one gets a temporary folder, any other an error."""
    if not spark.sparkContext.getCheckpointDir():
        chosen = spark.conf.get("spark.checkpoint.dir", None)
        if not chosen and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(chosen or tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the checkpoint folder: the plans that read it neither repeat its work nor depend on an executor's disk.

    It is kept as Parquet: columns are packed, plans read those they need, and sizes are known to joins. A checkpoint would keep whole rows unpacked.
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df = df.select(*(F.col(f"`{f.name}`").cast("string").alias(f.name) if f.dataType.typeName() == "void" else F.col(f"`{f.name}`") for f in df.schema))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class LookAheadViolation(ValueError):
    """A read would reach past its knowledge cutoff."""


def known_as_of(df: DataFrame, cutoff: Column | str, times: tuple[str, ...] = ("available_at", "observed_at")) -> DataFrame:
    """Rows whose times are all at or before the cutoff, which may be a column (many runs at once)."""
    limit = F.lit(cutoff).cast("timestamp") if isinstance(cutoff, str) else cutoff
    for t in times:
        df = df.filter(F.col(t) <= limit)
    return df


def effective_on(df: DataFrame, day: Column, start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Rows in force on a day: start included, end excluded, no end is open."""
    return df.filter((F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) > day)))


def latest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which must be total for a repeatable result."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def newest_revisions(df: DataFrame, keys: list[str], order: list[Column], valid: Column, valid_first: bool = False) -> DataFrame:
    """The newest revision of each key, if valid. By default a rejected newest one hides older valid ones; ``valid_first`` filters before."""
    return latest_per(df.filter(valid), keys, order) if valid_first else latest_per(df, keys, order).filter(valid)


def bars_as_of(bars: DataFrame, cutoff: str, mode: str | None = None, valid_first: bool = False) -> DataFrame:
    """Daily bars as known at ``cutoff``: newest revision per instrument, session and mode, then only if valid."""
    known = known_as_of(bars, cutoff)
    if mode:
        known = known.filter(F.col("mode") == mode)
    order = [F.desc("available_at"), F.desc("observed_at"), F.asc("observation_key")]
    return newest_revisions(known, ["instrument_id", "session_date", "mode"], order, F.col("quality_state") == "VALID", valid_first)


def newest_vintage(df: DataFrame, keys: list[str], order: list[Column], out: str | None = None) -> DataFrame:
    """All rows that share the newest place of their key."""
    rank = out or "_dr"
    ranked = df.withColumn(rank, F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if out else ranked.filter("_dr = 1").drop("_dr")


#: Into how many ranges of time a key's rows are dealt once it has more than so many.
HOT_BUCKETS, HOT_ROWS = 64, 200_000


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], direction: str = "backward", strict: bool = False, buckets: int = HOT_BUCKETS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each left row with the nearest right row of its key at or before (``backward``) or at or after (``forward``) its time.

    One window over both sides, no range join. A key of more than ``hot_rows`` rows is cut at its times' approximate quantiles into ``buckets`` ranges; each
    is ordered by itself, and the last right row before it is carried in from a table with a row per range. The result is the same for any number.
    ``strict`` leaves out equal times. Of right rows with the same time the greatest values win backward, the least forward. Right rows
    without a time are never met, and left ones meet none.
    """
    backward = direction == "backward"
    payload = F.struct(F.col(right_time).alias(right_time), *(F.col(v) for v in values))
    a = left.withColumn("_t", F.col(left_time)).withColumn("_p", F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType)).withColumn("_right", F.lit(False))
    b = right.filter(F.col(right_time).isNotNull()).select(*by, F.col(right_time).alias("_t"), payload.alias("_p")).withColumn("_right", F.lit(True))
    both = a.unionByName(b, allowMissingColumns=True)
    range_of = F.size(F.filter("_cuts", lambda c: c < F.col("_t")))
    cuts = both.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_t", [i / buckets for i in range(1, buckets)], 20 * buckets).alias("_cuts")).filter(F.col("_n") > hot_rows).drop("_n")
    dealt = both.join(cuts, by, "left").withColumn("_b", F.when(F.col("_cuts").isNull() | F.col("_t").isNull(), 0).otherwise(range_of)).drop("_cuts")
    # A right row of equal time must stand before the left one, unless strict.
    first = F.col("_right").cast("int") if (strict == backward) else -F.col("_right").cast("int")
    order = [F.col("_t"), first, F.col("_p")] if backward else [F.col("_t").desc(), (-F.col("_right").cast("int") if not strict else F.col("_right").cast("int")), F.col("_p").desc()]
    near = F.last("_p", ignorenulls=True).over(Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    edge = (F.max if backward else F.min)(F.when(F.col("_right"), F.struct("_t", "_p")))
    onward = Window.partitionBy(*by).orderBy("_b" if backward else F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    edges = b.join(cuts, by).withColumn("_b", range_of).groupBy(*by, "_b").agg(edge.alias("_e"))
    grid = cuts.select(*by, F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_b")).join(edges, [*by, "_b"], "left")
    carried = grid.withColumn("_carried", F.last("_e._p", ignorenulls=True).over(onward)).select(*by, "_b", "_carried").filter(F.col("_carried").isNotNull())
    met = dealt.withColumn("_near", near).filter(~F.col("_right")).join(carried, [*by, "_b"], "left").withColumn("_n", F.when(F.col("_t").isNotNull(), F.coalesce("_near", "_carried")))
    return met.select(*left.columns, *(F.col(f"_n.{c}").alias(c) for c in [right_time, *values]))


def effective_join(left: DataFrame, dim: DataFrame, key: str, day: str, order: list[Column], bucket_days: int = 366) -> DataFrame:
    """Each left row with the dimension row of its key in force on its day, or nulls; of several, the first in ``order``. Left rows are unique by key and day.

    Both sides meet by key and range of ``bucket_days`` days: an interval is copied into each range that it covers, as far as left rows go, so a key's rows
    are pairs only within a range, whatever its history; ranges that are still large are split by Spark's skew join. An interval without a start or an end is open there.
    """
    number = lambda d: F.floor(F.unix_date(d) / bucket_days)
    span = left.agg(F.min(F.unix_date(F.col(day).cast("date"))).alias("_first"), F.max(F.unix_date(F.col(day).cast("date"))).alias("_last"))  # one row
    begin, end = (F.floor(F.col(c) / bucket_days) for c in ("_first", "_last"))
    covers = F.sequence(F.greatest(F.coalesce(number(F.col("effective_from").cast("date")), begin), begin), F.least(F.coalesce(number(F.date_sub(F.col("effective_to").cast("date"), 1)), end), end))
    starts = F.greatest(F.coalesce(number(F.col("effective_from").cast("date")), begin), begin) <= F.least(F.coalesce(number(F.date_sub(F.col("effective_to").cast("date"), 1)), end), end)
    spread = dim.join(span).filter(starts).withColumn("_range", F.explode(covers)).drop("_first", "_last")
    asked = left.withColumn("_range", number(F.col(day).cast("date")))
    on = [F.col("l._range") == F.col("r._range"), F.col(f"l.{key}") == F.col(f"r.{key}"), F.col("effective_from").isNull() | (F.col("effective_from") <= F.col(f"l.{day}")), F.col("effective_to").isNull() | (F.col("effective_to") > F.col(f"l.{day}"))]
    met = asked.alias("l").join(spread.alias("r"), on, "left").select(*(F.col(f"l.{c}") for c in left.columns), *(F.col(f"r.{c}") for c in dim.columns if c != key))
    return latest_per(met, [key, day], order)


def resolve_unique(df: DataFrame, name: str, key: str) -> DataFrame:
    """Name to key, null where a name stands for several keys."""
    return df.groupBy(name).agg(F.when(F.count_distinct(key) == 1, F.first(key)).alias(key))


def superseded(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows that a later one of their key replaces."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn > 1").drop("_rn")


def session_ordinals(sessions: DataFrame, day: Column, n: int, known: Column) -> DataFrame:
    """The last ``n`` sessions up to a day that were known, numbered backwards from 1. Sessions are a calendar: one row a day."""
    seen = sessions.filter((F.col("session_date") <= day) & (F.col("available_at") <= known))
    return seen.withColumn("n", F.row_number().over(Window.orderBy(F.desc("session_date")))).filter(F.col("n") <= n)


def contiguous_suffix(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows after the last null of ``value`` in each key: the unbroken run that ends with the newest row."""
    gap = F.max(F.when(F.col(value).isNull(), F.col(order))).over(Window.partitionBy(key))
    return df.withColumn("_gap", gap).filter(F.col("_gap").isNull() | (F.col(order) > F.col("_gap"))).drop("_gap")


def scd2_intervals(changes: DataFrame, key: str, start: str, attributes: list[str]) -> DataFrame:
    """Intervals from dated changes: a change that alters nothing is no row; each ends where the next begins."""
    w = Window.partitionBy(key).orderBy(start)
    state = F.struct(*attributes)
    kept = changes.withColumn("_s", state).withColumn("_before", F.lag("_s").over(w)).filter(~F.col("_s").eqNullSafe(F.col("_before"))).drop("_s", "_before")
    return kept.withColumn("effective_to", F.lead(start).over(w))


def guard_range(end: str, as_of: str) -> None:
    """Raise when a range ends after its cutoff."""
    if end > as_of:
        raise LookAheadViolation(f"{end} is after {as_of}")


def range_scan(df: DataFrame, time: str, start: str, end: str, as_of: str) -> DataFrame:
    """Rows of a time range, which must not reach past the cutoff; the range is pushed to the scan."""
    guard_range(end, as_of)
    return df.filter(F.col(time).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def superseding_symbols(symbols: DataFrame) -> DataFrame:
    """Successions: a symbol that ends on the day another of the same key begins."""
    a, b = symbols.alias("a"), symbols.alias("b")
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.effective_to") == F.col("b.effective_from")) & (F.col("a.symbol") != F.col("b.symbol")))


def origins(links: DataFrame, ident: str, parent: str) -> DataFrame:
    """(``ident``, origin) of rows that name the row they were made from: the end of each chain, itself where there is no parent. Every round doubles the step, so a chain of n needs log n joins; a ring is an error."""
    at = settle(links.select(ident, F.coalesce(parent, ident).alias("origin")))
    for _ in range(64):
        up = at.select(F.col(ident).alias("origin"), F.col("origin").alias("_up"))
        nxt = settle(at.join(up, "origin", "left").select(ident, F.coalesce("_up", "origin").alias("origin"), (F.col("_up") != F.col("origin")).alias("_moved")))
        at = nxt.select(ident, "origin")
        if nxt.filter("_moved").isEmpty():
            return at
    raise ValueError("artifacts name each other in a ring")
