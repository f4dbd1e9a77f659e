"""Trading calendars and the run requests made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.temporal import asof_join


def day_range(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Every day from first to last."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))


def build_calendar(open_days: DataFrame, exchanges: DataFrame, first: str, last: str) -> DataFrame:
    """A row for every day and exchange; days without a session are holidays."""
    grid = day_range(open_days.sparkSession, first, last).join(F.broadcast(exchanges))
    held = open_days.select("day", "exchange").distinct().withColumn("_open", F.lit(True))
    return grid.join(held, ["day", "exchange"], "left").select("day", "exchange", F.col("_open").isNull().alias("holiday"))


def due_month_ends(calendar: DataFrame) -> DataFrame:
    """The last open day of every month of which the calendar has each day."""
    month = F.trunc("day", "month")
    full = calendar.groupBy("exchange", month.alias("month")).agg(F.max(F.when(~F.col("holiday"), F.col("day"))).alias("month_end"), F.count_distinct("day").alias("_n"))
    return full.filter((F.col("_n") == F.dayofmonth(F.last_day("month"))) & F.col("month_end").isNotNull()).drop("_n")


def next_opening(calendar: DataFrame, days: DataFrame) -> DataFrame:
    """For each asked day the next open one; null if a calendar day between is missing. Two as-of joins per exchange, no pairs of days."""
    numbered = calendar.withColumn("_i", F.row_number().over(Window.partitionBy("exchange").orderBy("day")))
    opened = numbered.filter(~F.col("holiday")).select("exchange", F.col("day").alias("opening"), F.col("_i").alias("_open"))
    passed = numbered.select("exchange", F.col("day").alias("_d"), F.col("_i").alias("_past"))
    met = asof_join(days.select("exchange", "day").distinct(), opened, ["exchange"], "day", "opening", ["_open"], "forward", strict=True)
    met = asof_join(met, passed, ["exchange"], "day", "_d", ["_past"])
    whole = F.col("_open") - F.coalesce("_past", F.lit(0)) == F.datediff("opening", "day")
    return met.select("exchange", "day", F.when(whole, F.col("opening")).alias("opening"))


def sessions_around(calendar: DataFrame, days: DataFrame) -> DataFrame:
    """For each asked day the latest open day before it and the first from it on: an as-of join each way."""
    opened = calendar.filter(~F.col("holiday")).select("exchange", F.col("day").alias("completed"))
    met = asof_join(days.select("exchange", "day").distinct(), opened, ["exchange"], "day", "completed", [], strict=True)
    return asof_join(met, opened.withColumnRenamed("completed", "upcoming"), ["exchange"], "day", "upcoming", [], "forward").select("exchange", "day", "completed", "upcoming")


def next_sessions(sessions: DataFrame, before: int = 366) -> DataFrame:
    """(day, next_session and the session's other columns) for every day up to the last session, from ``before`` days ahead of the first: what a date meets by equality. Sessions are a calendar."""
    start = F.coalesce(F.lag("session_date").over(Window.orderBy("session_date")), F.date_sub("session_date", before))
    each = sessions.withColumn("_from", start).withColumn("day", F.explode(F.sequence("_from", F.date_sub("session_date", 1))))
    return each.drop("_from").withColumnRenamed("session_date", "next_session")


def complete_through(coverage: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """Per key the last day before the first gap of its coverage, from ``first``; null if that day is a gap itself."""
    grid = coverage.select(key).distinct().join(F.broadcast(day_range(coverage.sparkSession, first, last)))
    have = coverage.select(key, "day").distinct().withColumn("_have", F.lit(True))
    gap = F.min(F.when(F.col("_have").isNull(), F.col("day")))
    return grid.join(have, [key, "day"], "left").groupBy(key).agg(F.coalesce(F.date_sub(gap, 1), F.lit(last).cast("date")).alias("_t")).select(key, F.when(F.col("_t") >= F.lit(first).cast("date"), F.col("_t")).alias("complete_through"))


def refresh_plan(items: DataFrame, today: str, n: int, day: str = "day") -> DataFrame:
    """Items with the date of their refresh: today's for the last ``n`` days, none for older ones."""
    now = F.lit(today).cast("date")
    return items.withColumn("refresh_on", F.when(F.datediff(now, day).between(0, n), now))


def run_ordinals(requests: DataFrame, sessions: DataFrame, n: int) -> DataFrame:
    """The last ``n`` sessions of every request (run_id, day), numbered backwards from 1: many runs at once. Requests and sessions are small tables."""
    met = requests.join(F.broadcast(sessions.select("session_date")), F.col("session_date") <= F.col("day"))
    return met.withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("session_date")))).filter(F.col("n") <= n)
