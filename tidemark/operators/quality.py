"""Ingestion quality: progress, gauges, alerts, coverage, gaps and triage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_progress(items: DataFrame, most_failed: int) -> DataFrame:
    """Done and failed items of each run, and its state."""
    c = items.groupBy("run").agg(F.count_if(F.col("status") == "F").alias("done"), F.count_if(F.col("status") == "P").alias("failed"), F.count("*").alias("_n"))
    return c.withColumn("state", F.when(F.col("failed") > most_failed, "FAILED").when(F.col("done") == F.col("_n"), "COMPLETE").otherwise("RUNNING")).drop("_n")


def gauges(items: DataFrame, events: DataFrame, now: str) -> DataFrame:
    """Named values: pending items, error events, age of the oldest pending item. One aggregate per table."""
    open_ = F.col("o_orderstatus") == "O"
    a = items.agg(F.count_if(open_).cast("double").alias("pending"), F.datediff(F.lit(now).cast("date"), F.min(F.when(open_, F.col("o_orderdate").cast("date")))).cast("double").alias("oldest_days"))
    b = events.agg(F.count_if(F.col("event_type") == "error").cast("double").alias("errors"))
    return a.unpivot([], ["pending", "oldest_days"], "name", "value").unionByName(b.unpivot([], ["errors"], "name", "value"))


def alerts(values: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Gauges over their limits."""
    limit = F.coalesce(*(F.when(F.col("name") == k, F.lit(x)) for k, x in limits.items()))
    return values.filter(F.col("value") > limit)


def page_conflicts(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Keys that several pages give different payloads for."""
    return rows.groupBy(*keys).agg(F.count_distinct(payload).alias("versions")).filter("versions > 1")


def missing(expected: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys without a row."""
    return expected.select(*keys).distinct().join(have.select(*keys), keys, "left_anti")


def first_deliveries(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first delivery of each key, and how often it was delivered again. Counts are joined, so a key redelivered without end is no large group."""
    first = F.min_by(F.struct(*[c for c in events.columns if c != key]), F.struct(*order))
    return events.groupBy(key).agg(first.alias("_f"), (F.count("*") - 1).alias("redeliveries")).select(key, "_f.*", "redeliveries")


def identity_conflicts(events: DataFrame, ident: str, content: str) -> DataFrame:
    """Identities that came with several contents."""
    return events.groupBy(ident).agg(F.min(content).alias("_a"), F.max(content).alias("_b")).filter("_a <> _b").select(ident)


def complete_items(items: DataFrame, events: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """Items all of whose events are accepted and that have no open issue."""
    return items.join(events.filter("NOT accepted"), key, "left_anti").join(issues, key, "left_anti").join(events, key, "left_semi")


def readiness(progress: DataFrame) -> DataFrame:
    """FAILED, DEGRADED, SYNCING or READY of each run from its counts."""
    state = F.when(F.col("failed") > F.col("done"), "FAILED").when(F.col("failed") > 0, "DEGRADED").when(F.col("pending") > 0, "SYNCING").otherwise("READY")
    return progress.withColumn("readiness", state)


def admissible(reviews: DataFrame, allocated: DataFrame, key: str) -> DataFrame:
    """Reviews whose target isn't allocated elsewhere."""
    return reviews.join(allocated, key, "left_anti")


def record_reviews(existing: DataFrame, incoming: DataFrame, ident: str, content: str) -> DataFrame:
    """Outcome of recording each review: RECORDED, REPEATED, or CONFLICT when the id holds other content."""
    met = incoming.join(existing.select(ident, F.col(content).alias("_held")), ident, "left")
    return met.withColumn("outcome", F.when(F.col("_held").isNull(), "RECORDED").when(F.col("_held") == F.col(content), "REPEATED").otherwise("CONFLICT")).drop("_held")


def triage(reasons: DataFrame, key: str) -> DataFrame:
    """Next action of each row from its reason codes: the first rule that applies."""
    has = lambda c: F.count_if(F.startswith("code", F.lit(c))) > 0
    action = F.when(has("1-"), "REVIEW").when(has("2-"), "COLLECT").when(has("5-"), "WAIT").otherwise("NONE")
    return reasons.groupBy(key).agg(action.alias("action"))


def coverage_rows(items: DataFrame, issues: DataFrame) -> DataFrame:
    """A coverage row (run, day, valid) of every complete single-day run; withdrawn (not valid) while the run has a blocking issue."""
    whole = items.groupBy("run").agg(F.min("day").alias("day"), F.max("day").alias("_last"), F.bool_and("complete").alias("_all")).filter("day = _last AND _all")
    blocked = issues.select("run").distinct().withColumn("_blocked", F.lit(True))
    return whole.join(blocked, "run", "left").select("run", "day", F.col("_blocked").isNull().alias("valid"))
