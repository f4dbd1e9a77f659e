"""Publication of runs: result tables, guards and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalars import framed_hash
from tidemark.operators.calendar import next_sessions


def result_scores(scored: DataFrame, run: Column) -> DataFrame:
    """Score rows of a run at six digits, ties to even."""
    return scored.select(run.alias("run_id"), "instrument_id", "rank", *(F.bround(F.col(c).cast("decimal(38,12)"), 6).cast("double").alias(c) for c in ("composite", "percentile")))


def run_identity(requests: DataFrame, *fields: str) -> DataFrame:
    """Requests with their logical id, and the one before of the same policy that they supersede."""
    keyed = requests.withColumn("run_key", framed_hash(*(F.col(f) for f in fields)))
    return keyed.withColumn("supersedes", F.lag("run_key").over(Window.partitionBy("policy").orderBy("as_of", "run_key")))


def guard(scores: DataFrame, exclusions: DataFrame, universe: DataFrame, run: list[str]) -> DataFrame:
    """Violations of every run: a run may be published only when all are 0. One aggregate over the three tables.

    Scored and excluded instruments are exactly the universe, none is both, ranks go from 1 without gaps, and excluded ones have a reason.
    """
    flag = lambda df, s, x, u, reason, rank: df.select(*run, "instrument_id", F.lit(s).alias("s"), F.lit(x).alias("x"), F.lit(u).alias("u"), reason.alias("no_reason"), rank.cast("long").alias("rank"))
    none, no = F.lit(None), F.lit(False)
    rows = flag(scores, True, False, False, no, F.col("rank")).unionByName(flag(exclusions, False, True, False, F.col("reason").isNull(), none)).unionByName(flag(universe, False, False, True, no, none))
    each = rows.groupBy(*run, "instrument_id").agg(*(F.bool_or(c).alias(c) for c in ("s", "x", "u", "no_reason")), F.max("rank").alias("rank"))
    n = F.count("rank")
    gap = F.when((n == 0) | ((F.min("rank") == 1) & (F.max("rank") == n) & (F.count_distinct("rank") == n)), 0).otherwise(1).cast("long")
    return each.groupBy(*run).agg(F.count_if(~F.col("s") & ~F.col("x")).alias("missing"), F.count_if(~F.col("u")).alias("unexpected"), F.count_if(F.col("s") & F.col("x")).alias("both"), F.count_if("no_reason").alias("no_reason"), gap.alias("rank_gap"))


def timing_guard(runs: DataFrame, sessions: DataFrame) -> DataFrame:
    """``state`` of each run (run_id, decided_at, published_at): published before the next session opens, a day after the decision at the earliest, on a calendar that was known when it was decided."""
    upcoming = next_sessions(sessions.select("session_date", "available_at")).select("day", F.col("next_session").alias("_next"), F.col("available_at").alias("_known"))
    met = runs.withColumn("day", F.to_date("decided_at")).join(upcoming, "day", "left")
    late = F.col("published_at") >= F.col("_next").cast("timestamp")
    state = F.when(F.col("_next").isNull() | (F.col("_known") > F.col("decided_at")), "CALENDAR_UNKNOWN").when(F.col("published_at") < F.col("decided_at") + F.expr("INTERVAL '1' DAY"), "EARLY").when(late, "LATE").otherwise("OK")
    return met.withColumn("state", state)


def late_lineage(lineage: DataFrame, bars: DataFrame, cutoff: str) -> DataFrame:
    """Used bars that weren't known at the cutoff."""
    return lineage.join(bars.filter(F.col("available_at") > F.lit(cutoff).cast("timestamp")), "observation_key", "left_semi")


def source_retention(scores: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Scored instruments with how many sources are kept; 0 is a gap."""
    held = artifacts.groupBy("instrument_id").agg(F.count_distinct("observation_key").alias("_n"))
    return scores.join(held, "instrument_id", "left").select("instrument_id", F.coalesce("_n", F.lit(0)).alias("sources"))


def sector_breakdown(norm: DataFrame) -> DataFrame:
    """Per sector and metric: rows with a value, by kind of cohort, and the smallest cohort used."""
    return norm.groupBy("sector", "metric").agg(F.count("value").alias("available"), F.count_if(F.col("cohort") == "PEER").alias("peer"), F.count_if(F.col("cohort") == "FALLBACK").alias("fallback"), F.count_if(F.col("value").isNotNull() & F.col("cohort").isNull()).alias("no_cohort"), F.min("cohort_n").alias("smallest"))


def cohort_audit(norm: DataFrame, stored: DataFrame) -> DataFrame:
    """Cohorts whose stored size differs from a recomputed one."""
    fresh = norm.filter("cohort = 'PEER'").groupBy("sector", "metric").agg(F.max("cohort_n").alias("recomputed"))
    return stored.join(fresh, ["sector", "metric"], "full").filter(~F.col("stored").eqNullSafe(F.col("recomputed")))


def diagnose(expected: DataFrame, known: DataFrame, ever: DataFrame, keys: list[str]) -> DataFrame:
    """Why an expected input is missing: known after the cutoff, or never seen."""
    lost = expected.join(known, keys, "left_anti")
    seen = ever.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return lost.join(seen, keys, "left").select(*keys, F.when(F.col("_seen"), "NOT_YET_KNOWN").otherwise("NEVER_REPORTED").alias("cause"))
