"""Cross-sectional scores: standardised values, ranks and percentiles per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.calendar import run_ordinals
from tidemark.operators.temporal import bars_as_of, session_ordinals, settle


def zscore(df: DataFrame, value: str, by: list[str], out: str = "z") -> DataFrame:
    """Population z-score within ``by``; no spread gives 0, null stays null. Moments are aggregated, then joined back, so no task sorts a whole group."""
    moments = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    joined = df.join(F.broadcast(moments), by) if by else df.join(F.broadcast(moments))
    z = F.when(F.col(value).isNull(), None).when(F.col("_s") == 0, 0.0).otherwise((F.col(value) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)))
    return joined.withColumn(out, z).drop("_m", "_s")


def ordinal_rank(df: DataFrame, by: list[str], value: str = "composite", ident: str = "instrument_id", buckets: int = 1) -> DataFrame:
    """Rank from 1 by falling value, ties by rising id, nulls last.

    ``buckets`` over 1: each group is cut at its approximate quantiles first, ranks start where the buckets above end, and only within
    a bucket is there a sort, so a group (even all rows: no ``by``) is no single task. The ranks are the same for any number.
    """
    order = [F.col(value).desc_nulls_last(), ident]
    if buckets < 2:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    cuts = df.groupBy(*by).agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 1000).alias("_cuts"))
    met = (df.join(cuts, by) if by else df.join(F.broadcast(cuts))).withColumn("_b", F.when(F.col(value).isNull(), buckets).otherwise(F.size(F.filter("_cuts", lambda c: c > F.col(value)))))
    above = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = met.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(above), F.lit(0)))  # a row per bucket
    placed = met.join(starts.select(*by, "_b", "_start"), [*by, "_b"])
    return placed.withColumn("rank", (F.col("_start") + F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order))).cast("int")).drop("_b", "_cuts", "_start")


def tie_percentile(df: DataFrame, by: list[str], value: str = "composite", ident: str = "instrument_id", buckets: int = 1) -> DataFrame:
    """``rank`` and ``percentile`` 100 (n - mean rank of equals) / (n - 1); null for a single row. Group sizes are aggregated and joined."""
    ranked = ordinal_rank(df, by, value, ident, buckets)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    met = ranked.withColumn("_mean", F.avg("rank").over(Window.partitionBy(*by, value)))
    met = met.join(sizes, by) if by else met.join(F.broadcast(sizes))
    return met.withColumn("percentile", F.when(F.col("_n") > 1, 100.0 * (F.col("_n") - F.col("_mean")) / (F.col("_n") - 1))).drop("_mean", "_n")


def average_rank(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Ascending rank in which equals share the mean of their places."""
    w = Window.partitionBy(*by).orderBy(value)
    return df.withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0))


def price_features(bars: DataFrame, ordinals: DataFrame, latest: int = 2, reference: int = 13, history: int = 12) -> DataFrame:
    """Closes at chosen session ordinals, history count and median traded value, in one aggregate per instrument."""
    n = F.col("n")
    met = bars.join(F.broadcast(ordinals.select("session_date", "n")), "session_date")
    return met.groupBy("instrument_id").agg(
        F.max(F.when(n == 1, F.col("close"))).alias("last_close"),
        F.max(F.when(n == latest, F.col("close"))).alias("latest_close"),
        F.max(F.when(n == reference, F.col("close"))).alias("reference_close"),
        F.count_if(n <= history).alias("history"),
        F.percentile(F.when(n <= 20, F.col("close") * F.col("volume")), F.lit(0.5)).alias("median_value"),
    )


def momentum_zscores(bars: DataFrame, sessions: DataFrame, cutoff: str, day: str) -> DataFrame:
    """Momentum of every instrument as known at ``cutoff``, standardised over all."""
    ordinals = session_ordinals(sessions, F.lit(day).cast("date"), 1 << 30, F.lit(cutoff).cast("timestamp"))
    features = settle(price_features(bars_as_of(bars, cutoff, "RAW"), ordinals).filter("latest_close IS NOT NULL AND reference_close IS NOT NULL"))  # a row per instrument, which moments, cuts and ranks read
    return zscore(features.withColumn("momentum", F.col("latest_close") / F.col("reference_close") - 1), "momentum", [])


def momentum_ranking(bars: DataFrame, sessions: DataFrame, cutoff: str, day: str) -> DataFrame:
    """All instruments ranked by momentum as known at a cutoff."""
    return tie_percentile(momentum_zscores(bars, sessions, cutoff, day), [], "momentum", buckets=64)


def momentum_runs(bars: DataFrame, sessions: DataFrame, requests: DataFrame, latest: int = 2, reference: int = 13) -> DataFrame:
    """Momentum rankings of many runs (run_id, day, cutoff: a small table) in one job.

    Bars of the sessions that some run needs are shuffled once, into an array of revisions per instrument and session, newest first;
    each run then takes the first revision that it knew from that array, where the session stands in the run's calendar (a small table).
    """
    ordinals = run_ordinals(requests, sessions, reference).filter(F.col("n").isin(latest, reference)).select("run_id", "cutoff", "session_date", "n")
    needed = bars.filter("mode = 'RAW'").join(F.broadcast(ordinals.select("session_date").distinct()), "session_date", "left_semi")
    newest_first = F.struct((-F.unix_micros("available_at")).alias("a"), (-F.unix_micros("observed_at")).alias("o"), "observation_key", "available_at", "observed_at", "close", (F.col("quality_state") == "VALID").alias("valid"))
    revisions = needed.groupBy("instrument_id", "session_date").agg(F.array_sort(F.collect_list(newest_first)).alias("_r"))  # of one bar: few
    met = revisions.join(F.broadcast(ordinals), "session_date")
    seen = F.filter("_r", lambda r: (r["available_at"] <= F.col("cutoff")) & (r["observed_at"] <= F.col("cutoff")))
    picked = met.select("run_id", "instrument_id", "n", F.get(seen, F.lit(0)).alias("_p")).filter("_p.valid")
    at = lambda k: F.max(F.when(F.col("n") == k, F.col("_p.close")))
    wide = picked.groupBy("run_id", "instrument_id").agg((at(latest) / at(reference) - 1).alias("momentum")).filter("momentum IS NOT NULL")
    return tie_percentile(wide, ["run_id"], "momentum")
