"""Audits and reports over runs, reasons and evidence, and the risk gates of special profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import reasons
from tidemark.operators.calendar import next_sessions


def soft_reasons(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Whether a reason only limits a row under each model version. ``rules``: version, exact code, prefix (empty: none); a small table."""
    met = rows.join(F.broadcast(rules))
    prefix = (F.col("prefix") != "") & F.startswith("code", "prefix")
    return met.withColumn("soft", (F.col("code") == F.col("exact")) | prefix)


def performance(df: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean and sample deviation per view."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def compare_runs(tables: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Per table of two runs: row counts, and rows that either holds more often."""
    out = []
    for name, (a, b) in tables.items():
        both = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
        rows = both.groupBy(*a.columns).agg(F.sum("_n").alias("_d"), F.count_if(F.col("_n") == 1).alias("_a"), F.count_if(F.col("_n") == -1).alias("_b"))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        out.append(rows.agg(F.lit(name).alias("table_name"), total("_a").alias("reference_rows"), total("_b").alias("candidate_rows"), total(F.greatest("_d", F.lit(0))).alias("only_reference"), total(F.greatest(-F.col("_d"), F.lit(0))).alias("only_candidate")))
    return reduce(lambda a, b: a.unionByName(b), out)


def compare_publications(before: DataFrame, after: DataFrame, key: str = "instrument_id") -> DataFrame:
    """Per instrument: recovered, lost or same, and how far its composite moved."""
    a, b = (d.select(key, F.col("composite").alias(f"c{i}"), F.col("eligible").alias(f"e{i}")) for i, d in ((0, before), (1, after)))
    was, now = F.coalesce("e0", F.lit(False)), F.coalesce("e1", F.lit(False))
    return a.join(b, key, "full").select(key, F.when(was & ~now, "LOST").when(~was & now, "RECOVERED").otherwise("SAME").alias("change"), (F.col("c1") - F.col("c0")).alias("moved"))


def audit_export(export: DataFrame, publication: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Issues of an export: rows missing, unexpected, or different in a field."""
    x, p = (d.select(key, F.struct(*fields).alias(n), F.lit(True).alias(f"_{n}")) for d, n in ((export, "x"), (publication, "p")))
    issue = F.when(F.col("_x").isNull(), "MISSING").when(F.col("_p").isNull(), "UNEXPECTED").when(~F.col("x").eqNullSafe(F.col("p")), "DIFFERENT")
    return x.join(p, key, "full").select(issue.alias("issue"), key).filter("issue IS NOT NULL")


def mapping_versions(base: DataFrame) -> DataFrame:
    """Concept mappings of version 1, and of version 2: the same and the reconciliation concept."""
    extra = base.sparkSession.sql("SELECT 2 AS version, 'RECONCILED' AS concept, 'COMMON_EQUITY' AS metric")
    return base.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2)))).select("version", "concept", "metric").unionByName(extra)


def coverage_gate(items: DataFrame, modes: int) -> DataFrame:
    """Runs that have all modes, and whether every item has evidence."""
    return items.groupBy("run").agg(F.bool_and(F.col("evidence").isNotNull()).alias("covered"), F.count_distinct("mode").alias("modes")).filter(F.col("modes") >= modes)


def gate(value: Column, exclude: float, warn: float, broken: str, low: str) -> Column:
    """``broken`` under the excluding bound, ``low`` under the warning one."""
    return F.when(value < exclude, broken).when(value < warn, low)


def stability(quarters: DataFrame, least: int) -> DataFrame:
    """Deviation of quarterly values over their mean, for issuers with enough quarters."""
    return quarters.groupBy("issuer_id").agg(F.count("*").alias("quarters"), (F.stddev_pop("value") / F.nullif(F.avg("value"), F.lit(0.0))).alias("stability")).filter(F.col("quarters") >= least)


def metric_coverage(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """How many metrics a row has, and a reason for each that is missing."""
    have = reduce(lambda a, b: a + b, (F.col(m).isNotNull().cast("long") for m in metrics))
    return wide.select(*keys, have.alias("have"), reasons(*((F.col(m).isNull(), f"MISSING_{m.upper()}") for m in metrics)).alias("reasons"))


def reset(rows: DataFrame) -> DataFrame:
    """Rows under a flexible model: hard flags exclude, others only limit."""
    return rows.withColumn("outcome", F.when(F.col("flagged") & F.col("hard"), "EXCLUDED").when(F.col("flagged"), "LIMITED").otherwise("KEPT"))


def tag_states(facts: DataFrame, keys: list[str], cutoff: str, current: str) -> DataFrame:
    """Whether a tag is in use at a cutoff: filed since ``current``, before only, or never."""
    known = F.col("available_at") <= F.lit(cutoff).cast("timestamp")
    newest = F.max(F.when(known, F.col("filed_date")))
    return facts.groupBy(*keys).agg(F.when(newest >= F.lit(current).cast("date"), "CURRENT").when(F.count_if(known) > 0, "NOT_CURRENT").otherwise("ABSENT").alias("state"))


def with_formula(metrics: DataFrame, formulas: DataFrame) -> DataFrame:
    """Metric rows with the formula of their profile, else the shared one. Formulas are a small dictionary."""
    own = formulas.select("profile", "metric", F.col("formula").alias("_own"))
    shared = formulas.filter("profile = 'SHARED'").select("metric", F.col("formula").alias("_shared"))
    return metrics.join(F.broadcast(own), ["profile", "metric"], "left").join(F.broadcast(shared), "metric", "left").select("profile", "metric", F.coalesce("_own", "_shared").alias("formula"))


def gates(summary: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Gate checks of a one-row summary, as rows."""
    rows = F.array(*(F.struct(F.lit(n).alias("gate"), c.alias("passed")) for n, c in rules.items()))
    return summary.select(F.explode(rows).alias("g")).select("g.*")


def active(series: DataFrame, a: str, b: str) -> DataFrame:
    """Mean difference of two return series and its information ratio."""
    d = series.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_d", F.col(a) - F.col(b))
    return d.agg(F.count("*").alias("n"), F.avg("_d").alias("active"), (F.avg("_d") / F.nullif(F.stddev_samp("_d"), F.lit(0.0))).alias("information_ratio"))


def next_bar(signals: DataFrame, sessions: DataFrame) -> DataFrame:
    """The first session strictly after each signal's date, met by equality on the day."""
    days = next_sessions(sessions.select("session_date")).select(F.col("day").alias("as_of"), F.col("next_session").alias("executes"))
    return signals.join(days, "as_of", "left")


def fan_out(events: DataFrame, kind: str, targets: list[str]) -> dict[str, DataFrame]:
    """One frame per target table."""
    return {t: events.filter(F.col(kind) == t) for t in targets}
