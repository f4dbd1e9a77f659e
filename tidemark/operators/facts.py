"""Fundamental facts: revision choice, period assembly and canonical quality states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.temporal import known_as_of, newest_vintage

PERIOD = ["issuer_id", "metric", "period_start", "period_end"]
#: Days from first to last, both counted, of a year, a quarter and a year to date (fixed values).
YEAR, QUARTER, TO_DATE = (350, 380), (70, 110), (70, 349)


def newest_facts(facts: DataFrame) -> DataFrame:
    """Rows of the newest filing date of each period; several may share it."""
    return newest_vintage(facts, PERIOD, [F.desc("filed_date")])


def preferred(facts: DataFrame) -> DataFrame:
    """Rows whose source priority is the best of their period."""
    return facts.withColumn("_b", F.min("priority").over(Window.partitionBy(*PERIOD))).filter("priority = _b").drop("_b")


def unambiguous(facts: DataFrame) -> DataFrame:
    """One row per period whose rows agree in value and are all valid; other periods go."""
    agreed = facts.groupBy(*PERIOD).agg(F.min("value").alias("value"), F.max("value").alias("_top"), F.bool_and(F.col("quality_state") == "VALID").alias("_ok"), F.max("filed_date").alias("filed_date"))
    return agreed.filter("value = _top AND _ok").drop("_top", "_ok")


def facts_as_of(facts: DataFrame, cutoff: str) -> DataFrame:
    """Facts as known at a cutoff: newest revision, then best source, then agreement and validity."""
    return unambiguous(preferred(newest_facts(known_as_of(facts, cutoff, ("available_at",)))))


def days(start: str = "period_start", end: str = "period_end") -> Column:
    """Length of a period, both ends counted."""
    return F.datediff(end, start) + 1


def quarter_chain(quarters: DataFrame, n: int) -> DataFrame:
    """Sums over ``n`` quarters in a row: each ends the day before the next starts."""
    parts = [quarters.select("issuer_id", F.col("period_start").alias(f"s{i}"), F.col("period_end").alias(f"e{i}"), F.col("value").alias(f"v{i}")) for i in range(n)]
    chain = parts[0]
    for i in range(1, n):
        step = parts[i].withColumnRenamed("issuer_id", "_i").withColumn("_next", F.date_add(f"e{i}", 1))
        chain = chain.join(step, (F.col("issuer_id") == F.col("_i")) & (F.col(f"s{i - 1}") == F.col("_next"))).drop("_i", "_next")
    total = reduce(lambda a, b: a + b, (F.col(f"v{i}") for i in range(n)))
    return chain.select("issuer_id", F.col("e0").alias("period_end"), F.col(f"s{n - 1}").alias("period_start"), total.alias("total"))


def trailing_year(facts: DataFrame, by: list[str]) -> DataFrame:
    """Trailing-twelve-month value of each (``by``, period_end), with its method.

    ``facts``: by columns, period_start, period_end, value; unique per period. One year-long fact is taken as it is; more than one ends
    the search with no value. Else four quarters in a row that span a year; else last year plus this year to date minus the same
    stretch of last year, if exactly one such combination exists.
    """
    f = facts.filter("period_start IS NOT NULL").withColumn("_d", days())
    ends = f.select(*by, "period_end").distinct()
    annual = f.filter(F.col("_d").between(*YEAR))
    direct = annual.groupBy(*by, "period_end").agg(F.count("*").alias("n_annual"), F.min("value").alias("v_annual"))
    q = [f.filter(F.col("_d").between(*QUARTER)).select(*by, F.col("period_start").alias(f"s{i}"), F.col("period_end").alias(f"e{i}"), F.col("value").alias(f"v{i}")) for i in range(4)]
    chain = q[0]
    for i in range(1, 4):
        chain = chain.join(q[i].withColumn(f"s{i - 1}", F.date_add(f"e{i}", 1)), [*by, f"s{i - 1}"])
    four = chain.filter((F.datediff("e0", "s3") + 1).between(*YEAR)).groupBy(*by, F.col("e0").alias("period_end")).agg(F.count("*").alias("n_quarters"), F.min(F.col("v0") + F.col("v1") + F.col("v2") + F.col("v3")).alias("v_quarters"))
    now = f.filter(F.col("_d").between(*TO_DATE)).select(*by, "period_end", F.col("period_start").alias("s"), F.col("value").alias("v"), F.col("_d").alias("d"))
    last = annual.select(*by, F.date_add("period_end", 1).alias("s"), F.col("period_start").alias("ls"), F.col("value").alias("lv"))
    past = f.filter(F.col("_d").between(*TO_DATE)).select(*by, F.col("period_start").alias("ls"), F.col("value").alias("pv"), F.col("_d").alias("pd"), F.col("period_end").alias("pe"))
    three = now.join(last, [*by, "s"]).join(past, [*by, "ls"]).filter((F.abs(F.col("d") - F.col("pd")) <= 7) & F.datediff("period_end", "pe").between(*YEAR))
    rolled = three.groupBy(*by, "period_end").agg(F.count("*").alias("n_rolled"), F.min(F.col("v") + F.col("lv") - F.col("pv")).alias("v_rolled"))
    out = reduce(lambda a, b: a.join(b, [*by, "period_end"], "left"), (direct, four, rolled), ends)
    none = F.col("n_annual").isNull()
    method = F.when(F.col("n_annual") == 1, "ANNUAL").when(none & (F.col("n_quarters") == 1), "QUARTERS").when(none & F.coalesce(F.col("n_quarters") != 1, F.lit(True)) & (F.col("n_rolled") == 1), "ROLLED")
    value = F.when(F.col("method") == "ANNUAL", F.col("v_annual")).when(F.col("method") == "QUARTERS", F.col("v_quarters")).when(F.col("method") == "ROLLED", F.col("v_rolled"))
    return out.withColumn("method", method).select(*by, "period_end", "method", value.alias("value"))


def balances(facts: DataFrame, anchor: str = "TOTAL_ASSETS") -> DataFrame:
    """Instant values at the issuer's latest date of ``anchor``; a metric with more than one value there has none."""
    instants = facts.filter("period_start IS NULL")
    at = instants.filter(F.col("metric") == anchor).groupBy("issuer_id").agg(F.max("period_end").alias("period_end"))
    return instants.join(at, ["issuer_id", "period_end"]).groupBy("issuer_id", "period_end", "metric").agg(F.when(F.count("*") == 1, F.min("value")).alias("value"))


def prior_balances(facts: DataFrame, anchor: str = "TOTAL_ASSETS") -> DataFrame:
    """The instant value a year before the issuer's latest one, if exactly one date lies there."""
    instants = facts.filter(F.col("period_start").isNull() & (F.col("metric") == anchor)).select("issuer_id", "period_end", "value")
    at = instants.groupBy("issuer_id").agg(F.max("period_end").alias("latest"))
    back = instants.join(at, "issuer_id").filter(F.datediff("latest", "period_end").between(*YEAR))
    return back.groupBy("issuer_id", "latest").agg(F.when(F.count_distinct("period_end") == 1, F.min("value")).alias("value"))


def last_annual(facts: DataFrame, metric: str, n: int = 3) -> DataFrame:
    """The values of the last ``n`` distinct period ends of a metric, numbered from the newest."""
    mine = facts.filter(F.col("metric") == metric)
    return mine.withColumn("back", F.dense_rank().over(Window.partitionBy("issuer_id").orderBy(F.desc("period_end")))).filter(F.col("back") <= n)


def quality_state(period_ok: Column, mapped: Column, unit_ok: Column, plain: Column, shape_ok: Column, sign_ok: Column) -> Column:
    """The first rule that a fact breaks, in this order, or VALID."""
    rules = (("INVALID_PERIOD", period_ok), ("UNMAPPED", mapped), ("INVALID_UNIT", unit_ok), ("UNSUPPORTED_DIMENSIONS", plain), ("INVALID_PERIOD", shape_ok), ("INVALID_SIGN", sign_ok))
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules), F.lit("VALID"))


def source_priority(facts: DataFrame, mappings: DataFrame, concept: str) -> DataFrame:
    """Facts with metric, priority (999 if unmapped) and multiplied value of a concept mapping; the raw value stays."""
    met = facts.join(F.broadcast(mappings), concept, "left")
    return met.withColumn("priority", F.coalesce("priority", F.lit(999))).withColumn("canonical_value", F.col("value") * F.coalesce("multiplier", F.lit(1.0)))


def mapped(rows: DataFrame, mappings: DataFrame, day: str, concept: str = "concept") -> DataFrame:
    """Rows with the metric of their concept under every version (version, concept, metric, valid_from, valid_to: end excluded, none is open) in force on ``day``."""
    m = mappings.withColumnRenamed("concept", "_concept")
    in_force = (F.col(concept) == F.col("_concept")) & (F.col(day) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(day) < F.col("valid_to")))
    return rows.join(m, in_force).drop("_concept", "valid_from", "valid_to")


def regulatory_facts(rows: DataFrame, links: DataFrame, mapping: DataFrame) -> DataFrame:
    """Regulatory report items (entity, item, value, period_end) as facts: the issuer linked to the entity on that date, metric and quality.

    ``links``: entity, issuer_id, effective_from, effective_to, one in force at a time; ``mapping``: item, metric, positive.
    """
    l = links.withColumnRenamed("entity", "_entity")  # noqa: E741
    in_force = (F.col("entity") == F.col("_entity")) & (F.col("period_end") >= F.col("effective_from")) & (F.col("effective_to").isNull() | (F.col("period_end") < F.col("effective_to")))
    met = rows.join(l, in_force, "left").join(mapping, "item", "left")
    state = F.when(F.col("issuer_id").isNull(), "UNLINKED").when(F.col("metric").isNull(), "UNMAPPED").when(F.col("positive") & (F.col("value") <= 0), "INVALID_SIGN").otherwise("VALID")
    return met.withColumn("quality_state", state).drop("_entity", "effective_from", "effective_to", "positive")
