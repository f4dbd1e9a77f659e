"""Corporate actions and derived facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical_actions(actions: DataFrame, cash: str, split: str, review: list[str]) -> DataFrame:
    """Actions with their term by kind (cash amount, split ratio) and state; some kinds always need review, others must have a positive term."""
    kind, value = F.col("kind"), F.col("value")
    term = F.when(kind == cash, value).when(kind == split, 1 / F.nullif(value, F.lit(0.0)))
    state = F.when(kind.isin(*review), "REVIEW_REQUIRED").when(kind.isin(cash, split) & (value > 0), "VALID").otherwise("MALFORMED")
    return actions.select("event_id", "kind", term.alias("term"), state.alias("state"))


def link_shares(facts: DataFrame, instruments: DataFrame) -> DataFrame:
    """Issuer facts on the instrument, where the issuer has exactly one."""
    one = instruments.groupBy("issuer_id").agg(F.count("*").alias("_n"), F.min("instrument_id").alias("instrument_id")).filter("_n = 1").drop("_n")
    return facts.join(one, "issuer_id")


def difference(facts: DataFrame, whole: str, part: str) -> DataFrame:
    """whole - part per issuer and period end, where both are known."""
    both = facts.filter(F.col("metric").isin(whole, part)).groupBy("issuer_id", "period_end").agg(F.max(F.when(F.col("metric") == whole, F.col("value"))).alias("_w"), F.max(F.when(F.col("metric") == part, F.col("value"))).alias("_p"))
    return both.filter("_w IS NOT NULL AND _p IS NOT NULL").select("issuer_id", "period_end", (F.col("_w") - F.col("_p")).alias("value"))


def component_sums(parts: DataFrame) -> DataFrame:
    """Signed sums of a fact's components; only one, three or four of them make a period, and a negative sum is told."""
    total, n = F.sum(F.col("value") * F.col("sign")), F.count("*")
    fit = n.isin(1, 3, 4)
    return parts.groupBy("fact_id").agg(F.when(fit, total).alias("total"), F.when(~fit, "PERIODS_UNRESOLVED").when(total < 0, "NEGATIVE").alias("reason"))
