"""What reviews change: the selection of facts as known at each of several cutoffs, and how it differs from one to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _newest_at(rows: DataFrame, keys: list[str], time: str, cutoffs: list[str], payload: list[str], order: list[Column]) -> DataFrame:
    """(``keys``, _at, _p): for each key and cutoff from the first at which it is known, its newest row then. Every row goes to the first cutoff that knows it, once; the rest is a running value over cutoffs."""
    limits = F.array(*(F.lit(c).cast("timestamp") for c in cutoffs))
    first = rows.withColumn("_at", F.size(F.filter(limits, lambda c: c < F.col(time)))).filter(F.col("_at") < len(cutoffs))
    newest = first.groupBy(*keys, "_at").agg(F.max(F.struct(F.col(time).alias("t"), *(o.alias(f"o{i}") for i, o in enumerate(order)), F.struct(*payload).alias("p"))).alias("_m"))
    so_far = Window.partitionBy(*keys).orderBy("_at")
    upto = F.coalesce(F.lead("_at").over(so_far), F.lit(len(cutoffs))) - 1
    running = newest.withColumn("_best", F.max("_m").over(so_far)).withColumn("_until", upto)
    return running.select(*keys, F.explode(F.sequence("_at", "_until")).alias("_at"), F.col("_best.p").alias("_p"))


def selections(facts: DataFrame, reviews: DataFrame, keys: list[str], cutoffs: list[str]) -> DataFrame:
    """(``keys``, cutoff, source, value): what is selected for each key at each cutoff (ascending texts), in one plan.

    ``facts``: ``keys``, available_at, fact_id, value. ``reviews``: ``keys``, recorded_at, review_id, decision (ACCEPT or REJECT), value. A known fact is taken as it is (DIRECT); only where there is
    none, the newest review known then counts, if it accepts (REVIEWED). Later times win, then larger ids. Keys without a selection have no row.
    """
    direct = _newest_at(facts, keys, "available_at", cutoffs, ["value"], [F.col("fact_id")]).select(*keys, "_at", F.col("_p.value").alias("_direct"), F.lit(True).alias("_has"))
    reviewed = _newest_at(reviews, keys, "recorded_at", cutoffs, ["decision", "value"], [F.col("review_id")]).select(*keys, "_at", F.when(F.col("_p.decision") == "ACCEPT", F.struct("_p.value")).alias("_review"))
    met = direct.join(reviewed, [*keys, "_at"], "full").filter(F.col("_has") | F.col("_review").isNotNull())
    named = F.array(*(F.lit(c) for c in cutoffs))
    return met.select(*keys, F.get(named, F.col("_at")).alias("cutoff"), F.when(F.col("_has"), "DIRECT").otherwise("REVIEWED").alias("source"), F.when(F.col("_has"), F.col("_direct")).otherwise(F.col("_review.value")).alias("value"))


def effect(selected: DataFrame, keys: list[str], cutoffs: list[str]) -> DataFrame:
    """(``keys``, cutoff, change, source, value): what entered, left or changed at each cutoff against the one before; at the first, all that is there entered."""
    number = F.create_map(*(F.lit(x) for i, c in enumerate(cutoffs) for x in (c, i)))
    w = Window.partitionBy(*keys).orderBy("_i")
    state = F.struct("source", "value")
    rows = selected.withColumn("_i", number[F.col("cutoff")]).withColumns({"_before": F.when(F.lag("_i").over(w) == F.col("_i") - 1, F.lag(state).over(w)), "_next": F.lead("_i").over(w)})
    here = F.when(F.col("_before").isNull(), "ENTERED").when(~F.col("_before").eqNullSafe(state), "CHANGED")
    gone = (F.col("_i") < len(cutoffs) - 1) & ~F.col("_next").eqNullSafe(F.col("_i") + 1)
    each = F.array_compact(F.array(
        F.when(here.isNotNull(), F.struct(F.col("cutoff").alias("cutoff"), here.alias("change"), F.col("source").alias("source"), F.col("value").alias("value"))),
        F.when(gone, F.struct(F.get(F.array(*(F.lit(c) for c in cutoffs)), F.col("_i") + 1).alias("cutoff"), F.lit("LEFT").alias("change"), F.col("source").alias("source"), F.col("value").alias("value"))),
    ))
    return rows.select(*keys, F.explode(each).alias("_x")).select(*keys, "_x.*")
