"""Scoring models: raw factors, cohort normalisation, composition and eligibility, for many runs and candidates at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalars import WEIGHTS, clamp, reasons
from tidemark.operators.ranking import tie_percentile, zscore
from tidemark.operators.screener import ratio
from tidemark.operators.selection import quantiles
from tidemark.operators.temporal import settle

#: Cohort sizes and statistics of the models (fixed values).
PEER, FALLBACK, LOW, HIGH, EPSILON, CLIP = 10, 20, 0.025, 0.975, 1e-12, 3.0


#: Composites are rounded to so many digits, so that equal ones tie whatever the order of their sums.
DIGITS = 10


def raw_factors(inputs: DataFrame) -> DataFrame:
    """Earnings yield, price change and return on equity; rows without a positive price-earnings ratio or any input go."""
    kept = inputs.filter("pe_ratio > 0 AND return_on_equity_ttm IS NOT NULL AND latest_close IS NOT NULL AND reference_close > 0")
    return kept.withColumn("value_raw", 1 / F.col("pe_ratio")).withColumn("momentum_raw", F.col("latest_close") / F.col("reference_close") - 1).withColumn("quality_raw", F.col("return_on_equity_ttm"))


def simple_composite(raw: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the three standardised factors."""
    out = raw
    for f in ("value", "momentum", "quality"):
        out = zscore(out, f"{f}_raw", by, f"{f}_z")
    return out.withColumn("composite", (F.col("value_z") + F.col("momentum_z") + F.col("quality_z")) / 3)


def exact_sum(x: Column) -> Column:
    """Sum of small numbers (under 100 each), as decimals of 18 digits: the same whatever the order of the rows."""
    return F.sum(x.cast("decimal(20,18)")).cast("double")


def cohort_moments(df: DataFrame, by: list[str], value: str, settled: bool = False) -> DataFrame:
    """Exact bounds, then count, mean and population deviation of values held within them, per cohort of any size. ``settled``: ``df`` may be read twice at no great cost.

    Moments are sums of decimals, of each value's place between the bounds (0 to 1), so they are the same to the last bit in whatever order rows come.
    """
    rows = df if settled else settle(df.select(*by, value))
    bounds = quantiles(rows, by, value, {"low": LOW, "high": HIGH}, settled=True).drop("n")
    half = F.col("high") / 2 - F.col("low") / 2  # halves: a difference of doubles may be too large for one
    place = F.when(half > 0, (clamp(F.col(value), F.col("low"), F.col("high")) / 2 - F.col("low") / 2) / half).otherwise(0.0)
    inside = rows.filter(F.col(value).isNotNull()).join(bounds, by).withColumn("_p", place)
    sums = inside.groupBy(*by).agg(F.count("*").alias("n"), exact_sum(F.col("_p")).alias("_p"), exact_sum(F.col("_p") * F.col("_p")).alias("_pp"), F.min("low").alias("low"), F.min("high").alias("high"))
    share = F.col("_p") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("_pp") / F.col("n") - share * share, F.lit(0.0)))
    return sums.select(*by, "n", (F.col("low") * (1 - share) + F.col("high") * share).alias("mean"), (2 * half * spread).alias("sd"), "low", "high")


def standardize(rows: DataFrame, run: list[str], levels: list[tuple[Column, Column, int]], value: str, fit: Column | None = None) -> DataFrame:
    """Cohort-standardised values of long metric rows, each in the first of its levels that has enough fitted rows.

    A level is (label, name, least): rows of one run and name are a cohort if ``least`` of them are fitted; a null name is none. ``fit`` marks the rows that
    statistics come from (one class per issuer, say); all rows with a value are standardised. All levels of all runs are resolved by one
    aggregate over fitted rows x levels, whose result is joined back; how it is joined is left to Spark, as it grows with the runs.
    Adds fit, cohort, cohort_n, z (bounded, clipped) and reason (NO_VALUE, NO_COMPATIBLE_COHORT, NO_DISPERSION).
    """
    there = F.col(value).isNotNull() & ~F.isnan(value)
    names = [f"_name{i}" for i in range(len(levels))]
    base = settle(rows.withColumns({n: name.cast("string") for n, (_, name, _) in zip(names, levels, strict=True)} | {"_fit": there if fit is None else there & fit}))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("_no"), F.col(n).alias("_name")) for i, n in enumerate(names))))
    fitted = base.filter("_fit").select(*run, each.alias("_l"), F.col(value).alias("_x")).select(*run, "_l._no", "_l._name", "_x").filter(F.col("_name").isNotNull())
    stats = settle(cohort_moments(fitted, [*run, "_no", "_name"], "_x"))
    met = base
    for i, n in enumerate(names):
        met = met.join(stats.filter(F.col("_no") == i).select(*run, F.col("_name").alias(n), F.struct("n", "mean", "sd", "low", "high").alias(f"_s{i}")), [*run, n], "left")
    enough = [(F.col(f"_s{i}.n") >= least) & F.col(value).isNotNull() for i, (_, _, least) in enumerate(levels)]
    choose = lambda found: reduce(lambda a, b: a.when(*b), zip(enough[1:], found[1:], strict=True), F.when(enough[0], found[0]))
    met = met.withColumns({"cohort": choose([label for label, _, _ in levels]), "_c": choose([F.col(f"_s{i}") for i in range(len(levels))])})
    x, flat = clamp(F.col(value), F.col("_c.low"), F.col("_c.high")), F.col("_c.sd") < EPSILON
    z = F.when(flat, 0.0).otherwise((x - F.col("_c.mean")) / F.nullif(F.col("_c.sd"), F.lit(0.0)))
    reason = F.when(F.col(value).isNull(), "NO_VALUE").when(F.col("cohort").isNull(), "NO_COMPATIBLE_COHORT").when(flat, "NO_DISPERSION")
    return met.withColumns({"cohort_n": F.col("_c.n"), "z": clamp(z, -CLIP, CLIP), "reason": reason}).withColumnRenamed("_fit", "fit").drop("_c", *names, *(f"_s{i}" for i in range(len(levels))))


def place(rows: DataFrame, run: list[str], levels: list[tuple[Column, Column, int]], value: str) -> DataFrame:
    """``rows`` with ``placed``: whether ``standardize`` finds a cohort for the value. Sizes are one aggregate over the levels; no value is ordered."""
    x = F.col(value)
    names = [f"_name{i}" for i in range(len(levels))]
    base = rows.withColumns({n: name.cast("string") for n, (_, name, _) in zip(names, levels, strict=True)})
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("_no"), F.col(n).alias("_name")) for i, n in enumerate(names))))
    counted = base.filter(x.isNotNull() & ~F.isnan(x)).groupBy(*run, *names).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.abs(x) < float("inf")).alias("_sound"))
    sizes = counted.select(*run, each.alias("_l"), "_n", "_sound").select(*run, "_l.*", "_n", "_sound").filter(F.col("_name").isNotNull())
    sizes = settle(sizes.groupBy(*run, "_no", "_name").agg(F.sum("_n").alias("_n"), F.sum("_sound").alias("_sound")).filter("_sound > 0"))
    for i, (n, (_, _, least)) in enumerate(zip(names, levels, strict=True)):
        large = sizes.filter((F.col("_no") == i) & (F.col("_n") >= least)).select(*run, F.col("_name").alias(n), F.lit(True).alias(f"_p{i}"))
        base = base.join(large, [*run, n], "left")
    found = reduce(lambda a, b: a | b, (F.coalesce(F.col(f"_p{i}"), F.lit(False)) for i in range(len(levels))))
    return base.withColumn("placed", x.isNotNull() & found).drop(*names, *(f"_p{i}" for i in range(len(levels))))


def normalize(rows: DataFrame, run: list[str], peer: str, profile: str | None, value: str, fit: Column | None = None, peer_least: int = PEER, fallback_least: int = FALLBACK) -> DataFrame:
    """``standardize`` within the peer group if it has ``peer_least`` fitted rows, else within the profile (or the whole run) if that has ``fallback_least``, else nowhere. ``cohort`` is PEER or FALLBACK."""
    return standardize(rows, run, [(F.lit("PEER"), F.col(peer), peer_least), (F.lit("FALLBACK"), F.col(profile) if profile else F.lit(""), fallback_least)], value, fit)


def compose_strict(norm: DataFrame, keys: list[str], denominator: int = 3, least: int = 2) -> DataFrame:
    """Family scores over a fixed denominator, missing metrics as zero; null under ``least`` metrics. ``norm``: keys, family, z."""
    return norm.groupBy(*keys, "family").agg(F.when(F.count("z") >= least, F.sum(F.coalesce("z", F.lit(0.0))) / denominator).alias("score"))


def compose_flexible(norm: DataFrame, keys: list[str], candidate: str = "primary") -> DataFrame:
    """Family means over what is there, weights shared out among families that have a score; COMPLETE when all three have."""
    families = ("value", "quality", "momentum")
    wide = norm.groupBy(*keys).agg(*(F.avg(F.when(F.col("family") == f, F.col("z"))).alias(f) for f in families))
    weight = dict(zip(families, WEIGHTS[candidate], strict=True))
    have = reduce(lambda a, b: a + b, (F.when(F.col(f).isNotNull(), F.lit(weight[f])).otherwise(0.0) for f in families))
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(f) * weight[f], F.lit(0.0)) for f in families))
    complete = reduce(lambda a, b: a & b, (F.col(f).isNotNull() for f in families))
    return wide.withColumn("composite", ratio(total, have)).withColumn("status", F.when(complete, "COMPLETE").when(have > 0, "PARTIAL"))


def compose_available(norm: DataFrame, cards: DataFrame, on: list[str], run: list[str], expected: int = 7, candidate: str = "primary") -> DataFrame:
    """A row per card (``on``, ``errors``, ``warnings``) with the composite over what is there: family means, weights shared out among families that have one.

    Adds value, quality, momentum, weight_* and contribution_* of each, normalized, composite, status (COMPLETE with ``expected`` metrics, PARTIAL, UNAVAILABLE), rank and
    percentile within ``run`` (null under two eligible rows). A card without errors and without any family gets NO_VALID_NORMALIZED_METRICS; a partial one a warning.
    ``norm``: ``on``, family, metric, cohort, z of cards without errors; a metric whose cohort is the fallback is warned of.
    """
    families = dict(zip(("value", "quality", "momentum"), WEIGHTS[candidate], strict=True))
    fell = F.when(~F.startswith("cohort", F.lit("PRIMARY:")), F.concat(F.lit("PEER_FALLBACK:"), "metric"))
    wide = norm.groupBy(*on).agg(*(F.avg(F.when(F.col("family") == f, F.col("z"))).alias(f) for f in families), F.count("z").alias("normalized"), F.collect_set(fell).alias("_fell"))
    met = cards.select(*on, "errors", "warnings").join(wide, on, "left")
    have = reduce(lambda a, b: a + b, (F.when(F.col(f).isNotNull(), F.lit(w)).otherwise(0.0) for f, w in families.items()))
    sound = (F.size("errors") == 0) & (have > 0)
    met = met.withColumns({f"weight_{f}": F.when(sound & F.col(f).isNotNull(), F.lit(w) / have).otherwise(0.0) for f, w in families.items()})
    met = met.withColumns({f"contribution_{f}": F.when(sound, F.col(f) * F.col(f"weight_{f}")) for f in families})
    met = met.withColumns({"composite": F.when(sound, F.round(reduce(lambda a, b: a + b, (F.coalesce(f"contribution_{f}", F.lit(0.0)) for f in families)), DIGITS)), "normalized": F.coalesce("normalized", F.lit(0)), "eligible": sound})
    none = F.array().cast("array<string>")
    status = F.when(~sound, "UNAVAILABLE").when(F.col("normalized") == expected, "COMPLETE").otherwise("PARTIAL")
    partial = F.when(status == "PARTIAL", F.array(F.lit("PARTIAL_SCORE:AVAILABLE_COMPONENTS_ONLY"))).otherwise(none)
    lost = F.when((F.size("errors") == 0) & ~sound, F.array(F.lit("NO_VALID_NORMALIZED_METRICS"))).otherwise(none)
    met = settle(met.withColumns({"status": status, "warnings": F.array_sort(F.array_distinct(F.concat("warnings", F.coalesce("_fell", none), partial))), "errors": F.array_sort(F.concat("errors", lost))}).drop("_fell"))
    ranked = tie_percentile(met.filter("eligible"), run, ident=on[-1]).select(*on, "rank", "percentile")
    out = met.join(ranked, on, "left")
    return out.withColumn("rank", F.when(F.count(F.when(F.col("eligible"), 1)).over(Window.partitionBy(*run)) > 1, F.col("rank")))


def candidates(families: DataFrame) -> DataFrame:
    """Composite of every candidate weighting in one pass: a row per input row and candidate."""
    rows = F.array(*(F.struct(F.lit(n).alias("candidate"), (F.col("value") * a + F.col("quality") * b + F.col("momentum") * c).alias("composite")) for n, (a, b, c) in WEIGHTS.items()))
    return families.withColumn("_c", F.explode(rows)).select(*families.columns, "_c.candidate", F.col("_c.composite").alias("candidate_composite"))


def eligibility(rows: DataFrame) -> DataFrame:
    """``exclusions``: codes of the gates a row fails."""
    age = F.datediff("as_of", "filed_date")
    return rows.withColumn(
        "exclusions",
        reasons(
            (F.coalesce(F.col("price") < 5, F.lit(True)), "PRICE_BELOW_MINIMUM"),
            (F.coalesce(F.col("traded_value") < 5_000_000, F.lit(True)), "ILLIQUID"),
            (F.col("history") < 252, "INSUFFICIENT_HISTORY"),
            (F.col("liquidity") < 20, "INSUFFICIENT_LIQUIDITY_HISTORY"),
            (~F.coalesce(age.between(0, 180), F.lit(False)), "STALE_OR_MISSING_FILING"),
            (~F.col("primary_class"), "SECONDARY_CLASS"),
        ),
    )


def accept_input(value: Column, unit_ok: Column, available: Column, cutoff: Column, age: Column, oldest: int) -> Column:
    """The first reason why an input can't be used, or null."""
    return F.when(value.isNull(), "NOT_REPORTED").when(available > cutoff, "FUTURE_INFORMATION").when(~unit_ok, "INVALID_UNIT").when(age > oldest, "STALE")


def issuer_capitalization(rows: DataFrame, run: list[str]) -> DataFrame:
    """Shares dropped for issuers with several instruments."""
    several = F.count(F.lit(1)).over(Window.partitionBy(*run, "issuer_id")) > 1
    return rows.withColumn("_s", several).withColumn("shares", F.when(~F.col("_s"), F.col("shares"))).drop("_s")


def score_runs(scored: DataFrame, run: list[str], least: int = 2) -> DataFrame:
    """Rank and percentile of the eligible rows of every run, with its status: FAILED under ``least`` of them."""
    ranked = tie_percentile(scored.filter("eligible AND composite IS NOT NULL"), run)
    n = F.count(F.lit(1)).over(Window.partitionBy(*run))
    return ranked.withColumn("scored", n).withColumn("status", F.when(F.col("scored") >= least, "SCORED").otherwise("FAILED"))


def simulate(rows: DataFrame, scenarios: DataFrame, run: list[str]) -> DataFrame:
    """Runs scored again under scenarios (scenario, instrument_id, composite: an override; a null instrument stands for none), all in one pass."""
    names = scenarios.select("scenario").distinct()
    patch = scenarios.filter("instrument_id IS NOT NULL").withColumnRenamed("composite", "_new")
    each = rows.join(F.broadcast(names)).join(F.broadcast(patch), ["scenario", "instrument_id"], "left")
    patched = each.withColumn("composite", F.coalesce("_new", "composite")).withColumn("eligible", F.col("eligible") | F.col("_new").isNotNull()).drop("_new")
    return score_runs(patched, ["scenario", *run])


def tax_rate(rates: Column, fallback: Column) -> Column:
    """Median of three yearly rates held within 0 and 0.4; the statutory rate where one is missing."""
    return F.when(F.size(rates) == 3, clamp(F.array_sort(rates)[1], 0.0, 0.4)).otherwise(fallback)
