"""Comparisons of tables, runs and model versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one of two sets only, with their ``side``."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table holds more often than the other, with side and how many more. One aggregate over both: no join."""
    both = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0").select(*a.columns, F.when(F.col("_n") > 0, "left").otherwise("right").alias("side"), F.abs("_n").alias("n"))


def score_difference(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 5e-7) -> DataFrame:
    """One row: keys missing on either side, largest difference, and whether the tables agree."""
    x, y = a.select(*keys, *(F.col(v).alias(f"a_{v}") for v in values), F.lit(1).alias("_a")), b.select(*keys, *(F.col(v).alias(f"b_{v}") for v in values), F.lit(1).alias("_b"))
    gap = F.greatest(*(F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")) for v in values)) if len(values) > 1 else F.abs(F.col(f"a_{values[0]}") - F.col(f"b_{values[0]}"))
    out = x.join(y, keys, "full").agg(F.count_if(F.col("_a").isNull()).alias("missing_left"), F.count_if(F.col("_b").isNull()).alias("missing_right"), F.max(gap).alias("largest"))
    return out.withColumn("agrees", (F.col("missing_left") + F.col("missing_right") == 0) & (F.coalesce("largest", F.lit(0.0)) <= tolerance))


def different_cells(a: DataFrame, b: DataFrame, keys: list[str], numbers: list[str], others: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Keys and fields in which two tables differ: numbers beyond a tolerance, others not equal; missing rows differ in all fields."""
    x, y = a.alias("x"), b.alias("y")
    met = x.join(y, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys], "full")
    near = {v: ~F.coalesce(F.abs(F.col(f"x.{v}") - F.col(f"y.{v}")) <= tolerance, F.col(f"x.{v}").isNull() & F.col(f"y.{v}").isNull()) for v in numbers}
    same = {v: ~F.col(f"x.{v}").eqNullSafe(F.col(f"y.{v}")) for v in others}
    fields = F.array_compact(F.array(*(F.when(c, F.lit(v)) for v, c in (near | same).items())))
    return met.select(*(F.coalesce(F.col(f"x.{k}"), F.col(f"y.{k}")).alias(k) for k in keys), F.explode(fields).alias("field"))


def compare_models(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Per key: rank and composite under two versions, and whether it came in or fell out."""
    a, b = (d.select(key, *(F.col(c).alias(f"{c}_{s}") for c in ("rank", "composite"))) for d, s in ((before, "before"), (after, "after")))
    change = F.when(F.col("rank_before").isNull(), "RECOVERED").when(F.col("rank_after").isNull(), "LOST").when(F.col("rank_before") == F.col("rank_after"), "SAME").otherwise("MOVED")
    return a.join(b, key, "full").withColumn("change", change)


def correlation(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Correlation of every two columns per group, in one aggregate, as long rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.groupBy(*by).agg(*(F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}~{b}").alias("r")) for a, b in pairs))
    return wide.select(*by, F.explode(rows).alias("x")).select(*by, "x.a", "x.b", "x.r")


def reason_overlap(reasons: DataFrame, key: str) -> DataFrame:
    """Per reason: rows that have it, and rows that have nothing else. ``reasons``: key, code; repeats don't count."""
    flat = reasons.select(key, "code").distinct()
    sets = flat.groupBy(key).agg(F.count("*").alias("_k"), F.min("code").alias("only"))
    alone = sets.filter("_k = 1").groupBy(F.col("only").alias("code")).agg(F.count("*").alias("sole"))
    return flat.groupBy("code").agg(F.count("*").alias("n")).join(alone, "code", "left").select("code", "n", F.coalesce("sole", F.lit(0)).alias("sole"))


def reason_pairs(reasons: DataFrame, key: str) -> DataFrame:
    """How many keys have two reasons together. A key has few reasons: pairs are made inside its own set."""
    sets = reasons.select(key, "code").groupBy(key).agg(F.array_sort(F.collect_set("code")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of several frames of one schema."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def replay(stored: DataFrame, rebuilt: DataFrame, run: list[str], ident: str, tolerance: float = 1e-9) -> DataFrame:
    """Per run: rows, rows whose rank differs or that only one side has, the largest difference of composites, and whether the stored run is reproduced."""
    a, b = (d.select(*run, ident, F.col("rank").alias(f"_r{i}"), F.col("composite").alias(f"_c{i}")) for i, d in ((0, stored), (1, rebuilt)))
    both = a.join(b, [*run, ident], "full")
    gap, moved = F.abs(F.col("_c0") - F.col("_c1")), ~F.col("_r0").eqNullSafe(F.col("_r1"))
    other = moved | F.coalesce(gap > tolerance, F.col("_c0").isNull() != F.col("_c1").isNull())
    return both.groupBy(*run).agg(F.count("*").alias("rows"), F.count_if(moved).alias("other_rank"), F.round(F.max(gap), 6).alias("largest"), (F.count_if(other) == 0).alias("reproduces"))
