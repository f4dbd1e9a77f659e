"""Replay of stored publications: rebuilt from their stored inputs, and held against what was published."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.comparisons import different_cells
from tidemark.operators.temporal import settle
from tidemark.sources.sinks import table_hash


def replay_publications(manifest: DataFrame, stored: dict[str, DataFrame], inputs: list[str], rebuild: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], run: str = "run") -> DataFrame:
    """(``run``, table_name, no, intact, reproduced) for every table of every published run.

    ``intact``: the stored table still has the rows and content hash of the manifest (run, table_name, rows, content_hash). ``reproduced``: so has the table that
    ``rebuild`` makes from the stored ``inputs``; null for inputs. All runs are rebuilt in one job and compared by hash; ``no`` is the table's place in the order of making.
    """
    hashed = lambda tables: reduce(lambda a, b: a.unionByName(b), (table_hash(df, [run]).withColumn("table_name", F.lit(n)) for n, df in tables.items()))
    rebuilt = rebuild({n: stored[n] for n in inputs})
    order = F.create_map(*(F.lit(x) for i, n in enumerate(stored) for x in (n, i)))
    mine = F.struct("rows", "content_hash")
    there = hashed(stored).select(run, "table_name", mine.alias("_stored"))
    again = hashed(rebuilt).select(run, "table_name", mine.alias("_rebuilt"))
    met = manifest.select(run, "table_name", mine.alias("_told")).join(there, [run, "table_name"], "left").join(again, [run, "table_name"], "left")
    result = F.col("table_name").isin(list(rebuilt))
    return met.select(run, "table_name", order[F.col("table_name")].alias("no"), F.col("_told").eqNullSafe(F.col("_stored")).alias("intact"), F.when(result, F.col("_told").eqNullSafe(F.col("_rebuilt"))).alias("reproduced"))


def first_difference(checked: DataFrame, run: str = "run") -> DataFrame:
    """(``run``, found_at, kind): the first table in the order of making that isn't what was published (ALTERED), else the first that isn't reproduced (NOT_REPRODUCED), else null."""
    wrong = F.when(~F.col("intact"), F.struct(F.lit(0).alias("k"), "no", "table_name")).when(~F.col("reproduced"), F.struct(F.lit(1).alias("k"), "no", "table_name"))
    first = checked.groupBy(run).agg(F.min(wrong).alias("_w"))
    return first.select(run, F.col("_w.table_name").alias("found_at"), F.when(F.col("_w.k") == 0, "ALTERED").when(F.col("_w.k") == 1, "NOT_REPRODUCED").alias("kind"))


def altered_cells(stored: DataFrame, rebuilt: DataFrame, suspects: DataFrame, keys: list[str], numbers: list[str], others: list[str], run: str = "run") -> DataFrame:
    """Cells in which a stored table differs from the rebuilt one, of the runs in ``suspects`` (``run``): what hashes found is looked at by cell, nothing else."""
    few = settle(suspects.select(run).distinct())
    return different_cells(stored.join(few, run, "left_semi"), rebuilt.join(few, run, "left_semi"), keys, numbers, others)
