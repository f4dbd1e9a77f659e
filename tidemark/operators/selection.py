"""Order statistics of groups of any size: exact, and without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.temporal import settle

#: Into how many ranges a cell is cut in each pass, and the rows up to which a cell's different values are ordered at once.
RANGES, CELL_ROWS = 64, 50_000


def _same(by: list[str], left: str = "l", right: str = "r") -> Column:
    """Rows of one group, where null is a group as well."""
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def _held(values: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """``values`` that lie in one of their group's cells (``_lo`` to ``_hi``), which don't overlap."""
    met = values.alias("l").join(cells.select(*by, "_lo", "_hi").distinct().alias("r"), _same(by) & F.col("_v").between(F.col("_lo"), F.col("_hi")))
    return met.select(*(F.col(f"l.{c}") for c in by), "_lo", "_hi", "_v")


def _narrowed(values: DataFrame, wanted: DataFrame, by: list[str], ranges: int) -> DataFrame:
    """``wanted`` after one pass: each place's cell is cut at its approximate quantiles, and exact counts of the ranges tell in which one the place lies.

    A cut is a range of its own, so equal values that fill a range end as a cell without width. The next cell runs from the least to the greatest value of its range.
    """
    held, cell = _held(values, wanted, by), [*by, "_lo", "_hi"]
    cuts = held.groupBy(*cell).agg(F.percentile_approx("_v", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("_cuts"))
    met = held.alias("l").join(cuts.alias("r"), _same(cell)).select(*(F.col(f"l.{c}") for c in cell), "_v", "_cuts")
    part = 2 * F.size(F.filter("_cuts", lambda c: c < F.col("_v"))) + F.array_contains("_cuts", F.col("_v")).cast("int")
    counts = met.groupBy(*cell, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    cells = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*cell).orderBy("_part")))
    met = wanted.alias("l").join(cells.alias("r"), _same(cell) & (F.col("l._at") < F.col("r._upto")) & (F.col("l._at") >= F.col("r._upto") - F.col("r._n")))
    return met.select(*(F.col(f"l.{c}") for c in by), "_place", (F.col("l._at") - F.col("r._upto") + F.col("r._n")).alias("_at"), F.col("r._least").alias("_lo"), F.col("r._most").alias("_hi"), F.col("r._n").alias("_rows"))


def places(values: DataFrame, wanted: DataFrame, by: list[str], ranges: int = RANGES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(``by``, _place, _x): the value at each wanted place of each group, in order from 0.

    ``values``: ``by``, _v (finite). ``wanted``: ``by``, _place, and the whole group as its cell (_at, _lo, _hi, _rows). A cell of more than ``cell_rows`` rows is cut into
    ranges, counted where the rows are; only the ranges that hold a wanted place go on. The different values of what is left are ordered. Both inputs
    should be settled, as each pass reads them; a pass leaves about one in ``ranges`` of a cell's rows, or equal values.
    """
    while True:
        large = wanted.filter((F.col("_rows") > cell_rows) & (F.col("_hi") > F.col("_lo")))
        if large.isEmpty():
            break
        wanted = settle(wanted.filter(~((F.col("_rows") > cell_rows) & (F.col("_hi") > F.col("_lo")))).unionByName(_narrowed(values, large, by, ranges)))
    level = wanted.filter(F.col("_lo") == F.col("_hi")).select(*by, "_place", F.col("_lo").alias("_x"))
    rest = wanted.filter(F.col("_lo") < F.col("_hi"))
    counts = _held(values, rest, by).groupBy(*by, "_lo", "_hi", "_v").agg(F.count(F.lit(1)).alias("_n"))
    cells = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by, "_lo", "_hi").orderBy("_v")))
    met = rest.alias("l").join(cells.alias("r"), _same(by) & (F.col("l._lo") == F.col("r._lo")) & (F.col("l._hi") == F.col("r._hi")) & (F.col("l._at") < F.col("r._upto")) & (F.col("l._at") >= F.col("r._upto") - F.col("r._n")))
    return level.unionByName(met.select(*(F.col(f"l.{c}") for c in by), "_place", F.col("r._v").alias("_x")))


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], ranges: int = RANGES, cell_rows: int = CELL_ROWS, settled: bool = False) -> DataFrame:
    """(``by``, n, one column per share): exact quantiles of every group, interpolated between the neighbours of share x (n - 1).

    Null, NaN and infinite values take no part; groups without others give no row. A group may hold any number of rows: see ``places``. ``settled`` says that
    ``df`` may be read again at no great cost.
    """
    x = F.col(value).cast("double")
    values = df.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(*by, x.alias("_v"))
    values = values if settled else settle(values)
    groups = settle(values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    at = [F.lit(p) * (F.col("n") - 1) for p in shares.values()]
    both = F.array_distinct(F.array(*(f(a).cast("long") for a in at for f in (F.floor, F.ceil))))
    wanted = settle(groups.select(*by, F.explode(both).alias("_place"), "_lo", "_hi", F.col("n").alias("_rows")).withColumn("_at", F.col("_place")))
    found = places(values, wanted, by, ranges, cell_rows)
    told = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_place", "_x"))).alias("_m"))  # two places per share
    met = groups.alias("l").join(told.alias("r"), _same(by)).select(*(F.col(f"l.{c}") for c in by), "n", "_m")
    low, high = ([F.element_at("_m", f(a).cast("long")) for a in at] for f in (F.floor, F.ceil))
    return met.select(*by, "n", *((lo + (hi - lo) * (a - F.floor(a))).alias(name) for name, a, lo, hi in zip(shares, at, low, high, strict=True)))
