"""Technical indicators over closes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def returns(df: DataFrame, key: str, order: str, value: str = "close", out: str = "change") -> DataFrame:
    """Simple change against the row before of the same key."""
    return df.withColumn(out, F.col(value) / F.lag(value).over(Window.partitionBy(key).orderBy(order)) - 1)


def closes_grid(instruments: DataFrame, sessions: DataFrame, bars: DataFrame, day: str, n: int) -> DataFrame:
    """The last ``n`` sessions up to a day for every instrument, ``k`` from 1 (oldest), close null where there is no bar. Calendar rows are few and broadcast."""
    upto = sessions.filter(F.col("session_date") <= F.lit(day).cast("date")).select("session_date")
    last = upto.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("session_date")))).filter(F.col("_n") <= n).withColumn("k", n + 1 - F.col("_n")).drop("_n")
    grid = instruments.select("instrument_id").join(F.broadcast(last))
    return grid.join(bars.select("instrument_id", "session_date", "close"), ["instrument_id", "session_date"], "left")


def price_range(closes: DataFrame) -> DataFrame:
    """High, low and distance of the newest close from the high."""
    return closes.groupBy("instrument_id").agg(F.max("close").alias("high"), F.min("close").alias("low"), (F.max_by("close", "k") / F.max("close") - 1).alias("from_high"))


def volatility(closes: DataFrame, periods: int = 252) -> DataFrame:
    """Sample deviation of log changes, for a year of ``periods``."""
    change = F.log(F.col("close") / F.lag("close").over(Window.partitionBy("instrument_id").orderBy("k")))
    return closes.withColumn("_x", change).groupBy("instrument_id").agg((F.stddev_samp("_x") * F.sqrt(F.lit(float(periods)))).alias("volatility"))


def rsi(closes: DataFrame, key: str, order: str, value: str, period: int = 14) -> DataFrame:
    """Wilder's relative strength index of each key's closes: mean of the first ``period`` changes, then a smoothed mean.

    ``rsi`` is null with a ``reason``: INSUFFICIENT_PRICE_HISTORY, or FLAT_PRICE_WINDOW where nothing moves. A key's closes are one window
    of bounded length (a year of sessions, say).
    """
    rows = closes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("c")))).alias("_r"))
    moves = F.zip_with(F.slice("_r", F.lit(2), F.greatest(F.size("_r") - 1, F.lit(0))), F.slice("_r", F.lit(1), F.greatest(F.size("_r") - 1, F.lit(0))), lambda b, a: b["c"] - a["c"])
    listed = rows.withColumn("_d", moves)

    def mean(sign: int) -> F.Column:
        part = lambda d: F.greatest(d * sign, F.lit(0.0))
        seed = F.aggregate(F.slice("_d", 1, period), F.lit(0.0), lambda a, d: a + part(d)) / period
        return F.aggregate(F.slice("_d", F.lit(period + 1), F.greatest(F.size("_d") - period, F.lit(0))), seed, lambda a, d: (a * (period - 1) + part(d)) / period)

    both = listed.filter(F.size("_d") >= 0).withColumn("_g", mean(1)).withColumn("_l", mean(-1))
    short = F.size("_d") < period
    flat = (F.col("_g") == 0) & (F.col("_l") == 0)
    index = F.when(F.col("_l") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.col("_g") / F.nullif(F.col("_l"), F.lit(0.0))))
    return both.select(key, F.when(~short & ~flat, index).alias("rsi"), F.when(short, "INSUFFICIENT_PRICE_HISTORY").when(flat, "FLAT_PRICE_WINDOW").alias("reason"), (F.size("_d") + 1).alias("sessions"))
