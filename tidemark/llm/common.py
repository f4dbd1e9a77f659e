"""Helpers that several training-data operators share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the session's checkpoint folder. A local session without either gets a temporary one; on a cluster that is an error."""
    chosen = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not chosen:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        chosen = spark.sparkContext.getCheckpointDir()
    return chosen.rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so later steps neither recompute it nor depend on an executor's disk."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def discard(*written: DataFrame) -> None:
    """Remove tables that ``cut`` wrote, once all that is made of them is written too."""
    for df in written:
        if path := getattr(df, "_written_at", None):
            sc = df.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sampled(rows: DataFrame, most: int, number: str = "row") -> DataFrame:
    """About ``most`` of ``rows`` (text, ``number``), by a hash of both; all if there are no more.

    ``number`` tells rows apart, so that any number of rows of one id, of none or of one text are thinned like others. It must be repeatable.
    """
    n = rows.count()
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64("text", number), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def bucket_of(n: int, *cols: Column | str) -> Column:
    """An even bucket from 0 to n - 1, by hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


#: Cells up to which their starts are broadcast.
FEW_CELLS = 100_000


def cells(rows: int, least: int = 1000) -> int:
    """Into how many buckets to deal that many rows: about as many as a bucket then holds rows, which are ``least`` or more."""
    return max(1, -(-rows // max(least, math.isqrt(rows))))


def gapless(df: DataFrame, part: list[str], order: list[str], out: str, largest: int, parts: int | None = None, cell_rows: int = 1000) -> DataFrame:
    """Number the rows of each ``part`` from 0 without gaps, no matter how many rows one part holds.

    Rows are dealt into hash buckets by ``order``, as many as ``cells`` says for the ``largest`` part (a row count); a bucket starts where the counts of those before it end, and only within a (part, bucket) cell is there a sort. Where the
    number of ``parts`` is known and there are at most FEW_CELLS cells, their starts are broadcast; else they are joined.
    """
    buckets = cells(largest, cell_rows)
    b, start, n = (fresh(df, x) for x in ("_bucket", "_start", "_n"))
    dealt = df.withColumn(b, bucket_of(buckets, *order))
    cell = [*part, b]
    before = Window.partitionBy(*part).orderBy(b).rowsBetween(Window.unboundedPreceding, -1) if part else Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*cell).agg(F.count(F.lit(1)).alias(n)).select(*cell, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    joined = dealt.join(F.broadcast(starts) if parts and parts * buckets <= FEW_CELLS else starts, cell)
    within = F.row_number().over(Window.partitionBy(*cell).orderBy(*order)) - 1
    return joined.withColumn(out, (F.col(start) + within).cast("long")).drop(b, start)


def attach(left: DataFrame, right: DataFrame, key: str, weight: str, hot_keys: int = 1000) -> DataFrame:
    """Left join with ``right``, unique by ``key``, where any key of ``left`` may be as frequent as it likes.

    ``weight`` is a column of ``right``: the key's row count in ``left``. Keys with over 1/hot_keys of all rows number fewer than
    hot_keys, so those alone are broadcast; all other rows meet by a shuffle, where the hot rows are spread by a random key.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    payload = [c for c in right.columns if c not in (key, weight)]
    is_hot = F.col(weight) > total / hot_keys
    hot = right.filter(is_hot).select(F.col(key), F.lit(True).alias("_hot"), F.struct(*payload).alias("_h"))
    cold = right.filter(~is_hot).select(F.col(key).alias("_k"), F.lit(False).alias("_f"), F.struct(*payload).alias("_c"))
    near = left.join(F.broadcast(hot), key, "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    spread = near.withColumn("_s", F.when(F.col("_hot"), F.xxhash64(*left.columns).cast("string").cast(left.schema[key].dataType)).otherwise(F.col(key)))
    both = spread.join(cold, (F.col("_s") == F.col("_k")) & (F.col("_hot") == F.col("_f")), "left")
    return both.select(*left.columns, *(F.coalesce(F.col(f"_h.{c}"), F.col(f"_c.{c}")).alias(c) for c in payload))
