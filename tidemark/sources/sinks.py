"""Sinks: publication of a run's tables at once, keyed and append-only tables, exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.temporal import settle


#: The result tables of a publication (fixed values).
RESULT_TABLES = ("lineage", "artifacts", "scores", "factors", "exclusions")


#: Below it a double has digits beyond the ninth; from it on its neighbours are further apart.
COARSE = float(1 << 23)


def _cell(name: str, kind: str) -> Column:
    """A cell as text that no other value has: numbers bare (doubles in units of the ninth digit, days and times as counts), texts behind their length, null as ~."""
    c = F.col(f"`{name}`")
    if kind in ("double", "float"):
        text = F.when(F.abs(c) < COARSE, F.rint(c * 1e9).cast("long").cast("string")).otherwise(F.concat(F.lit("e"), c.cast("string")))
    elif kind == "date":
        text = F.unix_date(c).cast("string")
    elif kind == "timestamp":
        text = F.unix_micros(c).cast("string")
    elif kind in ("boolean", "tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        text = c.cast("string")
    else:
        plain = c if kind == "string" else F.hex(c) if kind == "binary" else F.to_json(F.struct(c))
        text = F.when(c.isNotNull(), F.concat(F.length(plain).cast("string"), F.lit(":"), plain))
    return F.coalesce(text, F.lit("~"))


def table_hash(df: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, rows, content_hash) of each group: the sum of its rows' SHA-256, 60 bits each, over the columns in order of their names. The order of rows and how they are dealt don't matter; numbers count to 9 digits.

    A row's text is made of counts and lengths, and its bits are summed as two whole numbers of 30 bits: no JSON, dates or decimals are made for a row.
    """
    kinds = dict(df.dtypes)
    digest = F.sha2(F.concat_ws("|", *(_cell(c, kinds[c]) for c in sorted(df.columns))), 256)
    bits = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    rows = df.withColumn("_h", bits).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.shiftright("_h", 30)).alias("_high"), F.sum(F.col("_h").bitwiseAND((1 << 30) - 1)).alias("_low"))
    total = F.col("_high").cast("decimal(20,0)") * F.lit(1 << 30).cast("decimal(10,0)") + F.col("_low").cast("decimal(20,0)")
    return rows.select(*by, "rows", total.cast("string").alias("content_hash"))


def write_publication(tables: dict[str, DataFrame], violations: DataFrame, path: str, run_id: str) -> None:
    """All result tables of a run, or none: tables go to the run's own folders and are read back; the manifest row that makes readers see them is written last, only
    when no guard is violated and each table has the rows and content hash that were to be written. A run that died half-way leaves folders that no reader looks at and a repeat overwrites.
    """
    rules = [c for c in ("missing", "unexpected", "both", "no_reason", "rank_gap") if c in violations.columns]
    total = violations.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rules)).first()
    if broken := [c for c in rules if total[c]]:
        raise ValueError(f"run {run_id} violates {broken}")
    spark, written = violations.sparkSession, []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/run={run_id}")
        meant, back = (table_hash(d, []).select("rows", "content_hash").first() for d in (df, spark.read.schema(df.schema).parquet(f"{path}/{name}/run={run_id}")))
        if meant != back:
            raise ValueError(f"{name} of run {run_id} was read back with {back['rows']} rows instead of {meant['rows']}, or other content")
        written.append((run_id, name, back["rows"], back["content_hash"]))
    rows = spark.createDataFrame(written, "run_id string, table_name string, rows long, content_hash string")
    rows.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("table_name", "rows", "content_hash"))).alias("tables")).write.mode("overwrite").parquet(f"{path}/manifest/{run_id}")


def write_publications(tables: dict[str, DataFrame], violations: DataFrame, path: str, run: str = "run") -> DataFrame:
    """Many runs at once, in one job per table (folders by ``run``): runs whose guards hold and whose tables are read back as they were meant get manifest rows (run, table_name, rows, content_hash), which are returned.

    Tables are read twice, so they should be settled. Each call has a folder of its own; readers see only what the manifest of that folder names.
    """
    spark = violations.sparkSession
    rules = [c for c in ("missing", "unexpected", "both", "no_reason", "rank_gap") if c in violations.columns]
    sound = violations.filter(reduce(lambda a, b: a & b, (F.coalesce(F.col(c), F.lit(0)) == 0 for c in rules))).select(run).distinct()
    meant, back = [], []
    for name, df in tables.items():
        df.join(sound, run, "left_semi").write.mode("overwrite").partitionBy(run).parquet(f"{path}/{name}")
        again = spark.read.schema(df.schema).parquet(f"{path}/{name}")
        meant.append(table_hash(df.join(sound, run, "left_semi"), [run]).withColumn("table_name", F.lit(name)))
        back.append(table_hash(again.select(*df.columns), [run]).withColumn("table_name", F.lit(name)))
    columns = [run, "table_name", "rows", "content_hash"]
    union = lambda frames: reduce(lambda a, b: a.unionByName(b), frames).select(*columns)
    sides = settle(union(meant).withColumn("_n", F.lit(1)).unionByName(union(back).withColumn("_n", F.lit(-1))).groupBy(*columns).agg(F.sum("_n").alias("_n")))
    manifest = sides.filter("_n = 0").drop("_n").join(sides.filter("_n <> 0").select(run), run, "left_anti")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{path}/manifest")


def read_publication(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of one result table of all published runs."""
    runs = spark.read.parquet(f"{path}/manifest/*").select("run_id")
    return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").withColumn("run", F.col("run").cast("string")).join(F.broadcast(runs), F.col("run") == F.col("run_id"), "left_semi")


def append_if_absent(new: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table doesn't hold yet; of equal new keys one."""
    spark = new.sparkSession
    one = new.dropDuplicates([key])
    try:
        held = spark.read.parquet(path).select(key)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        one.write.parquet(path)
        return
    one.join(held, key, "left_anti").write.mode("append").parquet(path)


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*(F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c).cast("string").alias(c) for c in df.columns))


def _evidence(flat: DataFrame) -> DataFrame:
    empty = sum((F.col(c).isNull().cast("int") for c in flat.columns), F.lit(0))
    return flat.select(flat.columns[0], F.lit(len(flat.columns)).alias("cells"), empty.alias("empty"), F.sha2(F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("")) for c in flat.columns)), 256).alias("digest"))


def export_csv(df: DataFrame, path: str) -> DataFrame:
    """CSV in UTF-8 with a byte-order mark, nested cells as JSON and nulls empty; returns a row of evidence per row: its number of cells, of empty ones, and a hash."""
    flat = _flat(df)
    first = flat.columns[0]
    flat.withColumnRenamed(first, f"\ufeff{first}").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return _evidence(df.select(*(F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c) for c in df.columns)).select(df.columns[0], *(F.col(c).cast("string") for c in df.columns[1:])))


def verify_export(df: DataFrame, path: str) -> DataFrame:
    """The export at ``path`` read back and held against ``df``, as one row: exported, read_back, missing and unexpected rows, files, and the SHA-256 over the files' own hashes in order. Empty cells are nulls."""
    spark, columns = df.sparkSession, df.columns
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select(F.sha2("content", 256).alias("h"))
    told = files.agg(F.count(F.lit(1)).alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("sha256"))  # one hash a file
    schema = ", ".join(f"`c{i}` STRING" for i in range(len(columns)))
    back = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("escape", '"').option("multiLine", True).csv(path).toDF(*columns)
    blank = lambda d: d.select(*(F.when(F.col(c) != "", F.col(c)).alias(c) for c in columns))
    both = blank(_flat(df)).withColumn("_n", F.lit(1)).unionByName(blank(back).withColumn("_n", F.lit(-1))).groupBy(*columns).agg(F.sum("_n").alias("_n"), F.count_if(F.col("_n") > 0).alias("_out"))
    counts = both.agg(F.sum("_out").alias("exported"), (F.sum("_out") - F.sum("_n")).alias("read_back"), F.coalesce(F.sum(F.when(F.col("_n") > 0, F.col("_n"))), F.lit(0)).alias("missing"), F.coalesce(-F.sum(F.when(F.col("_n") < 0, F.col("_n"))), F.lit(0)).alias("unexpected"))
    return counts.join(told)  # two rows of one line each


def write_sector_audit(norm: DataFrame, stored: DataFrame, path: str) -> None:
    """Three tables of a sector audit: breakdown (sector, metric), totals (metric), issues (cohorts whose stored size differs)."""
    from tidemark.operators.publication import cohort_audit, sector_breakdown

    breakdown = sector_breakdown(norm)
    totals = norm.groupBy("metric").agg(F.count("value").alias("available"), F.count("z").alias("standardised"), F.count_distinct("sector").alias("sectors"))
    for name, df in (("breakdown", breakdown), ("totals", totals), ("issues", cohort_audit(norm, stored))):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
