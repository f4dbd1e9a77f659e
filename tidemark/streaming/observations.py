"""Observation streams: parse and check envelopes, accept each once, keep rejected ones for replay.

Order doesn't matter and late rows are never dropped: an observation becomes a newer revision that reads see from its own time on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from tidemark.operators import contracts

ENVELOPE = "event_id STRING, schema_version INT, observation_key STRING, instrument_id STRING, event_type STRING, economic_time TIMESTAMP, payload STRING, payload_hash STRING"


def read_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Envelopes that arrive as JSON lines in a folder."""
    return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", per_trigger).json(path)


def parse_records(records: DataFrame) -> DataFrame:
    """Envelopes from a text column ``value``, as a log delivers them."""
    return records.select(F.from_json(F.col("value").cast("string"), ENVELOPE).alias("e")).select("e.*")


def accept_once(valid: DataFrame, journal: DataFrame | None) -> DataFrame:
    """The first of each observation key that the journal doesn't hold."""
    first = valid.groupBy("observation_key").agg(F.min_by(F.struct(*(c for c in valid.columns if c != "observation_key")), F.struct("economic_time", "event_id")).alias("_f")).select("observation_key", "_f.*")
    return first.join(journal.select("observation_key"), "observation_key", "left_anti") if journal is not None else first


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, if there is one yet."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


#: Where accepted observations of a type go (fixed values); other types are quarantined where routes are asked for.
ROUTES = {
    "STOCK_BAR": "bars", "DAILY_BAR": "bars", "DAILY_PRICE": "daily_prices", "CORPORATE_ACTION_BATCH": "corporate_actions", "FILING_FACTS": "filing_facts",
    "FUNDAMENTAL_COLLECTION_STATUS": "collection_status", "REGULATORY_FACTS": "regulatory_facts", "FUNDAMENTAL_SNAPSHOT": "fundamental_snapshots",
}


def marked(valid: DataFrame, receipts: DataFrame | None) -> DataFrame:
    """``valid`` with ``sound``: an event id stands for one key and payload, the one first received; the least of several that come at once. Redeliveries of it are sound."""
    rows = valid.withColumn("_new", F.lit(True))
    if receipts is not None:
        rows = rows.unionByName(receipts.select("event_id", "observation_key", "payload_hash", F.lit(False).alias("_new")), allowMissingColumns=True)
    mine = F.struct("observation_key", "payload_hash")
    first = F.min(F.struct("_new", mine.alias("m"))).over(Window.partitionBy("event_id")).getField("m")
    return rows.withColumn("sound", first == mine).filter("_new").drop("_new")


def ingest_batch(path: str, routes: dict[str, str] | None = None) -> Callable[[DataFrame, int], None]:
    """What a micro-batch does: quarantine what breaks the contract or reuses an event id, journal the rest once, fan it out. Each write goes to the batch's own
    folder and overwrites it, so a repeated batch changes nothing; a batch reads the tables of the batches before it only.

    ``receipts`` has each sound delivery (event_id, observation_key, payload_hash). With ``routes`` (type to table) accepted rows also go to ``canonical``, one folder per
    table, in one pass, and other types are quarantined. The journal is kept by economic day: as the day is part of an observation's key, a
    batch meets only its own days there.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        checked = contracts.events(batch)
        if routes:
            known = F.when(~F.col("event_type").isin(*routes) | F.col("event_type").isNull(), F.array(F.lit("UNSUPPORTED_TYPE"))).otherwise(F.array().cast("array<string>"))
            checked = checked.withColumn("violations", F.array_sort(F.concat("violations", known)))
        checked.persist()
        usual = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", max(spark.sparkContext.defaultParallelism, checked.count() // PART_ROWS))
        try:
            write(spark, checked, batch_id)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", usual)
            checked.unpersist()

    def write(spark: SparkSession, checked: DataFrame, batch_id: int) -> None:
        valid, rejected = contracts.split(checked)
        earlier = lambda name: (t.filter(F.col("batch") < batch_id) if (t := table_or_none(spark, f"{path}/{name}")) is not None else None)
        told = marked(valid, earlier("receipts")).persist()  # four writes and reads below start from it
        sound, reused = told.filter("sound").drop("sound"), told.filter("NOT sound").drop("sound")
        at = f"batch={batch_id}"
        rejected.unionByName(reused.withColumn("violations", F.array(F.lit("IDENTITY_REUSED")))).write.mode("overwrite").parquet(f"{path}/quarantine/{at}")
        sound.select("event_id", "observation_key", "payload_hash").write.mode("overwrite").parquet(f"{path}/receipts/{at}")
        journal = earlier("journal")
        if journal is not None:
            days = [r[0] for r in sound.select(F.to_date("economic_time")).distinct().limit(MOST_DAYS + 1).collect()]
            journal = journal.filter(F.col("day").isin(days)) if len(days) <= MOST_DAYS else journal
        accept_once(sound, journal).withColumn("day", F.to_date("economic_time")).hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{path}/journal/{at}")
        if routes:
            written = table_or_none(spark, f"{path}/journal/{at}")
            to = F.create_map(*(F.lit(x) for pair in routes.items() for x in pair))
            if written is not None:
                written.withColumn("target", to[F.col("event_type")]).hint("rebalance", "target").write.mode("overwrite").partitionBy("target").parquet(f"{path}/canonical/{at}")
        told.unpersist()

    return run


#: Days of a batch up to which the journal is read by day; rows of a batch for each task of its shuffles, which a stream doesn't size by itself.
MOST_DAYS, PART_ROWS = 400, 50_000


def start(stream: DataFrame, path: str, routes: dict[str, str] | None = None) -> StreamingQuery:
    """Ingest everything that is there, then stop; call again, or use another trigger, to go on."""
    return stream.writeStream.foreachBatch(ingest_batch(path, routes)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def replay(quarantine: DataFrame, fixes: DataFrame, done: DataFrame | None) -> DataFrame:
    """Quarantined rows with the payload of their fix (event_id, replay_id, payload), less the replays already done, for another pass of the contract."""
    todo = fixes.join(done.select("replay_id"), "replay_id", "left_anti") if done is not None else fixes
    rows = quarantine.drop("payload", "violations", "batch").join(todo, "event_id")
    return rows.withColumn("payload_hash", F.sha2("payload", 256))


def gauges(stream: DataFrame, name: str) -> StreamingQuery:
    """Counts by type, refreshed with the stream, in a table in memory."""
    return stream.groupBy("event_type").agg(F.count("*").alias("n")).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()


def dedupe_recent(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Bounded state: repeats within ``lateness`` go; later ones are left to the journal."""
    return stream.withWatermark("economic_time", lateness).dropDuplicatesWithinWatermark(["observation_key"])


def start_gauges(stream: DataFrame, path: str, width: str = "1 day", lateness: str = "60 days") -> StreamingQuery:
    """Counts, distinct payloads and the newest time by type and window of ``width``, refreshed with the stream, in a durable table.

    State is kept until the watermark, ``lateness`` behind the newest row, has passed a window. Each micro-batch writes the windows that changed to its own
    folder and overwrites it, so a repeated batch changes nothing; ``read_gauges`` takes the newest row of each window.
    """
    w = F.window("economic_time", width)
    counts = stream.withWatermark("economic_time", lateness).groupBy(w.alias("_w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("economic_time").alias("newest"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(F.col("_w.start").alias("window_start"), "event_type", "n", "newest").write.mode("overwrite").parquet(f"{path}/gauges/batch={batch_id}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/gauges_checkpoint").trigger(availableNow=True).start()


def read_gauges(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of each window and type."""
    rows = spark.read.parquet(f"{path}/gauges")
    return rows.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "newest"), "batch").alias("_g")).select("window_start", "event_type", "_g.*")
