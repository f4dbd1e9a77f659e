"""Data contracts: every rule a row breaks, and the split into valid and rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import reasons


def check(df: DataFrame, *rules: tuple[str, Column]) -> DataFrame:
    """``df`` with ``violations``: sorted codes of the rules that don't hold. A null rule counts as broken."""
    return df.withColumn("violations", reasons(*((~F.coalesce(ok, F.lit(False)), code) for code, ok in rules)))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of a checked frame."""
    good = F.size("violations") == 0
    return checked.filter(good).drop("violations"), checked.filter(~good)


def bars(df: DataFrame) -> DataFrame:
    """Daily bar rules: positive prices, high and low around the others, no negative volume, known feed, vintage not before session."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return check(
        df,
        ("NON_POSITIVE_PRICE", (o > 0) & (h > 0) & (lo > 0) & (c > 0)),
        ("HIGH_BELOW", h >= F.greatest(o, lo, c)),
        ("LOW_ABOVE", lo <= F.least(o, h, c)),
        ("NEGATIVE_VOLUME", F.col("volume") >= 0),
        ("UNKNOWN_FEED", F.col("feed").isin("sip", "iex")),
        ("VINTAGE_BEFORE_SESSION", F.col("vintage").isNull() | (F.col("vintage") >= F.col("session_date"))),
    )


def filings(df: DataFrame) -> DataFrame:
    """Filing rules: ten-digit registrant, accession pattern, known form, period not after filing, amendments marked."""
    return check(
        df,
        ("BAD_CIK", F.col("cik").rlike("^[0-9]{10}$")),
        ("BAD_ACCESSION", F.col("accession").rlike("^[0-9]{10}-[0-9]{2}-[0-9]{6}$")),
        ("UNKNOWN_FORM", F.col("form").isin("10-K", "10-Q", "10-K/A", "10-Q/A")),
        ("PERIOD_AFTER_FILING", F.col("period_end") <= F.col("filed_date")),
        ("AMENDMENT_UNMARKED", F.col("amends").isNull() | F.endswith("form", F.lit("/A"))),
    )


def regulatory(df: DataFrame) -> DataFrame:
    """Regulatory report rules."""
    return check(df, ("BAD_SCOPE", F.col("scope").isin("SAME_LEGAL_ENTITY", "PARENT", "SUBSIDIARY")), ("EFFECTIVE_LATE", F.col("effective_from") <= F.col("period_end")), ("AVAILABLE_EARLY", F.col("available_at") > F.col("period_end")))


def events(df: DataFrame) -> DataFrame:
    """Event envelope rules: schema version, type, key as recomputed, payload hash."""
    from tidemark.functions.scalars import framed_hash

    return check(
        df,
        ("BAD_SCHEMA_VERSION", F.col("schema_version") == 2),
        ("BLANK_TYPE", F.trim("event_type") != ""),
        ("KEY_MISMATCH", F.col("observation_key") == framed_hash(F.col("instrument_id"), F.col("event_type"), F.date_format("economic_time", "yyyy-MM-dd'T'HH:mm:ss"))),
        ("PAYLOAD_HASH_MISMATCH", F.col("payload_hash") == F.sha2(F.col("payload"), 256)),
    )


def members(df: DataFrame) -> DataFrame:
    """Universe members in normal form, checked."""
    clean = lambda c, default=None: F.coalesce(F.nullif(F.upper(F.trim(F.col(c))), F.lit("")), F.lit(default))
    out = df.withColumn("symbol", clean("symbol")).withColumn("security_type", clean("security_type", "COMMON_STOCK")).withColumn("share_class", clean("share_class", "UNSPECIFIED")).withColumn("currency", clean("currency", "USD"))
    return check(out.withColumn("cik", F.lpad("cik", 10, "0")), ("NO_IDENTIFIER", F.col("cik").isNotNull() | F.col("figi").isNotNull()), ("BAD_SYMBOL", F.col("symbol").rlike("^[A-Z0-9./#-]{1,10}$")), ("BAD_SIC", F.col("sic").isNull() | F.col("sic").rlike("^[0-9]{4}$")))


def snapshots(df: DataFrame) -> DataFrame:
    """Snapshot rules: times in order, counts in order, COMPLETE only when all came."""
    return check(df, ("AVAILABLE_AFTER_OBSERVED", F.col("available_at") <= F.col("observed_at")), ("MORE_THAN_EXPECTED", F.col("expected") >= F.col("imported")), ("INCOMPLETE", (F.col("state") != "COMPLETE") | (F.col("expected") == F.col("imported"))))


def requests(df: DataFrame) -> DataFrame:
    """Timing policy rules of run requests."""
    close = F.col("policy") == "CLOSE_V1"
    late = F.expr("knowledge_at > market_at AND knowledge_at <= market_at + INTERVAL '7' DAY")
    return check(df, ("CLOSE_AFTER_MARKET", ~close | (F.col("knowledge_at") <= F.col("market_at"))), ("DELAY_OUT_OF_RANGE", close | late))


def reviews(df: DataFrame) -> DataFrame:
    """Review rules: kind and target agree, reviewer named, sourced, explained."""
    pair = ((F.col("kind") == "SHARE_FACT") & (F.col("target_type") == "FACT")) | ((F.col("kind") == "MISSING_SESSION") & (F.col("target_type") == "ISSUE"))
    return check(df, ("KIND_MISMATCH", pair), ("NO_REVIEWER", F.length("reviewer") >= 3), ("NO_SOURCE", F.startswith("source", F.lit("https://"))), ("NO_RATIONALE", F.length("rationale") >= 20))


def panel(df: DataFrame) -> DataFrame:
    """One row per broken panel rule: rule and how many rows or signals break it."""
    nulls = df.filter(F.col("close").isNull() | F.col("market_cap").isNull()).agg(F.lit("NULL_VALUE").alias("rule"), F.count("*").alias("n"))
    twice = df.groupBy("signal_at", "instrument_id").count().filter("count > 1").agg(F.lit("DUPLICATE_KEY").alias("rule"), F.count("*").alias("n"))
    cap = df.filter("NOT (market_cap > 0)").agg(F.lit("BAD_MARKET_CAP").alias("rule"), F.count("*").alias("n"))
    low = df.filter("total_return < -1").agg(F.lit("BAD_RETURN").alias("rule"), F.count("*").alias("n"))
    small = df.groupBy("signal_at").agg(F.count_distinct("instrument_id").alias("k")).filter("k < 100").agg(F.lit("SMALL_CROSS_SECTION").alias("rule"), F.count("*").alias("n"))
    return nulls.unionByName(twice).unionByName(cap).unionByName(low).unionByName(small)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by several rows, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
