"""Reference data: universes, listings, identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.temporal import latest_per


def universe_union(members: DataFrame, codes: list[str]) -> DataFrame:
    """One row per instrument over several snapshots (code, instrument_id, primary_class): a flag per code, and primary only if everywhere."""
    flags = [F.bool_or(F.col("code") == c).alias(f"in_{c.lower()}") for c in codes]
    return members.groupBy("instrument_id").agg(*flags, F.bool_and("primary_class").alias("primary_class"))


def primary_class(instruments: DataFrame) -> DataFrame:
    """The primary liquid class of each issuer: a primary one first, then by symbol."""
    return latest_per(instruments, ["issuer_id"], [F.desc("primary_class"), F.asc("symbol")])


def reconcile_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of two indices, and whether their classes disagree."""
    x, y = a.alias("x"), b.alias("y")
    return x.join(y, F.col("x.instrument_id") == F.col("y.instrument_id")).select("x.instrument_id", (~F.col("x.share_class").eqNullSafe(F.col("y.share_class"))).alias("conflict"))


def without_one_primary(instruments: DataFrame) -> DataFrame:
    """Issuers that don't have exactly one primary class."""
    return instruments.groupBy("issuer_id").agg(F.count("*").alias("members"), F.count_if("primary_class").alias("primaries")).filter("primaries <> 1")


def apply_renames(current: DataFrame, actions: DataFrame) -> DataFrame:
    """Keys with the new symbol of their rename."""
    return current.join(actions, "key").select("key", F.col("new_symbol").alias("symbol"))


def link_identifiers(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """What to do with each incoming identifier: NEW, SAME, or CONFLICT with another instrument."""
    outcome = F.when(F.col("held").isNull(), "NEW").when(F.col("held") == F.col("instrument_id"), "SAME").otherwise("CONFLICT")
    return incoming.join(current, "identifier", "left").select("identifier", "instrument_id", outcome.alias("outcome"))


def only_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming keys that aren't there yet, once each."""
    return incoming.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti")


def resolve_members(members: DataFrame, by_figi: DataFrame, by_cik: DataFrame) -> DataFrame:
    """Members with an instrument: by FIGI, else by CIK; ``conflict`` where the two disagree, ``is_new`` where neither is known."""
    met = members.join(by_figi.select("figi", F.col("instrument_id").alias("_f")), "figi", "left").join(by_cik.select("cik", F.col("instrument_id").alias("_c")), "cik", "left")
    both = F.coalesce(F.col("_f") != F.col("_c"), F.lit(False))
    return met.withColumn("instrument_id", F.coalesce("_f", "_c")).withColumn("conflict", both).withColumn("is_new", F.col("_f").isNull() & F.col("_c").isNull()).drop("_f", "_c")


def resolve_listings(members: DataFrame, listings: DataFrame) -> DataFrame:
    """Members (symbol) with the registrant of their listing; a symbol listed for several registrants resolves to none."""
    one = listings.groupBy("symbol").agg(F.count_distinct("cik").alias("_n"), F.min("cik").alias("cik"), F.min("legal_name").alias("legal_name"))
    return members.join(one, "symbol", "left").withColumn("ambiguous", F.coalesce(F.col("_n") > 1, F.lit(False))).withColumn("cik", F.when(~F.col("ambiguous"), F.col("cik"))).drop("_n")
