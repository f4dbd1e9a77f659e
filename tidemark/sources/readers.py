"""Sources: files and stored documents to typed rows. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIVERSE = "symbol STRING, legal_name STRING, cik STRING, figi STRING, exchange_mic STRING, security_type STRING, share_class STRING, currency STRING, domicile STRING, sic STRING, source_classification STRING, mapped_sector STRING, primary_liquid_class STRING"
PANEL = "signal_at STRING, knowledge_at STRING, execution_at STRING, next_session_open STRING, exit_at STRING, forward_end STRING, instrument_id STRING, sector STRING, profile STRING, score DOUBLE, total_return DOUBLE, forward_6m DOUBLE, market_cap DOUBLE, expected_count INT"
FACT = "start STRING, `end` STRING, val DOUBLE, accn STRING, filed STRING, form STRING"
COMPANY_FACTS = f"cik BIGINT, facts MAP<STRING, MAP<STRING, STRUCT<units: MAP<STRING, ARRAY<STRUCT<{', '.join(f'{a}: {b}' for a, b in (x.strip().split(' ') for x in FACT.split(',')))}>>>>>>"
BAR = "ARRAY<STRUCT<t: STRING, o: DOUBLE, h: DOUBLE, l: DOUBLE, c: DOUBLE, v: BIGINT, n: BIGINT, vw: DOUBLE>>"
FORMS = ["10-K", "10-Q", "10-K/A", "10-Q/A"]


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str], sep: str = ",") -> DataFrame:
    """A file with a header line; ragged rows fail, and so does a header without the ``required`` columns."""
    header = spark.read.option("header", True).option("sep", sep).csv(path).columns
    names = [c.lstrip("﻿").strip() for c in header]
    if lost := [c for c in required if c not in names]:
        raise ValueError(f"{path} lacks {', '.join(lost)}")
    kinds = {f.name: f.dataType for f in T._parse_datatype_string(f"struct<{schema}>").fields}
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(text).option("header", True).option("enforceSchema", True).option("sep", sep).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(path)
    return rows.select(*(F.col(n).cast(kinds[n]).alias(n) if n in kinds else F.col(n) for n in names))


def truth(text: Column) -> Column:
    """Booleans as files write them; blank is true."""
    return F.coalesce(F.nullif(F.lower(F.trim(text)), F.lit("")), F.lit("true")).isin("true", "1", "yes", "y", "t")


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Dated universe file."""
    rows = read_csv(spark, path, UNIVERSE, ["symbol", "legal_name", "cik", "exchange_mic"])
    return rows.withColumn("primary_liquid_class", truth(F.col("primary_liquid_class")) if "primary_liquid_class" in rows.columns else F.lit(True))


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation panel file; its times must state their offsets."""
    return read_csv(spark, path, PANEL, [f.split()[0] for f in PANEL.split(", ")])


def read_table(spark: SparkSession, schema: str, path: str | None = None, **jdbc: str) -> DataFrame:
    """A table of a fixed schema, from Parquet or, split by ``partitionColumn``, over JDBC."""
    if path:
        return spark.read.schema(schema).parquet(path)
    rows = spark.read.format("jdbc").options(**jdbc).load()
    return rows.select(*(F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(f"struct<{schema}>").fields))


def company_facts(documents: DataFrame, submissions: DataFrame, concepts: list[str], first: str, last: str) -> DataFrame:
    """Facts of stored registrant documents (column ``document``), of known concepts and forms, filed within a window, with their submission's acceptance time.

    A fact whose accession has no submission keeps a null ``accepted``. A form that disagrees with the submission's fails the job when the fact is read.
    """
    parsed = documents.select(F.from_json("document", COMPANY_FACTS).alias("d"))
    taxa = parsed.select("d.cik", F.explode("d.facts").alias("taxonomy", "c"))
    named = taxa.select("cik", "taxonomy", F.explode("c").alias("concept", "x")).filter(F.col("concept").isin(concepts))
    units = named.select("cik", "taxonomy", "concept", F.explode("x.units").alias("unit", "f"))
    rows = units.select("cik", "taxonomy", "concept", "unit", F.explode("f").alias("f")).select("cik", "taxonomy", "concept", "unit", F.to_date("f.start").alias("period_start"), F.to_date("f.end").alias("period_end"), F.col("f.val").alias("value"), F.col("f.accn").alias("accession"), F.to_date("f.filed").alias("filed_date"), F.col("f.form").alias("form"))
    kept = rows.filter(F.col("form").isin(FORMS) & F.col("filed_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    known = submissions.select("accession", F.col("form").alias("_form"), "accepted")
    met = kept.join(known, "accession", "left")
    wrong = F.raise_error(F.concat(F.lit("form of "), "accession", F.lit(" disagrees with its submission"))).cast("string")
    return met.withColumn("form", F.when(F.col("_form").isNull() | (F.col("_form") == F.col("form")), F.col("form")).otherwise(wrong)).drop("_form")


def zip_submissions(catalog: DataFrame) -> DataFrame:
    """Rows of a catalog stored as parallel arrays (accession, form, accepted, report_date); arrays of unequal length give an ``error`` row."""
    arrays = ["accession", "form", "accepted", "report_date"]
    ragged = F.array_max(F.array(*(F.size(a) for a in arrays))) != F.array_min(F.array(*(F.size(a) for a in arrays)))
    whole = catalog.filter(~ragged).select(F.explode(F.arrays_zip(*arrays)).alias("r")).select("r.*", F.lit(None).cast("string").alias("error")).distinct()
    clash = whole.groupBy("accession").agg(F.count("*").alias("_n")).filter("_n > 1").select("accession")
    fine = whole.join(clash, "accession", "left_anti").select(*arrays, "error")
    bad = clash.select("accession", *(F.lit(None).cast("string").alias(a) for a in arrays[1:]), F.lit("CONFLICTING_SUBMISSION").alias("error"))
    torn = catalog.filter(ragged).select(*(F.lit(None).cast("string").alias(a) for a in arrays), F.lit("RAGGED_CATALOG").alias("error"))
    return fine.unionByName(bad).unionByName(torn)


def read_call_report(spark: SparkSession, path: str, entities: DataFrame, concepts: list[str]) -> DataFrame:
    """Tab-separated bulk report: one row per entity and concept; rows without a numeric entity number (a description line) go, a repeated entity fails the contract."""
    raw = spark.read.option("header", True).option("sep", "\t").option("mode", "FAILFAST").csv(path)
    held = [c for c in concepts if c in raw.columns]
    rows = raw.filter(F.col("IDRSSD").rlike("^[0-9]+$")).select(F.col("IDRSSD").cast("long").alias("rssd"), *held)
    again = rows.groupBy("rssd").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("rssd").alias("_again"))
    wrong = F.raise_error(F.concat(F.lit("entity "), F.col("rssd").cast("string"), F.lit(" comes more than once"))).cast("long")
    single = rows.join(again, F.col("rssd") == F.col("_again"), "left").withColumn("rssd", F.when(F.col("_again").isNull(), F.col("rssd")).otherwise(wrong)).drop("_again")
    long = single.unpivot("rssd", held, "concept", "value")
    return long.filter("value IS NOT NULL").withColumn("value", F.col("value").cast("double")).join(entities, "rssd")


def parse_bars(pages: DataFrame) -> DataFrame:
    """Daily bars of stored pages (column ``document``): symbol to list of bars. A bar without trades has no average price."""
    lists = pages.select(F.explode(F.from_json("document", f"bars MAP<STRING, {BAR}>")["bars"]).alias("symbol", "b"))
    b = lists.select("symbol", F.explode("b").alias("b"))
    idle = (F.col("b.v") == 0) & (F.col("b.n") == 0) & (F.col("b.vw") == 0)
    return b.select("symbol", F.to_timestamp("b.t").alias("time"), F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.v").alias("volume"), F.when(~idle, F.col("b.vw")).alias("vwap"))


def parse_actions(pages: DataFrame) -> DataFrame:
    """Corporate actions of stored pages (document, request_date): a row per action with its subject, the first symbol named; those processed another day go."""
    kinds = "corporate_actions MAP<STRING, ARRAY<MAP<STRING, STRING>>>"
    lists = pages.select("request_date", F.explode(F.from_json("document", kinds)["corporate_actions"]).alias("kind", "a"))
    one = lists.select("request_date", "kind", F.explode("a").alias("a"))
    subject = F.coalesce(*(F.col("a")[k] for k in ("symbol", "old_symbol", "source_symbol", "acquiree_symbol")))
    return one.select("kind", subject.alias("subject"), F.to_date(F.col("a")["process_date"]).alias("process_date"), "request_date", F.col("a").alias("terms")).filter(F.col("process_date") == F.col("request_date"))


def parse_overview(documents: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Fields of a flat document in which all values are text; empty, ``None`` and ``-`` are null. A value that isn't of its type is null and named in ``errors``."""
    parsed = documents.withColumn("_o", F.from_json("document", ", ".join(f"`{f}` STRING" for f in fields)))
    text = {f: F.trim(F.col("_o")[f]) for f in fields}
    clean = {f: F.when(~t.isin("", "None", "-"), t) for f, t in text.items()}
    cast = {f: clean[f].try_cast(k) for f, k in fields.items()}
    errors = F.array_compact(F.array(*(F.when(clean[f].isNotNull() & cast[f].isNull(), F.lit(f)) for f in fields)))
    return parsed.select(*documents.columns, *(cast[f].alias(f) for f in fields), errors.alias("errors"))


def read_archive(spark: SparkSession, path: str, schema: str, hashes: DataFrame) -> DataFrame:
    """Stored run documents (name, sha256, parsed document) that ``hashes`` (name, sha256) vouches for. A document whose bytes have another hash, or none, fails the job."""
    raw = spark.read.format("binaryFile").load(path)
    held = raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.from_json(F.decode("content", "UTF-8"), schema).alias("document"))
    met = held.join(hashes.select("name", F.col("sha256").alias("_sha")), "name", "left")
    wrong = F.raise_error(F.concat(F.lit("bytes of "), "name", F.lit(" differ from their hash"))).cast("string")
    return met.select("name", F.when(F.col("sha256").eqNullSafe(F.col("_sha")), F.col("sha256")).otherwise(wrong).alias("sha256"), "document")


def source_components(facts: DataFrame, documents: DataFrame, schema: str, on: list[str]) -> DataFrame:
    """Facts with the parts of the stored document (column ``document``, an array of structs of ``schema``) that they were made from: parts become rows, which meet facts on ``on`` by equality."""
    parts = documents.select(F.explode(F.from_json("document", f"ARRAY<STRUCT<{schema}>>")).alias("p")).select("p.*")
    return facts.join(parts, on)
