"""Corpus pipeline: toxic documents go, then those without a recognisable language, then near copies; what stays is packed into sequences.

Each stage works on all rows that the one before kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, packing, simhash, toxicity
from tidemark.llm.common import cut, fresh, table
from tidemark.llm.queries import tokenizer_path

#: Under this score a language is a guess.
UNSURE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the toxic threshold, by a lexicon learned from the labels of those not held out."""
    out = fresh(docs, "_toxicity")
    rated = toxicity.with_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), out)
    return rated.filter(F.col(f"{out}.score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: texts without a letter and toss-ups go."""
    model = language.train(docs.filter(~language.held_out(F.col("doc_id"))))
    out = fresh(docs, "_language")
    known = language.with_language(docs, model, out)
    return known.filter((F.col(f"{out}.lang_pred") != language.UNDETERMINED) & (F.col(f"{out}.score") >= UNSURE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.one_of_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.packed_digest(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("language_id", drop_unknown_language), ("near_dedup", drop_near_copies), ("packing", pack_sequences)]

#: The learned stages have no form in SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what stays between two of them is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
