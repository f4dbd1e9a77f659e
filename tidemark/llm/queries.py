"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, language, lexical, lm, packing, pieces, quality, sharding, simhash, spelling, topk, toxicity, urls
from tidemark.llm.common import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_turns(chat.with_injection(table(spark, sf_dir, "conversations"))))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under the counts of all other documents."""
    return lm.backoff_scores(table(spark, sf_dir, "documents"), apart=True)


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(topk.whole_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url under the query's rules, else by its host's trust and distrust."""
    return urls.digest(table(spark, sf_dir, "pages"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the vocabulary with its more frequent form and the end of its chain of forms."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every operator over its whole table."""
    return {f.__name__: f for f in (op1_chat_format, op2_sharding, op3_best_fit_packing, op4_language_id, op5_simhash, op6_lm_scores, op7_piece_sampling, op8_exact_top_k, op9_quality_rules, op10_toxicity, op11_url_filters, op12_spelling_variants, op13_lexical_search)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat.DIGEST_SQL, "op8_exact_top_k": topk.SEARCH_SQL, "op11_url_filters": urls.JUDGE_SQL, "op12_spelling_variants": spelling.VARIANTS_SQL, "op13_lexical_search": lexical.SEARCH_SQL}
