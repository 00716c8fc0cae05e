"""The registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from . import oracle
from .chunk_encode import encode_documents
from .exact_dedup import exact_duplicates
from .filter_audit import audit_filters
from .language_id import held_out, identify
from .lexical_search import search
from .license_scan import scan_licenses
from .mixing import mix
from .quality import quality_scores
from .repeats import remove_repeats
from .simhash import hex_fingerprint, near_duplicates
from .token_count import count_tokens
from .toxicity import toxicity
from .url_filter import judge_urls


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts, score and verdict of every document."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of near duplicates of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, docs.filter(~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document, and whether the document stays."""
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("row")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document by the 32k piece vocabulary."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that strings of 100 bytes repeat from earlier."""
    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document, by the 50k byte-level BPE."""
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the temperature mixture uses every document."""
    return mix(table(spark, sf_dir, "documents")).drop("row")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity(docs, docs.filter(~held_out(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order of applying them, and its Shapley value, by language."""
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality_rules, op2_simhash_near_dedup, op3_language_id, op4_exact_dedup, op5_url_filters, op6_token_counts, op7_suffix_array_dedup, op8_bpe_encoding, op9_license_scans, op10_temperature_mixing, op11_toxicity, op12_lexical_search, op13_filter_audit)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": oracle.EXACT_DEDUP, "op5_url_filters": oracle.url_filters(), "op9_license_scans": oracle.license_scans(), "op12_lexical_search": oracle.LEXICAL_SEARCH, "op13_filter_audit": oracle.FILTER_AUDIT}
