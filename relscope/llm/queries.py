"""Queries of the operators: key -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relscope.llm import bpe, ego_join, lang_id, line_dedup, merkle, mixing, quality_mil, quality_rules, secrets, simhash, url_filter, warc, whitening
from relscope.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.mix_counts(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to ZIP-packaged WARC files and read back by ranges."""
    back = warc.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return lang_id.identify(docs.select("doc_id", "text"), lang_id.train(docs))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document, found through a new ledger."""
    return secrets.digest(secrets.scan_documents(table(spark, sf_dir, "documents", "doc_id", "text")))


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "text", F.col("__lines_gone").cast("long").alias("n_removed"))


def op6_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of each vector."""
    return ego_join.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def vocabulary_path() -> str:
    """Place of the byte-level vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document and what they decode to, as counts and hashes."""
    return bpe.digest(bpe.transcode(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path()))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and verdicts of each document."""
    return quality_rules.judge(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op10_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality_mil.score(docs, quality_mil.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of each vector on the leading components."""
    return whitening.components(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of each page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"), url_filter.train(url_filter.labelled_urls(spark)))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and folded root of each document."""
    return merkle.manifest(table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (
    op1_mix_sources, op2_warc_zip, op3_language_id, op4_secret_ledger, op5_fuzzy_lines, op6_simhash_pivots,
    op7_ego_join, op8_bpe_transducer, op9_host_rules, op10_attention_mil, op11_whitening, op12_url_filter, op13_merkle_manifest)}
