"""The registered queries of the corpus operators, each over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewire.llm import (bit_whitening, bloom_dedup, feistel_shards, licence_scan, line_winnow, ngram_join, piece_sampling,
                           pivotal_mix, prefix_trie, quality_rules, separator_scan, simhash_golay, sql, url_aliases)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark, sf_dir):
    return quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_token_counts(spark, sf_dir):
    return separator_scan.document_token_counts(_table(spark, sf_dir, "documents"))


def _deleted_lines(spark, sf_dir, **options):
    d = line_winnow.dedup_lines(_table(spark, sf_dir, "documents"), **options)
    return d.select("doc_id", "n_lines", "n_deleted", "deleted_runs", F.md5(F.col("text")).alias("text_md5"))


def op3_line_dedup(spark, sf_dir):
    return _deleted_lines(spark, sf_dir)


def op3_line_dedup_windows(spark, sf_dir):
    """op3 without the short runs: only runs of at least three lines."""
    return _deleted_lines(spark, sf_dir, min_words=None)


def op4_feistel_shards(spark, sf_dir):
    return feistel_shards.feistel_shards(_table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark, sf_dir):
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=85).select(
        "doc_id", "n_shingles", "component_id")


def op6_url_aliases(spark, sf_dir):
    return url_aliases.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_pivotal_mix(spark, sf_dir):
    return pivotal_mix.pivotal_mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op8_piece_sampling(spark, sf_dir):
    """The sampled segmentations with their ids (packed); their CRC-32 is derived from the ids."""
    return piece_sampling.sample_digests(_table(spark, sf_dir, "documents"))


def op9_licence_scan(spark, sf_dir):
    return licence_scan.licence_scan(_table(spark, sf_dir, "documents")).select("doc_id", "licence", "dice", "n_hits")


def op10_bloom_dedup(spark, sf_dir):
    return bloom_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op11_simhash_golay(spark, sf_dir):
    return simhash_golay.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_bit_whitening(spark, sf_dir):
    return bit_whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_token_counts, op3_line_dedup, op3_line_dedup_windows, op4_feistel_shards, op5_ngram_jaccard, op6_url_aliases,
    op7_pivotal_mix, op8_piece_sampling, op9_licence_scan, op10_bloom_dedup, op11_simhash_golay, op12_bit_whitening,
    op13_prefix_trie)}
ORACLE = sql.ORACLE
