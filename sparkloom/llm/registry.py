"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, exact_dedup, language_id, line_dedup, mixing, ngram_join, ppm, prefix_trie, quality, substring_dedup, url_filter, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), mixing.TARGETS, mixing.production_dims())
    return out.withColumn("probability", F.round("probability", 6))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.RULES).drop("component")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("reasons")


def op4_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.ppm_scores(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), digests=True)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_digests(warc.round_trip(table(spark, sf_dir, "pages")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("clean_text", 256).alias("clean_sha256"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), digests=True)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), hash_all=True)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations")).drop("preorder", "subtree_end")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_of_them = (
        op1_mixing, op2_url_filter, op3_quality_rules, op4_ppm_scoring, op5_substring_dedup, op6_warc, op7_line_dedup, op8_bpe, op9_ngram_join, op10_exact_dedup,
        op11_prefix_trie, op12_language_id, op13_whitening,
    )
    return {f.__name__: f for f in all_of_them}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.mix_sql(),
        "op2_url_filter": url_filter.URL_SQL,
        "op3_quality_rules": quality.quality_sql(),
        "op5_substring_dedup": substring_dedup.REPEAT_SQL,
        "op6_warc": warc.WARC_SQL,
        "op7_line_dedup": line_dedup.LINE_SQL,
        "op10_exact_dedup": exact_dedup.EXACT_SQL,
        "op11_prefix_trie": prefix_trie.TRIE_SQL,
    }
