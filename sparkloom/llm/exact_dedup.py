"""Exact dedup by progressive refinement: length, prefix hash, full hash [native]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .removal import filter_of, survives, without
from .scratch import Write, materialize, temporary

PREFIX_CHARS = 256


def normalized(text: Column) -> Column:
    """White-space runs become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def row_key(id_col: str, text_col: str) -> Column:
    """The same for rows of one id and one text."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _hashed(docs: DataFrame, id_col: str, text_col: str, hash_all: bool, filter_bits: int | None, write: Write) -> DataFrame:
    """(id, key, length, alive, sha) of each row: three levels, the last one for survivors only."""
    base = docs.select(F.col(id_col).alias("__id"), row_key(id_col, text_col).alias("__key"), normalized(F.col(text_col)).alias("__text")).withColumn(
        "__len", F.octet_length("__text").cast("bigint")
    )
    prefix = F.xxhash64("__len", F.substring("__text", 1, PREFIX_CHARS))
    keys = write(base.select("__len", prefix.alias("__prefix")), "exact-keys")
    lengths = write(keys.groupBy("__len").count().filter("count > 1").select("__len"), "exact-lengths")
    alive = survives(keys, "__len", *filter_of(lengths, "__len", write, "exact-length-filter", filter_bits)).filter("__alive")
    pairs = write(alive.groupBy("__len", "__prefix").count().filter("count > 1").select("__prefix"), "exact-prefixes")
    flagged = survives(base.withColumn("__prefix", prefix), "__prefix", *filter_of(pairs, "__prefix", write, "exact-filter", filter_bits))
    sha = F.sha2("__text", 256)
    return flagged.select("__id", "__key", "__alive", (sha if hash_all else F.when(F.col("__alive"), sha)).alias("__sha"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False, filter_bits: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each input row.

    Pass one reads each text once and keeps two numbers, length and prefix
    hash.  Lengths met twice, then (length, prefix) pairs met twice, leave a
    bit in filters sized by their count.  Pass two hashes in full only the rows
    whose bit is set; ``text_sha256`` is null elsewhere unless ``hash_all``.  A
    filter collision only lets a row go on to the next level, so results are
    exact.  No text is shuffled.

    Nulls and empty texts are equal to each other; a null id sorts after all
    others (a group of null ids only has a null ``keep_id``); repeated rows
    count in ``group_size`` and all rows that carry the smallest id are kept;
    empty tables give empty results; other columns are ignored, whatever their
    names.
    """
    with temporary(docs.sparkSession) as write:
        light = materialize(_hashed(docs, id_col, text_col, hash_all, filter_bits, write).drop("__key"), "exact-light")
    groups = materialize(
        light.filter("__alive").groupBy("__sha").agg(F.min("__id").alias("__keep"), F.count(F.lit(1)).alias("__size")).filter("__size > 1"),
        "exact-groups",
    )
    met = light.filter("__alive").join(groups.hint("merge"), "__sha", "left").select(
        "__id",
        F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__keep")).alias("__keep"),
        F.coalesce("__size", F.lit(1)).cast("bigint").alias("__size"),
        "__sha",
    )
    alone = light.filter("not __alive").select("__id", F.col("__id").alias("__keep"), F.lit(1).cast("bigint").alias("__size"), "__sha")
    return met.unionAll(alone).select(
        F.col("__id").alias("doc_id"),
        F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each group of equal texts: that of the smallest id.

    Decided row by row: of rows that carry the smallest id one stays, the one
    with the smallest row key; of rows equal in id and text any one.  Nulls are
    as in ``exact_duplicates``.  All columns are kept.  Texts without a
    duplicate are neither hashed in full nor shuffled.
    """
    with temporary(docs.sparkSession) as write:
        light = write(_hashed(docs, id_col, text_col, False, None, write).filter("__alive").drop("__alive"), "exact-light")
        order = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__key").alias("key"))
        groups = write(light.groupBy("__sha").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "exact-groups")
        stays = (F.col("__key") == F.col("first.key")) & F.col("__id").eqNullSafe(F.col("first.id"))
        rows = light.join(groups.hint("merge"), "__sha").select("__id", "__key", stays.alias("stays"))
        counted = rows.groupBy("__id", "__key").agg(F.bool_or("stays").alias("once"), F.count(F.lit(1)).alias("n")).filter("not once or n > 1")
        gone = materialize(counted.select(F.col("__id").alias("id"), F.col("__key").alias("key"), "once"), "exact-gone")
    return without(docs, id_col, row_key(id_col, text_col), gone, materialize)


EXACT_SQL = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
"""
