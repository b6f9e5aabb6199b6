"""Upserts, deletes and reconciliation as plans over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """The last version of each key; among equals the change wins."""
    both = table.withColumn("__side", F.lit(0)).unionByName(changes.withColumn("__side", F.lit(1)))
    order = W.partitionBy(*keys).orderBy(version.desc(), F.col("__side").desc())
    return both.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n", "__side")


def additive_upsert(table: DataFrame, changes: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Counters of equal keys added up."""
    return table.select(*keys, *counters).unionAll(changes.select(*keys, *counters)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def insert_new(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with new keys; of equal new keys one."""
    fresh = changes.dropDuplicates(keys).join(table, keys, "left_anti")
    return table.unionByName(fresh)


def delete(table: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(ids, keys, "left_anti")


def reindex(table: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """All old rows of the keys in ``fresh`` give way to its rows."""
    return delete(table, fresh.select(*keys).distinct(), keys).unionByName(fresh)


def overlay(table: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns of the change set where it has a value."""
    new = changes.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = table.join(new, keys, "left")
    return joined.withColumns({c: F.coalesce(f"__new_{c}", c) for c in columns}).drop(*[f"__new_{c}" for c in columns])


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that one store lacks: (key, issue)."""
    orphans = right.join(left, key, "left_anti").select(key, F.lit("orphan").alias("issue"))
    missing = left.join(right, key, "left_anti").select(key, F.lit("missing").alias("issue"))
    return missing.unionAll(orphans)
