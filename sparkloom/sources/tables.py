"""The driver's Parquet tables and the columns that queries derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tagged(prefix: str, number: object) -> object:
    return F.concat(F.lit(prefix), number.cast("string"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with tenant, visibility, ownership, access lists and status by formula on the id."""
    i = F.col("doc_id")
    empty = F.array().cast("array<string>")
    return read(spark, sf_dir, "documents").withColumns(
        {
            "tenant_id": tagged("t", i % 4),
            "visibility": F.element_at(F.array(*map(F.lit, ("public", "tenant", "group", "private"))), (F.floor(i / 4) % 4 + 1).cast("int")),
            "owner_id": tagged("u", i % 25),
            "allowed_groups": F.array(tagged("g", i % 5)),
            "allowed_users": F.array(tagged("u", i % 7)),
            "denied_users": F.when(i % 11 == 0, F.array(F.lit("u3"))).otherwise(empty),
            "denied_groups": F.when(i % 13 == 0, F.array(F.lit("g1"))).otherwise(empty),
            "status": F.when(i % 17 == 0, "deleted").otherwise("active"),
        }
    )


#: The same columns in DuckDB, as the CTE ``d``.
DOCUMENTS_SQL = """d AS (SELECT *, 't' || (doc_id % 4) AS tenant_id,
  list_extract(['public', 'tenant', 'group', 'private'], ((doc_id // 4) % 4 + 1)::INT) AS visibility,
  'u' || (doc_id % 25) AS owner_id, ['g' || (doc_id % 5)] AS allowed_groups, ['u' || (doc_id % 7)] AS allowed_users,
  CASE WHEN doc_id % 11 = 0 THEN ['u3'] ELSE []::VARCHAR[] END AS denied_users,
  CASE WHEN doc_id % 13 = 0 THEN ['g1'] ELSE []::VARCHAR[] END AS denied_groups,
  CASE WHEN doc_id % 17 = 0 THEN 'deleted' ELSE 'active' END AS status FROM documents)"""


def with_event_columns(rows: DataFrame) -> DataFrame:
    """Events, a table or a stream, as usage, audit, feedback, latency and job rows."""
    return rows.withColumns(
        {
            "tenant_id": tagged("t", F.col("user_id") % 4),
            "model": tagged("m", F.col("event_id") % 3),
            "day": F.to_date("ts"),
            "good": F.col("event_type") != "error",
            "tokens": F.get_json_object("props", "$.k").cast("bigint"),
            "latency_ms": F.col("value") * 10,
            "rating": (F.col("event_id") % 5 + 1).cast("int"),
        }
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_event_columns(read(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = read(spark, sf_dir, "events").schema
    return with_event_columns(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


EVENTS_SQL = """e AS (SELECT *, 't' || (user_id % 4) AS tenant_id, 'm' || (event_id % 3) AS model, ts::DATE AS day,
  event_type <> 'error' AS good, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, value * 10 AS latency_ms,
  (event_id % 5 + 1)::INT AS rating FROM events)"""
