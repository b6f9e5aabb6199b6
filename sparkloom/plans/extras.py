"""Smaller operators: analyzers, hit metadata, multi-query retrieval, guardrail checks, prompts, maps, evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import filters as fl, spans, stemming, text as tx
from ..operators import fusion, search, vector_index
from ..sources.shared import kept
from ..sources.tables import DOCUMENTS_SQL as D, EVENTS_SQL as E, documents, events, read
from .catalog import query
from .pipelines import _scratch
from .retrieval import MEMBER, _MULTI, _access_sql, _multi, corpus, request_vectors
from .textual import Q, _any, q, requests


_STOPS = ", ".join(f"'{w}'" for w in search.STOP_WORDS)


@query(
    "b03_stemmed_analyzer",
    r"WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM documents), "
    f"u AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM t), v AS (SELECT DISTINCT w FROM u), {stemming.stem_sql('v')}, "
    f"k AS (SELECT doc_id, list(stem ORDER BY pos) AS stems FROM u JOIN stemmed USING (w) WHERE stem NOT IN ({_STOPS}) GROUP BY 1) "
    "SELECT t.doc_id, CASE WHEN t.ws IS NOT NULL THEN coalesce(k.stems, []) END AS stems FROM t LEFT JOIN k ON t.doc_id = k.doc_id",
)
def b03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second analyzer: lower case, English stems, stop words off."""
    return read(spark, sf_dir, "documents").select("doc_id", stemming.stemmed_tokens(F.col("text"), search.STOP_WORDS).alias("stems"))


# Keys of a stored document that are no metadata.
RESERVED = (
    "chunk_id", "document_id", "tenant_id", "content", "title", "source_uri", "source_type", "chunk_index", "visibility", "owner_id",
    "allowed_groups", "allowed_users", "created_at",
)


@query("b05_hit_metadata", "SELECT doc_id, lang, source FROM documents")
def b05(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.create_map(F.lit("content"), "text", F.lit("title"), F.lit("t"), F.lit("lang"), "lang", F.lit("source"), "source")
    meta = F.map_filter(hit, lambda k, _: ~k.isin(*RESERVED))
    return read(spark, sf_dir, "documents").select("doc_id", meta["lang"].alias("lang"), meta["source"].alias("source"))


@query("r02_rrf_score", "SELECT event_id, round(1.0 / (60 + event_id % 50), 6) AS score FROM events")
def r02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.round(fusion.rrf_score(F.col("event_id") % 50), 6).alias("score"))


@query(
    "r19_multi_query_retrieve",
    f"WITH {_MULTI}, {D}, a AS (SELECT query_id, id, max(score) AS score FROM m GROUP BY 1, 2), v AS (SELECT a.* FROM a JOIN d ON id = doc_id WHERE {_access_sql(MEMBER, False)}) "
    "SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM v) WHERE n <= 10",
)
def r19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice the depth for each query, best score of each id, access, then the cut."""
    merged = fusion.aggregate_lists(_multi(spark, sf_dir), "max")
    seen = merged.join(documents(spark, sf_dir).withColumnRenamed("doc_id", "id"), "id").filter(fl.acl_can_access(MEMBER, check_tenant=False))
    return search.top_k(seen.select("query_id", "id", "score"), 10).select("query_id", "id", F.round("score", 6).alias("score"))


@query("j11_rerank_remap", f"WITH {_MULTI} SELECT query_id, id, round(max(score), 6) AS score, label FROM m JOIN embeddings ON id = vec_id GROUP BY 1, 2, 4")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New scores joined back by id; the other columns stay."""
    rescored = search.best_per_id(_multi(spark, sf_dir))
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return rows.join(rescored, "id").select("query_id", "id", F.round("score", 6).alias("score"), "label")


@query("x08_passages_for_embedding", f"WITH {Q} SELECT conv_id, turn, [q, 'A passage that answers: ' || q] AS inputs FROM q")
def x08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline generator restates the request; its passages join the embedding inputs."""
    return requests(spark, sf_dir).select("conv_id", "turn", F.array(q(), F.concat(F.lit("A passage that answers: "), q())).alias("inputs"))


def sub_questions(text: Column) -> Column:
    """A JSON list of strings, else numbered or bulleted lines."""
    listed = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:[0-9]+[.)]|[-*])\s*(.+)$"), 1)
    return F.coalesce(F.from_json(text, "array<string>"), listed)


@query("x09_sub_questions", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN ['a ' || turn, 'b'] ELSE ['first ' || role, 'second'] END AS questions FROM conversations")
def x09(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn").cast("string")
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('["a '), t, F.lit('", "b"]'))).otherwise(F.concat(F.lit("Here:\n1. first "), "role", F.lit("\n- second")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", sub_questions(raw).alias("questions"))


@query("x15_guardrail_pii")
def x15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by type in order; a span that overlaps an earlier one is no find."""
    patterns = {kind: "(?U)" + p for kind, p in tx.PII.items()}  # word letters of any script
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(spans.first_come_spans(F.col("text"), patterns)).alias("x"))
    return rows.select("doc_id", "x.kind", "x.start", "x.stop")


_LINE_JSON = """'{"user":{"name":"u' || user_id || '","api-key":"***"},"auth_token":"***","tags":{"kind":"' || event_type || '","Database_URL":"***"},"calls":[{"path":"/' || event_type || '","credential":"***"}]}'"""


@query("x41_masked_keys", f"SELECT event_id, {_LINE_JSON} AS line FROM events")
def x41(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines as nested values; sensitive names are found in structs, maps and lists alike."""
    who = F.col("user_id").cast("string")
    line = F.struct(
        F.struct(F.concat(F.lit("u"), who).alias("name"), who.alias("api-key")).alias("user"),
        F.struct(who.alias("jwt")).alias("auth_token"),
        F.create_map(F.lit("kind"), "event_type", F.lit("Database_URL"), who).alias("tags"),
        F.array(F.struct(F.concat(F.lit("/"), "event_type").alias("path"), F.col("value").alias("credential"))).alias("calls"),
    )
    rows = read(spark, sf_dir, "events").select("event_id", line.alias("line"))
    return rows.select("event_id", F.to_json(tx.masked(F.col("line"), rows.schema["line"].dataType)).alias("line"))


@query("x52_merged_config", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'redact' ELSE 'mask' END AS mode, 'en' AS language FROM events")
def x52(spark: SparkSession, sf_dir: str) -> DataFrame:
    defaults = F.create_map(F.lit("mode"), F.lit("mask"), F.lit("language"), F.lit("en"))
    override = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("mode"), F.lit("redact")))
    merged = F.map_zip_with(defaults, F.coalesce(override, F.create_map().cast("map<string,string>")), lambda _, a, b: F.coalesce(b, a))
    return read(spark, sf_dir, "events").select("event_id", merged["mode"].alias("mode"), merged["language"].alias("language"))


@query("x56_input_check", f"WITH {Q} SELECT conv_id, turn, CASE WHEN {_any('q', tx.INJECTIONS, '(?i)')} THEN 'blocked' WHEN " + " OR ".join(f"regexp_matches(q, '(?i){p}')" for p, _, _ in tx.HARMS) + " THEN 'blocked' ELSE 'passed' END AS verdict, left(trim(q), 100) AS clean FROM q")
def x56(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = tx.any_match(q(), tx.INJECTIONS, True) | tx.harm(q()).isNotNull()
    return requests(spark, sf_dir).select("conv_id", "turn", F.when(bad, "blocked").otherwise("passed").alias("verdict"), F.substring(F.trim(q()), 1, 100).alias("clean"))


@query("x58_prompt", f"WITH {Q} SELECT conv_id, turn, 'Context:' || chr(10) || role || chr(10) || 'Question: ' || q AS prompt FROM q")
def x58(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("conv_id", "turn", F.concat_ws("\n", F.lit("Context:"), "role", F.concat(F.lit("Question: "), q())).alias("prompt"))


@query("a23_run_metrics_map", f"WITH {E} SELECT model, round(avg(value), 6) AS mean, round(max(value), 6) AS high FROM e GROUP BY 1")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = events(spark, sf_dir).groupBy("model").agg(F.create_map(F.lit("mean"), F.avg("value"), F.lit("high"), F.max("value")).alias("metrics"))
    return runs.select("model", F.round(F.col("metrics")["mean"], 6).alias("mean"), F.round(F.col("metrics")["high"], 6).alias("high"))


@query("s15_evaluation_set", "SELECT item_id, text AS question FROM benchmark")
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation set out to JSON lines and in again."""
    path = _scratch(spark, "evaluation")
    read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question")).write.json(path)
    return spark.read.schema("item_id bigint, question string").json(path)


@query("k12_approximate_neighbours")
def k12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector against a kept index of all vectors; recall against the exact search is tested."""
    path = kept(spark, "vector-index", sf_dir, lambda p: vector_index.index_vectors(corpus(spark, sf_dir), p))
    hits = vector_index.search_index(spark, path, request_vectors(spark, sf_dir), 10)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))
