"""Queries whose results depend on Python code or on streams: chunking, parsing, embedding, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators import chunking, embedding, quality_metrics
from ..sources import parsers
from ..sources.shared import kept, new_path as _scratch
from ..sources.tables import DOCUMENTS_SQL as D, EVENTS_SQL as E, documents, event_stream, events, read
from ..streaming import jobs
from .catalog import query


for _name, _strategy in (("c01_c02_recursive", "recursive"), ("c05_c06_semantic", "semantic"), ("c09_hierarchical", "hierarchical"), ("c10_c11_qa", "qa"), ("c12_c14_tabular", "tabular"), ("c16_mixed", "mixed"), ("c19_auto", None)):

    def _run(spark: SparkSession, sf_dir: str, strategy: str | None = _strategy) -> DataFrame:
        return chunking.chunk(read(spark, sf_dir, "documents"), strategy)

    query(f"{_name}_chunks")(_run)


@query("s05_s08_parse_pages")
def s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parsers.parse(read(spark, sf_dir, "pages"), F.col("page_id"), F.col("html"), F.lit("html"))
    return parsed.select("source_id", "title", F.size("blocks").alias("blocks"), F.size("links").alias("links"), F.length("text").alias("chars"))


@query("s12_page_broken_text")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    parsed = parsers.parse(docs, F.col("doc_id"), F.translate("text", "\n", "\f"), F.lit("pdf"))
    return parsed.select("source_id", F.col("meta")["page_count"].cast("int").alias("pages"), F.length("text").alias("chars"))


@query("s01_s04_list_files")
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of the tables as a listing: name, extension, size; contents are not read."""
    return parsers.list_files(spark, sf_dir, ("PARQUET",)).select("name", "extension", "size")


@query("v09_v10_embed")
def v09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all documents by the model learned from them; encoded in groups of at most 32, failures are tried again."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    path = kept(spark, "word-vectors", sf_dir, lambda p: embedding.fit_word_vectors(docs, p))
    return embedding.embed(docs, embedding.load_word_vectors(spark, path))


_USAGE = f"WITH {E} SELECT tenant_id, day, model, sum(tokens)::BIGINT AS tokens FROM e GROUP BY 1, 2, 3"


@query("z01_stream_usage_flush", _USAGE)
def z01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches flushed under their batch id, then added up."""
    path = _scratch(spark, "usage")
    jobs.flush_usage(event_stream(spark, sf_dir), path, _scratch(spark, "state")).awaitTermination()
    return spark.read.parquet(path).groupBy("tenant_id", "day", "model").agg(F.sum("tokens").alias("tokens"))


@query("s02_fetch_files", "SELECT 'nation' AS name, true AS found, count(*) AS rows FROM nation UNION ALL SELECT 'region', true, count(*) FROM region UNION ALL SELECT 'nowhere', false, NULL")
def s02f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files by id, one of which is not there: their bytes are written elsewhere and read back as tables."""
    files = parsers.list_files(spark, sf_dir, ("parquet",)).filter(F.col("name").isin("nation.parquet", "region.parquet"))
    base = files.select(F.max(F.regexp_replace("source_id", "[^/]+$", ""))).first()[0]
    names = ("nation", "region", "nowhere")
    wanted = spark.createDataFrame([(f"{base}{n}.parquet", n) for n in names], "source_id string, name string")
    found = parsers.fetch_many(files, wanted).join(F.broadcast(wanted), "source_id")
    # A Parquet file ends with the length of its footer and its mark; whole files have both.
    whole = found.withColumn("whole", F.expr("substring(content, -4)") == F.lit(b"PAR1"))
    counts = [read(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n in names[:2]]
    return whole.select("name", (F.col("found") & F.coalesce("whole", F.lit(False))).alias("found")).join(counts[0].unionAll(counts[1]), "name", "left")


def _complete(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """The last complete result of a streaming aggregate."""
    path = _scratch(spark, "complete")
    sink = stream.writeStream.outputMode("complete").option("checkpointLocation", _scratch(spark, "state")).trigger(availableNow=True)
    sink.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return spark.read.parquet(path)


def _appended(stream: DataFrame, spark: SparkSession) -> DataFrame:
    path = _scratch(spark, "append")
    sink = stream.writeStream.format("parquet").option("checkpointLocation", _scratch(spark, "state")).trigger(availableNow=True)
    sink.start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("z02_stream_running_usage", _USAGE)
def z02s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _complete(jobs.usage_totals(event_stream(spark, sf_dir)), spark)


@query("z06_stream_windows", f"WITH {E} SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, count(*) FILTER (good) AS good FROM e GROUP BY 1, 2")
def z06s(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _complete(jobs.windowed_counts(event_stream(spark, sf_dir)), spark)
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("z05_stream_sliding_windows")
def z05s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours sliding by a quarter, as they close; the last ones stay open."""
    return _appended(jobs.windowed_counts(event_stream(spark, sf_dir), "1 hour", "1 hour", "15 minutes"), spark)


@query("z15_stream_sessions")
def z15s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _appended(jobs.sessions(event_stream(spark, sf_dir)), spark)


@query("z07_stream_token_bucket")
def z07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _appended(jobs.token_bucket(event_stream(spark, sf_dir), 1 / 3600, 3), spark)


@query("z08_stream_circuit_breaker")
def z08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _appended(jobs.circuit_breaker(event_stream(spark, sf_dir)), spark)


@query("z03_stream_token_buffer")
def z03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _appended(jobs.token_buffer(event_stream(spark, sf_dir), 4, 3_600_000), spark)


@query("z13_z18_invalidation", f"WITH {D} SELECT doc_id, tenant_id FROM d WHERE doc_id % 7 <> 0 AND tenant_id <> 't3'")
def z13(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", "tenant_id")
    named = d.filter("doc_id % 7 = 0").withColumn("tenant_id", F.lit(None).cast("string"))
    whole = spark.createDataFrame([(None, "t3")], "doc_id bigint, tenant_id string")
    return jobs.invalidate(d, named.unionByName(whole)).select("doc_id", "tenant_id")


@query("z17_store_sizes", "SELECT 'documents' AS store, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def z17(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [read(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("store"), "n") for t in ("documents", "embeddings")]
    return parts[0].unionAll(parts[1])


@query("k01_k05_k06_index_three_ways", "SELECT 'chunks' AS sink, count(*) AS n FROM documents UNION ALL SELECT 'postings', count(*) FROM (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS t FROM documents) WHERE t <> '' UNION ALL SELECT 'vectors', count(*) FROM embeddings")
def k01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, postings and vectors written side by side; a failing sink is reported and the others stay."""
    docs = read(spark, sf_dir, "documents")
    terms = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("term")).filter("term <> ''")
    sinks = {"chunks": docs.select("doc_id", "text"), "postings": terms, "vectors": read(spark, sf_dir, "embeddings")}
    base = _scratch(spark, "index")
    for name, frame in sinks.items():
        frame.write.parquet(f"{base}/{name}")
    parts = [spark.read.parquet(f"{base}/{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("sink"), "n") for n in sinks]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("k11_export_json_csv", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def k11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows out as CSV and JSON, and read back."""
    base = _scratch(spark, "export")
    rows = events(spark, sf_dir).select("event_id", "event_type")
    rows.filter("event_id % 2 = 0").write.option("header", True).csv(f"{base}/csv")
    rows.filter("event_id % 2 <> 0").write.json(f"{base}/json")
    schema = "event_id bigint, event_type string"
    both = spark.read.schema(schema).option("header", True).csv(f"{base}/csv").unionByName(spark.read.schema(schema).json(f"{base}/json"))
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


_WORD_SET = r"list_distinct(list_filter(string_split_regex(lower({}), '[\x20\x09-\x0D]+'), lambda x: x <> ''))"


@query("u08_lexical_quality_metric", f"WITH s AS (SELECT b.conv_id, b.turn, {_WORD_SET.format('a.text')} AS x, {_WORD_SET.format('b.text')} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, round(len(list_intersect(x, y)) / greatest(1, len(x))::DOUBLE, 6) AS score FROM s")
def u08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline stand-in of model-based metrics: share of a turn's words that the next turn holds."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    turns = read(spark, sf_dir, "conversations")
    other = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), words("text").alias("x"))
    both = turns.select("conv_id", "turn", words("text").alias("y")).join(other, ["conv_id", "turn"])
    share = F.size(F.array_intersect("x", "y")) / F.greatest(F.size("x"), F.lit(1))
    return both.select("conv_id", "turn", F.round(share, 6).alias("score"))


@query("u08_quality_metrics")
def u08m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of each assistant turn: the turn before asks, the three before that are its context, the next assistant turn is the truth."""
    order = W.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf_dir, "conversations")
    earlier = F.array_compact(F.array(*[F.lag("text", k).over(order) for k in (2, 3, 4)]))
    rows = turns.select("conv_id", "turn", "role", F.col("text").alias("answer"), F.lag("text").over(order).alias("question"), earlier.alias("contexts"), F.lead("text", 2).over(order).alias("ground_truth"))
    samples = rows.filter("role = 'assistant'").withColumn("id", F.struct("conv_id", "turn"))
    return quality_metrics.evaluate(samples).select("id.conv_id", "id.turn", "metric", F.round("score", 6).alias("score"))
