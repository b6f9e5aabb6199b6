"""Aggregates, ordered windows, sorts and sets, table changes, joins and batch twins of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..operators import chains, containment, intervals, tables
from ..sources.tables import DOCUMENTS_SQL as D, EVENTS_SQL as E, documents, events, read
from .catalog import query

def n_rows(name: str) -> Column:
    return F.count(F.lit(1)).cast("bigint").alias(name)


def count_if(c: Column) -> Column:
    return F.count_if(c).cast("bigint")


# --- aggregates ----------------------------------------------------------------------------------


@query("a01_audit_stats", f"WITH {E} SELECT tenant_id, event_type, model, count(*) AS n, count(DISTINCT user_id) AS users FROM e GROUP BY GROUPING SETS ((tenant_id), (event_type), (model), ())")
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    events(spark, sf_dir).createOrReplaceTempView("audit_rows")
    return spark.sql("SELECT tenant_id, event_type, model, count(*) AS n, count(DISTINCT user_id) AS users FROM audit_rows GROUP BY GROUPING SETS ((tenant_id), (event_type), (model), ())")


@query("a02_top_terms", f"WITH {E} SELECT user_id, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, user_id LIMIT 100")
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(n_rows("n")).orderBy(F.desc("n"), "user_id").limit(100)


@query("a02_approximate_cardinality")
def a02b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"))


@query("a03_count_by_action", f"WITH {E} SELECT count(*) AS n FROM e WHERE event_type = 'click' AND tenant_id = 't1'")
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("event_type = 'click' AND tenant_id = 't1'").agg(n_rows("n"))


@query("a04_usage_rollup", f"WITH {E} SELECT model, sum(tokens)::BIGINT AS tokens, count(*) AS calls FROM e WHERE tenant_id = 't1' GROUP BY ROLLUP (model)")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("tenant_id = 't1'").rollup("model").agg(F.sum("tokens").alias("tokens"), n_rows("calls"))


@query("a04_usage_cube", f"WITH {E} SELECT tenant_id, model, sum(tokens)::BIGINT AS tokens FROM e GROUP BY CUBE (tenant_id, model)")
def a04c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).cube("tenant_id", "model").agg(F.sum("tokens").alias("tokens"))


@query("a05_usage_in_range", f"WITH {E} SELECT coalesce(sum(tokens), 0)::BIGINT AS tokens FROM e WHERE tenant_id = 't2' AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-11'")
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = events(spark, sf_dir).filter((F.col("tenant_id") == "t2") & F.col("day").between("2024-01-05", "2024-01-11"))
    return kept.agg(F.coalesce(F.sum("tokens"), F.lit(0).cast("bigint")).alias("tokens"))


@query("a06_monthly_usage", f"WITH {E} SELECT tenant_id, date_trunc('month', day)::DATE AS month, sum(tokens)::BIGINT AS tokens FROM e GROUP BY 1, 2")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("tenant_id", F.trunc("day", "MM").alias("month")).agg(F.sum("tokens").alias("tokens"))


QUOTAS = [("t0", 100_000, True), ("t1", 20_000, True), ("t2", None, True), ("t3", 10, False)]


@query("a07_a08_quota_check", f"""WITH {E}, q(tenant_id, quota, enabled) AS (VALUES ('t0', 100000::BIGINT, true), ('t1', 20000, true), ('t2', NULL, true), ('t3', 10, false)),
u AS (SELECT tenant_id, sum(tokens)::BIGINT AS used FROM e GROUP BY 1)
SELECT u.tenant_id, used, CASE WHEN quota IS NULL OR NOT enabled THEN -1 ELSE quota - used END AS remaining, quota IS NULL OR NOT enabled OR quota - used > 0 AS allowed FROM u LEFT JOIN q USING (tenant_id)""")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotas = spark.createDataFrame(QUOTAS, "tenant_id string, quota bigint, enabled boolean")
    used = events(spark, sf_dir).groupBy("tenant_id").agg(F.sum("tokens").alias("used"))
    free = F.col("quota").isNull() | ~F.coalesce("enabled", F.lit(False))
    left = F.col("quota") - F.col("used")
    return used.join(quotas, "tenant_id", "left").select("tenant_id", "used", F.when(free, F.lit(-1).cast("bigint")).otherwise(left).alias("remaining"), (free | (left > 0)).alias("allowed"))


@query("a09_a10_a27_feedback", f"WITH {E} SELECT tenant_id, round(avg(rating), 6) AS mean, count(*) FILTER (rating >= 4) AS positive, count(*) FILTER (rating <= 2) AS negative, count(*) FILTER (rating = 3) AS threes FROM e GROUP BY 1")
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("rating")
    return events(spark, sf_dir).groupBy("tenant_id").agg(F.round(F.avg(r), 6).alias("mean"), count_if(r >= 4).alias("positive"), count_if(r <= 2).alias("negative"), count_if(r == 3).alias("threes"))


@query("a11_feedback_summary", f"WITH {E} SELECT event_type, round(avg(value), 6) AS mean, round(count(*) FILTER (value >= 0.5) / count(*)::DOUBLE, 6) AS positive_rate, count(*) AS n FROM e GROUP BY 1")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg((F.col("value") >= 0.5).cast("double")), 6).alias("positive_rate"), n_rows("n"))


@query("a12_low_scoring_groups", "SELECT user_id, round(avg(value), 6) AS mean FROM events GROUP BY 1 HAVING avg(value) < 60 ORDER BY avg(value), user_id LIMIT 10")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = events(spark, sf_dir).groupBy("user_id").agg(F.avg("value").alias("m")).filter("m < 60").orderBy("m", "user_id").limit(10)
    return low.select("user_id", F.round("m", 6).alias("mean"))


@query("a13_metric_aggregate", f"WITH {E} SELECT model, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(min(value), 6) AS low, round(max(value), 6) AS high, round(median(value), 6) AS median FROM e WHERE good GROUP BY 1")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"mean": F.avg("value"), "std": F.coalesce(F.stddev_samp("value"), F.lit(0.0)), "low": F.min("value"), "high": F.max("value"), "median": F.median("value")}
    return events(spark, sf_dir).filter("good").groupBy("model").agg(*[F.round(v, 6).alias(k) for k, v in parts.items()])


_RUNS = f"{E}, r AS (SELECT model, day < DATE '2024-01-16' AS base, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std FROM e GROUP BY 1, 2)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("model", (F.col("day") < "2024-01-16").alias("base")).agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))


@query("a14_run_comparison", f"WITH {_RUNS} SELECT c.model, round(c.mean - b.mean, 6) AS delta, round((c.mean - b.mean) / b.mean * 100, 6) AS percent, abs(c.mean - b.mean) > (c.std + b.std) / 2 AS significant, CASE WHEN abs(c.mean - b.mean) <= (c.std + b.std) / 2 THEN 'unchanged' WHEN c.mean > b.mean THEN 'improved' ELSE 'degraded' END AS verdict FROM r c JOIN r b ON c.model = b.model AND NOT c.base AND b.base")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    base = runs.filter("base").select("model", F.col("mean").alias("b_mean"), F.col("std").alias("b_std"))
    delta = F.col("mean") - F.col("b_mean")
    far = F.abs(delta) > (F.col("std") + F.col("b_std")) / 2
    return runs.filter("not base").join(base, "model").select("model", F.round(delta, 6).alias("delta"), F.round(delta / F.col("b_mean") * 100, 6).alias("percent"), far.alias("significant"), F.when(~far, "unchanged").when(delta > 0, "improved").otherwise("degraded").alias("verdict"))


@query("j09_full_outer_runs", f"WITH {_RUNS}, x AS (SELECT * FROM r WHERE base AND model <> 'm0'), y AS (SELECT * FROM r WHERE NOT base AND model <> 'm2') SELECT coalesce(x.model, y.model) AS model, round(coalesce(x.mean, 0), 6) AS a, round(coalesce(y.mean, 0), 6) AS b FROM x FULL JOIN y ON x.model = y.model")
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    x = runs.filter("base AND model <> 'm0'").select("model", F.col("mean").alias("x"))
    y = runs.filter("NOT base AND model <> 'm2'").select("model", F.col("mean").alias("y"))
    return x.join(y, "model", "full_outer").select("model", F.round(F.coalesce("x", F.lit(0.0)), 6).alias("a"), F.round(F.coalesce("y", F.lit(0.0)), 6).alias("b"))


@query("a15_dataset_statistics", "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, round(avg(length(text)), 6) AS mean_chars, min(length(text)) AS low, max(length(text)) AS high FROM conversations GROUP BY 1")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("text").cast("bigint")
    return read(spark, sf_dir, "conversations").groupBy("role").agg(n_rows("n"), F.countDistinct("conv_id").alias("conversations"), F.round(F.avg(size), 6).alias("mean_chars"), F.min(size).alias("low"), F.max(size).alias("high"))


@query("a16_stratified_sample", "WITH t AS (SELECT *, sha256('s1:' || doc_id) AS h, count(*) OVER (PARTITION BY lang) AS g, count(*) OVER () AS total FROM documents) SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h) AS r FROM t) WHERE r <= greatest(1, 40 * g // total)")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At least one and in proportion from each language, by a seeded hash."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.concat(F.lit("s1:"), F.col("doc_id").cast("string")), 256).alias("h"))
    total = docs.count()
    sizes = docs.groupBy("lang").agg(n_rows("g"))
    ranked = docs.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter("r <= 40")
    return ranked.join(sizes, "lang").filter(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("g") * 40 / total))).select("doc_id", "lang")


@query("a17_verification_score", "WITH v AS (SELECT conv_id, count(*) AS total, count(*) FILTER (turn % 3 = 0) AS s, count(*) FILTER (turn % 3 = 1) AS p FROM conversations GROUP BY 1) SELECT conv_id, round((s + 0.5 * p) / total, 6) AS score, CASE WHEN (s + 0.5 * p) / total >= 0.9 THEN 'supported' WHEN (s + 0.5 * p) / total >= 0.5 THEN 'partial' ELSE 'unsupported' END AS label FROM v")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(n_rows("total"), count_if(F.col("turn") % 3 == 0).alias("s"), count_if(F.col("turn") % 3 == 1).alias("p"))
    score = F.when(F.col("total") == 0, 1.0).otherwise((F.col("s") + 0.5 * F.col("p")) / F.col("total"))
    return v.select("conv_id", F.round(score, 6).alias("score"), F.when(score >= 0.9, "supported").when(score >= 0.5, "partial").otherwise("unsupported").alias("label"))


@query("a19_a28_cache_statistics", f"WITH {E} SELECT tenant_id, round(count(*) FILTER (event_id % 3 = 0) / count(*)::DOUBLE, 6) AS hit_rate, round(avg(latency_ms) FILTER (event_id % 3 = 0), 6) AS hit_ms, round(avg(latency_ms) FILTER (event_id % 3 <> 0), 6) AS miss_ms FROM e GROUP BY 1")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("event_id") % 3 == 0
    return events(spark, sf_dir).groupBy("tenant_id").agg(
        F.round(F.try_divide(F.count_if(hit), F.count(F.lit(1))), 6).alias("hit_rate"), F.round(F.avg(F.when(hit, F.col("latency_ms"))), 6).alias("hit_ms"), F.round(F.avg(F.when(~hit, F.col("latency_ms"))), 6).alias("miss_ms")
    )


@query("a20_row_counts", f"WITH {D} SELECT tenant_id, count(*) AS n FROM d GROUP BY 1")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy("tenant_id").agg(n_rows("n"))


EDGES = (50, 100, 250, 500, 1000, 2500)


@query("a21_latency_histogram", f"WITH {E}, b AS (SELECT unnest([{', '.join(map(str, EDGES))}]) AS le) SELECT event_type, le::BIGINT AS le, count(*) FILTER (latency_ms <= le) AS cumulative FROM e, b GROUP BY 1, 2")
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = events(spark, sf_dir).groupBy("event_type").agg(*[count_if(F.col("latency_ms") <= e).alias(f"le{e}") for e in EDGES])
    cells = F.array(*[F.struct(F.lit(e).cast("bigint").alias("le"), F.col(f"le{e}").alias("n")) for e in EDGES])
    return one.select("event_type", F.explode(cells).alias("x")).select("event_type", "x.le", F.col("x.n").alias("cumulative"))


@query("a22_latency_quantiles", f"WITH {E} SELECT day, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM e GROUP BY 1")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events(spark, sf_dir).groupBy("day").agg(F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("q"))
    return found.select("day", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


_SYNC = "CASE doc_id % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'pending' WHEN 3 THEN 'processing' ELSE 'archived' END"


@query("a24_sync_summary", f"WITH p AS (SELECT {_SYNC} AS status FROM documents ORDER BY doc_id DESC LIMIT 100) SELECT CASE status WHEN 'completed' THEN 'ok' WHEN 'failed' THEN 'error' WHEN 'pending' THEN 'pending' WHEN 'processing' THEN 'pending' ELSE 'stale' END AS state, count(*) AS n FROM p GROUP BY 1")
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("completed", "failed", "pending", "processing", "archived")))
    page = read(spark, sf_dir, "documents").orderBy(F.desc("doc_id")).limit(100).select(F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")).alias("status"))
    s = F.col("status")
    state = F.when(s == "completed", "ok").when(s == "failed", "error").when(s.isin("pending", "processing"), "pending").otherwise("stale")
    return page.groupBy(state.alias("state")).agg(n_rows("n"))


@query("a25_severity_histogram", f"WITH {E} SELECT CASE WHEN latency_ms > 2000 THEN 'critical' WHEN latency_ms > 1000 THEN 'high' WHEN latency_ms > 300 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM e GROUP BY 1")
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("latency_ms")
    return events(spark, sf_dir).groupBy(F.when(x > 2000, "critical").when(x > 1000, "high").when(x > 300, "medium").otherwise("low").alias("severity")).agg(n_rows("n"))


#: Stand-in token count: a quarter of the bytes, at least one.
_TOKENS_SQL = "greatest(1, octet_length(encode(text)) // 4)"


def approximate_tokens(text: str = "text") -> Column:
    return F.greatest(F.lit(1), F.floor(F.octet_length(text) / 4)).cast("bigint")


@query("a26_session_stats", f"SELECT conv_id, count(*) AS n, sum({_TOKENS_SQL})::BIGINT AS tokens, min(turn) AS first, max(turn) AS last FROM conversations GROUP BY 1")
def a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(n_rows("n"), F.sum(approximate_tokens()).alias("tokens"), F.min("turn").alias("first"), F.max("turn").alias("last"))


# --- ordered windows -----------------------------------------------------------------------------


@query("w01_rank_in_list", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events")
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return events(spark, sf_dir).select("event_id", F.row_number().over(order).cast("bigint").alias("rank"))


#: Key-sorted JSON with ", " and ": " between its parts.
_ENTRY = """'{"action": "' || event_type || '", "id": ' || event_id || ', "tenant": "' || tenant_id || '"}'"""


def entry_json() -> Column:
    return F.concat(F.lit('{"action": "'), "event_type", F.lit('", "id": '), F.col("event_id").cast("string"), F.lit(', "tenant": "'), "tenant_id", F.lit('"}'))


@query("w03_entry_hash", f"WITH {E} SELECT event_id, sha256({_ENTRY}) AS entry_hash FROM e")
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.sha2(entry_json(), 256).alias("entry_hash"))


@query("w02_hash_chain_check", f"WITH {E}, h AS (SELECT event_id, tenant_id, ts, sha256({_ENTRY}) AS entry_hash FROM e), c AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'broken' ELSE lag(entry_hash) OVER o END AS previous_hash, lag(entry_hash) OVER o AS expected FROM h WINDOW o AS (PARTITION BY tenant_id ORDER BY ts, event_id)) SELECT tenant_id, count(*) AS n, count(*) FILTER (previous_hash IS DISTINCT FROM expected) AS breaks, min(event_id) FILTER (previous_hash IS DISTINCT FROM expected) AS first_break FROM c GROUP BY 1")
def w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain for each tenant, checked day by day: a day's first entry follows the last one of the tenant's day before."""
    order = W.partitionBy("tenant_id", "day").orderBy("ts", "event_id")
    h = events(spark, sf_dir).withColumn("entry_hash", F.sha2(entry_json(), 256))
    ends = h.groupBy("tenant_id", "day").agg(F.max_by("entry_hash", F.struct("ts", "event_id")).alias("last"))  # one row a day
    borders = ends.select("tenant_id", "day", F.lag("last").over(W.partitionBy("tenant_id").orderBy("day")).alias("border"))
    h = h.withColumn("before", F.lag("entry_hash").over(order)).join(borders, ["tenant_id", "day"]).withColumn("expected", F.coalesce("before", "border"))
    stored = F.when(F.col("event_id") % 97 == 0, "broken").otherwise(F.col("expected"))
    bad = ~stored.eqNullSafe(F.col("expected"))
    return h.groupBy("tenant_id").agg(n_rows("n"), count_if(bad).alias("breaks"), F.min(F.when(bad, F.col("event_id"))).alias("first_break"))


@query(
    "w04_generated_hash_chain",
    f"WITH RECURSIVE {E}, o AS (SELECT user_id, event_id, sha256({_ENTRY}) AS body, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e), "
    "c AS (SELECT user_id, event_id, k, '' AS previous_hash, sha256(body) AS chain_hash FROM o WHERE k = 1 UNION ALL "
    "SELECT o.user_id, o.event_id, o.k, c.chain_hash, sha256(c.chain_hash || o.body) FROM c JOIN o ON o.user_id = c.user_id AND o.k = c.k + 1) SELECT user_id, event_id, previous_hash, chain_hash FROM c",
)
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entry's hash covers the one before; a chain for each user, folded in order."""
    rows = events(spark, sf_dir).select("user_id", "event_id", "ts", F.sha2(entry_json(), 256).alias("body"))
    return chains.chained(rows, "user_id", ["ts", "event_id"], "body").select("user_id", "event_id", "previous_hash", "chain_hash")


@query("w05_token_budget", f"WITH t AS (SELECT conv_id, turn, {_TOKENS_SQL} AS tokens FROM conversations), r AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t) SELECT conv_id, turn, CASE WHEN run <= 300 THEN tokens ELSE 300 - (run - tokens) END::BIGINT AS used, run > 300 AS truncated FROM r WHERE run <= 300 OR 300 - (run - tokens) > 50")
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.sum("tokens").over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    rows = read(spark, sf_dir, "conversations").withColumn("tokens", approximate_tokens()).withColumn("run", run)
    left = 300 - (F.col("run") - F.col("tokens"))
    return rows.filter((F.col("run") <= 300) | (left > 50)).select("conv_id", "turn", F.when(F.col("run") <= 300, F.col("tokens")).otherwise(left).alias("used"), (F.col("run") > 300).alias("truncated"))


@query("w06_history_window", f"SELECT conv_id, turn FROM (SELECT conv_id, turn, sum({_TOKENS_SQL}) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS run FROM conversations) WHERE run <= 200")
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.sum(approximate_tokens()).over(W.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, 0))
    return read(spark, sf_dir, "conversations").withColumn("run", run).filter("run <= 200").select("conv_id", "turn")


@query("w07_message_limit", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def w07(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return read(spark, sf_dir, "conversations").withColumn("r", F.row_number().over(order)).filter("r <= 3").select("conv_id", "turn")


@query("w08_summarise_trigger", "SELECT conv_id, count(*) - 2 >= 4 AS due FROM conversations GROUP BY 1")
def w08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.count(F.lit(1)) - 2 >= 4).alias("due"))


@query("w09_window_bounds")
def w09(spark: SparkSession, sf_dir: str) -> DataFrame:
    durations = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video"), (F.col("o_orderkey") % 200 * 1500).cast("bigint").alias("duration"))
    return durations.select("video", F.posexplode(intervals.window_bounds(F.col("duration"))).alias("n", "w")).select("video", "n", "w.start_ms", "w.end_ms")


@query("w10_text_dedup_in_order")
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of a conversation stay, and their letters: those that repeat, hold or lie in an earlier one go."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("id"), "text")
    kept = containment.first_texts(turns).groupBy("key").agg(n_rows("kept"), F.sum(F.length("text")).cast("bigint").alias("letters"))
    every = turns.groupBy("key").agg(n_rows("n"))
    return every.join(kept, "key", "left").select(F.col("key").alias("conv_id"), "n", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("letters", F.lit(0)).alias("letters"))


@query("w11_first_boundary_frame", "SELECT user_id, arg_min(event_id, (NOT (event_type = 'click'), ts, event_id)) AS frame FROM events GROUP BY 1")
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(F.min_by("event_id", F.struct((F.col("event_type") != "click").alias("b"), "ts", "event_id")).alias("frame"))


@query("w12_citation_numbers", "SELECT conv_id, string_agg('[' || r || '] ' || role, chr(10) ORDER BY r) AS cited FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 10 GROUP BY 1")
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").withColumn("r", F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))).filter("r <= 10")
    parts = F.array_sort(F.collect_list(F.struct("r", F.concat(F.lit("["), F.col("r").cast("string"), F.lit("] "), "role").alias("t"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("cited"))


@query("w13_event_sequence", "SELECT conv_id, regexp_full_match(string_agg(left(role, 1), '' ORDER BY turn), 's?(ua)*u?') AS valid FROM conversations GROUP BY 1")
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.substring("role", 1, 1).alias("c")))), lambda x: x["c"]), "")
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(coded.rlike("^s?(ua)*u?$").alias("valid"))


@query("w14_duplicates_in_a_minute", "SELECT event_id, count(*) OVER (PARTITION BY event_type, user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) > 3 AS suppressed FROM events")
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    near = W.partitionBy("event_type", "user_id").orderBy("us").rangeBetween(-60_000_000, 0)
    return e.select("event_id", (F.count(F.lit(1)).over(near) > 3).alias("suppressed"))


@query("w15_regular_timestamps", "SELECT o_orderkey AS video, unnest(range(0, o_orderkey % 200 * 700, 5000))::BIGINT AS at_ms FROM orders")
def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "orders").withColumn("d", (F.col("o_orderkey") % 200 * 700).cast("bigint"))
    return v.filter("d > 0").select(F.col("o_orderkey").alias("video"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("d") - 1, F.lit(5000).cast("bigint"))).alias("at_ms"))


@query("w16_interval_midpoint", "SELECT event_id, (event_id + event_id % 7 * 100) // 2 AS mid, greatest(0, event_id % 7 * 100 - event_id) AS gap FROM events")
def w16(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.col("event_id") % 7 * 100
    return events(spark, sf_dir).select("event_id", F.floor((F.col("event_id") + end) / 2).alias("mid"), F.greatest(F.lit(0).cast("bigint"), end - F.col("event_id")).alias("gap"))


@query("w17_ordered_concat", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS full_text FROM conversations GROUP BY 1")
def w17(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("full_text"))


# --- joins ---------------------------------------------------------------------------------------

_SPANS = "seg AS (SELECT user_id AS key, event_id, event_id * 40 % 90000 AS r_lo, event_id * 40 % 90000 + 1000 + event_id % 5 * 700 AS r_hi FROM events), win AS (SELECT DISTINCT user_id AS key, w * 28000 AS lo, w * 28000 + 30000 AS hi FROM events, (SELECT unnest(range(4)) AS w))"


def _segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf_dir)
    lo = F.col("event_id") * 40 % 90000
    segments = e.select(F.col("user_id").alias("key"), "event_id", lo.alias("r_lo"), (lo + 1000 + F.col("event_id") % 5 * 700).alias("r_hi"))
    windows = e.select(F.col("user_id").alias("key")).distinct().select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(84000).cast("bigint"), F.lit(28000).cast("bigint"))).alias("lo"))
    return windows.withColumn("hi", F.col("lo") + 30000), segments


@query("j03_interval_overlap_join", f"WITH {_SPANS} SELECT win.key, lo, event_id FROM win JOIN seg ON win.key = seg.key AND lo < r_hi AND r_lo < hi")
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlap_join(*_segments(spark, sf_dir), 28000).select("key", "lo", "event_id")


@query("j04_point_in_interval", f"WITH {_SPANS} SELECT win.key, lo, arg_min(event_id, (event_id % 4 <> 0, r_lo, event_id)) AS frame FROM win JOIN seg ON win.key = seg.key AND r_lo >= lo AND r_lo < hi GROUP BY 1, 2")
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows, segments = _segments(spark, sf_dir)
    inside = intervals.point_join(windows, segments.select("key", "event_id", F.col("r_lo").alias("at")), 28000)
    return inside.groupBy("key", "lo").agg(F.min_by("event_id", F.struct((F.col("event_id") % 4 != 0).alias("b"), "at", "event_id")).alias("frame"))


@query("j05_chunk_to_embedding", "SELECT doc_id, label FROM documents JOIN embeddings ON doc_id = vec_id")
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id")).select("doc_id", "label")


@query("j06_semi_join", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").filter("quality = 1"), "doc_id", "left_semi").select("doc_id")


@query("j07_f29_live_roles", f"WITH {E}, r AS (SELECT DISTINCT user_id, 'role' || (event_id % 6) AS role, CASE WHEN event_id % 6 = 0 THEN NULL ELSE DATE '2024-01-01' + (event_id % 30)::INT END AS expires FROM e) SELECT user_id, role, count(*) AS n FROM r WHERE expires IS NULL OR expires > DATE '2024-01-15' GROUP BY 1, 2")
def j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    expires = F.when(i % 6 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (i % 30).cast("int")))
    roles = events(spark, sf_dir).select("user_id", F.concat(F.lit("role"), (i % 6).cast("string")).alias("role"), expires.alias("expires")).distinct()
    return roles.filter("expires IS NULL OR expires > DATE '2024-01-15'").groupBy("user_id", "role").agg(n_rows("n"))


@query("j08_metric_trend", "SELECT o_orderkey, o_orderdate::DATE AS day, l_linenumber::BIGINT AS line FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey, l_linenumber LIMIT 30")
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    rows = o.filter("o_orderstatus = 'F'").join(li, o.o_orderkey == li.l_orderkey)
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey", "l_linenumber").limit(30).select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.col("l_linenumber").cast("bigint").alias("line"))


@query("j10_runs_against_baseline", f"WITH {E}, r AS (SELECT model, event_type, avg(value) AS m FROM e GROUP BY 1, 2) SELECT r.model, r.event_type, round(r.m - b.m, 6) AS delta FROM r JOIN r b ON r.event_type = b.event_type AND b.model = 'm0' AND r.model <> 'm0'")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = events(spark, sf_dir).groupBy("model", "event_type").agg(F.avg("value").alias("m"))
    base = r.filter("model = 'm0'").select("event_type", F.col("m").alias("b"))
    return r.filter("model <> 'm0'").join(base, "event_type").select("model", "event_type", F.round(F.col("m") - F.col("b"), 6).alias("delta"))


@query("j13_trace_log_correlation", f"WITH {E}, t AS (SELECT DISTINCT user_id, event_type FROM e), l AS (SELECT DISTINCT user_id, event_type FROM e WHERE event_id % 2 = 0), m AS (SELECT user_id, count(*) AS missing FROM (SELECT * FROM t EXCEPT SELECT * FROM l) GROUP BY 1) SELECT u.user_id, u.user_id IN (SELECT user_id FROM l) AND coalesce(missing, 0) = 0 AS correlated FROM (SELECT DISTINCT user_id FROM t) u LEFT JOIN m ON m.user_id = u.user_id")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    seen = e.groupBy("user_id", "event_type").agg(F.max((F.col("event_id") % 2 == 0).cast("int")).alias("logged"))
    return seen.groupBy("user_id").agg(((F.max("logged") == 1) & (F.min("logged") == 1)).alias("correlated"))


@query("j14_dataset_with_examples", "SELECT c_custkey, count(o_orderkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey).groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("j15_run_with_metrics", "SELECT p_partkey, list(l_orderkey ORDER BY l_orderkey, l_linenumber) FILTER (l_orderkey IS NOT NULL) AS orders FROM part LEFT JOIN lineitem ON p_partkey = l_partkey WHERE p_partkey <= 100 GROUP BY 1")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, li = read(spark, sf_dir, "part").filter("p_partkey <= 100"), read(spark, sf_dir, "lineitem")
    rows = p.join(li, p.p_partkey == li.l_partkey, "left").groupBy("p_partkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))).alias("x"))
    keys = F.transform(F.filter("x", lambda v: v["l_orderkey"].isNotNull()), lambda v: v["l_orderkey"])
    return rows.select("p_partkey", F.when(F.size(keys) > 0, keys).alias("orders"))


@query("j16_tenant_config", f"WITH {D}, c(tenant_id, top_k) AS (VALUES ('t0', 5), ('t2', 20)) SELECT doc_id, coalesce(top_k, 10) AS top_k FROM d LEFT JOIN c USING (tenant_id)")
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = spark.createDataFrame([("t0", 5), ("t2", 20)], "tenant_id string, top_k int")
    return documents(spark, sf_dir).join(F.broadcast(config), "tenant_id", "left").select("doc_id", F.coalesce("top_k", F.lit(10)).alias("top_k"))


# --- sorts and sets ------------------------------------------------------------------------------


@query("t01_t02_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("t03_paging", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20).select("o_orderkey")


@query("t04_multi_key_order", "SELECT n_nationkey, row_number() OVER (ORDER BY (n_regionkey = 1) DESC, n_name) AS pos FROM nation")
def t04(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.row_number().over(W.orderBy((F.col("n_regionkey") == 1).desc(), "n_name")).cast("bigint").alias("pos"))


@query("t05_id_union", "SELECT doc_id AS id FROM documents UNION SELECT vec_id FROM embeddings")
def t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).union(read(spark, sf_dir, "embeddings").select("vec_id")).distinct()


@query("t06_ordered_distinct", "WITH s AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), u AS (SELECT doc_id, trim(unnest(w)) AS word, unnest(range(len(w))) AS pos FROM s), f AS (SELECT doc_id, word, min(pos) AS pos FROM u WHERE word <> '' GROUP BY 1, 2), l AS (SELECT doc_id, list(word ORDER BY pos) AS words FROM f GROUP BY 1) SELECT s.doc_id, coalesce(words, []) AS words FROM s LEFT JOIN l USING (doc_id)")
def t06(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.transform(F.split("text", " "), lambda x: F.trim(x))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.filter(words, lambda x: x != "")).alias("words"))


@query("t07_distinct_by_content", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)")
def t07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("t08_sample_hash", "SELECT conv_id, left(sha256(min(role) || string_agg(text, '' ORDER BY text)), 16) AS h FROM conversations GROUP BY 1")
def t08(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.concat(F.min("role"), F.array_join(F.array_sort(F.collect_list("text")), ""))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.substring(F.sha2(both, 256), 1, 16).alias("h"))


@query("t09_reconcile_stores", "SELECT doc_id AS id, 'missing' AS issue FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'orphan' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def t09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.reconcile(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), "id")


# --- table changes -------------------------------------------------------------------------------

_BASE = "b AS (SELECT o_orderkey AS k, o_custkey AS v, 1 AS version FROM orders), c AS (SELECT o_orderkey + 10 AS k, o_custkey + 1000 AS v, 1 + o_orderkey % 2 AS version FROM orders WHERE o_orderkey % 5 = 0)"


def _change(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders")
    base = o.select(k.alias("k"), F.col("o_custkey").alias("v"), F.lit(1).cast("bigint").alias("version"))
    return base, o.filter(k % 5 == 0).select((k + 10).alias("k"), (F.col("o_custkey") + 1000).alias("v"), (k % 2 + 1).cast("bigint").alias("version"))


@query("k04_k17_k18_upsert", f"WITH {_BASE}, u AS (SELECT *, 0 AS side FROM b UNION ALL SELECT *, 1 FROM c) SELECT k, v, version::BIGINT AS version FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC, side DESC) AS n FROM u) WHERE n = 1")
def k04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.upsert(*_change(spark, sf_dir), ["k"], F.col("version"))


@query("k02_reindex", f"WITH {_BASE} SELECT k, v FROM b WHERE k NOT IN (SELECT k FROM c) UNION ALL SELECT k, v FROM c")
def k02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.reindex(*_change(spark, sf_dir), ["k"]).select("k", "v")


@query("k03_k07_k08_delete", f"WITH {_BASE} SELECT k, v FROM b WHERE k NOT IN (SELECT k FROM c)")
def k03(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, change = _change(spark, sf_dir)
    return tables.delete(base, change.select("k"), ["k"]).select("k", "v")


@query("k09_batch_delete_outcome", f"WITH {_BASE} SELECT c.k, CASE WHEN b.k IS NULL THEN 'not_found' ELSE 'deleted' END AS outcome FROM c LEFT JOIN b ON b.k = c.k")
def k09(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, change = _change(spark, sf_dir)
    return change.select("k").join(base.select("k", F.lit("deleted").alias("o")), "k", "left").select("k", F.coalesce("o", F.lit("not_found")).alias("outcome"))


@query("k10_additive_upsert", f"WITH {E}, u AS (SELECT tenant_id, day, model, sum(tokens) AS t FROM e GROUP BY 1, 2, 3) SELECT tenant_id, day, model, sum(t)::BIGINT AS tokens FROM (SELECT * FROM u UNION ALL SELECT * FROM u WHERE day > DATE '2024-01-20') GROUP BY 1, 2, 3")
def k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["tenant_id", "day", "model"]
    usage = events(spark, sf_dir).groupBy(*keys).agg(F.sum("tokens").alias("tokens"))
    return tables.additive_upsert(usage, usage.filter("day > DATE '2024-01-20'"), keys, ["tokens"])


@query("k13_mark_embedded", "SELECT doc_id, doc_id IN (SELECT vec_id FROM embeddings) AS embedded FROM documents")
def k13(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("embedded"))
    base = read(spark, sf_dir, "documents").select("doc_id", F.lit(False).alias("embedded"))
    return tables.overlay(base, done, ["doc_id"], ["embedded"])


@query("k14_status_change", f"WITH {D} SELECT doc_id, CASE WHEN doc_id IN (3, 6, 9) THEN 'failed' ELSE status END AS status FROM d")
def k14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id").isin(3, 6, 9), "failed").otherwise(F.col("status")).alias("status"))


@query("k16_insert_new_only", f"WITH {_BASE} SELECT k, v FROM b UNION ALL SELECT k, v FROM c WHERE k NOT IN (SELECT k FROM b)")
def k16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.insert_new(*_change(spark, sf_dir), ["k"]).select("k", "v")


@query("k19_k20_acl_overlay", f"WITH {D} SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'public' ELSE visibility END AS visibility, owner_id FROM d")
def k19(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", "visibility", "owner_id")
    change = d.filter("doc_id % 6 = 0").select("doc_id", F.lit("public").alias("visibility"), F.lit(None).cast("string").alias("owner_id"))
    return tables.overlay(d, change, ["doc_id"], ["visibility", "owner_id"])


# --- listings ------------------------------------------------------------------------------------


@query("f22_f23_audit_search", f"WITH {E} SELECT event_id, event_type FROM e WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND tenant_id = 't1' AND event_type IN ('click', 'error') ORDER BY ts DESC, event_id LIMIT 50 OFFSET 5")
def f22(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = events(spark, sf_dir).filter("ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-20 00:00:00' AND tenant_id = 't1' AND event_type IN ('click', 'error')")
    return kept.orderBy(F.desc("ts"), "event_id").offset(5).limit(50).select("event_id", "event_type")


@query("f34_f35_f36_user_activity", "SELECT event_id FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id LIMIT 40")
def f34(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("user_id = 7").orderBy(F.desc("ts"), "event_id").limit(40).select("event_id")


@query("f37_f38_conversation_listing", "SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1 ORDER BY last DESC, conv_id LIMIT 15 OFFSET 5")
def f37(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last")).orderBy(F.desc("last"), "conv_id").offset(5).limit(15)


@query("f39_job_history", "SELECT event_id, (SELECT count(*) FROM events) AS total FROM events ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 20")
def f39(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    page = e.orderBy(F.desc("ts"), F.desc("event_id")).offset(20).limit(20).select("event_id")
    return page.join(F.broadcast(e.agg(F.count(F.lit(1)).alias("total"))))  # one row


@query("f40_by_category", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def f40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter(F.from_json("props", "map<string,string>")["k"] == "7").select("event_id")


@query("f28_video_filter", f"WITH {D} SELECT doc_id FROM d WHERE tenant_id = 't2' AND list_has_any(allowed_groups, ['g0', 'g2']) AND n_chars / 10000.0 >= 0.05")
def f28(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.filter((d.tenant_id == "t2") & F.arrays_overlap("allowed_groups", F.array(F.lit("g0"), F.lit("g2"))) & (d.n_chars / 10000.0 >= 0.05)).select("doc_id")


# --- batch twins of streams ----------------------------------------------------------------------


@query("z02_usage_increments", f"WITH {E} SELECT tenant_id, day, model, sum(tokens)::BIGINT AS tokens FROM e GROUP BY 1, 2, 3")
def z02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("tenant_id", "day", "model").agg(F.sum("tokens").alias("tokens"))


@query("z04_first_token", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event, min(ts) AS first_ts FROM events GROUP BY 1")
def z04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), F.min("ts").alias("first_ts"))


@query("z06_sli_ratio", f"WITH {E} SELECT day, round(count(*) FILTER (good) / count(*)::DOUBLE, 6) AS ratio, count(*) AS n FROM e GROUP BY 1")
def z06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("day").agg(F.round(F.count_if("good") / F.count(F.lit(1)), 6).alias("ratio"), n_rows("n"))


@query("z05_burn_rate", f"""WITH {E}, h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n, count(*) FILTER (NOT good) AS bad FROM e GROUP BY 1),
w AS (SELECT hour, sum(bad) OVER s / sum(n) OVER s AS short, sum(bad) OVER l / sum(n) OVER l AS long FROM h
 WINDOW s AS (ORDER BY hour RANGE BETWEEN INTERVAL 0 HOURS PRECEDING AND CURRENT ROW), l AS (ORDER BY hour RANGE BETWEEN INTERVAL 5 HOURS PRECEDING AND CURRENT ROW))
SELECT hour, round(short, 6) AS short_rate, round(long, 6) AS long_rate, short > 0.2 AND long > 0.2 AS alert FROM w""")
def z05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates of the hour and of six hours; hours are pre-aggregated, so the window runs over few rows."""
    hours = events(spark, sf_dir).groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("good")).alias("bad"))
    six = W.orderBy(F.unix_timestamp("h")).rangeBetween(-5 * 3600, 0)
    short, long_ = F.col("bad") / F.col("n"), F.sum("bad").over(six) / F.sum("n").over(six)
    return hours.select(F.col("h").cast("timestamp_ntz").alias("hour"), F.round(short, 6).alias("short_rate"), F.round(long_, 6).alias("long_rate"), ((short > 0.2) & (long_ > 0.2)).alias("alert"))


@query("z09_degradation_level", f"WITH {E}, c AS (SELECT tenant_id, event_type, count(*) FILTER (NOT good AND event_id % 2 = 0) > 5 AS open FROM e GROUP BY 1, 2) SELECT tenant_id, CASE WHEN bool_and(open) THEN 'critical' WHEN bool_or(open) THEN 'degraded' ELSE 'normal' END AS level FROM c GROUP BY 1")
def z09(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = events(spark, sf_dir).groupBy("tenant_id", "event_type").agg((F.count_if(~F.col("good") & (F.col("event_id") % 2 == 0)) > 5).alias("open"))
    return c.groupBy("tenant_id").agg(F.when(F.bool_and("open"), "critical").when(F.bool_or("open"), "degraded").otherwise("normal").alias("level"))


_JOBS = "j AS (SELECT event_id, event_id % 4 AS priority, ts AS ready, event_id % 5 AS attempts, event_type FROM events)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return events(spark, sf_dir).select("event_id", (i % 4).alias("priority"), F.col("ts").alias("ready"), (i % 5).alias("attempts"), "event_type")


@query("z10_dequeue", f"WITH {_JOBS} SELECT event_id FROM j WHERE ready <= TIMESTAMP '2024-01-15' ORDER BY priority, ready, event_id LIMIT 30")
def z10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).filter("ready <= TIMESTAMP_NTZ '2024-01-15 00:00:00'").orderBy("priority", "ready", "event_id").limit(30).select("event_id")


@query("z11_x42_retry_or_dead_letter", f"WITH {_JOBS} SELECT event_id, CASE WHEN attempts < 3 THEN 'requeue' ELSE 'dead_letter' END AS target, CASE WHEN attempts < 3 THEN least(1000 * pow(2, attempts), 30000)::BIGINT END AS wait_ms FROM j WHERE event_type = 'error'")
def z11(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = F.col("attempts") < 3
    wait = F.when(again, F.least(F.lit(1000) * F.pow(F.lit(2), "attempts"), F.lit(30000)).cast("bigint"))
    return _jobs(spark, sf_dir).filter("event_type = 'error'").select("event_id", F.when(again, "requeue").otherwise("dead_letter").alias("target"), wait.alias("wait_ms"))


@query("z12_stuck_jobs", f"WITH {_JOBS} SELECT event_id FROM j WHERE event_type = 'error' AND TIMESTAMP '2024-01-30' - ready > INTERVAL 10 DAYS")
def z12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).filter("event_type = 'error' AND ready < TIMESTAMP_NTZ '2024-01-20 00:00:00'").select("event_id")


@query("z14_cache_ttl", f"WITH {E} SELECT event_id, TIMESTAMP '2024-01-20' < ts + CASE WHEN tenant_id = 't1' THEN INTERVAL 5 DAYS ELSE INTERVAL 2 DAYS END AS live FROM e")
def z14(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.col("ts") + F.when(F.col("tenant_id") == "t1", F.expr("INTERVAL '5' DAY")).otherwise(F.expr("INTERVAL '2' DAY"))
    return events(spark, sf_dir).select("event_id", (F.lit("2024-01-20").cast("timestamp_ntz") < ends).alias("live"))


@query("z15_session_cap", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def z15(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events(spark, sf_dir).withColumn("r", F.row_number().over(order)).filter("r <= 5").select("event_id")


@query("z16_expire_jobs", f"WITH {_JOBS} SELECT event_id FROM j WHERE ready >= TIMESTAMP '2024-01-25'")
def z16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).filter("ready >= TIMESTAMP_NTZ '2024-01-25 00:00:00'").select("event_id")


@query("z19_replay_dead_letter", f"WITH {_JOBS} SELECT event_id, 0::BIGINT AS attempts FROM j WHERE event_type = 'error' AND attempts >= 3 AND event_id % 2 = 0 UNION ALL SELECT event_id, attempts FROM j WHERE event_type = 'error' AND attempts >= 3 AND event_id % 2 <> 0")
def z19(spark: SparkSession, sf_dir: str) -> DataFrame:
    dead = _jobs(spark, sf_dir).filter("event_type = 'error' AND attempts >= 3").select("event_id", "attempts")
    replay = dead.filter("event_id % 2 = 0").select("event_id")
    return tables.delete(dead, replay, ["event_id"]).unionAll(replay.select("event_id", F.lit(0).cast("bigint")))


@query("p01_orders_by_nation", "SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def p01(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, c, n = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rows.groupBy("n_name").agg(n_rows("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
