"""Rank fusion.  Lists have (query_id, id, score); equal scores rank in id order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .search import top_k

RRF_K = 60
EPS = 1.1920929e-07


def ranked(hits: DataFrame, base: int = 1) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())
    return hits.withColumn("rank", F.row_number().over(order) - 1 + base)


def min_max(hits: DataFrame) -> DataFrame:
    """Scores of each list from 0 to 1; lists of equal scores are all 1."""
    by = W.partitionBy("query_id")
    low, high = F.min("score").over(by), F.max("score").over(by)
    return hits.withColumn("score", F.when(high - low <= EPS, 1.0).otherwise((F.col("score") - low) / (high - low)))


def z_scores(hits: DataFrame) -> DataFrame:
    """Distance from the list's mean in sample deviations; a deviation of nothing counts as 1."""
    by = W.partitionBy("query_id")
    spread = F.coalesce(F.stddev_samp("score").over(by), F.lit(0.0))
    return hits.withColumn("score", (F.col("score") - F.avg("score").over(by)) / F.when(spread > EPS, spread).otherwise(1.0))


def score_stats(hits: DataFrame) -> DataFrame:
    spread = F.coalesce(F.stddev_samp("score"), F.lit(0.0))
    return hits.groupBy("query_id").agg(F.avg("score").alias("mean"), F.when(spread > EPS, spread).otherwise(1.0).alias("std"))


def rrf_score(rank: Column, k: int = RRF_K, weight: float = 1.0) -> Column:
    """One division, as in the SQL: with a weight times the rounded reciprocal, sums of equal value part or tie otherwise."""
    return F.lit(float(weight)) / (F.lit(float(k)) + rank)


def rrf(lists: list[DataFrame], weights: list[float] | None = None, k: int = RRF_K, base: int = 0) -> DataFrame:
    """Sum of weight / (k + rank) over the lists that hold the id."""
    weights = weights or [1.0] * len(lists)
    if len(weights) != len(lists):
        raise ValueError("a weight for each list is needed")
    parts = [ranked(x, base).select("query_id", "id", rrf_score(F.col("rank"), k, w).alias("score")) for x, w in zip(lists, weights, strict=True)]
    return reduce(DataFrame.unionAll, parts).groupBy("query_id", "id").agg(F.sum("score").alias("score"))


def _both(semantic: DataFrame, keyword: DataFrame) -> DataFrame:
    left = semantic.select("query_id", "id", F.col("score").alias("s"))
    return left.join(keyword.select("query_id", "id", F.col("score").alias("k")), ["query_id", "id"], "full_outer")


def linear(semantic: DataFrame, keyword: DataFrame, ws: float = 0.7, wk: float = 0.3, normalize: bool = True) -> DataFrame:
    if normalize:
        semantic, keyword = min_max(semantic), min_max(keyword)
    score = F.lit(ws) * F.coalesce("s", F.lit(0.0)) + F.lit(wk) * F.coalesce("k", F.lit(0.0))
    return _both(semantic, keyword).select("query_id", "id", score.alias("score"))


def dbsf(semantic: DataFrame, keyword: DataFrame, ws: float = 0.5, wk: float = 0.5) -> DataFrame:
    """Weighted z-scores; a missing side counts as its mean."""
    return linear(z_scores(semantic), z_scores(keyword), ws, wk, normalize=False)


def fuse(semantic: DataFrame, keyword: DataFrame, method: str = "rrf", ws: float = 0.7, wk: float = 0.3, k: int = 10) -> DataFrame:
    """The best ``k`` fused rows with both sides' scores and 1-based ranks."""
    makers = {"rrf": lambda: rrf([semantic, keyword], [ws, wk]), "linear": lambda: linear(semantic, keyword, ws, wk), "dbsf": lambda: dbsf(semantic, keyword, ws, wk)}
    if method not in makers:
        raise ValueError(f"unknown fusion method {method}")
    best = top_k(makers[method](), k).withColumnsRenamed({"score": "fused_score", "rank": "fused_rank"})
    for name, side in (("semantic", semantic), ("keyword", keyword)):
        own = ranked(side).select("query_id", "id", F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"))
        best = best.join(own, ["query_id", "id"], "left")
    return best.withColumns(
        {"best_rank": F.least("semantic_rank", "keyword_rank"), "in_both": F.col("semantic_rank").isNotNull() & F.col("keyword_rank").isNotNull()}
    )


def best_chunk_per_document(hits: DataFrame, document: str = "document_id") -> DataFrame:
    order = W.partitionBy("query_id", document).orderBy(F.col("score").desc(), F.col("id").asc())
    return hits.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def aggregate_lists(hits: DataFrame, how: str) -> DataFrame:
    """Lists of several queries (list_no) of a request into one: max, mean where present, or 1-based rrf."""
    if how == "rrf":
        order = W.partitionBy("query_id", "list_no").orderBy(F.col("score").desc(), F.col("id").asc())
        scored = hits.select("query_id", "id", rrf_score(F.row_number().over(order)).alias("score"))
        return scored.groupBy("query_id", "id").agg(F.sum("score").alias("score"))
    agg = {"max": F.max, "avg": F.avg}[how]
    return hits.groupBy("query_id", "id").agg(agg("score").alias("score"))


def merge_sub_questions(hits: DataFrame, limit: int = 20) -> DataFrame:
    """First-seen score plus half of each later one, with the sub-questions that found the id."""
    seen = W.partitionBy("query_id", "id").orderBy("list_no")
    parts = hits.withColumn("__n", F.row_number().over(seen))
    merged = parts.groupBy("query_id", "id").agg(
        F.sum(F.when(F.col("__n") == 1, F.col("score")).otherwise(F.col("score") * 0.5)).alias("score"),
        F.array_sort(F.collect_list("list_no")).alias("found_by"),
    )
    return top_k(merged, limit)


def overlap_rerank(hits: DataFrame, query_tokens: str, text_tokens: str, k: int, min_score: float = 0.0) -> DataFrame:
    """The offline reranker: share of query tokens in the text replaces the score; the old one is kept."""
    share = F.size(F.array_intersect(query_tokens, text_tokens)) / F.greatest(F.size(F.array_distinct(query_tokens)), F.lit(1))
    rescored = hits.withColumn("original_score", F.col("score")).withColumn("score", share).filter(F.col("score") >= min_score)
    return top_k(rescored.drop("rank"), k)
