"""Re-ranking by a fitted pairwise model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .search import tokens, top_k

#: What a candidate is judged by.
FEATURES = ("keyword", "coverage", "title", "proximity", "density", "variety", "length", "semantic")


def _spots(words: str, terms: str) -> Column:
    """Places and words of a text's query terms, in order."""
    placed = F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("term")))
    return F.filter(placed, lambda s: F.array_contains(terms, s["term"]))


def _closest(spots: str) -> Column:
    """1 / the least distance of two different query terms, 0 without two: the closest pair is always next to each other in order."""
    # From the second spot on; an empty or single list has no pair.
    pairs = F.transform(F.slice(spots, 2, F.greatest(F.size(spots) - 1, F.lit(0))), lambda s, i: F.when(s["term"] != F.get(F.col(spots), i)["term"], s["at"] - F.get(F.col(spots), i)["at"]))
    return F.coalesce(1.0 / F.array_min(pairs), F.lit(0.0))


def features(candidates: DataFrame) -> DataFrame:
    """``candidates`` with a column ``features`` (a struct of ``FEATURES``).

    Candidates are (query_id, id, score, terms array<string>, text, title,
    semantic): the score of the first search, the request's analysed terms, the
    document, and the vectors' product or null.  All of it is built in; a
    candidate's text is read where it lies.
    """
    share = lambda n, of: F.coalesce(n / F.when(of > 0, of), F.lit(0.0))
    read = candidates.withColumns({"__words": tokens(F.coalesce("text", F.lit(""))), "__title": tokens(F.coalesce("title", F.lit("")))})
    read = read.withColumn("__spots", _spots("__words", "terms"))
    n, asked = F.size("__words"), F.size("terms")
    met = F.array_distinct(F.transform("__spots", lambda s: s["term"]))
    columns = {
        "keyword": F.coalesce(F.col("score").cast("double"), F.lit(0.0)),
        "coverage": share(F.size(met), asked),
        "title": share(F.size(F.array_intersect("__title", "terms")), asked),
        "proximity": _closest("__spots"),
        "density": share(F.size("__spots"), n),
        "variety": share(F.size(F.array_distinct("__words")), n),
        "length": F.log1p(n.cast("double")),
        "semantic": F.coalesce(F.col("semantic").cast("double"), F.lit(0.0)),
    }
    return read.withColumn("features", F.struct(*[columns[f].cast("double").alias(f) for f in FEATURES])).drop("__words", "__title", "__spots")


@dataclass(frozen=True)
class Ranker:
    """A linear order over features; ``score`` is its logistic value."""

    weights: tuple[float, ...]
    means: tuple[float, ...]

    def score(self, column: str = "features") -> Column:
        total = F.lit(0.0)
        for name, w, m in zip(FEATURES, self.weights, self.means, strict=True):
            total = total + F.lit(w) * (F.col(column)[name] - F.lit(m))
        return 1.0 / (1.0 + F.exp(-total))


def fit_ranker(judged: DataFrame, penalty: float = 0.01) -> Ranker:
    """From ``judged(query_id, id, features, relevant boolean)``: each relevant candidate against each other one of its request.

    A request has only as many candidates as its search returned, so pairs are
    bounded by the square of that.  A pair counts by its request's number of
    pairs, so that each request weighs the same.  Without a pair the order is
    that of the first search.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    flat = F.array(*[F.col("features")[f] for f in FEATURES])
    rows = judged.filter("relevant is not null").select("query_id", "relevant", flat.alias("x"))
    good = rows.filter("relevant").select("query_id", F.col("x").alias("a"))
    bad = rows.filter("not relevant").select("query_id", F.col("x").alias("b"))
    pairs = good.join(bad, "query_id").select("query_id", F.zip_with("a", "b", lambda p, q: p - q).alias("gap"))
    weight = pairs.groupBy("query_id").agg((1.0 / F.count(F.lit(1))).alias("weight"))
    weighted = pairs.join(weight, "query_id")
    both = weighted.select("gap", "weight", F.lit(1.0).alias("label")).unionAll(weighted.select(F.transform("gap", lambda g: -g), "weight", F.lit(0.0)))
    means = judged.agg(*[F.avg(F.col("features")[f]).alias(f) for f in FEATURES]).first()
    centre = tuple(float(m or 0.0) for m in means)
    if not both.limit(1).count():
        return Ranker((1.0,) + (0.0,) * (len(FEATURES) - 1), centre)
    model = LogisticRegression(fitIntercept=False, regParam=penalty, weightCol="weight").fit(both.select(array_to_vector("gap").alias("features"), "weight", "label"))
    return Ranker(tuple(float(w) for w in model.coefficients), centre)


def rerank(candidates: DataFrame, ranker: Ranker, k: int | None = None, min_score: float | None = None) -> DataFrame:
    """Candidates with features in the model's order: its score replaces theirs, which stays as ``original_score``; then the threshold, then the cut."""
    rows = candidates.withColumn("original_score", F.col("score")).withColumn("score", ranker.score()).drop("features")
    if min_score is not None:
        rows = rows.filter(F.col("score") >= min_score)
    return top_k(rows, k if k is not None else 2**31 - 1)


def gain(ranked: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg): discounted gain of ``ranked(query_id, rank, relevant)`` at ``k`` against the best order of the same rows; requests without a relevant row are left out."""
    from pyspark.sql import Window as W

    ideal = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("relevant").cast("int").desc()))
    rows = ranked.withColumn("__ideal", ideal)
    part = lambda place: F.sum(F.when(F.col("relevant") & (F.col(place) <= k), 1.0 / F.log2(F.col(place) + 1.0)).otherwise(0.0))
    return rows.groupBy("query_id").agg(part("rank").alias("got"), part("__ideal").alias("best")).filter("best > 0").select("query_id", (F.col("got") / F.col("best")).alias("ndcg"))
