"""The fitted re-ranker: features against plain Python, what it learns, thresholds and cuts."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import rerank, search
from sparkloom.plans import retrieval

SCHEMA = "query_id long, id long, score double, terms array<string>, text string, title string, semantic double"


def plain_features(score, terms, text, title, semantic):
    analysed = lambda t: [w for w in re.findall(r"[^\W_]+", (t or "").lower()) if w not in search.STOP_WORDS]
    words = analysed(text)
    spots = [(i, w) for i, w in enumerate(words) if w in terms]
    gaps = [j - i for a, (i, u) in enumerate(spots) for j, v in spots[a + 1 :] if u != v]
    return {
        "keyword": score or 0.0,
        "coverage": len({w for _, w in spots}) / len(terms) if terms else 0.0,
        "title": len(set(analysed(title)) & set(terms)) / len(terms) if terms else 0.0,
        "proximity": 1 / min(gaps) if gaps else 0.0,
        "density": len(spots) / len(words) if words else 0.0,
        "variety": len(set(words)) / len(words) if words else 0.0,
        "length": math.log1p(len(words)),
        "semantic": semantic or 0.0,
    }


def test_features_against_plain_python(spark):
    rng = random.Random(3)
    rows = [(1, k, rng.random(), ["red", "blue", "sun"], " ".join(rng.choice("red blue sun sky sea the a".split()) for _ in range(rng.randint(0, 30))), "red sky", rng.random()) for k in range(40)]
    rows += [(2, 100, None, [], None, None, None), (2, 101, 1.0, ["red"], "red red", "", None), (2, 102, 1.0, ["red", "blue"], "the", "blue", None)]
    got = {r.id: r.features.asDict() for r in rerank.features(spark.createDataFrame(rows, SCHEMA)).collect()}
    for _, i, *rest in rows:
        assert got[i] == pytest.approx(plain_features(*rest)), i


def made_requests(spark, n, seed):
    """Good documents hold the terms next to each other; keyword scores say nothing."""
    rng = random.Random(seed)
    rows = []
    for q in range(n):
        for k in range(12):
            good = k % 3 == 0
            filler = [f"w{rng.randint(0, 50)}" for _ in range(20)]
            filler[3:3] = ["alpha", "beta"] if good else ["alpha", *(f"x{j}" for j in range(8)), "beta"]
            rows.append((q, 100 * q + k, rng.random(), ["alpha", "beta"], " ".join(filler), "", None, good))
    df = spark.createDataFrame(rows, SCHEMA + ", relevant boolean")
    return rerank.features(df)


def test_model_orders_held_out_requests_better(spark):
    model = rerank.fit_ranker(made_requests(spark, 12, 1))
    held = made_requests(spark, 8, 2)
    mean = lambda rows: rerank.gain(rows).agg(F.avg("ndcg")).first()[0]
    before, after = mean(search.top_k(held, 20)), mean(rerank.rerank(held, model))
    assert after > 0.99 > 0.9 > before


def test_model_of_judged_documents(spark, sf_dir):
    """Held-out benchmark items: an order no worse than the keyword search's."""
    rows = retrieval._judged(spark, sf_dir).cache()
    model = rerank.fit_ranker(rows.filter("query_id % 2 = 0"))
    held = rows.filter("query_id % 2 = 1 and relevant is not null").drop("rank")
    mean = lambda r: rerank.gain(r).agg(F.avg("ndcg")).first()[0]
    assert mean(rerank.rerank(held, model)) >= mean(search.top_k(held, retrieval.CANDIDATES)) - 1e-9
    rows.unpersist()


def test_threshold_cut_and_nothing_to_learn(spark):
    rows = made_requests(spark, 3, 5)
    plain = rerank.fit_ranker(rows.withColumn("relevant", F.lit(True)))
    assert plain.weights == (1.0,) + (0.0,) * 7
    got = rerank.rerank(rows, plain, 2, 0.5).collect()
    by = {q: [r for r in got if r.query_id == q] for q in range(3)}
    scores = {(r.query_id, r.id): r.score for r in rows.collect()}
    for q, hits in by.items():
        assert len(hits) <= 2 and all(h.score >= 0.5 and h.original_score == scores[q, h.id] for h in hits)
        assert [h.id for h in sorted(hits, key=lambda h: h["rank"])] == [i for s, i in sorted(((-s, i) for (p, i), s in scores.items() if p == q))[: len(hits)]]
    assert rerank.fit_ranker(rows.limit(0)).weights[0] == 1.0


def test_requests_by_join_have_the_scores_of_literals(spark, sf_dir, tmp_path):
    docs = retrieval.titled(spark, sf_dir)
    search.index_postings(docs, str(tmp_path / "p"))
    pairs = spark.createDataFrame(search.query_terms(retrieval.KEYWORDS), "query_id bigint, term string")
    got = {(r.query_id, r.id, r.score) for r in search.bm25_requests(spark, str(tmp_path / "p"), pairs, 20).collect()}
    assert got == {(r.query_id, r.id, r.score) for r in search.bm25(docs, retrieval.KEYWORDS, ("text",), 20).collect()}


def test_fit_reads_stored_candidates(spark, sf_dir):
    """A fit makes many passes: each reads one small table, not the texts and postings again."""
    files = retrieval._judged(spark, sf_dir).inputFiles()
    assert files and all("/judged-" in f for f in files)
