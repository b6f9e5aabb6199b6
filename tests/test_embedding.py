"""Learned embeddings against brute force, batches and retries."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkloom.operators import embedding
from sparkloom.plans import pipelines  # noqa: F401  it registers its queries
from sparkloom.plans.catalog import QUERIES


def test_waits_double_and_the_last_failure_is_raised():
    calls, waits = [], []

    def fails(times):
        def encode(texts):
            calls.append(len(texts))
            if len(calls) <= times:
                raise ConnectionError("not yet")
            return np.ones((len(texts), 2))

        return encode

    assert embedding.with_retries(fails(2), ["a", "b"], 3, 0.5, waits.append).shape == (2, 2)
    assert calls == [2, 2, 2] and waits == [0.5, 1.0]
    calls.clear()
    with pytest.raises(ConnectionError):
        embedding.with_retries(fails(9), ["a"], 3, 0, waits.append)
    assert len(calls) == 3
    with pytest.raises(ValueError):
        embedding.with_retries(lambda texts: np.ones((1, 2)), ["a", "b"], 1, 0)


def test_groups_are_small_and_failing_ones_are_tried_again(spark):
    seen = {}

    def flaky(texts):
        if len(texts) > 3:
            raise AssertionError("too many at once")
        key = tuple(texts)
        seen[key] = seen.get(key, 0) + 1
        if seen[key] == 1:
            raise ConnectionError("the first call of each group fails")
        return np.array([[len(t or ""), seen[key]] for t in texts])

    docs = spark.createDataFrame([(i, "x" * i if i != 5 else None, i * 2) for i in range(20)], "id int, text string, batch int").repartition(2)
    got = {r.id: r for r in embedding.embed(docs, flaky, most=3, attempts=2, wait=0.0).collect()}
    assert len(got) == 20 and all(r.embedding == [0 if i == 5 else i, 2] and r.batch == 2 * i for i, r in got.items())
    with pytest.raises(Exception, match="first call"):
        embedding.embed(docs, flaky, most=3, attempts=1, wait=0.0).collect()
    assert embedding.embed(docs.limit(0), flaky).count() == 0


def test_information_against_brute_force(spark):
    texts = ["red fish blue fish !!", "one red sun", "blue sea | blue sky", None, "", "fish"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    words, rarity = embedding.vocabulary(docs, 100)
    n = Counter(w for t in texts for w in set(embedding.terms(t)))
    assert words == [w for w, k in sorted(n.items(), key=lambda p: (-p[1], p[0])) if k >= 2]
    assert np.allclose(rarity, [math.log1p(len(texts) / n[w]) for w in words])
    words = sorted(n)
    pairs = Counter()
    for t in texts:
        w = embedding.terms(t)
        for i in range(len(w)):
            for j in range(max(0, i - embedding.SPAN), min(len(w), i + embedding.SPAN + 1)):
                if i != j:
                    pairs[w[i], w[j]] += 1
    counted = embedding.co_occurrence(docs, words)
    assert {(words[r.word], words[r.context]): r.n for r in counted.collect()} == pairs
    total = Counter()
    for (a, _), k in pairs.items():
        total[a] += k
    whole = sum(v**embedding.FLAT for v in total.values())
    want = {(a, b): math.log(k * whole / (total[a] * total[b] ** embedding.FLAT)) for (a, b), k in pairs.items()}
    got = {(words[r.word], words[c]): v for r in embedding.information(counted).collect() for c, v in zip(r.contexts, r["values"], strict=True)}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 0})


def test_factors_are_those_of_the_dense_matrix(spark):
    rng = np.random.default_rng(2)
    half = rng.standard_normal((30, 4))
    dense = half @ half.T
    rows = spark.createDataFrame([(i, list(range(30)), [float(x) for x in row]) for i, row in enumerate(dense)], "word int, contexts array<int>, values array<double>")
    vectors = embedding.factors(rows, 30, dims=6)
    assert vectors.shape == (30, 6) and np.allclose(vectors @ vectors.T, dense, atol=1e-6)


def hashed(text, dims=64):
    v = np.zeros(dims)
    for w in (text or "").lower().split():
        h = zlib.crc32(w.encode())
        v[h % dims] += 1 if h & 0x8000 else -1
    return v / (np.linalg.norm(v) or 1)


def test_neighbours_agree_with_labels_better_than_hashes_do(spark, sf_dir):
    larger = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{larger}/documents.parquet").collect()}
    learned = {r.doc_id: np.array(r.embedding) for r in QUERIES["v09_v10_embed"](spark, larger).collect()}
    assert learned.keys() == texts.keys() and {len(v) for v in learned.values()} == {embedding.DIMS}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-5 or not v.any() for v in learned.values())
    ids = sorted(labels)

    def agreement(vectors, field):
        x = np.stack([vectors[i] for i in ids])
        y = np.array([labels[i][field] for i in ids])
        scores = x @ x.T
        np.fill_diagonal(scores, -9)
        return (y[np.argsort(-scores, axis=1)[:, :5]] == y[:, None]).mean()

    plain = {i: hashed(texts[i]) for i in ids}
    for field in ("quality", "toxic"):
        assert agreement(learned, field) > agreement(plain, field)


def test_a_corpus_without_words(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, "once")], "doc_id long, text string")
    embedding.fit_word_vectors(docs, str(tmp_path / "m"))
    model = embedding.load_word_vectors(spark, str(tmp_path / "m"))
    assert [r.embedding for r in embedding.embed(docs, model).collect()] == [[0.0] * embedding.DIMS] * 2


def test_pairs_are_counted_whole_however_many_a_task_holds(spark, monkeypatch):
    docs = spark.createDataFrame([("red sea red sky",), ("sea sky",), (None,), ("",)] * 5, "text string").coalesce(1)
    words, found = ["red", "sea", "sky"], []
    for held in (1, 7, 1 << 22):
        monkeypatch.setattr(embedding, "HELD_PAIRS", held)
        found.append(sorted(map(tuple, embedding.co_occurrence(docs, words).collect())))
    assert found[0] == found[1] == found[2] and sum(n for *_, n in found[0]) == 5 * (12 + 2)
