"""The seven quality metrics against plain definitions."""

import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from sparkloom.operators import quality_metrics as qm
from sparkloom.plans import pipelines  # noqa: F401
from sparkloom.plans.catalog import QUERIES

NAMES = ["context_precision", "context_recall", "faithfulness", "answer_relevancy", "context_entity_recall", "answer_similarity", "answer_correctness"]


def table_lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            rows[i][j] = rows[i - 1][j - 1] + 1 if x == y else max(rows[i - 1][j], rows[i][j - 1])
    return rows[-1][-1]


@given(st.lists(st.sampled_from("abcde"), max_size=40), st.lists(st.sampled_from("abcde"), max_size=90))
@settings(max_examples=200, deadline=None)
def test_common_subsequence(a, b):
    assert qm.common(a, b) == table_lcs(a, b) == qm.common(b, a)


def plain(q, a, contexts, g):
    w = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    cut = lambda t: [w(p) for p in re.split(r"[.!?\n]+", t or "") if w(p)]
    holds = lambda text, s: table_lcs(s, w(text)) >= 0.5 * len(s)
    f1 = lambda x, y: 2 * table_lcs(w(x), w(y)) / (len(w(x)) + len(w(y))) if w(x) and w(y) else 0.0
    claims, truths = cut(a), cut(g)
    relevant = [any(holds(c, s) for s in truths) for c in contexts]
    gains = [sum(relevant[: k + 1]) / (k + 1) for k in range(len(contexts)) if relevant[k]]
    names = set(re.findall(r"\d+", g or "")) | {x for p in re.split(r"[.!?\n]+", g or "") for x in re.findall(r"[^\W_]+", p)[1:] if x[0].isupper()}
    tp = sum(holds(g, s) for s in claims)
    fn = sum(not holds(a, s) for s in truths)
    both = bool(claims and truths)
    return {
        "context_precision": (sum(gains) / len(gains) if gains else 0.0) if truths else None,
        "context_recall": sum(any(holds(c, s) for c in contexts) for s in truths) / len(truths) if truths else None,
        "faithfulness": sum(any(holds(c, s) for c in contexts) for s in claims) / len(claims) if claims else None,
        "answer_relevancy": f1(q, a) if claims and w(q) else None,
        "context_entity_recall": len(names & set(re.findall(r"[^\W_]+", " ".join(c or "" for c in contexts)))) / len(names) if names else None,
        "answer_similarity": f1(a, g) if both else None,
        "answer_correctness": (0.75 * (2 * tp / (2 * tp + len(claims) - tp + fn) if tp else 0.0) + 0.25 * f1(a, g)) if both else None,
    }


def test_all_seven_against_plain_definitions(spark):
    rng = random.Random(6)
    pool = "red Blue sun 42 sea. Sky? the Rome 7 of\n and".split(" ")
    text = lambda n: " ".join(rng.choice(pool) for _ in range(rng.randint(0, n)))
    rows = [(i, text(8), text(20), [text(15) for _ in range(rng.randint(0, 4))], text(20)) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "q", "", [], ""), (102, "q", "an answer.", [None, ""], "Yes Rome."), (103, "red sun", "red sun.", ["red sun"], "red sun")]
    df = spark.createDataFrame(rows, "id long, question string, answer string, contexts array<string>, ground_truth string")
    got = {(r.id, r.metric): r.score for r in qm.evaluate(df).collect()}
    assert sorted(qm.METRICS) == sorted(NAMES) and len(got) == 7 * len(rows)
    for i, q, a, c, g in rows:
        for name, want in plain(q, a, c or [], g).items():
            assert got[i, name] == (pytest.approx(want) if want is not None else None), (i, name)
    assert all(got[103, n] == 1.0 for n in NAMES if n != "context_entity_recall")


def test_metrics_by_name(spark, monkeypatch):
    monkeypatch.setattr(qm, "METRICS", dict(qm.METRICS))
    qm.register("length", lambda s: float(len(qm.words(s.answer))))
    df = spark.createDataFrame([("x", "q", "two words", ["c"], "t")], "id string, question string, answer string, contexts array<string>, ground_truth string")
    assert [(r.id, r.metric, r.score) for r in qm.evaluate(df, ["unknown", "length"]).collect()] == [("x", "length", 2.0)]
    assert qm.evaluate(df, []).count() == 0


def test_metrics_of_all_answers(spark, sf_dir):
    rows = QUERIES["u08_quality_metrics"](spark, sf_dir).collect()
    answers = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("role = 'assistant'").count()
    assert len(rows) == 7 * answers and all(r.score is None or 0 <= r.score <= 1 for r in rows)
