"""Folds in order: hash chains, containment, spans, highlights, language profiles."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import spans, text as tx
from sparkloom.operators import chains, containment, intervals, language, search
from sparkloom.plans import analytics, extras, textual  # noqa: F401
from sparkloom.plans.catalog import QUERIES


def test_chain_of_a_user_with_half_of_all_rows(spark):
    rows = [("u1" if k % 2 else f"u{k % 9}", k * 7919 % 1000, None if k % 50 == 3 else f"body {k}") for k in range(1000)] + [(None, 5, "x")]
    df = spark.createDataFrame(rows, "user string, at int, body string").repartition(5)
    got = {(r.user, r.at): (r.previous_hash, r.chain_hash) for r in chains.chained(df, "user", ["at"], "body").collect()}
    want, last = {}, {}
    for user, at, body in sorted(rows, key=lambda r: r[1]):
        before = last.get(user, "")
        last[user] = hashlib.sha256((before + (body or "")).encode()).hexdigest()
        want[user, at] = (before, last[user])
    assert got == want
    assert "collect_list" not in chains.chained(df, "user", ["at"], "body")._jdf.queryExecution().toString()


def brute_first_texts(texts):
    kept = []
    for t in texts:
        t = (t or "").strip(" ")
        if t and not any(t in k or k in t for k in kept):
            kept.append(t)
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_containment_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(12):
        pool = ["".join(rng.choice("abé ") for _ in range(rng.choice([1, 3, 7, 8, 9, 31, 32, 33, 80, 400]))) for _ in range(12)]
        for turn in range(30):
            t = rng.choice(pool)
            a, b = sorted((rng.randint(0, len(t)), rng.randint(0, len(t))))
            rows.append((conv, turn, rng.choice([t, t[a:b], t + rng.choice(pool), "  " + t, None, ""])))
    df = spark.createDataFrame(rows, "key long, id long, text string").repartition(3)
    got = {}
    for r in containment.first_texts(df).collect():
        got.setdefault(r.key, {})[r.id] = r.text
    for conv in range(12):
        want = brute_first_texts([t for c, _, t in rows if c == conv])
        assert [t for _, t in sorted(got[conv].items())] == want


def test_containment_has_the_array_form_results(spark, sf_dir):
    rows = {r.conv_id: r for r in QUERIES["w10_text_dedup_in_order"](spark, sf_dir).collect()}
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    lists = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    for r in lists.withColumn("kept", intervals.first_texts(F.transform("texts", lambda t: F.trim(t)))).collect():
        assert (rows[r.conv_id].n, rows[r.conv_id].kept, rows[r.conv_id].letters) == (len(r.texts), len(r.kept), sum(map(len, r.kept)))


def brute_spans(text, patterns):
    found = []
    for kind, p in patterns.items():
        for m in re.finditer(p, text or ""):
            if all(m.end() <= a or m.start() >= b for _, a, b in found):
                found.append((kind, m.start(), m.end()))
    return found


def test_guardrail_spans_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = QUERIES["x15_guardrail_pii"](spark, sf_dir)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.start, r.stop))
    want = {i: found for i, t in texts.items() if (found := brute_spans(t, tx.PII))}
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()} and want


def test_spans_of_odd_texts(spark):
    odd = ["é123-45-6789 and a@b.co, 123-45-6789", "555-123-4567555-123-4567", "", None, "😀 a@b.co 4111111111111111é 10.0.0.1", "a@b.coa@b.co 1/2/2024"]
    patterns = {k: "(?U)" + p for k, p in tx.PII.items()}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").select("i", spans.first_come_spans(F.col("t"), patterns).alias("s")).collect()
    for r in rows:
        assert [tuple(x) for x in r.s or []] == brute_spans(odd[r.i], tx.PII), odd[r.i]


def test_best_fragments_not_the_first(spark):
    filler = "x" * 145
    text = " ".join(["the " + filler, "the " + filler, "the " + filler, "der the " + filler[:-4], "none " + filler])
    df = spark.createDataFrame([(text,)], "t string")
    first = lambda terms, most: [re.findall("<em>(.*?)</em>", h) for h in df.select(search.highlights(F.col("t"), terms, most=most).alias("h")).first().h]
    assert first(["the", "der"], 1) == [["der", "the"]]
    assert first(["the", "der"], 3) == [["the"], ["the"], ["der", "the"]]
    assert first({"the": 1.0, "der": 0.0}, 3) == [["the"]] * 3


def test_language_profiles_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit_profiles(docs.filter("doc_id % 2 = 0").select("text", "lang"), rows=60)
    held = docs.filter("doc_id % 2 <> 0 and length(trim(text)) >= 10")
    right = held.select((language.detected(F.col("text"), model) == F.col("lang")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert right >= 0.95
    literals = {
        "Waar kan ik de handleiding van dit apparaat vinden?": "nl",
        "Where can I find the manual of this device?": "en",
        "Het is vandaag mooi weer en wij gaan naar het strand": "nl",
        "kort": "en",
        "12345 67890 !!": "en",
        "ΑΒΓΔΕ ΖΗΘΙΚΛ": "en",
    }
    rows = spark.createDataFrame([(t,) for t in [*literals, None, ""]], "t string")
    got = {r.t: r.l for r in rows.select("t", language.supported(language.detected(F.col("t"), model)).alias("l")).collect()}
    assert got == {**literals, None: "en", "": "en"}
    spanish = rows.limit(1).select(language.supported(F.lit("es")).alias("l")).first().l
    assert spanish == "en"


def test_language_profiles_without_labels(spark):
    model = language.fit_profiles(spark.createDataFrame([(None, None)], "text string, lang string"))
    assert model.languages == ("en", "nl") and model.best("Dit is een zin in het Nederlands") == "nl" and model.best("中") is None
