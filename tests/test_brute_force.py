"""Queries without SQL, over their whole tables, against plain Python."""

import re
from collections import defaultdict

import pytest

from sparkloom.functions import text as tx
from sparkloom.operators import intervals
from sparkloom.plans import analytics, textual  # noqa: F401
from sparkloom.plans.catalog import QUERIES


def rows(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").collect()


def windows(duration):
    start, out = 0, []
    while start < duration:
        end = min(start + intervals.TARGET_MS, duration)
        if 0 < duration - end < intervals.LEAST_MS and duration - start <= intervals.MOST_MS:
            end = duration
        out.append((start, end))
        if end == duration:
            break
        start += intervals.TARGET_MS - intervals.OVERLAP_MS
    return out


def test_window_bounds(spark, sf_dir):
    want = {(r.o_orderkey, n, *w) for r in rows(spark, sf_dir, "orders") for n, w in enumerate(windows(r.o_orderkey % 200 * 1500))}
    got = [tuple(r) for r in QUERIES["w09_window_bounds"](spark, sf_dir).collect()]
    assert len(got) == len(want) and set(got) == want


def test_synonym_expansion(spark, sf_dir):
    asked = {(r.conv_id, r.turn): r.q for r in textual.requests(spark, sf_dir).collect()}
    got = {(r.conv_id, r.turn): r.variants for r in QUERIES["x05_x06_synonym_expansion"](spark, sf_dir).collect()}
    assert got.keys() == asked.keys()
    for at, q in asked.items():
        variants = [q, *(re.sub(rf"\b{a}\b", b, q) for a, b in textual.SYNONYMS.items())]
        assert got[at] == list(dict.fromkeys(variants))[:5]
    assert any(len(v) > 1 for v in got.values())


def terms(sentence):
    found = (w.lower() for w in re.findall(r"[a-zA-Z0-9]+", sentence))
    return list(dict.fromkeys(w for w in found if w not in tx.KEY_TERM_STOP_WORDS and (len(w) >= 5 or len(w) >= 3 and re.fullmatch("[0-9]+", w))))


def test_hallucination(spark, sf_dir):
    turns = defaultdict(list)
    for r in rows(spark, sf_dir, "conversations"):
        turns[r.conv_id].append(r)
    want = {}
    for conv, held in turns.items():
        held.sort(key=lambda r: r.turn)
        for before, r in zip(held, held[1:]):
            if r.role != "assistant" or before.text is None or r.text is None:
                continue
            for pos, s in enumerate(re.split("[.!?]+", r.text)):
                s = s.strip(" ").lower()
                found = terms(s)
                if len(s) >= 20 and found:
                    want[conv, r.turn, pos] = sum(t in before.text.lower() for t in found) / len(found)
    got = QUERIES["x18_x19_hallucination"](spark, sf_dir).collect()
    assert len(got) == len(want) > 0
    for r in got:
        share = want[r.conv_id, r.turn, r.pos]
        assert r.coverage == pytest.approx(share, abs=1e-6) and r.flagged == (share < 0.5)
    assert {r.flagged for r in got} == {True, False}


def test_encryption_restores_every_text(spark, sf_dir):
    texts = {r.doc_id: r.text for r in rows(spark, sf_dir, "documents")}
    got = {r.doc_id: r.restored for r in QUERIES["x39_field_encryption"](spark, sf_dir).collect()}
    assert got == {i: None if t is None else True for i, t in texts.items()}
