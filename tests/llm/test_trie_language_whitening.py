"""The prefix trie, language identification and whitening against brute force and on awkward inputs."""

import hashlib
import math
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import language_id, prefix_trie, registry, whitening

TURNS = "conv_id long, turn long, role string, text string, depth int, p1 string, rank long, block int, first string"


# --- prefix trie ---------------------------------------------------------------------------------


def brute_trie(rows, group=100, heads=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        paths[c] = tuple(own.get(c - int(math.fmod(c, group)), [])[:h] + own[c][h:])
    nodes = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[p[:d]].append(c)
    kids = defaultdict(set)
    for p in nodes:
        if p:
            kids[p[:-1]].add(p)

    def subtree(p):
        yield p
        for q in kids[p]:
            yield from subtree(q)

    out = set()
    for p, members in nodes.items():
        below = list(subtree(p))
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(p))
        out.add(
            (
                min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids[p]), sum(not kids[q] for q in below),
                sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return out


def trie(spark, rows):
    df = spark.createDataFrame([(*r, 1, "p", 2, 3, "f") for r in rows], TURNS)
    return prefix_trie.conversation_trie(df).collect()


NARROW = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def made_conversations():
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c % 7 if t < 3 else c} {t}") for c in range(0, 260, 3) for t in range(c % 9)]
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(4)]  # a group of equal conversations
    rows += [(1000, t, "user", "x" * (t % 5)) for t in range(60)] + [(1001, t, "user", "x" * (t % 5)) for t in range(40)]
    rows += [(-105, 0, "user", "below zero"), (-105, None, None, None), (None, 0, "user", "nobody's"), (777, 5, None, "no role"), (777, 6, "user", None)]
    rows += [(c, 0, "user", "only turn") for c in range(4000, 4060)]  # some of them lose it: the root is their end
    return rows


@pytest.mark.parametrize("chunk, piece", [(4096, 1 << 15), (4, 3)])
def test_trie_against_brute_force(spark, monkeypatch, chunk, piece):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    monkeypatch.setattr(prefix_trie, "HEAVY", 8)
    rows = made_conversations()
    got = trie(spark, rows)
    assert sorted(map(str, (tuple(r[c] for c in NARROW) for r in got))) == sorted(map(str, brute_trie(rows)))
    assert sorted(r.preorder for r in got) == list(range(len(got)))
    # Intervals nest as the tree does, and sizes of subtrees follow from them.
    by_place = {r.preorder: r for r in got}
    for r in got:
        inside = [by_place[p] for p in range(r.preorder, r.subtree_end + 1)]
        assert sum(x.n_children == 0 for x in inside) == r.n_leaves
        assert all(x.depth > r.depth for x in inside[1:])


def test_trie_of_repeated_rows_ties_and_nothing(spark):
    rows = [(0, 0, "user", "a"), (0, 0, "user", "a"), (0, 1, "user", "b"), (7, 3, "user", "long " * 200_000)]
    got = {tuple(r[c] for c in NARROW) for r in trie(spark, rows)}
    assert got == brute_trie(rows)
    tied = trie(spark, [(0, 0, "user", "a"), (0, 0, "user", "b"), (0, 0, "system", "c")])
    assert [r.depth for r in sorted(tied, key=lambda r: r.depth)] == [0, 1, 2, 3]
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "a")]) == []


def test_running_sums_over_chunks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(prefix_trie, "CHUNK", 8)
    df = spark.range(3, 60).select((F.col("id") % 1).alias("g"), F.col("id").alias("o"), F.col("id").alias("x"))

    def write(d, tag):
        d.write.parquet(f"{tmp_path}/{tag}")
        return spark.read.parquet(f"{tmp_path}/{tag}")

    for group in ("g", None):
        got = {r.o: r.x for r in prefix_trie.running(df, group, "o", ["x"], write, f"t{group}").collect()}
        assert got == {k: sum(range(3, k + 1)) for k in range(3, 60)}


# --- language identification ---------------------------------------------------------------------


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = registry.op12_language_id(spark, sf_dir).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_filters_hold_what_sets_hold(spark, sf_dir):
    """Every chosen n-gram is in its language's filter, foreign ones pass at the stated rate, and corrected votes are near those of exact sets."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    filters = language_id.fit_filters(docs)
    counts = defaultdict(lambda: defaultdict(int))
    for text, lang in docs.collect():
        for h in np.concatenate([*language_id.pieces(text or ""), np.empty(0, np.uint64)]):
            counts[lang][int(h)] += 1
    totals = {lang: sum(c.values()) for lang, c in counts.items()}
    every = set().union(*counts.values())
    top = {h: max(c.get(h, 0) / totals[lang] for lang, c in counts.items()) for h in every}
    exact = {lang: {h for h, n in c.items() if n >= language_id.LEAST and n / totals[lang] >= language_id.SHARE * top[h]} for lang, c in counts.items()}
    assert set(filters.languages) == set(exact)
    false = filters.false_positives()
    for i, lang in enumerate(filters.languages):
        inside = np.array(sorted(exact[lang]), np.uint64)
        assert filters.bit(filters.languages_of(inside), i).all()
        foreign = np.array(sorted(every - exact[lang]), np.uint64)
        assert filters.bit(filters.languages_of(foreign), i).mean() <= 3 * false[i] + 0.002
    for text, _ in docs.limit(20).collect():
        hashes = [int(h) for p in language_id.pieces(text or "") for h in p]
        if hashes:
            want = [sum(h in exact[lang] for h in hashes) for lang in filters.languages]
            assert np.allclose(filters.votes(text, false), want, atol=0.02 * len(hashes) + 2)


def test_language_bounds_keep_the_most_frequent(spark, monkeypatch, tmp_path):
    rows = [(0, g, int(1e6 * 0.95**g)) for g in range(100)] + [(1, 1000 + g, 5) for g in range(10)]
    table = spark.createDataFrame(rows, "language int, gram long, n long")

    def write(d, tag):
        d.write.parquet(f"{tmp_path}/{tag}")
        return spark.read.parquet(f"{tmp_path}/{tag}")

    got = {(r.language, r.gram) for r in language_id.chosen_grams(table, write, 60).collect()}
    assert {g for lang, g in got if lang == 1} == set(range(1000, 1010))
    first = {g for lang, g in got if lang == 0}
    assert first == set(range(len(first))) and 50 <= len(first) <= 60


def test_pieces_of_a_long_text_are_its_n_grams(monkeypatch):
    text = "Ünder the Grüße — 12 mañana, über alles! " * 30
    whole = np.concatenate(list(language_id.pieces(text)))
    monkeypatch.setattr(language_id, "PIECE", 7)
    assert sorted(np.concatenate(list(language_id.pieces(text)))) == sorted(whole)
    assert language_id.code_points("12 -- !").size == 0


def test_many_languages_and_awkward_rows(spark):
    """More than 64 languages need a second word of bits; nulls, texts without letters and clashing columns have stated results."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    names = [f"l{k:02d}" for k in range(70)]
    word = lambda k: alphabet[k % 26] * 3 + alphabet[k // 26] * 2
    rows = [(i, f"{word(k)} {word(k)} {word(k)}", name, "s", "t", 1) for k, name in enumerate(names) for i in range(4 * k, 4 * k + 4)]
    odd = [(-1, None, "l01", "s", "t", 1), (-2, "12 .. !", "l01", "s", "t", 1), (-3, "", None, None, None, None), (None, word(69), None, "s", "t", 1), (0, rows[0][1], "l00", "s", "t", 1)]
    schema = "doc_id long, text string, lang string, source string, language string, held_out int"
    got = language_id.identify(spark.createDataFrame(rows + odd, schema)).collect()
    assert len(got) == len(rows) + len(odd)
    found = {r.doc_id: r for r in got}
    assert all(found[i].lang_pred == name for i, _, name, *_ in rows)
    assert [found[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and found[None].lang_pred == "l69" and not found[None].held_out
    assert language_id.identify(spark.createDataFrame([], schema)).count() == 0
    unlabelled = language_id.identify(spark.createDataFrame([(1, "some words", None, None, None, None)], schema)).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]


# --- whitening -----------------------------------------------------------------------------------

SCHEMA = "vec_id long, embedding array<float>, x int, n string, component int"


def table_of(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "n", 2) for i, v in vectors], SCHEMA)


def test_whitening_against_exact_arithmetic(spark, sf_dir):
    source = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in source.items()}
    n, d = len(x), len(next(iter(x.values())))
    sums = [sum(v[j] for v in x.values()) for j in range(d)]
    exact = [[Fraction(sum((n * v[a] - sums[a]) * (n * v[b] - sums[b]) for v in x.values()), n**3) for b in range(d)] for a in range(d)]
    cov = np.array([[float(c) for c in row] for row in exact])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    rows = registry.op13_whitening(spark, sf_dir).collect()
    k = min(32, d)
    assert len(rows) == n * k and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error <= 1e-10
    sign = {}
    for r in rows:
        v, j = x[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        assert r.explained == pytest.approx(values[j] / values.sum(), rel=1e-9)
        want = float(sum(float(Fraction(n * a - s, n)) * vectors[i, j] for i, (a, s) in enumerate(zip(v, sums, strict=True))) / math.sqrt(values[j]))
        if abs(want) > 1e-3:
            sign.setdefault(j, np.sign(want * r.whitened))
            assert r.whitened == pytest.approx(want * sign[j], rel=1e-6)


def test_covariance_is_exact_beyond_doubles():
    """Spread of one part in 2**40 of the offset, where sums of plain products keep no digit."""
    rng = np.random.default_rng(3)
    x = (1 << 45) + rng.integers(-9, 10, (3000, 4))
    n, sums = len(x), [int(s) for s in x.sum(0)]
    parts = whitening.Centre(n, tuple(sums)).parts()
    total = np.zeros((4, 4)), np.zeros((4, 4))
    for at in range(0, n, whitening.BLOCK):
        total = whitening.add(total, whitening.gram(*whitening.centred(x[at : at + whitening.BLOCK], parts)))
    for a in range(4):
        for b in range(4):
            want = Fraction(sum((n * int(p) - sums[a]) * (n * int(q) - sums[b]) for p, q in zip(x[:, a], x[:, b], strict=True)), n * n)
            got = Fraction(float(total[0][a, b])) + Fraction(float(total[1][a, b]))
            assert abs(got - want) <= abs(want) * Fraction(1, 1 << 90) + Fraction(1, 1 << 80)


def test_gram_of_wide_ranges():
    rng = np.random.default_rng(5)
    hi = rng.standard_normal((700, 5)) * 10.0 ** rng.integers(-9, 9, (1, 5))
    lo = hi * 2.0**-55
    got = whitening.gram(hi, lo)
    for a in range(5):
        for b in range(5):
            want = sum((Fraction(float(p)) + Fraction(float(r))) * (Fraction(float(q)) + Fraction(float(s))) for p, q, r, s in zip(hi[:, a], hi[:, b], lo[:, a], lo[:, b], strict=True))
            scale = Fraction(float(np.abs(hi).max())) ** 2 * 700
            assert abs(Fraction(float(got[0][a, b])) + Fraction(float(got[1][a, b])) - want) <= scale * Fraction(1, 1 << 98)


def test_eigenvectors_of_close_eigenvalues():
    """Refinement brings vectors of nearly equal eigenvalues to full precision."""
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((6, 6)))
    wanted = np.array([5.0, 1 + 1e-7, 1.0, 0.5, 1e-3, 1e-6])
    q = np.longdouble(q)
    for _ in range(3):
        q = q @ (1.5 * np.eye(6) - 0.5 * q.T @ q)
    exact = q @ np.diag(np.longdouble(wanted)) @ q.T
    hi = np.float64(exact)
    values, vectors = whitening.eigen(hi, np.float64(exact - hi))
    assert np.allclose(values, wanted, rtol=1e-14)
    assert np.abs(np.abs((vectors * np.float64(q)).sum(0)) - 1).max() < 1e-12
    assert np.abs(np.float64(vectors.T @ q) - np.diag(np.diag(np.float64(vectors.T @ q)))).max() < 1e-11


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(v) for v in rng.standard_normal(3)]) for i in range(40)]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [float("nan"), 1.0, 1.0]), (53, [float("inf"), 1.0, 1.0]), (54, []), (55, [1.0, 2.0])]
    twice = [(3, good[3][1]), (None, good[4][1])]
    got = whitening.whiten(table_of(spark, good + bad + twice)).collect()
    assert len(got) == 42 * 3 and {r.n for r in got} == {42} and {r.component for r in got} == {1, 2, 3}
    assert sum(r.vec_id == 3 for r in got) == 6 and sum(r.vec_id is None for r in got) == 3
    # A dimension without spread is no component; equal vectors have none.
    flat = [(i, [float(i), 7.0]) for i in range(5)]
    assert {r.component for r in whitening.whiten(table_of(spark, flat)).collect()} == {1}
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, None)]):
        assert whitening.whiten(table_of(spark, rows)).count() == 0


def test_deviation_beyond_64_bits():
    model = whitening.Whitening(whitening.Centre(10**7, (0,)), np.ones(1), np.ones((1, 1)), 1.0)
    assert model.deviation(np.array([[3], [10**6]])) == [9 * 10**14, None]
