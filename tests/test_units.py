"""Operators on constants: chunking, parsers, fusion invariants, access rules, intervals."""

import io
import re
import zipfile

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import filters, text
from sparkloom.operators import chunking, fusion, intervals, reporting, search, tables, vector_index
from sparkloom.sources import parsers

CONFIG = chunking.Config(target=20, most=30, overlap=5, least=5)


@given(st.text(alphabet="ab .,;!?\n", max_size=800))
@settings(max_examples=60, deadline=None)
def test_recursive_chunks_keep_all_words(body):
    chunks = chunking.recursive(body, chunking.Config(20, 30, 0, 5))
    assert "".join("".join(c.content.split()) for c in chunks) == "".join(body.split())
    assert all(c.content.strip() for c in chunks)


def test_semantic_overlap_and_long_sentences():
    body = " ".join(f"Sentence number {k} has some words." for k in range(20)) + " " + "word " * 100
    chunks = chunking.semantic(body, CONFIG)
    assert all(chunking.count(c.content) <= CONFIG.most for c in chunks)
    assert chunking.trailing(["one two three.", "four."], 2) == ["four."]


def test_sections_and_headings():
    body = "# One\nalpha\n1.2 Next Title\nbeta\nALL CAPS HERE\ngamma\nOverview:\ndelta\n"
    assert [s[0] for s in chunking.sections(body)] == ["One", "1.2 Next Title", "ALL CAPS HERE", "Overview"]
    assert chunking.sections("plain text only") == [(None, 0, "plain text only")]
    assert {c.section for c in chunking.hierarchical(body, CONFIG)} == {"One", "1.2 Next Title", "ALL CAPS HERE", "Overview"}


def test_question_pairs():
    marked = "\n".join(f"Q: what is {k}?\nA: it is {k}\nmore" for k in range(3))
    assert chunking.qa_pairs(marked)[0] == ("what is 0?", "it is 0\nmore")
    assert len(chunking.qa(marked, CONFIG)) == 3
    assert chunking.qa_pairs("Is it so?\n\nYes it is.\n\nFine.") == [("Is it so?", "Yes it is.")]
    long = "\n".join(f"Q: what is {k}?\nA: " + "long answer. " * 200 for k in range(3))
    assert any("(continued)" in c.content for c in chunking.qa(long, CONFIG))


def test_tables():
    md = "intro\n| a | b |\n|---|---|\n| 1 | 2 |\n| ragged |\n| 3 | 4 |\n"
    assert chunking.markdown_table(md) == (["a", "b"], [["1", "2"], ["3", "4"]])
    assert chunking.csv_table('a,b\n"x, y",2\n') == (["a", "b"], [["x, y", "2"]])
    assert chunking.csv_table("a,b\nc\n") is None
    rows = "a,b\n" + "\n".join(f"{k},value {k}" for k in range(50))
    chunks = chunking.tabular(rows, CONFIG)
    assert len(chunks) > 1 and all(c.content.startswith("a | b\n") for c in chunks)
    kinds = [k for k, _ in chunking.zones("text\n```\ncode | x\n```\n| a | b |\n|---|---|\n| 1 | 2 |")]
    assert kinds == ["prose", "code", "table"]
    assert {c.kind for c in chunking.mixed("text here.\n```\ncode\n```\n", CONFIG)} == {"prose", "code"}


@pytest.mark.parametrize(
    ("profile", "want"),
    [
        ({"extension": "csv"}, "tabular"),
        ({"blocks": 10, "tables": 3}, "tabular"),
        ({"pairs": 3}, "qa"),
        ({"variance": 0.3, "blocks": 10, "tables": 1}, "mixed"),
        ({"extension": "md", "headings": 2}, "hierarchical"),
        ({"extension": "md"}, "recursive"),
        ({"blocks": 10, "structured": 3}, "hierarchical"),
        ({"blocks": 10, "code": 4, "n_bytes": 9000}, "recursive"),
        ({"n_bytes": 2000, "density": 3.0}, "hierarchical"),
        ({"n_bytes": 2000, "mean_sentence": 130, "prose": 0.7}, "semantic"),
        ({"n_bytes": 6000, "prose": 0.7}, "semantic"),
        ({"n_bytes": 6000, "extension": "html", "headings": 2}, "hierarchical"),
        ({"n_bytes": 6000}, "recursive"),
    ],
)
def test_strategy_rules(profile, want):
    assert chunking.select_for(profile) == want


def test_strategy_names():
    assert [chunking.strategy_name(x) for x in ("FAQ", "semantic", None, "odd")] == ["qa", "semantic", "auto", "auto"]


def test_html():
    p = parsers.parse_html(
        b"<title>T &amp; U</title><script>no</script><h1>Head</h1><p>Para <b>bold</b></p><pre>x = 1\n</pre><a href='#x'>a</a><a href='/y'>b</a>"
        b"<table><caption>Cap</caption><tr><th>h1</th><th>h2</th></tr><tr><td>1</td><td>2</td></tr></table>"
    )
    assert p.title == "T & U" and p.links == ["/y"]
    assert p.blocks == [("text", "Head"), ("text", "Para bold"), ("code", "x = 1\n")]
    assert p.tables == [{"headers": ["h1", "h2"], "rows": [["1", "2"]], "caption": "Cap"}]
    assert "no" not in p.text.split("\n")
    assert parsers.table_text(["a", "b"], [["1", "2"]], "C") == "C\na | b\n-----\n1 | 2"


def test_markdown_pages_docx():
    p = parsers.parse_markdown(b"---\nauthor: X\n---\n# Title\ntext one\n\n```\ncode\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n")
    assert (p.title, p.meta) == ("Title", {"author": "X"})
    assert ("code", "code") in p.blocks and p.tables[0]["rows"] == [["1", "2"]]
    assert parsers.front_matter("---\nno colon\n---\nx")[0] == {}
    assert parsers.parse_pages(b"one\f \ftwo").meta == {"page_count": "2"}
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hi</w:t></w:r></w:p><w:tbl><w:tr>{cell("a")}</w:tr><w:tr>{cell("1")}</w:tr></w:tbl></w:body></w:document>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", xml)
    d = parsers.parse_docx(buffer.getvalue())
    assert d.blocks == [("text", "Hi")] and d.tables == [{"headers": ["a"], "rows": [["1"]], "caption": None}]


def test_table_headers():
    rows = "<tr><td>1</td><td>2</td></tr><tr><th>a</th><th>b</th></tr><tr><td>3</td><td>4</td></tr>"
    read = lambda inner: parsers.parse_html(f"<table>{inner}</table>".encode()).tables
    assert read(f"<thead><tr><td>x</td></tr></thead>{rows}")[0] == {"headers": ["x"], "rows": [["1", "2"], ["a", "b"], ["3", "4"]], "caption": None}
    assert read(rows)[0] == {"headers": ["a", "b"], "rows": [["1", "2"], ["3", "4"]], "caption": None}
    assert read("<tr><td>1</td></tr><tr><td>2</td></tr>")[0] == {"headers": ["1"], "rows": [["2"]], "caption": None}
    assert read("") == []


def neighbours(rows, asked, k=10):
    return {(r.query_id, r.id) for r in search.vector_search(rows, asked, k).collect()}


@pytest.mark.parametrize("literals", [0, 10_000])
def test_approximate_search_has_the_recall(spark, tmp_path, monkeypatch, literals):
    monkeypatch.setattr(vector_index, "MOST_LITERALS", literals)
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").withColumnRenamed("vec_id", "id")
    asked = rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    path = str(tmp_path / "index")
    vector_index.index_vectors(rows, path)
    assert spark.read.parquet(f"{path}/codes").count() == spark.read.parquet(f"{path}/vectors").count() == rows.count()
    hits = vector_index.search_index(spark, path, asked, 10).collect()
    exact = search.vector_search(rows, asked, 10).collect()
    want = {(r.query_id, r.id): r.score for r in exact}
    found = {(r.query_id, r.id): r.score for r in hits}
    assert len(want) == 10 * asked.count() and len(found.keys() & want.keys()) >= 0.9 * len(want)
    assert all(abs(s - want[k]) < 1e-8 for k, s in found.items() if k in want)
    # The exact search against brute force, ties by id.
    vectors = {r.id: r.embedding for r in rows.collect()}
    for q in (0, 50):
        scores = sorted((-round(sum(a * b for a, b in zip(vectors[q], v, strict=True)), 9), i) for i, v in vectors.items())[:10]
        assert [i for _, i in scores] == [r.id for r in sorted(exact, key=lambda r: r.rank) if r.query_id == q]


def test_approximate_search_reads_few_lists(spark, tmp_path, monkeypatch):
    """Clustered vectors: each request reads at most a tenth of the codes and fewer vectors, by partition filters; a third of all
    vectors are equal and their list is split."""
    import numpy as np

    monkeypatch.setattr(vector_index, "PART_ROWS", 300)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 15)) * 4
    made = [(i, (centres[i % 40] + rng.standard_normal(15)).tolist()) for i in range(4000)] + [(i, centres[0].tolist()) for i in range(4000, 6000)]
    rows = spark.createDataFrame([*made, (9000, None), (9001, [1.0])], "id bigint, embedding array<double>")
    path = str(tmp_path / "index")
    vector_index.index_vectors(rows, path, lists=60)
    codes = spark.read.parquet(f"{path}/codes")
    assert codes.count() == 6000 and codes.groupBy("list", "part").count().agg(F.max("count")).first()[0] < 500
    near = [i for i in range(50, 4000, 50) if i % 40]
    found, want = set(), set()
    for i in near[:3]:
        asked = rows.filter(F.col("id") == i).select(F.col("id").alias("query_id"), "embedding")
        hits = vector_index.search_index(spark, path, asked, 10)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        lists = [[int(x) for x in m.split(",")] for m in re.findall(r"PartitionFilters: \[list#\d+ IN \(([\d,]+)\)", plan)]
        lists += [[int(x)] for x in re.findall(r"PartitionFilters: \[isnotnull\(list#\d+\), \(list#\d+ = (\d+)\)", plan)]
        assert lists and "In(id" in plan, plan
        probed = vector_index.candidates(spark, path, asked, 80).select("list").distinct()
        assert codes.join(probed, "list").count() <= 600
        found |= {(r.query_id, r.id) for r in hits.collect()}
        want |= neighbours(rows, asked)
    assert len(found & want) >= 0.9 * len(want)
    every = rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    hits, exact = vector_index.search_index(spark, path, every, 10).collect(), search.vector_search(rows, every, 10).collect()
    # Equal vectors tie: scores are compared, not ids.
    best = {(r.query_id, r["rank"]): r.score for r in exact}
    assert sum(abs(r.score - best[r.query_id, r["rank"]]) < 1e-6 for r in hits) >= 0.9 * len(best)


def test_approximate_search_of_few_or_no_vectors(spark, tmp_path):
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None)], "query_id bigint, embedding array<double>")
    for name, rows, ids in (("none", [], []), ("null", [(1, None)], []), ("two", [(1, [1.0, 2.0]), (2, [3.0, 1.0])], [2, 1])):
        path = str(tmp_path / name)
        vector_index.index_vectors(spark.createDataFrame(rows, "id bigint, embedding array<double>"), path)
        got = vector_index.search_index(spark, path, asked, 5).collect()
        assert [(r.query_id, r.id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, i) for i in ids]


def test_search_of_many_blocks_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    rows = spark.createDataFrame([(k, [float(k % 3), 1.0]) for k in range(20)] + [(30, [1.0]), (31, None)], "id bigint, embedding array<double>")
    asked = spark.createDataFrame([(q, [1.0, 0.0]) for q in range(5)], "query_id bigint, embedding array<double>")
    got = search.vector_search(rows, asked, 3, 0.5).collect()
    assert {q: [r.id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in range(5)} == {q: [2, 5, 8] for q in range(5)}
    assert search.vector_search(rows, asked.limit(0), 3).count() == 0


def test_highlights(spark):
    text = "Thé the " + "x" * 160 + " THE. " + "y " * 200 + "them der" + " z" * 300 + " the the"
    row = spark.createDataFrame([(text,), ("none",), (None,)], "t string").select(search.highlights(F.col("t"), ["the", "der"]).alias("h")).collect()
    assert [x.count("<em>") for x in row[0].h] == [1, 1, 1] and row[0].h[0].startswith("Thé <em>the</em>") and "<em>THE</em>." in row[0].h[1]
    assert all(len(x.replace("<em>", "").replace("</em>", "")) <= 150 for x in row[0].h)
    assert row[1].h == [] and row[2].h is None


def test_fetch_of_a_missing_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    files = parsers.list_files(spark, str(tmp_path))
    one = files.first().source_id
    assert parsers.fetch(files, one).count() == 1
    with pytest.raises(FileNotFoundError):
        parsers.fetch(files, one + "x")


def test_fetch_of_several_files(spark, tmp_path):
    for name in ("a.txt", "b.txt", "c.txt"):
        (tmp_path / name).write_text(name * 3)
    files = parsers.list_files(spark, str(tmp_path))
    ids = {r.name: r.source_id for r in files.collect()}
    wanted = spark.createDataFrame([(ids["a.txt"],), (ids["c.txt"],), (ids["a.txt"] + "x",), (None,)], "source_id string")
    got = {(r.source_id, r.found, bytes(r.content) if r.content else None) for r in parsers.fetch_many(files, wanted).collect()}
    assert got == {(ids["a.txt"], True, b"a.txt" * 3), (ids["c.txt"], True, b"c.txt" * 3), (ids["a.txt"] + "x", False, None), (None, False, None)}


def test_extension_points(spark):
    with pytest.raises(ValueError):
        filters.acl_rows(spark.range(1), {"odd": F.lit(1)})
    with pytest.raises(ValueError):
        reporting.report(spark.range(1).toDF("n"), "nowhere", ["odd"])
    bare = filters.acl_rows(spark.range(1), {}).first()
    assert bare.status == "active" and bare.allowed_groups == [] and bare.tenant_id is None


@pytest.mark.parametrize(
    ("extension", "kinds", "tables", "want"),
    [("csv", [], 0, "tabular"), ("", ["text"] * 3, 1, "tabular"), ("", ["text"] * 9 + ["code"], 2, "mixed"), ("md", ["heading"] * 2, 0, "hierarchical"), ("", ["code", "text"], 0, "recursive"), ("", ["heading"] * 3, 0, "hierarchical")],
)
def test_blocks_take_part_in_the_strategy(extension, kinds, tables, want):
    assert chunking.select_for(chunking.profile("plain words without any sign " * 80, extension, kinds, tables)) == want


def test_listing(spark, tmp_path):
    (tmp_path / "a.MD").write_text("# A\nx")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.txt").write_text("plain\0text")
    (tmp_path / "c.bin").write_bytes(b"\xff")
    files = parsers.list_files(spark, str(tmp_path), ("md", "TXT"))
    rows = parsers.parse(files, F.col("name"), F.col("content"), F.col("extension")).collect()
    assert {(r.source_id, r.text) for r in rows} == {("a.MD", "# A\nx"), ("b.txt", "plaintext")}


LISTS = st.dictionaries(st.integers(0, 30), st.floats(0, 100), max_size=15)


@given(LISTS, LISTS)
@settings(max_examples=8, deadline=None)
def test_fusion_invariants(spark, a, b):
    frame = lambda x: spark.createDataFrame([(0, k, v) for k, v in x.items()], "query_id bigint, id bigint, score double")
    for fused in (fusion.rrf([frame(a), frame(b)]), fusion.linear(frame(a), frame(b))):
        got = {r.id: r.score for r in fused.collect()}
        assert set(got) == set(a) | set(b)
        assert all(0 <= s <= 1.0000001 for s in got.values())


def test_dbsf_constants(spark):
    rows = lambda xs: spark.createDataFrame([(0, k, v) for k, v in xs], "query_id bigint, id bigint, score double")
    got = fusion.dbsf(rows([(1, 0.95), (2, 0.85), (3, 0.75)]), rows([(4, 15.2), (5, 12.8), (6, 10.1)])).collect()
    assert len(got) == 6 and sum(r.score for r in got) == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError):
        fusion.rrf([rows([(1, 1.0)])], [1.0, 2.0])


def test_requests():
    assert filters.parse_request({"tenant_id": "x", "lang": ["en", "de"]}).must == (filters.Condition("lang", ("en", "de")),)
    with pytest.raises(ValueError):
        filters.parse_request({"should": []})
    for bad in ({"query": ""}, {"query": "x" * 2001}, {"query": "x", "top_k": 0}, {"query": "x", "min_score": 1.1}):
        with pytest.raises(ValueError):
            filters.Request(**bad)


@pytest.mark.parametrize(("duration", "want"), [(0, []), (15000, [(0, 15000)]), (25000, [(0, 25000)])])
def test_window_bounds(spark, duration, want):
    got = spark.range(1).select(intervals.window_bounds(F.lit(duration).cast("bigint")).alias("w")).first().w
    assert [(x.start_ms, x.end_ms) for x in got] == want


def test_window_overlap(spark):
    got = spark.range(1).select(intervals.window_bounds(F.lit(60000).cast("bigint")).alias("w")).first().w
    assert got[0].end_ms - got[1].start_ms == 2000 and got[-1].end_ms == 60000


def test_text_dedup(spark):
    got = spark.range(1).select(intervals.first_texts(F.array(*map(F.lit, ("abc", "b", " ", "xyz", "abcd")))).alias("t")).first().t
    assert got == ["abc", "xyz"]


def test_masks(spark):
    line = "postgresql://u:pw@h password=abc Bearer aa.bb"
    row = spark.range(1).select(text.without_credentials(text.without_secrets(F.lit(line))).alias("m"), text.redacted(F.lit("mail a@b.co or 123-45-6789")).alias("r")).first()
    assert row.m == "postgresql://u:***@h password=*** Bearer ***"
    assert row.r == "mail [EMAIL_ADDRESS] or [SSN]"


def test_reconcile(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "id bigint") for xs in ((1, 2), (2, 3)))
    assert {tuple(r) for r in tables.reconcile(a, b, "id").collect()} == {(1, "missing"), (3, "orphan")}


def test_complexity_reaches_the_threshold_exactly(spark):
    """Four commas in 150 characters: 0.3 x 0.8 + 0.2 x 0.3 are 0.3, not a bit less."""
    rows = spark.createDataFrame([("a, b, c, d, " + "e" * 138,)], "q string")
    score = text.complexity(F.col("q"))
    assert rows.select(score, text.routing_strategy(F.lit("factual"), score, F.col("q"), 0.3)).first() == (0.3, "complex")


def test_rounding_keeps_the_sign_of_zero(spark):
    """DuckDB's round of a small negative value is -0.0."""
    rows = spark.createDataFrame([(-2e-7,), (2e-7,), (-0.1234567,), (None,), (float("nan"),)], "x double").select(search.rounded(F.col("x")).alias("r")).collect()
    assert [str(r.r) for r in rows] == ["-0.0", "0.0", "-0.123457", "None", "nan"]


def test_postings_are_counted_where_documents_are_read(spark, tmp_path):
    """No shuffle before the index's own order; counts, lengths and statistics as by plain Python, empty and null texts included."""
    texts = {1: "red sea red", 2: None, 3: "", 4: "Sea, sky; SKY sea", 5: "the"}
    docs = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    counted = search.term_counts(docs.select("id", search.tokens(F.coalesce("text", F.lit(""))).alias("w")))
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, counted.collect())) == [(1, 3, "red", 2), (1, 3, "sea", 1), (4, 4, "sea", 2), (4, 4, "sky", 2)]
    search.index_postings(docs, f"{tmp_path}/i")
    assert spark.read.parquet(f"{tmp_path}/i/text/stats").first() == (5, 7 / 5)
    search.index_postings(docs.filter("id < 0"), f"{tmp_path}/none")
    assert spark.read.parquet(f"{tmp_path}/none/text/stats").first() == (0, None)


@pytest.mark.parametrize("how", ["recursive", "semantic", "hierarchical", "qa", "tabular", "mixed"])
def test_chunking_counts_each_character_a_few_times(monkeypatch, how):
    """A chunk's tokens are added up as it grows, not counted again for each sentence."""
    body = "Short one here. " * 4000
    seen, count = [], chunking.count
    monkeypatch.setattr(chunking, "count", lambda t: seen.append(len(t)) or count(t))
    assert len(chunking.STRATEGIES[how](body, chunking.Config())) > 20
    assert sum(seen) < 8 * len(body)


@pytest.mark.parametrize("how", sorted(chunking.STRATEGIES))
def test_texts_without_words_have_no_chunks(how):
    assert chunking.STRATEGIES[how]("", chunking.Config()) == chunking.STRATEGIES[how](" \n", chunking.Config()) == []
