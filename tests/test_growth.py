"""What the findings of round 3 said may grow too fast: indexes for one request, Python workers' memory, bytes read, calls to state."""

import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import search
from sparkloom.plans import retrieval
from sparkloom.plans.catalog import QUERIES, SQL
from sparkloom.sources import parsers, shared
from sparkloom.streaming import stateful


@pytest.fixture
def nothing_kept(monkeypatch):
    monkeypatch.setattr(shared, "_KEPT", {})


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["b04_min_max_normalise", "r08_dbsf_fusion", "j01_full_outer_lists", "r13_r14_hybrid_search"])
def test_keyword_leg_builds_no_index(spark, sf_dir, nothing_kept, monkeypatch, name):
    """Its requests' words are read in one pass without a shuffle; what is kept of a text is these words alone."""
    monkeypatch.setattr(search, "index_postings", lambda *a, **k: pytest.fail("an index was built"))
    QUERIES[name](spark, sf_dir)
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("doc_id", "id").select("id", "text")
    assert "Exchange" not in plan(search.found_words(texts, retrieval.KEYWORDS))
    words = retrieval.request_words(spark, sf_dir)
    assert words.count() == texts.count()
    assert {r.x for r in words.select(F.explode("w").alias("x")).distinct().collect()} <= {t for _, t in search.query_terms(retrieval.KEYWORDS)}


@pytest.mark.parametrize("queries", [retrieval.KEYWORDS, {}])
def test_all_words_of_a_text_are_never_a_row(spark, sf_dir, queries):
    """They are split once; below the projection of what is found, no row holds a list of words."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("doc_id", "id").select("id", "text")
    found = search.found_words(texts, queries)
    assert plan(found).count("split(") == 1
    node = found._jdf.queryExecution().sparkPlan()
    while node.children().size():
        node = node.children().apply(0)
        kinds = [node.output().apply(i).dataType().simpleString() for i in range(node.output().size())]
        assert "array<string>" not in kinds
    terms = {t for _, t in search.query_terms(queries)}
    words = {r.id: r.w for r in texts.select("id", search.tokens(F.coalesce("text", F.lit(""))).alias("w")).collect()}
    assert {r.id: (r.dl, r.w) for r in found.collect()} == {i: (len(w), [x for x in w if x in terms]) for i, w in words.items()}


def test_overlap_rerank_leaves_texts_where_they_are_read(spark, sf_dir):
    """The hits go to the texts, whatever Spark knows of sizes; only the hits' texts are taken apart."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, "-1")
    try:
        found = plan(QUERIES["r21_overlap_rerank"](spark, sf_dir))
    finally:
        spark.conf.unset(name)
    assert "SortMergeJoin" not in found and found.index("split(") < found.index("BroadcastHashJoin")


def test_vectors_are_scored_in_tiles(monkeypatch):
    """A product's memory is that of a tile and a chunk; of many equal scores no more than ``k`` hits stay, those of the smallest ids."""
    rng = np.random.default_rng(1)
    ids, vectors, asked = rng.permutation(search.CHUNK_ROWS), rng.standard_normal((search.CHUNK_ROWS, 64)), rng.standard_normal((search.TILE, 64))
    vectors[1000:] = 1.0
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.full(len(asked), -np.inf))
    tracemalloc.start()
    best = search._scored(ids[:3000], vectors[:3000], asked, 10, none)
    best = search._scored(ids[3000:], vectors[3000:], asked, 10, best)
    size = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size < 150e6 and len(best[0]) == 10 * len(asked)
    for j, row in enumerate(asked @ vectors.T):
        want = sorted(zip(-np.round(row, 9), ids, strict=True))[:10]
        assert [(-s, i) for s, i, at in zip(best[2], best[1], best[0], strict=True) if at == j] == want


def test_vector_search_over_many_tiles_and_chunks(spark, monkeypatch):
    """As the plain order of all scores, in which NaN is the highest, with tiles, chunks and held hits of a few rows."""
    for name, value in (("QUERY_BLOCK", 4), ("CHUNK_ROWS", 7), ("TILE", 3), ("HELD_HITS", 20)):
        monkeypatch.setattr(search, name, value)
    vectors = {i: [float(i % 5), float(i % 3)] for i in range(60)} | {70: [float("nan"), 1.0], 71: [float("inf"), 1.0]}
    asked = {q: [1.0, float(q)] for q in range(9)}
    rows, queries = (spark.createDataFrame(list(x.items()), f"{n} bigint, embedding array<double>") for x, n in ((vectors, "id"), (asked, "query_id")))
    for k in (4, 100):
        got = search.vector_search(rows, queries, k).collect()
        for q, a in asked.items():
            scores = {i: round(a[0] * v[0] + a[1] * v[1], 9) for i, v in vectors.items()}
            want = sorted(scores, key=lambda i: (scores[i] == scores[i], -scores[i] if scores[i] == scores[i] else 0, i))[:k]
            assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_only_wanted_files_are_opened(spark, tmp_path):
    """Names that paths encode, too; a file that nobody wants may be longer than Spark reads."""
    for name, size in (("a b.txt", 5), ("c%20d.txt", 6), ("é.txt", 7), ("long.txt", 500)):
        (tmp_path / name).write_bytes(b"x" * size)
    files = parsers.list_files(spark, str(tmp_path))
    ids = {r.name: r.source_id for r in files.select("name", "source_id").collect()}
    wanted = spark.createDataFrame([(i,) for n, i in ids.items() if n != "long.txt"] + [(ids["a b.txt"] + "x",)], "source_id string")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")
    try:
        got = {(r.source_id.split("/")[-1], r.found, r.content and len(r.content)) for r in parsers.fetch_many(files, wanted).collect()}
        assert got == {("a b.txt", True, 5), ("c%20d.txt", True, 6), ("é.txt", True, 7), ("a b.txtx", False, None)}
        assert [len(r.content) for r in parsers.fetch(files, ids["c%20d.txt"]).collect()] == [6]
        assert parsers.fetch_many(files, wanted.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_a_worker_parses_a_bounded_number_of_bytes(spark, monkeypatch):
    monkeypatch.setattr(parsers, "PARSE_BYTES", 100)
    sizes = [60, 40, 1, 0, 500, 99, None, 1, 1]
    batch = pa.RecordBatch.from_pydict({"id": list(range(9)), "content": pa.array([s if s is None else b"x" * s for s in sizes], pa.binary())})
    assert [x.column(0).to_pylist() for x in parsers._slices(batch)] == [[0, 1], [2, 3], [4], [5, 6, 7], [8]]
    assert not list(parsers._slices(batch.slice(0, 0)))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.createDataFrame([(i, None if s is None else "x" * s) for i, s in enumerate(sizes)], "id bigint, text string")
    got = parsers.parse(rows, F.col("id"), F.col("text"), F.lit("txt"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4_000_000
    assert sorted((r.source_id, len(r.text)) for r in got.collect()) == [(i, s or 0) for i, s in enumerate(sizes)]


class Calls:
    """State of one key and its timers; counts the calls, each of which is a round trip to the JVM."""

    def __init__(self):
        self.value, self.timers, self.n = {}, set(), 0

    def var(self, name):
        calls = self

        class Var:
            def __getattr__(_, what):
                def call(*x):
                    calls.n += 1
                    if what in ("put", "update"):
                        calls.value[name] = x[0]
                    if what == "clear":
                        calls.value.pop(name, None)
                    return name in calls.value if what == "exists" else calls.value.get(name)

                return call

        return Var()

    def getMapState(self, name, *_):
        return self.var(name)

    getListState = getValueState = getMapState

    def listTimers(self):
        self.n += 1
        return list(self.timers)

    def registerTimer(self, ms):
        self.n += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.n += 1
        self.timers.discard(ms)

    def getCurrentWatermarkInMs(self):
        return 0


def fed(buffer, calls, *events):
    frame = pd.DataFrame({"us": [u for u, _ in events], "event_id": [i for _, i in events], "good": [True] * len(events)})
    return [x for out in buffer.handleInputRows((7,), iter([frame]), calls) for x in out.event_ids]


def expired(buffer, calls, ms):
    calls.timers.discard(ms)
    info = type("Info", (), {"getExpiryTimeInMs": lambda _: ms})()
    return [x for out in buffer.handleExpiredTimer((7,), calls, info) for x in out.event_ids]


def test_a_key_calls_its_state_a_few_times():
    """A key that is new, filled and left again: four calls, then four; a key without state has no timer that could end its next wait early."""
    calls, buffer = Calls(), stateful.TokenBuffer(3, 10)
    buffer.init(calls)
    assert fed(buffer, calls, (2000, 2), (1000, 1)) == [] and calls.n <= 4 and calls.timers == {11}
    calls.n = 0
    assert expired(buffer, calls, 11) == [[1, 2]] and calls.n <= 4 and not calls.value
    assert fed(buffer, calls, (20000, 3)) == [] and calls.timers == {30}
    assert fed(buffer, calls, (21000, 4), (22000, 5)) == [[3, 4, 5]] and not calls.timers and not calls.value
    calls.timers.add(30)  # of an older checkpoint
    assert fed(buffer, calls, (25000, 6)) == [] and expired(buffer, calls, 30) == [] and expired(buffer, calls, 35) == [[6]]


def shuffled(spark, run):
    """Bytes that all stages of ``run()`` write to shuffles."""
    java = spark.sparkContext._jvm

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        quantiles = spark.sparkContext._gateway.new_array(java.double, 0)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, quantiles, java.java.util.ArrayList())
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = total()
    run()
    return sum(n for key, n in total().items() if key not in before)


@pytest.mark.parametrize("name", ["r06_linear_fusion", "j01_full_outer_lists"])
def test_fusion_shuffles_hits_and_no_texts(spark, nothing_kept, tmp_path, name):
    """Texts of ten times the words, all different, move no more bytes; rows are the SQL's at both lengths."""
    asked = [w for text in retrieval.KEYWORDS.values() for w in text.split()]
    moved = []
    for length in (30, 300):
        path = tmp_path / str(length)
        texts = [(i, None if i == 7 else " ".join([asked[i % len(asked)], asked[i // 3 % len(asked)], *(f"w{i}x{j}" for j in range(length))])) for i in range(400)]
        vectors = [(i, [float(i % 7), float(i % 11), 1.0]) for i in range(0, 700, 2)]
        spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(2).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").coalesce(2).write.parquet(f"{path}/embeddings.parquet")
        rows = []
        moved.append(shuffled(spark, lambda at=str(path), rows=rows: rows.extend(QUERIES[name](spark, at).collect())))
        con = duckdb.connect()
        for table in ("documents", "embeddings"):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
        want = con.sql(SQL[name])
        assert sorted(tuple(r[c] for c in want.columns) for r in rows) == sorted(want.fetchall())
    assert 0 < moved[1] <= 1.1 * moved[0]
