"""Rank fusion to the last bit: sums of equal value tie, or part, as in the SQL."""

from fractions import Fraction
from itertools import combinations, product

import duckdb
import numpy as np

from sparkloom.operators import fusion, search
from sparkloom.plans import retrieval
from sparkloom.plans.catalog import QUERIES, SQL

#: Ranks of a document in the two lists of 50; none: it is not in the list.
RANKS = [p for p in product([None, *range(1, 51)], repeat=2) if any(p)]


def tied():
    """Pairs of ranks whose sums are equal by value."""
    by_value = {}
    for x, y in RANKS:
        by_value.setdefault((Fraction(7, 59 + x) if x else 0) + (Fraction(3, 59 + y) if y else 0), []).append((x, y))
    return [pair for same in by_value.values() for pair in combinations(same, 2)]


def database(path, *tables):
    con = duckdb.connect()
    for table in tables:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    return con


def test_equal_sums_are_ordered_as_in_the_sql(spark, tmp_path):
    """A request for each such pair and order of ids, and others that bring documents of all ranks."""
    lists = {"sem": [], "kr": []}
    asked = [(pair, ids) for pair in tied() for ids in ((1, 2), (2, 1))] + [([ranks], [1]) for ranks in RANKS[::7]]
    for q, (pair, ids) in enumerate(asked):
        for side, name in enumerate(lists):
            held = {ranks[side]: i for ranks, i in zip(pair, ids, strict=True)}
            lists[name] += [(q, held.get(r, 100 * (side + 1) + r), 1.0 - r / 100, r) for r in range(1, 51)]
    frames = {}
    for name, rows in lists.items():
        spark.createDataFrame(rows, "query_id bigint, id bigint, score double, rank bigint").coalesce(2).write.parquet(f"{tmp_path}/{name}.parquet")
        frames[name] = spark.read.parquet(f"{tmp_path}/{name}.parquet").drop("rank")
    got = search.top_k(fusion.rrf(list(frames.values()), [0.7, 0.3]), 100).collect()
    want = database(tmp_path, "sem", "kr").sql(f"WITH {retrieval._RRF} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM rrf").fetchall()
    assert len(asked) > 400 and sorted((r.query_id, r.id, r.score, r["rank"]) for r in got) == sorted(want)


def test_hybrid_search_with_equal_sums(spark, tmp_path):
    """As its SQL where documents are in both lists."""
    rng = np.random.default_rng(8)  # a request has such a pair among its best ten
    words = [w for text in retrieval.KEYWORDS.values() for w in text.split()]
    texts = [(i, " ".join(rng.choice(words, rng.integers(1, 6))) + " x" * int(rng.integers(0, 40)), "en", f"src{i % 20}") for i in range(3000)]
    vectors = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(3000)]
    spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").coalesce(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    name = "r13_r14_hybrid_search"
    want = database(tmp_path, "documents", "embeddings").sql(SQL[name])
    got = [tuple(r[c] for c in want.columns) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert len(got) > 400 and sorted(got) == sorted(want.fetchall())
