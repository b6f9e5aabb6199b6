"""Every registered query of the reference's operators against its DuckDB form, at the smallest scale."""

import math
import os

import duckdb
import pytest

from sparkloom.plans import analytics, extras, pipelines, retrieval, sources, textual  # noqa: F401
from sparkloom.plans.catalog import QUERIES, SQL


#: At this scale every document has an embedding.
EMPTY_HERE = {"f21_without_embeddings"}


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted("|".join(norm(r[c]) for c in cols) for r in df.collect())
    assert got == sorted("|".join(norm(r[i]) for i in at) for r in want.fetchall())
    assert got or name in EMPTY_HERE, "a query without rows shows nothing"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, sf_dir, name):
    """Queries without SQL have rows, and no column but a chunk's section or kind is null in all of them; chunks are of all documents and their words."""
    found = QUERIES[name](spark, sf_dir)
    rows = found.collect()
    assert rows
    assert {c for c in found.columns if all(r[c] is None for r in rows)} <= ({"section", "kind"} if "chunks" in name else set())
    if "chunks" in name:
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
        assert {r.doc_id for r in rows} == {i for i, t in texts.items() if t and t.strip()}
        assert all("".join(r.content.split()) in "".join(texts[r.doc_id].split()) for r in rows if name == "c01_c02_recursive_chunks")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
