"""Removal of more rows than one filter holds: the same rows, and kept texts stay in their task."""

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup, ngram_join, removal
from sparkloom.llm.scratch import materialize

ROWS, COPIES, FILES = 3000, 1800, 8


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Rows 0 to 1,799 are copies of 600 texts; ids, texts and extra columns repeat as ``removal`` names its own."""
    path = str(tmp_path_factory.mktemp("removal") / "docs")
    rows = [(i, f"text {i % 600 if i < COPIES else i} " + " ".join(f"w{i % 600 if i < COPIES else i}x{j}" for j in range(8)), i, "g") for i in range(ROWS)]
    rows += [(5, rows[5][1], 5, "g"), (None, None, 0, None), (ROWS, "", 0, None)]
    spark.createDataFrame(rows, "doc_id long, text string, __group long, _metadata string").repartition(FILES).write.parquet(path)
    return spark.read.parquet(path)


def ids(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def files_read(plan):
    """Files that each scan with texts has read."""
    if "FileScan" in plan.nodeName() or plan.nodeName().startswith("Scan parquet"):
        return [plan.metrics().apply("numFiles").value()] if "text" in plan.schema().fieldNames() else []
    nodes = plan.children()
    out = [x for i in range(nodes.size()) for x in files_read(nodes.apply(i))]
    if hasattr(plan, "plan") and plan.nodeName().endswith("QueryStage"):
        out += files_read(plan.plan())
    return out


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_duplicates, ngram_join.drop_near_duplicates])
def test_same_rows_with_many_filters(monkeypatch, files, drop):
    want = ids(drop(files))
    assert len(want) == ROWS - COPIES + 600 + (1 if drop is exact_dedup.drop_exact_duplicates else 2)
    monkeypatch.setattr(removal, "MOST_BITS", 1 << 12)
    got = drop(files)
    assert got.columns == files.columns
    assert ids(got) == want


def test_few_kept_rows_leave_their_task(monkeypatch, files):
    """All removed rows are alive and few others, each row is there once, and a group's filter reads its own files only."""
    monkeypatch.setattr(removal, "MOST_BITS", 1 << 12)
    key = exact_dedup.row_key("doc_id", "text")
    gone = files.filter("doc_id between 600 and 1799").select(F.col("doc_id").alias("id"), key.alias("key"), F.lit(False).alias("once"))
    tags = []

    def write(df, tag):
        tags.append(tag)
        return materialize(df, tag)

    seen = removal.flagged(files, key, gone, write)
    assert tags == ["removal-filters"]
    rows = seen.collect()
    assert len(rows) == ROWS + 3
    alive = [r.doc_id for r in rows if r["__alive"]]
    assert set(range(600, 1800)) <= set(alive)
    assert len(alive) - 1200 < (ROWS - 1200) / 4
    final = seen._jdf.queryExecution().executedPlan()
    plan = final.toString().split("Initial Plan")[-1]
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert plan.count("BroadcastHashJoin") == 5  # 1,200 keys of 16 bits in filters of 4,096
    assert sum(files_read(final.finalPhysicalPlan())) == len(files.inputFiles())


def test_rows_of_no_files_are_written_first(monkeypatch, spark):
    monkeypatch.setattr(removal, "MOST_BITS", 1 << 12)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 700).cast("string")).alias("text"))
    docs = docs.repartition(3, "doc_id").dropDuplicates(["doc_id"])
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(docs).collect()) == list(range(700))
    assert exact_dedup.drop_exact_duplicates(docs.limit(0)).collect() == []
