"""What is left in the shared folder: the tables that results read, and no others."""

import os
import re

import pytest

import corpus_pipeline
from sparkloom.llm import registry, scratch

#: Tables that a result still reads when it is handed out.
LEFT = {
    "op2_url_filter": {"url-pages", "url-decided"},
    "op4_ppm_scoring": {"ppm-asked", "ppm-model"},
    "op5_substring_dedup": {"repeat-spans", "repeat-filter"},
    "op9_ngram_join": {"join-result"},
    "op10_exact_dedup": {"exact-light", "exact-groups"},
    "op11_prefix_trie": {"trie"},
    "op12_language_id": set(),
    "op13_whitening": set(),
}


@pytest.fixture()
def shared(monkeypatch, tmp_path):
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: f"file://{tmp_path}")
    return lambda: {re.sub("-[0-9a-f]{32}$", "", f) for f in os.listdir(tmp_path / "sparkloom")} if (tmp_path / "sparkloom").exists() else set()


@pytest.mark.parametrize("name", sorted(LEFT))
def test_only_what_the_result_reads_is_left(spark, sf_dir, shared, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0
    assert shared() <= LEFT[name]


def test_one_stage_of_the_pipeline_is_left(spark, sf_dir, shared):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert {f for f in shared() if f.startswith("pipeline")} == {f"pipeline-{len(corpus_pipeline.STAGES) - 2}"}
