"""Blocks of a text are told where it lies."""

import pytest
from lodestrata.operators import semantic
from lodestrata.plans import registry


def test_no_unit_is_shuffled(spark):
    plan = registry.QUERIES["semantic_parents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Join" not in plan and "ArrowEvalPython" in plan


@pytest.mark.parametrize("chars", [40, 250_000])
def test_blocks_do_not_depend_on_runs(spark, monkeypatch, chars):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id % 5 = 0")
    want = sorted(map(tuple, semantic.parents(docs, "doc_id", "text").collect()))
    monkeypatch.setattr(semantic, "RUN_CHARS", chars)
    assert sorted(map(tuple, semantic.parents(docs, "doc_id", "text").collect())) == want and len(want) > 20
