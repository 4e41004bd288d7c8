"""The corpus pipeline: stages against their operators, and brute force for the whole."""

import pytest
from llm_helpers import SF, awkward_docs, needs_data
from test_ngram_join import brute
from test_quality_rules import brute_kept

import corpus_pipeline as pipeline


@needs_data
def test_run(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    stages = dict(pipeline.STAGES)
    first = stages["language ID"](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    known = {r.doc_id for r in first.collect()}
    # Whatever has letters is recognised here; the rest follows by brute force.
    assert known >= {r.doc_id for r in docs if r.text and any(c.isalpha() for c in r.text) and len(r.text) > 100}
    kept = [(r.doc_id, r.text) for r in docs if r.doc_id in known and brute_kept(r.text)[-1]]
    left = {key for key, group, _ in brute(kept) if key == group}
    rows = pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == left
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "quality rules", "n-gram Jaccard join", "best-fit packing"]


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES[:-1]])
def test_stages_keep_columns_and_awkward_rows(spark, stage):
    docs = awkward_docs(spark).selectExpr("*", "1 as score", "2 as kept", "3 as class_id", "'l' as lang_pred")
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and out.schema == docs.schema
    ids = [r.doc_id for r in out.collect()]
    assert set(ids) <= {r.doc_id for r in docs.collect()} and 6 in ids
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_packing_stage_and_awkward_rows(spark):
    """Every row is there once, whatever its columns are called; rows without a text have the end id only."""
    docs = awkward_docs(spark).selectExpr("*", "1 as piece", "2 as length", "3 as sequence_id", "'x' as ids")
    stage = dict(pipeline.STAGES)["best-fit packing"]
    rows = stage(spark, docs, SF).collect()
    firsts = sorted((str(r.doc_id) for r in rows if r.start == 0))
    assert firsts == sorted(str(r.doc_id) for r in docs.collect())
    assert [r.length for r in rows if r.doc_id in (3, 4)] == [1, 1]
    assert all(r.start == r.piece * 2048 for r in rows)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert stage(spark, docs.limit(0), SF).count() == 0
