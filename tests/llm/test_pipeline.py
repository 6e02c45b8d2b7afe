"""The corpus pipeline stage by stage."""

from __future__ import annotations

import corpus_pipeline
from runledger.llm.storage import stored
from tests.conftest import SMALL
from tests.llm import plain
from tests.llm.conftest import texts


def test_stages(spark, documents, benchmark):
    frames = [documents]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], SMALL)))
    assert all(f.columns == documents.columns for f in frames[:-1])
    known, one, clean, redacted = (texts(f) for f in frames[1:5])
    assert len(known) >= 0.98 * documents.count()
    assert set(one) == {c for _, c in plain.components(known, 5, 4, 5).values()}
    leaks = plain.contamination(one, [(r.item_id, r.text) for r in benchmark.collect()])
    assert set(clean) == {i for i, x in leaks.items() if not x[4]}
    assert set(redacted) == set(clean)
    assert not any(plain.private_spans(t) for t in redacted.values())
    assert {r.doc_id for r in frames[5].collect()} == set(redacted)
    run = corpus_pipeline.run(spark, SMALL)
    assert run.columns == frames[5].columns
    assert run.count() == frames[5].count()


def test_no_stage_needs_rows_or_known_columns(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SMALL))
        assert docs.count() >= 0
