"""The near-duplicate stage takes out copies from 80 % on."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string"


def test_near_copies_from_80_percent_on_leave_the_corpus(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = []
    for k in range(40):
        words = [f"d{k}w{x}" for x in range(100)]
        near, far = list(words), list(words)
        near[30] = near[70] = "edited"  # 86 of 106 shingles: 0.811
        far[20] = far[50] = far[80] = "edited"  # 81 of 111: 0.730
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(far))]
    left = {r.doc_id for r in pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert left == {i for i in range(120) if i % 3 != 1}
