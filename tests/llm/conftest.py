from __future__ import annotations

import pytest


@pytest.fixture
def frame(spark):
    """Documents with clashing extra columns, dealt over three partitions."""

    def make(texts, ids=None, kind="long"):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "x", 1.5, "y", 7) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, f"doc_id {kind}, text string, source string, score double, fingerprint string, part int").repartition(3)

    return make
