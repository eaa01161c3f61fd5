from __future__ import annotations

import pytest


@pytest.fixture
def documents(spark):
    """Builds documents from (doc_id, text, source) rows, with extra columns of clashing names."""

    def build(rows):
        table = [(i, s, "en", t, len(t or ""), "x", 1, "y", 2.0, "z") for i, t, s in rows]
        return spark.createDataFrame(
            table,
            "doc_id long, source string, lang string, text string, n_chars long, "
            "copy string, size int, bucket string, score double, place string",
        )

    return build
