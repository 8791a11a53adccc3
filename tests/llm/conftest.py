from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with clashing extra columns."""

    def make(rows, extra=True):
        full = [(*r, *("en", "s")[len(r) - 2 :]) if len(r) < 4 else r for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
        if extra:
            df = df.selectExpr(
                "*", "cast(length(text) as long) n_chars", "'x' component_id", "'y' words", "'z' head",
                "'q' shard", "'k' key", "'l' label", "1 n", "'b' block", "'w' copies", "'t' sig",
            )
        return df

    return make
