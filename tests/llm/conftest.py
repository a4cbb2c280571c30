from __future__ import annotations

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents from texts; ids count from 0."""

    def make(texts, langs=None):
        rows = [(i, t, (langs or {}).get(i, "en"), "s", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Null, empty, blank, repeated and very long texts, a repeated row, and columns with the names that operators add."""
    rows = docs([None, "", "   \n\n \n", "one", "one", "a b c d e\nf\ng\nh", "Wörter über Straßen " * 4000, "x" * 100_000, "l1\nl2\nl3\nl1\nl2\nl3\nend", "<|endoftext|> 漢字 é\U0001f600 it's"])
    rows = rows.unionByName(rows.where("doc_id = 5"))
    clash = ["token_ids", "decoded", "lang_pred", "n_lines", "shard_id", "depth", "gif_error", "media", "_spans", "words", "label", "h", "n", "bucket", "_key", "P"]
    return rows.withColumns({c: F.lit(1) for c in clash})


@pytest.fixture(scope="session")
def empty(docs, spark):
    return spark.createDataFrame([], DOCS)
