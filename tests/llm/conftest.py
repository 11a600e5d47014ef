from __future__ import annotations

import public_tokenizers
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def make_docs(spark):
    """A table of documents from texts, or from (id, text) pairs; with odd extra columns."""

    def make(texts):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", "s", len(t or ""), 1, "x") for i, t in pairs]
        extra = ", score int, n_tokens string"
        return spark.createDataFrame(rows, DOCS + extra).repartition(3)

    return make
