"""From documents to packed training sequences, a stage at a time.

Each stage gets what its predecessor kept, written as Parquet and read again, and learns, if it
learns, from those of these documents that have labels.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from shopflow.llm import chosen_path, packing, quality, toxicity  # noqa: E402
from shopflow.llm.queries import QUALITY_FROM, TOXIC_FROM, VOCABULARY, learnable, table  # noqa: E402
from shopflow.sources.scratch import stored  # noqa: E402

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def scored_name(docs: DataFrame) -> str:
    """A name for a helper column that no column of ``docs`` has."""
    name = "score"
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose toxicity is below the limit, with all their columns."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), learnable())
    name = scored_name(docs)
    scores = toxicity.score(docs, model, keep=docs.columns, name=name)
    return scores.where(scores[name] < TOXIC_FROM).select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality reaches the limit, with all their columns."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"), learnable())
    name = scored_name(docs)
    scores = quality.score(docs, model, keep=docs.columns, name=name)
    return scores.where(scores[name] >= QUALITY_FROM).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies, with all its columns."""
    return chosen_path.without_near_copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left into sequences; a row for each piece."""
    return packing.pack(docs, VOCABULARY)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("packing", pack_sequences),
]

#: SQL expresses neither the fitted models nor the tokens; tests compare with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each result stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
