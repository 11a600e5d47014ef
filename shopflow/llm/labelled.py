"""Labelled documents to learn from, a bounded number of each class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.sources.scratch import stored


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int) -> DataFrame:
    """Texts with label 0 or 1 (columns text, label), at most ``rows`` of each.

    ``usable`` says which rows of ``labels`` may be learnt from. Where there are more, the hash
    of the id decides, so the choice doesn't depend on how the table is stored. A class that
    has few labels gives what it has. Labels that are null or other than 0 and 1, null ids and
    ids without a document give nothing; an id with several labels counts with each. Of an id
    that several documents bear, the smallest text counts; a null text is empty.
    """
    known = labels.where(usable & F.col("doc_id").isNotNull())
    known = known.select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    by_hash = F.xxhash64("doc_id"), F.col("doc_id")
    zero, one = (known.where(F.col("label") == k).orderBy(*by_hash).limit(rows) for k in (0, 1))
    chosen = stored(zero.unionByName(one), "chosen")  # at most 2 * rows ids
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # However often an id is repeated, each task sends one text of it.
    return stored(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label"), "sample")
