"""Each document beside its edited text and its successor, with one shuffle of the texts."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.llm.common import map_batches, texts, transposed
from shopflow.llm.sketch import likeness, sketch, to_text


def first_ids(ids: DataFrame, parts: int) -> list[int]:
    """The smallest id of each of at most ``parts`` ranges that hold about as many rows each."""
    ranges = ids.repartitionByRange(parts, "doc_id").groupBy(F.spark_partition_id())
    return sorted(r["first"] for r in ranges.agg(F.min("doc_id").alias("first")).collect())


def range_of(doc_id: Column, firsts: list[int]) -> Column:
    """Index of the last of ``firsts`` that isn't above the id, by bisection; 0 if none is."""
    steps = [1 << k for k in reversed(range(len(firsts).bit_length()))]
    # A fold over powers of two: Spark evaluates it row by row without a join.
    table = F.array(*map(F.lit, firsts))
    found = F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= len(firsts)) & (F.get(table, at + step - 1) <= doc_id), at + step
        ).otherwise(at),
    )
    return F.greatest(found - 1, F.lit(0))


def edited(text: str, following: str) -> str:
    """The last half of ``text``, rounded down, replaced by the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text and of its successor.

    The successor is the row that follows by ascending (doc_id, text), the first row for the
    last. A null text is empty; a null doc_id comes first. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next, a row for each
    row of ``docs``.

    Ranges of ids are dealt to tasks. The first document of each range is also sent to the
    range before, where it ends the last pair.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    firsts = first_ids(rows.where("doc_id is not null").select("doc_id"), parts)
    if not firsts:
        firsts = [0]
    first, count = firsts[0], len(firsts)
    none = rows.where("doc_id is null").limit(1).count() > 0
    part = range_of(F.col("doc_id"), firsts) if count > 1 else F.lit(0)
    ends = F.array(*map(F.lit, firsts[1:])) if count > 1 else F.array().cast("array<bigint>")
    opens = F.coalesce(F.array_contains(ends, F.col("doc_id")), F.lit(False))
    # The very first row follows the last; with null ids these come first.
    turns = F.col("doc_id").isNull() if none else F.coalesce(F.col("doc_id") == first, F.lit(False))
    copies = F.array(
        F.struct(F.coalesce("part", F.lit(0)).alias("part"), F.lit(0).alias("tail")),
        F.when(opens, F.struct((F.col("part") - 1).alias("part"), F.lit(1).alias("tail"))),
        F.when(turns, F.struct(F.lit(count - 1).alias("part"), F.lit(2).alias("tail"))),
    )
    dealt = (
        rows.withColumn("part", part)
        .withColumn("copy", F.explode(F.filter(copies, lambda c: c.isNotNull())))
        .select("doc_id", "text", F.col("copy.part").alias("part"), F.col("copy.tail").alias("tail"))
        .repartitionById(parts, F.col("part").cast("int"))
        .sortWithinPartitions("part", "tail", F.asc_nulls_first("doc_id"), "text")
    )

    def start():
        held = None  # the last row and what is known of it, whose successor comes next

        def pairs(batch):
            nonlocal held
            out = []
            for doc, text, part, tail in zip(
                batch.column(0).to_pylist(), texts(batch), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True
            ):
                own = None
                if held is not None and held[0] == part:
                    own = sketch(text)
                    out.append(finished(held, text, own))
                    held = None
                if tail == 0:
                    held = (part, doc, text, sketch(text) if own is None else own)
            return [], transposed(out, 7)

        return pairs

    def finished(row, following, following_sketch):
        _, doc, text, own = row
        changed = edited(text, following)
        changed_sketch = sketch(changed)
        return (
            doc,
            len(text),
            hashlib.sha256(changed.encode()).hexdigest(),
            to_text(own),
            to_text(changed_sketch),
            likeness(own, changed_sketch),
            likeness(own, following_sketch),
        )

    added = {"doc_id": "long", "n_chars": "long", "edited_sha256": "string", "fingerprint": "string"}
    added |= {"edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
    return map_batches(dealt, [], added, start)
