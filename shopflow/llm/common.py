"""Helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

ARROW = {
    "int": pa.int32(),
    "long": pa.int64(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()),
}

#: What a mapping makes of a batch: which of its rows (None: each once), and the new columns.
Made = tuple[Sequence[int] | None, Sequence[Sequence[Any]]]


def map_batches(
    rows: DataFrame,
    keep: Sequence[str],
    added: dict[str, str],
    start: Callable[[], Callable[[pa.RecordBatch], Made]],
    at_once: int = 1000,
) -> DataFrame:
    """Columns ``keep`` of ``rows`` as they are, and new columns from batches of rows.

    ``start`` is called once in each task; what it returns gets up to ``at_once`` rows. Kept columns never become Python objects, so large
    integers beside nulls stay exact.
    """
    fields = [rows.schema[k] for k in keep]
    fields += [StructField(k, _parse_datatype_string(v)) for k, v in added.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in (b.slice(k, at_once) for b in batches for k in range(0, len(b), at_once)):
            index, columns = make(batch)
            kept = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            if index is not None:
                chosen = pa.array(np.asarray(index, np.int64))
                kept = [c.take(chosen) for c in kept]
            new = [pa.array(c, ARROW[t]) for c, t in zip(columns, added.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, *new], [*keep, *added])

    return rows.mapInArrow(run, StructType(fields))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A column of strings; a null is an empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def transposed(rows: Sequence[Sequence[Any]], width: int) -> list[list[Any]]:
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(width)]


def map_groups(
    rows: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    made: dict[str, str],
    make: Callable[[tuple, list[tuple]], Sequence[tuple]],
) -> DataFrame:
    """Rows made of each group of ``rows`` with equal ``keys``, which the caller keeps small.

    ``make(key, members)`` gets the ``values`` of the group's rows, ordered by these. Groups
    follow one another in sorted partitions, which costs less for each than a call with a frame.
    """
    width = len(keys)
    dealt = rows.select(*keys, *values).repartition(*keys).sortWithinPartitions(*keys, values[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []

        def packed(out: list[tuple]) -> pa.RecordBatch:
            columns = transposed(out, len(made))
            arrays = [pa.array(c, ARROW[t]) for c, t in zip(columns, made.values(), strict=True)]
            return pa.RecordBatch.from_arrays(arrays, list(made))

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:width] != key:
                    if members:
                        out += make(key, members)
                    key, members = row[:width], []
                members.append(row[width:])
            yield packed(out)
        if members:
            yield packed(list(make(key, members)))

    fields = [StructField(k, _parse_datatype_string(v)) for k, v in made.items()]
    return dealt.mapInArrow(run, StructType(fields))
