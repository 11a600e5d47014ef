"""Packing token sequences into windows by non-negative least squares.

A document of n tokens gives whole windows and one rest shorter than a window. How many rests
there are of each length is a histogram of fixed size. Combinations of two or three lengths
that fill a window exactly are its building blocks; non-negative least squares finds how often
to use each so that the sums come closest to the histogram. Rounded to the nearest whole number, and
cut to what is there, these counts pack most rests uncut. What remains is packed greedily, longest first, and cut at the
window's end, so that only the last window of all is padded.

Ranks of the rests of one length are spread over all tasks (a count per task and length, and the
place within the task), so that one length may hold any share of the rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopflow.llm.codec import codec
from shopflow.llm.common import map_batches, texts, transposed
from shopflow.sources.scratch import stored

END = 0  # the id after each document

PIECES = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def combinations(window: int, lengths: np.ndarray) -> np.ndarray:
    """Rows of up to three of ``lengths`` (ascending, 0 for none) whose sum is ``window``."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    there[0] = False
    a, b = np.meshgrid(np.flatnonzero(there), np.flatnonzero(there), indexing="ij")
    c = window - a - b
    fits = (a <= b) & (((c >= b) & there[np.clip(c, 0, window)]) | (c == 0))
    return np.stack([a[fits], b[fits], c[fits]], axis=1)


def least_squares(blocks: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths used by ``blocks`` closest to ``histogram``.

    Accelerated projected gradient; the step is one over a bound of the largest eigenvalue.
    """
    size = len(histogram)
    flat = blocks.ravel()
    weight = (flat > 0).astype(float)

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, 3) * weight, size)

    rows = np.bincount(flat, weight, size)
    bound = 3.0 * max(1.0, rows.max())
    x = z = np.zeros(len(blocks))
    t = 1.0
    for _ in range(steps):
        gap = used(z) - histogram
        gradient = (gap[blocks] * (blocks > 0)).sum(axis=1)
        new = np.maximum(0.0, z - gradient / bound)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


@dataclass
class Plan:
    """Where the rest with a given length and rank goes.

    ``slots`` (sorted by length, then ``rank``): from ``rank`` on, ``count`` rests of ``length``
    lie at ``offset`` in the sequences from ``sequence`` on, one in each. The rests of a length
    from rank ``whole[length]`` on are laid end to end from place ``base[length]`` of a stream
    cut into windows, which are the sequences from ``stream`` on.
    """

    window: int
    slots: np.ndarray
    first_slot: np.ndarray
    whole: np.ndarray
    base: np.ndarray
    stream: int


def make_plan(histogram: np.ndarray, window: int) -> Plan:
    """``histogram[n]``: number of rests with n tokens, n < window."""
    left = np.zeros(window + 1, np.int64)
    left[: len(histogram)] = histogram
    left[0] = 0
    blocks = combinations(window, np.flatnonzero(left))
    slots, sequence = [], 0
    taken = np.zeros(window + 1, np.int64)
    if len(blocks):
        x = least_squares(blocks, left.astype(float))
        for k in np.argsort(-x, kind="stable"):
            count = int(round(x[k]))
            if count == 0:
                break
            lengths, times = np.unique(blocks[k][blocks[k] > 0], return_counts=True)
            count = min(count, int((left[lengths] // times).min()))
            if count == 0:
                continue
            offset = 0
            for n in blocks[k][blocks[k] > 0].tolist():
                slots.append((n, int(taken[n]), count, sequence, offset))
                taken[n] += count
                left[n] -= count
                offset += n
            sequence += count
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 5)
    base = np.zeros(window + 1, np.int64)
    place = 0
    for n in range(window, 0, -1):
        base[n] = place
        place += n * int(left[n])
    first = np.searchsorted(table[:, 0], np.arange(window + 2))
    return Plan(window, table, first, taken, base, sequence)


def place(plan: Plan, length: int, rank: int) -> list[tuple[int, int, int, int]]:
    """(start in the rest, length, sequence, offset) of each piece of a rest."""
    if rank < plan.whole[length]:
        lo, hi = plan.first_slot[length], plan.first_slot[length + 1]
        slot = plan.slots[lo + np.searchsorted(plan.slots[lo:hi, 1], rank, side="right") - 1]
        return [(0, length, int(slot[3] + rank - slot[1]), int(slot[4]))]
    at = int(plan.base[length]) + (rank - int(plan.whole[length])) * length
    out, start = [], 0
    while start < length:
        sequence, offset = divmod(at + start, plan.window)
        take = min(length - start, plan.window - offset)
        out.append((start, take, plan.stream + sequence, offset))
        start += take
    return out


def tokenized(docs: DataFrame, vocabulary: str, window: int) -> DataFrame:
    """Each document's whole windows and rest.

    part, row: the task and the place in it; n_tokens with the end id; crcs: of the whole
    windows; first: how many whole windows the task had before; rest: ids of the rest, little
    endian; rank: how many rests of that length the task had before.
    """

    def start():
        bpe, part = codec(vocabulary), TaskContext.get().partitionId()
        ranks = [0] * window
        wholes, step = 0, 4 * window
        end = np.array([END], "<u4").tobytes()

        def encode(batch):
            nonlocal wholes
            out = []
            for text in texts(batch):
                data = bpe.encode(text).astype("<u4", copy=False).tobytes() + end
                n = len(data) // 4
                whole = n // window
                crcs = [zlib.crc32(data[k * step : (k + 1) * step]) for k in range(whole)]
                rest = n - whole * window
                out.append((part, n, wholes, crcs, rest, ranks[rest], data[whole * step :]))
                wholes += whole
                ranks[rest] += 1
            return None, transposed(out, 7)

        return encode

    added = {"part": "int", "doc_tokens": "long", "first": "long", "crcs": "array<long>"}
    added |= {"length": "int", "rank": "long", "rest": "binary"}
    return map_batches(docs.select("doc_id", "text"), ["doc_id"], added, start)


def pack(docs: DataFrame, vocabulary: str, window: int = 1024) -> DataFrame:
    """Pack the ids of each text, and an end id after it, into sequences of ``window`` ids.

    Returns a row for each piece: doc_id, start (ids of its document before it), length,
    ids_crc32 (of its ids as unsigned little-endian 32-bit numbers), doc_tokens (ids of its
    document with the end id), sequence_id and offset (its place there, gapless from 0). Each
    id lies in one piece, sequences are never longer than ``window``, and all but one are full.
    A null or empty text is packed as its end id alone. Repeated rows are packed each. Ids of
    sequences are unique but not gapless.

    The ids are computed once: checksums of whole windows and the ids of the rest are stored.
    """
    rows = stored(tokenized(docs, vocabulary, window), "tokenized")
    counts = stored(rows.where("length > 0").groupBy("part", "length").count(), "rest_counts")
    histogram = np.zeros(window, np.int64)
    for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # under a window
        histogram[r["length"]] = r["n"]
    plan = make_plan(histogram, window)

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")
    )
    ranked = rows.join(offsets, ["part", "length"], "left").withColumn(
        "rank", F.col("rank") + F.coalesce("before", F.lit(0))
    )

    names = ["part", "doc_tokens", "first", "crcs", "length", "rank", "rest"]

    def start():
        def pieces(batch):
            at, out = [], []
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)
            for i, (part, n, first, crcs, length, rank, rest) in enumerate(zip(*columns, strict=True)):
                # Whole windows are sequences of their own, numbered apart from the planned ones.
                own = ((part + 1) << 40) + first
                for k, crc in enumerate(crcs):
                    at.append(i)
                    out.append((k * window, window, crc, n, own + k, 0))
                base = len(crcs) * window
                for begin, take, sequence, offset in place(plan, length, rank) if length else ():
                    crc = zlib.crc32(rest[begin * 4 : (begin + take) * 4])
                    at.append(i)
                    out.append((base + begin, take, crc, n, sequence, offset))
            return at, transposed(out, 6)

        return pieces

    return map_batches(ranked.select("doc_id", *names), ["doc_id"], dict.fromkeys(PIECES, "long"), start)
