"""Token counts that follow edits.

A document is a row of segments (``codec.SEGMENT``) under a binary tree of sums. An edit
re-encodes the segments it touches, and up to one on either side as context, and updates the
sums on the way to the root.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.llm.codec import SEGMENT, Codec, codec
from shopflow.llm.common import map_batches, texts, transposed

EDITS = "array<struct<start:int,stop:int,new:string>>"


class Counts(dict):
    """Tokens of segments met before; emptied when ``limit`` of them are held."""

    def __init__(self, bpe: Codec, limit: int = 400_000) -> None:
        self.bpe, self.limit = bpe, limit

    def __missing__(self, segment: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        n = self.bpe.count(segment)
        if len(segment) <= 256:
            self[segment] = n
        return n


class TokenTree:
    """Token counts of one text under edits.

    Each leaf starts where a fixed boundary was when the tree was built. An edit takes the leaf
    that holds the character before it to the leaf that holds the one after it, so the
    characters on both sides of the outer boundaries stay, and so do the boundaries. The first
    of these leaves takes the new text, the others become empty.
    """

    def __init__(self, text: str, counts: Counts) -> None:
        self.counts = counts
        self.leaves = SEGMENT.findall(text) or [""]
        size = 1 << (len(self.leaves) - 1).bit_length()
        tokens = [counts[s] if s else 0 for s in self.leaves]
        self.tokens = self._sums(tokens, size)
        self.chars = self._sums(list(map(len, self.leaves)), size)
        self.reencoded = 0

    @staticmethod
    def _sums(leaves: list[int], size: int) -> list[np.ndarray]:
        """Levels of sums, the root first."""
        level = np.zeros(size, np.int64)
        level[: len(leaves)] = leaves
        levels = [level]
        while len(level) > 1:
            level = level[0::2] + level[1::2]
            levels.append(level)
        return levels[::-1]

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[0][0])

    @property
    def n_chars(self) -> int:
        return int(self.chars[0][0])

    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place``, and where that leaf starts."""
        node, start = 0, 0
        for level in self.chars[1:]:
            node *= 2
            if place - start >= level[node]:
                start += int(level[node])
                node += 1
        return node, start

    def _set(self, leaf: int, text: str) -> None:
        self.leaves[leaf] = text
        tokens = self.counts.bpe.count(text) if text else 0
        for levels, value in ((self.tokens, tokens), (self.chars, len(text))):
            change = value - int(levels[-1][leaf])
            for depth, level in enumerate(reversed(levels)):
                level[leaf >> depth] += change

    def replace(self, start: int, stop: int, new: str) -> None:
        """Put ``new`` in place of characters ``start`` to ``stop``; both are clipped."""
        n = self.n_chars
        start = min(max(start, 0), n)
        stop = min(max(stop, start), n)
        first, begins = self._leaf(max(start - 1, 0)) if n else (0, 0)
        last, _ = self._leaf(min(stop, n - 1)) if n else (0, 0)
        old = "".join(self.leaves[first : last + 1])
        self.reencoded += sum(1 for s in self.leaves[first : last + 1] if s)
        self._set(first, old[: start - begins] + new + old[stop - begins :])
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self._set(leaf, "")


def sample_edits(text: Column) -> Column:
    """Three edits a document: a deletion, a replacement and an insertion, in this order."""
    n = F.length(text)

    def edit(start: Column, stop: Column, new: str) -> Column:
        return F.struct(
            start.cast("int").alias("start"), stop.cast("int").alias("stop"), F.lit(new).alias("new")
        )

    third, half, late = F.floor(n / 3), F.floor(n / 2), F.floor(2 * n / 3)
    return F.array(
        edit(third, third + 5, ""), edit(half, half + 10, "edited's 42 words"), edit(late, late, " new")
    )


def edited_token_counts(docs: DataFrame, vocabulary: str, edits: Column) -> DataFrame:
    """Tokens of each text before and after its edits.

    ``edits`` gives ``EDITS``; each edit's places refer to the text that the edits before it
    left. Returns doc_id, n_tokens, edited_tokens, n_segments and reencoded_segments (longs),
    a row for each row of ``docs``. A null text is empty; a null edit, or one with a null
    place, changes nothing; null edits are none; a null ``new`` is empty. Places outside the
    text are clipped.
    """

    def start():
        counts = Counts(codec(vocabulary))

        def count(batch):
            changes = batch.column(batch.schema.get_field_index("edits")).to_pylist()
            out = []
            for text, edits_of_text in zip(texts(batch), changes, strict=True):
                tree = TokenTree(text, counts)
                before, segments = tree.n_tokens, len(tree.leaves) if text else 0
                for e in edits_of_text or ():
                    if e and e["start"] is not None and e["stop"] is not None:
                        tree.replace(e["start"], e["stop"], e["new"] or "")
                out.append((before, tree.n_tokens, segments, tree.reencoded))
            return None, transposed(out, 4)

        return count

    names = ("n_tokens", "edited_tokens", "n_segments", "reencoded_segments")
    rows = docs.select("doc_id", "text", edits.cast(EDITS).alias("edits"))
    return map_batches(rows, ["doc_id"], dict.fromkeys(names, "long"), start)
