"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut where a rolling hash of the last characters says so: a passage that several
documents share is cut alike in all of them. A chunk met before is not encoded again. Where two
chunks meet, the ids around the join may differ from those of the whole text: the characters
between the last fixed boundary of the one and the first of the other (see ``codec``) are
encoded anew, over as many chunks as it takes until both ends stand on a fixed boundary. Outside
the ids agree with those of the whole text, so the result is exact.

Chunks are counted over the whole table by their digests. Of those that occur more than once the
ones that save most, up to a bounded total, are encoded once, apart from the texts, and sent to
all tasks. Other chunks are shared within a task, in a store of bounded size. Chunks are looked up
by their text, so a shared digest changes nothing.
"""

from __future__ import annotations

import hashlib
from collections import Counter, OrderedDict

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.llm.codec import Codec, codec, first_edge, last_edge
from shopflow.llm.common import map_batches, texts, transposed
from shopflow.sources.scratch import stored

#: First and last fixed boundary of a chunk (-1: none), and the ids between them.
Entry = tuple[int, int, np.ndarray | None]

SHARED = 32_768  # chunks that all tasks get, at most
SHARED_CHARACTERS = 16_000_000  # of these chunks together, at most
WINDOW = 24
LEAST, MEAN, MOST = 128, 512, 8192
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def cuts(text: str, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list[int]:
    """Ends of the chunks of ``text``: content decides, between ``least`` and ``most`` characters."""
    n = len(text)
    if n <= least:
        return [n] if n else []
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points = (points + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    rolled = points.copy()
    span = 1
    while span < WINDOW:  # hashes of 2, 4, 8 characters and so on, then of the whole window
        step = min(span, WINDOW - span)
        with np.errstate(over="ignore"):
            rolled[step:] += rolled[:-step] * _FACTOR ** np.uint64(step)
        span += step
    found = (np.nonzero((rolled >> np.uint64(40)) % np.uint64(mean) == 0)[0] + 1).tolist()
    ends, begin = [], 0
    for end in [*found, n]:
        while end - begin > most:
            begin += most
            ends.append(begin)
        if end - begin >= least or (end == n and end > begin):
            ends.append(end)
            begin = end
    return ends


def digest_of(chunk: str) -> int:
    return xxhash.xxh64_intdigest(chunk.encode("utf-8", "surrogatepass")) - (1 << 63)


def chunks(text: str) -> list[str]:
    ends = cuts(text)
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def chunk_counts(docs: DataFrame) -> DataFrame:
    """(digest, length, n): how often each chunk occurs in all texts."""

    def start():
        def count(batch):
            found = Counter((digest_of(c), len(c)) for t in texts(batch) for c in chunks(t))
            return [], [[d for d, _ in found], [n for _, n in found], list(found.values())]

        return count

    counted = map_batches(docs.select("text"), [], {"digest": "long", "length": "int", "n": "long"}, start)
    return counted.groupBy("digest", "length").agg(F.sum("n").alias("n"))


def encoded_chunks(docs: DataFrame, vocabulary: str, wanted: set[int]) -> DataFrame:
    """(chunk, first, last, ids): the chunks with these digests, each encoded once."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def pick():
        seen: set[int] = set()

        def find(batch):
            found = {digest_of(c): c for t in texts(batch) for c in chunks(t)}
            fresh = (found.keys() & shared.value) - seen
            seen.update(fresh)
            return [], [list(fresh), [found[d] for d in fresh]]

        return find

    def start():
        bpe = codec(vocabulary)

        def encode(batch):
            made = [entry_of(c, bpe) for c in texts(batch, "chunk")]
            return None, [[e[0] for e in made], [e[1] for e in made], [None if e[2] is None else e[2].tobytes() for e in made]]

        return encode

    one = map_batches(docs.select("text"), [], {"digest": "long", "chunk": "string"}, pick)
    one = one.groupBy("digest").agg(F.min("chunk").alias("chunk"))
    return map_batches(one, ["chunk"], {"first": "int", "last": "int", "ids": "binary"}, start)


def entry_of(chunk: str, bpe: Codec) -> Entry:
    first, last = first_edge(chunk), last_edge(chunk)
    return first, last, bpe.encode(chunk[first:last]) if first >= 0 else None


def shared_chunks(docs: DataFrame, vocabulary: str) -> dict[str, Entry]:
    """The chunks that occur more than once and save most, with their ids: SHARED at most."""
    repeated = chunk_counts(docs).where(F.col("n") > 1)
    saved = (F.col("n") - 1) * F.col("length")
    best = repeated.orderBy(saved.desc(), "digest").limit(SHARED).select("digest", "length").collect()
    total = np.cumsum([r["length"] for r in best])
    wanted = {r["digest"] for r, so_far in zip(best, total, strict=True) if so_far <= SHARED_CHARACTERS}
    if not wanted:
        return {}
    rows = stored(encoded_chunks(docs, vocabulary, wanted), "chunks").collect()
    ids = [None if r["ids"] is None else np.frombuffer(r["ids"], np.uint32) for r in rows]
    return {r["chunk"]: (r["first"], r["last"], i) for r, i in zip(rows, ids, strict=True)}


class ChunkEncoder:
    """Encodes texts by chunks and keeps what it has encoded, up to ``room`` characters.

    ``shared`` holds chunks that are encoded already.
    """

    def __init__(self, bpe: Codec, room: int = 32_000_000, shared: dict[str, Entry] | None = None) -> None:
        self.bpe, self.room, self.shared = bpe, room, shared or {}
        self.held = 0
        self.known: OrderedDict[str, Entry] = OrderedDict()
        self.encoded = self.reused = 0

    def _chunk(self, chunk: str) -> Entry:
        entry = self.shared.get(chunk)
        if entry is None and (entry := self.known.get(chunk)) is not None:
            self.known.move_to_end(chunk)
        if entry is not None:
            self.reused += 1
            return entry
        entry = entry_of(chunk, self.bpe)
        self.encoded += 1
        self.known[chunk] = entry
        self.held += len(chunk)
        while self.held > self.room:
            self.held -= len(self.known.popitem(last=False)[0])
        return entry

    def encode(self, text: str) -> tuple[np.ndarray, int]:
        """Ids of ``text``, and its number of chunks."""
        parts, begin, open_from = [], 0, 0
        ends = cuts(text)
        for end in ends:
            first, last, ids = self._chunk(text[begin:end])
            if first >= 0:  # the join before this chunk ends on a boundary: repair it
                if begin + first > open_from:
                    parts.append(self.bpe.encode(text[open_from : begin + first]))
                parts.append(ids)
                open_from = begin + last
            begin = end
        if open_from < len(text):
            parts.append(self.bpe.encode(text[open_from:]))
        return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), len(ends)


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Ids of each text, with the text that these ids decode to.

    Returns doc_id, n_chunks (int), ids (array of int) and decoded (string), a row for each row
    of ``docs``. A null text is empty, and an empty text has no ids. Strings of special tokens
    in a text become these tokens. ``docs`` is read three times.
    """
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, vocabulary))

    def start():
        encoder = ChunkEncoder(codec(vocabulary), shared=shared.value)

        def encode(batch):
            rows = [encoder.encode(t) for t in texts(batch)]
            ids = [row[0] for row in rows]
            return None, ([n for _, n in rows], ids, [encoder.bpe.decode(i) for i in ids])

        return encode

    added = {"n_chunks": "int", "ids": "array<int>", "decoded": "string"}
    return map_batches(docs.select("doc_id", "text"), ["doc_id"], added, start)


def round_trip_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Number of ids, and digests of ids and decoded text, of each text; see ``encode_documents``.

    The digests are taken beside the ids, which then need not leave the task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, vocabulary))

    def start():
        encoder = ChunkEncoder(codec(vocabulary), shared=shared.value)
        shown: dict[int, str] = {}

        def digest(batch):
            out = []
            for text in texts(batch):
                ids, chunks = encoder.encode(text)
                listed = ids.tolist()
                for i in set(listed).difference(shown):
                    shown[i] = str(i)
                joined = ",".join(map(shown.__getitem__, listed)).encode()
                decoded = encoder.bpe.decode(ids).encode()
                out.append(
                    (len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded).hexdigest(), chunks)
                )
            return None, transposed(out, 4)

        return digest

    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "n_chunks": "int"}
    return map_batches(docs.select("doc_id", "text"), ["doc_id"], added, start)
