"""Document fingerprints: threshold-scaled sketches of shingles.

A sketch keeps every shingle hash below a fixed share of the hash range, so its size follows the
document, and sketches of very unequal documents can be compared: each is a sample, at the same
rate and of the same shingles, of its whole document. If no hash is below the threshold it
keeps the smallest, so that no document is without one. With this rule the sketch of a union is
the merge of the sketches, exactly and in any order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from shopflow.llm.common import map_batches, texts, transposed

SHINGLE = 9  # characters
SHARE = 16  # one hash in so many is kept
RANGE = 1 << 32
THRESHOLD = RANGE // SHARE
DIGITS = 8


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """Distinct 32-bit hashes of the runs of ``size`` characters; a shorter text is one run."""
    if not text:
        return np.empty(0, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    width = min(size, len(points))
    n = len(points) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += points[k : k + n]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return (h >> np.uint64(32)).astype(np.uint32)


def scaled(hashes: np.ndarray) -> np.ndarray:
    """The hashes that a sketch keeps, ascending."""
    kept = hashes[hashes < THRESHOLD]
    return np.unique(kept if len(kept) or not len(hashes) else hashes.min(keepdims=True))


def sketch(text: str) -> np.ndarray:
    return scaled(shingle_hashes(text))


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of the shingles of both."""
    return scaled(np.concatenate([a, b]))


def to_text(kept: np.ndarray) -> str:
    return kept.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has too; 1 for an empty ``a``."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points) and fingerprint (hex) of each row; a null text is empty.

    Equal texts have equal fingerprints, an empty text an empty one.
    """

    def start():
        def make(batch):
            rows = [(len(t), to_text(sketch(t))) for t in texts(batch)]
            return None, transposed(rows, 2)

        return make

    added = {"n_chars": "long", "fingerprint": "string"}
    return map_batches(docs.select("doc_id", "text"), ["doc_id"], added, start)
