"""A byte-level BPE vocabulary, loaded once per process, and where its texts may be cut.

The vocabulary is a ``tokenizers`` JSON file. Its ids are computed with ``tiktoken``, which
gives the same ids several times faster; that needs merges listed in the order of their ids, no
normaliser and no prefix space, which ``codec`` checks.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken

# Fixed value: the split that a byte-level pre-tokenizer does before the merges.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

# The code points that count as white space for that split.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: A pre-token never runs from a character that isn't white space into one that is. The places
#: between such two are boundaries whatever stands around them, so the ids of a text are those
#: of its segments, one after another. (A special token holds no white space.)
SEGMENT = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
_EDGE = re.compile(f"(?<=[^{SPACES}])(?=[{SPACES}])")


def first_edge(text: str) -> int:
    """Place of the first fixed boundary in ``text``, or -1."""
    found = _EDGE.search(text)
    return found.start() if found else -1


def last_edge(text: str) -> int:
    """Place of the last fixed boundary in ``text``, or -1."""
    step = 64
    while True:
        start = max(0, len(text) - step)
        place = max((m.start() for m in _EDGE.finditer(text, start)), default=-1)
        if place >= 0 or start == 0:
            return place
        step *= 8


def _byte_of() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        vocab = model["vocab"]
        pairs = ("".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"])
        ids = [vocab[p] for p in pairs]
        if model["type"] != "BPE" or spec["normalizer"] or split.get("type") != "ByteLevel":
            raise ValueError(f"{path}: not a byte-level BPE without normaliser")
        if split.get("add_prefix_space") or ids != sorted(ids):
            raise ValueError(f"{path}: merges out of order, or a prefix space")
        of = _byte_of()
        ranks = {bytes(of[c] for c in token): rank for token, rank in vocab.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._bpe = tiktoken.Encoding(
            path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special
        )

    def encode(self, text: str) -> np.ndarray:
        """Ids of ``text`` as unsigned 32-bit numbers; strings of special tokens become these."""
        return self._bpe.encode_to_numpy(text, allowed_special="all")

    def count(self, text: str) -> int:
        return len(self._bpe.encode(text, allowed_special="all"))

    def decode(self, ids: np.ndarray) -> str:
        return self._bpe.decode_bytes(ids.tolist()).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)
