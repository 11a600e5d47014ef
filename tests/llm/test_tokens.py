from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F
from shopflow.llm import chunk_bpe, packing, token_counts
from shopflow.llm.codec import codec

PIECES = [
    "a", "'s", "'re", " ", "  ", "\n", "\t", "b9", "<|endoftext|>", "é", "日本", "!!", "²",
    "\x1c", "　", "'", "_", "😀", " hello", "\xa0", " the", ".",
]


def texts(n=40, seed=1):
    draw = random.Random(seed)
    out = ["".join(draw.choices(PIECES, k=draw.randint(0, 1500))) for _ in range(n)]
    return [*out, *out[:3], "", None, "x" * 20_000, " " * 9_000, "word " * 9_000]


@pytest.fixture(scope="module")
def library(vocabulary):
    return Tokenizer.from_file(vocabulary)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_chunks_give_the_library_ids_and_texts(make_docs, vocabulary, library):
    rows = [*enumerate(texts()), (2**60 + 1, "a"), (None, "b"), (None, "b")]
    got = chunk_bpe.encode_documents(make_docs(rows), vocabulary).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    by_id = dict(rows)
    for r in got:
        ids = ids_of(library, by_id[r.doc_id])
        assert r.ids == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_digests_follow_the_ids(make_docs, vocabulary, library):
    rows = texts(6)
    got = {r.doc_id: r for r in chunk_bpe.round_trip_digests(make_docs(rows), vocabulary).collect()}
    for i, text in enumerate(rows):
        ids = ids_of(library, text)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_known_chunks_are_not_encoded_again(vocabulary):
    passage = " ".join(f"word{i * i}" for i in range(2000))
    encoder = chunk_bpe.ChunkEncoder(codec(vocabulary))
    encoder.encode("first " + passage)
    fresh = encoder.encoded
    encoder.encode("another beginning, longer than the first " + passage)
    assert encoder.encoded - fresh <= 3 and encoder.reused >= fresh - 3


def test_chunks_of_several_partitions_are_encoded_once(spark, vocabulary, monkeypatch):
    passage = " ".join(f"word{i * i}" for i in range(3000))
    docs = [(i, f"beginning {i} " * (20 + i) + passage + f" end {i}") for i in range(8)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(8, "doc_id")
    shared = chunk_bpe.shared_chunks(table, vocabulary)
    several = Counter(c for _, t in docs for c in chunk_bpe.chunks(t))
    assert set(shared) == {c for c, n in several.items() if n > 1}
    again = sum(n for c, n in several.items() if c not in shared)
    total = 0
    for _, text in docs:  # a task for each document
        encoder = chunk_bpe.ChunkEncoder(codec(vocabulary), shared=shared)
        assert encoder.encode(text)[0].tolist() == codec(vocabulary).encode(text).tolist()
        total += encoder.encoded
    assert total == again < sum(several.values()) / 4
    monkeypatch.setattr(chunk_bpe, "SHARED", 5)
    assert len(chunk_bpe.shared_chunks(table, vocabulary)) == 5
    monkeypatch.setattr(chunk_bpe, "SHARED_CHARACTERS", 1)
    assert chunk_bpe.shared_chunks(table, vocabulary) == {}


def test_store_of_chunks_is_bounded(vocabulary):
    encoder = chunk_bpe.ChunkEncoder(codec(vocabulary), room=3000)
    for k in range(50):
        encoder.encode(" ".join(f"{k}x{i}" for i in range(200)))
        assert encoder.held <= 3000


def test_tree_follows_edits(vocabulary):
    draw = random.Random(3)
    counts = token_counts.Counts(codec(vocabulary), limit=50)
    for text in texts(30):
        now = text or ""
        tree = token_counts.TokenTree(now, counts)
        for _ in range(5):
            start = draw.randint(0, len(now))
            stop = min(len(now), start + draw.choice([0, 1, 40]))
            new = "".join(draw.choices(PIECES, k=draw.randint(0, 3)))
            now = now[:start] + new + now[stop:]
            tree.replace(start, stop, new)
            assert tree.text() == now and tree.n_chars == len(now)
            assert tree.n_tokens == codec(vocabulary).count(now)


def test_an_edit_reads_few_segments(vocabulary):
    tree = token_counts.TokenTree("one two three " * 5000, token_counts.Counts(codec(vocabulary)))
    tree.replace(30_000, 30_004, "four")
    assert tree.reencoded <= 4


def test_edits_of_a_table(make_docs, vocabulary):
    docs = make_docs(["a b c", None, "", "a b c"])
    edits = F.expr(
        "array(named_struct('start', 0, 'stop', 1, 'new', 'hello there'), null,"
        " named_struct('start', cast(null as int), 'stop', 1, 'new', 'x'),"
        " named_struct('start', 900, 'stop', 2000, 'new', cast(null as string)))"
    )
    got = token_counts.edited_token_counts(docs, vocabulary, edits).collect()
    bpe = codec(vocabulary)
    expected = {0: "hello there b c", 1: "hello there", 2: "hello there", 3: "hello there b c"}
    assert {r.doc_id: r.edited_tokens for r in got} == {k: bpe.count(t) for k, t in expected.items()}
    none = token_counts.edited_token_counts(docs, vocabulary, F.lit(None)).collect()
    assert all(r.n_tokens == r.edited_tokens for r in none)


@pytest.mark.parametrize("window", [16, 64])
def test_pieces_cover_each_id_once(make_docs, vocabulary, library, window):
    rows = [t for t in texts(60, seed=5) if t is None or len(t) < 8000] + ["same length"] * 30
    pieces = packing.pack(make_docs(rows), vocabulary, window).toPandas()
    full = 0
    for _, of in pieces.groupby("sequence_id"):
        of = of.sort_values("offset")
        assert of["offset"].tolist() == [0, *of["length"].cumsum().tolist()[:-1]]
        assert of["length"].sum() <= window
        full += of["length"].sum() == window
    assert full >= pieces["sequence_id"].nunique() - 1
    for doc, of in pieces.groupby("doc_id"):
        ids = np.array([*ids_of(library, rows[doc]), 0], "<u4")
        of = of.sort_values("start")
        assert of["start"].tolist() == [0, *of["length"].cumsum().tolist()[:-1]]
        assert set(of["doc_tokens"]) == {len(ids)} and of["length"].sum() == len(ids)
        for r in of.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_least_squares_meets_what_can_be_met():
    blocks = packing.combinations(10, np.array([3, 4, 7]))
    assert {tuple(b) for b in blocks.tolist()} == {(3, 7, 0), (3, 3, 4)}
    histogram = np.zeros(11)
    histogram[[3, 4, 7]] = 25, 5, 15  # ten (3, 3, 4)... or fewer: 15 and 5 fill all
    used = packing.least_squares(blocks, histogram, steps=2000)
    by = dict(zip(map(tuple, blocks.tolist()), used, strict=True))
    assert by[3, 7, 0] == pytest.approx(15, abs=0.05) and by[3, 3, 4] == pytest.approx(5, abs=0.05)


def test_empty_tables(make_docs, vocabulary):
    none = make_docs(["x"]).where("doc_id < 0")
    assert packing.pack(none, vocabulary).count() == 0
    assert chunk_bpe.encode_documents(none, vocabulary).count() == 0
    assert token_counts.edited_token_counts(none, vocabulary, F.lit(None)).count() == 0
