from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from shopflow.llm import phrases, sql

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
        words = re.findall(r"[^\x20\x09]+", piece)
        if words:
            yield words


def by_hand(docs, least, top):
    """The contract, counted phrase by phrase with Python's whole numbers."""
    counts, totals = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            totals[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    key = lang, tuple(words[i : i + m])
                    counts[key] = counts.get(key, 0) + 1
    frequent = {k: f for k, f in counts.items() if f >= least and len(k[1]) > 1}
    inside = set()
    for (lang, words), f in frequent.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                part = lang, words[i : i + m]
                if f >= counts[part]:
                    inside.add(part)
    rows = {}
    for (lang, words), a in frequent.items():
        if (lang, words) in inside:
            continue
        n = totals[lang]
        cuts = [(counts[lang, words[:k]], counts[lang, words[k:]], k) for k in range(1, len(words))]
        score, _, left, right = min((1000 * a * n // (x * y), k, x, y) for x, y, k in cuts)
        rows.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), a, left, right, n, score))
    return sorted(
        (lang, i + 1, r[2].decode(), *r[3:]) for lang, found in rows.items() for i, r in enumerate(sorted(found)[:top])
    )


def texts(seed, docs):
    rnd = random.Random(seed)
    vocabulary = ["New", "York", "ÉTÉ", "été", "of", "the", "cat", "a b", "x-1", "ß"]
    out = []
    for _ in range(docs):
        words = []
        for _ in range(rnd.randrange(0, 60)):
            words.append("new york of the cat" if rnd.random() < 0.1 else rnd.choice(vocabulary))
        text = "".join(w + rnd.choice([" ", " ", "  ", "\t", ". ", "\n", "; "]) for w in words)
        out.append((rnd.choice(["en", "de", None, "und"]), rnd.choice([text, text, text, None, ""])))
    return out


def found(spark, docs, **settings):
    table = spark.createDataFrame([(x, t, i, "s", 1) for i, (x, t) in enumerate(docs)], "lang string, text string, a long, word string, f int")
    return sorted(tuple(r) for r in phrases.phrases(table.repartition(3), **settings).collect())


#: One hot phrase, a very long text, no words at all, and ties that byte order decides.
ODD = [("hot", "big data big data big data, big")] * 40 + [("long", "one two three four five six " * 3000)]
ODD += [(None, None), ("fr", ""), ("fr", " ,;! \t"), ("es", "uno")] + [("tie", "z y. é f. b a. \U0001f600 q. ￮ q1")] * 8


@pytest.mark.parametrize(("least", "top", "rows", "bits"), [(5, 2000, 400, (16, 30)), (8, 3, 1 << 20, (15, 15))])
def test_equals_counting_by_hand(spark, monkeypatch, least, top, rows, bits):
    """Also with groups of a few suffixes, and with filters too small to leave anything out."""
    monkeypatch.setattr(phrases, "FILTER_BITS", bits)
    docs = texts(least, 120) + ODD
    got = found(spark, docs, least=least, top=top, group_rows=rows)
    assert got == by_hand(docs, least, top)
    ties = sorted((r[1], r[2]) for r in got if r[0] == "tie")
    assert [p for _, p in ties][:3] == ["b a", "z y", "é f"]


def test_empty_tables(spark):
    assert found(spark, [], least=2) == []
    assert found(spark, [("en", "a"), (None, None)], least=2) == []


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    docs = [("en", " ".join(f"w{i} w{i + 1}" for i in range(k, k + 400))) for k in range(0, 4000, 400)] * 3
    words = phrases.word_counts(spark.createDataFrame(docs, "lang string, text string"), 18)
    shared = phrases.shared_codes(words, 2)
    assert len(shared) > 5 and sorted(shared.values()) == list(range(1, len(shared) + 1))
    assert found(spark, docs, least=3, bits=18) == by_hand(docs, 3, 2000)


def test_slices_of_few_bytes(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 10)
    batch = pa.record_batch({"lang": ["en"] * 5, "text": ["abc def", None, "x" * 50, "", "y z"]})
    parts = list(phrases.sliced(batch))
    assert sum(len(p) for p in parts) == 5 and len(parts) > 1
    assert [t for p in parts for t in p.column(1).to_pylist()] == batch.column(1).to_pylist()


def test_words_of_a_batch():
    s = phrases.cut(pa.record_batch({"lang": ["en", None, "en"], "text": ["A b.a", "b", None]}))
    occurrences = [(s.langs[k], s.words[k]) for k in s.which.tolist()]
    assert occurrences == [("en", "a"), ("en", "b"), ("en", "a"), ("und", "b")]
    assert (np.diff(s.piece) != 0).tolist() == [False, True, True]


def test_scores_of_large_counts_are_exact(spark):
    rows = [(999_999_999_937, 9_007_199_254_740_993, 999_999_999_989, 1_000_000_000_039), (100, 10**15, 100, 100), (3, 7, 5, 11)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [r["score"] for r in df.select(phrases.score_of().alias("score")).collect()]
    assert got == [1000 * a * n // (x * y) for a, n, x, y in rows]


def test_the_sql_means_the_same(spark):
    docs = texts(9, 2500)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    got = con.execute(sql.PHRASES).fetchall()
    assert sorted(got) == by_hand(docs, 100, 2000)
    assert got
