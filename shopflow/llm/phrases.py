"""Phrases whose words keep company: counts from suffix subtrees built group by group.

The words of a piece of text are a string, and a phrase's count is the number of suffixes that
begin with it. Suffixes are cut to five words and to what may still belong to a frequent phrase,
and dealt out by their first words to as many groups as the memory budget asks for. A prefix that
would fill a group by itself is extended (vertical partitioning): a hot word by its next word, a
hot pair by all words. Each group sorts its suffixes and builds its truncated subtree on its own,
from left to right; a node's count is the total of the leaves below it. Nodes above an extended
prefix have leaves in several groups, and their totals are added.

Words are 64-bit codes, hashes of language and word. Two words with one hash are found in the
table of all words, and all but one of them get a code that no hash has, so counts are exact.
Filters keep suffixes short: bits of frequent words, and of the buckets of pairs of neighbours
that hold enough occurrences. Bits also tell what is hot. All have a bounded size. They let too
much through, never too little, and too much only costs time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopflow.sources.scratch import stored

WORDS = 5  # longest phrase
SLICE = 1 << 20  # bytes of text at a time in a task
GROUP_ROWS = 1 << 19  # memory budget of a group, in suffixes
FILTER_BITS = (16, 30)  # smallest and largest size of a filter, as powers of two
RESERVED = 1 << 16  # codes that no hash has
SALTS = 32

UNKNOWN = "und"
BREAKS = b".,;:!?\n\x0b\x0c\r"
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = 1
KIND[list(BREAKS)] = 2

class Slice(NamedTuple):
    """The words of some texts: what differs, and for each occurrence which it is and its piece."""

    langs: list[str]  # of each different (language, word)
    words: list[str]
    which: np.ndarray
    piece: np.ndarray


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE bytes of text; a longer text is alone in its part."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64)) // SLICE
    ends = [*np.flatnonzero(part[1:] != part[:-1]) + 1, len(batch)]
    start = 0
    for end in ends:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def cut(batch: pa.RecordBatch) -> Slice:
    """Words of a batch of (lang, text); a null language is ``und``, a null text is empty."""
    text = pc.ascii_lower(pc.fill_null(batch.column(1), ""))
    offsets = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    kind = KIND[data]
    inside = kind == 0
    first = inside.copy()  # a byte that begins a word
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return Slice([], [], np.empty(0, np.int64), np.empty(0, np.int64))
    doc = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts] + doc  # a batch has less than 2**31 bytes
    bounds = np.cumsum(inside, dtype=np.int32)[starts] - 1
    bounds = np.append(bounds, np.int32(inside.sum()))
    packed = data[inside]
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(packed)).dictionary_encode()
    langs = pc.fill_null(batch.column(0), UNKNOWN).dictionary_encode()
    of_doc = langs.indices.to_numpy().astype(np.int64)
    names = words.dictionary.to_pylist()
    key = of_doc[doc] * len(names) + words.indices.to_numpy()
    different, which = np.unique(key, return_inverse=True)
    lang_names = langs.dictionary.to_pylist()
    return Slice(
        [lang_names[k // len(names)] for k in different.tolist()],
        [names[k % len(names)] for k in different.tolist()],
        which,
        piece,
    )


def coded(langs: list[str], words: list[str], taken: dict[tuple[str, str], int], bits: int = 64) -> np.ndarray:
    """64-bit codes of words; ``taken`` has those of words whose hash another word has too."""
    seeds = {x: xxhash.xxh64_intdigest(x.encode()) for x in set(langs)}
    hashed = [xxhash.xxh64_intdigest(w.encode(), seeds[x]) for x, w in zip(langs, words, strict=True)]
    codes = np.array(hashed, np.uint64) >> np.uint64(64 - bits)
    codes[codes < RESERVED] += np.uint64(RESERVED)
    codes = codes.view(np.int64)
    if taken:
        for i, pair in enumerate(zip(langs, words, strict=True)):
            if pair in taken:
                codes[i] = taken[pair]
    return codes


def bucket_of(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The bucket of each pair of neighbouring words, of ``size`` (a power of two)."""
    h = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return ((h >> np.uint64(32)) & np.uint64(size - 1)).astype(np.int64)


class Bits(NamedTuple):
    """A set of numbers below ``size``, a bit for each."""

    size: int
    data: np.ndarray

    def has(self, number: np.ndarray) -> np.ndarray:
        return (self.data[number >> 3] >> (number & 7).astype(np.uint8)) & 1 == 1


def filter_size(wanted: int) -> int:
    low, high = FILTER_BITS
    return 1 << min(high, max(low, int(wanted).bit_length()))


def bits_of(rows: DataFrame, number: Column, size: int) -> Bits:
    """The numbers of ``rows`` as bits: pieces of 32,768 bits are made by tasks and joined here."""
    pieces = rows.select(number.alias("at")).groupBy(F.shiftright("at", 15).alias("piece"))
    made = pieces.agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits"))
    data = np.zeros((max(1, size >> 15), 4096), np.uint8)
    for row in made.collect():  # size / 8 bytes at most
        data[row["piece"]] = np.frombuffer(row["bits"], np.uint8)
    return Bits(size, data.reshape(-1))


def over_texts(docs: DataFrame, schema: str, make: Callable[[Slice], list | None]) -> DataFrame:
    """Rows that ``make`` gets from the words of each slice of the texts, as columns."""
    names = [f.split(" ")[0] for f in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[f.split(" ")[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                columns = make(cut(part))
                if columns is not None:
                    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select("lang", "text").mapInArrow(run, schema)


def word_counts(docs: DataFrame, bits: int) -> DataFrame:
    def make(s: Slice) -> list | None:
        if not s.words:
            return None
        return [s.langs, s.words, coded(s.langs, s.words, {}, bits), np.bincount(s.which, minlength=len(s.words))]

    counted = over_texts(docs, "lang string, word string, code long, f long", make)
    return counted.groupBy("lang", "word", "code").agg(F.sum("f").alias("f"))


def shared_codes(words: DataFrame, least: int) -> dict[tuple[str, str], int]:
    """New codes for words that share one with another word, where together they are frequent.

    All members of a shared code but the first get one. There are about n * n / 2**65 shared
    codes of n different words; more than the reserved codes are an error.
    """
    members = F.collect_list(F.struct("lang", "word")).alias("members")
    shared = words.groupBy("code").agg(F.count("*").alias("n"), F.sum("f").alias("f"))
    shared = shared.where((F.col("n") > 1) & (F.col("f") >= least)).select("code")
    rows = words.join(shared, "code").groupBy("code").agg(members).limit(RESERVED).collect()
    pairs = [p for r in rows for p in sorted((m["lang"], m["word"]) for m in r["members"])[1:]]
    if len(pairs) >= RESERVED:
        raise ValueError("too many words share a hash")
    return {p: i + 1 for i, p in enumerate(sorted(pairs))}


def recoded(words: DataFrame, taken: dict[tuple[str, str], int]) -> DataFrame:
    if not taken:
        return words
    new = words.sparkSession.createDataFrame([(*k, v) for k, v in taken.items()], "lang string, word string, new long")
    joined = words.join(F.broadcast(new), ["lang", "word"], "left")  # fewer than RESERVED rows
    return joined.select("lang", "word", F.coalesce("new", "code").alias("code"), "f")


class Reader:
    """What tasks need to read frequent neighbours from texts."""

    def __init__(self, taken: dict, bits: int, frequent: Bits) -> None:
        self.taken, self.bits, self.frequent = taken, bits, frequent

    def pairs(self, s: Slice, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the different words; where a frequent word has a frequent neighbour; its bucket."""
        codes = coded(s.langs, s.words, self.taken, self.bits)
        good = self.frequent.has(codes & (self.frequent.size - 1))[s.which]
        at = np.flatnonzero(good[:-1] & good[1:] & (s.piece[:-1] == s.piece[1:]))
        each = codes[s.which]
        return codes, at, bucket_of(each[at], each[at + 1], size)


def pair_buckets(docs: DataFrame, reader: Reader, size: int, least: int) -> DataFrame:
    """(bucket, f): buckets that hold ``least`` occurrences of pairs or more; each frequent pair is in one."""
    shared = docs.sparkSession.sparkContext.broadcast(reader)

    def make(s: Slice) -> list | None:
        if not s.words:
            return None
        _, _, buckets = shared.value.pairs(s, size)
        return list(np.unique(buckets, return_counts=True))

    counted = over_texts(docs, "bucket long, f long", make).groupBy("bucket").agg(F.sum("f").alias("f"))
    return stored(counted.where(F.col("f") >= least), "buckets")


class Dealer(NamedTuple):
    """What goes on after a word, and to which group a suffix goes."""

    reader: Reader
    pairs: Bits  # buckets of pairs that go on
    hot_words: Bits
    hot_pairs: Bits  # buckets
    groups: int

    def prefixes(self, codes: np.ndarray) -> np.ndarray:
        """Words of the prefix that decides: one, two for a hot word, all for a hot pair."""
        hot = self.hot_words.has(codes[:, 0] & (self.hot_words.size - 1))
        pair = hot & self.hot_pairs.has(bucket_of(codes[:, 0].copy(), codes[:, 1].copy(), self.hot_pairs.size))
        return np.where(pair, WORDS, np.where(hot, 2, 1))

    def group(self, codes: np.ndarray, depth: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for d in range(WORDS):
            h += np.where(depth > d, codes[:, d], 0).view(np.uint64)
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h % np.uint64(self.groups)).astype(np.int64)


def suffixes(docs: DataFrame, dealer: Dealer) -> DataFrame:
    """Suffixes of two to five words, packed for each slice, group and language.

    (bin, lang, codes, counts, depths): five codes for each suffix, 0 after its end; how often it is
    in the slice; the words of its prefix.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dealer)

    def make(s: Slice) -> list | None:
        if not s.words:
            return None
        dealer = shared.value
        codes, at, buckets = dealer.reader.pairs(s, dealer.pairs.size)
        goes_on = np.zeros(len(s.which) + WORDS, bool)  # from a word to the next
        goes_on[at[dealer.pairs.has(buckets)]] = True
        at = np.flatnonzero(goes_on)
        if not len(at):
            return None
        each = np.append(s.which + 1, np.zeros(WORDS, np.int64))
        codes, base = np.append(0, codes), len(codes) + 1
        alive, columns = np.ones(len(at), bool), [each[at]]
        for d in range(1, WORDS):
            alive = alive & goes_on[at + d - 1]
            columns.append(np.where(alive, each[at + d], 0))
        row = columns[0]  # a number for each different suffix, a word at a time
        for c in columns[1:]:
            _, row = np.unique(row * base + c, return_inverse=True)
        _, chosen, counts = np.unique(row, return_index=True, return_counts=True)
        found = np.stack([codes[c[chosen]] for c in columns], axis=1)
        names = sorted(set(s.langs))
        number = {x: i for i, x in enumerate(names)}
        lang = np.array([number[x] for x in s.langs])[columns[0][chosen] - 1]
        depths = dealer.prefixes(found)
        key = dealer.group(found, depths) * len(names) + lang
        order = np.argsort(key, kind="stable")
        ends = [*np.flatnonzero(np.diff(key[order])) + 1, len(order)]
        parts = [order[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return [
            [int(key[p[0]]) // len(names) for p in parts],
            [names[int(lang[p[0]])] for p in parts],
            [found[p].tobytes() for p in parts],
            [counts[p].tobytes() for p in parts],
            [depths[p].astype(np.int8).tobytes() for p in parts],
        ]

    return over_texts(docs, "bin long, lang string, codes binary, counts binary, depths binary", make)


def subtree(codes: np.ndarray, counts: np.ndarray, depths: np.ndarray, least: int) -> Iterator[tuple[list[int], int, bool]]:
    """Nodes (codes, count, whole) of the tree of a group's suffixes, cut to five words.

    Sorted suffixes are its leaves from left to right; a node is a run of leaves with a common
    beginning, and counts their total. Whole nodes below ``least`` are left out. Nodes above the
    group's prefixes have leaves in other groups as well: they are not whole, and never left out.
    """
    order = np.lexsort(codes.T[::-1])
    codes, counts, depths = codes[order], counts[order], depths[order]
    new = np.zeros(len(codes), bool)
    new[0] = True
    for d in range(1, WORDS + 1):
        new[1:] |= codes[1:, d - 1] != codes[:-1, d - 1]
        if d == 1:
            continue  # single words are counted already
        starts = np.flatnonzero(new)
        totals = np.add.reduceat(counts, starts)
        whole = depths[starts] <= d
        for k in np.flatnonzero((codes[starts, d - 1] != 0) & (~whole | (totals >= least))).tolist():
            yield codes[starts[k], :d].tolist(), int(totals[k]), bool(whole[k])


def subtrees(packed: DataFrame, groups: int, least: int) -> DataFrame:
    """(lang, codes, a): phrases that occur ``least`` times or more, from each group's tree."""
    kinds = pa.schema([("lang", pa.string()), ("codes", pa.list_(pa.int64())), ("a", pa.int64()), ("whole", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nodes(lang: str, parts: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
            codes, counts, depths = (b"".join(x) for x in zip(*parts, strict=True))
            rows = np.frombuffer(codes, np.int64).reshape(-1, WORDS)
            made = list(subtree(rows, np.frombuffer(counts, np.int64), np.frombuffer(depths, np.int8), least))
            columns = [[lang] * len(made), *([x[i] for x in made] for i in range(3))]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

        key, parts = None, []
        # A batch may hold a whole group; few of its rows become Python objects at a time.
        for batch in (b.slice(k, 64) for b in batches for k in range(0, len(b), 64)):
            for group, lang, *data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (group, lang) != key and parts:
                    yield nodes(key[1], parts)
                    parts = []
                key = group, lang
                parts.append(tuple(data))
        if parts:
            yield nodes(key[1], parts)

    dealt = packed.repartition(groups, "bin").sortWithinPartitions("bin", "lang")
    made = stored(dealt.mapInArrow(run, "lang string, codes array<long>, a long, whole boolean"), "nodes")
    split = made.where("not whole").groupBy("lang", "codes").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return made.where("whole").drop("whole").unionByName(split)


def whole(least: int, docs: DataFrame, bits: int, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """Frequent words (lang, word, code, f, and n, all words of the language), and frequent phrases."""
    words = stored(word_counts(docs, bits), "words")
    taken = shared_codes(words, least)
    totals = stored(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    frequent = stored(recoded(words.where(F.col("f") >= least), taken), "frequent")
    known = frequent.agg(F.count("*").alias("words")).first()["words"]
    every = totals.agg(F.sum("n").alias("n")).first()["n"] or 0
    size, buckets = filter_size(64 * known), filter_size(every // 2)
    place = F.col("code").bitwiseAND(F.lit(size - 1))
    reader = Reader(taken, bits, bits_of(frequent, place, size))
    counted = pair_buckets(docs, reader, buckets, least)
    total = counted.agg(F.sum("f").alias("f")).first()["f"] or 0  # suffixes, before equal ones are one
    groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // group_rows))
    hot = max(1, total // (8 * groups))
    dealer = Dealer(
        reader,
        bits_of(counted, F.col("bucket"), buckets),
        bits_of(frequent.where(F.col("f") > hot), place, size),
        bits_of(counted.where(F.col("f") > hot), F.col("bucket"), buckets),
        groups,
    )
    nodes = stored(subtrees(suffixes(docs, dealer), groups, least), "phrases")
    return frequent.join(totals, "lang"), nodes


def score_of(a: str = "a", n: str = "n", left: str = "l", right: str = "r") -> Column:
    """floor(1000 * a * n / (l * r)), exactly: products of up to 38 digits. All are below 10**15."""
    above = f"CAST(1000 * {a} AS DECIMAL(19, 0)) * CAST({n} AS DECIMAL(18, 0))"
    return F.expr(f"({above}) DIV (CAST({left} AS DECIMAL(18, 0)) * CAST({right} AS DECIMAL(18, 0)))")


def phrases(
    docs: DataFrame, least: int = 100, top: int = 2000, bits: int = 64, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """The ``top`` phrases of each language by how much more often they occur than by chance.

    ``docs``: lang and text. A null text is empty, a null language ``und``. Texts are lower-cased
    (A-Z only), cut into pieces at .,;:!? and line ends, and these into words at blanks and tabs.
    Phrases are two to five words of a piece that occur ``least`` times or more, overlaps
    included; repeated documents count each. The score is floor(1000 * a * n / (l * r)): ``a`` the
    count, ``n`` all words of the language, ``l`` and ``r`` the counts of both parts at the cut that
    scores lowest, the earliest of equal ones. A phrase that only ever occurs inside one longer
    phrase, of five words at most, is left out. Ranked by score, count (both falling) and text.
    Returns lang, rank, phrase, a, l, r, n, score. A table without words gives no rows.

    ``bits``: of the hashes, fewer in tests.
    """
    words, nodes = whole(least, docs, bits, group_rows)
    size = F.size("codes")
    # A longer phrase of equal count has one of one more word between; those are enough.
    shorter = F.explode(F.array(F.slice("codes", F.lit(1), size - 1), F.slice("codes", F.lit(2), size - 1)))
    within = nodes.where(size > 2).select(shorter.alias("codes"), "a").distinct()
    kept = nodes.join(within, ["codes", "a"], "left_anti")

    counts = nodes.select("codes", F.col("a").alias("f"))
    counts = counts.unionByName(words.select(F.array("code").alias("codes"), "f"))
    cuts = kept.select("lang", "codes", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("codes", F.lit(1), F.col("k")))
    cuts = cuts.withColumn("right", F.slice("codes", F.col("k") + 1, size - F.col("k")))
    cuts = cuts.join(counts.select(F.col("codes").alias("left"), F.col("f").alias("l")), "left")
    cuts = cuts.join(counts.select(F.col("codes").alias("right"), F.col("f").alias("r")), "right")
    totals = words.select("lang", "n").distinct()
    cuts = cuts.join(totals, "lang").withColumn("score", score_of())
    lowest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("lowest")
    scored = cuts.groupBy("lang", "codes", "a", "n").agg(lowest).select("lang", "codes", "a", "n", "lowest.*")

    best = [F.desc("score"), F.desc("a")]
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("codes"), F.lit(SALTS))).orderBy(*best)
    first = scored.withColumn("rank", F.rank().over(parts)).where(F.col("rank") <= top)
    first = first.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*best)))
    first = stored(first.where(F.col("rank") <= top), "first")
    spelt = first.select("*", F.posexplode("codes").alias("at", "code"))
    spelt = spelt.join(words.select("lang", "code", "word"), ["lang", "code"])
    spelling = F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])
    spelt = spelt.groupBy("lang", "codes", "a", "l", "r", "n", "score").agg(F.array_join(spelling, " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(*best, "phrase")
    ranked = spelt.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
