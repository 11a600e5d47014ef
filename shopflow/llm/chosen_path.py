"""Self-join on the Jaccard similarity of word n-grams, by chosen paths.

Rows with equal sets of shingles form a class; only one set of each class is joined, and the
sizes of classes count as weights.

Candidates. Each set is embedded as ``TOKENS`` min-hash tokens, of which two sets share about
the share that is their similarity. In each run, at each node of a tree, a set goes on along
those of its tokens that the node's hash samples: on average ``1 / SAMPLED`` of them, so two
similar sets keep at least one path in common with a known probability. A node with up to
``SMALL`` sets is a bucket to be compared by brute force; a larger one is split again, up to
``DEPTH`` times, unless it holds more than half of the node it came from: such a crowd of like
sets stays together on every path, and splitting would only multiply it. A large bucket is
compared in tiles of bounded size. The number of runs follows from the recall that is asked
for at the threshold, with all ``DEPTH`` splits; pairs above it, or in crowds, are found with a
higher probability.

In a bucket the embedded sets are compared; those estimated at ``MARGIN`` below the threshold or
more are linked, and only a spanning forest of these links leaves the task. Two sets that earlier
links already connect need no comparison, so a crowd of near copies costs little more than
reading it. Of a bucket in several tiles, those of two blocks return only what joins the forests
of each. Its components are groups of sets with all near duplicates of each other.

Exact check. The shingles of the sets of a group are computed once more from the texts and all
pairs of a group are compared in tiles, which count links, and again return a spanning forest;
where only classes are asked for, connected sets are passed over here too. No step lists all
pairs. The components of the exact links are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.llm.common import map_batches, map_groups, texts, transposed
from shopflow.llm.components import components
from shopflow.sources.scratch import stored

TOKENS = 128
SAMPLED = 0.625
SMALL = 1024
DEPTH = 3
TILE = 256
BLOCK = 1024
MARGIN = 0.17

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+")
_DRAW = np.random.Generator(np.random.PCG64(8))
_FACTORS = _DRAW.integers(1, 1 << 32, TOKENS, np.uint32) | np.uint32(1)
_SHIFTS = _DRAW.integers(0, 1 << 32, TOKENS, np.uint32)


class WordHashes(dict):
    """64-bit hashes of words met before; emptied when ``limit`` of them are held."""

    def __init__(self, limit: int = 500_000) -> None:
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str, hashes: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` lower-case words.

    A text with fewer words is one shingle, one without words but not blank one of its
    characters. A blank text has none.
    """
    words = _WORD.findall(text.lower())
    if not words:
        text = text.strip()
        return np.array([xxhash.xxh64_intdigest(text, seed=1)] if text else [], np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(w))
    count = len(w) - width + 1
    h = np.full(count, width, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + count]
    return np.unique(mixed(h))


def embedded(tokens: np.ndarray) -> np.ndarray:
    """The min-hash tokens of a set of shingles, 32 bits each."""
    low = np.full(TOKENS, np.iinfo(np.uint32).max, np.uint32)
    short = (tokens >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(short), 2048):
        h = short[start : start + 2048, None] * _FACTORS
        h += _SHIFTS
        np.minimum(low, h.min(axis=0), out=low)
    return low


def runs_for(recall: float, threshold: float) -> int:
    """Runs after which a pair at the threshold has met in a bucket with probability ``recall``."""
    shared = threshold / SAMPLED  # tokens in common that a node samples, on average
    lost = 0.0
    for _ in range(DEPTH + 1):
        lost = math.exp(shared * (lost - 1.0))
    return math.ceil(math.log(1.0 - recall) / math.log(lost))


def children(nodes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``nodes``, the tokens it samples of a set: (index of node, child node)."""
    with np.errstate(over="ignore"):
        place = np.arange(TOKENS, dtype=np.uint64) << np.uint64(32)
        h = mixed(nodes[:, None] * np.uint64(0x9E3779B97F4A7C15) + mixed(tokens.astype(np.uint64) + place))
    chosen = h < np.uint64(int(2.0**64 / (SAMPLED * TOKENS)))
    at = np.nonzero(chosen)
    return at[0], mixed(h[at] + np.uint64(1))


def forest(links: list[tuple[int, int]], n: int) -> np.ndarray:
    """The smallest index connected with each of ``n``."""
    root = list(range(n))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return np.array([find(a) for a in range(n)])


def connected(own: np.ndarray, near: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest, as (index, smallest index of its component), of the sets of a tile.

    ``own``: the block of each; ``near``: whether each set after this one is near to it. Of two
    blocks, each has a tile of its own, so only what joins their components is returned.
    """
    n = len(own)
    part = np.arange(n)
    alone = own.min() == own.max()

    def join(across: bool) -> None:
        for k in range(n - 1):
            other = (part[k + 1 :] != part[k]) & ((own[k + 1 :] != own[k]) == across)
            if other.any():
                for p in np.unique(part[k + 1 :][other & near(k)]).tolist():
                    part[part == max(p, part[k])] = min(p, part[k])

    join(across=False)
    ends = np.arange(n)
    if not alone:
        ends = np.flatnonzero(part == ends)
        join(across=True)
    return [(k, r) for k, r in zip(ends.tolist(), part[ends].tolist(), strict=True) if k != r]


def tiled(members: DataFrame, sizes: DataFrame, group: str, item: str, rows: int) -> DataFrame:
    """Each row of a group beside each pair of the group's blocks that has it: columns i <= j and
    own, the block of the row. A block has about ``rows`` rows; a small group is one block.

    ``sizes``: ``group`` and ``count``.
    """
    blocks = F.when(F.col("count") > 2 * rows, F.ceil(F.col("count") / rows)).otherwise(1)
    partners = F.sequence(F.lit(0), F.col("blocks") - 1)
    return (
        members.join(sizes, group)
        .withColumn("blocks", blocks.cast("int"))
        .withColumn("own", F.pmod(F.xxhash64(item), "blocks").cast("int"))
        .withColumn("partner", F.explode(partners))
        .withColumn("i", F.least("own", "partner"))
        .withColumn("j", F.greatest("own", "partner"))
        .drop("count", "blocks", "partner")
    )


def distinct_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, digest of the set of shingles (null for none), size and embedded tokens."""

    def start():
        hashes = WordHashes()

        def make(batch):
            out = []
            for text in texts(batch):
                s = shingles(text, hashes, n)
                if len(s):
                    out.append((xxhash.xxh128_digest(s.tobytes()), len(s), embedded(s).tobytes()))
                else:
                    out.append((None, 0, None))
            return None, transposed(out, 3)

        return make

    added = {"digest": "binary", "size": "int", "tokens": "binary"}
    return map_batches(docs.select("doc_id", "text"), ["doc_id"], added, start)


def buckets(sets: DataFrame, runs: int) -> DataFrame:
    """(node, digest) of the buckets to be compared."""
    roots = mixed(np.arange(1, runs + 1, dtype=np.uint64))

    def start():
        def first(batch):
            at, out = [], []
            for k, tokens in enumerate(batch.column(1).to_pylist()):
                nodes = children(roots, np.frombuffer(tokens, np.uint32))[1].view(np.int64)
                at += [k] * len(nodes)
                out.append(nodes)
            return at, [np.concatenate(out) if out else []]

        return first

    def start_next():
        def deeper(batch):
            at, out = [], []
            for k, (tokens, node) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                nodes = children(np.array([node]).view(np.uint64), np.frombuffer(tokens, np.uint32))[1]
                at += [k] * len(nodes)
                out.append(nodes.view(np.int64))
            return at, [np.concatenate(out) if out else []]

        return deeper

    light = sets.select("digest", "tokens")
    level = stored(map_batches(light, ["digest"], {"node": "long"}, start), "paths")
    level = level.withColumn("held", F.lit(None).cast("long"))  # sets of the node above
    leaves = []
    for depth in range(DEPTH + 1):
        sizes = level.groupBy("node").agg(F.count("*").alias("count"), F.min("held").alias("held"))
        sizes = sizes.where("count > 1")
        last = depth == DEPTH
        crowd = F.coalesce(2 * F.col("count") > F.col("held"), F.lit(False))
        whole = F.lit(last) | (F.col("count") <= SMALL) | crowd
        ready = sizes.where(whole)
        leaves.append(level.join(ready.select("node"), "node"))
        if last:
            break
        split = sizes.where(~whole).select("node", F.col("count").alias("held"))
        large = stored(level.drop("held").join(split, "node"), "large")
        if large.limit(1).count() == 0:
            break
        again = light.join(large, "digest").select("digest", "tokens", F.col("node").alias("above"), "held")
        level = stored(map_batches(again, ["digest", "held"], {"node": "long"}, start_next), "paths")
    out = leaves[0]
    for leaf in leaves[1:]:
        out = out.unionByName(leaf)
    return out.select("node", "digest")


def candidate_links(sets: DataFrame, runs: int, threshold: float) -> DataFrame:
    """Edges (a, b) between sets whose embedded tokens are similar enough for the exact check.

    Of buckets with the same members, which near duplicates give in every run, one is compared.
    """
    members = stored(buckets(sets, runs), "buckets")
    named = members.groupBy("node").agg(
        F.count("*").alias("count"),
        F.sum(F.xxhash64("digest").cast("decimal(20,0)")).alias("sum"),
        F.bit_xor(F.xxhash64(F.lit(1), "digest")).alias("xor"),
    )
    sizes = named.groupBy("count", "sum", "xor").agg(F.min("node").alias("node"))
    tiles = tiled(members, sizes.select("node", "count"), "node", "digest", BLOCK)
    tiles = tiles.join(sets.select("digest", "tokens"), "digest")
    least = math.ceil((threshold - MARGIN) * TOKENS)

    def compare(key: tuple, rows: list[tuple]) -> list[tuple]:
        ids, own, tokens = zip(*rows, strict=True)
        embedding = np.frombuffer(b"".join(tokens), np.uint32).reshape(-1, TOKENS)
        own = np.array(own)

        def near(k: int) -> np.ndarray:
            return (embedding[k + 1 :] == embedding[k]).sum(axis=1) >= least

        return [(ids[k], ids[r]) for k, r in connected(own, near)]

    made = {"a": "binary", "b": "binary"}
    return map_groups(tiles, ["node", "i", "j"], ["digest", "own", "tokens"], made, compare)


class SharedCounts:
    """For a set of a list, how many tokens it shares with each that follows."""

    def __init__(self, tokens: list[np.ndarray]) -> None:
        names, self.code = np.unique(np.concatenate(tokens), return_inverse=True)
        self.mark = np.zeros(len(names), bool)
        self.starts = np.cumsum([0, *map(len, tokens)])

    def __call__(self, k: int) -> np.ndarray:
        start, end = self.starts[k : k + 2]
        own = self.code[start:end]
        self.mark[own] = True
        shared = np.add.reduceat(self.mark[self.code[end:]], self.starts[k + 1 : -1] - end, dtype=np.int64)
        self.mark[own] = False
        return shared


def exact_links(
    docs: DataFrame, groups: DataFrame, n: int, threshold: float, count: bool = True
) -> DataFrame:
    """Links inside the groups: a row for each set and tile with any.

    ``groups``: digest of a set, doc_id of a row with it, weight, root of its group. Returns
    digest, root (the first set connected with it in the tile), links (rows of the linked
    sets) and linked_sets. Without ``count`` these two are 0, and rows only those of a spanning
    forest.
    """
    texts_of = docs.select("doc_id", "text").join(groups, "doc_id")

    def start():
        hashes = WordHashes()

        def make(batch):
            at, out = [], []
            want = batch.column(batch.schema.get_field_index("digest")).to_pylist()
            for k, (text, digest) in enumerate(zip(texts(batch), want, strict=True)):
                data = shingles(text, hashes, n).tobytes()
                if xxhash.xxh128_digest(data) == digest:  # an id may have rows with other texts
                    at.append(k)
                    out.append(data)
            return at, [out]

        return make

    members = map_batches(texts_of, ["root", "digest", "weight"], {"shingles": "binary"}, start)
    members = stored(members.dropDuplicates(["digest"]), "members")

    def compare(key: tuple, rows: list[tuple]) -> list[tuple]:
        ids, own, weights, data = zip(*rows, strict=True)
        tokens = [np.frombuffer(s, np.uint64) for s in data]
        own, weight, size = np.array(own), np.array(weights), np.array([len(t) for t in tokens])
        shares = SharedCounts(tokens)

        def near(k: int) -> np.ndarray:
            shared = shares(k)
            return shared >= threshold * (size[k] + size[k + 1 :] - shared) - 1e-9

        if not count:
            return [(ids[k], ids[r], 0, 0) for k, r in connected(own, near)]
        links, counts, total = [], np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for k in range(len(ids) - 1):
            close = near(k)
            if key[1] != key[2]:
                close &= own[k + 1 :] != own[k]
            found = np.flatnonzero(close) + k + 1
            links += [(k, m) for m in found.tolist()]
            counts[k] += len(found)
            counts[found] += 1
            total[k] += weight[found].sum()
            total[found] += weight[k]
        root = forest(links, len(ids))
        some = np.flatnonzero(counts).tolist()
        return [(ids[k], ids[root[k]], int(total[k]), int(counts[k])) for k in some]

    sizes = members.groupBy("root").count().where("count > 1")
    tiles = tiled(members, sizes, "root", "digest", TILE)
    made = {"digest": "binary", "root": "binary", "links": "long", "linked_sets": "long"}
    values = ["digest", "own", "weight", "shingles"]
    return map_groups(tiles, ["root", "i", "j"], values, made, compare)


def similar_documents(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, count: bool = True
) -> DataFrame:
    """Class and number of links of each row of ``docs``.

    Two rows are linked if the Jaccard similarity of their word ``n``-grams is ``threshold`` or
    more; classes are the components of the links. Returns doc_id, class_id (the smallest
    doc_id of the class), n_links (other rows linked with it, copies counted each) and
    linked_texts (linked sets other than its own). Rows with a blank text, or with a null id, are
    linked with none; these are a class of their own, null for a null id. Rows that repeat an id
    are rows like others. ``recall`` is the probability, for each pair at the threshold, that
    some bucket holds it; links found through others of the group come on top. Without ``count``
    only doc_id and class_id are returned, for less work on crowds of near copies.
    """
    rows = stored(distinct_sets(docs, n), "sets")
    known = rows.where("doc_id is not null and digest is not null")
    sets = known.groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"),
        F.count("*").alias("weight"),
        F.first("tokens").alias("tokens"),
    )
    sets = stored(sets, "distinct_sets")
    found = candidate_links(sets, runs_for(recall, threshold), threshold)
    groups = components(found).withColumnRenamed("node", "digest")
    wanted = sets.select("digest", "doc_id", "weight").join(groups, "digest")
    links = stored(exact_links(docs, wanted, n, threshold, count), "links")
    classes = components(links.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("digest").agg(
        F.sum("links").alias("links"), F.sum("linked_sets").alias("linked_texts")
    )
    of_set = (
        sets.select("digest", "doc_id", "weight")
        .join(classes.withColumnRenamed("node", "digest"), "digest")
        .join(counts, "digest", "left")
    )
    first = of_set.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    of_set = of_set.join(first, "root").select("digest", "class_id", "links", "linked_texts")
    alone = F.when(F.col("doc_id").isNotNull(), F.col("digest"))
    copies = sets.select("digest", F.col("doc_id").alias("first_id"), "weight")
    labelled = (
        rows.select("doc_id", alone.alias("digest"))
        .join(copies, "digest", "left")
        .join(of_set, "digest", "left")
        .select(
            "doc_id",
            F.coalesce("class_id", "first_id", "doc_id").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).alias("n_links"),
            F.coalesce("linked_texts", F.lit(0)).alias("linked_texts"),
        )
    )
    return labelled if count else labelled.select("doc_id", "class_id")


def without_near_copies(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999
) -> DataFrame:
    """One row of each class of ``similar_documents``, the one with the smallest id.

    Of rows with the same id and text one stays; rows with a null id or a blank text stay. An id
    that has rows with several texts goes only if all of these are near copies of others.
    """
    classes = similar_documents(docs, n, threshold, recall, count=False).where("doc_id is not null")
    gone = classes.groupBy("doc_id").agg(F.max("class_id").alias("high"))
    gone = gone.where("high < doc_id").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti")
    named = kept.where("doc_id is not null and trim(text) != ''").dropDuplicates(["doc_id", "text"])
    return named.unionByName(kept.where("doc_id is null or text is null or trim(text) = ''"))
