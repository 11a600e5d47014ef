"""Language of texts by a bidirectional gated recurrent network over bytes.

The network reads windows of bytes in both directions and gives each position a probability of
each language; a document's are the means over the positions of all its windows. It is trained
in numpy by backpropagation through time on windows from a bounded sample of documents, the same
number for each language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopflow.llm.common import map_batches, texts
from shopflow.sources.scratch import stored

SPAN = 96  # bytes of a window
HIDDEN = 12
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def initial(languages: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights of both directions (0 forward, 1 backward) and of the output layer."""
    draw = np.random.default_rng(seed)

    def normal(*shape, scale):
        return (draw.standard_normal(shape) * scale).astype(np.float32)

    weights = {}
    for d in (0, 1):
        weights[f"byte{d}"] = normal(256, 3 * HIDDEN, scale=0.3)
        weights[f"loop{d}"] = normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
    weights["out"] = normal(2 * HIDDEN, languages, scale=0.2)
    weights["bias"] = np.zeros(languages, np.float32)
    return weights


def read(x: np.ndarray, table: np.ndarray, loop: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States after each byte: ``x`` (steps, windows) gives (steps, windows, HIDDEN).

    Gates z (keep) and r (reset), then the candidate n: h = n + z (h - n). ``trace`` gets what
    the way back needs.
    """
    steps, windows = x.shape
    states = np.zeros((steps + 1, windows, HIDDEN), np.float32)
    for t in range(steps):
        h = states[t]
        a, g = table[x[t]], h @ loop
        zr = a[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1.0
        zr *= 0.5
        z, r, gn = zr[:, :HIDDEN], zr[:, HIDDEN:], g[:, 2 * HIDDEN :]
        n = np.tanh(a[:, 2 * HIDDEN :] + r * gn)
        np.add(n, z * (h - n), out=states[t + 1])
        if trace is not None:
            trace.append((z, r, n, gn))
    return states


def read_back(x, loop, states, trace, grad) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of table and loop weights from those of the states after each byte."""
    table_grad = np.zeros((256, 3 * HIDDEN), np.float32)
    loop_grad = np.zeros_like(loop)
    dh = np.zeros_like(states[0])
    for t in reversed(range(len(x))):
        z, r, n, gn = trace[t]
        h = states[t]
        dh = dh + grad[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        da = np.concatenate([dz, dr, dn], axis=1)
        dg = np.concatenate([dz, dr, dn * r], axis=1)
        np.add.at(table_grad, x[t], da)
        loop_grad += h.T @ dg
        dh = dh * z + dg @ loop.T
    return table_grad, loop_grad


def probabilities(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Probabilities of each language at each position: (SPAN, windows, languages)."""
    ahead = read(x, w["byte0"], w["loop0"])[1:]
    behind = read(x[::-1], w["byte1"], w["loop1"])[1:][::-1]
    logits = ahead @ w["out"][:HIDDEN] + behind @ w["out"][HIDDEN:] + w["bias"]
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits


def train(
    x: np.ndarray, y: np.ndarray, languages: int, steps: int = 400, batch: int = 128, rate: float = 0.02, seed: int = 3
) -> dict[str, np.ndarray]:
    """Fit to windows ``x`` (windows, SPAN) of the languages ``y``, by Adam with a falling rate."""
    w = initial(languages)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    draw = np.random.default_rng(seed)
    for step in range(1, steps + 1):
        chosen = draw.integers(0, len(x), batch)
        xs, ys = x[chosen].T, y[chosen]
        there = (xs > 0)[:, :, None] / np.float32(max(1, int((xs > 0).sum())))
        traces: tuple[list, list] = ([], [])
        a = read(xs, w["byte0"], w["loop0"], traces[0])
        b = read(xs[::-1], w["byte1"], w["loop1"], traces[1])
        both = np.concatenate([a[1:], b[1:][::-1]], axis=2)
        logits = both @ w["out"] + w["bias"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(batch), ys] -= 1.0
        d = (p * there).astype(np.float32)
        back = d @ w["out"].T
        grads = {"out": np.tensordot(both, d, ((0, 1), (0, 1))), "bias": d.sum(axis=(0, 1))}
        grads["byte0"], grads["loop0"] = read_back(xs, w["loop0"], a, traces[0], back[:, :, :HIDDEN])
        grads["byte1"], grads["loop1"] = read_back(
            xs[::-1], w["loop1"], b, traces[1], back[::-1, :, HIDDEN:]
        )
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        slow = rate * (1.0 - step / (steps + 1)) * min(1.0, 1.0 / max(norm, 1e-9))
        for k, g in grads.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            scale = np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8
            w[k] -= slow * first[k] / (1 - 0.9**step) / scale
    return w


def windows_of(data: bytes) -> np.ndarray:
    """All bytes in rows of SPAN; the last is filled up with zeros."""
    rows = -(-len(data) // SPAN)
    return np.frombuffer(data.ljust(rows * SPAN, b"\0"), np.uint8).reshape(rows, SPAN)


def training_windows(sample: DataFrame, each: int = 4) -> DataFrame:
    """Up to ``each`` windows of each text, from places all over it, some of them short."""

    def start():
        def make(batch):
            at, out = [], []
            for k, text in enumerate(texts(batch)):
                data = text.encode("utf-8", "replace")
                seed = xxhash.xxh32_intdigest(data)
                for i in range(min(each, -(-len(data) // SPAN))):
                    begin = xxhash.xxh32_intdigest(bytes([i]), seed) % max(1, len(data) - SPAN + 1)
                    length = SPAN if i % 4 else SPAN // 3
                    at.append(k)
                    out.append(data[begin : begin + length].ljust(SPAN, b"\0"))
            return at, [out]

        return make

    return map_batches(sample.select("text", "lang"), ["lang"], {"window": "binary"}, start)


@dataclass
class Model:
    languages: list[str]
    weights: dict[str, np.ndarray]


def sample_of(docs: DataFrame, usable: Column, rows: int, languages: int) -> DataFrame:
    """Texts to learn from (doc_id, lang, text): at most ``rows`` of each of ``languages`` languages.

    The languages are those with the most ids, as sketches count them, ties by name; the ids of
    each are those with the smallest hashes. Of an id that several rows bear in a language, the
    smallest text with a letter counts.
    """
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids"))
    counts = counts.orderBy(F.desc("ids"), "lang").limit(languages)
    # Hashes are spread evenly, so that about 4 * rows ids of a language are below this share of
    # their range, and the first ``rows`` are among these.
    low = F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5 <= 4.0 * rows / F.col("ids")
    ids = known.select("doc_id", "lang").join(F.broadcast(counts), "lang").where(low)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = ids.select("doc_id", "lang").distinct().withColumn("place", F.row_number().over(order))
    chosen = stored(ranked.where(F.col("place") <= rows).select("doc_id", "lang"), "chosen")
    lettered = known.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    sample = lettered.join(F.broadcast(chosen), ["doc_id", "lang"])  # rows times languages at most
    return sample.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def learn(docs: DataFrame, usable: Column, rows: int = 800, most: int = 200) -> Model:
    """Train on at most ``rows`` documents of each of the ``most`` commonest languages.

    See ``sample_of``. Documents with a null language, id or text, or without letters, teach
    nothing; a language beyond these is not learnt.
    """
    sample = sample_of(docs, usable, rows, most)
    made = training_windows(sample).collect()
    languages = sorted({r["lang"] for r in made})
    if not languages:
        return Model([], {})
    order = sorted(range(len(made)), key=lambda k: (made[k]["lang"], bytes(made[k]["window"])))
    x = np.array([np.frombuffer(made[k]["window"], np.uint8) for k in order])
    y = np.array([languages.index(made[k]["lang"]) for k in order])
    # Each language as often as any other.
    per = [np.flatnonzero(y == k) for k in range(len(languages))]
    most = max(map(len, per))
    even = np.concatenate([np.resize(p, most) for p in per])
    return Model(languages, train(x[even], y[even], len(languages)))


def predict(docs: DataFrame, model: Model, chunk: int = 2048) -> DataFrame:
    """doc_id, lang_pred and score (its pooled probability) of each whole text.

    A text that is null or has no letter, and any text if no language was learnt, is ``und``
    with score 0. Repeated rows are predicted alike.
    """

    def start():
        languages = np.array([*model.languages, UNKNOWN], object)

        def make(batch):
            data = [t.encode("utf-8", "replace") if _LETTER.search(t) else b"" for t in texts(batch)]
            best, score = np.full(len(data), len(languages) - 1), np.zeros(len(data))
            if model.languages:
                pooled, length = np.zeros((len(data), len(model.languages))), np.array([len(d) for d in data])
                pending, owner, held = [], [], 0

                def pool():
                    x, who = np.concatenate(pending), np.repeat(*map(np.array, zip(*owner, strict=True)))
                    for k in range(0, len(x), chunk):
                        part = x[k : k + chunk].T
                        p = (probabilities(part, model.weights) * (part > 0)[:, :, None]).sum(axis=0)
                        np.add.at(pooled, who[k : k + chunk], p)

                for k, d in enumerate(data):
                    if d:
                        rows = windows_of(d)
                        pending.append(rows)
                        owner.append((k, len(rows)))
                        held += len(rows)
                    if held >= 16 * chunk:
                        pool()
                        pending, owner, held = [], [], 0
                if pending:
                    pool()
                some = length > 0
                total = np.maximum(pooled.sum(axis=1, keepdims=True), 1e-9)
                best[some] = pooled.argmax(axis=1)[some]
                score[some] = (pooled / total).max(axis=1)[some]
            return None, [languages[best].tolist(), score]

        return make

    added = {"lang_pred": "string", "score": "double"}
    return map_batches(docs.select("doc_id", "text"), ["doc_id"], added, start)
