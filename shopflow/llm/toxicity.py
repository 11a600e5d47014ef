"""Toxicity of texts by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation, reported speech, or other. Which words
are insults is learnt from labels: words, and beginnings of words, that stand in many different
contexts of toxic texts and in hardly any of others. The other lists are given. Transducers for
negation, reported speech, threats and targets are composed into one, which reads a clause and
weighs each insult or threat by what stands around it. A text's clause weights give a few
numbers; a logistic model of these, fitted to the labels, gives its score.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.llm.common import map_batches, texts
from shopflow.llm.labelled import labelled_sample
from shopflow.sources.scratch import stored

TARGETS = frozenset(
    "you your yours yourself they them their he him she her du dich dir dein deine ihr euch"
    " vous toi ton votre usted ustedes tuyo ellos ellas".split()
)
THREATS = frozenset(
    "kill hurt destroy murder beat shoot stab hang töten umbringen erschlagen erschießen tuer"
    " frapper détruire matar golpear destruir".split()
)
NEGATIONS = frozenset("not never no don't isn't aren't nicht kein keine nie jamais nunca".split())
REPORTS = frozenset(
    "said says wrote writes quoted called reported sagte schrieb nannte dit écrit dijo escribió".split()
)

_CLAUSE = re.compile(r"[^.!?;:\n]+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
STEMS = (4, 5, 6)

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "oithnr"


@dataclass(frozen=True)
class Transducer:
    """``arcs[state, symbol]`` = (next state, symbol written, weight); it starts in state 0.

    Symbols without an arc are written as they are, at weight 1, and lead to ``rest[state]``.
    """

    arcs: dict
    rest: tuple

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or (self.rest[state], symbol, 1.0)


def negation(scope: int = 3, weight: float = 0.3) -> Transducer:
    """An insult or threat within ``scope`` words after a negation loses weight."""
    arcs = {(s, NEGATION): (scope, OTHER, 1.0) for s in range(scope + 1)}
    for s in range(1, scope + 1):
        arcs |= {(s, x): (s - 1, x, weight) for x in (INSULT, THREAT)}
    return Transducer(arcs, tuple(max(0, s - 1) for s in range(scope + 1)))


def reported(weight: float = 0.5) -> Transducer:
    """After a verb of reporting, the rest of the clause is somebody else's word."""
    arcs = {(s, REPORT): (1, OTHER, 1.0) for s in (0, 1)}
    arcs |= {(1, x): (1, x, weight) for x in (INSULT, THREAT)}
    return Transducer(arcs, (0, 1))


def threats(reach: int = 2) -> Transducer:
    """A threat counts as an insult if a target follows within ``reach`` words; else it is a word.

    The weight is given when the target is read, so a threat without one leaves no trace.
    """
    arcs = {(s, THREAT): (reach, OTHER, 1.0) for s in range(reach + 1)}
    arcs |= {(s, TARGET): (0, INSULT, 1.5) for s in range(1, reach + 1)}
    return Transducer(arcs, tuple(max(0, s - 1) for s in range(reach + 1)))


def targeted(weight: float = 1.5) -> Transducer:
    """An insult weighs more in a clause that has named a target."""
    arcs = {(s, TARGET): (1, OTHER, 1.0) for s in (0, 1)} | {(1, INSULT): (1, INSULT, weight)}
    return Transducer(arcs, (0, 1))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """What ``b`` makes of what ``a`` writes; weights multiply. States are numbered as reached."""
    number = {(0, 0): 0}
    queue, arcs, rest = [(0, 0)], {}, {}
    for s, t in queue:  # grows as new states are reached
        for x in (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT):
            s2, y, v = a.step(s, x)
            t2, z, w = b.step(t, y)
            if (s2, t2) not in number:
                number[s2, t2] = len(number)
                queue.append((s2, t2))
            arcs[number[s, t], x] = (number[s2, t2], z, v * w)
            if x == OTHER:
                rest[number[s, t]] = number[s2, t2]
    return Transducer(arcs, tuple(rest[k] for k in range(len(number))))


@lru_cache(maxsize=1)
def grammar() -> Transducer:
    return reduce(compose, (negation(), reported(), threats(), targeted()))


@dataclass
class Model:
    """Weights of insults (whole words; beginnings end in ``*``) and of the logistic model."""

    lexicon: dict[str, float]
    coefficients: np.ndarray


class Reader:
    """Scores clauses with a lexicon; remembers the symbols of words, up to ``limit`` of them."""

    def __init__(self, lexicon: dict[str, float], limit: int = 500_000) -> None:
        self.lexicon, self.limit, self.known = lexicon, limit, {}
        self.arcs = grammar().arcs

    def symbol(self, word: str) -> tuple[str, float]:
        found = self.known.get(word)
        if found is None:
            stems = (word, *(word[:n] + "*" for n in STEMS if len(word) >= n))
            weight = max((self.lexicon.get(s, 0.0) for s in stems), default=0.0)
            kinds = ((TARGET, TARGETS), (THREAT, THREATS), (NEGATION, NEGATIONS), (REPORT, REPORTS))
            other = next((k for k, words in kinds if word in words), OTHER)
            found = (INSULT, weight) if weight > 0 else (other, 1.0)
            if len(self.known) >= self.limit:
                self.known.clear()
            self.known[word] = found
        return found

    def clause(self, words: list[str]) -> float:
        """Summed weight of the insults and threats of a clause, 0 for a clause without."""
        symbols = list(map(self.symbol, words))
        if not any(s == INSULT or s == THREAT for s, _ in symbols):
            return 0.0
        state, total, lent = 0, 0.0, 1.0
        for x, own in symbols:
            state, written, weight = self.arcs[state, x]
            if x == THREAT:
                lent = weight  # what negation or reporting leave of it
            if written == INSULT:
                total += weight * (own if x == INSULT else 2.0 * lent)
        return total

    def features(self, text: str) -> list[float]:
        """Bias, strongest clause, sum over clauses, their number, and their share of all."""
        weights, clauses = [], 0
        for m in _CLAUSE.findall(text.lower()):
            clauses += 1
            w = self.clause(_WORD.findall(m))
            if w:
                weights.append(w)
        n = len(weights)
        return [1.0, max(weights, default=0.0), math.log1p(sum(weights)), math.log1p(n), n / (clauses + 2.0)]


def contexts(sample: DataFrame) -> DataFrame:
    """(stem, context, label), distinct within each batch: contexts are a word's two neighbours.

    Copies of a text repeat its contexts, so contexts count evidence where rows would count
    copies.
    """

    def start():
        def make(batch):
            seen = set()
            for text, label in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
                words = _WORD.findall(text.lower())
                for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                    around = xxhash.xxh64_intdigest(f"{before} {word} {after}") >> 1
                    seen.add((word, around, label))
                    seen.update((word[:n] + "*", around, label) for n in STEMS if len(word) >= n)
            return [], [list(c) for c in zip(*seen, strict=True)] if seen else [[], [], []]

        return make

    added = {"stem": "string", "context": "long", "label": "int"}
    return map_batches(sample.select("text", "label"), [], added, start, at_once=100)


def learn_lexicon(sample: DataFrame, evidence: float = 20.0, factor: float = 6.0, most: int = 20_000) -> dict[str, float]:
    """Weights of the words and beginnings that mark toxic texts.

    A stem is taken if its rate in toxic texts is ``factor`` times that in others and the
    log-likelihood ratio of the two counts of contexts exceeds ``evidence``; the model keeps the
    ``most`` with the highest ratio. The weight is the log of the ratio of the rates.
    """
    seen = contexts(sample).groupBy("stem", "context").agg(
        F.max(F.col("label")).alias("one"), F.max(1 - F.col("label")).alias("zero")
    )
    counts = seen.groupBy("stem").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
    counts = stored(counts, "stems")
    whole = counts.where("stem not like '%*'").agg(F.sum("one"), F.sum("zero")).first()
    ones, zeros = float(whole[0] or 0) + 1.0, float(whole[1] or 0) + 1.0
    a, b = F.col("one"), F.col("zero")
    share = ones / (ones + zeros)

    def part(k, expected):
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    ratio = 2 * (part(a, (a + b) * share) + part(b, (a + b) * (1 - share)))
    weight = F.log(((a + 0.5) / ones) / ((b + 0.5) / zeros))
    marked = counts.where((a / ones > factor * b / zeros) & (ratio > evidence))
    top = marked.select("stem", weight.alias("weight"), ratio.alias("ratio")).orderBy(F.desc("ratio"), "stem")
    return {r["stem"]: r["weight"] for r in top.limit(most).collect()}


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weighted logistic regression by Newton steps; all but the first coefficient are shrunk."""
    beta = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-3
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30.0, 30.0)))
        gradient = x.T @ (weight * (y - p)) - ridge @ beta
        hessian = (x * (weight * p * (1.0 - p) + 1e-9)[:, None]).T @ x + ridge
        change = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(change, -5.0, 5.0)
        if np.abs(change).max() < 1e-8:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, usable, rows: int = 8_000) -> Model:
    """Learn from at most ``rows`` labelled rows of each class; see ``labelled_sample``.

    Without a toxic row no word is an insult, and every score is low.
    """
    sample = labelled_sample(docs, labels, "toxic", usable, rows)
    lexicon = learn_lexicon(sample)
    reader_of = lexicon  # what the tasks get

    def start():
        reader = Reader(reader_of)

        def make(batch):
            return None, [[np.array(reader.features(t)).tobytes() for t in texts(batch)]]

        return make

    made = map_batches(sample.select("text", "label"), ["label"], {"x": "binary"}, start).collect()
    width = len(Reader({}).features(""))
    x = np.array([np.frombuffer(r["x"]) for r in made]).reshape(-1, width)
    y = np.array([r["label"] for r in made], float)
    known = labels.where(usable & F.col("toxic").isin(0, 1)).agg(
        F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("ones")
    )
    n, ones = known.first()
    totals = {1.0: float(ones or 0), 0.0: float(n - (ones or 0))}
    weight = np.array([totals[k] / max(1, int((y == k).sum())) for k in y])
    beta = logistic(x, y, weight) if len(y) and 0 < y.sum() < len(y) else np.array([-4.0] + [0.0] * (width - 1))
    return Model(lexicon, beta)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` (doc_id if not given) and the score, 0 to 1, higher for more toxic texts.

    A null text is empty and has the score of a text without insults. Each row is scored by
    itself, so repeated rows score alike.
    """
    keep = keep or ["doc_id"]

    def start():
        reader = Reader(model.lexicon)

        def make(batch):
            x = np.array([reader.features(t) for t in texts(batch)]).reshape(-1, len(model.coefficients))
            z = np.clip(x @ model.coefficients, -500.0, 500.0)
            return None, [1.0 / (1.0 + np.exp(-z))]

        return make

    columns = [*keep, *([] if "text" in keep else ["text"])]
    return map_batches(docs.select(*columns), keep, {name: "double"}, start)
