"""Quality of texts by regularised quadratic discriminant analysis.

Each text gives a vector of statistics, transformed to be roughly normal. Each class has a mean
and a covariance, shrunk towards the pooled covariance and its diagonal. The score is the
posterior probability from the difference of the two log densities, whose Mahalanobis distances
use Cholesky factors computed once.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.llm.common import map_batches, texts
from shopflow.llm.labelled import labelled_sample

STATISTICS = (
    "words", "word_length", "uppercase", "digits", "marks", "exclamations", "symbols", "bars",
    "repeated_next", "novelty", "repeated_lines",
)

_MARKS = re.compile(r"""[.,;:'"()?-]+""")
_SYMBOLS = re.compile(r"[#$%&*+<=>@\\^_`{}~/\[\]]+")
_UPPER = re.compile(r"[^\W\d_a-zß-öø-ÿ]+")
_DIGITS = re.compile(r"\d+")


def _share(part: int, whole: int, usual: float, weight: float) -> float:
    """A share as an angle, whose spread hardly depends on its size.

    ``weight`` units with the ``usual`` share are added, so that a short text isn't odd for
    what two or three of its characters are.
    """
    return math.asin(math.sqrt((part + usual * weight) / (whole + weight)))


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text; an empty text gives those of no words."""
    words = text.split()
    n, chars = len(words), len(text)
    distinct = len(set(words))
    twice = sum(map(str.__eq__, words, words[1:]))
    lines = text.split("\n")
    letters = sum(map(len, words))

    def found(pattern: re.Pattern) -> int:
        return sum(map(len, pattern.findall(text)))

    return [
        math.log1p(n),
        math.log((letters + 20.0) / (n + 4.0)),
        _share(found(_UPPER), chars, 0.03, 80),
        _share(found(_DIGITS), chars, 0.002, 80),
        _share(found(_MARKS), chars, 0.03, 80),
        _share(text.count("!"), chars, 0.002, 80),
        _share(found(_SYMBOLS), chars, 0.002, 80),
        _share(text.count("|"), n, 0.01, 15),
        _share(twice, n, 0.01, 15),
        math.log((distinct + 1.0) / (n + 1.0) ** 0.8),
        _share(len(lines) - len(set(lines)), len(lines), 0.02, 4),
    ]


@dataclass
class Discriminant:
    """Log priors, means, inverse Cholesky factors and log determinants of both classes."""

    log_prior: np.ndarray
    mean: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Posterior probability of class 1 for each row of ``x``."""
        density = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.whiten[k].T
            density.append(self.log_prior[k] - 0.5 * (self.log_det[k] + (z * z).sum(axis=1)))
        gap = np.clip(density[1] - density[0], -500.0, 500.0)
        return 1.0 / (1.0 + np.exp(-gap))


def fit(
    count: np.ndarray, total: np.ndarray, square: np.ndarray, pooled_share: float = 0.2,
    diagonal_share: float = 0.1, ridge: float = 1e-3,
) -> Discriminant:
    """A discriminant from counts, sums and sums of outer products of the two classes.

    A class with fewer rows than statistics leans more on the pooled covariance. A class
    without rows has the other's mean and a prior of half a row.
    """
    width = total.shape[1]
    mean = total / np.maximum(count, 1.0)[:, None]
    if count.min() == 0:
        mean[count == 0] = total.sum(axis=0) / max(count.sum(), 1.0)
    scatter = square - np.einsum("k,ki,kj->kij", count, mean, mean)
    pooled = scatter.sum(axis=0) / max(count.sum() - 2.0, 1.0) + ridge * np.eye(width)
    whiten, log_det = [], []
    for k in (0, 1):
        lean = max(pooled_share, width / (width + count[k]))
        own = scatter[k] / max(count[k] - 1.0, 1.0)
        cov = (1.0 - lean) * own + lean * pooled
        cov = (1.0 - diagonal_share) * cov + diagonal_share * np.diag(np.diag(cov))
        factor = np.linalg.cholesky(cov + ridge * np.eye(width))
        whiten.append(np.linalg.inv(factor))
        log_det.append(2.0 * np.log(np.diag(factor)).sum())
    prior = np.log((count + 0.5) / (count.sum() + 1.0))
    return Discriminant(prior, mean, np.array(whiten), np.array(log_det))


def moments(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of outer products of the statistics, by label; from each task."""
    width = len(STATISTICS)

    def start():
        def make(batch):
            label = np.array(batch.column(1).to_pylist())
            x = np.array([statistics(t) for t in texts(batch)]).reshape(-1, width)
            out = []
            for k in (0, 1):
                own = x[label == k]
                parts = [[float(len(own))], own.sum(axis=0), (own.T @ own).ravel()]
                out.append(np.concatenate(parts).tobytes())
            return [], [[0, 1], out]

        return make

    rows = map_batches(sample.select("text", "label"), [], {"label": "int", "parts": "binary"}, start)
    sums = np.zeros((2, 1 + width + width * width))
    for label, parts in rows.collect():  # two short rows for each batch of the bounded sample
        sums[label] += np.frombuffer(parts)
    return sums[:, 0], sums[:, 1 : 1 + width], sums[:, 1 + width :].reshape(2, width, width)


def learn(docs: DataFrame, labels: DataFrame, usable, rows: int = 20_000) -> Discriminant:
    """Fit on at most ``rows`` labelled rows of each class; see ``labelled_sample``."""
    sample = labelled_sample(docs, labels, "quality", usable, rows)
    count, total, square = moments(sample)
    model = fit(count, total, square)
    # The sample may hold the classes in other shares than the labels do.
    known = labels.where(usable & F.col("quality").isin(0, 1)).agg(
        F.count("*").alias("n"), F.sum(F.col("quality").cast("long")).alias("ones")
    )
    n, ones = known.first()
    share = np.array([n - (ones or 0), ones or 0], float)
    model.log_prior = np.log((share + 0.5) / (n + 1.0))
    return model


def score(docs: DataFrame, model: Discriminant, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` (doc_id if not given) and the score, 0 to 1, higher for better quality.

    A null text is empty. Each row is scored by itself, so repeated rows score alike.
    """
    keep = keep or ["doc_id"]

    def start():
        def make(batch):
            x = np.array([statistics(t) for t in texts(batch)]).reshape(-1, len(STATISTICS))
            return None, [model.scores(x)]

        return make

    columns = [*keep, *([] if "text" in keep else ["text"])]
    return map_batches(docs.select(*columns), keep, {name: "double"}, start)
