"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is linear in measures of its whole text. Pairs of a good
and a bad labelled document are preferences; the weights minimise the logistic
loss of the differences of their features. Strengths become scores by one shift:
the threshold is the quantile of the labelled strengths below which the share of
bad documents lies, and gets the score ``CUT``.

The fit uses at most about ``SAMPLE`` labelled documents (a hash sample) and
``PAIRS`` pairs. Scores read the text alone.

Null and empty texts have all measures zero and get a score like any other.
Labels without a document, or null labels, are not learned from; repeated labels
count as often as they occur. With labels of one kind only, or none, every score
is 0.5. Texts are measured whole, whatever their length.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, column_map

CUT = 0.3
SAMPLE = 20_000
PAIRS = 100_000
PENALTY = 1e-3
#: Characters that prose uses; all others count as odd.
MARKS = ".,;:'\"!?()-"


SIZE = 17
_LETTERS = re.compile(r"[^\W\d_]+")


def measures(text: str | None) -> list[float]:
    """What a text looks like: shares of kinds of characters, repetition, spread."""
    if not text:
        return [0.0] * SIZE
    n = len(text)
    words = text.split()
    w = max(len(words), 1)
    lines = text.split("\n")
    letters = n - len(_LETTERS.sub("", text))
    digits, marks, blanks = (sum(map(text.count, kind)) for kind in ("0123456789", MARKS, " \t\n\r\x0b\x0c"))
    upper = sum(1 for x in words if x.isupper() and len(x) > 1)
    title = sum(1 for x in words if x.istitle())
    odd = max(0, n - letters - digits - marks - blanks)
    distinct = len(set(words))
    same_next = sum(map(str.__eq__, words, words[1:]))
    closed = sum(1 for x in words if x[-1] in ".!?")
    return [
        letters / n,
        digits / n,
        marks / n,
        odd / n,
        math.sqrt(odd / n),
        upper / w,
        title / w,
        math.sqrt(same_next / w),
        distinct / w,
        math.log1p(w),
        distinct / w * math.log1p(w),
        closed / w,
        len(set(lines)) / len(lines),
        text.count("!") / w,
        text.count("|") / w,
        (n - blanks) / w / 10,
        math.log1p(len(lines)),
    ]


@dataclass
class Ranking:
    """Weights on standardised measures, and where the threshold lies."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.strength(x) - self.threshold + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-z.clip(-500, 500)))


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, penalty: float = PENALTY, seed: int = 5) -> Ranking:
    """Newton's method on the logistic loss of feature differences."""
    mean = x.mean(0) if len(x) else np.zeros(SIZE)
    scale = np.where((s := x.std(0) if len(x) else mean) > 1e-9, s, 1.0)
    better, worse = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    flat = Ranking(mean, scale, np.zeros(x.shape[1] if x.ndim == 2 else SIZE), math.log(CUT / (1 - CUT)))
    if not len(better) or not len(worse):
        return flat
    z = ((x - mean) / scale).clip(-8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(better, pairs)] - z[rng.choice(worse, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp((d @ w).clip(-30, 30)))  # chance of the wrong order
        step = np.linalg.solve(
            (d * (p * (1 - p))[:, None]).T @ d / pairs + penalty * np.eye(len(w)), d.T @ p / pairs - penalty * w
        )
        w += step
        if np.abs(step).max() < 1e-6:
            break
    strengths = z @ w
    bad = (good == 0).mean()
    below, above = np.quantile(strengths, [max(0.0, bad - 1e-9), min(1.0, bad + 1 / len(strengths))], method="nearest")
    return Ranking(mean, scale, w, float((below + above) / 2))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE
) -> Ranking:
    """Fit on a hash sample of the labelled documents, at most about ``sample``."""
    rows = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_good"))
    some = bounded_sample(rows, "_id", sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    measured = column_map(lambda ts: [measures(t) for t in ts], T.ArrayType(T.DoubleType()))
    got = texts.join(some, "_id").select("_id", measured(F.col("_text")).alias("x"), "_good").toPandas().sort_values("_id")
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, SIZE)
    return fit_pairs(x, got["_good"].to_numpy())


def score_column(model: Ranking):
    """Score of a text between 0 and 1; ``CUT`` is the threshold."""

    def scores(texts):
        return model.score(np.array([measures(t) for t in texts]).reshape(-1, SIZE)).tolist()

    return column_map(scores, T.DoubleType())


def keep_good(docs: DataFrame, learned: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` at or above the threshold; learns from ``learned``."""
    return docs.where(score_column(train(learned, labels))(F.col("text")) >= CUT)
