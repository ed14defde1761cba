"""Toxicity by a classifier chain over categories.

Categories are predicted one after the other: each linear model sees the text's
features and the probabilities of all earlier categories. While training, those
probabilities come from models that have not seen the document (out-of-fold), as
they will for new documents. Features are words and beginnings of words, so
inflected forms of a stem count together.

Features and models are learned from at most about ``SAMPLE`` labelled documents
(a hash sample); candidates are ranked by how much they tell the last category
apart (likelihood ratio), and at most ``FEATURES`` are kept.

Null and empty texts have no features and so the base chance. Labels that are
null, or without a document, are not learned from; repeated ones count as often
as they occur. A category without examples of both kinds has its base rate as
probability for every document. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, column_map, stored

SAMPLE = 12_000
FEATURES = 256
FOLDS = 5
PENALTY = 1e-3
CUT = 0.5
BEGINNINGS = (3, 4, 5, 6, 7, 8, 9)
#: A feature must stand in so many sampled documents.
LEAST = 5
WORD = re.compile(r"[^\W\d_]+")
# Seeds of the two categories that the label does not tell apart (fixed values).
INSULT = ("idiot", "moron", "clown", "scum", "loser")
CONTEMPT = ("worthless", "pathetic", "disgusting", "stupid", "trash")


def features(text: str | None) -> list[str]:
    """Distinct words, beginnings of longer words (marked ``+``), and what stands
    in two or more distinct words (marked ``++``), of a whole text."""
    out: Counter = Counter()
    for w in set(WORD.findall(text.lower())) if text else ():
        out[w] += 1
        out.update([w[:k] + "+" for k in BEGINNINGS if len(w) > k])
    return [*out, *[f + "+" for f, n in out.items() if n > 1]]


@dataclass
class Chain:
    """Weights of each category on features, earlier probabilities and a constant."""

    names: list[str]
    index: dict[str, int]
    weights: list[np.ndarray]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.names)))
        for k, w in enumerate(self.weights):
            out[:, k] = _chance(np.hstack([x, out[:, :k], np.ones((len(x), 1))]), w)
        return out

    def rows(self, texts: list[str | None]) -> np.ndarray:
        """Feature matrix of whole texts."""
        whole = {f: j for f, j in self.index.items() if f[-1] != "+"}
        stems = {f.rstrip("+") for f in self.index if f[-1] == "+"}
        begins = {k: {f for f in stems if len(f) == k} for k in sorted({len(f) for f in stems})}
        x = np.zeros((len(texts), len(self.index)))
        for i, t in enumerate(texts):
            seen: Counter = Counter()
            for w in set(WORD.findall(t.lower())) if t else ():
                if w in whole:
                    x[i, whole[w]] = 1
                for k, known in begins.items():
                    if w[:k] in known and len(w) > k:
                        seen[w[:k] + "+"] += 1
            for f, n in seen.items():
                for name in (f, f + "+")[: min(n, 2)]:
                    if (j := self.index.get(name)) is not None:
                        x[i, j] = 1
        return x


def _chance(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Penalised logistic regression by Newton steps; the last column is a constant."""
    n, p = x.shape
    w = np.zeros(p)
    rate = min(max(y.mean() if n else 0.0, 1e-6), 1 - 1e-6)
    w[-1] = np.log(rate / (1 - rate))
    if not n or y.min() == y.max():
        return w
    ridge = np.full(p, penalty)
    ridge[-1] = 1e-9
    for _ in range(12):
        q = _chance(x, w)
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x / n + np.diag(ridge + 1e-9), x.T @ (y - q) / n - ridge * w)
        w += step
        if np.abs(step).max() < 1e-3:
            break
    return w


def fit_chain(x: np.ndarray, y: np.ndarray, names: list[str], index: dict[str, int], folds: int = FOLDS, seed: int = 3) -> Chain:
    """``y`` has a column per category, in the order of the chain."""
    n = len(x)
    fold = np.random.default_rng(seed).permutation(n) % folds
    earlier = np.zeros((n, 0))
    weights = []
    for k in range(len(names)):
        z = np.hstack([x, earlier, np.ones((n, 1))])
        weights.append(_logistic(z, y[:, k], PENALTY))
        unseen = np.zeros(n)
        for f in range(folds):
            out = fold == f
            unseen[out] = _chance(z[out], _logistic(z[~out], y[~out, k], PENALTY))
        earlier = np.hstack([earlier, unseen[:, None]])
    return Chain(names, index, weights)


def categories(toxic: str, text: str) -> dict:
    """Columns of the chain: a toxic document with a seed word has its category."""

    def has(words):
        return (F.col(toxic) == 1) & F.lower(text).rlike(rf"\b({'|'.join(words)})\b")

    return {"insult": has(INSULT), "contempt": has(CONTEMPT), "toxic": F.col(toxic) == 1}


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
    most: int = FEATURES,
) -> Chain:
    """Learn the chain from labelled documents."""
    rows = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_toxic"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    named = categories("_toxic", "_text")
    some = stored(
        texts.join(bounded_sample(rows, "_id", sample), "_id").select(
            "_id", "_text", *[F.coalesce(c, F.lit(False)).cast("int").alias(f"y{i}") for i, c in enumerate(named.values())]
        )
    )
    last = f"y{len(named) - 1}"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[y].update(features(t))
        names = list(seen[0].keys() | seen[1].keys())
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"f": part, "a": [seen[1][x] for x in part], "b": [seen[0][x] for x in part]})

    total = some.agg(F.sum(last), F.count(F.lit(1))).first()
    pos, neg = float(total[0] or 0), float((total[1] or 0) - (total[0] or 0))
    a, b = F.col("a"), F.col("b")
    rest_a, rest_b = F.lit(pos) - a, F.lit(neg) - b
    both = F.lit(pos + neg)

    def part(k, row, col):
        return F.when(k > 0, k * F.log(k * both / (row * col))).otherwise(0.0)

    gain = (
        part(a, a + b, F.lit(pos)) + part(b, a + b, F.lit(neg)) + part(rest_a, rest_a + rest_b, F.lit(pos)) + part(rest_b, rest_a + rest_b, F.lit(neg))
    )
    found = (
        some.select("_text", last)
        .mapInArrow(counted, "f string, a long, b long")
        .groupBy("f")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .where(F.col("a") + F.col("b") >= LEAST)
        .orderBy(gain.desc(), "f")
        .limit(most)
        .select("f")
    )
    index = {r["f"]: i for i, r in enumerate(found.collect())} if pos and neg else {}
    seen_by = Chain(list(named), index, [])
    marks = column_map(lambda ts: [np.flatnonzero(r).tolist() for r in seen_by.rows(ts)], T.ArrayType(T.IntegerType()))
    got = some.select("_id", marks(F.col("_text")).alias("x"), *[f"y{i}" for i in range(len(named))]).toPandas().sort_values("_id")
    x = np.zeros((len(got), len(index)))
    for i, js in enumerate(got["x"]):
        x[i, np.asarray(js, dtype=int)] = 1
    y = got[[f"y{i}" for i in range(len(named))]].to_numpy(float).reshape(-1, len(named))
    return fit_chain(x, y, list(named), index)


def chances_column(model: Chain):
    """Probability of every category, as an array in the order of the chain."""

    def chances(texts):
        out = []
        for i in range(0, len(texts), 1024):
            out += model.predict(model.rows(texts[i : i + 1024])).tolist()
        return out

    return column_map(chances, T.ArrayType(T.DoubleType()))


def keep_clean(docs: DataFrame, learned: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the last category of the chain does not reject."""
    return docs.where(F.element_at(chances_column(train(learned, labels))(F.col("text")), -1) < CUT)
