"""Languages of a document as a mixture, by expectation-maximisation.

Every language has likelihoods of letter trigrams inside words, learned from the
counts of all training documents. A document's words come from a mixture of
languages; expectation-maximisation estimates the proportions. Language sets grow
from the largest proportion down, and the set with the best likelihood less a
penalty for every further language is taken.

Trigrams are hashed into ``BUCKETS`` cells, so the model is a table of languages
by cells, whatever the corpus. Texts are read whole; several are worked on at a
time, in slices of about ``SLICE`` characters.

A null text, or one without a letter, is ``und`` with score 0, and so is every
text if nothing could be learned. Documents without a language are not learned
from; repeated rows count as often as they occur. Equal likelihoods go to the
language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_map

BUCKETS = 1 << 13
SLICE = 400_000
STEPS = 12
#: Sizes of language sets tried for every text; beyond, while the likelihood rises.
TRIED = 3
#: A further language must gain so many times log(words).
PENALTY = 3.0
UNKNOWN = "und"

GUESS = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("langs", T.ArrayType(T.StringType())),
        T.StructField("shares", T.ArrayType(T.DoubleType())),
    ]
)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    out = np.zeros(0x110000, bool)
    out[:0x30000] = [chr(c).isalpha() for c in range(0x30000)]
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the trigrams around every letter, in order; the first trigram of
    every word; and the text of every word. Words end at all but letters."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, np.uint32(0))
    h = codes[:-2] * np.uint32(2654435761) ^ codes[1:-1] * np.uint32(2246822519) ^ codes[2:] * np.uint32(3266489917)
    h ^= h >> np.uint32(15)
    at = np.flatnonzero(codes[1:-1])
    cells = ((h[at] * np.uint32(668265263)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)
    first = np.flatnonzero(codes[at] == 0)
    ends = np.cumsum([len(t) + 1 for t in lower])
    return cells, first, np.searchsorted(ends, at[first], "right")


def slices(texts: list[str | None], size: int = SLICE) -> Iterator[tuple[list[int], list[str]]]:
    """Texts (by their place) in lists of about ``size`` characters."""
    places, some, n = [], [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        if some and n + len(t) > size:
            yield places, some
            places, some, n = [], [], 0
        places.append(i)
        some.append(t)
        n += len(t)
    if some:
        yield places, some


@dataclass
class Languages:
    names: list[str]
    logs: np.ndarray  # language x cell, float32

    def _word_logs(self, cells: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-likelihood of every word in every language."""
        out = np.empty((len(first), len(self.names)), np.float32)
        step = max(1, (4 * SLICE) // max(1, len(self.names)))
        ends = np.append(first[1:], len(cells))
        a = 0
        while a < len(first):
            b = max(a + 1, int(np.searchsorted(ends, first[a] + step, "right")))
            part = cells[first[a] : ends[b - 1]]
            for k in range(len(self.names)):
                out[a:b, k] = np.add.reduceat(self.logs[k][part], first[a:b] - first[a])
            a = b
        return out

    def mixtures(self, texts: list[str]) -> list[tuple | None]:
        """(language, score, set, shares) of every text; None without a letter."""
        cells, first, owner = grams(texts)
        out: list[tuple | None] = [None] * len(texts)
        if not len(first) or not self.names:
            return out
        docs, starts, counts = np.unique(owner, return_index=True, return_counts=True)
        logs = self._word_logs(cells, first).astype(np.float64)
        top = logs.max(1, keepdims=True)
        like = np.exp(logs - top)
        which = np.repeat(np.arange(len(docs)), counts)
        base = np.add.reduceat(top[:, 0], starts)

        def fit(allowed, some):
            """Shares and likelihood of the documents ``some``."""
            row = np.isin(which, some) if len(some) < len(docs) else slice(None)
            own, n = like[row], counts[some]
            at = np.repeat(np.arange(len(some)), n)
            begin = np.cumsum(n) - n
            share = allowed / allowed.sum(1, keepdims=True)
            for _ in range(STEPS):
                r = own * share[at]
                r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
                share = np.add.reduceat(r, begin, axis=0) / n[:, None]
            value = np.add.reduceat(np.log(np.maximum((own * share[at]).sum(1), 1e-300)), begin) + base[some]
            return share, value

        every = np.arange(len(docs))
        share, _ = fit(np.ones((len(docs), len(self.names))), every)
        order = np.argsort(-share, axis=1, kind="stable")
        rank = np.argsort(order, axis=1, kind="stable")
        best, best_value, size = share, np.full(len(docs), -np.inf), np.zeros(len(docs), int)
        for k in range(1, len(self.names) + 1):
            # Sets of three are tried for all; larger ones while the last one was better.
            some = every if k <= TRIED else np.flatnonzero(size == k - 1)
            if not len(some):
                break
            got, value = fit((rank[some] < k).astype(float), some)
            value = value - PENALTY * (k - 1) * np.log(counts[some] + 1)
            more = value > best_value[some]
            won = some[more]
            best_value[won], best[won], size[won] = value[more], got[more], k
        for d, p in zip(docs, best):
            have = np.argsort(-p, kind="stable")
            have = have[p[have] > 1e-6]
            out[d] = (self.names[have[0]], float(min(1.0, p[have[0]])), [self.names[j] for j in have], [float(p[j]) for j in have])
        return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Trigram likelihoods from all rows of ``docs`` with a language."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for places, some in slices(b.column(0).to_pylist()):
                by: dict[str, list[str]] = {}
                for i, t in zip(places, some):
                    by.setdefault(langs[i], []).append(t)
                for lang, ts in by.items():
                    n = np.bincount(grams(ts)[0], minlength=BUCKETS)
                    sums[lang] = sums[lang] + n if lang in sums else n
        for lang, n in sums.items():
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(cell), "cell": cell.astype(np.int32), "n": n[cell]})

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, lang_col)
    got = rows.mapInArrow(counted, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(got["lang"].unique())
    n = np.zeros((len(names), BUCKETS))
    n[got["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(int), got["cell"].to_numpy(int)] = got["n"].to_numpy(float)
    logs = np.log((n + 0.5) / (n.sum(1, keepdims=True) + 0.5 * BUCKETS))
    return Languages(names, logs.astype(np.float32))


def guess_column(model: Languages):
    """Struct (lang, score, langs, shares) of a text."""

    def guesses(texts):
        out = [(UNKNOWN, 0.0, [], [])] * len(texts)
        for places, some in slices(texts):
            for i, got in zip(places, model.mixtures(some)):
                if got:
                    out[i] = got
        return [dict(zip(("lang", "score", "langs", "shares"), r)) for r in out]

    return column_map(guesses, GUESS)
