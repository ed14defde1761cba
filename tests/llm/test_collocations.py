import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealis.llm import collocations

SCHEMA = "doc_id long, text string, lang string"


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split("[\x20\x09]+", p) if w] for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def brute(rows, least, percent, top, most=3):
    f, n = {}, Counter()
    for _, text, lang in rows:
        for w in pieces(text):
            n[lang or "und"] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang or "und", Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        good = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in good.items():
            longer = [b for q, b in good.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= percent * a for b in longer):
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), c[p[:k]], c[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, r, n[lang], s) for i, (s, a, p, left, r) in enumerate(found[:top])]
    return sorted(out)


def run(spark, rows, **kw):
    found = collocations.collocations(spark.createDataFrame(rows, SCHEMA), **kw)
    return sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts():
    rng = np.random.default_rng(5)
    words = ["the", "new", "york", "Ünder", "a-b", "x", " y", "wal\x1ck", "(of)", "B"]
    rows = []
    for i in range(300):
        w = [words[j] for j in rng.integers(0, len(words), rng.integers(0, 30))]
        sep = [" ", "  ", "\t", ". ", ",", "\n", " ; ", "\r\n"]
        text = "".join(x + sep[int(rng.choice(8, p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03]))] for x in w)
        rows.append((i, text, ["en", "de", None][i % 3]))
    rows += [(1, "the new york times", "en")] * 40 + [(2, None, "en"), (3, "", None), (4, "...", "fr"), (5, "one", "fr"), (6, "x " * 30_000, "en")]
    return rows


@pytest.mark.parametrize("modulus", [1, 3, 6, 10**9])
def test_phrases_match_all_positions(spark, modulus):
    rows = texts()
    assert run(spark, rows, least=3, modulus=modulus, top=40) == brute(rows, 3, 50, 40)


@pytest.mark.parametrize("percent", [1, 90, 1000])
def test_drops_of_covered_phrases(spark, percent):
    rows = texts()[:150]
    assert run(spark, rows, least=2, percent=percent) == brute(rows, 2, percent, 2000)
    assert run(spark, rows, least=2, percent=percent, most=2) == brute(rows, 2, percent, 2000, most=2)


def test_batches_of_any_size_give_the_same_counts(spark):
    docs = spark.createDataFrame(texts(), SCHEMA)
    small = collocations.counts_of_length(collocations.parse(docs, batch=50), 3, batch=50)
    large = collocations.counts_of_length(collocations.parse(docs), 3)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_copies_share_their_chunks(spark):
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(3000))
    docs = spark.createDataFrame([(i, f"{'pad ' * i} {long}", "en") for i in range(20)], SCHEMA)
    assert collocations.parse(docs).where("n >= 20").count() > 40


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    rows = spark.createDataFrame(texts()[:60], SCHEMA).withColumns({c: F.lit("x") for c in ("chunk", "n", "phrase", "f", "w", "_salt")})
    assert collocations.collocations(rows, least=2).count() == len(brute(texts()[:60], 2, 50, 2000))


def test_products_beyond_64_bits(spark):
    a = 3_000_000_000
    rows = [("en", "x", a + 1), ("en", "y", a + 2), ("en", "x y", a)]
    [r] = collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, f long")).collect()
    assert r["score"] == 1_000_000 * a * a // ((a + 1) * (a + 2))
