"""Phrases that stand together more often than their parts, by prefix-free parsing.

Texts are cut into pieces at punctuation and pieces into words. A window of two words of
a piece whose hash is a multiple of ``modulus`` ends a chunk, and the next chunk begins
with the words of that window; breaks between pieces stay in the chunk. So what is cut
depends on content alone, and a passage that
many documents share gives the same chunks in all of them. The distinct chunks of a
language are its dictionary and their counts the frequencies of the parse. Phrases
are counted inside distinct chunks only, weighted by frequency. A phrase belongs
to the chunk that holds its last word past the overlap, so each occurrence counts once.

Lengths are counted one after the other, longer phrases only where the parts of one
word less may be frequent, which a bitmap of bounded size tells: what it lets through
is counted exactly, so it spares work and decides nothing. Counts of a batch are added
up before rows leave a task, and again before they are shuffled. A common phrase is one row per task; the parts of candidates are looked up
under salts; a language is ranked in salted shares first.

Words are compared as UTF-8 bytes after A-Z are lower-cased. Null and empty texts have
no words; a null language is ``und``. Repeated rows count as often as they occur. A text
without a window that ends a chunk is one chunk, however long. Ties in score and count go by the phrase's bytes. Without words the result is
empty. Other columns are ignored. Counts must stay below 10**15 (the score is computed
in decimals of 38 digits; beyond, it raises).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SALTS, salted_lookup, stored, text_slices, written

WORDS = 3
LEAST = 10
DROP_PERCENT = 50
TOP = 2_000
SCALE = 1_000_000
#: One in so many windows ends a chunk.
MODULUS = 32
SEED = 42
ODD = np.uint64(0x9E3779B97F4A7C15)  # any odd number
#: Bits of the sketch of frequent phrases: 16 MB are sent to a task at most.
MOST_BITS = 1 << 27
#: Bits of one row of it (fixed by Spark's bitmap functions).
BLOCK = 32_768
#: Bytes of text, or of chunks, counted at once (a single longer one is taken whole).
BATCH = 4 << 20

BREAK = ord(".")  # stands for all separators of pieces, so it is never part of a word
CLOSE = b"!"  # another separator: it closes a text
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes.maketrans(
    SEPARATORS + bytes(range(65, 91)) + b"\t", bytes([BREAK]) * len(SEPARATORS) + bytes(range(97, 123)) + b" "
)


class Words:
    """The words of a buffer in which a blank follows each of them."""

    def __init__(self, data: bytes):
        self.data = data
        self.ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        offsets = np.concatenate([[0], self.ends]).astype(np.int64)
        array = pa.Array.from_buffers(pa.large_binary(), len(self.ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = array.dictionary_encode()
        self.code = coded.indices.to_numpy().astype(np.int64)
        self.distinct = coded.dictionary.to_pylist()

    def __len__(self) -> int:
        return len(self.ends)

    def joined(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """Words ``first`` to ``last`` as one text each."""
        data = self.data
        return [data[a:b] for a, b in zip(self.starts[first].tolist(), (self.ends[last] - 1).tolist())]

    def gathered(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """As ``joined()``, as an Arrow column."""
        start, size = self.starts[first], self.ends[last] - 1 - self.starts[first]
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
        text = np.frombuffer(self.data, np.uint8)[at]
        return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(text)])


def normal(text: bytes) -> bytes:
    """Lower-cased words with single blanks; a lone break stands between pieces."""
    text = b" ".join(text.translate(TABLE).replace(b".", b" . ").split())
    while b". ." in text:
        text = text.replace(b". .", b".")
    return text.strip(b" .")


def chunk_places(words: Words, modulus: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word, whether it continues a text, text) of every chunk of texts
    that are each closed by ``CLOSE``."""
    over = np.array([w == CLOSE + b" " for w in words.distinct], bool)[words.code]
    stop = over | np.array([w == b". " for w in words.distinct], bool)[words.code]
    h = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words.distinct], np.uint64)[words.code]
    mixed = h[:-1] * ODD + h[1:]
    mixed ^= mixed >> np.uint64(29)
    ends = np.zeros(len(words), bool)
    ends[1:] = (mixed % np.uint64(modulus) == 0) & ~stop[:-1]
    ends[:-1] |= over[1:]
    ends &= ~stop
    last = np.flatnonzero(ends)
    text = np.cumsum(over)[last]
    first = np.concatenate([[0], np.flatnonzero(over) + 1])[text]
    on = np.zeros(len(last), bool)
    on[1:] = text[1:] == text[:-1]
    first[1:][on[1:]] = last[:-1][on[1:]] - 1
    return first, last, on, text


def parse(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", modulus: int = MODULUS, batch: int = BATCH) -> DataFrame:
    """The dictionary (lang, chunk, n): distinct chunks and how often they occur. A
    chunk that continues a text begins with a break and the two shared words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("text").cast(pa.binary()).fill_null(b"")
            for i, j in text_slices(column, batch):
                texts = [normal(t) for t in column.slice(i, j - i).to_pylist()]
                words = Words(b"".join([t + b" " + CLOSE + b" " if t else CLOSE + b" " for t in texts]))
                first, last, on, doc = chunk_places(words, modulus)
                if not len(last):
                    continue
                chunk = [b". " + c if k else c for c, k in zip(words.joined(first, last), on.tolist())]
                lang = b.column("lang").slice(i, j - i).dictionary_encode()
                code = lang.indices.take(pa.array(doc))
                t = pa.table({"c": code, "chunk": pa.array(chunk, pa.binary())}).group_by(["c", "chunk"]).aggregate([([], "count_all")])
                for r in t.to_batches(50_000):
                    yield pa.RecordBatch.from_arrays(
                        [lang.dictionary.take(r.column("c")), r.column("chunk").cast(pa.string()), r.column("count_all")], ["lang", "chunk", "n"]
                    )

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "lang string, chunk string, n long").groupBy("lang", "chunk").agg(F.sum("n").alias("n"))


def _weighted(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of one occurrence, sum of weights, number of each key) of the distinct keys."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    starts = np.flatnonzero(new)
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[starts], np.add.reduceat(weight[order], starts), number


def _hashes(words: Words, langs: np.ndarray, n: int) -> np.ndarray:
    """A number for the phrase of ``n`` words that ends at each word of a language."""
    h = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words.distinct], np.uint64)[words.code]
    out = langs.copy()
    for back in range(n - 1, -1, -1):
        out[n - 1 :] = (out[n - 1 :] ^ h[n - 1 - back : len(h) - back]) * ODD
        out ^= out >> np.uint64(31)
    return out


def _hashed_langs(langs: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x, SEED) for x in langs.to_pylist()], np.uint64)


def sketch(frequent: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bitmap of the phrases of ``n`` words in ``frequent``, and its size in bits.

    It has 16 bits for each phrase but no more than ``MOST_BITS``. A phrase that
    isn't in it is not frequent; one that is in it gets counted.
    """
    bits = min(max(1 << 16, 1 << (16 * frequent.count()).bit_length()), MOST_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                words = Words(b" ".join(b.column("phrase").cast(pa.binary()).to_pylist()) + b" ")
                h = _hashes(words, np.repeat(_hashed_langs(b.column("lang")), n), n)[n - 1 :: n]
                yield pa.RecordBatch.from_pydict({"at": pa.array((h & np.uint64(bits - 1)).view(np.int64) + 1)})  # counted from 1

    set_ = frequent.select("lang", "phrase").mapInArrow(places, "at long")
    blocks = set_.groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros((max(1, bits // BLOCK), BLOCK // 8), np.uint8)
    for r in blocks.toLocalIterator():
        out[r["k"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel(), bits


def counts_of_length(dictionary: DataFrame, n: int, shorter: tuple | None = None, batch: int = BATCH) -> DataFrame:
    """(lang, phrase, f) of the phrases of ``n`` words. With ``shorter``, a broadcast
    ``sketch()`` of the phrases of one word less, only of those whose two such parts
    may be in it. For one word, the number of all words of a language comes as well,
    under the empty phrase."""

    def counted(lang: pa.Array, chunks: list[bytes], weight: np.ndarray) -> Iterator[pa.RecordBatch]:
        words = Words(b" ".join(chunks) + b" ")
        size = np.fromiter((c.count(b" ") + 1 for c in chunks), np.int64, len(chunks))
        on = np.fromiter((c.startswith(b". ") for c in chunks), bool, len(chunks))
        chunk = np.repeat(np.arange(len(chunks)), size)
        # Places count from the last break, or the begin of the chunk; a phrase of a
        # continued chunk ends past the mark and the two shared words.
        here = np.arange(len(words))
        stop = np.array([w == b". " for w in words.distinct], bool)[words.code]
        begin = (np.cumsum(size) - size)[chunk]
        place = here - np.maximum(np.maximum.accumulate(np.where(stop, here, -1)), begin - 1) - 1
        at = np.flatnonzero((place >= n - 1) & (here - begin >= np.where(on, 3, 0)[chunk]))
        coded = lang.dictionary_encode()
        langs = coded.indices.to_numpy().astype(np.int64)[chunk]
        w = weight[chunk]
        if n == 1:
            total = np.zeros(len(coded.dictionary), np.int64)
            np.add.at(total, langs[at], w[at])
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array([""] * len(total)), pa.array(total)], ["lang", "phrase", "f"])
        if shorter:
            bitmap, bits = shorter[0].value, np.uint64(shorter[1] - 1)
            h = _hashes(words, _hashed_langs(coded.dictionary)[langs], n - 1) & bits
            may = (bitmap[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 > 0
            at = at[may[at] & may[at - 1]]
        if not len(at):
            return
        code = langs[at]
        for back in range(n - 1, -1, -1):
            one, f, code = _weighted(code * len(words.distinct) + words.code[at - back], w[at])
        for a in range(0, len(one), 50_000):
            i = at[one[a : a + 50_000]]
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(langs[i])), words.gathered(i - n + 1, i).cast(pa.string()), pa.array(f[a : a + 50_000])],
                ["lang", "phrase", "f"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.column("chunk").nbytes
            if size >= batch:
                yield from whole(held)
                held, size = [], 0
        if size:
            yield from whole(held)

    def whole(held):
        t = pa.Table.from_batches(held).combine_chunks()
        yield from counted(t.column("lang").combine_chunks(), t.column("chunk").cast(pa.large_binary()).to_pylist(), t.column("n").to_numpy())

    counted_rows = dictionary.select("lang", "chunk", "n").mapInArrow(run, "lang string, phrase string, f long")
    return counted_rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def phrase_counts(dictionary: DataFrame, most: int = WORDS, least: int = LEAST) -> DataFrame:
    """(lang, phrase, f) of the phrases of 1 to ``most`` words with f >= ``least``,
    and the number of all words under the empty phrase.

    A phrase is as frequent as ``least`` only if its parts are: each length is
    counted where the parts one word shorter may be frequent.
    """
    out, shorter = None, None
    for n in range(1, most + 1):
        found = stored(counts_of_length(dictionary, n, shorter).where((F.col("f") >= least) | (F.col("phrase") == "")))
        out = found if out is None else out.unionByName(found)
        if n < most:
            bitmap, bits = sketch(found.where("phrase != ''"), n)
            shorter = (dictionary.sparkSession.sparkContext.broadcast(bitmap), bits)
    return out


def _words(phrase: str | Column) -> Column:
    return F.split(phrase, " ")


def _sub(words: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(words, first, count), " ")


def scored(frequent: DataFrame, most: int = WORDS) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words or more among
    ``frequent(lang, phrase, f)``, by their lowest-scoring cut; all parts of a
    phrase are as frequent as itself, so they are in ``frequent`` too."""
    w = F.col("w")
    phrases = frequent.select("lang", "phrase", F.col("f").alias("a"), _words("phrase").alias("w")).where(F.size("w") > 1)
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    sides = F.array(
        F.struct(F.lit(True).alias("head"), _sub(w, F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(False).alias("head"), _sub(w, F.col("k") + 1, F.size(w) - F.col("k")).alias("part")),
    )
    asked = stored(cuts.select("lang", "phrase", "a", "k", F.inline(sides)))
    found = salted_lookup(asked, ["lang", "part"], frequent.select("lang", F.col("phrase").alias("part"), "f"))
    cut = found.groupBy("lang", "phrase", "k").agg(
        F.max("a").alias("a"), F.max(F.when(F.col("head"), F.col("f"))).alias("l"), F.max(F.when(~F.col("head"), F.col("f"))).alias("r")
    )
    exact = F.expr(f"CAST(a AS DECIMAL(16, 0)) * CAST(a AS DECIMAL(15, 0)) * {SCALE}BD div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    best = cut.withColumn("score", exact).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def covered(frequent: DataFrame, percent: int = DROP_PERCENT) -> DataFrame:
    """(lang, phrase, longest): phrases inside longer ones, with the highest count of those."""
    w = F.col("w")
    longer = frequent.select("lang", "f", _words("phrase").alias("w")).where(F.size("w") > 2)
    sizes = longer.withColumn("m", F.explode(F.sequence(F.lit(2), F.size("w") - 1)))
    places = sizes.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)))
    parts = places.select("lang", "f", _sub(w, F.col("i"), F.col("m")).alias("phrase"))
    return parts.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    most: int = WORDS,
    least: int = LEAST,
    percent: int = DROP_PERCENT,
    top: int = TOP,
    modulus: int = MODULUS,
) -> DataFrame:
    """Per language the ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Phrases of 2 to ``most`` words that occur ``least`` times; those inside a longer
    one that has ``percent`` of their count or more are dropped.
    """
    if not 2 <= most <= 3:
        raise ValueError("chunks share two words, so phrases have two or three")
    kept = phrase_counts(written(parse(docs, text_col, lang_col, modulus)), most, least)
    frequent = kept.where((F.col("phrase") != "") & (F.col("f") >= least))
    total = kept.where("phrase = ''").select("lang", F.col("f").alias("n"))
    inside = covered(frequent)
    alive = scored(frequent, most).join(inside, ["lang", "phrase"], "left")
    alive = alive.where(F.coalesce(100 * F.col("longest") < percent * F.col("a"), F.lit(True))).drop("longest")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = alive.withColumn("_s", share).withColumn("rank", F.row_number().over(W.partitionBy("lang", "_s").orderBy(*order)))
    best = first.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
    # One row per language, no hot key beyond ``top`` rows each.
    return best.where(F.col("rank") <= top).join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )


# The same table as SQL: all positions of all pieces, integers of 128 bits.
ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
q AS (SELECT lang, row_number() OVER () AS id, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
w AS (SELECT lang, id, unnest(w) AS x, unnest(range(len(w))) AS i FROM q),
v AS (SELECT lang, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
g AS (SELECT lang, 1 AS words, x AS phrase FROM v UNION ALL SELECT lang, 2, x || ' ' || y FROM v WHERE y IS NOT NULL
      UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z FROM v WHERE z IS NOT NULL),
f AS (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 10),
k AS (SELECT c.lang, c.phrase, c.words, a, k.k, x.f AS l, y.f AS r, a::HUGEINT * a * 1000000 // (x.f::HUGEINT * y.f) AS score
      FROM c JOIN (VALUES (1), (2)) k(k) ON k.k < c.words
      JOIN f x ON x.lang = c.lang AND x.words = k.k AND x.phrase = array_to_string(c.w[:k.k], ' ')
      JOIN f y ON y.lang = c.lang AND y.words = c.words - k.k AND y.phrase = array_to_string(c.w[k.k + 1:], ' ')),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE words = 3),
gone AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN inside i USING (lang, phrase) WHERE words = 2 AND 100 * i.a >= 50 * b.a),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM b ANTI JOIN gone USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN t USING (lang) WHERE rank <= 2000
"""
