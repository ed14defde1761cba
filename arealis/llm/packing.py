"""Best-fit packing of tokenized documents from a length histogram.

Documents are tokenized and closed by an end token; those longer than a sequence
are cut into full pieces behind one shorter first piece. Only the counts of piece
lengths are planned: from the longest down, pieces go to the open sequences with
the least room that still holds them, thousands of equal sequences at a time. The
plan is a table of slots (length, first rank, count, first sequence, offset)
whose size depends on the sequence length, not on the number of documents. Pieces
then take their slots by joining on their rank within their length.

The task that makes pieces numbers those of each length, and what the tasks before it
made of that length is added: no piece moves to be ranked, so a length that holds a
third of all pieces costs like any other.

A null text is an empty document: its end token alone. Repeated rows are packed
as often as they occur. Without documents the result is empty. Other columns are
ignored. Texts of any length are tokenized whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, text_slices

SEQUENCE = 1024
END = 2
#: Ranks of a length that meet its slots under one key.
RANKED = 100_000
#: Slots, and counts of a task and length, that are sent to every task; more are joined.
SENT = 50_000
SENT_COUNTS = 400_000
#: Bytes of words and ids that a worker remembers, with what an entry costs besides.
KEPT = 96 << 20
KEPT_ENTRY = 150
#: Bytes of text that are encoded at once.
TEXTS = 2 << 20
ID = "<u4"
TOKENIZER = "byte_bpe_50k.json"

# Word pattern of byte-level vocabularies of this kind (fixed value).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# White space that a text cut at single blanks must not have: other than blanks
# and line ends, or two in a row.
RUNS = ["  ", "\n ", " \n", "\n\n", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"]
WIDE = [chr(c) for c in range(128, 0x10000) if chr(c).isspace()]


def _visible_bytes() -> dict[int, int]:
    """Byte-level vocabularies write a byte as a character: printable Latin-1 as
    it is, the others, in order, from 256 on."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


BYTES = _visible_bytes()
BLANK = chr(BYTES[32])
#: Marks that are a word of their own behind letters.
STOPS = b".,;:!?)"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of whole texts as little-endian bytes.

    A byte-level vocabulary never merges across its words, and a single blank
    between two visible characters always begins a word. So texts are cut at such
    blanks, all at once; each distinct cut is encoded once and its ids are remembered
    in a memory bounded in bytes.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        self.words = regex.compile(WORD)
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(regex.escape(s) for s in special)) if special else None
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def _piece(self, word: bytes) -> bytes:
        """Ids of one word of the vocabulary's pattern."""
        ids = self.known.get(word)
        if ids is not None:
            return ids
        ids = self.older.get(word)
        if ids is None:
            if 32 <= word[0] < 127 and (len(word) == 1 or word[1:].isalpha()):
                visible = word.decode().replace(" ", BLANK)
            else:
                visible = word.decode("latin-1").translate(BYTES)
            table = self.id_bytes
            ids = b"".join([table[t.id] for t in self.merge(visible)])
        # Half of what is kept is young; words met again stay, others go.
        self.held += len(word) + len(ids) + KEPT_ENTRY
        if 2 * self.held > KEPT:
            self.known, self.older, self.held = {}, self.known, 0
        self.known[word] = ids
        return ids

    def _between(self, chunk: bytes) -> bytes:
        """Ids of what stands between two blanks, its first blank included."""
        body = chunk[1:]
        if body.isalpha():
            return self._piece(chunk)
        if body[:-1].isalpha() and body[-1] in STOPS:
            return self._piece(chunk[:-1]) + self._piece(chunk[-1:])
        return b"".join([self._piece(w.encode()) for w in self.words.findall(chunk.decode())])

    def _plain(self, text: str) -> bool:
        """Whether the text may be cut at its single blanks."""
        if text[:1].isspace() or text[-1:].isspace() or any(s in text for s in RUNS):
            return False
        return text.isascii() or not any(s in text for s in WIDE)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of all texts: the distinct words of those that may be cut are encoded once."""
        out: list[bytes | None] = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if not t:
                out[i] = b""
            elif self.special is not None and self.special.search(t):
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype=ID).tobytes()
            elif self._plain(t):
                plain.append(i)
            else:
                out[i] = b"".join([self._piece(w.encode()) for w in self.words.findall(t)])
        if plain:
            for i, ids in zip(plain, self._cut([texts[i].encode() for i in plain])):
                out[i] = ids
        return out

    def _cut(self, texts: list[bytes]) -> list[bytes]:
        data = b" ".join(texts) + b" "
        blank = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        offsets = np.concatenate([[0], blank + 1]).astype(np.int64)
        array = pa.Array.from_buffers(pa.large_binary(), len(blank), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = array.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        words = [w[:-1] for w in coded.dictionary.to_pylist()]
        # the first word of a text has no blank before it: a second set of words
        ends = np.cumsum([len(t) + 1 for t in texts])
        first = np.searchsorted(offsets, ends - [len(t) + 1 for t in texts])
        heads, own = np.unique(code[first], return_inverse=True)
        code[first] = len(words) + own
        between = self._between
        ids = [between(b" " + w) for w in words]
        ids += [b"".join([self._piece(w.encode()) for w in self.words.findall(words[h].decode())]) for h in heads.tolist()]
        size = np.fromiter((len(x) for x in ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), ID)
        begin = np.cumsum(size) - size
        count = size[code]
        total = np.cumsum(count)
        at = np.arange(total[-1]) + np.repeat(begin[code] - (total - count), count)
        tokens = flat[at]
        cuts = total[np.append(first[1:], len(code)) - 1]
        return [tokens[a:b].tobytes() for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One encoder a worker: its tasks share the vocabulary and what is remembered."""
    return Encoder(path)


def cut(ids: bytes, sequence: int, with_ids: bool) -> list[tuple]:
    """Pieces of one document: a shorter first piece, then full ones."""
    n = len(ids) // 4
    first = n % sequence or sequence
    ends = [min(first, n), *range(first + sequence, n + 1, sequence)]
    out, start = [], 0
    for i, end in enumerate(ends):
        part = ids[4 * start : 4 * end]
        out.append((i, start, end - start, zlib.crc32(part), part if with_ids else None))
        start = end
    return out


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence: int = SEQUENCE,
    end: int = END,
    tokenizer: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of all documents: id, piece, start, length, ids_crc32, ids
    (little-endian 32-bit ids; null unless ``with_ids``), and the task that made a
    piece with its number among that task's pieces of one length."""
    path = tokenizer or tokenizer_path()
    close = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, made = encoder_of(path), np.zeros(sequence + 1, np.int64)
        part = TaskContext.get().partitionId()
        for b in batches:
            for i, j in text_slices(b.column("text"), TEXTS):
                id_ = b.column("id").slice(i, j - i)
                ids = encoder.encode_all(b.column("text").slice(i, j - i).to_pylist())
                cuts = [cut(x + close, sequence, with_ids) for x in ids]
                doc = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
                piece, start, length, crc, kept = zip(*(p for c in cuts for p in c))
                number = []
                for n in length:
                    number.append(made[n])
                    made[n] += 1
                columns = [
                    id_.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()), pa.array(kept, pa.binary()), pa.array([part] * len(doc), pa.int32()), pa.array(number, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "ids", "part", "number"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"id {kind}, piece int, start long, length long, ids_crc32 long, ids binary, part int, number long"
    ).withColumnRenamed("id", id_col)


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, count, first sequence, offset), best fit first.

    Equal open sequences are one entry: room -> runs of consecutive sequences.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    open_runs: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    sequences = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        small: list[int] = []
        while left:
            while rooms and (rooms[0] < length or not open_runs.get(rooms[0])):
                room = heappop(rooms)
                if open_runs.get(room):
                    small.append(room)  # may hold a shorter length later
                else:
                    open_runs.pop(room, None)
            if rooms:
                room = rooms[0]
                first, count = open_runs[room].pop()
            else:
                room, first, count = sequence, sequences, -(-left // (sequence // length))
                sequences += count
            each = room // length
            full = min(count, left // each)
            used = [(first, full, each)] if full else []
            if full < count and left > full * each:
                used.append((first + full, 1, left - full * each))
            for start, n, times in used:
                for k in range(times):
                    slots.append((length, rank, n, start, sequence - room + k * length))
                    rank += n
                    left -= n
                rest = room - times * length
                if rest:
                    if rest not in open_runs:
                        heappush(rooms, rest)
                        open_runs[rest] = []
                    open_runs[rest].append((start, n))
            taken = sum(n for _, n, _ in used)
            if taken < count:
                open_runs[room].append((first + taken, count - taken))
        rooms.extend(small)
        heapify(rooms)
    return slots


def packed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence: int = SEQUENCE,
    end: int = END,
    tokenizer: str | None = None,
    with_ids: bool = False,
    ranked: int = RANKED,
) -> DataFrame:
    """All pieces with ``sequence_id`` and ``offset``."""
    made = stored(pieces(docs, id_col, text_col, sequence, end, tokenizer, with_ids))
    spark = docs.sparkSession
    # What a task made of a length is one row; ranks add what the tasks before it made.
    counts = stored(made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    # At most one row per length comes to the driver.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    planned = plan(histogram, sequence)
    slots = spark.createDataFrame(planned, "length long, first long, n long, sequence long, offset long")
    running = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    ranks = made.join(F.broadcast(before) if counts.count() <= SENT_COUNTS else before, ["part", "length"])
    ranks = ranks.withColumn("rank", F.col("number") + F.col("before")).alias("a")
    # Slots are cut at steps of ranks, so that the join has an equal key.
    step = F.lit(ranked)
    stepped = slots.withColumn(
        "step", F.explode(F.sequence(F.floor(F.col("first") / step), F.floor((F.col("first") + F.col("n") - 1) / step)))
    ).alias("s")
    return ranks.join(
        F.broadcast(stepped) if len(planned) + sum(histogram.values()) // ranked <= SENT else stepped,
        (F.col("a.length") == F.col("s.length"))
        & (F.floor(F.col("a.rank") / step) == F.col("s.step"))
        & (F.col("a.rank") >= F.col("s.first"))
        & (F.col("a.rank") < F.col("s.first") + F.col("s.n")),
    ).select(
        F.col(f"a.{id_col}"),
        "a.piece",
        "a.start",
        "a.length",
        "a.ids_crc32",
        *(["a.ids"] if with_ids else []),
        (F.col("s.sequence") + F.col("a.rank") - F.col("s.first")).alias("sequence_id"),
        F.col("s.offset").alias("offset"),
    )
