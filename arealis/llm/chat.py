"""Chat formatting: whole conversations as one text with a mask of what is learned.

A turn is ``<|im_start|>role<|im_sep|>text<|im_end|>``. What could read as a mark in a
role or text is escaped: a ``<``, any number of backslashes and a ``|`` get one
more backslash, so that ``<|`` stands in marks only and the text comes back whole.

A conversation is rendered once and encoded once, with the place of every token in
the text. The marks are tokens of their own (numbers behind the vocabulary, which is
not trained), so no token reaches over the edge of a turn. The spans of learned turns
and of tokens are both sorted: binary search finds the tokens that meet a span, those
are the mask. A token that reached over an edge would raise.

Rows are in the order of their turn (null first), then of role and text. A null role
or text is empty. Repeated rows are turns of their own. Rows without an id are one
conversation without id. Without rows the result is empty. Other columns are ignored.
A conversation of any length is rendered whole, by one task.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole_groups
from .packing import tokenizer_path

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
MARKS = (START, SEP, END)
LEARNED = ("assistant",)
#: Rows read before conversations are encoded together.
ROWS = 2_000
_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")

FORMATTED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("starts", T.BinaryType()),
        T.StructField("ends", T.BinaryType()),
        T.StructField("mask", T.BinaryType()),
    ]
)


def escaped(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text) if "|" in text else text


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def rendered(turns: Sequence[tuple[str, str]], learned: Sequence[str] = LEARNED) -> tuple[str, np.ndarray]:
    """The text of (role, text) turns, and the spans (first, end) of learned texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escaped(role)}{SEP}", escaped(text)
        parts += [head, body, END]
        at += len(head)
        if role in learned:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parsed(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered conversation."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        sep = text.index(SEP, at)
        end = text.index(END, sep)
        turns.append((unescaped(text[at + len(START) : sep]), unescaped(text[sep + len(SEP) : end])))
        at = end + len(END)
    return turns


def learned_tokens(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the tokens inside the sorted ``spans``, by binary search.

    Tokens of parts of a character share its place, so places are sorted but may
    repeat. A token over the edge of a span raises.
    """
    mask = np.zeros(len(starts), bool)
    spans = spans[spans[:, 0] < spans[:, 1]]
    first = np.searchsorted(ends, spans[:, 0], "right")
    last = np.searchsorted(starts, spans[:, 1], "left")
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, last, -1)
    mask = np.cumsum(change[:-1]) > 0
    if len(spans) and ((last <= first).any() or (starts[first] != spans[:, 0]).any() or (ends[last - 1] != spans[:, 1]).any()):
        raise ValueError("a token reaches over the edge of a turn")
    return mask


def encoder(path: str | None = None):
    """The tokenizer with the marks as tokens of their own."""
    from tokenizers import AddedToken, Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
    tokenizer = Tokenizer.from_file(path or tokenizer_path())
    tokenizer.encode_special_tokens = False
    tokenizer.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in MARKS])
    return tokenizer


def formatted(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    learned: Sequence[str] = LEARNED,
    tokenizer: str | None = None,
) -> DataFrame:
    """One row per conversation: its text, token ids (little-endian 32-bit), places
    of the tokens in the text (64-bit code points) and the mask, a byte per token."""
    path = tokenizer or tokenizer_path()
    kind = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), *[(c, pa.binary()) for c in ("ids", "starts", "ends", "mask")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for t, starts in whole_groups(batches, ["none", "id"], ROWS):
            none, ids = t.column("none").to_pylist(), t.column("id").to_pylist()
            turns = list(zip(t.column("role").to_pylist(), t.column("text").to_pylist()))
            bounds = [*starts.tolist(), len(turns)]
            rows = []
            for a, b in zip(bounds, bounds[1:]):
                text, spans = rendered(turns[a:b], learned)
                tokens = encode.encode(text, add_special_tokens=False)
                place = np.array(tokens.offsets, np.int64).reshape(-1, 2)
                mask = learned_tokens(spans, place[:, 0], place[:, 1])
                rows.append(
                    (
                        None if none[a] else ids[a], text, np.array(tokens.ids, "<u4").tobytes(),
                        place[:, 0].astype("<i8").tobytes(), place[:, 1].astype("<i8").tobytes(), mask.tobytes(),
                    )
                )
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    rows = conversations.select(
        F.col(id_col).isNull().alias("none"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
        F.col(turn_col).alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((role_col, "role"), (text_col, "text"))],
    )
    in_order = rows.repartition("none", "id").sortWithinPartitions("none", "id", F.asc_nulls_first("turn"), "role", "text")
    return in_order.mapInArrow(run, FORMATTED)


def learned_texts(text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """What stands under the mask, a text for each run of learned tokens. Tokens of
    parts of one character cover it once."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    runs = zip(np.flatnonzero(edge > 0).tolist(), (np.flatnonzero(edge < 0) - 1).tolist())
    return [unescaped(text[starts[a] : ends[b]]) for a, b in runs]


READ = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_loss_tokens", T.LongType()),
    ]
)


def read_back(made: DataFrame) -> DataFrame:
    """Counts and digests of turns and learned texts, from ``formatted()`` alone."""
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, text, starts, ends, mask in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "starts", "ends", "mask"))):
                turns = parsed(text)
                inside = np.frombuffer(mask, bool)
                loss = "".join(learned_texts(text, np.frombuffer(starts, "<i8"), np.frombuffer(ends, "<i8"), inside))
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append(
                    (
                        conv, len(turns), sha256(whole.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(),
                        len(text), len(inside), int(inside.sum()),
                    )
                )
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], READ.names)

    return made.mapInArrow(run, READ)


# What is read back, as SQL over the rows; the numbers of tokens are not in it.
ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 32 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
