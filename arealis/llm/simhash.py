"""Near-duplicate texts by SimHash with bit-sliced comparison.

Fingerprints within two bits agree in two of their four 16-bit blocks, so equal
fingerprints are first made one and then compared only inside the six tables of
block pairs. Inside a table's group the remaining bits are stored vertically, 64
fingerprints to a word and plane; carry-save counters add the differing planes of
a row to 64 distances at once, and words in which every distance is beyond the
radius are abandoned. Groups beyond ``TILE`` rows are compared in tiles of
chunks, so no task holds more than two chunks, whatever the size of a group.

Nulls and empty texts have no words and fingerprint zero; shorter texts than a
shingle have one hash of all their words. Repeated rows and ids share their
class; rows without an id get the class id of their class, or null if it has no
id at all. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_map, components, forest, stored, whole_groups

SEED = 42
WORDS = 3
RADIUS = 2
TILE = 16_384
BLOCKS = 4
WIDTH = 64 // BLOCKS
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included."""
    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_column(words: int = WORDS):
    return column_map(lambda texts: [fingerprint(t, words) for t in texts], T.LongType())


def near_pairs(values: np.ndarray, starts: np.ndarray, radius: int = RADIUS, lanes: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group whose values differ in at most ``radius`` <= 2 bits."""
    ends = np.append(starts[1:], len(values))
    sizes = ends - starts
    words = -(-sizes // 64)
    first = 0
    while first < len(starts):  # as many groups as fill about `lanes` words
        last = first + max(1, int(np.searchsorted(np.cumsum(words[first:]), lanes)))
        yield from _sliced(values[starts[first] : ends[last - 1]], int(starts[first]), sizes[first:last], words[first:last], radius)
        first = last


def _sliced(v, base, sizes, words, radius):
    rows = len(v)
    group = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(rows) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    word0 = np.cumsum(words) - words
    bits = np.unpackbits(v.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    vertical = np.zeros((int(words.sum()), 64, 64), np.uint8)  # word, bit, lane
    vertical[word0[group] + inside // 64, :, inside % 64] = bits
    planes = np.packbits(vertical, axis=2, bitorder="little").view("<u8")[:, :, 0].T.copy()
    used = np.zeros_like(vertical[:, 0, :])
    used[word0[group] + inside // 64, inside % 64] = 1
    used = np.packbits(used, axis=1, bitorder="little").view("<u8")[:, 0]
    at_row = np.zeros(len(used) * 64, np.int64)
    at_row[(word0[group] + inside // 64) * 64 + inside % 64] = np.arange(rows)
    # Every row meets the words of its group from its own word on.
    meets = words[group] - inside // 64
    ends = np.cumsum(meets)
    done = 0
    while done < rows:
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + (1 << 19), "right")))
        own = np.arange(done, upto)
        row = np.repeat(own, meets[own])
        step = np.arange(len(row)) - np.repeat(np.cumsum(meets[own]) - meets[own], meets[own])
        word = word0[group[row]] + inside[row] // 64 + step
        one = np.zeros(len(row), np.uint64)
        two, far = one.copy(), ~used[word]
        for b in range(64):
            d = planes[b][word] ^ np.where(bits[row, b], ALL, np.uint64(0))
            carry = one & d
            one ^= d
            far |= two & carry  # a distance of four, and it stays far
            two ^= carry
            if b % 8 == 7:
                beyond = far | (one & two if radius == 2 else two if radius == 1 else one | two)
                live = np.flatnonzero(beyond != ALL)
                if len(live) < len(row):
                    row, word, one, two, far = row[live], word[live], one[live], two[live], far[live]
                if not len(row):
                    break
        if len(row):
            near = ~(far | (one & two if radius == 2 else two if radius == 1 else one | two))
            for i in range(0, len(row), 1 << 14):
                k, lane = np.nonzero(np.unpackbits(near[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                a, b = row[i + k], at_row[word[i + k] * 64 + lane]
                up = a < b
                yield base + a[up], base + b[up]
        done = upto


def block_keys(fp: str = "fp"):
    """The six (table, two blocks) keys of a fingerprint, as longs."""
    block = [F.shiftrightunsigned(F.col(fp), WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1)) for i in range(BLOCKS)]
    return F.array(
        *[
            (F.lit(t).cast("long") * F.lit(1 << 2 * WIDTH) + block[i] * F.lit(1 << WIDTH) + block[j])
            for t, (i, j) in enumerate(combinations(range(BLOCKS), 2))
        ]
    )


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``nodes(fp)``: for each tile of
    each group, every fingerprint with its smallest relative inside the tile."""
    keyed = nodes.select("fp", F.explode(block_keys()).alias("key"))
    count = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
    tiles = (
        keyed.join(count, "key")
        .withColumn("c", chunks)
        .withColumn("own", own)
        .select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other"))
        .select("key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["key", "i", "j"], 1 << 15):
            v = t.column("fp").to_numpy()
            pairs = list(near_pairs(v.view(np.uint64), starts, radius))
            if not pairs:
                continue
            a, b = (np.concatenate(x) for x in zip(*pairs))
            root = forest(a, b, len(v))
            some = np.flatnonzero(root != np.arange(len(v)))
            yield pa.RecordBatch.from_pydict({"a": v[some], "b": v[root[some]]})

    return (
        tiles.repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInArrow(compare, "a long, b long")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id reachable over links of ``radius`` bits."""
    if not 0 <= radius <= 2:
        raise ValueError("block pairs find all pairs only up to two bits")
    rows = stored(docs.select(F.col(id_col).alias("_id"), fingerprint_column()(F.col(text_col)).alias("fp")))
    nodes = rows.groupBy("fp").agg(F.min("_id").alias("rep"))
    root = components(links(nodes.select("fp"), radius))
    placed = nodes.join(root, nodes.fp == root.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    low = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = placed.join(low, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stand for their class of ``near_duplicates()``: one of each.

    The row with the smallest id stays; of rows that repeat that id, or have none, the
    one that sorts first by its columns.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("doc"), F.xxhash64(*columns).alias("r1"), F.xxhash64(F.lit(1), *reversed(columns)).alias("r2"))
    rows = keyed.select(F.struct(F.col("doc")[id_col].isNull().alias("none"), F.col("doc")[id_col].alias("i"), "r1", "r2").alias("row"), F.col("doc")[text_col].alias("text"))
    numbered = stored(rows.select("row", fingerprint_column()(F.col("text")).alias("fp")))
    nodes = numbered.groupBy("fp").agg(F.min("row").alias("best"))
    root = components(links(nodes.select("fp"), radius))
    placed = nodes.join(root, nodes.fp == root.node, "left").select("best", F.coalesce("root", "fp").alias("root"))
    kept = placed.groupBy("root").agg(F.min("best").alias("best")).select("best.r1", "best.r2")
    return keyed.join(kept, ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"]).select("doc.*")
