"""Near-duplicate embeddings by codes of random rotations.

Unit vectors are turned by seeded random rotations; a code keeps the signs, and a
correction factor the inner product of the turned vector with its code. With it
the inner product of a code and another turned vector gives an unbiased estimate
of the vectors' own, and a bound that fails with chance ``DOUBT``. Pairs whose
bound reaches the threshold are computed again in double precision; only those
decide.

Which pairs meet at all: bits of further rotations make keys, in so many tables
that a pair at the threshold misses all of them with chance ``MISS``. The number
of bits grows with the logarithm of the largest label, so that chance meetings
stay few. Equal vectors of a label are made one before, and a pair counts in the
first table it shares. Rows of one key beyond ``TILE`` are compared in tiles of
chunks, so no task holds more than two chunks, whatever the size of a group. A
tile gives counts per vector and a forest of its links, never its pairs.

Vectors meet inside their label and length. Those that are null, zero, or hold null or
non-finite components link with nothing, nor do rows without a label; they are classes
of their own. Rows without an id link like others and count, their class id is
the smallest id reachable, or null. Repeated rows link with each other. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, group_starts, stored, whole_groups
from .kmeans_tree import matrix, sound

THRESHOLD = 0.98
MISS = 1e-7
DOUBT = 1e-9
ROTATIONS = 4
TILE = 4_096
SEED = 29


@lru_cache(maxsize=16)
def rotations(length: int, count: int, seed: int = SEED) -> np.ndarray:
    """``count`` random orthogonal matrices side by side."""
    rng = np.random.default_rng(seed)
    return np.hstack([np.linalg.qr(rng.standard_normal((length, length)))[0] for _ in range(count)])


def tables(rows: int, length: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits of a key and number of tables."""
    same = 1 - math.acos(min(1.0, threshold)) / math.pi
    bits = int(min(30, max(8, math.ceil(math.log2(max(2, rows))) + 2)))
    return bits, math.ceil(math.log(miss) / math.log(1 - same**bits))


def units(v: np.ndarray) -> np.ndarray:
    """Vectors of norm one, however large or small they are."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def keys_of(unit: np.ndarray, bits: int, count: int) -> np.ndarray:
    """Keys (row x table) from the signs of turned vectors."""
    length = unit.shape[1]
    turned = unit @ rotations(length, -(-bits * count // length), SEED + 1)[:, : bits * count]
    powers = 1 << np.arange(bits, dtype=np.int64)
    return (turned > 0).reshape(len(unit), count, bits) @ powers


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turned vectors, their codes (+1, -1) and correction factors per rotation."""
    length = unit.shape[1]
    turned = (unit @ turn).astype(np.float32)
    code = np.where(turned > 0, np.float32(1), np.float32(-1))
    factor = (turned * code).reshape(len(unit), -1, length).sum(2) / math.sqrt(length)
    return turned, code, factor


def candidates(a: slice, b: slice, coded, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) whose confidence bound reaches the threshold.

    A code is ``factor`` times its vector and a rest at right angles to it, which
    the rotation turns anywhere. The other vector has a part of sin(angle) there, so
    an estimate has at most sqrt(1 - factor^2) / factor * sin(angle) /
    sqrt(length - 1) as standard deviation, and the angle of a pair that must not
    be lost is at most the threshold's.
    """
    turned, code, factor = coded
    count = factor.shape[1]
    length = turned.shape[1] // count
    own = np.maximum(factor[a], 1e-3)
    # The mean over rotations: every code is divided by its own factor.
    scaled = (code[a].reshape(-1, count, length) / (own[:, :, None] * math.sqrt(length) * count)).reshape(len(own), -1)
    estimate = scaled @ turned[b].T
    sigma = np.sqrt(((1 - np.minimum(own, 1) ** 2) / own**2).sum(1)) / count / math.sqrt(max(1, length - 1))
    bound = sigma * math.sqrt(1 - min(1.0, threshold) ** 2) * math.sqrt(2 * math.log(1 / DOUBT)) + 1e-5
    return np.nonzero(estimate + bound[:, None] >= threshold)


def links(unit: np.ndarray, keys: np.ndarray, table: np.ndarray, starts: np.ndarray, ends: np.ndarray, coded, threshold: float):
    """Pairs of rows linked inside their group and counted in this table."""
    for s, e in zip(starts, ends):
        for i in range(s, e, 1024):
            stop = min(e, i + 1024)
            for j in range(i, e, 1024):
                last = min(e, j + 1024)
                p, q = candidates(slice(i, stop), slice(j, last), coded, threshold)
                p, q = p + i, q + j
                keep = p < q
                p, q = p[keep], q[keep]
                for x in range(0, len(p), 1 << 16):
                    u, v = p[x : x + (1 << 16)], q[x : x + (1 << 16)]
                    near = (unit[u] * unit[v]).sum(1) >= threshold
                    u, v = u[near], v[near]
                    if t := int(table[s]):
                        first = ~(keys[u, :t] == keys[v, :t]).any(1)
                        u, v = u[first], v[first]
                    if len(u):
                        yield u, v


def by_length(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, pa.RecordBatch | pa.Table]]:
    """The rows of each length, in their order."""
    lengths = rows.column("len").to_numpy()
    for n in np.unique(lengths).tolist():
        yield n, rows if (lengths == n).all() else rows.filter(pa.array(lengths == n))


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    miss: float = MISS,
    tile: int = TILE,
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label")
    ).withColumn("ok", F.coalesce(F.col("label").isNotNull() & sound("v"), F.lit(False)))
    # Two hashes stand for a vector of a label.
    rows = stored(
        rows.withColumn("h1", F.when(F.col("ok"), F.xxhash64("label", "v")))
        .withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit(1), "v", "label")))
    )
    single = rows.where("ok").groupBy("label", "h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("low"), F.first("v").alias("v"))
    # Vectors of one label and length meet; every length has rotations and tables of its own.
    single = stored(single.withColumn("len", F.size("v")))
    most = single.groupBy("label", "len").count().agg(F.max("count")).first()[0] or 0

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                for length, part in by_length(b.slice(a, 4096)):
                    bits, count = tables(most, length, threshold, miss)
                    k = keys_of(units(matrix(part.column("v"))), bits, count)
                    n = len(k)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "label": part.column("label").take(pa.array(np.repeat(np.arange(n), count))),
                            "len": np.full(n * count, length, np.int32),
                            "t": np.tile(np.arange(count, dtype=np.int32), n),
                            "key": k.ravel(),
                            "h1": np.repeat(part.column("h1").to_numpy(), count),
                        }
                    )

    kind = single.schema["label"].dataType.simpleString()
    keyed = single.select("label", "len", "v", "h1").mapInArrow(spread, f"label {kind}, len int, t int, key long, h1 long")
    # Rows that share a key with another; a key of many rows is dealt in tiles.
    shared = keyed.groupBy("label", "len", "t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = (
        keyed.join(shared, ["label", "len", "t", "key"])
        .withColumn("c", F.ceil(F.col("n") / tile).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("h1"), F.col("c")).cast("int"))
        .select("label", "len", "t", "key", "h1", "own", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other"))
        .select("label", "t", F.xxhash64("label", "len", "t", "key").alias("g"), "h1", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    blocks = (
        met.join(single.select(F.col("h1").alias("h"), "len", "v", "copies"), F.col("h1") == F.col("h"))
        .select("g", "i", "j", "t", "h1", "own", "copies", "len", "v")
        .repartition("g", "i", "j")
        .sortWithinPartitions("g", "i", "j", "h1")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = (x for part, _ in whole_groups(batches, ["g", "i", "j"], 4096) for x in by_length(part))
        for length, part in groups:
            bits, count = tables(most, length, threshold, miss)
            starts = group_starts(part, ["g", "i", "j"])
            unit = units(matrix(part.column("v")))
            h, copies = part.column("h1").to_numpy(), part.column("copies").to_numpy()
            i, j, own = (part.column(c).to_numpy() for c in ("i", "j", "own"))
            # In a tile of two chunks only pairs across them are new; each chunk
            # is compared inside in its own tile.
            ends = np.append(starts[1:], len(h))
            n = np.zeros(len(h), np.int64)
            found = []
            keys, coded = keys_of(unit, bits, count), encode(unit, rotations(length, ROTATIONS))
            for u, w in links(unit, keys, part.column("t").to_numpy(), starts, ends, coded, threshold):
                new = (i[u] == j[u]) | (own[u] != own[w])
                u, w = u[new], w[new]
                np.add.at(n, u, copies[w])
                np.add.at(n, w, copies[u])
                found.append((u, w))
            if not found:
                continue
            u, w = (np.concatenate(x) for x in zip(*found))
            root = forest(u, w, len(h))
            some = np.flatnonzero((n > 0) | (root != np.arange(len(h))))
            yield pa.RecordBatch.from_pydict({"a": h[some], "b": h[root[some]], "n": n[some]})

    found = stored(blocks.mapInArrow(compare, "a long, b long, n long"))
    linked = found.groupBy("a").agg(F.sum("n").alias("n"))
    root = components(found.select("a", "b"))
    placed = single.select("h1", "h2", "copies", "low").join(root, F.col("h1") == F.col("node"), "left").withColumn("root", F.coalesce("root", "h1"))
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = (
        placed.join(lows, "root")
        .join(linked, F.col("h1") == F.col("a"), "left")
        .select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("component_id").alias("c"))
    )
    out = rows.select("id", "h1", "h2").join(classes, ["h1", "h2"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("c")).alias("component_id"),
        F.coalesce(F.col("id") == F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("c")), F.lit(False)).alias("kept"),
    )


# The same table as SQL, with all pairs of a label compared.
ORACLE = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.98),
reach AS (SELECT a AS vec_id, a AS low FROM links UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.vec_id WHERE r.low < l.b)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(low, e.vec_id)::BIGINT AS component_id, coalesce(low, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON e.vec_id = c.a
LEFT JOIN (SELECT vec_id, min(low) AS low FROM reach GROUP BY vec_id) r ON e.vec_id = r.vec_id
"""
