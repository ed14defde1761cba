"""Nearest neighbours by a hierarchical k-means tree with best-bin-first search.

Nearness is the inner product. Vectors get one more component so that all have
the norm of the longest; the largest inner product is then the smallest
distance, and k-means cells serve both. The tree is fitted on at most about
``SAMPLE_BYTES`` of vectors (a hash sample); every vector is placed in a leaf.

A query walks the tree best bin first, through a priority queue of cells by
distance, and so orders the leaves. How many leaves queries visit is calibrated:
``PROBES`` queries are answered by brute force over all rows, and visits widen
until their mean recall reaches ``RECALL``. Vectors of a leaf and the queries that
visit it meet in blocks; leaves and visits that are too many for one block are
salted. Each block gives its best rows by matrix product, with a margin for
rounding, and these get their exact score in double precision.

Past the calibrated visits a query goes on until its leaves hold ``k`` candidates, so it
gets as many rows as there are, however few vectors lie around it. Every length of
vectors that a hundredth of the rows has gets a tree of its own; queries of rarer lengths
meet all vectors of their length in blocks. Lengths do not meet: they have no product.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do
rows without an id. Repeated ids are separate candidates; a query's own id is none. Ties go to the smaller id. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_sample, stored

SAMPLE_BYTES = 8 << 20
LEAVES = 128
LEAF_ROWS = 16_384
BRANCHES = 12
PROBES = 128
RECALL = 0.97
BLOCK_ROWS = 8_192
BLOCK_QUERIES = 8_192
MARGIN = 1e-9
#: Lengths that one in so many rows has get a tree.
COMMON = 100


def sound(vector: str) -> Column:
    """Whether a vector takes part: finite throughout and not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def sound_vectors(df: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """(id, v, ...) of the rows that take part; v is an array of doubles."""
    rows = df.where(F.col(id_col).isNotNull() & sound(vector_col)).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *more
    )
    return rows.where(F.forall("v", lambda x: F.abs(x) < float("inf")))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


@dataclass
class Tree:
    """Cells by centre; ``children`` of a leaf are empty, ``leaf`` numbers leaves."""

    longest: float
    centres: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)

    @property
    def leaves(self) -> int:
        return max(self.leaf, default=-1) + 1

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the component that makes all norms equal."""
        rest = np.maximum(self.longest**2 - (x * x).sum(1), 0.0)
        return np.hstack([x, np.sqrt(rest)[:, None]])

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every vector: the nearest child at every level."""
        z = self.lifted(x)
        at = np.zeros(len(z), int)
        open_rows = np.arange(len(z))
        while len(open_rows):
            for node in np.unique(at[open_rows]):
                rows = open_rows[at[open_rows] == node]
                if kids := self.children[node]:
                    at[rows] = np.array(kids)[_nearest(z[rows], self.centres[kids])]
            open_rows = open_rows[[bool(self.children[n]) for n in at[open_rows]]]
        return np.array(self.leaf, int)[at]

    def visits(self, q: np.ndarray, most: int, rows: np.ndarray | None = None, least: int = 0) -> np.ndarray:
        """The first ``most`` leaves of a query, best bin first, and further ones until
        they hold ``least`` of ``rows`` (a number for each leaf)."""
        q = np.append(q, 0.0)
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < most or held < least):
            _, node = heappop(queue)
            kids = self.children[node]
            if not kids:
                out.append(self.leaf[node])
                held += int(rows[self.leaf[node]]) if rows is not None else 0
                continue
            away = self.centres[kids] - q
            for kid, d in zip(kids, (away * away).sum(1).tolist()):
                heappush(queue, (d, kid))
        return np.array(out, np.int32)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - (centres * centres).sum(1) / 2, axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(steps):
        cell = _nearest(x, centres)
        for c in range(k):
            own = x[cell == c]
            centres[c] = own.mean(0) if len(own) else x[rng.integers(len(x))]
    return centres


def grow(sample: np.ndarray, longest: float, leaves: int, branches: int = BRANCHES, seed: int = 11) -> Tree:
    """Split the largest cell until there are ``leaves``, or none can be split."""
    tree = Tree(longest)
    z = tree.lifted(sample)
    rng = np.random.default_rng(seed)
    centres, members, tree.children = [z.mean(0)], [np.arange(len(z))], [[]]
    queue = [(-len(z), 0)]
    count = 1
    while queue and count < leaves:
        size, node = heappop(queue)
        own = z[members[node]]
        k = min(branches, leaves - count + 1, len(own) // 2)
        if k < 2 or (own == own[0]).all():
            continue
        found = _kmeans(own.copy(), k, rng)
        cell = _nearest(own, found)
        used = np.unique(cell)
        if len(used) < 2:
            continue
        for c in used:
            tree.children[node].append(len(centres))
            heappush(queue, (-int((cell == c).sum()), len(centres)))
            centres.append(found[c])
            members.append(members[node][cell == c])
            tree.children.append([])
        count += len(used) - 1
    tree.centres = np.array(centres)
    number = iter(range(len(centres)))
    tree.leaf = [-1 if kids else next(number) for kids in tree.children]
    return tree


def _best(scores: np.ndarray, ids: np.ndarray, q_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query the rows that may be among its best k of a block."""
    for i in range(len(q_ids)):
        s = np.where(ids == q_ids[i], -np.inf, scores[i])
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            own = np.flatnonzero(s >= least - MARGIN * max(1.0, abs(least)))
        else:
            own = np.arange(len(s))
        yield i, own[s[own] > -np.inf]


def answers(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int) -> pa.RecordBatch:
    """Exact best k rows of a block for every query."""
    out_q, out_i, out_s = [], [], []
    for a in range(0, len(q), 1024):
        scores = q[a : a + 1024] @ x.T
        for i, own in _best(scores, ids, q_ids[a : a + 1024], k):
            exact = (x[own] * q[a + i]).sum(1)
            first = np.lexsort((ids[own], -exact))[:k]
            out_q.append(np.full(len(first), q_ids[a + i]))
            out_i.append(ids[own][first])
            out_s.append(exact[first])
    flat = [np.concatenate(p) if p else np.zeros(0, t) for p, t in ((out_q, np.int64), (out_i, np.int64), (out_s, np.float64))]
    return pa.RecordBatch.from_arrays([pa.array(p) for p in flat], names=["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def build(rows: DataFrame, length: int, leaves: int = LEAVES) -> Tree:
    """Fit the tree on a sample of ``rows(id, v)`` whose size is bounded in bytes."""
    n, longest = rows.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    some = bounded_sample(rows, "id", max(1024, SAMPLE_BYTES // (8 * max(1, length))))
    got = some.select("id", "v").toPandas().sort_values("id", kind="stable")
    sample = np.array(got["v"].tolist(), float).reshape(len(got), length)
    wanted = min(max(leaves, n // LEAF_ROWS), max(1, len(sample) // 8))
    return grow(sample, float(longest or 0.0), wanted)


def calibrate(rows: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float = RECALL, probes: int = PROBES) -> int:
    """Leaves to visit so that the mean recall of sampled queries is reached."""
    some = bounded_sample(queries, "id", probes, seed=13).limit(4 * probes).toPandas().sort_values("id", kind="stable")
    if not len(some):
        if queries.limit(1).count():
            raise RuntimeError("queries exist, but no probe was drawn from them")
        return 1
    q, q_ids = np.array(some["v"].tolist(), float), some["id"].to_numpy()

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1 << 14):
                part = b.slice(a, 1 << 14)
                yield answers(matrix(part.column(1)), part.column(0).to_numpy(), q, q_ids, k)

    best = _ranked(rows.select("id", "v").mapInArrow(brute, FOUND), k).select("query_id", F.col("vec_id").alias("id"))
    true = rows.select("id", "leaf").join(best, "id").select("query_id", "leaf").toPandas()
    turn = {int(i): {int(leaf): t for t, leaf in enumerate(tree.visits(v, tree.leaves))} for i, v in zip(q_ids, q)}
    needs = np.sort([turn[int(r.query_id)][int(r.leaf)] for r in true.itertuples()])
    if not len(needs):
        return 1
    return int(needs[min(len(needs) - 1, int(np.ceil(recall * len(needs))) - 1)]) + 1


def search(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    recall: float = RECALL,
    leaves: int = LEAVES,
) -> DataFrame:
    """The ``k`` nearest found for every row that ``queries`` marks: query_id, rank,
    vec_id, score. ``queries`` is a condition on the column ``id``."""
    rows = stored(sound_vectors(vectors, id_col, vector_col))
    sizes = rows.groupBy(F.size("v").alias("n")).count()
    common = sorted(r["n"] for r in sizes.where(F.col("count") * COMMON >= F.lit(rows.count())).collect())
    found = [_by_tree(rows.where(F.size("v") == n), n, queries, k, recall, leaves) for n in common]
    rest = rows.where(~F.size("v").isin(common))
    if not common or rest.limit(1).count():
        rest = rest.select(F.size("v").alias("group"), "id", "v")
        found.append(_met(rest, rest.where(queries).select("group", F.col("id").alias("q_id"), F.col("v").alias("q")), k))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return _ranked(out, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _by_tree(rows: DataFrame, length: int, queries: Column, k: int, recall: float, leaves: int) -> DataFrame:
    """What the queries among ``rows`` of one length find in the leaves they visit."""
    tree = build(rows, length, leaves)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.place(matrix(b.column(1))).astype(np.int32) if b.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf)], names=["id", "v", "leaf"])

    placed = stored(rows.mapInArrow(place, "id long, v array<double>, leaf int"))
    asked = placed.where(queries).select("id", "v")
    most = calibrate(placed, asked, tree, k, recall)
    held = np.zeros(max(1, tree.leaves), np.int64)
    for r in placed.groupBy("leaf").count().collect():  # one row per leaf of the fitted tree
        held[r["leaf"]] = r["count"]
    own = asked.groupBy("id").agg(F.count(F.lit(1)).alias("own"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = matrix(b.column(1))
            path = [tree.visits(x, most, held, k + n).tolist() for x, n in zip(v, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(path, pa.list_(pa.int32()))], names=["id", "v", "path"])

    visits = asked.join(own, "id").mapInArrow(walk, "id long, v array<double>, path array<int>").select(
        F.explode("path").alias("group"), F.col("id").alias("q_id"), F.col("v").alias("q")
    )
    return _met(placed.select(F.col("leaf").alias("group"), "id", "v"), visits, k)


def _met(placed: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """Best rows of every block where vectors (group, id, v) and visits (group, q_id, q)
    of one group meet."""
    # One row per group: how many blocks its vectors and its queries make.
    blocks = placed.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("vs"))
    asks = visits.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("qs"))
    shape = stored(blocks.join(asks, "group"))
    left = (
        placed.join(shape, "group")
        .withColumn("vb", F.pmod(F.xxhash64("id"), F.col("vs")).cast("int"))
        .select("group", "vb", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qb"), "id", "v")
    )
    right = (
        visits.join(shape, "group")
        .withColumn("qb", F.pmod(F.xxhash64("q_id"), F.col("qs")).cast("int"))
        # a column of its own: queries may come from the same rows
        .select((F.col("group") + 0).alias("group"), F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("vb"), "qb", "q_id", "q")
    )

    def meet(block: pa.Table, asking: pa.Table) -> pa.Table:
        x, q = matrix(block.column("v")), matrix(asking.column("q"))
        if not len(x) or not len(q):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return pa.Table.from_batches([answers(x, block.column("id").to_numpy(), q, asking.column("q_id").to_numpy(), k)])

    key = ["group", "vb", "qb"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, FOUND)
