"""Systems over the areas of a graph, solved in blocks.

Every area has q unknowns; the matrix is ``W + K1 (x) L + K0 (x) I``: a q x q matrix W
for each area (its data), the graph Laplacian L coupled by K1, and K0 for each area by
itself. Structured effects, varying slopes and all types of space-time interaction
have this form, and one solve takes any number of right-hand sides.

Areas are dealt into blocks along the graph, blocks into groups, groups into larger ones.
A block eliminates the areas that only it needs and hands the rest on, a group those
that only it needs, until nothing is left; then the values go the same way back. So
a solve is exact and takes two jobs a level, whatever the matrix. Right-hand sides are
made in the tasks of the blocks, each time they are needed: only what is handed on is
stored.

Where a group would have to hold more than ``FRONT`` unknowns (graphs that no narrow border
cuts) conjugate gradients take over, preconditioned on two levels: the dense solve of
each block in its task, and a system of block means. Blocks exchange the values of their
border areas once a step. The driver sees one row per block and pair of neighbours.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import reliable_checkpoint

#: Unknowns of one dense block.
DENSE = 1_500
#: Unknowns of a layer at least, by which a block is eliminated.
LAYER = 64
#: Links of a graph that one task deals into blocks.
LINKS = 1_000_000
#: Unknowns of the coarse system that are solved densely; more by gradients, sparse.
COARSE = 3_000
#: Blocks of a group, groups of a larger one.
GROUP = 8
#: Unknowns that a group may hold at once; above it the system is solved by gradients.
FRONT = 5_000

_STATE = "block long, source long, data binary, sums binary"


# ------------------------------------------------------------------- dealing


def grown(i: np.ndarray, j: np.ndarray, n: int, most: int, size: np.ndarray | None = None) -> np.ndarray:
    """Blocks of ``n`` numbered areas, or clusters of ``size`` areas, each grown from one at the
    edge of the last."""
    sizes = [1] * n if size is None else size.tolist()
    order = np.argsort(i, kind="stable")
    near = j[order]
    begin = np.searchsorted(i[order], np.arange(n + 1))
    block = np.full(n, -1)
    edge: deque[int] = deque()
    left: deque[int] = deque()  # what earlier blocks met and did not take, the oldest first
    number, full = 0, 0
    for seed in range(n):
        left.append(seed)
        while edge or left:
            a = (edge or left).popleft()
            if block[a] >= 0:
                continue
            if full and full + sizes[a] > most:
                number, full = number + 1, 0
                left.extend([*edge, a])
                edge.clear()  # the next block begins beside the oldest ones
                a = next(x for x in iter(left.popleft, None) if block[x] < 0)
            block[a] = number
            full += sizes[a]
            edge.extend(near[begin[a] : begin[a + 1]].tolist())
    return block


def _in_one_task(clusters: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """(c, block) of ``clusters(c, s)``, s areas each, grown along ``links(c1, c2)``."""
    kind = clusters.schema["c"].dataType.simpleString()

    def one(frames):
        some = list(frames)
        if not some:
            return
        d = pd.concat(some)
        here = d[d.s > 0]
        names = here.i.to_numpy()
        number = pd.Series(np.arange(len(names)), index=names)
        e = d[d.s == 0]
        a, b = number.reindex(e.i).to_numpy(), number.reindex(e.j).to_numpy()
        both = ~(np.isnan(a) | np.isnan(b))
        yield pd.DataFrame({"c": names, "block": grown(a[both].astype(int), b[both].astype(int), len(names), most, here.s.to_numpy())})

    zero = F.lit(0).cast("long").alias("s")
    rows = clusters.select(F.col("c").alias("i"), F.col("c").alias("j"), F.col("s").cast("long").alias("s")).union(links.select("c1", "c2", zero))
    return rows.coalesce(1).sortWithinPartitions("i", "j").mapInPandas(one, f"c {kind}, block long")


def deal(edges: DataFrame, areas: DataFrame, most: int, links: int = LINKS, rounds: int = 60) -> DataFrame:
    """(area, block) for the one column of ``areas``: neighbours together, about ``most`` each.

    A graph of up to ``links`` links is dealt by one task. In a larger one clusters join
    along the most links: in a round a coin makes each cluster a head or a tail, a tail
    asks one head among its neighbours, a head takes what fits. When so few links are left
    between clusters, or none can join, one task deals clusters instead of areas. Clusters
    stay below an eighth of a block as long as that leaves some to join, for ragged blocks
    have long borders. Those that nothing links to others are put together by hash.
    """
    (area,) = areas.columns
    one = F.lit(1).cast("long")
    if areas.count() <= most:
        return areas.select(area, F.lit(0).cast("long").alias("block"))
    if edges.count() <= links:
        near = edges.select(F.col("i").alias("c1"), F.col("j").alias("c2"))
        return _in_one_task(areas.select(F.col(area).alias("c"), one.alias("s")), near, most).withColumnRenamed("c", area)
    labels = reliable_checkpoint(areas.select(F.col(area).alias("a"), F.col(area).alias("c")))
    near = edges.select(F.col("i").alias("c1"), F.col("j").alias("c2"), one.alias("links"))
    for end in ("c1", "c2"):
        near = near.join(labels.select(F.col("c").alias(end)), end, "left_semi")

    def between(near: DataFrame) -> DataFrame:
        """Links between two clusters, as one row."""
        return reliable_checkpoint(near.where("c1 != c2").groupBy("c1", "c2").agg(F.sum("links").alias("links")))

    near = between(near)
    idle, cap = 0, min(most, max(2, most // 8))
    for k in range(rounds):
        if near.count() <= links:
            break
        size = labels.groupBy("c").agg(F.count(one).alias("s"))
        tail = lambda c: F.pmod(F.xxhash64(c, F.lit(k)), F.lit(2)) == 1  # noqa: E731, B023
        offers = near.where(tail("c1") & ~tail("c2"))
        offers = offers.join(size.select(F.col("c").alias("c1"), F.col("s").alias("s1")), "c1").join(
            size.select(F.col("c").alias("c2"), F.col("s").alias("s2")), "c2"
        )
        asked = offers.where(F.col("s1") + F.col("s2") <= cap).groupBy("c1", "s1").agg(
            F.max(F.struct("links", F.xxhash64("c2", F.lit(k)).alias("h"), "c2", "s2")).alias("o")
        )
        fill = F.sum("s1").over(W.partitionBy("o.c2").orderBy(F.desc("o.links"), "c1").rowsBetween(W.unboundedPreceding, 0))
        taken = asked.withColumn("fill", fill).where(F.col("fill") + F.col("o.s2") <= cap).select(F.col("c1").alias("c"), F.col("o.c2").alias("to"))
        taken = reliable_checkpoint(taken)
        if taken.limit(1).count():
            idle = 0
            labels = reliable_checkpoint(labels.join(taken, "c", "left").select("a", F.coalesce("to", "c").alias("c")))
            for end in ("c1", "c2"):
                near = near.join(taken.withColumnRenamed("c", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
            near = between(near)
        elif idle < 2:
            idle += 1
        elif cap < most:
            idle, cap = 0, min(most, 2 * cap)
        else:
            break
    size = reliable_checkpoint(labels.groupBy("c").agg(F.count(one).alias("s")))
    linked = near.select(F.col("c1").alias("c")).union(near.select("c2"))
    blocks = _in_one_task(size.join(linked, "c", "left_semi"), near, most)
    alone = size.join(linked, "c", "left_anti")
    bins = max(1, -(-2 * (alone.where(2 * F.col("s") < most).agg(F.sum("s")).first()[0] or 0) // most))
    own = F.xxhash64("c", F.lit(-1))
    bin_ = F.when(2 * F.col("s") < most, -1 - F.pmod(own, F.lit(bins))).otherwise(own)
    return labels.join(blocks.union(alone.select("c", bin_)), "c").select(F.col("a").alias(area), "block")


@dataclass
class Dealt:
    """A graph in blocks: its rows (block, areas, links) and how many there are."""

    rows: DataFrame
    placed: DataFrame
    area: str
    blocks: int
    #: the groups of each block, from the smallest; None: solved by gradients
    paths: dict[int, list[int]] | None = None


def dealt(edges: DataFrame, areas: DataFrame, unknowns: int = 1, dense: int = DENSE, front: int = FRONT) -> Dealt:
    """Number the areas inside their blocks and list the links of each block.

    Links to areas that are not in ``areas`` count in the degree only: such an area
    is held at 0.
    """
    (area,) = areas.columns
    parts = reliable_checkpoint(deal(edges, areas, max(1, dense // unknowns)))
    lists = parts.groupBy("block").agg(F.sort_array(F.collect_list(area)).alias("l"))
    placed = reliable_checkpoint(lists.select("block", F.posexplode("l").alias("at", area)))
    side = lambda end, b, at: placed.select(F.col(area).alias(end), F.col("block").alias(b), F.col("at").alias(at))
    links = edges.select("i", "j").join(side("i", "block", "at"), "i").join(side("j", "other", "there"), "j", "left").drop("i", "j")
    links = reliable_checkpoint(links)
    names = sorted(r["block"] for r in parts.select("block").distinct().collect())
    paths = {b: [] for b in names}
    if len(names) > 1:
        paths = _groups(links, names)
        links = reliable_checkpoint(_levels(links, paths))
        if _widest(links) * unknowns > front:
            paths = None
    else:
        links = links.withColumns({"level": F.lit(0), "up": F.lit(0)})
    rows = links.groupBy("block").agg(F.collect_list(F.struct("at", "other", "there", "level", "up")).alias("links"))
    return Dealt(reliable_checkpoint(rows), placed, area, len(names), paths)


def _groups(links: DataFrame, names: list[int], most: int = GROUP) -> dict[int, list[int]]:
    """For each block its group, the group of that, and so on up to the one that holds all."""
    pairs = links.where("other != block").select("block", "other").distinct().orderBy("block", "other").collect()
    number = {b: k for k, b in enumerate(names)}
    i, j = (np.array([number[r[c]] for r in pairs], np.int64) for c in ("block", "other"))
    at = np.arange(len(names))
    paths: list[np.ndarray] = []
    while not paths or paths[-1].max() > 0:
        group = grown(i, j, int(at.max()) + 1, most)
        at = group[at]
        paths.append(at)
        i, j = group[i], group[j]
        i, j = i[i != j], j[i != j]
    return {b: [int(p[k]) for p in paths] for k, b in enumerate(names)}


def _levels(links: DataFrame, paths: dict[int, list[int]]) -> DataFrame:
    """``links`` with ``level``, the first at which a group holds both ends (0: the block
    itself), and ``up``, the level at which the other end is eliminated.

    Of a link between blocks the end in the smaller block waits for that group; the other
    end may go before.
    """
    known = links.sparkSession.createDataFrame([(b, p) for b, p in paths.items()], "block long, path array<int>")
    d = links.join(known, "block").join(known.select(F.col("block").alias("other"), F.col("path").alias("path2")), "other", "left")
    first = F.size(F.filter(F.zip_with("path", "path2", lambda a, b: a != b), lambda x: x)) + 1
    d = d.withColumn("level", F.when(F.col("other") != F.col("block"), first).otherwise(0)).drop("path2")
    waits = d.where("other > block").groupBy(F.col("block").alias("other"), F.col("at").alias("there")).agg(F.max("level").alias("up"))
    return d.join(waits, ["other", "there"], "left").withColumn("up", F.coalesce("up", F.lit(0)))


def _widest(links: DataFrame) -> int:
    """Areas that the largest group holds at once."""
    own = links.where("other > block").groupBy("block", "at", "path").agg(F.max("level").alias("up"))
    out = links.where("other < block").select("path", F.col("other").alias("b"), F.col("there").alias("t"), "up")
    held = own.select("path", F.col("block").alias("b"), F.col("at").alias("t"), "up").union(out)
    held = held.select("b", "t", F.posexplode(F.slice("path", F.lit(1), F.col("up"))).alias("k", "group")).distinct()
    return held.groupBy("k", "group").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


# ------------------------------------------------------------------- one block


class Block:
    """Matrix and values of a block; arrays are (areas, unknowns, right-hand sides)."""

    def __init__(self, w: np.ndarray, b: np.ndarray, links: list, block: int, k1: np.ndarray, k0: np.ndarray):
        self.block, self.k1, self.w, self.b = block, k1, w + k0, b
        n = len(w)
        at = np.array([x["at"] for x in links], np.int64)
        other = np.array([-1 if x["there"] is None else x["there"] for x in links], np.int64)
        owner = np.array([block if x["other"] is None else x["other"] for x in links], np.int64)
        self.degree = np.bincount(at, minlength=n).astype(float)
        known = other >= 0
        inner = known & (owner == block)
        self.i, self.j = at[inner], other[inner]
        outer = known & ~inner
        self.out_i, self.out_j, self.out_block = at[outer], other[outer], owner[outer]
        self.out_level = np.array([x["level"] for x in links], np.int64)[outer]
        self.out_up = np.array([x["up"] for x in links], np.int64)[outer]

    def dense(self, out: np.ndarray | None = None) -> np.ndarray:
        """The matrix of the block, in the upper left of ``out`` (zeros) if that is given."""
        n, q = self.w.shape[:2]
        out = np.zeros((n * q, n * q)) if out is None else out
        a = _paired(out, q)
        np.subtract.at(a, (self.i, self.j), self.k1)
        a[np.arange(n), np.arange(n)] += self.w + self.degree[:, None, None] * self.k1
        d = np.diag(out)[: n * q].copy()
        # what neither data nor neighbours tell keeps 0
        out[np.arange(n * q), np.arange(n * q)] += np.where(d > 0, 1e-13 * d, 1.0)
        return out

    def front(self) -> Front:
        """The block's matrix with the areas of smaller blocks that it is linked to."""
        n, q = self.w.shape[:2]
        ahead = self.out_block < self.block
        level = np.zeros(n, np.int64)
        np.maximum.at(level, self.out_i[~ahead], self.out_level[~ahead])
        far = np.stack([self.out_block, self.out_j, self.out_up], 1)[ahead]
        far, at = np.unique(far, axis=0, return_inverse=True)
        ids = np.vstack([np.stack([np.full(n, self.block), np.arange(n), level], 1), far])
        a = self.dense(np.zeros((len(ids) * q,) * 2))
        np.subtract.at(_paired(a, q), (self.out_i[ahead], n + at.ravel()), self.k1)
        a[n * q :, : n * q] = a[: n * q, n * q :].T
        b = np.concatenate([self.b, np.zeros((len(far), *self.b.shape[1:]))])
        return Front(ids, a, b, ids[:, 2] == 0, layers(self.i, self.j, np.flatnonzero(level == 0), max(1, LAYER // q)))

    def solved(self, r: np.ndarray) -> np.ndarray:
        if not self.k1.any():  # areas without links: each by itself
            d = np.einsum("nkk->nk", self.w)
            own = self.w.copy()
            np.einsum("nkk->nk", own)[:] += np.where(d > 0, 1e-13 * d, 1.0)
            return np.linalg.solve(own, r)
        return np.linalg.solve(self.dense(), r.reshape(-1, r.shape[2])).reshape(r.shape)

    def times(self, x: np.ndarray, lap: np.ndarray) -> np.ndarray:
        return np.einsum("nkl,nlm->nkm", self.w, x) + np.einsum("kl,nlm->nkm", self.k1, lap)

    def inner_laplacian(self, x: np.ndarray) -> np.ndarray:
        out = self.degree[:, None, None] * x
        np.subtract.at(out, self.i, x[self.j])
        return out


def _paired(a: np.ndarray, q: int) -> np.ndarray:
    """View of a matrix by pairs of areas: (area, area, q, q)."""
    return a.reshape(len(a) // q, q, -1, q).transpose(0, 2, 1, 3)


def layers(i: np.ndarray, j: np.ndarray, of: np.ndarray, least: int) -> list[np.ndarray]:
    """Areas ``of`` in layers of ``least`` areas or more; links i, j join an area only with its own
    layer, the one before and the one after."""
    place = np.full(int(max([0, *(x.max() + 1 for x in (i, j, of) if len(x))])), -1)
    place[of] = np.arange(len(of))
    i, j = place[i], place[j]
    both = (i >= 0) & (j >= 0)
    a, b = np.concatenate([i[both], j[both]]), np.concatenate([j[both], i[both]])
    order = np.argsort(a, kind="stable")
    near = b[order]
    begin = np.searchsorted(a[order], np.arange(len(of) + 1))

    def spread(seed: int, seen: np.ndarray) -> list[np.ndarray]:
        """Areas that are reached from ``seed``, by their distance."""
        out, now = [], np.array([seed])
        while len(now):
            seen[now] = True
            out.append(now)
            met = np.unique(np.concatenate([near[begin[x] : begin[x + 1]] for x in now.tolist()]))
            now = met[~seen[met]]
        return out

    out: list[list] = []
    seen = np.zeros(len(of), bool)
    for seed in range(len(of)):
        if seen[seed]:
            continue
        far = spread(seed, seen.copy())[-1][0]  # layers from the far end are narrow
        for some in spread(int(far), seen):
            if out and len(out[-1]) < least:
                out[-1] += some.tolist()
            else:
                out.append(some.tolist())
    return [of[x] for x in out]


def solved_by_layers(a: np.ndarray, at: list[np.ndarray], b: np.ndarray) -> np.ndarray:
    """x with a x = b for a symmetric ``a`` in which rows ``at[k]`` meet those of k - 1, k and k + 1
    only."""
    if len(at) < 2:
        return np.linalg.solve(a, b)
    m, back = b.shape[1], []
    d, g = a[np.ix_(at[0], at[0])], b[at[0]]
    for here, after in zip(at, at[1:]):
        out = a[np.ix_(here, after)]
        s = np.linalg.solve(d, np.hstack([g, out]))
        back.append((s[:, :m], s[:, m:]))
        d, g = a[np.ix_(after, after)] - out.T @ s[:, m:], b[after] - out.T @ s[:, :m]
    x = np.empty(b.shape)
    x[at[-1]] = np.linalg.solve(d, g)
    for here, after, (y, z) in zip(at[-2::-1], at[:0:-1], back[::-1]):
        x[here] = y - z @ x[after]
    return x


class Front:
    """A dense system over areas ``ids`` (block, place, level); those ``gone`` leave it, layer by
    layer where ``layers`` of them are given."""

    def __init__(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray, gone: np.ndarray, layers: list[np.ndarray] | None = None):
        self.ids, self.a, self.b, self.q = ids, a, b, b.shape[1]
        self.gone, self.kept = np.flatnonzero(gone), np.flatnonzero(~gone)
        # layers by place among those gone
        self.layers = [self._places(np.searchsorted(self.gone, x)) for x in layers or []]

    def _places(self, at: np.ndarray) -> np.ndarray:
        return (at[:, None] * self.q + np.arange(self.q)).ravel()

    def eliminated(self, trail: int) -> tuple:
        """What is left: ids, matrix and right-hand sides; how to get back: the values of those
        gone, (y, z) for ``y - z x``; and what they take from products with the
        last ``trail`` right-hand sides."""
        i, r = self._places(self.gone), self._places(self.kept)
        b = self.b.reshape(len(self.a), -1)
        m = b.shape[1]
        out = self.a[np.ix_(i, r)]
        s = solved_by_layers(self.a[np.ix_(i, i)], self.layers, np.hstack([b[i], out]))
        y, z = s[:, :m], s[:, m:]
        a = self.a[np.ix_(r, r)] - out.T @ z
        left = (self.ids[self.kept], (a + a.T) / 2, (b[r] - out.T @ y).reshape(-1, self.q, m))
        return left, (y, z), b[i][:, m - trail :].T @ y

    def values(self, kept: np.ndarray) -> np.ndarray:
        """All values, from those that were handed on."""
        i, r = self._places(self.gone), self._places(self.kept)
        b = self.b.reshape(len(self.a), -1)
        x = np.empty(b.shape)
        x[r] = kept.reshape(len(r), -1)
        x[i] = solved_by_layers(self.a[np.ix_(i, i)], self.layers, b[i] - self.a[np.ix_(i, r)] @ x[r])
        return x.reshape(self.b.shape)


def _assembled(parts: list[tuple], level: int) -> Front:
    """The system of a group from what its members left."""
    q, m = parts[0][2].shape[1:]
    ids, at = np.unique(np.vstack([p[0] for p in parts]), axis=0, return_inverse=True)
    a, b = np.zeros((len(ids), q, len(ids), q)), np.zeros((len(ids), q, m))
    begin = 0
    for p in parts:
        n = len(p[0])
        k = at.ravel()[begin : begin + n]
        begin += n
        a[k[:, None], :, k[None, :], :] += p[1].reshape(n, q, n, q).transpose(0, 2, 1, 3)
        b[k] += p[2]
    return Front(ids, a.reshape(len(ids) * q, -1), b, ids[:, 2] == level)


def _arrays(rows, q: int) -> tuple[np.ndarray, np.ndarray, None]:
    w = np.array([r["w"] for r in rows], float).reshape(len(rows), q, q)
    b = np.array([r["b"] for r in rows], float).reshape(len(rows), q, -1)
    return w, b, None


# ------------------------------------------------------------------- solving


@dataclass
class Solved:
    """``values``: (area, x) with x the q x m unknowns of an area, row by row.

    ``left``: with ``trail`` right-hand sides C at the end, what the areas leave of the sums that
    ``make`` gives, less C' x.
    """

    iterations: int
    residual: float
    run: Callable
    left: np.ndarray | None = None
    history: list[float] = field(default_factory=list)

    @property
    def values(self) -> DataFrame:
        return reliable_checkpoint(self.run(_table, self.schema))

    schema: str = ""


def _table(block: Block, names: list, x: np.ndarray, schema: str):
    area = schema.split()[0]
    return pd.DataFrame({area: names, "x": list(x.reshape(len(x), -1))})


def _tasks(df: DataFrame, parts: int, key: str) -> DataFrame:
    """One task for a few of ``parts`` keys; their size doesn't tell what they cost."""
    spark = df.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(max(1, min(2 * parts, most)), key)


def solve(
    systems: DataFrame,
    graph: Dealt,
    k1: np.ndarray,
    k0: np.ndarray | None = None,
    tol: float = 1e-8,
    max_iter: int = 500,
    then: Callable | None = None,
    make: Callable | None = None,
    trail: int = 0,
) -> Solved:
    """Solve for ``systems(area, w array<double>, b array<double>)``, all areas of ``graph``.

    With ``make`` the other columns of ``systems`` may be any: ``make(rows)`` gives w (n, q, q),
    b (n, q, m) and sums (or None) of a block's rows, in its task, the same whenever it is
    called. ``then(block)`` may replace what is returned of a block: it gives an array whose
    first axis is the areas. It needs a graph of one block.
    """
    k1 = np.atleast_2d(np.asarray(k1, float))
    q = len(k1)
    k0 = np.zeros((q, q)) if k0 is None else np.asarray(k0, float)
    area = graph.area
    given = [c for c in systems.columns if c != area]
    placed = systems.join(graph.placed.select(area, "block"), area)
    rows = placed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(F.col(area).alias("a"), *given))).alias("rows"))
    rows = reliable_checkpoint(_tasks(rows.join(graph.rows, "block", "left"), graph.blocks, "block"))
    kind = systems.schema[area].dataType.simpleString()
    schema = f"{area} {kind}, x array<double>"

    def block_of(r) -> Block:
        w, b, sums = make(r.rows) if make else _arrays(r.rows, q)
        links = r.links if isinstance(r.links, (list, np.ndarray)) else []
        d = Block(w, b, list(links), r.block, k1, k0)
        d.sums = sums
        return d

    def names_of(r) -> list:
        return [v["a"] for v in r.rows]

    if then and graph.blocks > 1:
        raise ValueError("a result of whole blocks needs a graph of one block")
    apart = graph.blocks <= 1 or not k1.any()
    if apart or graph.paths is not None:
        inbox, left = (None, None) if apart else _eliminated(rows, block_of, graph.paths, trail)

        def run(fn, schema):
            def each(frames):
                for pdf in frames:
                    for r in pdf.itertuples():
                        d = block_of(r)
                        if then:
                            x = then(d)
                        elif apart:
                            x = d.solved(d.b)
                        else:
                            f = d.front()
                            x = f.values(pickle.loads(r.data))[: len(d.w)]
                        yield fn(d, names_of(r), x, schema)

            some = rows if inbox is None else rows.join(F.broadcast(inbox) if _small(inbox) else inbox, "block")
            return some.mapInPandas(each, schema)

        history = [0.0]
    else:
        state, history = _gradients(rows, block_of, k1, q, tol, max_iter)
        left = None

        def run(fn, schema):
            def each(frames):
                for pdf in frames:
                    for data in pdf.data:
                        s = pickle.loads(data)
                        yield fn(s["d"], s["names"], s["x"], schema)

            return state.select("data").mapInPandas(each, schema)

    if trail and left is None:

        def crossed(d, names, x, schema):
            c = d.b[:, :, d.b.shape[2] - trail :]
            out = (0 if d.sums is None else d.sums) - np.einsum("nkg,nkm->gm", c, x)
            return pd.DataFrame({"sums": [pickle.dumps(out)]})

        left = sum(pickle.loads(s["sums"]) for s in run(crossed, "sums binary").toLocalIterator())
    return Solved(len(history) - 1, history[-1], run, left, history[1:], schema)


_LEFT = "parent long, member long, left binary, back binary"


def _eliminated(rows: DataFrame, block_of: Callable, paths: dict[int, list[int]], trail: int) -> tuple[DataFrame, np.ndarray | None]:
    """Level by level to the group that holds all, and back: (block, data) with the values of the
    areas that a block handed on, and what is left of the sums."""
    depth = len(next(iter(paths.values())))
    above = [{b: p[0] for b, p in paths.items()}]
    above += [{p[k - 1]: p[k] for p in paths.values()} for k in range(1, depth)]

    def first(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                d = block_of(r)
                left, _, taken = d.front().eliminated(trail)
                sums = None if not trail else (0 if d.sums is None else d.sums) - taken
                yield pd.DataFrame({"parent": [above[0][r.block]], "member": [r.block], "left": [pickle.dumps((*left, sums))], "back": [None]})

    def grouped(level: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("member")
            parts = [pickle.loads(x) for x in pdf["left"]]
            f = _assembled(parts, level)
            left, back, taken = f.eliminated(trail)
            sums = sum(p[3] for p in parts) - taken if trail else None
            group = int(pdf.parent.iloc[0])
            back = (f.ids[f.gone], *back, left[0], [(int(m), p[0]) for m, p in zip(pdf.member, parts)])
            parent = above[level][group] if level < depth else 0
            return pd.DataFrame({"parent": [parent], "member": [group], "left": [pickle.dumps((*left, sums))], "back": [pickle.dumps(back)]})

        return run

    def handed(pdf: pd.DataFrame) -> pd.DataFrame:
        gone, y, z, kept, members = pickle.loads(pdf.back.iloc[0])
        data = pdf.data.iloc[0]
        q = len(y) // len(gone) if len(gone) else 0
        x = np.zeros((0, y.shape[1])) if data is None else pickle.loads(data)
        q = q or (len(x) // len(kept) if len(kept) else 1)
        all_ids = np.vstack([gone, kept])
        all_x = np.concatenate([y - z @ x, x]).reshape(len(all_ids), q, -1)
        at = {tuple(v): k for k, v in enumerate(all_ids[:, :2].tolist())}
        out = [(m, pickle.dumps(all_x[[at[tuple(v)] for v in ids[:, :2].tolist()]].reshape(len(ids) * q, -1))) for m, ids in members]
        return pd.DataFrame(out, columns=["block", "data"])

    ups = [reliable_checkpoint(rows.mapInPandas(first, _LEFT))]
    for level in range(1, depth + 1):
        some = _tasks(ups[-1].select("parent", "member", "left"), len(set(above[level - 1].values())), "parent")
        ups.append(reliable_checkpoint(some.groupBy("parent").applyInPandas(grouped(level), _LEFT)))
    left = pickle.loads(ups[-1].first()["left"])[3]
    down = ups[-1].select("back", F.lit(None).cast("binary").alias("data"), F.lit(0).cast("long").alias("member"))
    for level in range(depth, 0, -1):
        sent = down.groupBy("member").applyInPandas(handed, "block long, data binary")
        if level > 1:
            down = ups[level - 1].select("member", "back").join(sent.select(F.col("block").alias("member"), "data"), "member")
    return reliable_checkpoint(sent), left


#: Bytes of values that are sent to every task; more are joined.
SENT = 16 << 20


def _small(inbox: DataFrame) -> bool:
    return (inbox.agg(F.sum(F.length("data"))).first()[0] or 0) <= SENT


def _gradients(rows, block_of, k1, q, tol, max_iter) -> tuple[DataFrame, list[float]]:
    """Two-level preconditioned gradients in their single-reduction form."""

    def sent(d: Block, block: int, state: dict, sums):
        return _sent(d, block, state, sums, state["u"])

    def start(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                d = block_of(r)
                zero = np.zeros_like(d.b)
                state = {"d": d, "names": [v["a"] for v in r.rows], "x": zero, "p": zero, "s": zero, "r": d.b, "u": d.solved(d.b)}
                # the coarse matrix: sums of the block's own matrix, and of its links out
                to, count = np.unique(d.out_block, return_counts=True)
                own = d.w.sum(axis=0) + (d.degree.sum() - len(d.i)) * k1
                out += sent(d, r.block, state, (own, dict(zip(to.tolist(), count.tolist()))))
            yield pd.DataFrame(out, columns=["block", "source", "data", "sums"])

    def met(pdf: pd.DataFrame) -> pd.DataFrame:
        """A q for u from the border values that came in, and the sums of the block."""
        home = pdf[pdf.source.isna()].iloc[0]
        s = pickle.loads(home.data)
        d: Block = s["d"]
        lap = d.inner_laplacian(s["u"])
        lap -= _around(pdf, d, lap.shape)
        s["q"] = d.times(s["u"], lap)
        dot = lambda a, b: np.einsum("nkm,nkm->m", a, b)
        sums = (s["r"].sum(0), s["q"].sum(0), dot(s["r"], s["u"]), dot(s["u"], s["q"]), dot(s["r"], s["r"]), pickle.loads(home.sums) if home.sums else None)
        return pd.DataFrame([{"block": home.block, "source": None, "data": pickle.dumps(s), "sums": pickle.dumps(sums)}])

    def stepped(y: np.ndarray, number: dict, alpha: np.ndarray, beta: np.ndarray):
        def run(frames):
            for pdf in frames:
                out = []
                for r in pdf.itertuples():
                    s = pickle.loads(r.data)
                    d: Block = s["d"]
                    mine = y[number[r.block]]
                    # the product of the coarse part: constant inside, differences at links out
                    lap = (d.degree - np.bincount(d.i, minlength=len(d.degree)))[:, None, None] * mine[None]
                    np.subtract.at(lap, d.out_i, y[[number[b] for b in d.out_block.tolist()]])
                    flat = np.broadcast_to(mine[None], s["u"].shape)
                    s["p"] = s["u"] + flat + beta * s["p"]
                    s["s"] = s["q"] + d.times(flat, lap) + beta * s["s"]
                    s["x"] = s["x"] + alpha * s["p"]
                    s["r"] = s["r"] - alpha * s["s"]
                    s["u"] = d.solved(s["r"])
                    del s["q"]
                    out += sent(d, r.block, s, None)
                yield pd.DataFrame(out, columns=["block", "source", "data", "sums"])

        return run

    def gathered(df: DataFrame) -> tuple[DataFrame, list]:
        state = reliable_checkpoint(df.groupBy("block").applyInPandas(met, _STATE))
        return state, sorted((r["block"], pickle.loads(r["sums"])) for r in state.select("block", "sums").toLocalIterator())

    state, sums = gathered(rows.mapInPandas(start, _STATE))
    number = {b: k for k, (b, _) in enumerate(sums)}
    coarse = _Coarse([s[5] for _, s in sums], number, k1, q)
    over = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b != 0)
    norm = sum(s[4] for _, s in sums)
    alpha = beta = gamma = None
    history: list[float] = []
    while True:
        rsum, qsum = (np.array([s[k] for _, s in sums]) for k in (0, 1))
        ru, uq, rr = (sum(s[k] for _, s in sums) for k in (2, 3, 4))
        left = float(np.sqrt(np.max(over(rr, norm)))) if len(norm) else 0.0
        history.append(left)
        if left <= tol or len(history) > max_iter:
            break
        y = coarse.solved(rsum)
        new = ru + np.einsum("bqm,bqm->m", y, rsum)
        delta = uq + 2 * np.einsum("bqm,bqm->m", y, qsum) + np.einsum("bqm,bqm->m", y, rsum)
        if gamma is None:
            beta, alpha = np.zeros_like(new), over(new, delta)
        else:
            beta = over(new, gamma)
            alpha = over(new, delta - over(beta * new, alpha))
        gamma = new
        state, sums = gathered(state.select("block", "data").mapInPandas(stepped(y, number, alpha, beta), _STATE))

    return state, history


def _sent(d: Block, block: int, state: dict, sums, u: np.ndarray):
    """The state of a block and the border values its neighbours need."""
    yield {"block": block, "source": None, "data": pickle.dumps(state), "sums": pickle.dumps(sums)}
    for to in np.unique(d.out_block):
        at = np.unique(d.out_i[d.out_block == to])
        yield {"block": int(to), "source": block, "data": pickle.dumps((at, u[at])), "sums": b""}


def _around(pdf: pd.DataFrame, d: Block, shape: tuple) -> np.ndarray:
    """Sums of the values of neighbours in other blocks."""
    out = np.zeros(shape)
    for m in pdf[pdf.source.notna()].itertuples():
        at, u = pickle.loads(m.data)
        mine = d.out_block == int(m.source)
        np.add.at(out, d.out_i[mine], u[np.searchsorted(at, d.out_j[mine])])
    return out


# --------------------------------------------------------- draws and variances


def root(k: np.ndarray) -> np.ndarray:
    """R with R R' = k for a positive semi-definite matrix, or for each of several."""
    e, v = np.linalg.eigh(k)
    return v * np.sqrt(np.maximum(e, 0))[..., None, :]


def prior_noise(key: int, near: Sequence[int], r1: np.ndarray, r0: np.ndarray, draws: int, seed: int, known: dict | None = None) -> np.ndarray:
    """Noise of the precision K1 (x) L + K0 (x) I at one area, the same on every run;
    that of a link is equal and opposite at its two ends. ``r1``, ``r0``: roots. ``known`` holds
    the noise of links one end of which was met, for the areas of one call after the other."""
    q = len(r1)
    known = {} if known is None else known
    normal = lambda a, b: np.random.default_rng([seed, a & _MASK, b & _MASK]).standard_normal((q, draws))
    out = r0 @ normal(key, key) if r0.any() else np.zeros((q, draws))
    for other in map(int, near if r1.any() else ()):
        link = min(key, other), max(key, other)
        noise = known.pop(link, None)
        if noise is None:
            noise = known[link] = r1 @ normal(*link)
        out += noise if key < other else -noise
    return out


_MASK = (1 << 64) - 1


def neighbours(edges: DataFrame, area: str) -> DataFrame:
    """(area, near): hashes of the neighbours of each area."""
    return edges.groupBy(F.col("i").alias(area)).agg(F.collect_list(F.xxhash64("j")).alias("near"))


def perturbed(systems: DataFrame, edges: DataFrame, k1: np.ndarray, k0: np.ndarray | None = None, draws: int = 64, seed: int = 7) -> DataFrame:
    """``systems`` with ``draws`` right-hand sides more: solved, they are draws from the
    Gaussian with the system's matrix as precision around the solution of the first."""
    k1 = np.atleast_2d(np.asarray(k1, float))
    q = len(k1)
    area = next(c for c in systems.columns if c not in ("w", "b"))
    r1, r0 = root(k1), root(np.zeros((q, q)) if k0 is None else np.asarray(k0, float))

    def noisy(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                near = [] if r.near is None else list(r.near)
                noise = prior_noise(r.key, near, r1, r0, draws, seed)
                own = np.random.default_rng([seed + 1, r.key & _MASK]).standard_normal((q, draws))
                b = np.asarray(r.b, float).reshape(q, -1)
                noise += root(np.asarray(r.w, float).reshape(q, q)) @ own
                out.append(np.hstack([b, b[:, :1] + noise]).ravel())
            yield pdf[[area, "w"]].assign(b=out)

    rows = systems.withColumn("key", F.xxhash64(area)).join(neighbours(edges, area), area, "left")
    kind = systems.schema[area].dataType.simpleString()
    return rows.mapInPandas(noisy, f"{area} {kind}, w array<double>, b array<double>")


def marginal_variances(systems: DataFrame, edges: DataFrame, graph: Dealt, k1, k0=None, draws: int = 64, seed: int = 7, tol: float = 1e-8) -> DataFrame:
    """(area, x): the diagonal of the inverse, q values per area.

    In one block it is exact. In several it is the variance inside a block given the
    others, exact, and the variance of its mean over draws of the areas around it.
    """
    if graph.blocks <= 1:

        def diagonal(d: Block):
            return np.diag(np.linalg.inv(d.dense())).reshape(len(d.w), -1)

        return solve(systems, graph, k1, k0, then=diagonal).values
    sol = solve(perturbed(systems, edges, k1, k0, draws, seed), graph, k1, k0, tol)
    (area,) = (c for c in systems.columns if c not in ("w", "b"))
    kind = systems.schema[area].dataType.simpleString()

    def borders(d, names, x, schema):
        out = list(_sent(d, d.block, {"d": d, "names": names}, None, x[:, :, -draws:]))
        return pd.DataFrame(out, columns=["block", "source", "data", "sums"])

    def combined(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pickle.loads(pdf[pdf.source.isna()].iloc[0].data)
        d: Block = s["d"]
        pull = np.einsum("kl,nlm->nkm", d.k1, _around(pdf, d, (*d.w.shape[:2], draws)))
        a = np.linalg.inv(d.dense())
        mean = a @ pull.reshape(len(a), -1)
        x = np.diag(a) + mean.var(axis=1, ddof=1)
        return pd.DataFrame({area: s["names"], "x": list(x.reshape(len(d.w), -1))})

    return sol.run(borders, _STATE).groupBy("block").applyInPandas(combined, f"{area} {kind}, x array<double>")


class _Coarse:
    """The system of block means; one q x q matrix per block and per pair of neighbours."""

    def __init__(self, parts: Sequence, number: dict, k1: np.ndarray, q: int):
        self.shape = (len(parts), q)
        self.own = np.array([p[0] for p in parts])
        near = [(k, number[b], c) for k, p in enumerate(parts) for b, c in p[1].items()]
        self.i, self.j, self.c = (np.array(x) for x in zip(*near)) if near else (np.zeros(0, int),) * 3
        self.k1 = k1
        self.inverse = None
        if len(parts) * q <= COARSE:
            a = np.zeros((len(parts), len(parts), q, q))
            a[np.arange(len(parts)), np.arange(len(parts))] = self.own
            np.subtract.at(a, (self.i, self.j), self.c[:, None, None] * k1 if len(self.c) else np.zeros((0, q, q)))
            self.inverse = np.linalg.pinv(a.transpose(0, 2, 1, 3).reshape(len(parts) * q, -1), hermitian=True)
        else:
            self.diagonal = np.linalg.pinv(self.own, hermitian=True)

    def times(self, x: np.ndarray) -> np.ndarray:
        out = np.einsum("nkl,nlm->nkm", self.own, x)
        np.subtract.at(out, self.i, self.c[:, None, None] * np.einsum("kl,nlm->nkm", self.k1, x[self.j]))
        return out

    def solved(self, b: np.ndarray) -> np.ndarray:
        if self.inverse is not None:
            return (self.inverse @ b.reshape(self.inverse.shape[0], -1)).reshape(b.shape)
        x, r = np.zeros_like(b), b.copy()
        p = z = np.einsum("nkl,nlm->nkm", self.diagonal, r)
        g, limit = (r * z).sum((0, 1)), 1e-24 * np.maximum((b * b).sum((0, 1)), 1e-300)
        for _ in range(20_000):
            if ((r * r).sum((0, 1)) <= limit).all():
                break
            s = self.times(p)
            d = (p * s).sum((0, 1))
            a = np.divide(g, d, out=np.zeros_like(g), where=d > 0)
            x, r = x + a * p, r - a * s
            z = np.einsum("nkl,nlm->nkm", self.diagonal, r)
            h = (r * z).sum((0, 1))
            p, g = z + np.divide(h, g, out=np.zeros_like(g), where=g > 0) * p, h
        return x
