"""Helpers shared by the operators: tables, checkpoints, samples, groups, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASHES = 1 << 62
SALTS = 64
#: Bytes of text that become Python objects at once.
SLICE = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and go on from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only
    where that is unset (a local session) a folder of its own is used.
    """
    return in_checkpoint_dir(df.sparkSession) and df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``stored()``, as a compressed table: for wide rows of which few columns are read."""
    spark = df.sparkSession
    path = f"{in_checkpoint_dir(spark)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int = 7) -> DataFrame:
    """About ``rows`` rows (all, if there are fewer), chosen by a hash of ``key``."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(HASHES)) < sample_bound(rows, n))


def sample_bound(rows: int, n: int) -> int:
    """Hashes below it, of ``HASHES``, keep about ``rows`` of ``n`` rows at every size."""
    return HASHES * rows // n


def column_map(fn: Callable[[list], list], kind: T.DataType, setup: Callable[[], object] | None = None):
    """An Arrow column function over whole texts: ``fn(list[str | None], state)``.

    ``setup`` builds what a worker needs once for all its batches.
    """
    arrow = _arrow(kind)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        state = setup() if setup else None
        for a in batches:
            some = (a.slice(i, j - i).to_pylist() for i, j in text_slices(a))
            parts = [pa.array(fn(texts, state) if setup else fn(texts), type=arrow) for texts in some]
            yield pa.concat_arrays(parts) if parts else pa.array([], arrow)

    return run


def text_slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` bytes of text; a longer text is one of its own."""
    if not len(texts):
        return
    total = np.cumsum(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(total):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Cut a stream sorted by ``keys`` into tables of whole groups.

    Yields (table, starts): at least ``rows`` rows except at the end, and the
    first row of every group. Only the groups of one table are in memory.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        starts = group_starts(t, keys)
        if len(starts) > 1:
            last = int(starts[-1])
            yield t.slice(0, last), starts[:-1]
            held = t.slice(last).to_batches()
            n -= last
    if held:
        t = pa.Table.from_batches(held)
        yield t, group_starts(t, keys)


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def salted_lookup(rows: DataFrame, on: list[str], found: DataFrame, salts: int = SALTS) -> DataFrame:
    """``rows`` with the columns of ``found`` (one row per key), null where there is none.

    Many rows may ask for one key: they ask under one of ``salts`` numbers, and what
    is looked up are the distinct questions. ``rows`` is read twice.
    """
    rest = [c for c in rows.columns if c not in on]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int"))
    asked = salted.select(*on, "_salt").distinct().join(found, on)
    return salted.join(asked, [*on, "_salt"], "left").drop("_salt")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each of ``n`` nodes over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            return root
        root = new


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Table (node, root) for all nodes of ``edges(a, b)``: root is the smallest
    node reachable. Large-star and small-star steps alternate until the links no
    longer change; every step is an aggregate and an equi-join.
    """
    e = stored(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = None
    for _ in range(rounds):
        mark = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or not mark[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = mark
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(low, "a")
        e = stored(
            near.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
    raise RuntimeError(f"components: not settled after {rounds} rounds")
