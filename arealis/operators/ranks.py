"""Exact order statistics without a single-task sort.

A window ordered over a whole table, or ``percentile`` on a hot group, puts an
unbounded group into one task. Here the distinct values are counted first (map
side), range-partitioned by (group, value), and every partition only needs the
totals of the partitions before it. Ties, a value that holds a third of the
rows, and one dominating group cost no more than any other input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared checkpoint folder of the session.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    return _without_vast_size(df.checkpoint(eager=True))


def _without_vast_size(df: DataFrame) -> DataFrame:
    """``df``, a checkpoint, without Spark's estimate of its size if that is beyond all tables.

    A join's estimate is the product of its sides, and a checkpoint keeps it. In a loop its
    digits would multiply with every round, to millions of them in the driver. Without an
    estimate Spark takes the largest long, which decides all plans as the vast one did.
    """
    spark = df.sparkSession
    plan = df._jdf.queryExecution().optimizedPlan()
    size = plan.stats().simpleString().split(",")[0]
    if not ("EiB" in size or "E+" in size):  # as text, from 2^61 bytes on
        return df
    none = spark._jvm.scala.Option.empty()
    rows = spark._jvm.org.apache.spark.sql.execution.LogicalRDD(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none, spark._jsparkSession, none, none
    )
    return type(df)(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, rows), spark)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]):
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def cumulative_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group and distinct value: ``n``, ``cum`` (rows up to and with the
    value) and ``total`` (rows of the group). NULL values are left out.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    # The partition number is stored with the rows, so a lost executor cannot
    # give a row another number than the one the totals were built from.
    placed = reliable_checkpoint(
        counts.repartitionByRange(_partitions(df), *by, value).withColumn("_part", F.spark_partition_id())
    )
    part = placed.groupBy(*by, "_part").agg(F.sum("n").alias("_in_part"))
    ordered = W.partitionBy(*by).orderBy("_part")
    offsets = part.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)],
        F.col("_part").alias("_p"),
        (F.sum("_in_part").over(ordered) - F.col("_in_part")).alias("_before"),
        F.sum("_in_part").over(W.partitionBy(*by)).alias("total"),
    )
    cond = placed["_part"] == offsets["_p"]
    for i, c in enumerate(by):
        cond = cond & placed[c].eqNullSafe(offsets[f"_k{i}"])
    inside = W.partitionBy("_part", *by).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return placed.join(offsets, cond).select(
        *[placed[c] for c in by],
        placed[value],
        placed["n"],
        (F.col("_before") + F.sum("n").over(inside)).alias("cum"),
        "total",
    )


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles (the usual default definition) per group.

    ``probs`` maps an output column to its probability.
    """
    by = list(by)
    c = cumulative_counts(df, value, by)
    aggs, outs = [], []
    for name, p in probs.items():
        pos = (F.col("total") - 1) * F.lit(float(p))
        aggs += [
            F.min(F.when(F.col("cum") > F.floor(pos), F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("cum") > F.ceil(pos), F.col(value))).alias(f"_hi_{name}"),
            F.max(pos - F.floor(pos)).alias(f"_fr_{name}"),
        ]
        lo, hi, fr = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_fr_{name}")
        outs.append((lo + (hi - lo) * fr).alias(name))
    return c.groupBy(*by).agg(*aggs).select(*by, *outs)


def dense_index(df: DataFrame, key: str, index: str, start: int = 1) -> DataFrame:
    """Table (key, index): consecutive numbers over the sorted distinct keys."""
    c = cumulative_counts(df.select(key).distinct(), key)
    return c.select(key, (F.col("cum") - 1 + start).cast("long").alias(index))


def with_group_totals(df: DataFrame, by: Sequence[str], aggs: dict) -> DataFrame:
    """Attach group aggregates to every row.

    A two-phase aggregate joined back, not a window: a window would sort a hot
    group in one task. NULL group keys match themselves.
    """
    totals = df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()])
    renamed = totals.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], *aggs)
    cond = F.lit(True)
    for i, c in enumerate(by):
        cond = cond & df[c].eqNullSafe(renamed[f"_g{i}"])
    return df.join(renamed, cond, "left").select(*df.columns, *aggs)
