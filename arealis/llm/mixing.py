"""Mixing sources to target weights by capped water-filling.

Every source has a weight; the words of the mix are shared by weight, but no
source gives more than ``max_epochs`` times its words, and what it can't give is
shared again among the others. Over sources sorted by words per weight the level
at which that settles is a running sum, so no loop is needed. A source then gives
all its documents as many whole times as its target holds, and of the rest a
seeded sample: documents in the order of a hash until the words are reached; the
document at that edge gives only as many words as are left.

The running sum over a source is done by hash bucket first and document by
document only inside the one bucket where it ends, so a source that holds a third
of all rows is never sorted in one task.

A null text has no words and is never taken; a null source is a source of its
own, after all others. Repeated ids are separate documents with the same hash:
they are ordered by size, and equal ones at the edge share its words. With no
documents the result is empty. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Sources whose plan is sent to every task.
SENT = 20_000


def word_count(text: str) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; a null text has none."""
    flat = F.translate(F.col(text), "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(flat, " "), "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sizes(_source, source_size)`` with the ``target`` words of each source.

    One row per source, so its windows see as many rows as there are sources.
    """
    order = W.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")
    )
    cap = F.col("source_size") * F.lit(float(max_epochs))
    rising = W.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    everything = W.partitionBy()
    filled = (
        sizes.withColumn("_w", weight)
        .withColumn("_cap", cap)
        .withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_below", F.sum("_cap").over(rising.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("_above", F.sum("_w").over(rising.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_level", (F.col("_all") - F.coalesce("_below", F.lit(0.0))) / F.col("_above"))
        # The level rises up to the first source that stays below its cap, then falls.
        .withColumn("_level", F.max(F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.col("_level"))).over(everything))
    )
    free = F.col("_level") * F.col("_w")
    return filled.select(
        "_source", "source_size", F.when(F.col("_level").isNull() | (free > F.col("_cap")), F.col("_cap")).otherwise(free).alias("target")
    )


def repetitions(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size_col: str | None = None,
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
    seed: str = SEED,
    digits: int = 3,
) -> DataFrame:
    """``docs`` with ``__size``, ``__source_size``, ``__target``, ``__times`` (how
    often the mix takes the whole document) and ``__words`` (taken besides). ``digits``: hexadecimal digits of the
    hash that make a bucket. ``size_col``: a column that holds the sizes already."""
    sized = docs.withColumns(
        {
            "__size": F.col(size_col) if size_col else word_count(text_col),
            "__hash": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))),
        }
    ).withColumn("__bucket", F.substring("__hash", 1, digits))
    light = stored(sized.select(F.col(source_col).alias("_source"), "__size", "__hash", "__bucket"))
    buckets = light.groupBy("_source", "__bucket").agg(F.sum("__size").alias("_words"))
    wanted = targets(buckets.groupBy("_source").agg(F.sum("_words").alias("source_size")), weights, share, max_epochs)
    wanted = wanted.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))).withColumn(
        "_part", F.floor(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long")
    )
    # Where the running sum of the buckets passes the part, the sample ends.
    run = W.partitionBy("_source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, 0)
    ends = (
        buckets.withColumn("_upto", F.sum("_words").over(run))
        .join(_named(wanted, "w_"), F.col("_source").eqNullSafe(F.col("w__source")))
        .where((F.col("_upto") > F.col("w__part")) & (F.col("_upto") - F.col("_words") <= F.col("w__part")))
        .select(
            F.col("_source").alias("e_source"), F.col("__bucket").alias("e_bucket"), (F.col("_upto") - F.col("_words")).alias("e_before")
        )
    )
    plan = _sent(_named(wanted, "w_").join(ends, F.col("w__source").eqNullSafe(F.col("e_source")), "left").drop("e_source"))
    inside = W.partitionBy("_source").orderBy("__hash", "__size").rangeBetween(W.unboundedPreceding, W.currentRow)
    equal = F.count(F.lit(1)).over(W.partitionBy("_source", "__hash", "__size"))
    edge = (
        light.join(plan, F.col("_source").eqNullSafe(F.col("w__source")))
        .where(F.col("__bucket") == F.col("e_bucket"))
        .withColumn("_sum", F.col("e_before") + F.sum("__size").over(inside))
        .withColumn("_equal", equal)
        .where(F.col("_sum") > F.col("w__part"))
        .withColumn("_left", F.col("w__part") - F.col("_sum") + F.col("_equal") * F.col("__size"))
        .groupBy("_source")
        .agg(F.min(F.struct("__hash", "__size", F.floor(F.col("_left") / F.col("_equal")).alias("share"))).alias("_edge"))
        .select(F.col("_source").alias("n_source"), F.struct("_edge.__hash", "_edge.__size").alias("_edge"), F.col("_edge.share").alias("_share"))
    )
    plan = _sent(
        plan.join(edge, F.col("w__source").eqNullSafe(F.col("n_source")), "left").select(
            "w__source", "w_source_size", "w_target", "w__whole", "w__part", "e_bucket", "_edge", "_share"
        )
    )
    row = F.struct("__hash", "__size")
    drawn = (F.col("w__part") > 0) & (
        (F.col("__bucket") < F.col("e_bucket")) | ((F.col("__bucket") == F.col("e_bucket")) & (row < F.col("_edge")))
    )
    at_edge = (F.col("__bucket") == F.col("e_bucket")) & (row == F.col("_edge"))
    return sized.join(plan, F.col(source_col).eqNullSafe(F.col("w__source"))).select(
        *[F.col(f"`{c}`") for c in docs.columns],
        "__size",
        F.col("w_source_size").alias("__source_size"),
        F.col("w_target").alias("__target"),
        F.when(F.col("__size") > 0, F.col("w__whole") + F.when(drawn, 1).otherwise(0)).otherwise(0).cast("int").alias("__times"),
        F.when((F.col("__size") > 0) & at_edge, F.col("_share")).otherwise(0).cast("long").alias("__words"),
    )


def _sent(plan: DataFrame) -> DataFrame:
    """One row per source: sent to every task if its counted rows are few, so that
    no document moves; else joined as it is."""
    plan = stored(plan)
    return F.broadcast(plan) if plan.count() <= SENT else plan


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it, with its own columns.

    Whole documents only: the one at the edge comes if half of it is taken.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"),
    )
    edge = (F.col("__words") > 0) & (2 * F.col("__words") >= F.col("__size"))
    return (
        repetitions(rows, "id", "text", source_col="source", **options)
        .withColumn("__times", F.col("__times") + F.when(edge, 1).otherwise(0))
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.when(F.col("__times") > 0, F.col("__times")))))
        .select("doc.*")
    )


# The same mix as one statement: md5 gives both engines the same order.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
         source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM src),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM weighed),
leveled AS (SELECT *, max(CASE WHEN lv * w < cap THEN lv END) OVER () AS level FROM levels),
goal AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM (
    SELECT source, source_size, CASE WHEN level IS NULL OR level * w > cap THEN cap ELSE level * w END AS target FROM leveled)),
parts AS (SELECT *, floor(target - whole * source_size)::BIGINT AS part FROM goal),
runs AS (
  SELECT s.*, p.source_size, p.target, p.whole, p.part,
         sum(size) OVER (PARTITION BY s.source ORDER BY h, size) AS upto,
         size * count(*) OVER (PARTITION BY s.source, h, size) AS equal_words,
         count(*) OVER (PARTITION BY s.source, h, size) AS equal
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * whole + CASE WHEN upto <= part THEN size WHEN upto - equal_words < part THEN (part - (upto - equal_words)) // equal ELSE 0 END)::BIGINT AS taken
FROM runs
"""
