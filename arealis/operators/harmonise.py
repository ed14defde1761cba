"""Boundary crosswalks, year backfill, price indices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_col, ratio, strict_weighted_mean
from .ranks import with_group_totals


def crosswalk(
    df: DataFrame,
    cw: DataFrame,
    values: Sequence[str],
    source: str = "geoid00",
    target: str = "geoid10",
    pop: str = "pop00",
    pct: str = "poppct00",
    whole: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Carry values from old to new areas as population-weighted means.

    Full join, so areas missing on one side stay visible; the weight is
    ``pop * pct / 100`` and one unknown term makes the mean of its target NULL.
    ``whole=True`` floors the result (counts). ``by`` keeps further keys such as
    year and cause: every link of the crosswalk counts under each of the keys that
    occur, so a source area without a row under a key is an unknown term there.
    The distinct keys (not the rows) travel as one array.
    """
    weight = F.col(pop) * F.col(pct) / F.lit(100.0)
    if by:
        keys = df.agg(F.collect_set(F.struct(*by))).scalar()
        cw = cw.withColumn("_k", F.explode(keys)).select(*cw.columns, *[F.col("_k")[k].alias(k) for k in by])
    joined = df.join(cw, [source, *by], "full")
    aggs = []
    for v in values:
        m = strict_weighted_mean(F.col(v), weight)
        aggs.append((F.floor(m) if whole else m).alias(v))
    return joined.groupBy(target, *by).agg(*aggs)


def backfill_years(df: DataFrame, source_year: int, targets: Sequence[int], year: str = "year", inclusive: bool = True) -> DataFrame:
    """Copy the rows of one year to earlier years.

    Rows of ``source_year`` appear once for every target and, if ``inclusive``,
    for the source year too; later years pass through and earlier ones drop.
    One explode, so the table is read once whatever the number of targets.
    """
    years = sorted({*targets, *([source_year] if inclusive else [])})
    spread = F.when(F.col(year) == source_year, F.array(*[F.lit(y) for y in years])).otherwise(
        F.array(F.col(year).cast("int"))
    )
    rest = [c for c in df.columns if c != year]
    return df.where(F.col(year) >= source_year).select(*rest, F.explode(spread).alias(year)).select(*df.columns)


def stack_years(frames: Mapping[int, DataFrame], year: str = "year") -> DataFrame:
    """Tag each table with its year and stack; columns missing in one are NULL."""
    tagged = [f.withColumn(year, F.lit(y)) for y, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def price_index(df: DataFrame, base_year: int, year: str = "year", value: str = "value", name: str = "index") -> DataFrame:
    """Index by year: the base year's value over the year's value."""
    base = df.where(F.col(year) == base_year).agg(F.max(value)).scalar()
    return df.select(year, ratio(base, F.col(value)).alias(name))


def relative_to_base(df: DataFrame, key: Sequence[str], base_year: int, year: str, value: str, name: str) -> DataFrame:
    """Series over its own group's base-year value."""
    base = {"_base": F.max(F.when(F.col(year) == base_year, F.col(value)))}
    return with_group_totals(df, key, base).select(*df.columns, ratio(value, "_base").alias(name))


def deflate(value: str | Column, year: str | Column, index: Mapping[int, float]) -> Column:
    """``value / index * 100`` for the listed price years, unchanged otherwise."""
    value, year = as_col(value), as_col(year)
    out = None
    for y, i in index.items():
        v = value / F.lit(float(i)) * 100
        out = F.when(year == y, v) if out is None else out.when(year == y, v)
    return value if out is None else out.otherwise(value)


# Price levels of the covariate years (fixed values).
PRICE_LEVEL = {1990: 76.90, 2010: 125.96}


def fill_first_known(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Missing values take the group's first known value in ``order``."""
    known = F.when(F.col(value).isNotNull(), F.col(order))
    filled = with_group_totals(df, by, {"_first": F.min_by(value, known)})
    return filled.select(*[(F.coalesce(c, "_first") if c == value else F.col(c)).alias(c) for c in df.columns])
