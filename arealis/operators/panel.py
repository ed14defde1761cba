"""Area-year panels: assembly, indexing and model-frame preparation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from .ranks import cumulative_counts, dense_index, exact_quantiles
from .reshape import to_long


def area_years(areas: DataFrame, first: int | Column, last: int | Column, year: str = "year") -> DataFrame:
    """Every area in every year of a range (an explode, not a cross join).

    The ends are numbers, or scalar subqueries such as those of ``year_range``.
    """
    first, last = (F.lit(y) if isinstance(y, int) else y for y in (first, last))
    return areas.select("*", F.explode(F.sequence(first, last)).alias(year))


def year_range(df: DataFrame, year: str = "year") -> tuple[Column, Column]:
    """First and last year of a table as scalar subqueries."""
    return df.agg(F.min(year)).scalar(), df.agg(F.max(year)).scalar()


def assemble_by_state(
    areas: DataFrame,
    covariates: DataFrame,
    outcomes: Mapping[str, DataFrame],
    area: str = "geoid",
    year: str = "year",
    state_chars: int = 2,
) -> DataFrame:
    """Panel of all covariate rows, with each state's own outcome table.

    ``outcomes`` maps a state prefix of the area id to its (area, year, ...)
    table. Rows of a state without an outcome table keep NULL outcomes; area
    attributes are NULL for covariate rows outside the area table.
    """
    prefix = F.substring(F.col(area), 1, state_chars)
    own = [o.where(prefix == s) for s, o in outcomes.items()]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own)
    return areas.join(covariates, area, "right").join(stacked, [area, year], "left")


def add_covariates(panel: DataFrame, tables: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Chain of left joins; each table comes with its explicit keys."""
    return reduce(lambda df, t: df.join(t[0], list(t[1]), "left"), tables, panel)


def area_index(df: DataFrame, area: str, index: str = "area_index", order: str = "sorted", year: str | None = None) -> DataFrame:
    """Table (area, index) numbered 1..n.

    ``sorted`` numbers the ids in order. ``first_seen`` numbers them by the first
    year in which they occur, ids in order within a year.
    """
    if order == "sorted":
        return dense_index(df, area, index)
    if order != "first_seen" or year is None:
        raise ValueError("order must be 'sorted', or 'first_seen' with a year column")
    key = df.groupBy(area).agg(F.min(year).alias("_y")).select(area, F.struct("_y", area).alias("_k"))
    ranked = cumulative_counts(key, "_k")
    return ranked.select(F.col("_k")[area].alias(area), F.col("cum").cast("long").alias(index))


def panel_keys(df: DataFrame, index: DataFrame, area: str, year: str, base_year: int, n_areas: int) -> DataFrame:
    """Add area index, year index, an area-year text key and the row ordinal.

    The ordinal is arithmetic (year-major, area fastest), so it needs no sort.
    """
    yi = F.col(year) - F.lit(base_year)
    return df.join(index, area).select(
        "*",
        yi.alias("year_index"),
        F.concat_ws("_", F.col("area_index"), yi).alias("area_year"),
        ((yi - 1) * F.lit(n_areas) + F.col("area_index")).cast("long").alias("row_ordinal"),
    )


def panel_frame(df: DataFrame, disease: str, base_year: int, area: str = "geoid", year: str = "year") -> DataFrame:
    """Rows of one cause after the base year, with index and key columns."""
    kept = df.where((F.col("disease") == disease) & (F.col(year) > base_year))
    index = dense_index(kept, area, "area_index")
    return panel_keys(kept, index, area, year, base_year, index.count())


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values of each numeric column become that column's median.

    The medians are exact and come from one long pass over all columns; only one
    number per column reaches the driver.
    """
    medians = exact_quantiles(to_long(df, [], columns), "value", {"median": 0.5}, ["name"]).collect()
    value = {r["name"]: r["median"] for r in medians}
    return df.select(
        *[
            F.coalesce(F.col(c).cast("double"), F.lit(value[c])).alias(c) if c in value else F.col(c)
            for c in df.columns
        ]
    )


def log_covariates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``log(x)``, or ``log(x + 1)`` for a column whose minimum is 0."""
    low = df.agg(F.struct(*[F.min(c).alias(c) for c in columns])).scalar()
    return df.select(
        *[
            F.when(low.getField(c) == 0, F.log(F.col(c) + 1)).otherwise(F.log(F.col(c))).alias(c)
            if c in columns
            else F.col(c)
            for c in df.columns
        ]
    )


def zscore(df: DataFrame, columns: Sequence[str], population: bool = False) -> DataFrame:
    """Centre and scale by the sample (or population) standard deviation.

    A constant column becomes NULL.
    """
    sd = F.stddev_pop if population else F.stddev_samp
    stats = df.agg(F.struct(*[F.struct(F.avg(c).alias("m"), sd(c).alias("s")).alias(c) for c in columns])).scalar()
    return df.select(
        *[
            ratio(F.col(c) - stats.getField(c).getField("m"), stats.getField(c).getField("s")).alias(c)
            if c in columns
            else F.col(c)
            for c in df.columns
        ]
    )


def model_frame(
    df: DataFrame,
    outcome: str,
    covariates: Sequence[str],
    log_outcome: bool = False,
    log_all: bool = False,
    standardize: bool = False,
) -> DataFrame:
    """Imputed, optionally logged and standardised copy of a panel.

    The outcome is standardised only when it is not logged.
    """
    out = impute_median(df, [outcome, *covariates])
    if log_outcome:
        out = out.withColumn(outcome, F.log(outcome))
        if log_all:
            out = log_covariates(out, covariates)
    if standardize:
        out = zscore(out, [*covariates, *([] if log_outcome else [outcome])])
    return out


def with_exposure(df: DataFrame, outcome: str, exposure: str, population: str) -> DataFrame:
    """Outcome and exposure chosen by name, and the log-population offset."""
    return df.select(
        "*",
        F.col(outcome).alias("outcome"),
        F.col(exposure).alias("exposure"),
        F.log(F.col(population)).alias("offset"),
    )
