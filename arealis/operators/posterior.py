"""Tables derived from posterior summaries, densities and draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import as_col, ratio
from .ranks import exact_quantiles


def unstack(effects: DataFrame, row: str, n_areas: int, n_years: int, layout: str = "block") -> DataFrame:
    """Split a 0-based effect row number into (block, year_index, area_index).

    ``block``: all years of block 0, then block 1. ``interleaved``: inside each
    year the two blocks follow each other. Area runs fastest in both.
    """
    r = F.col(row)
    unit = F.floor(r / n_areas)
    if layout == "block":
        block, yr = F.floor(unit / n_years), F.pmod(unit, F.lit(n_years))
    elif layout == "interleaved":
        block, yr = F.pmod(unit, F.lit(2)), F.floor(unit / 2)
    else:
        raise ValueError("layout must be 'block' or 'interleaved'")
    return effects.select(
        "*",
        block.cast("int").alias("block"),
        yr.cast("int").alias("year_index"),
        F.pmod(r, F.lit(n_areas)).cast("long").alias("area_index"),
    )


def combine_blocks(unstacked: DataFrame, value: str, keys: Sequence[str] = ("area_index", "year_index")) -> DataFrame:
    """Structured plus unstructured part: the sum over blocks per area and year."""
    return unstacked.groupBy(*keys).agg(F.sum(value).alias(value))


def add_fixed(effects: DataFrame, value: str, fixed: DataFrame, term: str, estimate: str = "estimate") -> DataFrame:
    """Add one fixed coefficient, read from a (term, estimate) table, to each effect."""
    b = fixed.where(F.col("term") == term).agg(F.max(estimate)).scalar()
    return effects.select(*[(F.col(c) + b).alias(c) if c == value else F.col(c) for c in effects.columns])


def apply_combinations(selectors: DataFrame, effects: DataFrame, value: str = "mean") -> DataFrame:
    """Means of linear combinations: selectors (effect, i, j, v) times effects
    (effect, j, value), summed by row."""
    e = effects.select("effect", "j", F.col(value).alias("_m"))
    return selectors.join(e, ["effect", "j"]).groupBy("i").agg(F.sum(F.col("v") * F.col("_m")).alias(value))


def select_effect(effects: DataFrame, n_areas: int, year: int | None = None, area: str = "area_index", year_col: str = "year_index") -> DataFrame:
    """Effects of one year, or of all. Refuses a purely temporal effect, which has
    fewer distinct areas than the map."""
    seen = effects.agg(F.count_distinct(area)).first()[0]
    if seen < n_areas:
        raise ValueError("the effect has no value per area; a temporal effect cannot be mapped")
    return effects if year is None else effects.where(F.col(year_col) == year)


def expand_years(area_effects: DataFrame, first: int, last: int, year: str = "year") -> DataFrame:
    """Repeat an area-only effect for every year."""
    return area_effects.select("*", F.explode(F.sequence(F.lit(first), F.lit(last))).alias(year))


def map_table(effects: DataFrame, areas: DataFrame, base_year: int, value: str = "mean") -> DataFrame:
    """(geoid, year, value) for all years by one join on the area index."""
    return effects.join(areas, "area_index").select(
        "geoid", (F.col("year_index") + F.lit(base_year)).alias("year"), value
    )


def exceedance_from_density(density: DataFrame, by: Sequence[str], threshold: float = 0.0, upper: bool = False) -> DataFrame:
    """P(x < threshold) per effect from points (x, density) of its curve.

    Trapezoid rule; the interval that holds the threshold is cut linearly.
    ``upper`` gives the complement. The points of one curve are a fixed-size grid,
    so the ordered window stays small.
    """
    w = W.partitionBy(*by).orderBy("x")
    x0, f0 = F.col("x") - threshold, F.col("density")
    x1, f1 = F.lead("x").over(w) - threshold, F.lead("density").over(w)
    seg = density.select(*by, x0.alias("x0"), f0.alias("f0"), x1.alias("x1"), f1.alias("f1")).where("x1 is not null")
    whole = (F.col("x1") - F.col("x0")) * (F.col("f0") + F.col("f1")) / 2
    at0 = F.col("f0") - F.col("x0") * ratio(F.col("f1") - F.col("f0"), F.col("x1") - F.col("x0"))
    left = (
        F.when(F.col("x1") <= 0, whole)
        .when(F.col("x0") >= 0, F.lit(0.0))
        .otherwise(-F.col("x0") * (F.col("f0") + at0) / 2)
    )
    p = ratio(F.sum(left), F.sum(whole))
    return seg.groupBy(*by).agg((F.lit(1.0) - p if upper else p).alias("p"))


def exceedance_from_draws(draws: str | Column, threshold: float = 0.0, upper: bool = False) -> Column:
    """Share of an array of draws below (or not below) the threshold."""
    a = as_col(draws)
    hits = F.size(F.filter(a, lambda x: (x >= threshold) if upper else (x < threshold)))
    return ratio(hits, F.size(a))


# class limits used on the probability maps (fixed values)
PROBABILITY_BREAKS_7 = (0, 0.05, 0.2, 0.5, 0.8, 0.95, 1)
PROBABILITY_BREAKS_5 = (0, 0.2, 0.5, 0.8, 1)


def classify(c: str | Column, breaks: Sequence[float | Column]) -> Column:
    """0-based class between sorted breaks, left-closed; the last class is closed
    on both sides. NULL outside the breaks. End points may be columns."""
    c = as_col(c)
    lits = [b if isinstance(b, Column) else F.lit(float(b)) for b in breaks]
    last = len(lits) - 2
    out = None
    for k in range(last + 1):
        upper = (c <= lits[k + 1]) if k == last else (c < lits[k + 1])
        cond = (c >= lits[k]) & upper
        out = F.when(cond, F.lit(k)) if out is None else out.when(cond, F.lit(k))
    return out


def effect_bands(draws: DataFrame, value: str, by: Sequence[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Mean and exact quantile band of long draws per group."""
    bands = exact_quantiles(draws, value, {"q_low": low, "q_high": high}, by)
    means = draws.groupBy(*by).agg(F.avg(value).alias("mean"))
    return means.join(bands, list(by))


def residuals(observed: DataFrame, fitted: DataFrame, on: Sequence[str], outcome: str, prediction: str = "fitted") -> DataFrame:
    """Observed minus fitted, by key."""
    return observed.join(fitted, list(on)).select(
        *on, outcome, prediction, (F.col(outcome) - F.col(prediction)).alias("residual")
    )


def accuracy(df: DataFrame, truth: str, rate: str, population: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """MAPE (percent), MSE, RMSE and MAE; the prediction is rate times population."""
    pred = F.col(rate) if population is None else F.col(rate) * F.col(population)
    d = F.col(truth) - pred
    return df.groupBy(*by).agg(
        F.avg(100 * F.abs(ratio(d, truth))).alias("mape"),
        F.avg(d * d).alias("mse"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(F.abs(d)).alias("mae"),
    )
