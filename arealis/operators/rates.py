"""Counts by area and year, and directly standardised rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import COUNTED_FLAGS
from ..functions.numeric import per_unit, ratio, zero_sum
from .ranks import with_group_totals
from .reshape import pivot_codes, to_long

# US standard population, 2010 census: five-year bands (fixed values).
# band, all, male, female, ten-year band
STANDARD_POPULATION = [
    ("00_05", 20201362, 10319427, 9881935, "00_10"),
    ("05_10", 20348657, 10389638, 9959019, "00_10"),
    ("10_15", 20677194, 10579862, 10097332, "10_20"),
    ("15_20", 22040343, 11303666, 10736677, "10_20"),
    ("20_25", 21585999, 11014176, 10571823, "20_30"),
    ("25_30", 21101849, 10635591, 10466258, "20_30"),
    ("30_35", 19962099, 9996500, 9965599, "30_40"),
    ("35_40", 20179642, 10042022, 10137620, "30_40"),
    ("40_45", 20890964, 10393977, 10496987, "40_50"),
    ("45_50", 22708591, 11209085, 11499506, "40_50"),
    ("50_55", 22298125, 10933274, 11364851, "50_60"),
    ("55_60", 19664805, 9523648, 10141157, "50_60"),
    ("60_65", 16817924, 8077500, 8740424, "60_70"),
    ("65_70", 12435263, 5852547, 6582716, "60_70"),
    ("70_75", 9278166, 4243972, 5034194, "70_80"),
    ("75_80", 7317795, 3182388, 4135407, "70_80"),
    ("80_85", 5743327, 2294374, 3448953, "80_Inf"),
    ("85_Inf", 5493433, 1789679, 3703754, "80_Inf"),
]


def flag_counts(df: DataFrame, by: Sequence[str], flags: Mapping[str, str] = COUNTED_FLAGS) -> DataFrame:
    """Sum of each 0/1 flag per group; NULL flags count as 0."""
    return df.groupBy(*by).agg(*[zero_sum(f).cast("long").alias(n) for f, n in flags.items()])


def flag_summary(
    df: DataFrame,
    by: Sequence[str],
    age: str,
    mean_age_of: Mapping[str, str],
    flags: Mapping[str, str] = COUNTED_FLAGS,
) -> DataFrame:
    """Flag sums plus the mean age of the flagged records, in one pass.

    ``mean_age_of`` maps a flag to its output column. Rows of unknown age (NULL)
    add to the counts but, as in the study, only to the divisor of the mean.
    """
    means = [
        ratio(zero_sum(F.col(age) * F.col(f)), zero_sum(f)).alias(n) for f, n in mean_age_of.items()
    ]
    return df.groupBy(*by).agg(*[zero_sum(f).cast("long").alias(n) for f, n in flags.items()], *means)


def summarise(df: DataFrame, by: Sequence[str], columns: Sequence[str], fn) -> DataFrame:
    """The same aggregate over several columns."""
    return df.groupBy(*by).agg(*[fn(c).alias(c) for c in columns])


def standard_population(spark: SparkSession) -> DataFrame:
    """The fixed table as a local relation: the planner knows its exact size."""
    names = ["agegroup", "n_all", "n_male", "n_female", "newgroup"]
    return spark.createDataFrame(pa.table(dict(zip(names, map(list, zip(*STANDARD_POPULATION))))))


def regroup_bands(std: DataFrame, columns: Sequence[str] = ("n_all", "n_male", "n_female")) -> DataFrame:
    """Five-year bands summed to the ten-year bands named in ``newgroup``."""
    return summarise(std, ["newgroup"], columns, F.sum).withColumnRenamed("newgroup", "agegroup")


def share_of_group(df: DataFrame, by: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Each value over its group total; maps column -> output column."""
    totals = {f"_t_{c}": F.sum(c) for c in columns}
    return with_group_totals(df, by, totals).select(
        *df.columns, *[ratio(c, f"_t_{c}").alias(o) for c, o in columns.items()]
    )


def standard_weights(std10: DataFrame, columns: Sequence[str] = ("n_all", "n_male", "n_female")) -> DataFrame:
    """Population columns turned into weights that each sum to 1."""
    long = to_long(std10, ["agegroup"], columns)
    shares = share_of_group(long, ["name"], {"value": "weight"})
    return pivot_codes(shares, ["agegroup"], columns, name="name", value="weight")


def age_specific_rates(
    population: DataFrame,
    counts: DataFrame,
    weights: DataFrame,
    on: Sequence[str],
    count_columns: Sequence[str],
    band: str = "agegroup",
    pop: str = "tpop",
    per: float = 1e5,
) -> DataFrame:
    """Rate per 100,000 for every population cell; a cell without records has 0."""
    joined = population.join(counts, list(on), "left").join(weights, band, "left")
    filled = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in count_columns]
    rest = [F.col(c) for c in joined.columns if c not in count_columns]
    base = joined.select(*rest, *filled)
    return base.select("*", *[per_unit(c, pop, per).alias("r_" + c.removeprefix("n_")) for c in count_columns])


def standardised_rates(
    band_rates: DataFrame, by: Sequence[str], rates: Sequence[str], weight: str = "n_all"
) -> DataFrame:
    """Directly standardised rate: sum of band rate times standard weight."""
    return band_rates.groupBy(*by).agg(*[zero_sum(F.col(r) * F.col(weight)).alias(r) for r in rates])


def total_counts(band_rates: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """All-age counts from the counts by band."""
    return summarise(band_rates, by, columns, zero_sum)


# Sex-by-age cells of census table B01001 that make up each band (fixed layout).
AGE_CELLS_5 = {
    "00_05": (3, 27),
    "05_10": (4, 28),
    "10_15": (5, 29),
    "15_20": (6, 7, 30, 31),
    "20_25": (8, 9, 10, 32, 33, 34),
    "25_30": (11, 35),
    "30_35": (12, 36),
    "35_40": (13, 37),
    "40_45": (14, 38),
    "45_50": (15, 39),
    "50_55": (16, 40),
    "55_60": (17, 41),
    "60_65": (18, 19, 42, 43),
    "65_70": (20, 21, 44, 45),
    "70_75": (22, 46),
    "75_80": (23, 47),
    "80_85": (24, 48),
    "85_Inf": (25, 49),
}


def age_cells(width: int = 10) -> dict[str, tuple[str, ...]]:
    """Band label -> cell codes, in five- or ten-year bands."""
    out: dict[str, list[str]] = {}
    regroup = {five: ten for five, *_, ten in STANDARD_POPULATION}
    for band, cells in AGE_CELLS_5.items():
        key = band if width == 5 else regroup[band]
        out.setdefault(key, []).extend(f"B01001_{n:03d}" for n in cells)
    return {k: tuple(v) for k, v in out.items()}


def band_population(census: DataFrame, keys: Sequence[str], width: int = 10) -> DataFrame:
    """Population by age band from long sex-by-age cells (keys, variable, estimate).

    Every band has a row. A band with a missing or NULL cell is NULL, as a sum of
    columns would be.
    """
    totals = []
    for band, cells in age_cells(width).items():
        own = F.when(F.col("variable").isin(*cells), F.col("estimate"))
        total = F.when(F.count(own) == len(cells), F.sum(own))
        totals.append(F.struct(F.lit(band).alias("agegroup"), total.alias("tpop")))
    return census.groupBy(*keys).agg(F.array(*totals).alias("_t")).select(*keys, F.inline("_t"))


def expected_counts(
    df: DataFrame,
    outcome: str,
    population: str,
    by: Sequence[str] = ("year",),
    base: str = "population",
    name: str = "expected",
) -> DataFrame:
    """Expected count: ``base`` times the group's overall rate.

    ``base='population'`` is the usual definition, ``'outcome'`` multiplies the
    outcome itself by the rate.
    """
    if base not in ("population", "outcome"):
        raise ValueError("base must be 'population' or 'outcome'")
    chosen: Column = F.col(population if base == "population" else outcome)
    totals = with_group_totals(df, by, {"_o": F.sum(outcome), "_p": F.sum(population)})
    return totals.select(*df.columns, (chosen * ratio("_o", "_p")).alias(name))
