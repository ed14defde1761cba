"""Census-style long tables: pivots, unpivots and percentage shares."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import suffix_columns
from ..functions.numeric import add_all, ratio


def pivot_codes(df: DataFrame, keys: Sequence[str], codes: Sequence[str], name: str = "variable", value: str = "estimate") -> DataFrame:
    """Long to wide with an explicit code list (no extra job to find the codes).

    One value per cell is expected; of a duplicated cell the smallest is kept so
    that the result does not depend on row order.
    """
    return df.groupBy(*keys).agg(*[F.min(F.when(F.col(name) == c, F.col(value))).alias(c) for c in codes])


def estimates_and_margins(df: DataFrame, keys: Sequence[str], codes: Sequence[str], suffix: str = "_moe") -> tuple[DataFrame, DataFrame]:
    """Two wide tables from one long one: estimates, and margins with a suffix."""
    est = pivot_codes(df, keys, codes, value="estimate")
    moe = suffix_columns(pivot_codes(df, keys, codes, value="moe"), keys, suffix)
    return est, moe


def to_long(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """Wide to long; all value columns are read as doubles."""
    wide = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in values])
    return wide.unpivot(list(keys), list(values), name, value)


def codes_for_year(df: DataFrame, old: Sequence[str], new: Sequence[str], last_old: int, year: str = "year", name: str = "variable") -> DataFrame:
    """Keep the codes that are valid in the row's year: ``old`` up to and with
    ``last_old``, ``new`` afterwards."""
    return df.where(
        F.when(F.col(year) <= last_old, F.col(name).isin(list(old))).otherwise(F.col(name).isin(list(new)))
    )


def share(numerators: Sequence[str | Column], denominators: Sequence[str | Column]) -> Column:
    """``100 * sum(numerators) / sum(denominators)``; a NULL term gives NULL."""
    return ratio(F.lit(100.0) * add_all(list(numerators)), add_all(list(denominators)))


@dataclass(frozen=True)
class Share:
    """A percentage defined by census cells; ``complement`` means 100 minus it."""

    numerators: tuple[str, ...]
    denominators: tuple[str, ...]
    complement: bool = False

    def cells(self) -> tuple[str, ...]:
        return self.numerators + self.denominators

    def column(self) -> Column:
        if not self.complement:
            return share(self.numerators, self.denominators)
        den = add_all(list(self.denominators))
        return ratio(F.lit(100.0) * (den - add_all(list(self.numerators))), den)


def _cells(table: str, numbers: Sequence[int]) -> tuple[str, ...]:
    return tuple(f"{table}_{n:03d}" for n in numbers)


# Percentages fixed by the census table layouts.
CENSUS_SHARES: dict[str, Share] = {
    "p_nonwhite": Share(_cells("B01001A", [1]), _cells("B01001", [1]), complement=True),
    "p_elderly": Share(_cells("B01001", [*range(20, 26), *range(44, 50)]), _cells("B01001", [1])),
    "p_youngadult": Share(_cells("B01001", [*range(7, 11), *range(31, 35)]), _cells("B01001", [1])),
    "p_poverty": Share(_cells("B17001", [2]), _cells("B17001", [1])),
    "p_edubac": Share(_cells("B15002", [*range(15, 19), *range(32, 36)]), _cells("B15002", [1])),
    "p_renter": Share(_cells("B25003", [3]), _cells("B25003", [1])),
    "p_vacant": Share(_cells("B25004", [1]), _cells("B25001", [1])),
    "p_singleheaded": Share(_cells("B25009", [3, 11]), _cells("B25009", [1])),
    "p_noncitizen": Share(_cells("B05001", [6]), _cells("B05001", [1])),
    "p_veteran": Share(_cells("B21001", [2]), _cells("B21001", [1])),
    "p_bmarital": Share(_cells("B12002", [35, 50, 65, 80, 129, 143, 158, 173]), _cells("B12002", [1])),
    "p_fulltime": Share(_cells("B20005", [3, 50]), _cells("B20005", [1])),
    "p_uninsured": Share(_cells("B27001", [*range(5, 30, 3), *range(33, 58, 3)]), _cells("B27001", [1])),
}


def share_from_labels(metadata: DataFrame, table: str, numerator: str, denominator: str) -> Share:
    """Share whose cells are looked up in the variable metadata by label regex.

    ``metadata`` has one row per census variable (name, label); only the names
    of one table whose label matches are read back. Used for unemployment:
    'Unemployed$' over 'In labor force$' in table B23001.
    """
    hits = (
        metadata.where(F.col("name").rlike(table) & F.col("label").rlike(f"({numerator})|({denominator})"))
        .select("name", F.col("label").rlike(numerator).alias("num"), F.col("label").rlike(denominator).alias("den"))
        .orderBy("name")
        .collect()
    )
    return Share(tuple(r["name"] for r in hits if r["num"]), tuple(r["name"] for r in hits if r["den"]))


def add_shares(df: DataFrame, shares: dict[str, Share]) -> DataFrame:
    """Add the percentages; a share whose cells are absent from the table is NULL."""
    have = set(df.columns)
    return df.select(
        "*",
        *[
            (s.column() if have.issuperset(s.cells()) else F.lit(None).cast("double")).alias(n)
            for n, s in shares.items()
        ],
    )
