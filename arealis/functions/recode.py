"""Value recodes, ages, durations and age bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col

UNKNOWN_AGE = 9999


def _literal_map(mapping: Mapping) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])


def recode(c: str | Column, mapping: Mapping) -> Column:
    """Replace listed values, pass every other value (and NULL) through."""
    c = as_col(c)
    return F.coalesce(F.try_element_at(_literal_map(mapping), c), c)


def recode_by_era(
    c: str | Column,
    year: str | Column,
    eras: Sequence[tuple[int | None, int | None, Mapping]],
) -> Column:
    """Recode with the table whose ``first <= year <= last`` holds.

    ``None`` leaves an end open. A year outside every era, or an unknown year,
    keeps the value as it is.
    """
    c, year = as_col(c), as_col(year)
    out = None
    for first, last, mapping in eras:
        cond = F.lit(True)
        if first is not None:
            cond = cond & (year >= first)
        if last is not None:
            cond = cond & (year <= last)
        value = recode(c, mapping)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return c if out is None else out.otherwise(c)


def fill_then_recode(
    unit: str | Column,
    fallback: str | Column,
    year: str | Column,
    last_year: int,
    mapping: Mapping,
) -> Column:
    """Missing unit taken from a second column, then recoded up to ``last_year``."""
    filled = F.coalesce(as_col(unit), as_col(fallback))
    return F.when(as_col(year) <= last_year, recode(filled, mapping)).otherwise(filled)


# Age units as recorded on the certificate: 1 years, 2 months, 4 days, 5 hours,
# 6 minutes, 9 unknown. Days per year as the study uses it.
DAYS_PER_YEAR = 365.24


def age_years(unit: str | Column, number: str | Column, unknown: int = UNKNOWN_AGE, unknown_first: bool = True) -> Column:
    """Completed years of age from (unit, number); ``unknown`` where not stated.

    A missing or 999 number is unknown whatever the unit. With
    ``unknown_first=False`` the unit decides first: hours and minutes are 0 even
    without a number, and only what no unit settles is unknown.
    """
    unit, number = as_col(unit), as_col(number)
    stated = number.isNotNull() & (number != 999) if unknown_first else F.lit(True)
    return (
        F.when(~stated, F.lit(unknown))
        .when(unit == 1, number)
        .when(unit == 2, F.floor(30 * number / F.lit(DAYS_PER_YEAR)))
        .when(unit == 4, F.floor(number / F.lit(DAYS_PER_YEAR)))
        .when(unit.isin(5, 6), F.lit(0))
        .otherwise(F.lit(unknown))
        .cast("int")
    )


def first_match(branches: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first branch whose condition is true; NULL is not true."""
    out = None
    for cond, value in branches:
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def race_class(
    white: str | Column,
    black: str | Column,
    hispanic: Sequence[str | Column],
    others: Sequence[str | Column],
) -> Column:
    """Race/ethnicity class: 1 white, 2 black, 3 hispanic, 9 unknown, else 4.

    ``hispanic`` columns hold 'H' when marked, race columns 'Y'; 'U' in any
    column means unknown. The first true branch wins.
    """
    white, black = as_col(white), as_col(black)
    hisp = [as_col(c) for c in hispanic]
    not_hisp = [c != "H" for c in hisp]
    is_hisp = [c == "H" for c in hisp]
    unknown = [c == "U" for c in [*hisp, white, black, *[as_col(c) for c in others]]]

    def fold(items: list[Column], op: str) -> Column:
        acc = items[0]
        for item in items[1:]:
            acc = (acc & item) if op == "and" else (acc | item)
        return acc

    return first_match(
        [
            (fold([white == "Y", *not_hisp], "and"), 1),
            (black == "Y", 2),
            (fold(is_hisp, "or"), 3),
            (fold(unknown, "or"), 9),
        ],
        4,
    )


# Days per unit of residence time; hours and minutes count as one day.
DURATION_DAYS = {"D": 1, "W": 7, "M": 30, "Y": 365, "U": 1}


def duration_days(unit: str | Column, number: str | Column) -> Column:
    """Length of stay in days from (unit letter, number)."""
    unit, number = as_col(unit), as_col(number)
    out = F.when(unit.isin("H", "N"), F.lit(1))
    for letter, days in DURATION_DAYS.items():
        out = out.when(unit == letter, number * days)
    return out.cast("long")


def leading_year(c: str | Column) -> Column:
    """Year in the first four characters of an id; NULL if they are no number."""
    return F.substring(as_col(c), 1, 4).try_cast("int")


def age_band_index(age: str | Column, width: int = 10, top: int = 80, unknown: int | None = UNKNOWN_AGE) -> Column:
    """0-based left-closed band; the last band is open. NULL for unknown ages."""
    age = as_col(age)
    known = age >= 0
    if unknown is not None:
        known = known & (age != unknown)
    return F.when(known, F.least(F.floor(age / F.lit(float(width))), F.lit(top // width).cast("long"))).cast("int")


def band_labels(width: int = 10, top: int = 80) -> list[str]:
    """Zero-padded labels: ``00_10`` ... ``70_80``, ``80_Inf``."""
    return [f"{lo:02d}_{lo + width:02d}" for lo in range(0, top, width)] + [f"{top:02d}_Inf"]


def band_label(index: str | Column, width: int = 10, top: int = 80) -> Column:
    """Label of a 0-based band (a lookup in a constant array)."""
    labels = F.array(*[F.lit(x) for x in band_labels(width, top)])
    return F.try_element_at(labels, as_col(index) + 1)


def age_band(age: str | Column, width: int = 10, top: int = 80, unknown: int | None = UNKNOWN_AGE) -> Column:
    """Age-band label. ``unknown=None`` keeps the unknown code in the open band."""
    return band_label(age_band_index(age, width, top, unknown), width, top)


def state_label(code: str | Column, names: Mapping[str, str], default: str) -> Column:
    """Name of a state from its code, ``default`` for all others."""
    code = as_col(code).cast("string")
    return F.coalesce(F.try_element_at(_literal_map(names), code), F.lit(default))
