"""Cause-code flags and identifier/variable-code text work."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import as_col

# Patterns fixed by the study definitions (ICD-10 chapters).
ANY_F = "F.*"
PARKINSON = "^(A521|F023|G20|G21|G22|G903).*"
DEMENTIA = "^(F00|F01|F02|F03).*"
ALZHEIMER = "^(G30).*"

# flag name -> (number of leading cause columns looked at, pattern)
CAUSE_FLAGS: dict[str, tuple[int, str]] = {
    "mental": (1, ANY_F),
    "mental3": (3, ANY_F),
    "mental_new": (10, "F[0-4][0-9]"),
    "mental_new2": (10, "F[0-6][0-9]"),
    "moodanxiety": (10, "F[3-4][0-9]"),
    "substance": (10, "F1[0-9]"),
    "nonsubstance": (10, "F[2-4][0-9]"),
    "nonsubstance2": (10, "F(0|[2-6])[0-9]"),
    "dementia_vascular": (10, "F01"),
    "dementia_unspecified": (10, "F03"),
    "mental_any": (10, ANY_F),
    "parkinson": (3, PARKINSON),
    "dementia": (3, DEMENTIA),
    "alzheimer": (3, ALZHEIMER),
}

# underlying-cause flags
UNDERLYING_FLAGS: dict[str, str] = {
    "mental_u": ANY_F,
    "parkinson_u": PARKINSON,
    "dementia_u": DEMENTIA,
    "alzheimer_u": ALZHEIMER,
}

# the ten flags counted by area and year, with their count-column names
COUNTED_FLAGS: dict[str, str] = {
    "mental": "n_mental1",
    "mental3": "n_mental3",
    "mental_new": "n_mentaln",
    "mental_new2": "n_mentaln2",
    "moodanxiety": "n_moodanxiety",
    "substance": "n_substance",
    "nonsubstance": "n_nonsubstance",
    "nonsubstance2": "n_nonsubstance2",
    "dementia_vascular": "n_dementia_vas",
    "dementia_unspecified": "n_dementia_uns",
}

# Characters of a pattern that cannot reach past the line break between codes.
_LINE_SAFE = re.compile(r"[A-Za-z0-9_.*+?|()\[\]{}^$,\-]*")


def _stays_in_line(pattern: str) -> bool:
    return (
        _LINE_SAFE.fullmatch(pattern) is not None
        and "[^" not in pattern
        and "(?" not in pattern
        and re.search(pattern, "") is None
    )


def _found(text: Column, pattern: str, multiline: bool = False) -> Column:
    """Pattern found in the text. Plain text (``F01``, ``F.*``) needs no regex."""
    plain = pattern.removesuffix(".*")
    if re.fullmatch("[A-Za-z0-9]+", plain):
        return text.contains(plain)
    return text.rlike("(?m)" + pattern if multiline else pattern)


def has_code(c: str | Column, pattern: str) -> Column:
    """1 where the code matches, 0 where it does not or is NULL."""
    return F.coalesce(_found(as_col(c), pattern), F.lit(False)).cast("int")


def any_code(cols: Sequence[str | Column], pattern: str, text: Column | None = None) -> Column:
    """1 if any of the code columns matches the pattern, NULL codes skipped.

    The codes are joined with line breaks and searched once in multi-line mode,
    so ``.`` and the anchors stay inside one code: one regex run per record
    instead of one per column. Patterns that could see the line break, or could
    match the empty text, go column by column. ``text``: the joined codes, where
    they are a column already.
    """
    cols = [as_col(c) for c in cols]
    if len(cols) == 1:
        return has_code(cols[0], pattern)
    if not _stays_in_line(pattern):
        return F.greatest(*[has_code(c, pattern) for c in cols])
    return _found(F.concat_ws("\n", *cols) if text is None else text, pattern, multiline=True).cast("int")


def cause_flags(
    df: DataFrame,
    prefix: str = "mltcse",
    flags: dict[str, tuple[int, str]] | None = None,
) -> DataFrame:
    """Add one 0/1 column per flag from ``prefix1 .. prefix<k>``.

    Codes are joined once for each number of columns, not once per flag.
    """
    flags = CAUSE_FLAGS if flags is None else flags
    cols = {k: [f"{prefix}{i}" for i in range(1, k + 1)] for k, _ in flags.values()}
    joined = df.select("*", *[F.concat_ws("\n", *c).alias(f"__codes{k}") for k, c in cols.items() if k > 1])
    return joined.select(
        *df.columns, *[any_code(cols[k], p, F.col(f"__codes{k}") if k > 1 else None).alias(name) for name, (k, p) in flags.items()]
    )


def underlying_flags(df: DataFrame, column: str, flags: dict[str, str] | None = None) -> DataFrame:
    """Add the flags that look at the underlying cause only."""
    flags = UNDERLYING_FLAGS if flags is None else flags
    return df.select("*", *[has_code(column, p).alias(name) for name, p in flags.items()])


def rename_matching(df: DataFrame, pattern: str, old: str, new: str) -> DataFrame:
    """Rename every column whose name matches, replacing ``old`` by ``new``."""
    hit = re.compile(pattern)
    return df.withColumnsRenamed({c: c.replace(old, new) for c in df.columns if hit.search(c)})


def suffix_columns(df: DataFrame, keep: Sequence[str], suffix: str) -> DataFrame:
    """Append a suffix to every column that is not in ``keep``."""
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c not in keep})


# table letter, five digits, optional race letter, cell number
VARIABLE_CODE = "[A-Z][0-9]{5}[A-Z]{0,1}_[0-9]{3}"


def variable_code(c: str | Column) -> Column:
    """Normalised census variable code; NULL if the text holds none."""
    return F.nullif(F.regexp_extract(as_col(c), VARIABLE_CODE, 0), F.lit(""))


def key_slice(c: str | Column, first: int, last: int) -> Column:
    """Characters ``first..last`` (1-based, inclusive) of an identifier."""
    return F.substring(as_col(c), first, last - first + 1)
