"""Row filters that say what they refuse. Null never equals anything here, unless a blank is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_splits(rows: DataFrame, splits: tuple[str, ...], split: str = "split", forbid: tuple[str, ...] = ()) -> DataFrame:
    """Rows of `splits`; a row of a forbidden split anywhere is an error."""
    if forbid and not rows.where(F.col(split).isin(*forbid)).isEmpty():
        raise ValueError(f"rows of {forbid} don't belong here")
    return rows.where(F.col(split).isin(*splits))


def where_equal(rows: DataFrame, condition: str) -> DataFrame:
    """COLUMN=VALUE as a slice: a column that isn't there, or null, compares as blank; an empty slice is an error."""
    column, found, value = condition.partition("=")
    if not found:
        raise ValueError("a slice is COLUMN=VALUE")
    own = F.coalesce(F.col(column).cast("string"), F.lit("")) if column in rows.columns else F.lit("")
    out = rows.where(own == value)
    if out.isEmpty():
        raise ValueError(f"no row with {condition}")
    return out


def known(rows: DataFrame, label: str) -> DataFrame:
    """Rows with a label: blanks and -1 are unknown, and are left out, never filled."""
    value = F.col(label).cast("string")
    return rows.where(value.isNotNull() & ~F.trim(value).isin("", "-1"))


def mismatch_population(rows: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Genuine and out-of-context rows."""
    return rows.where(F.col(scenario).isin(1, 4))


def not_in(rows: DataFrame, quarantined: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't quarantined; nulls in the quarantine exclude nothing."""
    return rows.join(quarantined.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def source_holdout(rows: DataFrame, group: str, category: str = "categories", label: str = "label", split: str = "split") -> tuple[DataFrame, DataFrame]:
    """(training rows without the category, validation rows of it with all real ones)."""
    own = F.array_contains(F.split(F.coalesce(category, F.lit("")), "[|]"), group)
    return rows.where((F.col(split) == "train") & ~own), rows.where((F.col(split) == "val") & (own | (F.col(label) == 0)))
