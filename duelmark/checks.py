"""Schema and cardinality guards shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F


def require_columns(df: DataFrame, columns: Iterable[str], label: str = "table") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{label} is missing columns: {missing}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, keys: list[str], label: str = "table") -> DataFrame:
    """Raise unless ``keys`` identify a row; the check is one distributed count."""
    offenders = duplicate_keys(df, keys).limit(5).collect()
    if offenders:
        raise ValueError(f"{label} is not unique on {keys}: {[tuple(r) for r in offenders]}")
    return df


def assert_empty(offenders: DataFrame, message: str, preview: int = 5) -> None:
    """Fail closed when ``offenders`` has rows; only a short preview reaches the driver."""
    rows = offenders.limit(preview + 1).collect()
    if rows:
        more = " (and more)" if len(rows) > preview else ""
        shown = "; ".join(str(r.asDict()) for r in rows[:preview])
        raise ValueError(f"{message}: {shown}{more}")
