"""Text to number parsers for raw contest tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from duelmark.functions._col import col
from duelmark.settings import DIVISION_LIMITS


def x_of_y(c) -> tuple[Column, Column]:
    """``"23 of 38"`` -> (23.0, 38.0); anything else -> (NULL, NULL)."""
    pattern = r"^\s*(\d+)\s+of\s+(\d+)"
    return tuple(F.regexp_extract(col(c), pattern, g).try_cast("double") for g in (1, 2))


def clock_seconds(c) -> Column:
    """``"m:ss"`` -> seconds; NULL unless exactly two integer parts."""
    parts = F.split(col(c), ":")
    return F.when(
        F.size(parts) == 2,
        F.trim(parts[0]).try_cast("int") * 60 + F.trim(parts[1]).try_cast("int"),
    ).cast("double")


def duration_minutes(round_no, clock, round_minutes: int = 5) -> Column:
    """Elapsed minutes of a contest that ended at ``clock`` of round ``round_no``."""
    finished = (col(round_no).try_cast("int") - 1) * round_minutes
    return finished + clock_seconds(clock) / 60.0


def height_inches(c) -> Column:
    feet, inches = (F.regexp_extract(col(c), r"^(\d+)'\s*(\d+)", g).try_cast("int") for g in (1, 2))
    return (feet * 12 + inches).cast("double")


def leading_number(c, anywhere: bool = False) -> Column:
    """Number at the start of a measure (quotes trimmed), or the first number anywhere."""
    if anywhere:
        return F.regexp_extract(col(c), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.regexp_extract(col(c), r'^[" ]*(\d+)', 1).try_cast("double")


def parse_date(c, formats=("MMM dd, yyyy", "yyyy-MM-dd", "MMMM d, yyyy")) -> Column:
    """First format that parses; NULL when none does."""
    tries = [F.try_to_timestamp(col(c), F.lit(f)) for f in formats]
    return F.coalesce(*tries).cast("date")


def split_sides(c) -> tuple[Column, Column]:
    """``"A vs. B"`` -> two trimmed sides; the second is NULL without a separator."""
    parts = F.split(col(c), r"\s+vs\.?\s+", 2)
    return F.trim(F.get(parts, 0)), F.trim(F.get(parts, 1))


def outcome_side(c) -> Column:
    code = F.trim(col(c))
    return F.when(code == "W/L", "A").when(code == "L/W", "B").when(code == "D/D", "draw")


def division_limit(c, limits=DIVISION_LIMITS) -> Column:
    """Limit of the first division label contained in the text."""
    text = F.lower(col(c))
    head, *rest = limits
    chain = F.when(text.contains(head[0]), head[1])
    return reduce(lambda acc, item: acc.when(text.contains(item[0]), item[1]), rest, chain)


def method_class(c) -> Column:
    text = F.upper(F.coalesce(col(c), F.lit("")))
    return (F.when(text.contains("KO"), "KO").when(text.contains("SUB"), "SUB")
            .when(text.contains("DEC"), "DEC").otherwise("OTHER"))


def five_round_flag(c) -> Column:
    return F.coalesce(col(c), F.lit("")).contains("5 Rnd").cast("double")


def heavy_flag(c) -> Column:
    return F.lower(F.coalesce(col(c), F.lit(""))).contains("heavyweight").cast("double")


def women_flag(c) -> Column:
    return F.lower(F.coalesce(col(c), F.lit(""))).contains("women").cast("double")
