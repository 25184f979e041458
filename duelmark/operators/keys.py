"""Keep-one-per-key, anti joins and set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Row with the largest ``order`` per key.

    Spark turns ``row_number() = 1`` into a group limit that also runs *before* the
    shuffle: each task sends one row per key, so a hot key stays small, and unlike an
    aggregate over whole-row structs the columns nobody reads are pruned at the scan.
    """
    return _first_row(df, keys, [F.col(c).desc_nulls_last() for c in order])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Row with the smallest ``order`` per key; NULLs come last."""
    return _first_row(df, keys, [F.col(c).asc_nulls_last() for c in order])


def unseen(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in ``known`` (not captured, locked, settled or attempted yet)."""
    return rows.join(known.select(*keys), keys, "left_anti")


def union_ids(df: DataFrame, columns: list[str], name: str = "id") -> DataFrame:
    """Distinct values of several id columns in one scan."""
    return (df.select(F.explode(F.array(*columns)).alias(name))
            .filter(F.col(name).isNotNull()).distinct())


def dropped_ids(old: DataFrame, new: DataFrame, columns: list[str], name: str = "id") -> DataFrame:
    """Ids of the old table that the new table lost."""
    return union_ids(old, columns, name).join(union_ids(new, columns, name), name, "left_anti")


def conflicting_mapping(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n_values) rows for keys mapped to more than one distinct value.

    The result stays one row per pair, so no group is gathered into a list.
    """
    pairs = df.select(key, value).where(F.col(value).isNotNull()).distinct()
    counts = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n_values")).filter("n_values > 1")
    return pairs.join(counts, key)


def surplus_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows repeat an earlier key (n - 1 per key)."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("surplus"))
