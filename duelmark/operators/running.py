"""Ordered operators without a single-task window.

A window with no partition key runs in one task. These helpers split the order into
coarse buckets (a column that never decreases along the order, such as the year), scan
inside each bucket, and carry bucket totals over a table with one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

START = W.unboundedPreceding
ROUNDING = 1e-9                 # by which a sum of doubles may miss its true value


def ordered_index(df: DataFrame, order: list[str], bucket, name: str = "idx") -> DataFrame:
    """Dense 0-based position along ``order``, which must be unique."""
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(W.orderBy("_bucket").rowsBetween(START, -1)), F.lit(0)).alias("_off"))
    local = F.row_number().over(W.partitionBy("_bucket").orderBy(*order)) - 1
    return (rows.withColumn("_local", local).join(offsets, "_bucket")
            .withColumn(name, (F.col("_off") + F.col("_local")).cast("long"))
            .drop("_bucket", "_off", "_local"))


def equity_curve(df: DataFrame, order: list[str], value: str, bucket,
                 partition: list[str] | None = None, peak_floor: float | None = None) -> DataFrame:
    """Add ``equity`` (running total), ``peak`` (running maximum of it) and ``drawdown``.

    ``peak_floor=0.0`` starts the peak at zero (the stop rule); ``None`` starts it at the
    first row (the report).
    """
    keys = list(partition or [])
    rows = df.withColumn("_bucket", bucket)
    local = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(START, 0)
    rows = rows.withColumn("_run", F.sum(value).over(local))
    rows = rows.withColumn("_top", F.max("_run").over(local))
    totals = rows.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"), F.max("_run").alias("_max"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(START, -1)
    carry = totals.withColumn("_off", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    carry = carry.withColumn("_oldpeak", F.max(F.col("_off") + F.col("_max")).over(before))
    carry = carry.select(*keys, "_bucket", "_off", "_oldpeak")
    floor = [F.lit(float(peak_floor))] if peak_floor is not None else []
    out = rows.join(carry, [*keys, "_bucket"])
    out = out.withColumn("equity", F.col("_off") + F.col("_run"))
    out = out.withColumn("peak", F.greatest(F.col("_off") + F.col("_top"), F.col("_oldpeak"), *floor))
    return (out.withColumn("drawdown", F.col("peak") - F.col("equity"))
            .drop("_bucket", "_run", "_top", "_off", "_oldpeak"))


def max_drawdown(curve: DataFrame, partition: list[str] | None = None) -> DataFrame:
    return curve.groupBy(*(partition or [])).agg(F.max("drawdown").alias("max_drawdown"))


def halt_after_drawdown(curve: DataFrame, order_col: str, stop: float,
                        partition: list[str] | None = None) -> DataFrame:
    """Rows after the first breach of ``peak - equity >= stop`` are flagged ``halted``.

    The path up to the breach does not depend on what is dropped later, so one pass
    over the unrestricted curve finds it. A drawdown that reaches the stop exactly is a breach
    however its sum was rounded.
    """
    keys = list(partition or [])
    breach = (curve.filter(F.col("drawdown") >= stop - ROUNDING)
              .groupBy(*keys).agg(F.min(order_col).alias("_breach")))
    if keys:
        out = curve.join(breach, keys, "left")
    else:
        out = curve.withColumn("_breach", breach.select("_breach").scalar())
    return out.withColumn("halted", F.coalesce(F.col(order_col) > F.col("_breach"), F.lit(False))).drop("_breach")


def running_before(df: DataFrame, order: str, values: list[str], bucket,
                   partition: list[str] | None = None) -> DataFrame:
    """Replace ``values`` by their totals over strictly earlier rows (0 at the start).

    ``order`` is unique within ``partition``.
    """
    keys = list(partition or [])
    rows = df.withColumn("_bucket", bucket)
    local = W.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(START, -1)
    totals = rows.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(v) for v in values])
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(START, -1)
    carry = totals.select(*keys, "_bucket", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_c_{v}")
                                              for v in values])
    out = rows.withColumns({v: F.coalesce(F.sum(v).over(local), F.lit(0)) for v in values})
    out = out.join(carry, [*keys, "_bucket"])
    return out.withColumns({v: F.col(v) + F.col(f"_c_{v}") for v in values}).select(*df.columns)
