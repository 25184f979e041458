"""Cluster bootstrap with reproducible, hash-picked weights.

Rows are aggregated to clusters first. In draw ``d`` a cluster counts as often as a Poisson(1) variable that a hash
of (seed, draw, cluster) picks, the limit of resampling with replacement. A cluster has one weight per draw, shared by all groups
and measures, so a report with many intervals hashes once. Tasks multiply the weights with their clusters' sums and hand on
one row per draw and group; nothing is joined or numbered, results do not depend on partitioning, and any SQL engine can check
them.
"""

from __future__ import annotations

from math import lgamma, log, sqrt

import numpy as np
from pyspark.sql import DataFrame, functions as F

BITS = 20                       # of a hash that pick a weight
PER_HASH = 6                    # draws that share a hash: three in each of two numbers of 60 bits
CLUSTERS_PER_TASK = 256         # at least, so that a task has more clusters than it hands on
KEYS_AT_ONCE = 256
STEP = 1e6                      # values are told apart to a millionth


def poisson_reach(mean: float) -> tuple[int, int]:
    """Numbers outside of which a Poisson variable hardly lies; the end is exclusive."""
    spread = 9 + 9 * sqrt(mean)
    return max(0, int(mean - spread)), int(mean + spread) + 1


def poisson_steps(mean: float = 1.0) -> tuple[int, np.ndarray]:
    """The least weight, and where it grows by one: cumulative probabilities in units of 2**-BITS."""
    low, high = poisson_reach(mean)
    k = np.arange(low, high, dtype=float)
    # log p(k) from log p(low) by the ratios of neighbours
    logs = np.concatenate([[-mean + low * log(mean) - lgamma(low + 1)], log(mean) - np.log(k[1:])]).cumsum()
    total = np.exp(logs).cumsum()
    if mean > 1e6:
        total /= total[-1]      # by then the first logarithm has lost its last digits
    steps = np.floor(total * (1 << BITS)).astype(np.uint64)
    return low, steps[steps < (1 << BITS) - 1]


def weighted_sums(cells: DataFrame, by: list[str], key: list[str], columns: list[str], draws: int, seed: int = 0,
                  count: str | None = None) -> DataFrame:
    """(by, draw, columns): sums of the columns over the weighted clusters of each group.

    ``cells`` has a row per group and cluster; ``key`` identifies a cluster. With ``count`` a cluster stands for that many rows
    that are drawn independently: its weight is Poisson(count).
    """
    spark = cells.sparkSession
    group = F.to_json(F.struct(*by)) if by else F.lit("{}")
    rows = cells.select(group.alias("_group"), F.concat_ws("|", *[F.col(c).cast("string") for c in key]).alias("_key"),
                        F.col(count).cast("double").alias("_mean") if count else F.lit(1.0).alias("_mean"),
                        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_v{j}") for j, c in enumerate(columns)])
    tasks = max(1, min(spark.sparkContext.defaultParallelism, cells.select(*key).distinct().count() // CLUSTERS_PER_TASK))
    width, blocks = len(columns), -(-draws // PER_HASH)

    def multiply(batches):
        from hashlib import md5

        import pyarrow as pa

        mask, shifts = np.uint64((1 << BITS) - 1), np.arange(3, dtype=np.uint64) * np.uint64(BITS)
        prefixes = [f"{seed}|{b}|".encode() for b in range(blocks)]
        tables: dict[float, tuple[int, np.ndarray]] = {}

        def weights(name: bytes, mean: float) -> np.ndarray:
            digests = np.frombuffer(b"".join([md5(p + name).digest() for p in prefixes]), ">u8").astype(np.uint64) >> np.uint64(4)
            if mean not in tables:
                tables[mean] = poisson_steps(mean)
            low, steps = tables[mean]
            # one number gives three draws, and one hash two numbers
            return low + np.searchsorted(steps, (digests[:, None] >> shifts & mask).ravel(), "right")[:draws]

        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column("_key").cast(pa.binary()).to_pylist()
            means, groups = batch.column("_mean").to_pylist(), batch.column("_group").to_pylist()
            values = np.column_stack([batch.column(f"_v{j}").to_numpy() for j in range(width)])
            line = sorted(range(len(names)), key=names.__getitem__)
            for start in range(0, len(line), KEYS_AT_ONCE):
                part = line[start:start + KEYS_AT_ONCE]
                keys = list(dict.fromkeys((names[i], means[i]) for i in part))
                at, own = {k: j for j, k in enumerate(keys)}, list(dict.fromkeys(groups[i] for i in part))
                column = {g: j for j, g in enumerate(own)}
                dense = np.zeros((len(keys), len(own), width))
                np.add.at(dense, ([at[names[i], means[i]] for i in part], [column[groups[i]] for i in part]), values[part])
                drawn = np.stack([weights(*k) for k in keys], axis=1).astype(float)
                made = (drawn @ dense.reshape(len(keys), -1)).reshape(draws, len(own), width)
                for g, j in column.items():
                    totals[g] = totals[g] + made[:, j] if g in totals else made[:, j]
        for g, sums in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * draws), pa.array(np.arange(draws)), *(pa.array(sums[:, j]) for j in range(width))],
                                             ["_group", "draw", *(f"_v{j}" for j in range(width))])

    schema = "_group string, draw long, " + ", ".join(f"_v{j} double" for j in range(width))
    parts = rows.repartition(tasks, "_key").mapInArrow(multiply, schema)
    out = parts.groupBy("_group", "draw").agg(*[F.sum(f"_v{j}").alias(c) for j, c in enumerate(columns)])
    kinds = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in by)
    told = [F.from_json("_group", kinds)[c].alias(c) for c in by]
    return out.select(*told, "draw", *columns)


def bootstrap_draws(clusters: DataFrame, key: list[str], numerator: str, denominator: str, draws: int, seed: int = 0,
                    count: str | None = None) -> DataFrame:
    """One row per draw: sum(numerator) / sum(denominator) over the weighted clusters, which ``key`` identifies."""
    cells = clusters.withColumns({"num": F.col(numerator), "den": F.col(denominator)})
    return weighted_sums(cells, [], key, ["num", "den"], draws, seed, count).withColumn("ratio", F.try_divide("num", "den"))


def interval(draws: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Exact percentile interval over the draws."""
    return draws.agg(F.percentile("ratio", low).alias("ci_low"), F.percentile("ratio", high).alias("ci_high"))


def grouped_intervals(cells: DataFrame, by: list[str], key: list[str], ratios: dict[str, tuple[str, str]], draws: int = 10000,
                      seed: int = 0, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Intervals of several ratios of sums for every group: ``<name>_low`` and ``<name>_high``.

    ``cells`` has a row per group and cluster. All groups and ratios share the clusters' weights. Draws in which a
    group's denominator is 0 do not count.
    """
    columns = list(dict.fromkeys(c for pair in ratios.values() for c in pair))
    sums = weighted_sums(cells, by, key, columns, draws, seed)
    each = sums.select(*by, *[F.try_divide(num, den).alias(name) for name, (num, den) in ratios.items()])
    return each.groupBy(*by).agg(*[F.percentile(name, q).alias(f"{name}_{end}") for name in ratios for end, q in (("low", low), ("high", high))])


def cluster_ratio_ci(events: DataFrame, key: list[str], pnl="pnl", staked="staked", draws: int = 10000, seed: int = 0) -> DataFrame:
    """Interval of sum(pnl) / sum(staked) over events with a stake."""
    return interval(bootstrap_draws(events.filter(F.col(staked) > 0), key, pnl, staked, draws, seed))


def cluster_mean_ci(rows: DataFrame, cluster: str, value: str, draws: int = 10000, seed: int = 0) -> DataFrame:
    """Interval of a row-level mean, resampling whole clusters (aggregated first)."""
    usable = rows.dropna(subset=[cluster, value])
    cards = usable.groupBy(cluster).agg(F.sum(value).alias("num0"), F.count(value).alias("den0"))
    return interval(bootstrap_draws(cards, [cluster], "num0", "den0", draws, seed))


def value_counts(rows: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """(by, cell, total, n): rows collapsed to distinct values, told apart to a millionth."""
    cell = F.floor(F.col(value) * STEP + 0.5).cast("long").alias("cell")
    return rows.dropna(subset=[value]).groupBy(*by, cell).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def row_mean_ci(rows: DataFrame, value: str, draws: int = 4000, seed: int = 0, key: list[str] | None = None) -> DataFrame:
    """Interval of a mean with every row drawn by itself.

    With ``key``, which identifies a row, every row has its own weight in every draw. Without it, rows of one value are one
    cell, whose weight is Poisson(rows): the sum of their independent weights.
    """
    if key:
        own = rows.dropna(subset=[value]).select(*key, F.col(value).alias("num0"), F.lit(1.0).alias("den0"))
        return interval(bootstrap_draws(own, key, "num0", "den0", draws, seed))
    cells = value_counts(rows, value).withColumns({"mean": F.col("total") / F.col("n"), "one": F.lit(1.0)})
    return interval(bootstrap_draws(cells, ["cell"], "mean", "one", draws, seed, count="n"))
