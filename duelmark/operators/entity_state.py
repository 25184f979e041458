"""Entity states: what a history says about the next contest, stored and updated instead of replayed.

A state is what ``point_in_time`` would carry to a row after an entity's last one: counts, sums, extremes, the last values and
the place of the last broken streak. States of consecutive parts of a history merge, so a batch of new rows is summed up
alone and merged into the stored table, and a hypothetical contest is scored by one lookup per entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from duelmark.checks import require_columns
from duelmark.operators.point_in_time import Prior, _mean, _std, _true


def _used(features: dict[str, Prior], *kinds: str) -> list[str]:
    return sorted({p.col for p in features.values() if p.kind in kinds})


def _tail(features: dict[str, Prior]) -> int:
    return max((p.k for p in features.values() if p.kind == "last"), default=0)


def part_states(rows: DataFrame, entity: str, time: str, seq: str, features: dict[str, Prior], chunk: str = "MONTH") -> DataFrame:
    """One row per (entity, chunk of time): what the rows of the chunk add to the entity's state.

    Sums are combined before rows move, so a busy entity is no hot key in them; the last rows of a chunk are found by a rank that
    every task limits first.
    """
    require_columns(rows, [entity, time, seq, *[p.col for p in features.values() if p.col]])
    base = rows.withColumn("_chunk", F.date_trunc(chunk, F.col(time)))
    order = F.struct(F.col(time), F.col(seq))
    aggs = {"n": F.count(F.lit(1)), "_first": F.min(order)}
    for c in _used(features, "sum", "mean", "std"):
        aggs |= {f"s_{c}": F.sum(F.col(c).cast("double")), f"c_{c}": F.count(c)}
    for c in _used(features, "std"):
        aggs[f"q_{c}"] = F.sum(F.col(c).cast("double") * F.col(c))
    for c in _used(features, "max"):
        aggs[f"m_{c}"] = F.max(c)
    for c in _used(features, "lag"):
        aggs[f"l_{c}"] = F.max_by(F.struct(F.col(c).alias("v")), order)
    flags = _used(features, "streak")
    for c in flags:
        aggs[f"_broken_{c}"] = F.max(F.when(~_true(c), order))
    out = base.groupBy(entity, "_chunk").agg(*[v.alias(k) for k, v in aggs.items()])
    keys = [entity, "_chunk"]
    if flags:
        # rows after the last broken one: the run that the chunk ends with
        broken = out.select(*keys, *[f"_broken_{c}" for c in flags])
        after = base.join(broken, keys).groupBy(*keys).agg(
            *[F.count_if(F.col(f"_broken_{c}").isNull() | (order > F.col(f"_broken_{c}"))).alias(f"run_{c}") for c in flags])
        out = out.join(after, keys).drop(*[f"_broken_{c}" for c in flags])
    if k := _tail(features):
        last = W.partitionBy(*keys).orderBy(F.desc(time), F.desc(seq))
        few = base.withColumn("_place", F.row_number().over(last)).filter(F.col("_place") <= k)
        tail = F.sort_array(F.collect_list(F.struct((-F.col("_place")).alias("place"), *_used(features, "last"))))
        out = out.join(few.groupBy(*keys).agg(tail.alias("tail")), keys)
    return out


def merge_states(parts: DataFrame, entity: str, features: dict[str, Prior], order: str = "_chunk") -> DataFrame:
    """One state per entity from states of consecutive parts of its history, in ``order``."""
    aggs = {"n": F.sum("n")}
    for c in parts.columns:
        kind = c.split("_")[0]
        if kind in ("s", "c", "q") and c != "c":
            aggs[c] = F.sum(c)
        elif kind == "m":
            aggs[c] = F.max(c)
        elif kind == "l":
            aggs[c] = F.max_by(c, order)
    flags, k = _used(features, "streak"), _tail(features)
    rows = parts
    if flags:
        # a part without a broken streak lengthens the run of the parts before it
        later = W.partitionBy(entity).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1)
        for c in flags:
            whole = F.col(f"run_{c}") == F.col("n")
            counts = F.coalesce(F.min(whole.cast("int")).over(later), F.lit(1)) == 1
            rows = rows.withColumn(f"_run_{c}", F.when(counts, F.col(f"run_{c}")).otherwise(0))
            aggs[f"run_{c}"] = F.sum(f"_run_{c}")
    if k:
        held = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(order, "tail"))), lambda p: p["tail"]))
        aggs["tail"] = F.slice(held, F.greatest(F.size(held) - k + 1, F.lit(1)), F.lit(k))
    return rows.groupBy(entity).agg(*[v.alias(name) for name, v in aggs.items()])


def entity_states(rows: DataFrame, entity: str, time: str, seq: str, features: dict[str, Prior], chunk: str = "MONTH") -> DataFrame:
    """One state per entity over all rows."""
    return merge_states(part_states(rows, entity, time, seq, features, chunk), entity, features)


def update_states(states: DataFrame, later: DataFrame, entity: str, time: str, seq: str, features: dict[str, Prior], chunk: str = "MONTH") -> DataFrame:
    """States after rows that all come later than those of ``states``; the history itself is not read."""
    new = part_states(later, entity, time, seq, features, chunk).drop("_first")
    old = states.withColumn("_chunk", F.lit("0001-01-01").cast(new.schema["_chunk"].dataType))
    return merge_states(old.unionByName(new), entity, features)


def next_features(rows: DataFrame, states: DataFrame, entity: str, features: dict[str, Prior], suffix: str = "") -> DataFrame:
    """Features of hypothetical next contests: those that ``point_in_time`` gives to a row after the entity's last."""
    table = states.select(F.col(entity).alias("_entity"), F.struct(*[c for c in states.columns if c != entity]).alias("_state"))
    joined = rows.join(table, F.col(entity + suffix) == F.col("_entity"), "left")

    def at(name):
        return F.col(f"_state.{name}")

    out = {}
    for name, p in features.items():
        if p.kind == "count":
            value = F.coalesce(at("n"), F.lit(0))
        elif p.kind == "sum":
            value = at(f"s_{p.col}")
        elif p.kind == "mean":
            value = _mean(at(f"s_{p.col}"), at(f"c_{p.col}"))
        elif p.kind == "std":
            value = _std(at(f"s_{p.col}"), at(f"q_{p.col}"), at(f"c_{p.col}"))
        elif p.kind == "max":
            value = at(f"m_{p.col}")
        elif p.kind == "lag":
            value = at(f"l_{p.col}")["v"]
        elif p.kind == "streak":
            value = F.coalesce(at(f"run_{p.col}"), F.lit(0))
        elif p.kind == "last":
            values = at(f"tail.{p.col}")
            last = F.slice(values, F.greatest(F.size(values) - p.k + 1, F.lit(1)), F.lit(p.k))
            known = F.filter(F.coalesce(last, F.array()).cast("array<double>"), lambda v: v.isNotNull())
            value = _mean(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), F.nullif(F.size(known), F.lit(0)))
        else:
            raise ValueError(p.kind)
        out[name + suffix] = value
    return joined.withColumns(out).drop("_entity", "_state")
