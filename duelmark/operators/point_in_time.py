"""Leakage-free histories: every feature of a row uses strictly earlier rows of its entity.

A window partitioned by entity puts one entity in one task, which fails when a single
entity holds a large share of the rows. ``point_in_time`` therefore cuts every history
into time chunks: rows are shuffled once by (entity, chunk), each chunk is scanned with a
local lag-1 window, and the state of all earlier chunks is carried in from a small
per-chunk summary. A hot entity is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from duelmark.checks import require_columns
from duelmark.session import materialize

START = W.unboundedPreceding
ROWS_PER_PART = 500_000         # of a range of sorted rows, about


@dataclass(frozen=True)
class Prior:
    """One lag-1 feature; ``col`` is an input column name."""

    kind: str
    col: str | None = None
    k: int = 0


def prior_count() -> Prior:
    return Prior("count")


def prior_sum(col: str) -> Prior:
    return Prior("sum", col)


def prior_mean(col: str) -> Prior:
    return Prior("mean", col)


def prior_std(col: str) -> Prior:
    """Sample standard deviation of earlier rows (NULL below two values)."""
    return Prior("std", col)


def prior_max(col: str) -> Prior:
    return Prior("max", col)


def previous(col: str) -> Prior:
    return Prior("lag", col)


def last_mean(col: str, k: int) -> Prior:
    """Mean over the last ``k`` earlier rows; NULLs keep their place and are skipped."""
    return Prior("last", col, k)


def streak(flag: str) -> Prior:
    """Number of consecutive true flags directly before the row."""
    return Prior("streak", flag)


def _true(flag: str) -> Column:
    return F.coalesce(F.col(flag).cast("boolean"), F.lit(False))


def _mean(total: Column, n: Column) -> Column:
    return F.try_divide(total, n)


def _std(total: Column, square: Column, n: Column) -> Column:
    spread = F.greatest(square - total * total / n, F.lit(0.0))
    return F.when(n >= 2, F.sqrt(spread / (n - 1)))


def _plain(df: DataFrame, keys, time, seq, features) -> DataFrame:
    """Single-window form: one exchange, one sort, for inputs without hot entities."""
    order = W.partitionBy(*keys).orderBy(time, seq)
    prior = order.rowsBetween(START, -1)
    df = df.withColumn("_i", F.row_number().over(order) - 1)
    out = {}
    for name, p in features.items():
        c = F.col(p.col) if p.col else None
        if p.kind == "count":
            out[name] = F.col("_i").cast("long")
        elif p.kind == "sum":
            out[name] = F.sum(c).over(prior)
        elif p.kind == "mean":
            out[name] = F.avg(c).over(prior)
        elif p.kind == "std":
            out[name] = F.stddev_samp(c).over(prior)
        elif p.kind == "max":
            out[name] = F.max(c).over(prior)
        elif p.kind == "lag":
            out[name] = F.lag(c).over(order)
        elif p.kind == "last":
            out[name] = F.avg(c).over(order.rowsBetween(-p.k, -1))
        elif p.kind == "streak":
            broken = F.max(F.when(~_true(p.col), F.col("_i"))).over(prior)
            out[name] = F.coalesce(F.col("_i") - 1 - broken, F.col("_i")).cast("long")
        else:
            raise ValueError(p.kind)
    return df.withColumns(out).drop("_i")


def _chunk_summary(rows: DataFrame, keys, time, seq, features, entity_cols):
    """One row per (entity, chunk) with everything later chunks need."""
    aggs = {"_n": F.count(F.lit(1)), **{f"_ent_{c}": F.min(c) for c in entity_cols}}
    tail_k = 0
    order = F.struct(F.col(time), F.col(seq))
    for p in set(features.values()):
        c = F.col(p.col) if p.col else None
        if p.kind in ("sum", "mean", "std"):
            aggs[f"_s_{p.col}"] = F.sum(c.cast("double"))
            aggs[f"_c_{p.col}"] = F.count(c)
        if p.kind == "std":
            aggs[f"_q_{p.col}"] = F.sum(c.cast("double") * c)
        if p.kind == "max":
            aggs[f"_m_{p.col}"] = F.max(c)
        if p.kind == "lag":
            aggs[f"_l_{p.col}"] = F.max_by(F.struct(c.alias("v")), order)
        if p.kind == "streak":
            aggs[f"_b_{p.col}"] = F.max(F.when(~_true(p.col), F.col("_i")))
        if p.kind == "last":
            tail_k = max(tail_k, p.k)
    if tail_k:
        cols = sorted({p.col for p in features.values() if p.kind == "last"})
        last = W.partitionBy(*keys, "_chunk").orderBy(F.desc(time), F.desc(seq))
        rows = rows.withColumn("_r", F.row_number().over(last))
        # at most tail_k structs per chunk, so the list is bounded
        aggs["_tail"] = F.sort_array(F.collect_list(
            F.when(F.col("_r") <= tail_k, F.struct("_i", *cols))))
    return rows.groupBy(*keys, "_chunk").agg(*[v.alias(k) for k, v in aggs.items()]), tail_k


def _carry(summary: DataFrame, keys, features, tail_k, entity_cols) -> DataFrame:
    """Running state before each chunk; the window runs over chunk rows only."""
    order = W.partitionBy(*keys).orderBy("_chunk")
    prior = order.rowsBetween(START, -1)
    out = {"_off": F.coalesce(F.sum("_n").over(prior), F.lit(0))}
    for c in summary.columns:
        tag = c[:3]
        if tag in ("_s_", "_c_", "_q_"):
            out["k" + c] = F.sum(c).over(prior)
        elif tag == "_m_":
            out["k" + c] = F.max(c).over(prior)
        elif tag == "_l_":
            out["k" + c] = F.lag(c).over(order)
    if tail_k:
        out["k_tail"] = F.flatten(F.collect_list("_tail").over(order.rowsBetween(-tail_k, -1)))
    carried = summary.withColumns(out)
    # break positions become global once the chunk offset is known
    breaks = {"k" + c: F.max(F.col(c) + F.col("_off")).over(prior)
              for c in summary.columns if c.startswith("_b_")}
    if breaks:
        carried = carried.withColumns(breaks)
    return carried.select(*keys, "_chunk", *out, *breaks, *[f"_ent_{c}" for c in entity_cols])


def point_in_time(df: DataFrame, entity, time: str, seq: str, features: dict[str, Prior],
                  chunk: str | Column | None = "MONTH") -> DataFrame:
    """Add lag-1 features per entity, ordered by (time, seq).

    ``seq`` must make (entity, time, seq) unique. ``chunk`` is a ``date_trunc`` unit or a
    column that never decreases along (time, seq); ``None`` uses one plain window.
    """
    keys = [entity] if isinstance(entity, str) else list(entity)
    require_columns(df, [*keys, time, seq, *[p.col for p in features.values() if p.col]])
    if chunk is None:
        return _plain(df, keys, time, seq, features)

    cut = F.date_trunc(chunk, F.col(time)) if isinstance(chunk, str) else chunk
    # a key that is never NULL adds no filter to one side of the join below, so the rows and
    # their summary share one exchange
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("(null)")) for k in keys]
    key = parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)
    base = df.withColumns({"_key": key, "_chunk": cut})
    entity_cols, keys = keys, ["_key"]
    local = W.partitionBy("_key", "_chunk").orderBy(time, seq)
    before = local.rowsBetween(START, -1)
    indexed = base.withColumn("_i", (F.row_number().over(local) - 1).cast("long"))
    positional = any(p.kind in ("last", "streak") for p in features.values())
    summary, tail_k = _chunk_summary(indexed if positional else base, keys, time, seq, features, entity_cols)
    carry = _carry(summary, keys, features, tail_k, entity_cols)

    scratch = {}
    for p in set(features.values()):
        c = F.col(p.col) if p.col else None
        if p.kind in ("sum", "mean", "std"):
            scratch[f"_ls_{p.col}"] = F.sum(c.cast("double")).over(before)
            scratch[f"_lc_{p.col}"] = F.count(c).over(before)
        if p.kind == "std":
            scratch[f"_lq_{p.col}"] = F.sum(c.cast("double") * c).over(before)
        if p.kind == "max":
            scratch[f"_lm_{p.col}"] = F.max(c).over(before)
        if p.kind == "lag":
            scratch[f"_ll_{p.col}"] = F.lag(c).over(local)
        if p.kind == "streak":
            scratch[f"_lb_{p.col}"] = F.max(F.when(~_true(p.col), F.col("_i"))).over(before)
        if p.kind == "last":
            frame = local.rowsBetween(-p.k, -1)
            scratch[f"_ts{p.k}_{p.col}"] = F.sum(c.cast("double")).over(frame)
            scratch[f"_tc{p.k}_{p.col}"] = F.count(c).over(frame)
    joined = indexed.withColumns(scratch).join(carry, [*keys, "_chunk"], "left")

    zero = F.lit(0.0)

    def total(tag, name):
        a, b = F.col(f"_l{tag}_{name}"), F.col(f"k_{tag}_{name}")
        return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, zero) + F.coalesce(b, zero))

    out = {}
    for name, p in features.items():
        if p.kind == "count":
            out[name] = F.col("_off") + F.col("_i")
        elif p.kind == "sum":
            out[name] = total("s", p.col)
        elif p.kind == "mean":
            out[name] = _mean(total("s", p.col), total("c", p.col))
        elif p.kind == "std":
            out[name] = _std(total("s", p.col), total("q", p.col), total("c", p.col))
        elif p.kind == "max":
            out[name] = F.greatest(F.col(f"_lm_{p.col}"), F.col(f"k_m_{p.col}"))
        elif p.kind == "lag":
            out[name] = (F.when(F.col("_i") == 0, F.col(f"k_l_{p.col}")["v"])
                         .otherwise(F.col(f"_ll_{p.col}")))
        elif p.kind == "streak":
            here = F.col("_off") + F.col("_i")
            broken = F.greatest(F.col("_off") + F.col(f"_lb_{p.col}"), F.col(f"k_b_{p.col}"))
            out[name] = F.coalesce(here - 1 - broken, here)
        elif p.kind == "last":
            missing = F.greatest(F.lit(p.k) - F.col("_i"), F.lit(0)).cast("int")
            tail = F.coalesce(F.col("k_tail"), F.array())
            start = F.greatest(F.size(tail) - missing + 1, F.lit(1))
            values = F.filter(F.transform(F.slice(tail, start, missing), lambda s: s[p.col]),
                              lambda v: v.isNotNull())
            extra = F.aggregate(values, zero, lambda acc, v: acc + v)
            n = F.col(f"_tc{p.k}_{p.col}") + F.when(missing > 0, F.size(values)).otherwise(0)
            s = F.coalesce(F.col(f"_ts{p.k}_{p.col}"), zero) + F.when(missing > 0, extra).otherwise(zero)
            out[name] = _mean(s, F.nullif(n, F.lit(0)))
    # reading the entity from either side keeps both sides on the same columns (one exchange)
    passed = [F.coalesce(c, f"_ent_{c}").alias(c) if c in entity_cols else F.col(c) for c in df.columns]
    return joined.select(*passed, *[v.alias(k) for k, v in out.items()])


def two_sided_long(df: DataFrame, shared: list[str], per_side: dict[str, tuple]) -> DataFrame:
    """One row per (contest, side) from a two-sided table: a single scan, no self-union.

    ``per_side`` maps an output column to its (side A, side B) columns. Rows carry
    ``side`` in ('A', 'B') and ``side_no`` (0 for A, 1 for B) as the order tie-break.
    """
    def as_col(v):
        return v if isinstance(v, Column) else F.col(v)

    sides = [
        F.struct(F.lit(s).alias("side"), F.lit(n).alias("side_no"),
                 *[as_col(v[n]).alias(k) for k, v in per_side.items()])
        for n, s in enumerate("AB")
    ]
    return df.select(*shared, F.explode(F.array(*sides)).alias("_s")).select("*", "_s.*").drop("_s")


def to_wide(long: DataFrame, contest: list[str], values: list[str]) -> DataFrame:
    """Back to one row per contest: ``<value>_a`` and ``<value>_b`` in one aggregation."""
    aggs = [F.max(F.when(F.col("side") == s, F.col(v))).alias(f"{v}_{s.lower()}")
            for v in values for s in ("A", "B")]
    return long.groupBy(*contest).agg(*aggs)


def career_stats(long: DataFrame, entity: str, time: str, seq: str, won: str, finish: str,
                 minutes: str, rate_stats=(), total_stats=(), accuracy=None,
                 chunk="MONTH", streak_lag: int = 1) -> DataFrame:
    """Career totals and rates before each contest.

    Unknown histories get the neutral defaults: win rate 0.5, days since last 365,
    rates and totals 0. ``streak_lag=2`` leaves the latest contest out of the streak.
    """
    features = {
        "career_fights": prior_count(), "career_wins": prior_sum(won),
        "career_minutes": prior_sum(minutes), "career_finish_rate": prior_mean(finish),
        "win_streak": streak(won), "_previous": previous(time),
        **{f"_cum_{c}": prior_sum(c) for c in (*rate_stats, *total_stats)},
    }
    out = point_in_time(long, entity, time, seq, features, chunk)
    if streak_lag == 2:
        out = point_in_time(out, entity, time, seq, {"_streak2": previous("win_streak")}, chunk)
        out = out.withColumn("win_streak", F.coalesce("_streak2", F.lit(0))).drop("_streak2")
    zero = F.lit(0.0)
    cols = {
        "career_wins": F.coalesce(F.col("career_wins"), zero),
        "career_minutes": F.coalesce(F.col("career_minutes"), zero),
        "career_winrate": F.coalesce(F.try_divide("career_wins", "career_fights"), F.lit(0.5)),
        "career_finish_rate": F.coalesce(F.col("career_finish_rate"), zero),
        "days_since_last": F.coalesce(F.datediff(time, "_previous"), F.lit(365)),
    }
    for c in rate_stats:
        cols[f"career_{c}_pm"] = F.coalesce(F.try_divide(f"_cum_{c}", "career_minutes"), zero)
    for c in total_stats:
        cols[f"career_{c}_total"] = F.coalesce(F.col(f"_cum_{c}"), zero)
    if accuracy:
        landed, tried = accuracy
        cols["career_accuracy"] = F.coalesce(F.try_divide(f"_cum_{landed}", f"_cum_{tried}"), zero)
    return out.withColumns(cols).drop("_previous", *[f"_cum_{c}" for c in (*rate_stats, *total_stats)])


def days_since_flag(df: DataFrame, entity, time: str, seq: str, flag: str, name: str,
                    chunk="MONTH") -> DataFrame:
    """Whole days since the entity's last earlier row with a true flag; NULL if never."""
    marked = df.withColumn("_flagged", F.when(_true(flag), F.col(time)))
    out = point_in_time(marked, entity, time, seq, {"_last": prior_max("_flagged")}, chunk)
    return out.withColumn(name, F.datediff(time, "_last")).drop("_flagged", "_last")


def opponent_adjusted(long: DataFrame, contest: str, entity: str, time: str, seq: str,
                      made: str, allowed: str, chunk="MONTH",
                      priors: tuple[str, str] | None = None) -> DataFrame:
    """Output relative to what the opponent usually allows, averaged over earlier contests.

    ``made`` and ``allowed`` are the entity's own per-contest rates. First pass: prior
    means per entity. The two sides of a contest are then matched by one aggregation over
    the contest key instead of a self-join. Second pass: prior means of the differences.
    ``priors`` names prior-mean columns that already exist and saves the first pass.
    """
    if priors:
        base = long.withColumns({"c_made": F.col(priors[0]), "c_allowed": F.col(priors[1])})
    else:
        base = point_in_time(long, entity, time, seq,
                             {"c_made": prior_mean(made), "c_allowed": prior_mean(allowed)}, chunk)
    other = (base.groupBy(contest)
             .agg(*[F.max(F.when(F.col("side") == s, F.col(v))).alias(f"{v}_{s}")
                    for v in ("c_made", "c_allowed") for s in "AB"]))
    def rival(v):
        return F.when(F.col("side") == "A", F.col(f"{v}_B")).otherwise(F.col(f"{v}_A"))

    adjusted = (base.join(other, contest)
                .withColumns({"adj_out": F.col(made) - rival("c_allowed"),
                              "adj_def": F.col(allowed) - rival("c_made")})
                .select(*base.columns, "adj_out", "adj_def"))
    return point_in_time(adjusted, entity, time, seq,
                         {"c_adj_out": prior_mean("adj_out"),
                          "c_adj_def": prior_mean("adj_def")}, chunk)


def class_z(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """z-score against the whole class: two-phase aggregation, class table joined back."""
    stats = df.groupBy(group).agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
    z = F.try_divide(F.col(value) - F.col("_mu"), F.nullif("_sd", F.lit(0.0)))
    return df.join(stats, group, "left").withColumn(name, z).drop("_mu", "_sd")


def balanced_parts(df: DataFrame, keys: list[str], time: str, seq: str, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Rows range-sorted by (keys, time, seq) into parts of about equal size, told in ``_part``.

    However few keys there are, and however busy one is, no part holds more than its share.
    """
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-df.count() // rows_per_part))
    return materialize(df.repartitionByRange(parts, *keys, time, seq).withColumn("_part", F.spark_partition_id()), "parts")


def prior_moments(df: DataFrame, group: str, time: str, seq: str, value: str, mean: str, std: str, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Mean and sample deviation of the group's earlier rows, from triples (n, mean, M2) that merge.

    A few huge groups are the normal case here: rows lie in parts of equal size, every part has one triple per group, and the
    triples of the parts before are merged over one row per (group, part). Inside a part, windows sum what is left after the
    part's own mean, so that large values lose no digits.
    """
    rows = balanced_parts(df, [group], time, seq, rows_per_part)
    keys = [group, "_part"]
    v = F.col(value).cast("double")
    triples = rows.groupBy(*keys).agg(F.count(v).alias("_n"), F.avg(v).alias("_m"), (F.var_pop(v) * F.count(v)).alias("_q"))
    order = W.partitionBy(group).orderBy("_part")
    before = order.rowsBetween(START, -1)
    # means are summed as differences from the group's first one
    shift = triples.withColumn("_c", F.first("_m", ignorenulls=True).over(order.rowsBetween(START, W.unboundedFollowing)))
    d = F.col("_m") - F.col("_c")
    n, s = F.sum("_n").over(before), F.sum(F.col("_n") * d).over(before)
    q = F.sum(F.col("_q") + F.col("_n") * d * d).over(before)
    carry = shift.select(*keys, F.col("_m").alias("_own"), F.coalesce(n, F.lit(0)).alias("_N"), (F.col("_c") + s / F.nullif(n, F.lit(0))).alias("_M"),
                         (q - s * s / F.nullif(n, F.lit(0))).alias("_Q"))
    local = W.partitionBy(*keys).orderBy(time, seq).rowsBetween(START, -1)
    # the group may be NULL
    joined = rows.join(carry.withColumnsRenamed({group: "_g", "_part": "_p"}), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))).drop("_g", "_p")
    e = v - F.col("_own")
    joined = joined.withColumns({"_k": F.count(e).over(local), "_e": F.sum(e).over(local), "_f": F.sum(e * e).over(local)})
    k, here, spread = F.col("_k"), F.col("_own") + F.col("_e") / F.nullif(F.col("_k"), F.lit(0)), F.col("_f") - F.col("_e") * F.col("_e") / F.nullif(F.col("_k"), F.lit(0))
    total, gap = F.col("_N") + k, here - F.col("_M")
    mu = F.when(F.col("_N") == 0, here).when(k == 0, F.col("_M")).otherwise(F.col("_M") + gap * k / total)
    m2 = F.when(F.col("_N") == 0, spread).when(k == 0, F.col("_Q")).otherwise(F.col("_Q") + spread + gap * gap * F.col("_N") * k / total)
    deviation = F.when(total >= 2, F.sqrt(F.greatest(m2, F.lit(0.0)) / (total - 1)))
    return joined.select(*df.columns, F.when(total > 0, mu).alias(mean), deviation.alias(std))


def class_z_point_in_time(df: DataFrame, group: str, time: str, seq: str, value: str, name: str,
                          rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """z-score against earlier rows of the class only."""
    out = prior_moments(df, group, time, seq, value, "_mu", "_sd", rows_per_part)
    z = F.try_divide(F.col(value) - F.col("_mu"), F.nullif("_sd", F.lit(0.0)))
    return out.withColumn(name, z).drop("_mu", "_sd")
