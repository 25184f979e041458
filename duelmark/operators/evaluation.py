"""Metrics, breakdowns, grids, drift and gates.

Parameter grids are exploded from a literal array next to the rows, so every grid is a
single scan with map-side aggregation: no cross join and no job per parameter.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from duelmark.functions.pricing import clip
from duelmark.operators.betting import allocate, row_pnl, two_sided_pnl
from duelmark.operators.bootstrap import grouped_intervals, value_counts, weighted_sums
from duelmark.operators.running import equity_curve, max_drawdown
from duelmark.session import materialize
from duelmark.settings import (CLV_GATE_TEXT, EDGE_BUCKETS, EDGE_RULE, EVENT_DAY_CAP, POLICIES, ROI_GATE_TEXT)


def log_loss_term(y, p, low: float = 0.001) -> Column:
    q = clip(p, low, 1 - low)
    return -F.when(F.col(y) == 1, F.ln(q)).otherwise(F.ln(1 - q))


def brier_term(y, p, low: float = 0.001) -> Column:
    d = clip(p, low, 1 - low) - F.col(y)
    return d * d


def hit_term(y, p) -> Column:
    return ((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("double")


def prob_metrics(y: str, p: str, suffix: str = "", low: float = 0.001) -> list[Column]:
    """Log loss, Brier score and accuracy as aggregate columns."""
    return [F.avg(log_loss_term(y, p, low)).alias(f"log_loss{suffix}"),
            F.avg(brier_term(y, p, low)).alias(f"brier{suffix}"),
            F.avg(hit_term(y, p)).alias(f"accuracy{suffix}")]


def event_rollup(df: DataFrame, date: str = "date", source: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n_contests"),
            F.count_if(F.col("stake") > 0).alias("n_bets"),
            F.sum("stake").cast("double").alias("staked"), F.sum("pnl").alias("pnl")]
    if source:
        # source labels are a small closed set
        aggs.append(F.array_join(F.sort_array(F.collect_set(source)), ",").alias("source_list"))
    return df.groupBy(date).agg(*aggs)


def breakdown(df: DataFrame, by: str) -> DataFrame:
    """Count, share, bets, staked, pnl and ROI per label."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return (df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("stake") > 0).alias("bets"),
        F.sum("stake").cast("double").alias("staked"), F.sum("pnl").alias("pnl"))
        .withColumns({"roi": F.try_divide("pnl", "staked"), "share": F.col("n") / total}))


def yearly_metrics(df: DataFrame, date="date", y="y", model="p_model", market="p_line",
                   close: str | None = None) -> DataFrame:
    closes = F.count(close) if close else F.lit(0).cast("long")
    out = df.groupBy(F.year(date).alias("year")).agg(
        F.count(F.lit(1)).alias("contests"),
        F.avg(log_loss_term(y, model)).alias("model_log_loss"),
        F.avg(log_loss_term(y, market)).alias("market_log_loss"), closes.alias("close_contests"))
    return out.withColumn("model_minus_market", F.col("model_log_loss") - F.col("market_log_loss"))


def agreement(df: DataFrame, y="y", model="p_model", market="p_line") -> DataFrame:
    m, k = F.col(model) >= 0.5, F.col(market) >= 0.5
    split = m != k
    right = (m.cast("int") == F.col(y)).cast("double")
    return df.agg(
        F.avg((~split).cast("double")).alias("agree_rate"), F.corr(model, market).alias("correlation"),
        F.count_if(split).alias("disagreements"), F.avg(F.when(split, right)).alias("model_right"),
        F.avg(F.when(split, 1 - right)).alias("market_right"))


def explode_params(df: DataFrame, params: list[dict]) -> DataFrame:
    """Copy each row to every parameter set (a literal list, never a table)."""
    names = list(params[0])
    kinds = {n: ("string" if any(isinstance(p[n], str) for p in params) else "double") for n in names}
    structs = [F.struct(*[F.lit(p[n]).cast(kinds[n]).alias(n) for n in names]) for p in params]
    return df.withColumn("_p", F.explode(F.array(*structs))).select(*df.columns, *[F.col(f"_p.{n}") for n in names])


def threshold_grid(df: DataFrame, edges=(0.03, 0.05, 0.08, 0.12), segments=("all", "dogs")) -> DataFrame:
    """Edge threshold x segment: number of bets, pnl and ROI; empty cells are absent."""
    grid = explode_params(df, [{"min_edge": e, "segment": s} for e in edges for s in segments])
    n, pnl = two_sided_pnl(F.col("min_edge"), underdogs_only=F.col("segment") == "dogs")
    return (grid.withColumns({"_n": n, "_pnl": pnl}).groupBy("min_edge", "segment")
            .agg(F.sum("_n").alias("n_bets"), F.sum("_pnl").alias("pnl"))
            .filter("n_bets > 0").withColumn("roi", F.col("pnl") / F.col("n_bets")))


def edge_summary(df: DataFrame, edges=(0.00, 0.05, 0.10), by: list[str] = ()) -> DataFrame:
    """Bets, wins, pnl and ROI per edge (and per extra key) for the two-sided simulator."""
    grid = explode_params(df, [{"min_edge": e} for e in edges])
    n, pnl = two_sided_pnl(F.col("min_edge"))
    wins = (((F.col("p_model") > F.col("pr_raw") + F.col("min_edge")) & (F.col("y") == 1)).cast("int")
            + ((1 - F.col("p_model") > F.col("pb_raw") + F.col("min_edge")) & (F.col("y") == 0)).cast("int"))
    return (grid.withColumns({"_n": n, "_pnl": pnl, "_w": wins}).groupBy("min_edge", *by)
            .agg(F.sum("_n").alias("n_bets"), F.sum("_w").alias("wins"), F.sum("_pnl").alias("pnl"))
            .filter("n_bets > 0").withColumn("roi", F.col("pnl") / F.col("n_bets")))


def bucket_edges(df: DataFrame, net="net_edge", buckets=EDGE_BUCKETS) -> DataFrame:
    """Half-open edge buckets as a label column; rows outside every bucket are dropped."""
    label = F.lit(None).cast("string")
    for name, low, high in reversed(buckets):
        inside = F.col(net) >= low if high is None else (F.col(net) >= low) & (F.col(net) < high)
        label = F.when(inside, name).otherwise(label)
    return df.withColumn("bucket", label).filter("bucket IS NOT NULL")


def edge_bucket_report(df: DataFrame, clv: str | None = None, by: list[str] = (), date: str = "date", draws: int = 10000) -> DataFrame:
    """Flat-stake result per edge bucket, with event-clustered intervals of ROI and closing-line value.

    Rows are summed per bucket and event once; totals and intervals come from these sums.
    """
    rows = bucket_edges(df).withColumn("_one", F.lit(1)).withColumn("_unit", row_pnl(stake="_one"))
    line = F.col(clv) if clv else F.lit(None).cast("double")
    cells = rows.groupBy(*by, "bucket", date).agg(F.count(F.lit(1)).alias("bets"), F.sum("_unit").alias("pnl"),
                                                  F.count(line).alias("clv_bets"), F.sum(line).alias("clv"))
    cells = materialize(cells, "bucket-events")
    keys = [*by, "bucket"]
    out = cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("bets", "pnl", "clv_bets", "clv")])
    ratios = {"roi": ("pnl", "bets")} | ({"clv": ("clv", "clv_bets")} if clv else {})
    out = out.join(grouped_intervals(cells, keys, [date], ratios, draws), keys)
    out = out.withColumns({"roi": F.col("pnl") / F.col("bets"), "mean_clv": F.try_divide("clv", "clv_bets")})
    return out.drop("clv") if clv else out.drop("clv", "clv_bets", "mean_clv")


def clv_points(side="pick_side", entry="p_line", close="p_close_line") -> Column:
    """Closing minus entry probability of the picked side, in points."""
    def pick(c):
        return F.when(F.col(side) == "A", F.col(c)).otherwise(1.0 - F.col(c))
    return (pick(close) - pick(entry)) * 100.0


def clv_report(df: DataFrame, clv="clv", stake="stake", close="p_close_line", y="y") -> DataFrame:
    active = (F.col(stake) > 0) & F.col(close).isNotNull()
    v = F.when(active, F.col(clv))
    return df.agg(
        F.count(close).alias("contests_with_close"),
        F.avg(F.col(close).isNotNull().cast("double")).alias("close_coverage"),
        F.avg(F.when(F.col(close).isNotNull(), log_loss_term(y, close))).alias("log_loss_close"),
        F.count(v).alias("active_bets_with_close"), F.avg(v).alias("mean_clv"),
        F.avg((v > 0).cast("double")).alias("positive_clv_rate"))


def apply_policies(df: DataFrame, row_id: list[str], date="date", policies=POLICIES, by: list[str] = ()) -> DataFrame:
    """All staking policies in one pass, the policy name in the allocation key and its cap in a column."""
    rows = explode_params(df, list(policies))
    want = F.when((F.col("max_stake") >= 2) & (F.col("net_edge") >= F.col("high")), 2).otherwise(1)
    rows = rows.withColumn("desired", F.when(F.col("net_edge") >= EDGE_RULE, want).otherwise(0))
    out = allocate(rows, [*by, "policy", date], row_id, "cap")
    return out.withColumn("pnl", row_pnl())


def nominees(df: DataFrame, row_id: list[str], date="date", policies=POLICIES, by: list[str] = ()) -> DataFrame:
    """The rows of every event day that any of the policies can stake; a day without one keeps rows, so that it is still counted.

    All policies wish for the same rows and rank them alike, and a stake is at least one unit, so the best ``ceil(cap)`` rows of the widest cap
    are enough. They are picked before rows are copied per policy; tasks send no more than these.
    """
    caps = [p["cap"] for p in policies]
    if None in caps:
        return df
    wish = F.coalesce(F.col("net_edge") >= EDGE_RULE, F.lit(False))
    place = F.row_number().over(W.partitionBy(*by, date).orderBy(wish.desc(), F.desc("net_edge"), *row_id))
    return df.withColumn("_place", place).filter(F.col("_place") <= max(1, *map(ceil, caps))).drop("_place")


def policy_report(df: DataFrame, row_id: list[str], date="date", bucket: Column | None = None, policies=POLICIES, by: list[str] = (),
                  draws: int = 10000) -> DataFrame:
    """Bets, stake, profit, ROI with its event-clustered interval, and drawdown of every policy.

    Only rows that can receive a stake are allocated. The allocation is summed per policy and event once; the totals, the equity curve and the intervals come from these sums.
    ``bucket`` cuts the events for the running totals (years by default).
    """
    keys = [*by, "policy"]
    rows = apply_policies(nominees(df, row_id, date, policies, by), row_id, date, policies, by)
    events = rows.groupBy(*keys, date).agg(F.count_if(F.col("stake") > 0).alias("bets"), F.sum("stake").cast("double").alias("staked"),
                                           F.sum("pnl").alias("pnl"))
    events = materialize(events, "policy-events")
    out = events.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("bets", "staked", "pnl")]).withColumn("roi", F.try_divide("pnl", "staked"))
    curve = equity_curve(events, [date], "pnl", F.year(date) if bucket is None else bucket, keys)
    active = events.filter("staked > 0")
    return (out.join(max_drawdown(curve, keys), keys)
            .join(grouped_intervals(active, keys, [date], {"roi": ("pnl", "staked")}, draws), keys, "left"))


def allocate_grid(df: DataFrame, row_id: list[str], thresholds, caps, date="date") -> DataFrame:
    """Threshold x cap grid of the tiered rule in one scan and one allocation; ``None`` as cap means unlimited."""
    cells = [{"threshold": float(t), "high": max(0.08, 2 * t), "cap": None if c is None else float(c)} for t in thresholds for c in caps]
    rows = explode_params(df, cells)
    want = F.when(F.col("net_edge") >= F.col("high"), 2).otherwise(1)
    rows = rows.withColumn("desired", F.when(F.col("net_edge") >= F.col("threshold"), want).otherwise(0))
    return allocate(rows, ["threshold", "cap", date], row_id, "cap").withColumn("pnl", row_pnl())


def stake_summary(df: DataFrame, by: list[str]) -> DataFrame:
    return (df.groupBy(*by).agg(F.count_if(F.col("stake") > 0).alias("bets"),
                                F.sum("stake").cast("double").alias("staked"), F.sum("pnl").alias("pnl"))
            .withColumn("roi", F.try_divide("pnl", "staked")))


def drift_summary(df: DataFrame, period: Column, fields: list[str], stake: str | None = None) -> DataFrame:
    """Mean, population std and missing count per (field, period), with the row count and the share of rows with a stake.

    All fields are aggregated in one pass; only the tiny result is unpivoted.
    """
    bet = F.avg((F.col(stake) > 0).cast("double")) if stake else F.lit(None).cast("double")
    aggs = [F.count(F.lit(1)).alias("rows"), bet.alias("bet_rate")]
    for f in fields:
        aggs += [F.avg(f).alias(f"{f}__mean"), F.stddev_pop(f).alias(f"{f}__std"),
                 F.count_if(F.col(f).isNull()).alias(f"{f}__missing")]
    wide = df.groupBy(period.alias("period")).agg(*aggs)
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}__mean").alias("mean"),
                               F.col(f"{f}__std").alias("std"), F.col(f"{f}__missing").alias("missing"))
                      for f in fields])
    return wide.select("period", "rows", "bet_rate", F.explode(cells).alias("c")).select("period", "rows", "bet_rate", "c.*")


def drift_distance(df: DataFrame, period: Column, ranges: dict[str, tuple[float, float]], bins: int = 20,
                   reference="reference", recent="recent") -> DataFrame:
    """Distance of each field's distributions in two periods: half the sum of differences of the shares per bin.

    ``ranges`` gives a field's range; values outside lie in its outer bins, missing ones are left out. Counts per
    (field, bin, period) are merged from counts per task, at any size.
    """
    def place(field: str, low: float, high: float) -> Column:
        at = F.floor((F.col(field).cast("double") - low) / (high - low) * bins)
        inside = F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int")
        return F.struct(F.lit(field).alias("field"), F.when(F.col(field).isNotNull(), inside).alias("bin"))

    cells = df.select(period.alias("period"), F.inline(F.array(*[place(f, *r) for f, r in ranges.items()]))).filter("bin IS NOT NULL")
    counts = cells.groupBy("field", "bin").agg(F.count_if(F.col("period") == reference).alias("a"), F.count_if(F.col("period") == recent).alias("b"))
    whole = counts.groupBy("field").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gap = F.abs(F.try_divide("a", "na") - F.try_divide("b", "nb"))
    return counts.join(whole, "field").groupBy("field").agg((F.sum(gap) / 2).alias("distance"), F.count(F.lit(1)).alias("bins"))


def source_counts(df: DataFrame, period: Column, source: str, recent="recent") -> DataFrame:
    """Rows per source in the recent period."""
    return df.filter(period == recent).groupBy(source).agg(F.count(F.lit(1)).alias("n"))


def drift_warnings(summary: DataFrame, reference="reference", recent="recent", z: float = 2.0) -> DataFrame:
    """Fields whose recent mean moved by at least ``z`` reference deviations."""
    def at(c, p):
        return F.max(F.when(F.col("period") == p, F.col(c)))
    out = summary.groupBy("field").agg(at("mean", reference).alias("reference_mean"),
                                       at("std", reference).alias("reference_std"),
                                       at("mean", recent).alias("recent_mean"))
    shift = F.when(F.col("reference_std") > 1e-12,
                   (F.col("recent_mean") - F.col("reference_mean")) / F.col("reference_std")).otherwise(0.0)
    return out.withColumn("z_shift", shift).filter(F.abs("z_shift") >= z)


def gate(report: DataFrame, checks: list[tuple[str, str, Column, str]]) -> DataFrame:
    """One row per check from a one-row report: (name, observed column, passed, required)."""
    cells = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(p, F.lit(False)).alias("passed"),
                               F.col(o).cast("double").alias("observed"), F.lit(r).alias("required"))
                      for n, o, p, r in checks])
    return report.select(F.explode(cells).alias("c")).select("c.*")


def promotion_gate(report: DataFrame, min_events=50, min_bets=200, min_clv=200, min_rate=0.55) -> DataFrame:
    """Seven promotion checks over a one-row report."""
    c = F.col
    r = report.withColumn("ll_delta", c("log_loss_model") - c("log_loss_market"))
    return gate(r, [
        ("minimum_events", "events", c("events") >= min_events, f">= {min_events}"),
        ("minimum_bets", "bets", c("bets") >= min_bets, f">= {min_bets}"),
        ("positive_roi_interval", "roi_low", c("roi_low") > 0, ROI_GATE_TEXT),
        ("model_beats_entry_market", "ll_delta", c("ll_delta") < 0, "model-minus-market log loss < 0"),
        ("minimum_active_clv_bets", "clv_bets", c("clv_bets") >= min_clv, f">= {min_clv}"),
        ("positive_clv_interval", "clv_low", c("clv_low") > 0, CLV_GATE_TEXT),
        ("positive_clv_rate", "clv_rate", c("clv_rate") > min_rate, f"> {min_rate}"),
    ])


def live_gate(report: DataFrame, min_events=50, min_bets=200) -> DataFrame:
    c = F.col
    return gate(report, [
        ("minimum_events", "events", c("events") >= min_events, f">= {min_events}"),
        ("minimum_bets", "bets", c("bets") >= min_bets, f">= {min_bets}"),
        ("positive_roi_interval", "roi_low", c("roi_low") > 0, ROI_GATE_TEXT),
    ])


def staking_gate(report: DataFrame, min_bets=100) -> DataFrame:
    """Eight candidate checks; prefixes ``prod_`` and ``entry_`` name the two audits."""
    c = F.col
    sized = [(f"{label}_at_least_{min_bets}", col, c(col) >= min_bets, f">= {min_bets}") for label, col in (
        ("production_candidate_bets", "prod_bets"), ("entry_candidate_bets", "entry_bets"),
        ("entry_candidate_clv_bets", "entry_clv_bets"))]
    lows = [(f"{label}_lower_positive", col, c(col) > 0, "> 0") for label, col in (
        ("production_candidate_roi_ci", "prod_roi_low"), ("entry_candidate_roi_ci", "entry_roi_low"),
        ("production_candidate_policy_roi_ci", "prod_policy_low"),
        ("entry_candidate_policy_roi_ci", "entry_policy_low"), ("entry_candidate_clv_ci", "entry_clv_low"))]
    return gate(report, sized + lows)


def staking_report(buckets: DataFrame, policies: DataFrame, production="production", entry="entry", bucket="10_plus",
                   policy="candidate_2u_at_10_day_cap2", key="prediction_set") -> DataFrame:
    """The one-row report of the staking gate from bucket and policy reports of two prediction sets."""
    def at(column: str, prediction_set: str) -> Column:
        return F.max(F.when(F.col(key) == prediction_set, F.col(column)))

    b = buckets.filter(F.col("bucket") == bucket).agg(
        F.coalesce(at("bets", production), F.lit(0)).alias("prod_bets"), F.coalesce(at("bets", entry), F.lit(0)).alias("entry_bets"),
        F.coalesce(at("clv_bets", entry), F.lit(0)).alias("entry_clv_bets"), at("roi_low", production).alias("prod_roi_low"),
        at("roi_low", entry).alias("entry_roi_low"), at("clv_low", entry).alias("entry_clv_low"))
    p = policies.filter(F.col("policy") == policy).agg(at("roi_low", production).alias("prod_policy_low"), at("roi_low", entry).alias("entry_policy_low"))
    # one row each
    return b.withColumns({c: p.select(c).scalar() for c in ("prod_policy_low", "entry_policy_low")})


def verdict(checks: DataFrame, passed: str, failed: str) -> DataFrame:
    """Overall status of a gate."""
    return checks.agg(F.when(F.bool_and("passed"), passed).otherwise(failed).alias("status"),
                      F.count_if("passed").alias("passed_checks"), F.count(F.lit(1)).alias("checks"))


def freshness(results: DataFrame, tracked: DataFrame, keys: list[str], date: str, start: str, now,
              grace_hours: int = 12, stale_days: int = 21) -> DataFrame:
    """One row: latest result, tracked contests without a result, and the status."""
    done = tracked.filter(F.col(start) < F.lit(now) - F.expr(f"INTERVAL {grace_hours} HOURS"))
    missing = done.join(results.select(*keys).distinct(), keys, "left_anti")
    n_missing = missing.agg(F.count(F.lit(1))).scalar()
    out = results.agg(F.max(date).alias("latest_result")).withColumn("n_missing", n_missing)
    age = F.greatest(F.lit(0), F.datediff(F.lit(now), F.col("latest_result")))
    lagging, old = F.col("n_missing") > 0, age > stale_days
    return out.withColumns({
        "age_days": age,
        "status": F.when(lagging, "lagging").when(old, "check").otherwise("current"),
        "message": F.when(lagging, F.format_string("%d completed tracked contest(s) await results", "n_missing"))
        .when(old, F.format_string("latest result is %d days old", age))
        .otherwise("no completed tracked contests are missing")})


def blend_scores(df: DataFrame, weights, row_id: list[str], date="date", keep: list[str] = ()) -> DataFrame:
    """Rows scored under every fixed market weight, allocated per (weight, day)."""
    from duelmark.operators.betting import desired_stake, score_picks

    rows = explode_params(df, [{"market_weight": w} for w in weights])
    w = F.col("market_weight")
    rows = rows.withColumns({"p_model": w * F.col("p_line") + (1 - w) * F.col("p_model"),
                             "se": (1 - w) * F.col("se")})
    rows = score_picks(rows).withColumn("desired", desired_stake())
    out = allocate(rows, ["market_weight", date], row_id, EVENT_DAY_CAP)
    return out.withColumn("pnl", row_pnl())


def blend_report(df: DataFrame, weights, row_id: list[str], date="date", close: str = "p_close_line", y="y", draws: int = 10000) -> DataFrame:
    """Fixed market blends ranked by log loss: probability metrics, stakes, ROI and closing-line value with intervals.

    ``close`` is a benchmark only. The scored rows are summed per blend and event once. ``rank`` 1 is the smallest log loss.
    """
    rows = blend_scores(df, weights, row_id, date)
    active = F.col("stake") > 0
    line = F.when(active, clv_points(close=close))
    sums = {"n": F.count(F.lit(1)), "_ll": F.sum(log_loss_term(y, "p_model")), "_br": F.sum(brier_term(y, "p_model")), "_hit": F.sum(hit_term(y, "p_model")),
            "bets": F.count_if(active), "staked": F.sum("stake").cast("double"), "pnl": F.sum("pnl"),
            "clv_bets": F.count(line), "_clv": F.coalesce(F.sum(line), F.lit(0.0)), "_up": F.count_if(line > 0)}
    key = "market_weight"
    cells = materialize(rows.groupBy(key, date).agg(*[v.alias(k) for k, v in sums.items()]), "blend-events")
    out = cells.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums])
    ratios = {"roi": ("pnl", "staked"), "clv": ("_clv", "clv_bets")}
    out = out.join(grouped_intervals(cells, [key], [date], ratios, draws), key)
    out = out.withColumns({"log_loss": F.col("_ll") / F.col("n"), "brier": F.col("_br") / F.col("n"), "accuracy": F.col("_hit") / F.col("n"),
                           "roi": F.try_divide("pnl", "staked"), "mean_clv": F.try_divide("_clv", "clv_bets"),
                           "positive_clv_rate": F.try_divide("_up", "clv_bets")})
    # one row per blend
    out = out.withColumn("rank", F.row_number().over(W.orderBy("log_loss", key)))
    return out.drop("_ll", "_br", "_hit", "_clv", "_up", "n")


def line_summary(df: DataFrame, y="y", model="p_model", market="p_line") -> DataFrame:
    """One row: log loss and accuracy of model and line, and the model's log loss minus the line's."""
    out = df.agg(F.count(F.lit(1)).alias("n"), F.avg(log_loss_term(y, model)).alias("model_log_loss"), F.avg(log_loss_term(y, market)).alias("line_log_loss"),
                 F.avg(hit_term(y, model)).alias("model_accuracy"), F.avg(hit_term(y, market)).alias("line_accuracy"))
    return out.withColumn("log_loss_delta", F.col("model_log_loss") - F.col("line_log_loss"))


def edge_intervals(df: DataFrame, edges=(0.00, 0.05, 0.10), least: int = 20, draws: int = 4000, seed: int = 0) -> DataFrame:
    """Bets, ROI and its interval per edge of the two-sided simulator, for edges with at least ``least`` bets.

    A bet's profit takes few values, so bets are collapsed to (edge, profit) cells with Poisson(bets) weights.
    """
    n, pnl = two_sided_pnl(F.col("min_edge"))
    bets = explode_params(df, [{"min_edge": e} for e in edges]).withColumns({"_n": n, "_pnl": pnl}).filter("_n > 0")
    cells = materialize(value_counts(bets, "_pnl", ["min_edge"]), "edge-cells")
    out = cells.groupBy("min_edge").agg(F.sum("n").alias("n_bets"), F.sum("total").alias("pnl")).filter(F.col("n_bets") >= least)
    means = cells.withColumns({"mean": F.col("total") / F.col("n"), "one": F.lit(1.0)})
    sums = weighted_sums(means, ["min_edge"], ["min_edge", "cell"], ["mean", "one"], draws, seed, count="n")
    ci = sums.groupBy("min_edge").agg(*[F.percentile(F.try_divide("mean", "one"), q).alias(f"roi_{end}") for end, q in (("low", 0.05), ("high", 0.95))])
    return out.join(ci, "min_edge").withColumn("roi", F.col("pnl") / F.col("n_bets"))
