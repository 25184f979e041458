"""Scoring picks, allocating capped stakes, profit and loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from duelmark.functions.pricing import ceil_american, implied_prob, unit_profit
from duelmark.settings import (EDGE_RULE, EVENT_DAY_CAP, LIVE_SOURCE_PREFIX, MAX_ODDS_AGE_MINUTES, MAX_STAKE,
                               MIN_MARKET_BOOKS, TWO_UNIT_RULE)


def score_picks(df: DataFrame, p_model="p_model", se="se", price_a="pr_raw", price_b="pb_raw",
                threshold: float = EDGE_RULE) -> DataFrame:
    """Edges on both sides, the better side (ties to A), net edge and qualification."""
    p, s = F.col(p_model), F.col(se)
    edge_a, edge_b = p - F.col(price_a), (1.0 - p) - F.col(price_b)
    gross = F.greatest(edge_a, edge_b)
    return df.withColumns({
        "edge": gross, "net_edge": gross - s,
        "pick_side": F.when(edge_a >= edge_b, "A").otherwise("B"),
        "qualified": gross - s >= threshold,
    })


def desired_stake(net="net_edge", threshold: float = EDGE_RULE, max_stake: int = MAX_STAKE,
                  high_threshold: float | None = None) -> Column:
    """Stake before the group cap: tiered when a high threshold is given, else flat."""
    n = F.col(net)
    high = max_stake if high_threshold is None else 1
    want = F.lit(high)
    if high_threshold is not None and max_stake >= 2:
        want = F.when(n >= high_threshold, 2).otherwise(1)
    return F.when(n >= threshold, want).otherwise(0)


def allocate(df: DataFrame, group: list[str], row_id: list[str], cap: float | str | None = EVENT_DAY_CAP,
             desired="desired", net="net_edge", stake="stake", eligible: Column | None = None,
             salts: int | None = None) -> DataFrame:
    """Greedy capped allocation by net edge, in closed form.

    stake = least(desired, greatest(0, cap - sum of desired ranked before)). ``cap`` may name a column with each group's
    cap; without a cap every wish is met. Stakes are at least one unit, so only the best ``ceil(cap)`` rows of a group can
    receive one. Groups are split into ``salts`` parts first (by default as many as shuffle partitions); each part nominates its
    best rows, and only the nominees (at most salts x cap per group) meet in one task. Both branches hang on the
    same exchange, so the input is computed and shuffled once, and a hot group is spread.
    ``row_id`` must be unique and orders ties.
    """
    want = F.col(desired)
    if cap is None:
        return df.withColumn(stake, want.cast("int"))
    most = F.col(cap) if isinstance(cap, str) else F.lit(cap)
    salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ok = F.coalesce(want > 0 if eligible is None else (want > 0) & eligible, F.lit(False))
    best = [F.desc(net), *row_id]
    part = W.partitionBy(*group, "_salt").orderBy(F.desc("_ok"), *best)
    # a running count instead of a rank: a rank filter would give the branches different exchanges
    rows = (df.withColumns({"_salt": F.pmod(F.xxhash64(*row_id), F.lit(salts)), "_ok": ok})
            .withColumn("_place", F.count(F.lit(1)).over(part.rowsBetween(W.unboundedPreceding, 0))))
    nominee = F.col("_ok") & F.coalesce(F.col("_place") <= F.ceil(most), F.lit(False))
    order = W.partitionBy(*group).orderBy(*best)
    before = F.coalesce(F.sum(desired).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    paid = rows.filter(nominee).withColumn(stake, F.least(want, F.greatest(F.lit(0), most - before)).cast("int"))
    unlimited = F.when(most.isNull(), want).otherwise(0)
    rest = rows.filter(~nominee).withColumn(stake, unlimited.cast("int"))
    return paid.unionByName(rest).drop("_salt", "_ok", "_place")


def row_pnl(side="pick_side", y="y", odds_a="odds_a", odds_b="odds_b", stake="stake") -> Column:
    """Profit of the staked pick: stake x profit when right, minus stake when wrong."""
    a = F.col(side) == "A"
    won = F.when(a, F.col(y) == 1).otherwise(F.col(y) == 0)
    payout = F.when(a, unit_profit(odds_a)).otherwise(unit_profit(odds_b))
    s = F.col(stake).cast("double")
    return F.when(s > 0, F.when(won, s * payout).otherwise(-s)).otherwise(0.0)


def two_sided_pnl(edge, p="p_model", y="y", odds_a="odds_a", odds_b="odds_b", price_a="pr_raw",
                  price_b="pb_raw", underdogs_only: Column | None = None) -> tuple[Column, Column]:
    """Older simulator: strict edge, both sides may be bet. Returns (number of bets, pnl)."""
    e = edge if isinstance(edge, Column) else F.lit(edge)
    dog = F.lit(False) if underdogs_only is None else underdogs_only
    bet_a = (F.col(p) > F.col(price_a) + e) & (~dog | (F.col(price_a) < 0.5))
    bet_b = ((1 - F.col(p)) > F.col(price_b) + e) & (~dog | (F.col(price_b) < 0.5))
    pnl_a = F.when(bet_a, F.when(F.col(y) == 1, unit_profit(odds_a)).otherwise(-1.0)).otherwise(0.0)
    pnl_b = F.when(bet_b, F.when(F.col(y) == 0, unit_profit(odds_b)).otherwise(-1.0)).otherwise(0.0)
    return bet_a.cast("int") + bet_b.cast("int"), pnl_a + pnl_b


def execution_ladder(df: DataFrame, p: str, se: str,
                     tiers=(("1u", EDGE_RULE), ("2u_candidate", TWO_UNIT_RULE))) -> DataFrame:
    """One row per stake tier with the worst price that still clears its threshold."""
    levels = F.array(*[F.struct(F.lit(n).alias("tier"), F.lit(float(t)).alias("threshold"))
                       for n, t in tiers])
    out = df.withColumn("_t", F.explode(levels)).select(*df.columns, "_t.*")
    price = ceil_american(F.col(p) - F.col(se) - F.col("threshold"))
    return out.withColumn("worst_price", price).filter("worst_price IS NOT NULL")


def eligibility(df: DataFrame, net="net_edge", books="market_books", age="quote_age_minutes",
                source="odds_source", live_prefix=LIVE_SOURCE_PREFIX, threshold: float = EDGE_RULE,
                min_books: int = MIN_MARKET_BOOKS, max_age: float = MAX_ODDS_AGE_MINUTES) -> DataFrame:
    """Adds ``quality_ok``, ``qualified`` and the reason text."""
    enough = F.coalesce(F.col(books) >= min_books, F.lit(True))
    fresh = F.coalesce(F.col(age) <= max_age, F.lit(True)) | ~F.coalesce(
        F.col(source).startswith(live_prefix), F.lit(False))
    ok = enough & fresh
    reason = (F.when((F.col(net) >= threshold) & ok, "eligible").when(~fresh, "price stale")
              .when(~enough, F.lit(f"fewer than {min_books} paired books")).otherwise("below edge rule"))
    return df.withColumns({"quality_ok": ok, "qualified": (F.col(net) >= threshold) & ok,
                           "eligibility_reason": reason})


def cap_reason() -> Column:
    """Reason after allocation: qualified but unstaked means the exposure cap was reached."""
    return (F.when(F.col("qualified") & (F.col("stake") == 0), "event-day exposure cap")
            .otherwise(F.col("eligibility_reason")))


def add_prices(df: DataFrame, odds_a="odds_a", odds_b="odds_b") -> DataFrame:
    return df.withColumns({"pr_raw": implied_prob(odds_a), "pb_raw": implied_prob(odds_b)})
