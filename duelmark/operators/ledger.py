"""Append-only ledgers: snapshots, locked trades and settlements.

Every step returns the *new* rows; ``sources.append`` writes them. Idempotence comes from
deterministic ids and anti joins, so a step can be repeated after a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from duelmark.functions.ids import hash_id
from duelmark.functions.names import pair_key
from duelmark.functions.pricing import devig, signed_price, unit_profit
from duelmark.operators.keys import keep_first, unseen
from duelmark.operators.quality import assert_pre_event
from duelmark.settings import CLOSING_SOURCES, FORWARD_NOTE, FORWARD_STATUS

OFFSETS = (0, -1, 1)            # days between a trade and its result or close, in order of preference


def contest_key(start, a, b) -> Column:
    """Stable contest id: start date and unordered pair."""
    return hash_id(F.date_format(F.col(start) if isinstance(start, str) else start, "yyyy-MM-dd"), pair_key(a, b))


def stamp_text(c) -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def snapshot_rows(predictions: DataFrame, recorded_at, start: str, precision: str, id_parts: list[str],
                  provenance: dict[str, str] | None = None, pick="pick", opp="opp") -> DataFrame:
    """Snapshot rows with deterministic ids and provenance columns."""
    stamp = stamp_text(F.lit(recorded_at).cast("timestamp"))
    out = predictions.withColumns({
        "recorded_at": stamp, "scheduled_start": stamp_text(start), "timing_precision": F.col(precision),
        "fight_key": contest_key(start, pick, opp),
        "snapshot_date": F.date_format(start, "yyyy-MM-dd"),
        **{k: F.lit(v) for k, v in (provenance or {}).items()}})
    return out.withColumn("snapshot_id", hash_id("recorded_at", "fight_key", *id_parts))


def record_snapshots(predictions: DataFrame, existing: DataFrame | None, recorded_at, start: str,
                     precision: str, id_parts: list[str], provenance=None, check: bool = True) -> DataFrame:
    """New snapshot rows; refuses rows that are not pre-event."""
    if check:
        assert_pre_event(predictions, start, recorded_at, ["pick", "opp"])
    rows = snapshot_rows(predictions, recorded_at, start, precision, id_parts, provenance)
    rows = rows.dropDuplicates(["snapshot_id"])
    return rows if existing is None else unseen(rows, existing, ["snapshot_id"])


def lock_trades(snapshots_now: DataFrame, snapshots: DataFrame, trades: DataFrame | None,
                order: list[str], seq: list[str]) -> DataFrame:
    """At most one trade per contest: qualifying, not locked yet, linked to the latest snapshot.

    ``order`` picks among several qualifying rows of one contest (first wins); ``seq``
    orders the snapshot log (last wins).
    """
    wanted = snapshots_now.filter(F.col("bet") & (F.col("stake") > 0))
    one = keep_first(wanted, ["fight_key"], order)
    if trades is not None:
        one = unseen(one, trades, ["fight_key"])
    latest = snapshots.groupBy("fight_key").agg(F.max_by("snapshot_id", F.struct(*seq)).alias("_latest"))
    out = one.join(latest, "fight_key", "left")
    return (out.withColumn("snapshot_id", F.coalesce("_latest", "snapshot_id"))
            .withColumn("trade_id", hash_id(F.lit("official"), "fight_key"))
            .withColumnRenamed("recorded_at", "locked_at").drop("_latest"))


def timing_valid(locked="locked_at", start="scheduled_start") -> Column:
    """Locked strictly before the start; unparsable times are invalid."""
    a, b = F.try_to_timestamp(F.col(locked).cast("string")), F.try_to_timestamp(F.col(start).cast("string"))
    return F.coalesce(a < b, F.lit(False))


def timing_rejects(trades: DataFrame) -> DataFrame:
    return trades.agg(F.count_if(timing_valid()).alias("valid"), F.count_if(~timing_valid()).alias("invalid"))


def _serving(table: DataFrame, tag: str, **payload: Column) -> DataFrame:
    """(pair, _day, tag): a dated row for each trade day that it can serve, with the rank of that offset."""
    days = F.explode(F.array(*[F.struct(F.lit(n).alias("rank"), F.date_sub("date", o).alias("day")) for n, o in enumerate(OFFSETS)]))
    rows = table.filter("pair IS NOT NULL AND date IS NOT NULL").select("pair", *[v.alias(k) for k, v in payload.items()], days.alias("_o"))
    return rows.select("pair", F.col("_o.day").alias("_day"), F.struct(F.col("_o.rank").alias("rank"), *payload).alias(tag))


def settle(trades: DataFrame, settled: DataFrame | None, results: DataFrame, captured: DataFrame | None,
           master: DataFrame | None, labels=CLOSING_SOURCES) -> DataFrame:
    """Settlement rows for valid, unsettled trades with a result on day 0, -1 or +1.

    trades: trade_id, locked_at, scheduled_start, date, pick, opp, pair, price, market, stake
    results: date, pair, side_a, winner; unique on (date, pair)
    captured: date, pair, side_a, odds_a, odds_b, prob_a (the preferred close)
    master: date, pair, side_a, odds_a, odds_b (the fallback close)

    Trades, results and both closes meet in one pass: the dated tables are told to the days they can serve, all rows are dealt by
    (pair, day) once, and the smallest offset wins in each table. Neither trades nor their copies are joined.
    """
    open_trades = trades.filter(timing_valid())
    if settled is not None:
        open_trades = unseen(open_trades, settled, ["trade_id"])
    rows = open_trades.filter("pair IS NOT NULL AND date IS NOT NULL").select("pair", F.col("date").alias("_day"), F.struct(*trades.columns).alias("_trade"))
    decided = results.filter(F.col("winner").isin("A", "B"))
    rows = rows.unionByName(_serving(decided, "_res", side=F.col("side_a"), winner=F.col("winner")), allowMissingColumns=True)
    closes = []
    for table, tag in ((captured, "t30"), (master, "mst")):
        if table is None:
            continue
        prob = F.col("prob_a") if "prob_a" in table.columns else devig("odds_a", "odds_b")
        close = _serving(table, tag, side=F.col("side_a"), a=F.col("odds_a"), b=F.col("odds_b"), p=prob)
        rows = rows.unionByName(close, allowMissingColumns=True)
        closes.append(tag)
    same = W.partitionBy("pair", "_day")
    t = rows.withColumns({tag: F.min(tag).over(same) for tag in ("_res", *closes)}).filter("_trade IS NOT NULL AND _res IS NOT NULL")
    t = t.select("_trade.*", F.col("_res.side").alias("r_side_a"), F.col("_res.winner").alias("r_winner"),
                 *[F.col(f"{tag}.{c}").alias(f"{tag}_{c}") for tag in closes for c in ("side", "a", "b", "p")])

    price = F.regexp_replace(F.col("price").cast("string"), r"\+", "").try_cast("double")
    won = (F.col("r_winner") == "A") == (F.col("pick") == F.col("r_side_a"))
    won = F.when(price.isNull(), False).otherwise(won)
    stake = F.col("stake").cast("double")
    pnl = F.when(price.isNull(), 0.0).when(won, stake * unit_profit(price)).otherwise(-stake)

    close_price, close_market = F.lit(None).cast("double"), F.lit(None).cast("double")
    source = F.lit(None).cast("string")
    names = dict(zip(("t30", "mst"), labels))
    for tag in reversed(closes):
        has = F.col(f"{tag}_side").isNotNull()
        is_a = F.col("pick") == F.col(f"{tag}_side")
        close_price = F.when(has, F.when(is_a, F.col(f"{tag}_a")).otherwise(F.col(f"{tag}_b"))).otherwise(close_price)
        prob = F.when(is_a, F.col(f"{tag}_p")).otherwise(1.0 - F.col(f"{tag}_p")) * 100.0
        close_market = F.when(has, prob).otherwise(close_market)
        source = F.when(has, names[tag]).otherwise(source)
    return t.select(
        "trade_id", F.when(won, "WIN").otherwise("LOSS").alias("result"), F.bround(pnl, 6).alias("pnl"),
        signed_price(close_price).alias("closing_price"), F.bround(close_market, 6).alias("closing_market"),
        F.bround(close_market - F.col("market").try_cast("double"), 6).alias("clv_prob"),
        source.alias("closing_source"))


def ledger_summary(trades: DataFrame, settlements: DataFrame) -> DataFrame:
    """One row: trades, settled, staked, pnl, ROI and closing-line value."""
    n = trades.agg(F.count(F.lit(1))).scalar()
    j = settlements.join(trades.select("trade_id", "stake"), "trade_id", "left")
    out = j.agg(F.count(F.lit(1)).alias("settled"),
                F.coalesce(F.sum(F.col("stake").cast("double")), F.lit(0.0)).alias("staked"),
                F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("pnl"),
                F.avg("clv_prob").alias("mean_clv"),
                F.avg((F.col("clv_prob") > 0).cast("double")).alias("positive_clv_rate"))
    return out.select(n.alias("official_trades"), "settled", F.bround("staked", 4).alias("staked"),
                      F.bround("pnl", 4).alias("pnl"),
                      F.bround(F.try_divide("pnl", "staked"), 6).alias("roi"),
                      F.bround("mean_clv", 4).alias("mean_clv_prob_points"),
                      F.bround("positive_clv_rate", 4).alias("positive_clv_rate"))


def forward_verdict(summary: DataFrame) -> DataFrame:
    return summary.withColumns({
        "status": F.lit(FORWARD_STATUS), "interpretation": F.lit(FORWARD_NOTE)})
