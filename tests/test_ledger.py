import datetime as dt

import pytest
from pyspark.sql import functions as F

from duelmark.functions import pair_key
from duelmark.operators import ledger as lg


def prediction(spark, start="2099-01-02 03:00:00"):
    df = spark.createDataFrame([("Fighter A", "Fighter B", "+120", 44.0, True, 1, start)],
                               "pick string, opp string, price string, market double, bet boolean, stake int, start string")
    return df.withColumns({"start": F.col("start").cast("timestamp"), "precision": F.lit("exact")})


PARTS = ["pick", "opp", "price"]


def test_retroactive_snapshot_is_rejected(spark):
    with pytest.raises(ValueError, match="retroactive"):
        lg.record_snapshots(prediction(spark, "2000-01-02 03:00:00"), None, dt.datetime(2000, 1, 3), "start", "precision", PARTS)


def test_lock_is_idempotent_and_links_the_latest_snapshot(spark):
    p, now, later = prediction(spark), dt.datetime(2099, 1, 1), dt.datetime(2099, 1, 1, 1)
    snaps = lg.record_snapshots(p, None, now, "start", "precision", PARTS)
    assert snaps.count() == 1
    assert lg.record_snapshots(p, snaps, now, "start", "precision", PARTS).count() == 0
    log = snaps.unionByName(lg.record_snapshots(p, snaps, later, "start", "precision", PARTS))
    assert log.count() == 2
    trades = lg.lock_trades(snaps, log, None, ["snapshot_id"], ["recorded_at"])
    row = trades.first()
    assert row.snapshot_id == log.orderBy(F.desc("recorded_at")).first().snapshot_id != snaps.first().snapshot_id
    again = lg.snapshot_rows(p, later, "start", "precision", PARTS)
    assert lg.lock_trades(again, log, trades, ["snapshot_id"], ["recorded_at"]).count() == 0


def trade(spark, locked="2025-01-01T20:00:00Z", start="2025-01-02T03:00:00Z", price="+120"):
    df = spark.createDataFrame([("t1", locked, start, "2025-01-02", "fighter a", "fighter b", price, 44.0, 1)],
                               "trade_id string, locked_at string, scheduled_start string, date string, pick string, opp string, price string, market double, stake int")
    return df.withColumns({"date": F.col("date").cast("date"), "pair": pair_key("pick", "opp")})


def result(spark, date="2025-01-01", winner="A"):
    df = spark.createDataFrame([(date, "fighter a|fighter b", "fighter a", winner)], "date string, pair string, side_a string, winner string")
    return df.withColumn("date", F.col("date").cast("date"))


def test_unverifiable_trade_does_not_settle(spark):
    for bad in (trade(spark, "2025-01-03T00:00:00Z"), trade(spark, start="when?")):
        assert lg.settle(bad, None, result(spark), None, None).count() == 0
        assert lg.timing_rejects(bad).first().invalid == 1


def test_captured_close_is_preferred_across_the_date_boundary(spark):
    close = spark.createDataFrame([("2025-01-02", "fighter a|fighter b", "fighter a", -150.0, 130.0, 0.60)],
                                  "date string, pair string, side_a string, odds_a double, odds_b double, prob_a double").withColumn("date", F.col("date").cast("date"))
    master = close.drop("prob_a").withColumn("odds_a", F.lit(-999.0))
    r = lg.settle(trade(spark), None, result(spark), close, master).first()
    assert (r.closing_source, r.closing_market, r.clv_prob, r.closing_price, r.result, r.pnl) == ("standardized-t30", 60.0, 16.0, "-150", "WIN", 1.2)
    r = lg.settle(trade(spark), None, result(spark), None, close.drop("prob_a")).first()
    fair = 0.6 / (0.6 + 100 / 230)
    assert r.closing_source == "master" and abs(r.closing_market - fair * 100) < 1e-5
    r = lg.settle(trade(spark), None, result(spark, winner="B"), None, None).first()
    assert (r.result, r.pnl, r.closing_price, r.closing_market, r.closing_source) == ("LOSS", -1.0, None, None, None)
    assert lg.settle(trade(spark), None, result(spark, winner="draw"), None, None).count() == 0
    assert lg.settle(trade(spark), None, result(spark, "2025-01-04"), None, None).count() == 0
    bad = lg.settle(trade(spark, price="?"), None, result(spark), None, None).first()
    assert (bad.result, bad.pnl) == ("LOSS", 0.0)


def test_summary_of_nothing_and_something(spark):
    t = trade(spark)
    s = lg.settle(t, None, result(spark), None, None)
    r = lg.ledger_summary(t, s).first()
    assert (r.official_trades, r.settled, r.staked, r.pnl, r.roi, r.mean_clv_prob_points) == (1, 1, 1.0, 1.2, 1.2, None)
    assert lg.settle(t, s, result(spark), None, None).count() == 0
    e = lg.forward_verdict(lg.ledger_summary(t, s.filter("pnl > 99"))).first()
    assert (e.settled, e.staked, e.roi, e.status) == (0, 0.0, None, "paper_only")


def test_settlement_moves_trades_once(spark):
    """Trades, results and both closes meet behind one exchange by (pair, day)."""
    close = spark.createDataFrame([("2025-01-02", "fighter a|fighter b", "fighter a", -150.0, 130.0)],
                                  "date string, pair string, side_a string, odds_a double, odds_b double").withColumn("date", F.col("date").cast("date"))
    out = lg.settle(trade(spark), None, result(spark), close, close)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    full = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and full.count("Exchange hashpartitioning") == 1 and full.count("Window ") >= 1


def test_offsets_are_preferred_in_order(spark):
    results = result(spark, "2025-01-03", "B").unionByName(result(spark, "2025-01-01", "A"))
    assert lg.settle(trade(spark), None, results, None, None).first().result == "WIN"           # the day before comes before the day after
    results = results.unionByName(result(spark, "2025-01-02", "B"))
    assert lg.settle(trade(spark), None, results, None, None).first().result == "LOSS"          # the day itself first
    none = trade(spark).withColumn("date", F.lit(None).cast("date"))
    assert lg.settle(none, None, results, None, None).count() == 0
