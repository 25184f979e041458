import random

import pytest
from pyspark.sql import functions as F

from duelmark.operators import betting, bootstrap as bs, evaluation as ev, running


def greedy(rows, cap):
    """Plain loop: (group, id, net, desired) -> stake."""
    out = {}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for g in groups.values():
        left = cap
        for _, i, net, want in sorted(g, key=lambda r: (-r[2], r[1])):
            stake = int(min(want, max(0, left))) if want > 0 else 0
            out[i] = stake
            left -= stake
    return out


def test_allocation_hand_value(spark):
    df = spark.createDataFrame([("A", 0, .09), ("A", 1, .12), ("A", 2, .08), ("B", 3, .07)], "g string, id int, net_edge double")
    out = betting.allocate(df.withColumn("desired", betting.desired_stake()), ["g"], ["id"], 2).orderBy("id")
    assert [r.stake for r in out.collect()] == [1, 1, 0, 1]
    # the two-unit tier is research only: the active policy stays flat
    one = df.filter("id = 1").withColumn("desired", betting.desired_stake())
    assert betting.allocate(one, ["g"], ["id"], 2).first().stake == 1


@pytest.mark.parametrize("cap", [1, 2, 3, 5])
def test_allocation_equals_a_greedy_loop(spark, cap):
    rng = random.Random(cap)
    rows = [(f"g{rng.randrange(6)}", i, rng.choice([0.01, 0.05, 0.06, 0.09, 0.2]), rng.choice([0, 1, 1, 2])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, id int, net_edge double, desired int")
    got = {r.id: r.stake for r in betting.allocate(df, ["g"], ["id"], cap).collect()}
    assert got == {**{r[1]: 0 for r in rows}, **greedy(rows, cap)}


def test_hot_group_is_spread_and_the_input_is_shuffled_once(spark):
    df = spark.range(400).selectExpr("concat('g', id % 1) g", "id", "id / 400.0D net_edge", "1 desired", "id * 2 payload")
    out = betting.allocate(df, ["g"], ["id"], 2)
    assert sorted(r.id for r in out.collect() if r.stake) == [398, 399]
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "hashpartitioning(g" in plan and "_salt" in plan and "ReusedExchange" in plan


def test_pick_tie_goes_to_a_and_pnl(spark):
    df = spark.createDataFrame([(0.5, 0.0, 0.4, 0.4, 1, 150.0, -200.0, 2), (0.3, 0.01, 0.5, 0.5, 0, 150.0, -200.0, 1), (0.3, 0.01, 0.5, 0.5, 1, 150.0, -200.0, 0)],
                               "p_model double, se double, pr_raw double, pb_raw double, y int, odds_a double, odds_b double, stake int")
    out = betting.score_picks(df).withColumn("pnl", betting.row_pnl()).collect()
    assert [(r.pick_side, r.pnl) for r in out] == [("A", 3.0), ("B", 0.5), ("B", 0.0)]


def test_drawdown_and_stop_match_a_loop(spark):
    rng = random.Random(5)
    for start in (None, 0.0):
        days = [(d, rng.choice([-3.0, -1.0, 1.0, 2.0])) for d in range(120)]
        df = spark.createDataFrame(days, "d int, pnl double")
        curve = running.equity_curve(df, ["d"], "pnl", F.floor(F.col("d") / 10), peak_floor=start)
        equity, peak, want, breach = 0.0, start, {}, None
        for d, p in days:
            equity += p
            peak = equity if peak is None else max(peak, equity)
            want[d] = (equity, peak - equity)
            if breach is None and peak - equity >= 8:
                breach = d
        assert {r.d: (r.equity, r.drawdown) for r in curve.collect()} == want
        halted = running.halt_after_drawdown(curve, "d", 8.0).filter("halted").agg(F.min("d")).first()[0]
        assert halted == (breach + 1 if breach is not None else None)


def test_running_before_and_ordered_index(spark):
    df = spark.createDataFrame([(w, d, float(d * w)) for w in (1, 2) for d in range(25)], "w int, d int, v double")
    out = running.running_before(df, "d", ["v"], F.floor(F.col("d") / 4), ["w"]).collect()
    assert all(r.v == sum(x * r.w for x in range(r.d)) for r in out)
    idx = running.ordered_index(df.filter("w = 1"), ["d"], F.floor(F.col("d") / 7)).collect()
    assert all(r.idx == r.d for r in idx)


def test_bootstrap_is_reproducible_and_handles_nothing(spark):
    df = spark.createDataFrame([(i, float(i % 3) - 1, 1.0 + i % 2) for i in range(40)], "d int, pnl double, staked double")
    a = bs.cluster_ratio_ci(df, ["d"], draws=50, seed=1).first()
    b = bs.cluster_ratio_ci(df.repartition(7), ["d"], draws=50, seed=1).first()
    assert tuple(a) == pytest.approx(tuple(b)) and a.ci_low < a.ci_high
    none = bs.cluster_ratio_ci(df.filter("d < 0"), ["d"], draws=50).first()
    assert none.ci_low is None and none.ci_high is None


def _report(spark, **change):
    base = dict(events=80, bets=250, roi_low=0.01, log_loss_model=0.58, log_loss_market=0.59, clv_bets=220, clv_low=0.05, clv_rate=0.56)
    return spark.createDataFrame([{**base, **change}])


def test_promotion_gate(spark):
    full = ev.promotion_gate(_report(spark))
    assert ev.verdict(full, "candidate_for_manual_review", "paper_only").first().status == "candidate_for_manual_review"
    small = ev.promotion_gate(_report(spark, clv_bets=40))
    assert ev.verdict(small, "candidate_for_manual_review", "paper_only").first().status == "paper_only"
    assert [r["check"] for r in small.filter("NOT passed").collect()] == ["minimum_active_clv_bets"]


def test_staking_gate(spark):
    row = dict(prod_bets=120, entry_bets=110, entry_clv_bets=99, prod_roi_low=0.1, entry_roi_low=0.1, prod_policy_low=0.1, entry_policy_low=0.1, entry_clv_low=None)
    names = list(row)
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} {'long' if n.endswith('bets') else 'double'}" for n in names))
    out = ev.staking_gate(df)
    assert out.count() == 8 and out.filter("NOT passed").count() == 2


def test_freshness_states(spark):
    import datetime as dt
    res = spark.createDataFrame([("x", dt.date(2024, 1, 10))], "k string, d date")
    tracked = spark.createDataFrame([("x", dt.datetime(2024, 1, 10)), ("y", dt.datetime(2024, 1, 11)), ("z", dt.datetime(2024, 1, 12, 6))], "k string, s timestamp")
    now = dt.datetime(2024, 1, 12, 12)
    r = ev.freshness(res, tracked, ["k"], "d", "s", now).first()
    assert (r.status, r.n_missing) == ("lagging", 1)
    assert ev.freshness(res, tracked.filter("k = 'x'"), ["k"], "d", "s", now).first().status == "current"
    assert ev.freshness(res, tracked.filter("k = 'x'"), ["k"], "d", "s", dt.datetime(2024, 3, 1)).first().status == "check"


def test_a_drawdown_that_meets_the_stop_is_a_breach_however_it_is_rounded(spark):
    # 0.7 - 0.1 - 0.1 - 0.1 is a drawdown of 0.3, which doubles miss from below
    rows = [(0, 0.7), (1, -0.1), (2, -0.1), (3, -0.1), (4, 0.5)]
    df = spark.createDataFrame(rows, "d int, pnl double")
    for width in (1, 2, 10):
        curve = running.equity_curve(df, ["d"], "pnl", F.floor(F.col("d") / width), peak_floor=0.0)
        out = running.halt_after_drawdown(curve, "d", 0.3).orderBy("d").collect()
        assert [r.halted for r in out] == [False, False, False, False, True]


def test_policy_report_allocates_only_rows_that_can_be_staked(spark, monkeypatch):
    """400 picks of two sets and three days, with ties, missing edges and a day without a wish: at most two rows a day and set are copied per policy."""
    rows = [(s, f"2024-01-0{k % 3 + 1}", k, None if k % 7 == 0 else 0.01 if k % 3 == 2 else (k * 37 % 40) / 200.0, "A" if k % 2 else "B", k % 5 % 2, -120.0, 110.0)
            for s in ("p", "q") for k in range(200)]
    df = spark.createDataFrame(rows, "prediction_set string, date string, event_key int, net_edge double, pick_side string, y int, odds_a double, odds_b double")
    df = df.withColumn("date", F.col("date").cast("date"))
    whole = ev.apply_policies(df, ["event_key"], by=["prediction_set"])

    def sums(rows):
        out = rows.groupBy("prediction_set", "policy", "date").agg(F.count_if(F.col("stake") > 0), F.sum("stake"), F.round(F.sum("pnl"), 9))
        return sorted(map(tuple, out.collect()))

    seen, plain = [], ev.apply_policies
    monkeypatch.setattr(ev, "apply_policies", lambda rows, *a, **k: seen.append(rows) or plain(rows, *a, **k))
    report = ev.policy_report(df, ["event_key"], by=["prediction_set"], draws=50).collect()
    assert seen[0].count() == 12
    assert len(report) == 6 and sum(r.bets for r in report) == sum(n for *_, n, _, _ in sums(whole)) > 0
    assert sums(plain(seen[0], ["event_key"], by=["prediction_set"])) == sums(whole)
    free = [{"policy": "free", "high": None, "max_stake": 1.0, "cap": None}]
    assert ev.nominees(df, ["event_key"], policies=free).count() == 400
