"""Bootstrap weights, grouped intervals and collapsed rows against plain loops."""

import hashlib
import random
from bisect import bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelmark.operators import bootstrap as bs, evaluation as ev


def weight(seed, draw, key, mean=1.0):
    low, steps = bs.poisson_steps(mean)
    digest = hashlib.md5(f"{seed}|{draw // bs.PER_HASH}|{key}".encode()).hexdigest()
    j = draw % bs.PER_HASH
    number = int(digest[0:15] if j < 3 else digest[16:31], 16)
    return low + bisect_right(steps.tolist(), number >> bs.BITS * (j % 3) & (1 << bs.BITS) - 1)


def test_poisson_steps():
    assert bs.poisson_steps()[0] == 0 and bs.poisson_steps()[1].tolist()[:3] == [385749, 771499, 964373]
    for mean in (1.0, 2.0, 7.0, 300.0, 1e5, 1e8):
        low, steps = bs.poisson_steps(mean)
        u = np.random.default_rng(1).integers(0, 1 << bs.BITS, 20_000)
        drawn = low + np.searchsorted(steps, u, "right")
        assert abs(drawn.mean() - mean) < 5 * (mean / 20_000) ** 0.5 + 1e-6 * mean
        assert abs(drawn.std() / mean ** 0.5 - 1) < 0.05


def test_all_groups_and_ratios_share_the_clusters_weights(spark):
    rng = random.Random(1)
    cells = [(g, c, rng.randint(-5, 9) * 1.0, rng.randint(0, 3) * 1.0, rng.randint(1, 4)) for g in ("x", "y", None) for c in range(700) if g != "y" or c % 3]
    df = spark.createDataFrame(cells, "g string, c int, pnl double, staked double, n int").repartition(5)
    draws = 40
    want = {}
    for g, c, pnl, staked, n in cells:
        for d in range(draws):
            s = want.setdefault((g, d), [0, 0, 0])
            w = weight(3, d, c)
            s[0] += w * pnl
            s[1] += w * staked
            s[2] += w * n
    got = {(r.g, r.draw): [r.pnl, r.staked, r.n] for r in bs.weighted_sums(df, ["g"], ["c"], ["pnl", "staked", "n"], draws, 3).collect()}
    assert got == want
    ci = {r.g: r for r in bs.grouped_intervals(df, ["g"], ["c"], {"roi": ("pnl", "staked"), "mean": ("pnl", "n")}, draws, 3).collect()}
    for g in ("x", "y", None):
        roi = [want[g, d][0] / want[g, d][1] for d in range(draws)]
        assert ci[g].roi_low == pytest.approx(np.quantile(roi, 0.05)) and ci[g].roi_high == pytest.approx(np.quantile(roi, 0.95))
        mean = [want[g, d][0] / want[g, d][2] for d in range(draws)]
        assert ci[g].mean_low == pytest.approx(np.quantile(mean, 0.05))


def test_collapsed_rows_give_the_interval_of_single_rows(spark):
    rng = np.random.default_rng(2)
    values = rng.choice([-1.0, 0.9, 1.4, 2.5], 4000, p=[0.55, 0.2, 0.15, 0.1])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    r = bs.row_mean_ci(df, "v", draws=2000).first()
    means = [rng.choice(values, len(values)).mean() for _ in range(2000)]
    spread = np.quantile(means, 0.95) - np.quantile(means, 0.05)
    assert abs(r.ci_low - np.quantile(means, 0.05)) < 0.1 * spread and abs(r.ci_high - np.quantile(means, 0.95)) < 0.1 * spread
    assert bs.value_counts(df, "v").count() == 4


def test_no_rows_and_empty_denominators(spark):
    none = spark.createDataFrame([], "g string, c int, a double, b double")
    assert bs.grouped_intervals(none, ["g"], ["c"], {"r": ("a", "b")}, 10).count() == 0
    zero = spark.createDataFrame([("x", 1, 1.0, 0.0)], "g string, c int, a double, b double")
    r = bs.grouped_intervals(zero, ["g"], ["c"], {"r": ("a", "b")}, 10).first()
    assert (r.g, r.r_low, r.r_high) == ("x", None, None)


def test_caps_are_a_column_of_the_grid(spark):
    """Different caps in one allocation equal one allocation each."""
    rng = random.Random(5)
    rows = [(k, k % 6, rng.randint(0, 30) / 100, "A", k % 2, 110.0, -130.0) for k in range(120)]
    df = spark.createDataFrame(rows, "k int, date int, net_edge double, pick_side string, y int, odds_a double, odds_b double")
    got = {(r.threshold, r.cap, r.k): r.stake for r in ev.allocate_grid(df, ["k"], (0.04, 0.08), (None, 2, 5)).collect()}
    assert len(got) == 120 * 6
    for threshold in (0.04, 0.08):
        for cap in (None, 2.0, 5.0):
            for date in range(6):
                left = float("inf") if cap is None else cap
                for k, _, net, *_ in sorted((r for r in rows if r[1] == date), key=lambda r: (-r[2], r[0])):
                    want = 0 if net < threshold else 2 if net >= max(0.08, 2 * threshold) else 1
                    stake = min(want, left)
                    left -= stake
                    assert got[threshold, cap, k] == stake


def test_drift_distance(spark):
    rows = [("reference", v / 10) for v in range(10)] + [("recent", 0.95)] * 4 + [("recent", None)]
    df = spark.createDataFrame(rows, "p string, v double")
    r = ev.drift_distance(df, F.col("p"), {"v": (0.0, 1.0)}, bins=10).first()
    assert (r.field, round(r.distance, 9), r.bins) == ("v", 0.9, 10)


def test_rows_with_a_key_are_drawn_one_by_one(spark):
    values = [(i, [-1.0, 0.9, 2.5][i % 3]) for i in range(60)]
    df = spark.createDataFrame([*values, (60, None)], "k int, v double")
    r = bs.row_mean_ci(df, "v", draws=50, seed=3, key=["k"]).first()
    means = []
    for draw in range(50):
        w = [weight(3, draw, str(k)) for k, _ in values]
        means.append(sum(x * v for x, (_, v) in zip(w, values)) / sum(w))
    assert r.ci_low == pytest.approx(np.quantile(means, 0.05)) and r.ci_high == pytest.approx(np.quantile(means, 0.95))
