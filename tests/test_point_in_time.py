import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from duelmark.operators import point_in_time as pit


def rows(n=600, seed=3, hot=0.4):
    """Random histories in which one entity holds a large share and values can be missing."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        entity = "hot" if rng.random() < hot else f"e{rng.randrange(12)}"
        value = None if rng.random() < 0.15 else round(rng.uniform(0, 100), 3)
        won = rng.choice([True, True, False, None])
        out.append((entity, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 60)), i, value, won))
    return out


SCHEMA = "entity string, time timestamp, seq long, value double, won boolean"


def brute(data):
    out = {}
    by = {}
    for r in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        past = by.setdefault(r[0], [])
        vals = [p[3] for p in past if p[3] is not None]
        last3 = [p[3] for p in past[-3:] if p[3] is not None]
        run = 0
        for p in reversed(past):
            if p[4] is not True:
                break
            run += 1
        flagged = [p[1] for p in past if p[4] is False]
        mean = sum(vals) / len(vals) if vals else None
        std = math.sqrt(sum((v - mean) ** 2 for v in vals) / (len(vals) - 1)) if len(vals) > 1 else None
        out[r[2]] = (len(past), sum(vals) if vals else None, mean, std, sum(last3) / len(last3) if last3 else None,
                     past[-1][3] if past else None, max(vals) if vals else None, run, max(flagged) if flagged else None)
        past.append(r)
    return out


def features():
    return {"n": pit.prior_count(), "s": pit.prior_sum("value"), "m": pit.prior_mean("value"), "sd": pit.prior_std("value"),
            "l3": pit.last_mean("value", 3), "prev": pit.previous("value"), "mx": pit.prior_max("value"),
            "run": pit.streak("won"), "lost_at": pit.prior_max("lost_time")}


@pytest.mark.parametrize("chunk", [None, "DAY", "WEEK", "YEAR"])
def test_every_feature_matches_a_plain_loop(spark, chunk):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).withColumn("lost_time", F.when(F.col("won") == F.lit(False), F.col("time")))
    got = pit.point_in_time(df, "entity", "time", "seq", features(), chunk).collect()
    want = brute(data)
    assert len(got) == len(data)
    for r in got:
        mine = (r.n, r.s, r.m, r.sd, r.l3, r.prev, r.mx, r.run, r.lost_at)
        for a, b in zip(mine, want[r.seq]):
            if isinstance(b, float):
                assert a is not None and abs(a - b) < 1e-6, (r, want[r.seq])
            else:
                assert a == b, (r, want[r.seq])


def test_future_rows_change_nothing(spark):
    data = rows(200)
    cut = dt.datetime(2024, 2, 1)
    poisoned = [r if r[1] < cut else (r[0], r[1], r[2], -1e6, False) for r in data]

    def run(d):
        df = spark.createDataFrame(d, SCHEMA).withColumn("lost_time", F.when(F.col("won") == F.lit(False), F.col("time")))
        out = pit.point_in_time(df, "entity", "time", "seq", features(), "DAY").filter(F.col("time") < F.lit(cut))
        return sorted(map(tuple, out.collect()), key=lambda r: r[2])

    assert run(data) == run(poisoned)


def test_single_window_needs_one_exchange(spark):
    df = spark.createDataFrame(rows(50), SCHEMA)
    plan = pit.point_in_time(df, "entity", "time", "seq", {"m": pit.prior_mean("value"), "l3": pit.last_mean("value", 3),
                                                           "p": pit.previous("value")}, None)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def test_streak_lag(spark):
    data = [("x", dt.datetime(2024, 1, d), d, 1.0, w) for d, w in enumerate((True, True, False, True), 1)]
    df = spark.createDataFrame(data, SCHEMA).withColumns({"w": F.col("won").cast("double"), "f": F.lit(0.0), "t": F.lit(10.0)})
    for lag, want in ((1, [0, 1, 2, 0]), (2, [0, 0, 1, 2])):
        out = pit.career_stats(df, "entity", "time", "seq", "w", "f", "t", streak_lag=lag, chunk="DAY")
        assert [r.win_streak for r in out.orderBy("seq").collect()] == want
    first = pit.career_stats(df, "entity", "time", "seq", "w", "f", "t").orderBy("seq").first()
    assert (first.career_winrate, first.days_since_last, first.career_fights) == (0.5, 365, 0)


def test_long_and_wide_round_trip(spark):
    df = spark.createDataFrame([(1, "p", "q", 3.0, 4.0), (2, "q", "r", None, 6.0)], "id int, a string, b string, x_a double, x_b double")
    long = pit.two_sided_long(df, ["id"], {"entity": ("a", "b"), "x": ("x_a", "x_b")})
    assert long.count() == 4
    wide = pit.to_wide(long, ["id"], ["x"]).orderBy("id").collect()
    assert [tuple(r) for r in wide] == [(1, 3.0, 4.0), (2, None, 6.0)]
