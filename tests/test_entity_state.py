"""Entity states against the replayed history, in one piece and updated."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from duelmark.operators import entity_state as es, point_in_time as pit

FEATURES = {"n": pit.prior_count(), "total": pit.prior_sum("v"), "mean": pit.prior_mean("v"), "sd": pit.prior_std("v"), "top": pit.prior_max("v"),
            "was": pit.previous("v"), "last2": pit.last_mean("v", 2), "last5": pit.last_mean("v", 5), "run": pit.streak("won")}


def history(spark, seed, n=160, months=5):
    rng = random.Random(seed)
    rows = [(rng.choice("abcde"), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 24 * 30 * months)), k,
             rng.choice([None, 0.5, 1.0, 2.0, 7.0]), rng.choice([True, True, True, False, None])) for k in range(n)]
    return spark.createDataFrame(rows, "e string, t timestamp, s long, v double, won boolean")


def rounded(rows):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_states_equal_a_hypothetical_last_row(spark, seed):
    rows = history(spark, seed)
    people = spark.createDataFrame([(c,) for c in "abcdez"], "e string")
    last = people.select("e", F.lit(dt.datetime(2030, 1, 1)).alias("t"), F.lit(10_000).cast("long").alias("s"))
    marked = rows.withColumn("new", F.lit(False)).unionByName(last.withColumn("new", F.lit(True)), allowMissingColumns=True)
    want = pit.point_in_time(marked, "e", "t", "s", FEATURES).filter("new").select("e", *FEATURES).collect()
    states = es.entity_states(rows, "e", "t", "s", FEATURES)
    got = es.next_features(people, states, "e", FEATURES).select("e", *FEATURES).collect()
    assert rounded(got) == rounded(want)


@pytest.mark.parametrize("cuts", [("2024-02-10",), ("2024-01-20", "2024-04-01"), ("2023-01-01", "2029-01-01")])
def test_updates_equal_one_pass(spark, cuts):
    rows = history(spark, 9)
    want = es.entity_states(rows, "e", "t", "s", FEATURES)
    bounds = [dt.datetime(1, 1, 2), *(dt.datetime.fromisoformat(c) for c in cuts), dt.datetime(2100, 1, 1)]
    states = None
    for low, high in zip(bounds, bounds[1:]):
        part = rows.filter((F.col("t") >= F.lit(low)) & (F.col("t") < F.lit(high)))
        states = es.entity_states(part, "e", "t", "s", FEATURES) if states is None else es.update_states(states, part, "e", "t", "s", FEATURES)
    people = rows.select("e").distinct()
    a, b = (es.next_features(people, s, "e", FEATURES).select("e", *FEATURES).collect() for s in (want, states))
    assert rounded(a) == rounded(b)


def test_nothing_known(spark):
    rows = history(spark, 4).limit(0)
    got = es.next_features(spark.createDataFrame([("x",)], "e string"), es.entity_states(rows, "e", "t", "s", FEATURES), "e", FEATURES).first()
    assert (got.n, got.run, got.mean, got.last2, got.was) == (0, 0, None, None, None)


@pytest.mark.parametrize("per_part", [7, 100_000])
def test_prior_moments_over_parts_equal_a_window(spark, per_part):
    rng = random.Random(3)
    rows = [(rng.choice(["big", "big", "big", "small", None]), dt.date(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 60)), k,
             rng.choice([None, 1e9 + rng.random(), 1e9 + 5 * rng.random()])) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, d date, s long, v double")
    got = {r.s: (r.m, r.sd) for r in pit.prior_moments(df, "g", "d", "s", "v", "m", "sd", per_part).collect()}
    assert len(got) == len(rows)
    seen = {}
    for g, d, s, v in sorted(rows, key=lambda r: (r[1], r[2])):
        known = seen.setdefault(g, [])
        if known:
            mean = sum(x - 1e9 for x in known) / len(known) + 1e9
            assert abs(got[s][0] - mean) < 1e-5
        else:
            assert got[s] == (None, None)
        if len(known) >= 2:
            sd = (sum((x - mean) ** 2 for x in known) / (len(known) - 1)) ** 0.5
            assert abs(got[s][1] - sd) < 1e-5
        if v is not None:
            known.append(v)
