import pytest
from pyspark.sql import functions as F

from duelmark.checks import assert_unique, require_columns
from duelmark.operators import joins, keys

REG = [("bo silva", "aaa", 125.0), ("bo silva", "bbb", 185.0), ("one only", "ccc", None), ("tied", "ddd", 150.0), ("tied", "eee", 160.0),
       ("half known", "fff", 170.0), ("half known", "ggg", None)]


def registry(spark):
    return spark.createDataFrame(REG, "name_key string, entity_id string, registered_weight double")


def test_identity_resolution(spark):
    rows = spark.createDataFrame([(1, "bo silva", "Flyweight Bout"), (2, "bo silva", "Middleweight Bout"), (3, "one only", None),
                                  (4, "tied", "Lightweight"), (5, "half known", None), (6, "half known", "Catch Weight"), (7, "nobody", "x"),
                                  (8, "bo silva", None)], "id int, n string, d string")
    out = joins.resolve_or_mark(rows, registry(spark), "n", "d").orderBy("id").collect()
    assert [r.entity_id for r in out] == ["aaa", "bbb", "ccc", "unresolved:tied", "fff", "fff", "unresolved:nobody", "unresolved:bo silva"]
    assert [r.resolution for r in out] == ["by_weight", "by_weight", "unique", "ambiguous", "by_weight", "by_weight", "not_found", "ambiguous"]
    with pytest.raises(ValueError, match="identity not resolved"):
        joins.resolve_or_mark(rows, registry(spark), "n", "d", strict=True)


def test_nearest_date_ties_go_to_the_earlier(spark):
    left = spark.createDataFrame([(1, "k", "2024-01-05 12:00:00"), (2, "k", "2024-01-09 00:00:00")], "id int, k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    right = spark.createDataFrame([("k", "2024-01-06", "late"), ("k", "2024-01-05", "early"), ("k", "2024-01-11", "far")], "k string, d string, v string")
    right = right.withColumn("d", F.col("d").cast("timestamp"))
    out = joins.nearest_date(left, right, ["id"], ["k"], "t", "d", 1).collect()
    assert [(r.id, r.v, r.date_error_days) for r in out] == [(1, "early", 0.5)]


def test_preferred_offset_order(spark):
    left = spark.createDataFrame([(1, "p", "2024-01-05"), (2, "q", "2024-01-05"), (3, "r", "2024-01-05")], "id int, k string, d string").withColumn("d", F.col("d").cast("date"))
    right = spark.createDataFrame([("p", "2024-01-04", "before"), ("p", "2024-01-05", "same"), ("q", "2024-01-06", "after"), ("q", "2024-01-04", "before")],
                                  "k string, rd string, v string").withColumn("rd", F.col("rd").cast("date"))
    got = {r.id: r.v for r in joins.preferred_offset(left, right, ["id"], ["k"], "d", "rd", how="left").collect()}
    assert got == {1: "same", 2: "before", 3: None}


def test_guards(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="not unique"):
        assert_unique(df, ["k"])
    with pytest.raises(ValueError, match="missing columns"):
        require_columns(df, ["k", "z"])
    with pytest.raises(ValueError):
        joins.lookup(df, df, ["k"])


def test_resume_worklist(spark):
    man = spark.createDataFrame([("e1", "discovery_72h", "ok", "2025-01-02 01:00:00", 1), ("e1", "entry", "no_quotes", None, 2), ("e2", "entry", "http_error", None, 3)],
                                "uid string, kind string, status string, start string, seq int")
    want = spark.createDataFrame([(u, k) for u in ("e1", "e2") for k in ("entry", "close")], "uid string, kind string")
    out = joins.resume_worklist(want, man, "uid", "kind", "status", "start", ["seq"]).collect()
    assert {(r.uid, r.kind, r.known_start) for r in out} == {("e1", "close", "2025-01-02 01:00:00"), ("e2", "entry", None), ("e2", "close", None)}


def test_keep_and_fold_copies(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (2, 1, "z")], "k int, o int, v string")
    assert sorted(r.v for r in keys.keep_last(df, ["k"], ["o"]).collect()) == ["y", "z"]
    assert sorted(r.v for r in keys.keep_first(df, ["k"], ["o"]).collect()) == ["x", "z"]
    copies = joins.fold_copies(df, "o", [2, 6, 8]).groupBy("fold").count().collect()
    assert {r.fold: r["count"] for r in copies} == {2: 1, 6: 2, 8: 3}


def test_nearest_date_equals_all_pairs_on_a_hot_key(spark):
    import datetime as dt
    import random

    rng = random.Random(2)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 12))
    left = [(i, "hot" if rng.random() < 0.6 else "b", at()) for i in range(150)]
    right = [(1000 + i, "hot" if rng.random() < 0.6 else "b", at()) for i in range(60)]
    for days in (1, 2):
        want = {}
        for i, k, t in left:
            near = [(abs(t - u), u, j) for j, kk, u in right if kk == k and abs(t - u) <= dt.timedelta(days=days)]
            if near:
                want[i] = min(near)[2]
        l, r = spark.createDataFrame(left, "id int, k string, t timestamp"), spark.createDataFrame(right, "rid int, k string, u timestamp")
        got = {x.id: x.rid for x in joins.nearest_date(l, r, ["id"], ["k"], "t", "u", days, ["rid"]).collect()}
        assert got == want


def test_fold_totals_equal_copies(spark):
    rows = spark.createDataFrame([(k * 7 % 40, float(k % 5)) for k in range(200)], "o int, v double")
    folds = [0, 3, 3, 12, 40, 99]
    table = spark.createDataFrame([(f,) for f in sorted(set(folds))], "o int")
    got = {r.o: (r.n, r.v) for r in joins.fold_totals(rows, "o", table, ["v"], F.floor(F.col("o") / 10)).collect()}
    want = {r.fold: (r.n, r.v) for r in joins.fold_copies(rows, "o", sorted(set(folds))).groupBy("fold").agg(
        F.count("*").alias("n"), F.sum("v").alias("v")).collect()}
    assert got == {f: want.get(f, (0, 0.0)) for f in folds}


def test_merged_partitions_stay_small(spark):
    from pyspark.sql import functions as F

    # more cores would make smaller partitions; here their size alone decides
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(2_000_000).select(F.xxhash64("id").alias("k")).distinct()        # 16 MB that do not compress
        assert rows.rdd.getNumPartitions() > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
