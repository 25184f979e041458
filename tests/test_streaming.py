import datetime as dt

from pyspark.sql import functions as F

from duelmark.session import scratch_path
from duelmark.streaming import flows

T0 = dt.datetime(2024, 1, 1)


def landed(spark, files, schema):
    """One file per entry, read one file per micro-batch."""
    path = scratch_path(spark, "landed")
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return flows.read_landed(spark, path, "*.parquet", spark.read.parquet(path).schema, max_files=1)


def minutes(n):
    return T0 + dt.timedelta(minutes=n)


QUOTE = "k int, book long, at timestamp, odds_a double, odds_b double, book_prob double"


def test_consensus_over_several_batches_equals_batch(spark):
    """Seven books that quote again and again, in three files, against the last quotes of all rows together."""
    files = [[(m % 2, m % 7, minutes(m), -100.0 - m % 11, 100.0 + m % 13, 0.4 + m / 1000) for m in range(b, 90, 3)] for b in range(3)]
    stream = landed(spark, files, QUOTE)
    found = flows.run_available_now(flows.live_consensus(stream, ["k"], "book", "at", "10 minutes", "2 hours"), "c", "update")["out"]
    assert found.select("batch_id").distinct().count() == 3
    got = {(r.poll_start, r.k): r for r in flows.latest_update(found, ["poll_start", "k"]).collect()}
    last = {}
    for k, book, at, a, b, p in sorted((r for f in files for r in f), key=lambda r: r[2]):
        last.setdefault((at - dt.timedelta(minutes=at.minute % 10), k), {})[book] = (a, b, p)
    assert got.keys() == last.keys()
    for key, books in last.items():
        r, n = got[key], len(books)
        a, b, p = (sorted(v[j] for v in books.values()) for j in range(3))
        median = (p[(n - 1) // 2] + p[n // 2]) / 2
        assert (r.odds_a, r.odds_b, r.market_books, r.best_odds_a, r.best_odds_b) == (a[n // 2], b[n // 2], n, a[-1], b[-1])
        assert abs(r.market_prob_a - median) < 1e-12 and abs(r.market_spread - (p[-1] - p[0])) < 1e-12
        assert r.best_book_a == min(k for k, v in books.items() if v[0] == a[-1]) and r.best_book_b == min(k for k, v in books.items() if v[1] == b[-1])


def states(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in map(json_of, query.recentProgress) if p["stateOperators"]]


def json_of(progress):
    import json

    return progress if isinstance(progress, dict) else json.loads(progress.json)


def run_counted(stream, mode):
    """Runs a stream; its rows, and the rows of state after each micro-batch."""
    spark, rows = stream.sparkSession, []
    query = (stream.writeStream.outputMode(mode).foreachBatch(lambda batch, n: rows.extend(map(tuple, batch.collect())))
             .option("checkpointLocation", scratch_path(spark, "counted")).trigger(availableNow=True).start())
    query.awaitTermination()
    return rows, states(query)


def test_quotes_of_ended_windows_leave_the_state(spark):
    files = [[(1, b, minutes(3), 110.0 + b, -120.0, 0.45) for b in range(5)], [(1, 9, minutes(200), 100.0, 100.0, 0.5)],
             [(1, 7, minutes(4), 500.0, 500.0, 0.5), (2, 1, minutes(201), 100.0, 100.0, 0.5)]]
    rows, held = run_counted(flows.live_consensus(landed(spark, files, QUOTE), ["k"], "book", "at", "10 minutes", "30 minutes"), "update")
    # the late quote of book 7 changes nothing; of the first window nothing is left
    assert [(r[0], r[1], r[5]) for r in rows] == [(minutes(0), 1, 5), (minutes(200), 1, 1), (minutes(200), 2, 1)]
    assert held[-1] == 2


def test_a_task_hands_on_the_last_quotes_only(spark, monkeypatch):
    """Missing values come first, keys may be missing, and no key is lost when a task meets more keys than it holds."""
    rows = [(k, t, x) for k in (1, 2, None) for t in (None, 1, 3, 2) for x in ("a", None, "c", "b")]
    part = spark.createDataFrame(rows, "k int, t int, x string").coalesce(1)
    assert sorted(map(str, flows.last_in_task(part, ["k"], ["t", "x"]).collect())) == sorted(f"Row(k={k}, t=3, x='c')" for k in (1, 2, None))
    monkeypatch.setattr(flows, "MOST_HELD", 10)
    many = spark.range(25_000).selectExpr("id % 12000 k", "id t").coalesce(1)
    kept = flows.last_in_task(many, ["k"], ["t"])
    assert kept.groupBy("k").agg(F.max("t").alias("t")).agg(F.count("*"), F.sum("t")).first() == (12_000, sum(range(13_000, 25_000)))


def test_quotes_are_reduced_before_they_move(spark):
    """900 quotes of six books in one file: six rows are shuffled."""
    quotes = spark.createDataFrame([(1, m % 6, minutes(0) + dt.timedelta(seconds=m), 110.0, -120.0, 0.45) for m in range(900)], QUOTE).coalesce(1)
    rows = flows.live_consensus(quotes, ["k"], "book", "at", "1 hour", "2 hours")
    assert [r.market_books for r in rows.collect()] == [6]
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.index("TransformWithState") < plan.index("MapInArrow")


def test_large_slices_land_in_more_files(spark, monkeypatch):
    from types import SimpleNamespace

    from duelmark.catalog import streams

    monkeypatch.setattr(streams, "ROWS_A_FILE", 50)
    rows = spark.range(1000).select("id", F.timestamp_seconds("id").alias("at"))
    stream = streams.in_slices(SimpleNamespace(spark=spark), rows, "at")
    out = flows.run_available_now(stream.withColumn("file", F.col("_metadata.file_path")), "files")["out"]
    per = out.groupBy("batch_id").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"), F.min("id").alias("low")).orderBy("batch_id").collect()
    assert len(per) == 4 and sum(r.n for r in per) == 1000
    assert all(r.files == 5 for r in per) and [r.low for r in per] == sorted(r.low for r in per)


def test_append_once_across_batches(spark):
    rows = [("a", minutes(1)), ("b", minutes(2))]
    stream = landed(spark, [rows, rows, [("c", minutes(3)), ("a", minutes(4))]], "id string, at timestamp")
    out = flows.run_available_now(flows.append_once(stream, "id", "at", "1 hour"), "o")["out"]
    assert sorted(r.id for r in out.collect()) == ["a", "b", "c"]


def test_one_close_per_event_in_the_due_window(spark):
    schedule = spark.createDataFrame([("e", minutes(60)), ("f", minutes(300)), ("g", minutes(320)), ("h", minutes(900))], "event string, start timestamp")
    files = [[("e", minutes(30), 1.0)], [("e", minutes(20), 2.0), ("e", minutes(5), 3.0), ("f", minutes(30), 4.0)], [("e", minutes(45), 5.0)],
             [("g", minutes(285), 6.0), ("g", minutes(275), 7.0), ("f", minutes(255), 8.0)], [("none", minutes(400), 9.0)], [("f", minutes(256), 10.0), ("h", minutes(870), 11.0)],
             [("none", minutes(1000), 12.0)]]
    stream = landed(spark, files, "event string, at timestamp, v double")
    rows, held = run_counted(flows.close_snapshots(stream, schedule, "event", "at", "start", ["v"], watermark="15 minutes"), "append")
    assert sorted((r[0], r[3], r[4]) for r in rows) == [("e", 40.0, 2.0), ("f", 45.0, 8.0), ("g", 45.0, 7.0), ("h", 30.0, 11.0)]
    # every event has started: nothing is kept
    assert max(held) > 0 and held[-1] == 0


def test_an_event_that_has_not_started_is_kept(spark):
    schedule = spark.createDataFrame([("e", minutes(60))], "event string, start timestamp")
    rows, held = run_counted(flows.close_snapshots(landed(spark, [[("e", minutes(30), 1.0)], [("x", minutes(59), 2.0)]], "event string, at timestamp, v double"),
                                                   schedule, "event", "at", "start", ["v"]), "append")
    assert not rows and held[-1] > 0


def test_late_rows_go_to_the_side_output(spark):
    stream = landed(spark, [[(1, minutes(1), minutes(5)), (2, minutes(5), minutes(5)), (3, None, minutes(5))]], "k int, at timestamp, start timestamp")
    out = flows.run_available_now(flows.admit_pre_start(stream, "at", "start"), "l", split={"in": F.col("admitted"), "out": ~F.col("admitted")})
    assert sorted(r.k for r in out["in"].collect()) == [1] and sorted(r.k for r in out["out"].collect()) == [2, 3]


def test_missing_results_alert(spark):
    hour = 60
    tracked = landed(spark, [[("x", minutes(0)), ("y", minutes(1)), ("end", minutes(40 * hour))]], "k string, tracked_at timestamp")
    results = landed(spark, [[("x", minutes(5 * hour)), ("y", minutes(14 * hour)), ("end", minutes(40 * hour))]], "k string, result_at timestamp")
    out = flows.run_available_now(flows.missing_results(tracked, results, "k", "tracked_at", "result_at"), "m")["out"]
    assert [r.k for r in out.collect()] == ["y"]
