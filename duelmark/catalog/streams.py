"""The polled flows as Structured Streaming, run over what has landed."""

from pyspark.sql import functions as F

from duelmark.catalog.registry import query
from duelmark.functions import devig
from duelmark.session import scratch_path
from duelmark.streaming import flows


SLICES, FILES = 4, 2            # micro-batches of a stream, and least files of each
ROWS_A_FILE = 1_000_000         # a slice with more rows lands in more files


def in_slices(t, rows, time):
    """A stream over the rows: they land in order of time, slice by slice, and each slice is one micro-batch."""
    path = scratch_path(t.spark, "landed")
    at = F.unix_micros(F.col(time).cast("timestamp"))
    cuts, n = rows.agg(F.percentile_approx(at, [k / SLICES for k in range(1, SLICES)]), F.count(F.lit(1))).first()
    files = max(FILES, -(-n // (SLICES * ROWS_A_FILE)))
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows if low is None else rows.filter(at >= low)
        part = part if high is None else part.filter(at < high)
        part.repartition(files).write.mode("append").parquet(path)
    return flows.read_landed(t.spark, path, "*.parquet", rows.schema, max_files=files)


def quote_rows(t):
    q, low = F.col("l_quantity"), F.col("l_discount") < 0.05
    return t.lineitem.select(
        (F.col("l_orderkey") % 200).alias("event_key"), (F.col("l_suppkey") % 12).alias("book"), F.col("l_shipdate").cast("timestamp").alias("fetched_at"),
        F.col("l_extendedprice").alias("price"), F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("order_key"),
        F.when(low, -(95 + q * 6)).otherwise(95 + q * 6).alias("odds_a"),
        F.when(low, 80 + q * 5).otherwise(-(115 + q * 7)).alias("odds_b")).withColumn("book_prob", devig("odds_a", "odds_b"))


@query("L1_live_consensus_stream", """
WITH q AS (SELECT l_orderkey % 200 AS event_key, l_suppkey % 12 AS book, CAST(time_bucket(INTERVAL 91 DAY, l_shipdate, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS poll_start,
  l_shipdate, l_extendedprice, l_partkey, l_orderkey, CASE WHEN l_discount < 0.05 THEN -(95 + l_quantity * 6) ELSE 95 + l_quantity * 6 END AS oa,
  CASE WHEN l_discount < 0.05 THEN 80 + l_quantity * 5 ELSE -(115 + l_quantity * 7) END AS ob FROM lineitem),
k AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY poll_start, event_key, book ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey DESC, l_orderkey DESC) = 1),
p AS (SELECT *, CASE WHEN oa < 0 THEN -oa / (-oa + 100.0) ELSE 100.0 / (oa + 100.0) END AS pa, CASE WHEN ob < 0 THEN -ob / (-ob + 100.0) ELSE 100.0 / (ob + 100.0) END AS pb FROM k)
SELECT poll_start, event_key, list_sort(list(oa))[count(*) // 2 + 1] AS odds_a,
  list_sort(list(ob))[count(*) // 2 + 1] AS odds_b, quantile_cont(pa / (pa + pb), 0.5) AS market_prob_a, count(*) AS market_books,
  max(pa / (pa + pb)) - min(pa / (pa + pb)) AS market_spread, max(oa) AS best_odds_a, max(ob) AS best_odds_b,
  arg_max(book, (oa, -book)) AS best_book_a, arg_max(book, (ob, -book)) AS best_book_b FROM p GROUP BY 1, 2""",
       "market_prob_a market_spread")
def _(t):
    quotes = in_slices(t, quote_rows(t), "fetched_at")
    s = flows.live_consensus(quotes, ["event_key"], "book", "fetched_at", "91 days", "1 day", order=["price", "part", "order_key"])
    out = flows.run_available_now(s, "live", "update")["out"]
    out = flows.latest_update(out, ["poll_start", "event_key"])
    return out.withColumn("poll_start", F.col("poll_start").cast("timestamp_ntz"))


@query("L2_append_once_stream", "SELECT event_id, value FROM events")
def _(t):
    e = in_slices(t, t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "value"), "ts")
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    out = flows.run_available_now(flows.append_once(twice, "event_id", "ts", "1 hour"), "once")["out"]
    return out.select("event_id", "value")


# an event is emitted once the watermark, the latest capture of all, has passed its start
@query("L3_close_snapshot_stream", """
SELECT contest, captured_at, value, date_diff('microsecond', captured_at, date_trunc('hour', captured_at) + INTERVAL 1 HOUR) / 6e7 AS lead_minutes FROM (
SELECT strftime(ts, '%Y-%m-%d %H') || '/' || user_id % 10 AS contest, ts AS captured_at, value,
  row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d %H') || '/' || user_id % 10 ORDER BY ts, value) AS rn FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR - ts BETWEEN INTERVAL 10 MINUTE AND INTERVAL 50 MINUTE)
WHERE rn = 1 AND date_trunc('hour', captured_at) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)""", "lead_minutes")
def _(t):
    def contest():
        return F.concat_ws("/", F.date_format("ts", "yyyy-MM-dd HH"), (F.col("user_id") % 10).cast("string"))

    e = in_slices(t, t.events.select(contest().alias("contest"), F.col("ts").cast("timestamp").alias("captured_at"), "value"), "captured_at")
    schedule = t.events.select(contest().alias("contest"), (F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR")).alias("start")).distinct()
    s = flows.close_snapshots(e, schedule, "contest", "captured_at", "start", ["value"])
    out = flows.run_available_now(s, "close")["out"]
    return out.select("contest", F.col("captured_at").cast("timestamp_ntz").alias("captured_at"), "value", "lead_minutes")


@query("L4_late_rows_rejected_stream", """
SELECT CASE WHEN lead_hours > 0 THEN 'admitted' ELSE 'rejected' END AS output, count(*) AS n, sum(lead_hours) AS total FROM {quotes} GROUP BY 1""", "total", 3)
def _(t):
    l = in_slices(t, t.lineitem.select("l_orderkey", "l_quantity", "l_shipdate"), "l_shipdate")
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("timestamp").alias("start"))
    lead = F.col("l_quantity") * 2 - 4
    q = l.join(o, "l_orderkey").select("l_orderkey", lead.alias("lead_hours"), "start", (F.col("start") - F.make_dt_interval(
        F.lit(0), lead.cast("int"), F.lit(0), F.lit(0))).alias("captured_at"))
    out = flows.run_available_now(flows.admit_pre_start(q, "captured_at", "start"), "late",
                                  split={"admitted": F.col("admitted"), "rejected": ~F.col("admitted")})
    parts = [df.agg(F.lit(n).alias("output"), F.count(F.lit(1)).alias("n"), F.sum("lead_hours").alias("total")) for n, df in out.items()]
    return parts[0].unionByName(parts[1])


@query("L5_missing_results_stream", """
WITH e AS (SELECT user_id, date_trunc('millisecond', ts) AS ts, event_id, event_type FROM events),
w AS (SELECT least((SELECT max(ts) FROM e WHERE event_type = 'purchase'), (SELECT max(ts) FROM e WHERE event_type = 'click')) AS mark)
SELECT t.event_id FROM e t, w WHERE t.event_type = 'purchase' AND t.ts + INTERVAL 12 HOUR < w.mark
  AND NOT EXISTS (SELECT 1 FROM e r WHERE r.event_type = 'click' AND r.user_id = t.user_id AND r.ts >= t.ts AND r.ts <= t.ts + INTERVAL 12 HOUR)""")
def _(t):
    e = t.events.select("user_id", F.date_trunc("millisecond", "ts").alias("at"), "event_id", "event_type")
    e = in_slices(t, e, "at")
    tracked = e.filter("event_type = 'purchase'").select("user_id", F.col("at").alias("tracked_at"), "event_id")
    results = e.filter("event_type = 'click'").select("user_id", F.col("at").alias("result_at"))
    s = flows.missing_results(tracked, results, "user_id", "tracked_at", "result_at")
    return flows.run_available_now(s, "missing")["out"].select("event_id")
