"""Sources, sinks and source tables."""

from pyspark.sql import Window as W, functions as F, types as T

from duelmark.catalog.fixtures import TIE
from duelmark.catalog.registry import query
from duelmark.functions import pair_key
from duelmark.operators import quotes as qt
from duelmark.session import scratch_path
from duelmark.sources import append as ap, files as fl


@query("A1_read_trimmed", """
SELECT c_custkey, c_name, nullif(CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END, '') AS segment FROM customer""")
def _(t):
    path = scratch_path(t.spark, "a1")
    raw = t.customer.select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit("   ")).alias("c_name"),
                            F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.concat("c_mktsegment", F.lit("\t"))).alias("segment"))
    raw.write.csv(path, header=True)
    return fl.read_trimmed(t.spark, path, "c_custkey long, c_name string, segment string")


@query("A2_closing_with_fallback", """
SELECT event_key, odds_a, odds_b, odds_source FROM (
SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY pri, snapshot_ts DESC, price DESC, part DESC, line DESC, ship DESC, book_key DESC) AS rn FROM (
  SELECT *, 0 AS pri, 'closing' AS odds_source FROM {valid} WHERE lead_hours <= 12
  UNION ALL SELECT *, 1, 'captured' FROM {valid} WHERE lead_hours > 12 AND commence_time <= TIMESTAMP '1998-01-01')) WHERE rn = 1""")
def _(t):
    closing = t.valid.filter("lead_hours <= 12")
    log = t.valid.filter("lead_hours > 12")
    out = qt.closing_with_fallback(closing, log, ["event_key"], "snapshot_ts", F.lit("1998-01-01").cast("timestamp_ntz"),
                                   date="commence_time", tie=[*TIE, "book_key"])
    return out.select("event_key", "odds_a", "odds_b", "odds_source")


@query("A3_read_quotes", "SELECT event_key, book_key, snapshot_ts, odds_a, odds_b, book_prob FROM {clean}", "book_prob")
def _(t):
    return t.clean.select("event_key", "book_key", "snapshot_ts", "odds_a", "odds_b", "book_prob")


@query("A3_read_quotes_by_kind", f"""
SELECT event_key, kind, book_key, odds_a FROM (
SELECT *, row_number() OVER (PARTITION BY event_key, kind, book_key ORDER BY snapshot_ts DESC, price DESC, part DESC, line DESC, ship DESC) AS rn
FROM (SELECT *, CASE WHEN lead_hours >= 24 THEN 'entry' WHEN lead_hours <= 12 THEN 'close' ELSE 'other' END AS kind FROM {{quotes}})
WHERE kind IN ('entry', 'close') AND abs(odds_a) >= 100 AND abs(odds_b) >= 100 AND snapshot_ts < commence_time) WHERE rn = 1""")
def _(t):
    kind = F.when(F.col("lead_hours") >= 24, "entry").when(F.col("lead_hours") <= 12, "close").otherwise("other")
    text = t.quotes.withColumns({"kind": kind, "odds_a": F.format_string("%.1f", "odds_a")})
    out = qt.clean_quotes(text, ["event_key"], "book_key", "snapshot_ts", "commence_time", "odds_a", "odds_b",
                          tie=TIE, kind="kind")
    return out.select("event_key", "kind", "book_key", "odds_a")


def payload(t):
    """Nested quote payloads, as JSON text.

    A payload holds up to 100 neighbouring books of one event, one quote per book, so its arrays stay small however
    many books an event has. Books are counted and not taken by number: numbers lie so far apart that most payloads
    held one book, and the text of an event was made and parsed for each.
    """
    place = F.row_number().over(W.partitionBy("event_key").orderBy("book_key"))
    books = t.clean.withColumn("part_no", F.floor((place - 1) / 100))
    struct = F.struct(
        F.col("book_key").cast("string").alias("key"), F.concat(F.lit("Book "), F.col("book_key").cast("string")).alias("title"),
        F.date_format("snapshot_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_update"),
        F.array(
            F.struct(F.lit("spreads").alias("key"), F.lit(None).cast("string").alias("last_update"),
                     F.array(F.struct(F.lit("home").alias("name"), F.lit("-500").alias("price"))).alias("outcomes")),
            F.struct(F.lit("h2h").alias("key"), F.lit(None).cast("string").alias("last_update"), F.array(
                F.struct(F.lit("home").alias("name"), F.col("odds_a").cast("string").alias("price")),
                F.struct(F.lit("away").alias("name"), F.when(F.col("line") == 1, F.lit("n/a")).otherwise(
                    F.col("odds_b").cast("string")).alias("price"))).alias("outcomes"))).alias("markets"))
    event = books.groupBy("event_key", "part_no").agg(F.max("commence_time").alias("c"), F.sort_array(F.collect_list(struct)).alias("b"))
    return event.select("event_key", F.to_json(F.array(F.struct(
        F.col("event_key").cast("string").alias("id"), F.date_format("c", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("commence_time"),
        F.lit("home").alias("home_team"), F.lit("away").alias("away_team"), F.col("b").alias("bookmakers")))).alias("body"))


@query("A4_paired_quotes_from_json", """
SELECT CAST(event_key AS VARCHAR) AS event_id, CAST(book_key AS VARCHAR) AS book_key, odds_a, odds_b, book_prob
FROM {clean} WHERE line <> 1""", "book_prob")
def _(t):
    rows = qt.explode_paired_quotes(qt.parse_payload(payload(t), "body"))
    return rows.select("event_id", "book_key", "odds_a", "odds_b", "book_prob")


@query("A5_archive_quotes_from_json", """
SELECT event_key, strftime(commence_time, '%Y-%m-%dT%H:%M:%SZ') AS commence_time, 'Book ' || CAST(book_key AS VARCHAR) AS book_title,
       odds_a, CASE WHEN line <> 1 THEN odds_b END AS odds_b FROM {clean}""")
def _(t):
    rows = qt.archive_quotes(qt.parse_payload(payload(t), "body", ["event_key"]), ["event_key"])
    return rows.select("event_key", "commence_time", "book_title", F.col("odds_a").try_cast("double").alias("odds_a"),
                       F.col("odds_b").try_cast("double").alias("odds_b"))


@query("A6_json_fragments", "SELECT event_id, event_type, value, ts FROM events")
def _(t):
    rows = t.events.select("event_id", "event_type", "value", "ts")
    path = fl.write_fragments(rows, scratch_path(t.spark, "a6"), None)
    return fl.read_fragments(t.spark, path, rows.schema)


@query("A7_append_dedup", "SELECT event_id, value FROM events")
def _(t):
    path = scratch_path(t.spark, "a7")
    rows = t.events.select("event_id", "value", "ts")
    ap.append_dedup(rows.filter("event_id % 2 = 0"), path, ["event_id"], ["ts"])
    # the second batch repeats the first and itself
    again = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    ap.append_dedup(again, path, ["event_id"], ["ts"])
    return t.spark.read.parquet(path).select("event_id", "value")


@query("A8_append_evolving", """
SELECT event_id, value, CASE WHEN event_id % 2 = 1 THEN event_type END AS event_type FROM events""")
def _(t):
    path = scratch_path(t.spark, "a8")
    ap.append_evolving(t.events.filter("event_id % 2 = 0").select("event_id", "value"), path)
    ap.append_evolving(t.events.filter("event_id % 2 = 1").select("event_id", "value", "event_type"), path)
    schema = T.StructType([t.events.schema[c] for c in ("event_id", "value", "event_type")])
    return ap.conform(ap.read_table(t.spark, path), schema)


@query("A9_month_partitioned_log", """
SELECT strftime(commence_time, '%Y-%m') AS month, count(*) AS n, sum(odds_a) AS total FROM {quotes}
WHERE strftime(commence_time, '%Y-%m') >= '1996-01' GROUP BY 1""", "total", 3)
def _(t):
    path = scratch_path(t.spark, "a9")
    ap.write_by_month(t.quotes, path, "commence_time")
    log = t.spark.read.schema(t.quotes.schema.add("month", "string")).parquet(path)
    return log.filter("month >= '1996-01'").groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("odds_a").alias("total"))


@query("A10_staged_replace", "SELECT bout_id, a, b, winner FROM {bouts} WHERE a <> b")
def _(t):
    from duelmark.operators.quality import audit_bouts, refresh_regressions

    path = scratch_path(t.spark, "a10")
    b = t.bouts.filter("a <> b").withColumns({"pair": pair_key("a", "b"), "name_a": F.col("a"), "name_b": F.col("b")})
    old = b.filter("bout_ts < TIMESTAMP_NTZ '2024-01-20'")

    def gates(previous):
        return lambda staged: [audit_bouts(staged, date="bout_ts")] + (
            [refresh_regressions(previous, staged, "bout_ts", ["a", "b"])] if previous is not None else [])

    ap.staged_replace(old, path, gates(None))
    ap.staged_replace(b, path, gates(ap.read_current(t.spark, path)))
    return ap.read_current(t.spark, path).select("bout_id", "a", "b", "winner")


@query("A11_file_fingerprint")
def _(t):
    return fl.file_fingerprint(t.spark, t.dir, "*.parquet")


@query("A11_table_fingerprint", """
SELECT count(*) AS rows, CAST(sum(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR) || '|' ||
  o_orderstatus || '|' || o_orderpriority), 1, 8))::BIGINT) AS BIGINT) AS fingerprint FROM orders""")
def _(t):
    return fl.table_fingerprint(t.orders, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("A12_table_manifest", """
SELECT count(*) AS rows, min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date FROM orders""")
def _(t):
    return fl.table_manifest(t.orders.select(F.col("o_orderdate").cast("date").alias("date")), "date")


@query("A13_five_stage_history", """
WITH src AS (SELECT * FROM {quotes} WHERE odds_a <> 0 AND odds_b <> 0),
cl AS (SELECT * FROM src WHERE lead_hours > 0),
en AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY snapshot_ts DESC, book_key DESC, price DESC, part DESC, line DESC, ship DESC) AS rn
       FROM cl WHERE lead_hours >= 24) WHERE rn = 1),
co AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY snapshot_ts DESC, book_key DESC, price DESC, part DESC, line DESC, ship DESC) AS rn
       FROM cl WHERE lead_hours >= 0.5) WHERE rn = 1),
ec AS (SELECT en.event_key, en.lead_hours AS e, co.lead_hours AS c FROM en JOIN co USING (event_key)
       WHERE co.snapshot_ts > en.snapshot_ts AND co.lead_hours <= 12)
SELECT 'source' AS stage, count(*) AS n, sum(lead_hours) AS lead_total FROM src UNION ALL SELECT 'clean', count(*), sum(lead_hours) FROM cl
UNION ALL SELECT 'entry', count(*), sum(lead_hours) FROM en UNION ALL SELECT 'entry_close', count(*), sum(c) FROM ec
UNION ALL SELECT 'entry_with_close', (SELECT count(*) FROM en), (SELECT sum(c) FROM ec)""", "lead_total", 3)
def _(t):
    from duelmark.plans.history import five_stage_history

    stages = five_stage_history(t.quotes, ["event_key"], scratch_path(t.spark, "a13"), tie=["book_key", *TIE])
    lead = {"entry_close": "close_lead_hours", "entry_with_close": "close_lead_hours", "entry": "entry_lead_hours"}
    parts = [df.agg(F.lit(s).alias("stage"), F.count(F.lit(1)).alias("n"), F.sum(lead.get(s, "lead_hours")).alias("lead_total"))
             for s, df in stages.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("A14_captured_and_master_closes", f"""
SELECT 'captured' AS src, date, pair, odds_a FROM (SELECT CAST(commence_time AS DATE) AS date, event_key AS pair, odds_a,
  row_number() OVER (PARTITION BY CAST(commence_time AS DATE), event_key ORDER BY snapshot_ts DESC, book_key DESC, price DESC, part DESC, line DESC, ship DESC) AS rn
  FROM {{quotes}} WHERE snapshot_ts < commence_time) WHERE rn = 1
UNION ALL
SELECT 'master', date, pair, odds_a FROM (SELECT CAST(commence_time AS DATE) AS date, event_key AS pair, odds_a,
  row_number() OVER (PARTITION BY CAST(commence_time AS DATE), event_key ORDER BY line DESC, price DESC, book_key DESC, part DESC, ship DESC) AS rn
  FROM {{quotes}} WHERE book_key % 4 <> 0) WHERE rn = 1""")
def _(t):
    q = t.quotes.withColumn("pair", F.col("event_key"))
    cap = qt.captured_closes(q, "pair", "snapshot_ts", "commence_time", ["book_key", *TIE])
    mas = qt.master_closes(q.withColumns({"date": F.col("commence_time").cast("date"),
                                          "odds_a": F.when(F.col("book_key") % 4 != 0, F.col("odds_a"))}),
                           "date", "pair", ("odds_a", "odds_b"), ["line", "price", "book_key", "part", "ship"])
    return (cap.select(F.lit("captured").alias("src"), "date", "pair", "odds_a")
            .unionByName(mas.select(F.lit("master").alias("src"), "date", "pair", "odds_a")))


@query("A15_result_table", """
SELECT bout_date, least(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) || '|' || greatest(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) AS pair,
       winner FROM {bouts} WHERE bout_id % 10 <> 0""")
def _(t):
    from duelmark.plans.history import result_table

    b = t.bouts.withColumn("winner", F.when(F.col("bout_id") % 10 != 0, F.col("winner")))
    return result_table(b, "bout_date", "a", "b", "winner").select("bout_date", "pair", "winner")
