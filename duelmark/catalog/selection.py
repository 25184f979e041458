"""Filters, joins, ordering and set operations."""

import datetime as dt

from pyspark.sql import functions as F

from duelmark.catalog.fixtures import TIE
from duelmark.catalog.registry import query
from duelmark.functions import lead_hours, pair_key
from duelmark.functions.timing import lead_minutes
from duelmark.operators import evaluation as ev, joins, keys, point_in_time as pit, quotes as qt
from duelmark.operators.betting import score_picks


@query("C1_not_null_and_membership", """
SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderstatus IN ('F', 'O')""")
def _(t):
    o = t.orders.withColumn("price", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))
    return o.dropna(subset=["price", "o_orderdate"]).filter(F.col("o_orderstatus").isin("F", "O")).select("o_orderkey")


@query("C2_half_open_window", """
SELECT seq FROM {history} WHERE time >= TIMESTAMP '2024-01-10' AND time < TIMESTAMP '2024-01-20'""")
def _(t):
    return t.history.filter("time >= TIMESTAMP_NTZ '2024-01-10' AND time < TIMESTAMP_NTZ '2024-01-20'").select("seq")


@query("C3_lead_filters", """
SELECT event_key, book_key, line, part, CASE WHEN lead_hours >= 24 THEN 'entry' WHEN lead_hours <= 12 THEN 'close' ELSE 'between' END AS kind
FROM {quotes} WHERE snapshot_ts < commence_time""")
def _(t):
    q = t.quotes.filter(F.col("snapshot_ts") < F.col("commence_time")).withColumn("lead", lead_hours("snapshot_ts", "commence_time"))
    kind = F.when(F.col("lead") >= 24, "entry").when(F.col("lead") <= 12, "close").otherwise("between")
    return q.select("event_key", "book_key", "line", "part", kind.alias("kind"))


@query("C4_minimum_books", """
SELECT event_key, count(DISTINCT book_key) AS n_books FROM {quotes} GROUP BY event_key HAVING count(DISTINCT book_key) >= 4""")
def _(t):
    return (t.quotes.groupBy("event_key").agg(F.countDistinct("book_key").alias("n_books")).filter("n_books >= 4"))


@query("C5_due_window", """
SELECT event_id, date_diff('second', ts, date_trunc('hour', ts) + INTERVAL 1 HOUR) // 60 AS lead FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR - ts BETWEEN INTERVAL 10 MINUTE AND INTERVAL 50 MINUTE
  AND event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error') AND event_id % 17 <> 0""")
def _(t):
    e = t.events.withColumns({"captured_at": F.col("ts").cast("timestamp"),
                              "commence": F.when(F.col("event_id") % 17 != 0, F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR"))})
    due = e.withColumn("lead", lead_minutes("captured_at", "commence")).filter(F.col("lead").between(10, 50))
    open_ = keys.unseen(due, t.events.filter("event_type = 'error'"), ["event_id"])
    secs = F.unix_seconds("commence") - F.unix_seconds("captured_at")
    return open_.select("event_id", F.floor(secs / 60).alias("lead"))


@query("C6_price_validity", """
SELECT event_key, book_key, line, part, CASE WHEN abs(odds_a) < 100 OR abs(odds_b) < 100 THEN 'price' ELSE 'probability' END AS fault
FROM {quotes} WHERE abs(odds_a) < 100 OR abs(odds_b) < 100 OR lead_hours / 90.0 <= 0 OR lead_hours / 90.0 >= 1""")
def _(t):
    from duelmark.functions.pricing import inside_unit, valid_price

    bad_price = ~(valid_price("odds_a") & valid_price("odds_b"))
    return (t.quotes.withColumn("p", F.col("lead_hours") / 90.0).filter(bad_price | ~inside_unit("p"))
            .select("event_key", "book_key", "line", "part", F.when(bad_price, "price").otherwise("probability").alias("fault")))


@query("C7_edge_bucket", """
SELECT event_key, CASE WHEN net_edge < CAST(0.06 AS DOUBLE) THEN '4_to_6' WHEN net_edge < CAST(0.08 AS DOUBLE) THEN '6_to_8'
  WHEN net_edge < CAST(0.10 AS DOUBLE) THEN '8_to_10' ELSE '10_plus' END AS bucket FROM {edges} WHERE net_edge >= CAST(0.04 AS DOUBLE)""")
def _(t):
    return ev.bucket_edges(score_picks(t.scored)).select("event_key", "bucket")


# --- joins -----------------------------------------------------------------------

@query("D1_validated_left_join", """
SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    n = t.nation.select("n_nationkey", "n_name")
    out = joins.lookup(joins.lookup(t.orders, c, ["o_custkey"]), n, ["n_nationkey"])
    return out.select("o_orderkey", "c_mktsegment", "n_name")


PAIR = "least(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) || '|' || greatest(CAST(a AS VARCHAR), CAST(b AS VARCHAR))"


@query("D2_pair_match", f"""
SELECT bout_date, pair, bout_id, odds_id FROM (
SELECT x.bout_date, x.pair, x.bout_id, y.bout_id AS odds_id,
       row_number() OVER (PARTITION BY x.bout_date, x.pair ORDER BY x.bout_id, y.bout_id) AS rn
FROM (SELECT *, {PAIR} AS pair FROM {{bouts}}) x JOIN (SELECT *, {PAIR} AS pair FROM {{bouts}} WHERE winner <> 'draw') y
  ON x.bout_date = y.bout_date AND x.pair = y.pair) WHERE rn = 1""")
def _(t):
    b = t.bouts.withColumn("pair", pair_key("a", "b"))
    # one row per key on both sides before the join: no all-pairs inside a repeated key
    odds = keys.keep_first(b.filter("winner <> 'draw'").select("bout_date", "pair", F.col("bout_id").alias("odds_id")),
                           ["bout_date", "pair"], ["odds_id"])
    left = keys.keep_first(b.select("bout_date", "pair", "bout_id"), ["bout_date", "pair"], ["bout_id"])
    return left.join(odds, ["bout_date", "pair"])


@query("D3_own_and_opponent_stats", """
WITH s AS (SELECT event_id // 2 AS bout_id, user_id, sum(value) AS total FROM events GROUP BY 1, 2)
SELECT b.bout_id, o.total AS own, p.total AS opp FROM {bouts} b LEFT JOIN s o ON o.bout_id = b.bout_id AND o.user_id = b.a
LEFT JOIN s p ON p.bout_id = b.bout_id AND p.user_id = b.b""", "own opp")
def _(t):
    s = t.events.groupBy(F.expr("event_id div 2").alias("bout_id"), "user_id").agg(F.sum("value").alias("total"))
    own = s.select("bout_id", F.col("user_id").alias("a"), F.col("total").alias("own"))
    opp = s.select("bout_id", F.col("user_id").alias("b"), F.col("total").alias("opp"))
    return (t.bouts.join(own, ["bout_id", "a"], "left").join(opp, ["bout_id", "b"], "left").select("bout_id", "own", "opp"))


@query("D4_opponent_values", """
SELECT bout_id, a AS entity, stat_a AS own, stat_b AS opp FROM {bouts} WHERE a <> b
UNION ALL SELECT bout_id, b, stat_b, stat_a FROM {bouts} WHERE a <> b""")
def _(t):
    return pit.two_sided_long(t.bouts.filter("a <> b"), ["bout_id"], {
        "entity": ("a", "b"), "own": ("stat_a", "stat_b"), "opp": ("stat_b", "stat_a")}).select("bout_id", "entity", "own", "opp")


@query("D5_nearest_date", """
SELECT bout_id, event_id, err FROM (
SELECT b.bout_id, e.event_id, date_diff('microsecond', b.bout_ts, e.ts) / 8.64e10 AS d, abs(date_diff('microsecond', b.bout_ts, e.ts)) / 8.64e10 AS err,
       row_number() OVER (PARTITION BY b.bout_id ORDER BY abs(date_diff('microsecond', b.bout_ts, e.ts)), e.ts, e.event_id) AS rn
FROM {bouts} b JOIN events e ON e.user_id = b.a AND e.event_type = 'purchase' AND abs(date_diff('microsecond', b.bout_ts, e.ts)) <= 86400000000)
WHERE rn = 1""", "err")
def _(t):
    right = t.events.filter("event_type = 'purchase'").select(F.col("user_id").alias("a"), F.col("ts").alias("r_ts"), "event_id")
    left = t.bouts.select("bout_id", "a", "bout_ts")
    out = joins.nearest_date(left, right, ["bout_id"], ["a"], "bout_ts", "r_ts", 1, ["event_id"])
    return out.select("bout_id", "event_id", F.col("date_error_days").alias("err"))


DAYS = "SELECT user_id AS u, CAST(ts AS DATE) AS d, min(event_id) AS hit FROM events WHERE event_type = 'error' GROUP BY 1, 2"


@query("D6_preferred_offset", f"""
WITH r AS ({DAYS})
SELECT bout_id, coalesce(x.hit, y.hit, z.hit) AS hit, CASE WHEN x.hit IS NOT NULL THEN 0 WHEN y.hit IS NOT NULL THEN 1 ELSE 2 END AS offset_rank
FROM {{bouts}} b LEFT JOIN r x ON x.u = b.a AND x.d = b.bout_date LEFT JOIN r y ON y.u = b.a AND y.d = b.bout_date - 1
LEFT JOIN r z ON z.u = b.a AND z.d = b.bout_date + 1 WHERE coalesce(x.hit, y.hit, z.hit) IS NOT NULL""")
def _(t):
    r = (t.events.filter("event_type = 'error'").groupBy(F.col("user_id").alias("a"), F.col("ts").cast("date").alias("d"))
         .agg(F.min("event_id").alias("hit")))
    out = joins.preferred_offset(t.bouts.select("bout_id", "a", "bout_date"), r, ["bout_id"], ["a"], "bout_date", "d")
    return out.select("bout_id", "hit", "offset_rank")


LAST = "snapshot_ts DESC, price DESC, part DESC, line DESC, ship DESC, book_key DESC"


@query("D7_as_of_lead", f"""
SELECT event_key, book_key, lead_hours, odds_a FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY {LAST}) AS rn
FROM {{valid}} WHERE lead_hours >= 24) WHERE rn = 1""")
def _(t):
    out = qt.at_or_before_lead(t.valid, ["event_key"], 24.0, "snapshot_ts", "lead_hours", [*TIE, "book_key"])
    return out.select("event_key", "book_key", "lead_hours", "odds_a")


@query("D8_entry_and_close", f"""
WITH e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY {LAST}) AS rn FROM {{valid}} WHERE lead_hours >= 24) WHERE rn = 1),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY {LAST}) AS rn FROM {{valid}} WHERE lead_hours <= 12) WHERE rn = 1)
SELECT event_key, e.lead_hours AS entry_lead, c.lead_hours AS close_lead, e.book_prob AS entry_prob, c.book_prob AS close_prob
FROM e JOIN c USING (event_key)""", "entry_prob close_prob")
def _(t):
    both = qt.entry_and_close(t.valid, ["event_key", "commence_time"], F.col("lead_hours") >= 24, F.col("lead_hours") <= 12,
                              "snapshot_ts", ["lead_hours", "book_prob"], [*TIE, "book_key"])
    ok = both.filter(qt.valid_entry_close())
    return ok.select("event_key", F.col("entry_lead_hours").alias("entry_lead"), F.col("close_lead_hours").alias("close_lead"),
                     F.col("entry_book_prob").alias("entry_prob"), F.col("close_book_prob").alias("close_prob"))


@query("D9_tracked_without_result", """
SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01' - INTERVAL 12 HOUR
  AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def _(t):
    done = t.orders.filter("o_orderdate < TIMESTAMP_NTZ '1998-06-01' - INTERVAL 12 HOURS").select("o_orderkey")
    results = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return keys.unseen(done, results, ["o_orderkey"])


@query("D10_overlay_history", f"""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY {LAST}) AS rn FROM {{valid}} WHERE book_key % 2 = 0 AND lead_hours >= 24),
fc AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY {LAST}) AS rn FROM {{valid}} WHERE book_key % 2 = 0 AND lead_hours < 24),
u AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY {LAST}) AS rn FROM {{valid}} WHERE book_key % 2 = 1 AND lead_hours >= 24),
uc AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY {LAST}) AS rn FROM {{valid}} WHERE book_key % 2 = 1 AND lead_hours < 24),
j AS (SELECT f.event_key, f.commence_time, coalesce(u.snapshot_ts, f.snapshot_ts) AS ets, coalesce(u.odds_a, f.odds_a) AS entry_odds_a,
  fc.snapshot_ts AS bts, fc.odds_a AS bo, CASE WHEN u.event_key IS NOT NULL THEN uc.snapshot_ts END AS uts, CASE WHEN u.event_key IS NOT NULL THEN uc.odds_a END AS uo
  FROM (SELECT * FROM f WHERE rn = 1) f LEFT JOIN (SELECT * FROM fc WHERE rn = 1) fc USING (event_key)
  LEFT JOIN (SELECT * FROM u WHERE rn = 1) u USING (event_key) LEFT JOIN (SELECT * FROM uc WHERE rn = 1) uc USING (event_key)),
v AS (SELECT *, coalesce(bts > ets AND bts < commence_time AND date_diff('second', bts, commence_time) <= 43200, false) AS bok,
  coalesce(uts > ets AND uts < commence_time AND date_diff('second', uts, commence_time) <= 43200, false) AS uok FROM j)
SELECT event_key, entry_odds_a, CASE WHEN uok AND (NOT bok OR uts > bts) THEN uo WHEN bok THEN bo END AS close_odds_a,
  date_diff('second', ets, commence_time) / 3600.0 AS entry_lead_hours,
  date_diff('second', CASE WHEN uok AND (NOT bok OR uts > bts) THEN uts WHEN bok THEN bts END, commence_time) / 3600.0 AS close_lead_hours FROM v""",
       "entry_lead_hours close_lead_hours")
def _(t):
    def side(rest):
        both = qt.entry_and_close(t.valid.filter(F.col("book_key") % 2 == rest), ["event_key", "commence_time"],
                                  F.col("lead_hours") >= 24, F.col("lead_hours") < 24, "snapshot_ts",
                                  ["odds_a"], [*TIE, "book_key"])
        return both.filter(F.col("entry_snapshot_ts").isNotNull())

    out = qt.overlay_history(side(0), side(1), ["event_key"], ["entry_snapshot_ts", "entry_odds_a"],
                             ["close_snapshot_ts", "close_odds_a"])
    return out.select("event_key", "entry_odds_a", "close_odds_a", "entry_lead_hours", "close_lead_hours")


LIMITS = "SELECT * FROM (VALUES ('AUTOMOBILE', 205.0), ('BUILDING', 155.0), ('FURNITURE', NULL), ('HOUSEHOLD', 135.0), ('MACHINERY', 265.0)) v(seg, lim)"


@query("D11_identity_resolution", f"""
WITH lim AS ({LIMITS}), reg AS (SELECT c_mktsegment || '-' || c_nationkey || '-' || (c_custkey % 40) AS name_key, c_custkey AS id,
   CASE WHEN c_custkey % 6 <> 0 THEN 115 + abs(c_acctbal) % 150 END AS w FROM customer),
need AS (SELECT DISTINCT c_mktsegment || '-' || c_nationkey || '-' || (o_orderkey % 40) AS name_key, c_mktsegment AS seg FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT need.name_key, lim.lim, reg.id, reg.w, abs(reg.w - lim.lim) AS gap FROM need JOIN lim USING (seg) LEFT JOIN reg USING (name_key)),
g AS (SELECT name_key, max(lim) AS lim, count(id) AS n, count(w) AS known, min(id) AS any_id, min(CASE WHEN w IS NOT NULL THEN id END) AS weighed, min(gap) AS mg FROM c GROUP BY 1),
k AS (SELECT c.name_key, count(*) AS ties, min(id) AS near FROM c JOIN g USING (name_key) WHERE gap = mg GROUP BY 1),
r AS (SELECT name_key, CASE WHEN n = 1 THEN any_id WHEN g.lim IS NOT NULL AND ties = 1 THEN near WHEN g.lim IS NULL AND known = 1 THEN weighed END AS id,
   CASE WHEN n = 0 THEN 'not_found' WHEN n = 1 THEN 'unique' WHEN (g.lim IS NOT NULL AND ties = 1) OR (g.lim IS NULL AND known = 1) THEN 'by_weight' ELSE 'ambiguous' END AS resolution
   FROM g LEFT JOIN k USING (name_key))
SELECT o_orderkey, coalesce(CAST(r.id AS VARCHAR), 'unresolved:' || r.name_key) AS entity_id, r.resolution
FROM orders JOIN customer ON o_custkey = c_custkey JOIN r ON r.name_key = c_mktsegment || '-' || c_nationkey || '-' || (o_orderkey % 40)""")
def _(t):
    c = t.customer
    stem = F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string"))
    weight = F.when(F.col("c_custkey") % 6 != 0, 115 + F.abs("c_acctbal") % 150)
    reg = c.select(F.concat_ws("-", stem, (F.col("c_custkey") % 40).cast("string")).alias("name_key"),
                   F.col("c_custkey").cast("string").alias("entity_id"), weight.alias("registered_weight"))
    # ids compare as numbers in the statement: keep the same order
    reg = reg.withColumn("entity_id", F.lpad("entity_id", 12, "0"))
    div = (F.when(F.col("c_mktsegment") == "AUTOMOBILE", "Light Heavyweight").when(F.col("c_mktsegment") == "BUILDING", "Lightweight")
           .when(F.col("c_mktsegment") == "HOUSEHOLD", "Bantamweight").when(F.col("c_mktsegment") == "MACHINERY", "Heavyweight"))
    rows = t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.concat_ws("-", stem, (F.col("o_orderkey") % 40).cast("string")).alias("name_key"), div.alias("division"))
    out = joins.resolve_or_mark(rows, reg, "name_key", "division")
    ident = F.when(F.col("entity_id").startswith("unresolved:"), F.col("entity_id")).otherwise(
        F.col("entity_id").cast("string").try_cast("long").cast("string"))
    return out.select("o_orderkey", ident.alias("entity_id"), "resolution")


@query("D12_source_preference", f"""
WITH p AS (SELECT user_id AS u, CAST(ts AS DATE) AS d, min(event_id) AS hit FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
q AS ({DAYS})
SELECT bout_id, coalesce(p0.hit, p1.hit, p2.hit, q0.hit, q1.hit, q2.hit) AS hit,
  CASE WHEN coalesce(p0.hit, p1.hit, p2.hit) IS NOT NULL THEN 'first' WHEN coalesce(q0.hit, q1.hit, q2.hit) IS NOT NULL THEN 'second' END AS src FROM {{bouts}} b
LEFT JOIN p p0 ON p0.u = a AND p0.d = bout_date LEFT JOIN p p1 ON p1.u = a AND p1.d = bout_date - 1 LEFT JOIN p p2 ON p2.u = a AND p2.d = bout_date + 1
LEFT JOIN q q0 ON q0.u = a AND q0.d = bout_date LEFT JOIN q q1 ON q1.u = a AND q1.d = bout_date - 1 LEFT JOIN q q2 ON q2.u = a AND q2.d = bout_date + 1""")
def _(t):
    def table(kind, name):
        return (t.events.filter(F.col("event_type") == kind)
                .groupBy(F.col("user_id").alias("a"), F.col("ts").cast("date").alias("d")).agg(F.min("event_id").alias(name)))

    b = t.bouts.select("bout_id", "a", "bout_date")
    x = joins.preferred_offset(b, table("purchase", "h1"), ["bout_id"], ["a"], "bout_date", "d", how="left").drop("d", "offset_rank")
    y = joins.preferred_offset(x, table("error", "h2"), ["bout_id"], ["a"], "bout_date", "d", how="left")
    src = F.when(F.col("h1").isNotNull(), "first").when(F.col("h2").isNotNull(), "second")
    return y.select("bout_id", F.coalesce("h1", "h2").alias("hit"), src.alias("src"))


@query("D13_dimension_lookup", """
SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def _(t):
    n = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    out = joins.lookup(joins.lookup(t.supplier, n, ["s_nationkey"]), t.region, ["r_regionkey"])
    return out.select("s_suppkey", "n_name", "r_name")


@query("D14_walk_forward_copies", """
SELECT f AS fold, count(*) AS n, sum(value) AS total FROM {history}
JOIN (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-29', INTERVAL 7 DAY)) AS TIMESTAMP) AS f) ON time < f GROUP BY f""", "total", 3)
def _(t):
    folds = [dt.datetime(2024, 1, d) for d in (8, 15, 22, 29)]
    rows = t.history.withColumn("time", F.col("time").cast("timestamp"))
    out = joins.fold_copies(rows, "time", folds)
    return (out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
            .withColumn("fold", F.col("fold").cast("timestamp_ntz")))


@query("D14_walk_forward_totals", """
SELECT f AS fold, count(*) AS n, sum(value) AS total FROM {history} JOIN (SELECT DISTINCT date_trunc('hour', time) AS f FROM {history}) ON time < f GROUP BY f""", "total", 3)
def _(t):
    folds = t.history.select(F.date_trunc("hour", "time").cast("timestamp_ntz").alias("time")).distinct()
    out = joins.fold_totals(t.history.select("time", "value"), "time", folds, ["value"], F.date_trunc("day", "time"))
    return out.filter("n > 0").select(F.col("time").alias("fold"), "n", F.col("value").alias("total"))


@query("D15_hypothetical_rows", """
SELECT user_id AS entity, count(*) AS n_prior, max(ts) AS prev_time, avg(value) AS prior_mean FROM events GROUP BY user_id""", "prior_mean", 5)
def _(t):
    from duelmark.plans.card import features_of_hypothetical

    hyp = t.customer.select(F.col("c_custkey").alias("entity"), F.lit("2030-01-01").cast("timestamp_ntz").alias("time"),
                            (-F.col("c_custkey") - 1).alias("seq"))
    hyp = hyp.join(t.history.select("entity").distinct(), "entity", "left_semi")
    out = features_of_hypothetical(t.history, hyp, ["entity", "seq"], lambda df: pit.point_in_time(
        df, "entity", "time", "seq", {"n_prior": pit.prior_count(), "prev_time": pit.previous("time"),
                                      "prior_mean": pit.prior_mean("value")}, "DAY"))
    return out.select("entity", "n_prior", "prev_time", "prior_mean")


@query("D16_required_pairs", """
SELECT CAST(bout_ts AS DATE) AS card, count(*) AS matched, min(bout_ts) AS card_start FROM {bouts}
WHERE a IN (SELECT user_id FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) > 10) GROUP BY 1""")
def _(t):
    wanted = t.events.filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("a")).count().filter("count > 10")
    hit = joins.required_pairs(t.bouts, wanted, ["a"], "bout_ts")
    return hit.groupBy(F.col("bout_ts").cast("date").alias("card")).agg(
        F.count(F.lit(1)).alias("matched"), F.min("bout_ts").alias("card_start"))


MAN = """(SELECT CAST(l_orderkey AS VARCHAR) AS uid, CASE WHEN l_linenumber <= 2 THEN 'discovery_72h' WHEN l_linenumber <= 4 THEN 'entry' ELSE 'close' END AS kind,
 CASE WHEN l_returnflag = 'R' THEN 'ok' WHEN l_returnflag = 'A' THEN 'no_match' ELSE 'http_error' END AS status, l_shipdate AS start, l_extendedprice AS s1, l_partkey AS s2, l_suppkey AS s3 FROM lineitem)"""


@query("D17_resume_worklist", f"""
WITH m AS {MAN}, w AS (SELECT CAST(o_orderkey AS VARCHAR) AS uid, k AS kind FROM orders, (VALUES ('entry'), ('close')) v(k)),
s AS (SELECT uid, arg_max(start, (s1, s2, s3, start)) AS known_start FROM m WHERE kind = 'discovery_72h' AND status = 'ok' GROUP BY uid)
SELECT w.uid, w.kind, s.known_start FROM w LEFT JOIN s USING (uid)
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.uid = w.uid AND m.kind = w.kind AND m.status IN ('ok', 'no_match'))""")
def _(t):
    return _worklist(t)


def _worklist(t):
    l = t.lineitem
    man = l.select(
        F.col("l_orderkey").cast("string").alias("uid"),
        F.when(F.col("l_linenumber") <= 2, "discovery_72h").when(F.col("l_linenumber") <= 4, "entry").otherwise("close").alias("kind"),
        F.when(F.col("l_returnflag") == "R", "ok").when(F.col("l_returnflag") == "A", "no_match").otherwise("http_error").alias("status"),
        F.col("l_shipdate").alias("start"), F.col("l_extendedprice").alias("s1"), F.col("l_partkey").alias("s2"), F.col("l_suppkey").alias("s3"))
    wanted = t.orders.select(F.col("o_orderkey").cast("string").alias("uid"), F.explode(F.array(F.lit("entry"), F.lit("close"))).alias("kind"))
    return joins.resume_worklist(wanted, man, "uid", "kind", "status", "start", ["s1", "s2", "s3", "start"])


@query("E24_remaining_work_cost", f"""
WITH m AS {MAN}, w AS (SELECT CAST(o_orderkey AS VARCHAR) AS uid, k AS kind FROM orders, (VALUES ('entry'), ('close')) v(k)),
p AS (SELECT uid, count(*) AS n FROM w WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.uid = w.uid AND m.kind = w.kind AND m.status IN ('ok', 'no_match')) GROUP BY uid)
SELECT count(*) AS pending_events, CAST(sum(n) + sum(CASE WHEN k.uid IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS requests
FROM p LEFT JOIN (SELECT DISTINCT uid FROM m WHERE kind = 'discovery_72h' AND status = 'ok') k USING (uid)""")
def _(t):
    per = _worklist(t).groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.max("known_start").alias("known"))
    return per.agg(F.count(F.lit(1)).alias("pending_events"),
                   (F.sum("n") + F.count_if(F.col("known").isNull())).alias("requests"))


@query("E24_pairs_per_event", f"""
SELECT bout_date, {PAIR} AS pair, count(*) AS n_bouts FROM {{bouts}} GROUP BY 1, 2""")
def _(t):
    return t.bouts.groupBy("bout_date", pair_key("a", "b").alias("pair")).agg(F.count(F.lit(1)).alias("n_bouts"))


# --- ordering ----------------------------------------------------------------------

@query("G1_last_n_event_dates", """
SELECT event_key, date FROM {scored} WHERE date IN (SELECT DISTINCT date FROM {scored} ORDER BY date DESC LIMIT 50)""")
def _(t):
    last = t.scored.select("date").distinct().orderBy(F.desc("date")).limit(50)
    return t.scored.join(last, "date", "left_semi").select("event_key", "date")


@query("G2_latest_rows", """
SELECT event_key, date, pick_side, net_edge FROM {edges} ORDER BY date DESC, event_key DESC LIMIT 30""", "net_edge")
def _(t):
    s = score_picks(t.scored)
    return s.orderBy(F.desc("date"), F.desc("event_key")).limit(30).select("event_key", "date", "pick_side", "net_edge")


_LOSS = "avg(-(CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END))"


@query("G3_best_blend_weight", f"""
SELECT arg_min(w, (round(loss, 12), -w)) AS market_weight, min(loss) AS log_loss FROM (SELECT w, {_LOSS} AS loss FROM (
SELECT w, y, least(greatest(w * p_line + (1 - w) * p_model, 0.001), 0.999) AS q FROM {{scored}}, (VALUES (0.0), (0.25), (0.5), (0.75), (0.9), (1.0)) v(w)) GROUP BY w)""",
       "market_weight log_loss")
def _(t):
    rows = ev.explode_params(t.scored, [{"w": w} for w in (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)])
    rows = rows.withColumn("p", F.col("w") * F.col("p_line") + (1 - F.col("w")) * F.col("p_model"))
    loss = rows.groupBy("w").agg(F.avg(ev.log_loss_term("y", "p")).alias("loss"))
    return loss.agg(F.min_by("w", F.struct(F.round("loss", 12), -F.col("w"))).alias("market_weight"), F.min("loss").alias("log_loss"))


@query("G4_ranked_by_metric", """
SELECT odds_source, roi, row_number() OVER (ORDER BY roi DESC, odds_source) AS place
FROM (SELECT odds_source, sum(pnl) / sum(stake) AS roi FROM {picks} GROUP BY 1)""", "roi")
def _(t):
    from pyspark.sql import Window as W

    # one row per source label: a closed, tiny set
    table = ev.breakdown(t.stored("picks"), "odds_source").select("odds_source", "roi")
    return table.withColumn("place", F.row_number().over(W.orderBy(F.desc("roi"), "odds_source")))


@query("G5_chronological_order", """
SELECT bout_id, row_number() OVER (ORDER BY bout_date, bout_id) - 1 AS position FROM {bouts}""")
def _(t):
    from duelmark.operators.running import ordered_index

    bucket = F.struct("bout_date", F.floor(F.col("bout_id") / 1_000_000))
    return ordered_index(t.bouts, ["bout_date", "bout_id"], bucket, "position").select("bout_id", "position")


# --- keep one, sets -------------------------------------------------------------------

@query("F14_keep_first_and_last", """
SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY user_id""")
def _(t):
    e = t.events.select("user_id", "ts", "event_id", "value")
    first = keys.keep_first(e, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_id").alias("first_id"))
    last = keys.keep_last(e, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_id").alias("last_id"))
    return first.join(last, "user_id")


@query("E7_conflicting_mapping", """
SELECT DISTINCT c_nationkey AS key, c_mktsegment AS value, n_values FROM customer JOIN (
SELECT c_nationkey AS k, count(DISTINCT c_mktsegment) AS n_values FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1) ON k = c_nationkey""")
def _(t):
    c = t.customer.select(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("value"))
    return keys.conflicting_mapping(c, "key", "value")


@query("E8_duplicate_keys", """
SELECT CAST(sum(n - 1) AS BIGINT) AS surplus FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)""")
def _(t):
    return keys.surplus_rows(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("H1_union_all_sides", """
SELECT entity, count(*) AS n, sum(stat) AS total FROM (SELECT a AS entity, stat_a AS stat FROM {bouts} UNION ALL SELECT b, stat_b FROM {bouts}) GROUP BY 1""", "total", 4)
def _(t):
    long = pit.two_sided_long(t.bouts, ["bout_id"], {"entity": ("a", "b"), "stat": ("stat_a", "stat_b")})
    return long.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("stat").alias("total"))


@query("H2_registry_union_details", """
SELECT name_key, entity_id, src, weight FROM (SELECT *, row_number() OVER (PARTITION BY name_key, entity_id ORDER BY seq) AS rn FROM (
SELECT lower(c_name) AS name_key, CAST(c_custkey AS VARCHAR) AS entity_id, 'registry' AS src, 115 + c_custkey % 150 AS weight, c_custkey * 2 AS seq FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT lower(c_name), CAST(c_custkey AS VARCHAR), 'details', NULL, c_custkey * 2 + 1 FROM customer)) WHERE rn = 1""")
def _(t):
    from duelmark.functions import id_from_url, leading_number, norm_name

    url = F.concat(F.lit("http://x.example/fighter-details/"), F.col("c_custkey").cast("string"))
    reg = t.customer.filter("c_custkey % 3 <> 0").select(
        F.col("c_name").alias("name"), url.alias("url"), F.concat((115 + F.col("c_custkey") % 150).cast("string"), F.lit(" lbs.")).alias("weight_text"),
        F.lit("registry").alias("src"), (F.col("c_custkey") * 2).alias("seq"))
    det = t.customer.select(F.col("c_name").alias("name"), url.alias("url"), F.lit("details").alias("src"), (F.col("c_custkey") * 2 + 1).alias("seq"))
    out = joins.build_registry(reg, det, "name", "url", id_from_url("url"), norm_name("name"),
                               leading_number("weight_text", anywhere=True), "seq")
    return out.select("name_key", "entity_id", "src", F.col("registered_weight").cast("long").alias("weight"))


@query("H3_dropped_ids", """
SELECT id FROM (SELECT a AS id FROM {bouts} WHERE bout_id % 2 = 0 UNION SELECT b FROM {bouts} WHERE bout_id % 2 = 0)
EXCEPT (SELECT a FROM {bouts} WHERE bout_id % 2 = 1 AND a % 5 <> 0 AND b % 5 <> 0 UNION SELECT b FROM {bouts} WHERE bout_id % 2 = 1 AND a % 5 <> 0 AND b % 5 <> 0)""")
def _(t):
    new = t.bouts.filter("bout_id % 2 = 1 AND a % 5 <> 0 AND b % 5 <> 0")      # ids with a last digit of 0 or 5 are lost
    return keys.dropped_ids(t.bouts.filter("bout_id % 2 = 0"), new, ["a", "b"])


@query("H4_union_of_id_columns", "SELECT a AS id FROM {bouts} UNION SELECT b FROM {bouts}")
def _(t):
    return keys.union_ids(t.bouts, ["a", "b"])
