"""Quality gates and ledgers."""

import datetime as dt

from pyspark.sql import functions as F

from duelmark.catalog.fixtures import TIE, imp, profit
from duelmark.catalog.registry import query
from duelmark.functions import pair_key, scheduled_start, signed_price, start_precision
from duelmark.session import materialize
from duelmark.operators import ledger as lg, quality as ql, quotes as qt


def _unpivot(table: str, checks: dict[str, str]) -> str:
    return "\nUNION ALL ".join(f"SELECT '{n}' AS chk, CAST({e} AS BIGINT) AS n FROM {table}" for n, e in checks.items())


def named_bouts(t):
    k = F.col("bout_id")
    return t.bouts.select(
        "bout_id", F.when(k % 500 != 0, F.col("bout_date")).alias("date"),
        F.when(k % 300 != 0, F.col("a").cast("string")).alias("a"), F.col("b").cast("string").alias("b"),
        F.col("a").cast("string").alias("name_a"), F.col("b").cast("string").alias("name_b"),
        F.when(k % 700 != 0, F.col("winner")).alias("winner"), pair_key("a", "b").alias("pair"),
        F.concat(F.lit("http://x.example/fighter-details/"), F.when(k % 400 == 0, "77f").otherwise(F.col("b").cast("string"))).alias("url_b"))


PAIR = "least(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) || '|' || greatest(CAST(a AS VARCHAR), CAST(b AS VARCHAR))"


@query("J1_bout_audit", _unpivot(
    f"(SELECT *, CASE WHEN bout_id % 500 <> 0 THEN bout_date END AS d, {PAIR} AS pair FROM {{bouts}})", {
        "invalid_date": "count(*) FILTER (WHERE d IS NULL)", "missing_id_a": "count(*) FILTER (WHERE bout_id % 300 = 0)",
        "missing_id_b": "0 * count(*)", "duplicate_date_pair": "count(*) - count(DISTINCT coalesce(CAST(d AS VARCHAR), '') || '/' || pair)",
        "invalid_winner": "count(*) FILTER (WHERE bout_id % 700 = 0)", "self_match_name": "count(*) FILTER (WHERE a = b)",
        "self_match_id": "count(*) FILTER (WHERE a = b AND bout_id % 300 <> 0)", "missing_url_b": "0 * count(*)",
        "url_id_mismatch_b": "count(*) FILTER (WHERE bout_id % 400 = 0)"}))
def _(t):
    return ql.audit_bouts(named_bouts(t), url_b="url_b").withColumnRenamed("check", "chk")


def upcoming(t):
    k = F.col("event_key")
    return t.consensus.select(
        F.when(k % 900 != 0, F.col("commence_time").cast("date")).alias("date"), F.concat(F.lit("a"), (k % 40).cast("string")).alias("a"),
        F.concat(F.lit("a"), (k % 41).cast("string")).alias("b"), F.when(k % 7 != 0, F.format_string("%+.1f", "odds_a")).alias("odds_a"),
        F.col("odds_b").cast("string").alias("odds_b"), (F.col("consensus_prob") * F.when(k % 50 == 0, 3.0).otherwise(1.0)).alias("prob"),
        (F.col("n_books") - 3).alias("books"), F.col("odds_a").alias("best_a"), F.when(k % 3 == 0, " ").otherwise("bk").alias("book_a"),
        F.lit(None).cast("double").alias("best_b"), F.lit(None).cast("string").alias("book_b")
    ).withColumn("pair", pair_key("a", "b"))


@query("J2_upcoming_audit", _unpivot(
    """(SELECT *, CASE WHEN event_key % 900 <> 0 THEN CAST(commence_time AS DATE) END AS d, 'a' || event_key % 40 AS a, 'a' || event_key % 41 AS b,
       consensus_prob * CASE WHEN event_key % 50 = 0 THEN 3.0 ELSE 1.0 END AS p FROM {consensus})""", {
        "invalid_date": "count(*) FILTER (WHERE d IS NULL)", "missing_or_zero_price": "count(*) FILTER (WHERE event_key % 7 = 0 OR odds_a = 0 OR odds_b = 0)",
        "duplicate_date_pair": "count(*) - count(DISTINCT coalesce(CAST(d AS VARCHAR), '') || '/' || least(a, b) || '|' || greatest(a, b))",
        "self_match": "count(*) FILTER (WHERE a = b)", "invalid_probability": "count(*) FILTER (WHERE NOT (p > 0 AND p < 1))",
        "invalid_book_count": "count(*) FILTER (WHERE n_books - 3 < 1)", "invalid_best_a": "count(*) FILTER (WHERE abs(odds_a) < 100)",
        "best_without_book_a": "count(*) FILTER (WHERE event_key % 3 = 0)", "invalid_best_b": "0 * count(*)", "best_without_book_b": "0 * count(*)"}))
def _(t):
    return ql.audit_upcoming(upcoming(t), prob="prob", books="books", best=("best_a", "book_a", "best_b", "book_b")).withColumnRenamed("check", "chk")


@query("J3_fail_closed_gate", f"""
SELECT true AS rejected, 'input quality gate failed: self_match_name=' || count(*) || ', self_match_id=' || count(*) AS message FROM {{bouts}} WHERE a = b""")
def _(t):
    clean = t.bouts.select("bout_id", "bout_ts", "a", "b", F.col("a").alias("name_a"), F.col("b").alias("name_b"), "winner",
                           F.concat_ws("/", pair_key("a", "b"), F.col("bout_id").cast("string")).alias("pair"))
    try:
        ql.assert_clean(ql.audit_bouts(clean, date="bout_ts"))
        outcome = (False, "")
    except ValueError as exc:
        outcome = (True, str(exc))
    return t.spark.createDataFrame([outcome], "rejected boolean, message string")


@query("J4_pre_event_offenders", """
SELECT o_orderkey, o_orderdate AS start FROM orders WHERE TIMESTAMP '1995-06-01' >= o_orderdate""")
def _(t):
    o = t.orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("start"))
    return ql.late_rows(o, "start", dt.datetime(1995, 6, 1)).select("o_orderkey", F.col("start").cast("timestamp_ntz").alias("start"))


LAST = "snapshot_ts DESC, price DESC, part DESC, line DESC, ship DESC, book_key DESC"


@query("J5_history_validation", f"""
WITH e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY {LAST}) AS rn FROM {{valid}} WHERE lead_hours >= 20) WHERE rn = 1),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY {LAST}) AS rn FROM {{valid}} WHERE lead_hours <= 16) WHERE rn = 1),
j AS (SELECT e.event_key, e.lead_hours AS el, e.snapshot_ts AS ets, CASE WHEN e.event_key % 11 <> 0 THEN e.odds_a END AS ea, c.snapshot_ts AS cts, c.lead_hours AS cl,
  CASE WHEN e.event_key % 13 <> 0 THEN c.odds_a END AS ca FROM e LEFT JOIN c USING (event_key))
""" + _unpivot("j", {
    "incomplete_entry": "count(*) FILTER (WHERE ea IS NULL)", "entry_not_pre_event": "0 * count(*)", "entry_lead_too_short": "count(*) FILTER (WHERE el < 24)",
    "partial_close": "count(*) FILTER (WHERE cts IS NOT NULL AND ca IS NULL)", "invalid_close_time": "count(*) FILTER (WHERE ca IS NOT NULL AND NOT (ets < cts))",
    "close_lead_too_long": "count(*) FILTER (WHERE ca IS NOT NULL AND cl > 12)"}))
def _(t):
    h = qt.entry_and_close(t.valid, ["event_key", "commence_time"], F.col("lead_hours") >= 20, F.col("lead_hours") <= 16,
                           "snapshot_ts", ["lead_hours", "odds_a"], [*TIE, "book_key"]).filter("entry_snapshot_ts IS NOT NULL")
    h = h.withColumns({"entry_odds_a": F.when(F.col("event_key") % 11 != 0, F.col("entry_odds_a")),
                       "close_odds_a": F.when(F.col("event_key") % 13 != 0, F.col("close_odds_a"))})
    return ql.history_checks(h, ["commence_time", "entry_snapshot_ts", "entry_lead_hours", "entry_odds_a"],
                             ["close_snapshot_ts", "close_lead_hours", "close_odds_a"]).withColumnRenamed("check", "chk")


@query("J6_refresh_regression_gate", """
WITH o AS (SELECT * FROM {bouts}), n AS (SELECT * FROM {bouts} WHERE a % 7 <> 0 AND b % 7 <> 0),
d AS (SELECT a AS id FROM o UNION SELECT b FROM o EXCEPT (SELECT a FROM n UNION SELECT b FROM n))
SELECT 'rows_shrank' AS chk, greatest((SELECT count(*) FROM o) - (SELECT count(*) FROM n), 0) AS n
UNION ALL SELECT 'latest_moved_backward', CAST((SELECT max(bout_ts) FROM n) < (SELECT max(bout_ts) FROM o) AS BIGINT)
UNION ALL SELECT 'ids_dropped', (SELECT count(*) FROM d)""")
def _(t):
    return ql.refresh_regressions(t.bouts, t.bouts.filter("a % 7 <> 0 AND b % 7 <> 0"), "bout_ts", ["a", "b"]).withColumnRenamed("check", "chk")


@query("J7_identity_warnings", """
SELECT subject, 'unresolved_identity' AS warning, count(*) AS n FROM (SELECT CAST(a AS VARCHAR) AS subject FROM {bouts} WHERE a % 17 = 0
UNION ALL SELECT CAST(b AS VARCHAR) FROM {bouts} WHERE b % 17 = 0) GROUP BY 1""")
def _(t):
    def ident(c):
        return F.when(F.col(c) % 17 == 0, F.concat(F.lit("unresolved:"), F.col(c).cast("string"))).otherwise(F.col(c).cast("string"))

    b = t.bouts.withColumns({"id_a": ident("a"), "id_b": ident("b")})
    return ql.identity_warnings(b, ["id_a", "id_b"], ["a", "b"])


# --- ledgers -------------------------------------------------------------------------

NOW = dt.datetime(1990, 1, 1)
LATER = dt.datetime(1990, 1, 2)


def predictions(t):
    """Card rows: one contest per scored event between ``a<key>`` and ``b<key>``."""
    p = t.stored("picks")
    key, is_a = F.col("event_key").cast("string"), F.col("pick_side") == "A"
    exact = F.when(F.col("event_key") % 2 == 0, F.concat(F.col("date").cast("string"), F.lit("T20:00:00Z")))
    a, b = F.concat(F.lit("a"), key), F.concat(F.lit("b"), key)
    return p.select(
        "event_key", "date", F.when(is_a, a).otherwise(b).alias("pick"), F.when(is_a, b).otherwise(a).alias("opp"),
        signed_price(F.when(is_a, F.col("odds_a")).otherwise(F.col("odds_b"))).alias("price"),
        F.round(F.when(is_a, F.col("p_line")).otherwise(1 - F.col("p_line")) * 100 + 1e-9, 1).alias("market"),
        (F.col("stake") > 0).alias("bet"), "stake", "y", scheduled_start("date", exact).alias("start"),
        start_precision("date", exact).alias("precision"))


_P0 = f"""(SELECT *, CASE WHEN pick_side = 'A' THEN 'a' ELSE 'b' END || event_key AS pick, CASE WHEN pick_side = 'A' THEN 'b' ELSE 'a' END || event_key AS opp,
  printf('%+d', CAST(trunc(CASE WHEN pick_side = 'A' THEN odds_a ELSE odds_b END) AS BIGINT)) AS price_text,
  round(CASE WHEN pick_side = 'A' THEN p_line ELSE 1 - p_line END * 100 + 1e-9, 1) AS market,
  substr(sha256(strftime(date, '%Y-%m-%d') || '|a' || event_key || '|b' || event_key), 1, 20) AS fight_key FROM {{picks}})"""


def _snap(stamp):
    return f"substr(sha256('{stamp}|' || fight_key || '|' || pick || '|' || opp || '|' || price_text), 1, 20)"


@query("K1_record_snapshots", f"""
SELECT event_key, fight_key, {_snap('1990-01-01T00:00:00Z')} AS snapshot_id, 'production-v3' AS model_version,
  CASE WHEN event_key % 2 = 0 THEN 'exact' ELSE 'date_only' END AS timing_precision,
  strftime(date, '%Y-%m-%d') || CASE WHEN event_key % 2 = 0 THEN 'T20:00:00Z' ELSE 'T00:00:00Z' END AS scheduled_start FROM {_P0}""")
def _(t):
    rows = lg.record_snapshots(predictions(t), None, NOW, "start", "precision", ["pick", "opp", "price"], {"model_version": "production-v3"})
    return rows.select("event_key", "fight_key", "snapshot_id", "model_version", "timing_precision", "scheduled_start")


def snapshots(t, stamp):
    return lg.snapshot_rows(predictions(t), stamp, "start", "precision", ["pick", "opp", "price"])


def trades(t):
    now, later = snapshots(t, NOW), snapshots(t, LATER)
    locked = now.filter("bet AND event_key % 5 = 0").select("fight_key")
    return lg.lock_trades(now, now.unionByName(later), locked, ["snapshot_id"], ["recorded_at"])


@query("K2_lock_trades", f"""
SELECT event_key, substr(sha256('official|' || fight_key), 1, 20) AS trade_id, {_snap('1990-01-02T00:00:00Z')} AS snapshot_id, stake FROM {_P0}
WHERE stake > 0 AND event_key % 5 <> 0""")
def _(t):
    return trades(t).select("event_key", "trade_id", "snapshot_id", "stake")


def settlement(t):
    k = F.col("event_key")
    tr = materialize(trades(t), "trades").withColumn("scheduled_start", F.when(k % 19 == 0, "unknown").otherwise(F.col("scheduled_start")))
    tr = tr.withColumn("pair", pair_key("pick", "opp"))
    done = tr.filter("event_key % 7 = 0").select("trade_id")
    names = {"side_a": F.concat(F.lit("a"), k.cast("string")),
             "pair": pair_key(F.concat(F.lit("a"), k.cast("string")), F.concat(F.lit("b"), k.cast("string")))}
    s = t.stored("picks").withColumns(names)
    results = s.select(F.date_add("date", ((k % 3) - 1).cast("int")).alias("date"), "pair", "side_a",
                       F.when(k % 23 == 0, "draw").when(F.col("y") == 1, "A").otherwise("B").alias("winner"))
    captured = s.filter("event_key % 2 = 0").select(F.date_add("date", 1).alias("date"), "pair", "side_a", "odds_a", "odds_b",
                                                     (F.col("p_line") * 0.98).alias("prob_a"))
    master = s.filter("event_key % 3 = 0").select("date", "pair", "side_a", "odds_a", "odds_b")
    return tr, lg.settle(tr, done, results, captured, master)


_SETTLED = f"""(SELECT *, CASE WHEN event_key % 2 = 0 THEN 'standardized-t30' WHEN event_key % 3 = 0 THEN 'master' END AS closing_source,
  (pick_side = 'A') = (y = 1) AS won, CAST(price_text AS DOUBLE) AS px,
  CASE WHEN event_key % 2 = 0 THEN CASE WHEN pick_side = 'A' THEN p_line * 0.98 ELSE 1 - p_line * 0.98 END * 100
       WHEN event_key % 3 = 0 THEN CASE WHEN pick_side = 'A' THEN {imp('odds_a')} / ({imp('odds_a')} + {imp('odds_b')}) ELSE 1 - {imp('odds_a')} / ({imp('odds_a')} + {imp('odds_b')}) END * 100 END AS closing_market
  FROM {_P0} WHERE stake > 0 AND event_key % 5 <> 0 AND event_key % 7 <> 0 AND event_key % 19 <> 0 AND event_key % 23 <> 0)"""


@query("K3_settle_trades", f"""
SELECT substr(sha256('official|' || fight_key), 1, 20) AS trade_id, CASE WHEN won THEN 'WIN' ELSE 'LOSS' END AS result,
  CASE WHEN won THEN stake * {profit('px')} ELSE -stake END AS pnl, CASE WHEN closing_source IS NOT NULL THEN price_text END AS closing_price,
  round(closing_market, 6) AS closing_market, round(closing_market - market, 6) AS clv_prob, closing_source FROM {_SETTLED}""", "pnl closing_market clv_prob")
def _(t):
    return settlement(t)[1]


@query("K5_timing_validity", f"""
SELECT count(*) FILTER (WHERE event_key % 19 <> 0) AS valid, count(*) FILTER (WHERE event_key % 19 = 0) AS invalid FROM {{picks}} WHERE stake > 0 AND event_key % 5 <> 0""")
def _(t):
    return lg.timing_rejects(settlement(t)[0])


_SUMMARY = f"""SELECT (SELECT count(*) FROM {{picks}} WHERE stake > 0 AND event_key % 5 <> 0) AS official_trades, count(*) AS settled, CAST(sum(stake) AS DOUBLE) AS staked,
  sum(CASE WHEN won THEN stake * {profit('px')} ELSE -stake END) AS pnl, sum(CASE WHEN won THEN stake * {profit('px')} ELSE -stake END) / sum(stake) AS roi,
  avg(round(closing_market - market, 6)) AS mean_clv_prob_points, avg(CAST(round(closing_market - market, 6) > 0 AS DOUBLE)) AS positive_clv_rate FROM {_SETTLED}"""


@query("E20_ledger_summary", _SUMMARY, "staked pnl roi mean_clv_prob_points positive_clv_rate", 3)
def _(t):
    tr, st = settlement(t)
    return lg.ledger_summary(tr, st)


@query("E27_forward_verdict", f"""
SELECT official_trades, settled, pnl, 'paper_only' AS status,
 'Forward-test evidence only. Positive closing-line value should be established before ROI is treated as meaningful.' AS interpretation FROM ({_SUMMARY})""", "pnl", 3)
def _(t):
    tr, st = settlement(t)
    return lg.forward_verdict(lg.ledger_summary(tr, st)).select("official_trades", "settled", "pnl", "status", "interpretation")
