"""Book, live and one-sided consensus."""

from pyspark.sql import functions as F

from duelmark.catalog.registry import query
from duelmark.operators import quotes as qt


@query("E3_book_consensus", "SELECT * FROM {consensus}", "odds_a odds_b consensus_prob lead_hours")
def _(t):
    return t.consensus.select("event_key", "snapshot_ts", "commence_time", "odds_a", "odds_b", "consensus_prob",
                              "n_books", "lead_hours")


@query("E4_live_consensus", """
SELECT event_key, list_sort(list(odds_a))[count(*) // 2 + 1] AS odds_a, list_sort(list(odds_b))[count(*) // 2 + 1] AS odds_b,
  round(quantile_cont(book_prob, 0.5), 8) AS market_prob_a, count(*) AS market_books, round(max(book_prob) - min(book_prob), 8) AS market_spread,
  max(odds_a) AS best_odds_a, max(odds_b) AS best_odds_b, 'Book ' || CAST(arg_max(book_key, (odds_a, -book_key)) AS VARCHAR) AS best_book_a,
  'Book ' || CAST(arg_max(book_key, (odds_b, -book_key)) AS VARCHAR) AS best_book_b FROM {clean} GROUP BY event_key""",
       "market_prob_a market_spread")
def _(t):
    rows = t.clean.withColumn("book_title", F.concat(F.lit("Book "), F.col("book_key").cast("string")))
    return qt.live_consensus(rows, ["event_key"], "book_key")


@query("E5_one_sided_consensus", """
SELECT event_key, list_sort(list(oa))[count(oa) // 2 + 1] AS odds_a, list_sort(list(ob))[count(ob) // 2 + 1] AS odds_b,
  least(count(oa), count(ob)) AS n_books FROM (SELECT event_key, CASE WHEN line <> 3 THEN odds_a END AS oa, CASE WHEN line <> 5 THEN odds_b END AS ob FROM {clean})
GROUP BY event_key HAVING least(count(oa), count(ob)) > 0""")
def _(t):
    rows = t.clean.select("event_key", F.when(F.col("line") != 3, F.col("odds_a")).alias("oa"),
                          F.when(F.col("line") != 5, F.col("odds_b")).alias("ob"))
    return qt.one_sided_consensus(rows, ["event_key"], "oa", "ob")


@query("E1_bout_entity_sums", """
SELECT l_orderkey AS event_key, l_suppkey AS entity, CAST(sum(l_linenumber) AS BIGINT) AS landed,
  CAST(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber END), 0) AS BIGINT) AS downs, max(l_linenumber) AS n_rounds
FROM lineitem GROUP BY 1, 2""")
def _(t):
    from duelmark.plans.features import round_totals

    l = t.lineitem.select(F.col("l_orderkey").alias("event_key"), F.col("l_suppkey").alias("entity"),
                          F.col("l_linenumber").alias("round_no"), F.col("l_linenumber").alias("landed"),
                          F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")).alias("downs"))
    out = round_totals(l, ["event_key", "entity"], "round_no", ["landed", "downs"], fade_of="landed")
    return out.select("event_key", "entity", "landed", "downs", "n_rounds")


@query("E2_late_round_fade", """
SELECT l_orderkey AS event_key, l_suppkey AS entity, sum(CASE WHEN l_linenumber >= 3 THEN l_extendedprice END) /
  count(DISTINCT CASE WHEN l_linenumber >= 3 THEN l_linenumber END) - sum(CASE WHEN l_linenumber = 1 THEN l_extendedprice END) AS fade
FROM lineitem GROUP BY 1, 2 HAVING count(CASE WHEN l_linenumber >= 3 THEN 1 END) > 0""", "fade", 4)
def _(t):
    from duelmark.plans.features import round_totals

    l = t.lineitem.select(F.col("l_orderkey").alias("event_key"), F.col("l_suppkey").alias("entity"),
                          F.col("l_linenumber").alias("round_no"), F.col("l_extendedprice").alias("landed"))
    out = round_totals(l, ["event_key", "entity"], "round_no", ["landed"], fade_of="landed")
    return out.filter("late_rounds > 0").select("event_key", "entity", "fade")
