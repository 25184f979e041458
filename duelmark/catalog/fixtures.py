"""Views over the given tables that give every operator whole-table input.

``Tables`` builds them as DataFrames, ``CTES`` states the same views in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from duelmark.operators.betting import add_prices, desired_stake, row_pnl, score_picks, allocate
from duelmark.operators.evaluation import clv_points, explode_params
from duelmark.operators.quotes import book_consensus, clean_quotes, valid_quotes
from duelmark.session import materialize

TIE = ["price", "part", "line", "ship"]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        self._written: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    def stored(self, view: str) -> DataFrame:
        """A view written once to the shared folder, for queries that read it many times."""
        if view not in self._written:
            self._written[view] = materialize(getattr(self, view), view)
        return self._written[view]

    @cached_property
    def history(self) -> DataFrame:
        """Long point-in-time table over events."""
        return self.events.select(
            F.col("user_id").alias("entity"), F.col("ts").alias("time"), F.col("event_id").alias("seq"), "value",
            (F.col("value") > 50).alias("won"), (F.col("event_type") == "error").alias("flag"), "event_type")

    @cached_property
    def bouts(self) -> DataFrame:
        """Two-sided contests from consecutive events: one aggregation, no self-join."""
        even = F.col("event_id") % 2 == 0

        def pick(c, cond):
            return F.max(F.when(cond, F.col(c)))

        pairs = self.events.groupBy(F.expr("event_id div 2").alias("bout_id")).agg(
            pick("ts", even).alias("bout_ts"), pick("user_id", even).alias("a"), pick("user_id", ~even).alias("b"),
            pick("value", even).alias("stat_a"), pick("value", ~even).alias("stat_b"),
            pick("event_type", even).alias("event_type"))
        pairs = pairs.filter("a IS NOT NULL AND b IS NOT NULL")
        winner = (F.when(F.col("stat_a") > F.col("stat_b"), "A").when(F.col("stat_a") < F.col("stat_b"), "B")
                  .otherwise("draw"))
        method = (F.when(F.col("event_type") == "error", "KO/TKO").when(F.col("event_type") == "purchase", "SUB")
                  .otherwise("DEC"))
        return pairs.select("bout_id", F.col("bout_ts").cast("date").alias("bout_date"), "bout_ts", "a", "b",
                            "stat_a", "stat_b", winner.alias("winner"), method.alias("method"))

    @cached_property
    def quotes(self) -> DataFrame:
        """Per-book two-sided prices with lead times."""
        j = self.lineitem.join(self.orders.select("o_orderkey", "o_orderdate"),
                               F.col("l_orderkey") == F.col("o_orderkey"))
        q, low = F.col("l_quantity"), F.col("l_discount") < 0.05
        lead = q * 2 - 4
        return j.select(
            F.col("l_orderkey").alias("event_key"), F.col("l_suppkey").alias("book_key"),
            F.col("o_orderdate").alias("commence_time"), lead.alias("lead_hours"),
            (F.col("o_orderdate") - F.make_dt_interval(F.lit(0), lead.cast("int"), F.lit(0), F.lit(0)))
            .alias("snapshot_ts"),
            F.when(low, -(95 + q * 6)).otherwise(95 + q * 6).alias("odds_a"),
            F.when(low, 80 + q * 5).otherwise(-(115 + q * 7)).alias("odds_b"),
            F.col("l_extendedprice").alias("price"), F.col("l_partkey").alias("part"),
            F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("ship"))

    @cached_property
    def clean(self) -> DataFrame:
        return clean_quotes(self.quotes, ["event_key"], "book_key", "snapshot_ts", "commence_time", "odds_a",
                            "odds_b", tie=TIE)

    @cached_property
    def valid(self) -> DataFrame:
        return valid_quotes(self.quotes, ["event_key", "book_key"], "snapshot_ts", "commence_time", "odds_a", "odds_b")

    @cached_property
    def consensus(self) -> DataFrame:
        return book_consensus(self.clean, ["event_key"], min_books=3)

    @cached_property
    def scored(self) -> DataFrame:
        """Consensus events with a stand-in model and result."""
        k = F.col("event_key")
        c = self.consensus.select(
            "event_key", F.col("commence_time").cast("date").alias("date"), "odds_a", "odds_b",
            F.col("consensus_prob").alias("p_line"), "n_books",
            (0.02 + 0.96 * ((k * 7919) % 1000) / 1000.0).alias("p_model"),
            (0.01 + ((k * 31) % 7) / 500.0).alias("se"), ((k * 13) % 2).cast("int").alias("y"))
        return add_prices(c)

    @cached_property
    def picks(self) -> DataFrame:
        """Scored and allocated under the flat policy, with profit."""
        rows = score_picks(self.scored).withColumn("desired", desired_stake())
        rows = allocate(rows, ["date"], ["event_key"], 2)
        source = F.when(F.col("event_key") % 3 == 0, "captured").otherwise("closing")
        close = F.col("p_line") + ((F.col("event_key") * 17) % 21 - 10) / 400.0
        return rows.withColumns({"pnl": row_pnl(), "odds_source": source,
                                 "p_close_line": F.when(F.col("event_key") % 4 != 0, close)})


    @cached_property
    def sets(self) -> DataFrame:
        """Two prediction sets over the same events, scored: the model, and half of it with half of the market."""
        rows = explode_params(self.scored, [{"prediction_set": "production", "w": 0.0}, {"prediction_set": "entry", "w": 0.5}])
        w = F.col("w")
        rows = rows.withColumns({"p_model": w * F.col("p_line") + (1 - w) * F.col("p_model"), "se": (1 - w) * F.col("se")})
        close = F.col("p_line") + ((F.col("event_key") * 17) % 21 - 10) / 400.0
        rows = rows.withColumn("p_close_line", F.when(F.col("event_key") % 4 != 0, close))
        return score_picks(rows).withColumn("clv", clv_points())


def imp(o: str) -> str:
    return f"(CASE WHEN {o} < 0 THEN -({o}) / (-({o}) + 100.0) ELSE 100.0 / ({o} + 100.0) END)"


def profit(o: str) -> str:
    return f"(CASE WHEN {o} < 0 THEN 100.0 / -({o}) ELSE {o} / 100.0 END)"


def ll(y: str, p: str, low: float = 0.001) -> str:
    q = f"least(greatest({p}, {low}), {1 - low})"
    return f"(-(CASE WHEN {y} = 1 THEN ln({q}) ELSE ln(1 - {q}) END))"


CTES = {
    "history": """
SELECT user_id AS entity, ts AS time, event_id AS seq, value, value > 50 AS won,
       event_type = 'error' AS flag, event_type FROM events""",
    "bouts": """
SELECT e1.event_id // 2 AS bout_id, CAST(e1.ts AS DATE) AS bout_date, e1.ts AS bout_ts,
       e1.user_id AS a, e2.user_id AS b, e1.value AS stat_a, e2.value AS stat_b,
       CASE WHEN e1.value > e2.value THEN 'A' WHEN e1.value < e2.value THEN 'B' ELSE 'draw' END AS winner,
       CASE e1.event_type WHEN 'error' THEN 'KO/TKO' WHEN 'purchase' THEN 'SUB' ELSE 'DEC' END AS method
FROM events e1 JOIN events e2 ON e2.event_id = e1.event_id + 1 WHERE e1.event_id % 2 = 0""",
    "quotes": """
SELECT l_orderkey AS event_key, l_suppkey AS book_key, o_orderdate AS commence_time,
       l_quantity * 2 - 4 AS lead_hours,
       o_orderdate - to_hours(CAST(l_quantity * 2 - 4 AS INTEGER)) AS snapshot_ts,
       CASE WHEN l_discount < 0.05 THEN -(95 + l_quantity * 6) ELSE 95 + l_quantity * 6 END AS odds_a,
       CASE WHEN l_discount < 0.05 THEN 80 + l_quantity * 5 ELSE -(115 + l_quantity * 7) END AS odds_b,
       l_extendedprice AS price, l_partkey AS part, l_linenumber AS line, l_shipdate AS ship
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "clean": f"""
SELECT * EXCLUDE (rn), {imp('odds_a')} / ({imp('odds_a')} + {imp('odds_b')}) AS book_prob
FROM (SELECT *, row_number() OVER (PARTITION BY event_key, book_key
             ORDER BY snapshot_ts DESC, price DESC, part DESC, line DESC, ship DESC) AS rn
      FROM {{quotes}} WHERE abs(odds_a) >= 100 AND abs(odds_b) >= 100 AND snapshot_ts < commence_time)
WHERE rn = 1""",
    "valid": f"""
SELECT *, {imp('odds_a')} / ({imp('odds_a')} + {imp('odds_b')}) AS book_prob
FROM {{quotes}} WHERE abs(odds_a) >= 100 AND abs(odds_b) >= 100 AND snapshot_ts < commence_time""",
    "consensus": """
SELECT event_key, max(snapshot_ts) AS snapshot_ts, min(commence_time) AS commence_time,
       quantile_cont(odds_a, 0.5) AS odds_a, quantile_cont(odds_b, 0.5) AS odds_b,
       quantile_cont(book_prob, 0.5) AS consensus_prob, count(DISTINCT book_key) AS n_books,
       date_diff('second', max(snapshot_ts), min(commence_time)) / 3600.0 AS lead_hours
FROM {clean} GROUP BY event_key HAVING count(DISTINCT book_key) >= 3""",
    "scored": f"""
SELECT *, {imp('odds_a')} AS pr_raw, {imp('odds_b')} AS pb_raw FROM (
SELECT event_key, CAST(commence_time AS DATE) AS date, odds_a, odds_b, consensus_prob AS p_line, n_books,
       CAST(0.02 AS DOUBLE) + CAST(0.96 AS DOUBLE) * ((event_key * 7919) % 1000) / CAST(1000.0 AS DOUBLE) AS p_model,
       CAST(0.01 AS DOUBLE) + ((event_key * 31) % 7) / CAST(500.0 AS DOUBLE) AS se,
       CAST((event_key * 13) % 2 AS INTEGER) AS y
FROM {{consensus}})""",
    "edges": """
SELECT *, greatest(p_model - pr_raw, (1 - p_model) - pb_raw) AS edge,
       greatest(p_model - pr_raw, (1 - p_model) - pb_raw) - se AS net_edge,
       CASE WHEN p_model - pr_raw >= (1 - p_model) - pb_raw THEN 'A' ELSE 'B' END AS pick_side,
       greatest(p_model - pr_raw, (1 - p_model) - pb_raw) - se >= CAST(0.04 AS DOUBLE) AS qualified FROM {scored}""",
    "units": f"""
SELECT *, CASE WHEN (pick_side = 'A') = (y = 1) THEN CASE WHEN pick_side = 'A' THEN {profit('odds_a')}
          ELSE {profit('odds_b')} END ELSE -1.0 END AS unit_pnl FROM {{edges}}""",
    "sets": f"""
SELECT *, CASE WHEN (pick_side = 'A') = (y = 1) THEN CASE WHEN pick_side = 'A' THEN {profit('odds_a')} ELSE {profit('odds_b')} END ELSE -1.0 END AS unit_pnl,
  ((CASE WHEN pick_side = 'A' THEN p_close_line ELSE 1.0 - p_close_line END) - (CASE WHEN pick_side = 'A' THEN p_line ELSE 1.0 - p_line END)) * 100.0 AS clv
FROM (SELECT *, greatest(p - pr_raw, (1 - p) - pb_raw) - s AS net_edge, CASE WHEN p - pr_raw >= (1 - p) - pb_raw THEN 'A' ELSE 'B' END AS pick_side
  FROM (SELECT prediction_set, event_key, date, odds_a, odds_b, p_line, y, pr_raw, pb_raw, w * p_line + (1 - w) * p_model AS p, (1 - w) * se AS s,
    CASE WHEN event_key % 4 <> 0 THEN p_line + ((event_key * 17) % 21 - 10) / CAST(400.0 AS DOUBLE) END AS p_close_line
    FROM {{scored}}, (VALUES ('production', CAST(0.0 AS DOUBLE)), ('entry', CAST(0.5 AS DOUBLE))) v(prediction_set, w)))""",
    "picks": """
SELECT *, stake * unit_pnl AS pnl, CASE WHEN event_key % 3 = 0 THEN 'captured' ELSE 'closing' END AS odds_source,
       CASE WHEN event_key % 4 <> 0 THEN p_line + ((event_key * 17) % 21 - 10) / CAST(400.0 AS DOUBLE) END AS p_close_line
FROM (SELECT *, CASE WHEN qualified AND row_number() OVER (PARTITION BY date, qualified ORDER BY net_edge DESC, event_key) <= 2
             THEN 1 ELSE 0 END AS stake FROM {units})""",
}
