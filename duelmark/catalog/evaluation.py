"""Scoring, allocation, reports, bootstrap intervals, drift and gates."""

from pyspark.sql import functions as F

from duelmark.catalog.fixtures import ll, profit
from duelmark.catalog.registry import query
from duelmark.operators import betting, bootstrap as bs, evaluation as ev, running
from duelmark.operators.betting import score_picks

def by_year():
    return F.year("date")


DRAWS = 10_000


@query("F16_pick_scoring", "SELECT event_key, edge, net_edge, pick_side, qualified FROM {edges}", "edge net_edge")
def _(t):
    return score_picks(t.scored).select("event_key", "edge", "net_edge", "pick_side", "qualified")


@query("F11_capped_allocation", "SELECT event_key, date, stake FROM {picks}")
def _(t):
    return t.stored("picks").select("event_key", "date", "stake")


def tiered_sql(cap: str, threshold="0.04", high="0.08", src="{units}", group="date"):
    return f"""SELECT *, CASE WHEN desired > 0 THEN least(desired, greatest(0, {cap} - coalesce(sum(desired) OVER (
      PARTITION BY {group} ORDER BY net_edge DESC, event_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) ELSE 0 END AS stake
      FROM (SELECT *, CASE WHEN net_edge < CAST({threshold} AS DOUBLE) THEN 0 WHEN net_edge >= CAST({high} AS DOUBLE) THEN 2 ELSE 1 END AS desired FROM {src})"""


@query("F11_tiered_partial_fill", f"SELECT event_key, CAST(stake AS INTEGER) AS stake FROM ({tiered_sql('3')})")
def _(t):
    rows = score_picks(t.scored).withColumn("desired", betting.desired_stake(max_stake=2, high_threshold=0.08))
    return betting.allocate(rows, ["date"], ["event_key"], 3).select("event_key", "stake")


@query("F15_row_pnl", "SELECT event_key, stake, pnl FROM {picks}", "pnl")
def _(t):
    return t.stored("picks").select("event_key", "stake", "pnl")


def two_sided_sql(edge, dogs="false"):
    ba = f"(p_model > pr_raw + {edge} AND (NOT ({dogs}) OR pr_raw < 0.5))"
    bb = f"(1 - p_model > pb_raw + {edge} AND (NOT ({dogs}) OR pb_raw < 0.5))"
    n = f"(CAST({ba} AS INTEGER) + CAST({bb} AS INTEGER))"
    pnl = (f"(CASE WHEN {ba} THEN CASE WHEN y = 1 THEN {profit('odds_a')} ELSE -1.0 END ELSE 0.0 END + "
           f"CASE WHEN {bb} THEN CASE WHEN y = 0 THEN {profit('odds_b')} ELSE -1.0 END ELSE 0.0 END)")
    wins = f"(CAST({ba} AND y = 1 AS INTEGER) + CAST({bb} AND y = 0 AS INTEGER))"
    return n, pnl, wins


_N, _PNL, _WINS = two_sided_sql("CAST(0.05 AS DOUBLE)")


@query("F15_two_sided_simulator", f"SELECT event_key, {_N} AS n_bets, {_PNL} AS pnl FROM {{scored}} WHERE {_N} > 0", "pnl")
def _(t):
    n, pnl = betting.two_sided_pnl(0.05)
    return t.scored.select("event_key", n.alias("n_bets"), pnl.alias("pnl")).filter("n_bets > 0")


CARDS = "(SELECT date, CAST(sum(stake) AS DOUBLE) AS staked, sum(pnl) AS pnl FROM {picks} GROUP BY date)"


def cards(t):
    return ev.event_rollup(t.stored("picks"))


@query("F12_equity_curve", f"""
SELECT date, equity, max(equity) OVER (ORDER BY date) - equity AS drawdown
FROM (SELECT date, sum(pnl) OVER (ORDER BY date) AS equity FROM {CARDS})""", "equity drawdown")
def _(t):
    return running.equity_curve(cards(t), ["date"], "pnl", by_year()).select("date", "equity", "drawdown")


@query("F12_max_drawdown", f"""
SELECT max(peak - equity) AS max_drawdown FROM (SELECT equity, max(equity) OVER (ORDER BY date) AS peak
FROM (SELECT date, sum(pnl) OVER (ORDER BY date) AS equity FROM {CARDS}))""", "max_drawdown")
def _(t):
    return running.max_drawdown(running.equity_curve(cards(t), ["date"], "pnl", by_year()))


@query("F13_drawdown_stop", f"""
WITH c AS (SELECT *, sum(pnl) OVER (ORDER BY date) AS equity FROM {CARDS}),
d AS (SELECT *, greatest(0.0, max(equity) OVER (ORDER BY date)) - equity AS dd FROM c), b AS (SELECT min(date) AS breach FROM d WHERE dd >= 10)
SELECT date, coalesce(date > breach, false) AS halted, CASE WHEN date > breach THEN 0.0 ELSE pnl END AS kept_pnl FROM d, b""", "kept_pnl")
def _(t):
    curve = running.equity_curve(cards(t), ["date"], "pnl", by_year(), peak_floor=0.0)
    out = running.halt_after_drawdown(curve, "date", 10.0)
    return out.select("date", "halted", F.when(F.col("halted"), 0.0).otherwise(F.col("pnl")).alias("kept_pnl"))


@query("E9_event_rollup", """
SELECT date, count(*) AS n_contests, count(*) FILTER (WHERE stake > 0) AS n_bets, CAST(sum(stake) AS DOUBLE) AS staked, sum(pnl) AS pnl,
  string_agg(DISTINCT odds_source, ',' ORDER BY odds_source) AS source_list FROM {picks} GROUP BY date""", "staked pnl")
def _(t):
    return ev.event_rollup(t.stored("picks"), source="odds_source")


@query("E10_breakdown_by_source", """
SELECT odds_source, count(*) AS n, count(*) FILTER (WHERE stake > 0) AS bets, CAST(sum(stake) AS DOUBLE) AS staked, sum(pnl) AS pnl,
  sum(pnl) / nullif(sum(stake), 0) AS roi, count(*) / (SELECT count(*) FROM {picks}) AS share FROM {picks} GROUP BY 1""", "staked pnl roi share")
def _(t):
    return ev.breakdown(t.stored("picks"), "odds_source")


@query("E11_probability_metrics", f"""
SELECT avg({ll('y', 'p_model')}) AS log_loss_model, avg(pow(least(greatest(p_model, 0.001), 0.999) - y, 2)) AS brier_model,
  avg(CAST(CAST(p_model >= 0.5 AS INTEGER) = y AS DOUBLE)) AS accuracy_model, avg({ll('y', 'p_line', 1e-5)}) AS log_loss_line,
  avg(pow(p_line - y, 2)) AS brier_line, avg(CAST(CAST(p_line >= 0.5 AS INTEGER) = y AS DOUBLE)) AS accuracy_line FROM {{scored}}""",
       "log_loss_model brier_model accuracy_model log_loss_line brier_line accuracy_line")
def _(t):
    return t.scored.agg(*ev.prob_metrics("y", "p_model", "_model"), *ev.prob_metrics("y", "p_line", "_line", 1e-5))


@query("E12_yearly_metrics", f"""
SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS contests, avg({ll('y', 'p_model')}) AS model_log_loss, avg({ll('y', 'p_line')}) AS market_log_loss,
  count(p_close_line) AS close_contests, avg({ll('y', 'p_model')}) - avg({ll('y', 'p_line')}) AS model_minus_market FROM {{picks}} GROUP BY 1""",
       "model_log_loss market_log_loss model_minus_market")
def _(t):
    return ev.yearly_metrics(t.stored("picks"), close="p_close_line")


@query("E13_agreement", """
SELECT avg(CAST((p_model >= 0.5) = (p_line >= 0.5) AS DOUBLE)) AS agree_rate, corr(p_model, p_line) AS correlation,
  count(*) FILTER (WHERE (p_model >= 0.5) <> (p_line >= 0.5)) AS disagreements,
  avg(CAST(CAST(p_model >= 0.5 AS INTEGER) = y AS DOUBLE)) FILTER (WHERE (p_model >= 0.5) <> (p_line >= 0.5)) AS model_right,
  avg(1 - CAST(CAST(p_model >= 0.5 AS INTEGER) = y AS DOUBLE)) FILTER (WHERE (p_model >= 0.5) <> (p_line >= 0.5)) AS market_right FROM {scored}""",
       "agree_rate correlation model_right market_right")
def _(t):
    return ev.agreement(t.scored)


_GN, _GP, _ = two_sided_sql("e", "s = 'dogs'")


@query("E14_threshold_segment_grid", f"""
SELECT e AS min_edge, s AS segment, CAST(sum({_GN}) AS BIGINT) AS n_bets, sum({_GP}) AS pnl, sum({_GP}) / sum({_GN}) AS roi
FROM {{scored}}, (VALUES (CAST(0.03 AS DOUBLE)), (CAST(0.05 AS DOUBLE)), (CAST(0.08 AS DOUBLE)), (CAST(0.12 AS DOUBLE))) a(e), (VALUES ('all'), ('dogs')) b(s)
GROUP BY 1, 2 HAVING sum({_GN}) > 0""", "min_edge pnl roi", 5)
def _(t):
    return ev.threshold_grid(t.scored)


GRID = " UNION ALL ".join(
    f"SELECT CAST({th} AS DOUBLE) AS threshold, {'NULL' if cap is None else cap} AS cap, stake, stake * unit_pnl AS pnl FROM ("
    + (tiered_sql(str(cap), th, high) if cap is not None else
       f"SELECT *, CASE WHEN net_edge < CAST({th} AS DOUBLE) THEN 0 WHEN net_edge >= CAST({high} AS DOUBLE) THEN 2 ELSE 1 END AS stake FROM {{units}}") + ")"
    for th, high in (("0.02", "0.08"), ("0.04", "0.08"), ("0.06", "0.12")) for cap in (None, 2, 4))


@query("E14_threshold_cap_grid", f"""
SELECT threshold, CAST(cap AS DOUBLE) AS cap, count(*) FILTER (WHERE stake > 0) AS bets, CAST(sum(stake) AS DOUBLE) AS staked, sum(pnl) AS pnl,
  sum(pnl) / sum(stake) AS roi FROM ({GRID}) GROUP BY 1, 2""", "threshold staked pnl roi", 5)
def _(t):
    rows = ev.allocate_grid(score_picks(t.scored), ["event_key"], (0.02, 0.04, 0.06), (None, 2, 4))
    return ev.stake_summary(rows, ["threshold", "cap"])


def poisson_weights(u: str) -> str:
    low, steps = bs.poisson_steps()
    return " + ".join([str(low)] + [f"CAST({u} >= {step} AS INTEGER)" for step in steps])


def uniforms(keys: str, key: str, seed: int, draws: int) -> str:
    """(key, draw, u): the number that picks a key's weight in each draw."""
    return f"""(SELECT key, block * {bs.PER_HASH} + j AS draw, (('0x' || substr(h, CASE WHEN j < 3 THEN 1 ELSE 17 END, 15))::BIGINT >> CAST({bs.BITS} * (j % 3) AS INTEGER)) & {(1 << bs.BITS) - 1} AS u
FROM (SELECT key, block, md5('{seed}|' || block || '|' || CAST(key AS VARCHAR)) AS h FROM (SELECT DISTINCT {key} AS key FROM {keys}), (SELECT unnest(range({-(-draws // bs.PER_HASH)})) AS block)),
  (SELECT unnest(range({bs.PER_HASH})) AS j) WHERE block * {bs.PER_HASH} + j < {draws})"""


def grouped_boot(cells: str, by: str, key: str, ratios: dict[str, tuple[str, str]], draws: int = DRAWS, seed: int = 0) -> str:
    """(by, <name>_low, <name>_high) over a table with a row per group and cluster."""
    each = ", ".join(f"sum(w * {num}) / nullif(sum(w * {den}), 0) AS {name}" for name, (num, den) in ratios.items())
    ends = ", ".join(f"quantile_cont({name}, {q}) AS {name}_{end}" for name in ratios for end, q in (("low", 0.05), ("high", 0.95)))
    return f"""(SELECT {by}, {ends} FROM (SELECT {by}, draw, {each} FROM {cells} c
JOIN (SELECT key, draw, CAST({poisson_weights('u')} AS DOUBLE) AS w FROM {uniforms(cells, key, seed, draws)}) g ON c.{key} = g.key GROUP BY {by}, draw) GROUP BY {by})"""


BUCKET = """CASE WHEN net_edge < CAST(0.06 AS DOUBLE) THEN '4_to_6' WHEN net_edge < CAST(0.08 AS DOUBLE) THEN '6_to_8' WHEN net_edge < CAST(0.10 AS DOUBLE) THEN '8_to_10' ELSE '10_plus' END"""
_ROI_CLV = {"roi": ("pnl", "bets"), "clv": ("clv", "clv_bets")}


@query("E15_edge_buckets", f"""
WITH c AS (SELECT {BUCKET} AS bucket, date, count(*) AS bets, sum(unit_pnl) AS pnl, count(clv) AS clv_bets, coalesce(sum(clv), 0) AS clv
FROM (SELECT *, ((CASE WHEN pick_side = 'A' THEN p_close_line ELSE 1.0 - p_close_line END) - (CASE WHEN pick_side = 'A' THEN p_line ELSE 1.0 - p_line END)) * 100.0 AS clv FROM {{picks}})
WHERE net_edge >= CAST(0.04 AS DOUBLE) GROUP BY 1, 2)
SELECT bucket, CAST(sum(bets) AS BIGINT) AS bets, sum(pnl) AS pnl, sum(pnl) / sum(bets) AS roi, CAST(sum(clv_bets) AS BIGINT) AS clv_bets, sum(clv) / nullif(sum(clv_bets), 0) AS mean_clv,
  any_value(roi_low) AS roi_low, any_value(roi_high) AS roi_high, any_value(clv_low) AS clv_low, any_value(clv_high) AS clv_high
FROM c JOIN {grouped_boot('c', 'bucket', 'date', _ROI_CLV)} USING (bucket) GROUP BY 1""", "pnl roi mean_clv roi_low roi_high clv_low clv_high", 5)
def _(t):
    return ev.edge_bucket_report(t.stored("picks").withColumn("clv", ev.clv_points()), clv="clv", draws=DRAWS)


@query("E16_closing_line_value", f"""
SELECT count(p_close_line) AS contests_with_close, avg(CAST(p_close_line IS NOT NULL AS DOUBLE)) AS close_coverage,
  avg({ll('y', 'p_close_line')}) FILTER (WHERE p_close_line IS NOT NULL) AS log_loss_close, count(clv) AS active_bets_with_close, avg(clv) AS mean_clv,
  avg(CAST(clv > 0 AS DOUBLE)) AS positive_clv_rate
FROM (SELECT *, CASE WHEN stake > 0 THEN ((CASE WHEN pick_side = 'A' THEN p_close_line ELSE 1.0 - p_close_line END)
  - (CASE WHEN pick_side = 'A' THEN p_line ELSE 1.0 - p_line END)) * 100.0 END AS clv FROM {{picks}})""",
       "close_coverage log_loss_close mean_clv positive_clv_rate")
def _(t):
    return ev.clv_report(t.stored("picks").withColumn("clv", ev.clv_points()))


def boot_sql(cluster_table: str, num: str, den: str, key: str, seed: int = 0, draws: int = DRAWS) -> str:
    return f"""WITH g AS (SELECT {key} AS key, {num} AS num0, {den} AS den0 FROM {cluster_table}),
d AS (SELECT draw, sum(w * num0) / nullif(sum(w * den0), 0) AS ratio FROM (SELECT key, draw, {poisson_weights('u')} AS w FROM {uniforms('g', 'key', seed, draws)}) JOIN g USING (key) GROUP BY draw)
SELECT quantile_cont(ratio, 0.05) AS ci_low, quantile_cont(ratio, 0.95) AS ci_high FROM d"""


@query("E17_cluster_bootstrap_ratio", boot_sql(f"(SELECT * FROM {CARDS} WHERE staked > 0)", "pnl", "staked", "date"), "ci_low ci_high")
def _(t):
    return bs.cluster_ratio_ci(cards(t), ["date"], draws=DRAWS)


@query("E18_cluster_bootstrap_mean", boot_sql(
    "(SELECT date, sum(unit_pnl) AS s, count(*) AS k FROM {picks} WHERE stake > 0 GROUP BY date)", "s", "k", "date", 7), "ci_low ci_high")
def _(t):
    active = t.stored("picks").filter("stake > 0").withColumn("unit_pnl", F.col("pnl") / F.col("stake"))
    return bs.cluster_mean_ci(active, "date", "unit_pnl", draws=DRAWS, seed=7)


@query("E19_iid_bootstrap_mean", boot_sql("(SELECT * FROM {picks} WHERE stake > 0)", "pnl", "1", "event_key", 3, 4000), "ci_low ci_high")
def _(t):
    return bs.row_mean_ci(t.stored("picks").filter("stake > 0"), "pnl", draws=4000, seed=3, key=["event_key"])


def counted_boot(cells: str, by: str, draws: int, seed: int) -> str:
    """Draws of the mean per group over cells (by, cell, total, n): a cell's weight is Poisson(n), from its cumulative probabilities."""
    comma = f"{by}, " if by else ""
    key = f"CAST({by} AS VARCHAR) || '|' || cell" if by else "CAST(cell AS VARCHAR)"
    reach = "9 + 9 * sqrt(n)"
    return f"""(SELECT {comma}draw, sum(w * total / n) / nullif(sum(w), 0) AS ratio FROM (
  SELECT {comma}draw, total, n, low + len(list_filter(steps, lambda s: s <= u)) AS w FROM (SELECT *, {key} AS key FROM {cells}) k
  JOIN {uniforms(f"(SELECT {key} AS key FROM {cells})", "key", seed, draws)} USING (key)
  JOIN (SELECT n, min(k) AS low, list(step ORDER BY k) FILTER (WHERE step < {(1 << bs.BITS) - 1}) AS steps FROM (
    SELECT n, k, CAST(floor(sum(exp(-n + k * ln(n) - lgamma(k + 1))) OVER (PARTITION BY n ORDER BY k) * {1 << bs.BITS}) AS BIGINT) AS step
    FROM (SELECT DISTINCT n FROM {cells}), range(greatest(0, CAST(trunc(n - ({reach})) AS BIGINT)), CAST(trunc(n + {reach}) AS BIGINT) + 1) r(k)) GROUP BY n) USING (n))
  GROUP BY {comma}draw)"""


def value_cells(rows: str, value: str, by: str = "") -> str:
    return f"(SELECT {by}{',' if by else ''} CAST(floor({value} * {bs.STEP} + 0.5) AS BIGINT) AS cell, sum({value}) AS total, count(*) AS n FROM {rows} GROUP BY ALL)"


# reference rows are those before a date, recent ones the rest; open_days grows with time, the other fields do not
SINCE = "1996-01-01"
DRIFTING = """(SELECT *, CASE WHEN date < DATE '1996-01-01' THEN 'reference' ELSE 'recent' END AS period, date_diff('day', DATE '1995-01-01', date) AS open_days FROM {picks})"""
RANGES = {"p_model": (0.0, 1.0), "p_line": (0.0, 1.0), "edge": (-0.5, 1.0), "se": (0.0, 0.05), "net_edge": (-0.5, 1.0), "stake": (0.0, 2.0), "open_days": (0.0, 2500.0)}
DRIFT = " UNION ALL ".join(
    f"""SELECT period, count(*) AS rows, avg(CAST(stake > 0 AS DOUBLE)) AS bet_rate, '{c}' AS field, avg({c}) AS mean, stddev_pop({c}) AS std,
    count(*) FILTER (WHERE {c} IS NULL) AS missing FROM {DRIFTING} GROUP BY 1""" for c in RANGES)


def drifting(t):
    rows = t.stored("picks").withColumn("open_days", F.datediff("date", F.lit("1995-01-01").cast("date")))
    return rows, F.when(F.col("date") < F.lit(SINCE).cast("date"), "reference").otherwise("recent")


@query("E21_drift_summary", DRIFT, "mean std bet_rate")
def _(t):
    rows, period = drifting(t)
    return ev.drift_summary(rows, period, list(RANGES), "stake")


@query("E21_drift_warnings", f"""
SELECT r.field, r.mean AS reference_mean, r.std AS reference_std, c.mean AS recent_mean, (c.mean - r.mean) / r.std AS z_shift
FROM ({DRIFT}) r JOIN ({DRIFT}) c ON r.field = c.field AND r.period = 'reference' AND c.period = 'recent' WHERE abs((c.mean - r.mean) / r.std) >= 2""",
       "reference_mean reference_std recent_mean z_shift")
def _(t):
    rows, period = drifting(t)
    return ev.drift_warnings(ev.drift_summary(rows, period, list(RANGES)), z=2.0)


_BINS = " UNION ALL ".join(
    f"SELECT '{f}' AS field, period, CAST(least(greatest(floor((CAST({f} AS DOUBLE) - {low}) / {high - low} * 20), 0), 19) AS INTEGER) AS bin FROM {DRIFTING} WHERE {f} IS NOT NULL"
    for f, (low, high) in RANGES.items())


@query("E21_drift_distance", f"""
WITH c AS (SELECT field, bin, count(*) FILTER (WHERE period = 'reference') AS a, count(*) FILTER (WHERE period = 'recent') AS b FROM ({_BINS}) GROUP BY 1, 2),
w AS (SELECT field, sum(a) AS na, sum(b) AS nb FROM c GROUP BY 1)
SELECT field, sum(abs(a / na - b / nb)) / 2 AS distance, count(*) AS bins FROM c JOIN w USING (field) GROUP BY 1""", "distance")
def _(t):
    rows, period = drifting(t)
    return ev.drift_distance(rows, period, RANGES)


@query("E21_recent_sources", f"SELECT odds_source, count(*) AS n FROM {DRIFTING} WHERE period = 'recent' GROUP BY 1")
def _(t):
    rows, period = drifting(t)
    return ev.source_counts(rows, period, "odds_source")


REPORT = f"""(SELECT count(DISTINCT date) AS events, count(*) FILTER (WHERE stake > 0) AS bets, avg({ll('y', 'p_model')}) AS log_loss_model,
  avg({ll('y', 'p_line')}) AS log_loss_market, count(*) FILTER (WHERE stake > 0 AND p_close_line IS NOT NULL) AS clv_bets,
  avg(CAST((CASE WHEN pick_side = 'A' THEN p_close_line - p_line ELSE p_line - p_close_line END) > 0 AS DOUBLE)) FILTER (WHERE stake > 0) AS clv_rate FROM {{picks}})"""


def report(t):
    """One-row report; the intervals are attached as scalar sub-queries."""
    picks = t.stored("picks").withColumn("clv", ev.clv_points())
    active = F.col("stake") > 0
    roi = bs.cluster_ratio_ci(ev.event_rollup(picks), ["date"], draws=DRAWS)
    clv = bs.cluster_mean_ci(picks.filter(active & F.col("clv").isNotNull()), "date", "clv", draws=DRAWS)
    base = picks.agg(
        F.countDistinct("date").alias("events"), F.count_if(active).alias("bets"),
        F.avg(ev.log_loss_term("y", "p_model")).alias("log_loss_model"), F.avg(ev.log_loss_term("y", "p_line")).alias("log_loss_market"),
        F.count(F.when(active, F.col("clv"))).alias("clv_bets"),
        F.avg(F.when(active, (F.col("clv") > 0).cast("double"))).alias("clv_rate"))
    return base.withColumns({"roi_low": roi.select("ci_low").scalar(), "clv_low": clv.select("ci_low").scalar()})


_ROI_LOW = boot_sql(f"(SELECT * FROM {CARDS} WHERE staked > 0)", "pnl", "staked", "date")
_CLV_LOW = boot_sql("""(SELECT date, sum(clv) AS s, count(clv) AS k FROM (SELECT *, (CASE WHEN pick_side = 'A' THEN p_close_line - p_line ELSE p_line - p_close_line END) * 100 AS clv
  FROM {picks} WHERE stake > 0) WHERE clv IS NOT NULL GROUP BY date)""", "s", "k", "date")


@query("E22_promotion_gate", f"""
WITH r AS (SELECT *, (SELECT ci_low FROM ({_ROI_LOW})) AS roi_low, (SELECT ci_low FROM ({_CLV_LOW})) AS clv_low FROM {REPORT})
SELECT 'minimum_events' AS "check", events >= 50 AS passed, events * 1.0 AS observed, '>= 50' AS required FROM r
UNION ALL SELECT 'minimum_bets', bets >= 200, bets * 1.0, '>= 200' FROM r
UNION ALL SELECT 'positive_roi_interval', roi_low > 0, roi_low, '90% event-clustered ROI lower bound > 0' FROM r
UNION ALL SELECT 'model_beats_entry_market', log_loss_model < log_loss_market, log_loss_model - log_loss_market, 'model-minus-market log loss < 0' FROM r
UNION ALL SELECT 'minimum_active_clv_bets', clv_bets >= 200, clv_bets * 1.0, '>= 200' FROM r
UNION ALL SELECT 'positive_clv_interval', clv_low > 0, clv_low, '90% event-clustered mean CLV lower bound > 0' FROM r
UNION ALL SELECT 'positive_clv_rate', clv_rate > 0.55, clv_rate, '> 0.55' FROM r""".replace('"check"', "chk"), "observed")
def _(t):
    return ev.promotion_gate(report(t)).withColumnRenamed("check", "chk")


@query("E22_live_gate", f"""
WITH r AS (SELECT *, (SELECT ci_low FROM ({_ROI_LOW})) AS roi_low FROM {REPORT}),
g AS (SELECT events >= 50 AS p FROM r UNION ALL SELECT bets >= 200 FROM r UNION ALL SELECT roi_low > 0 FROM r)
SELECT CASE WHEN bool_and(p) THEN 'tiny_stakes_only' ELSE 'paper_only' END AS status, count(*) FILTER (WHERE p) AS passed_checks, count(*) AS checks FROM g""")
def _(t):
    return ev.verdict(ev.live_gate(report(t)), "tiny_stakes_only", "paper_only")


@query("E23_freshness", """
WITH d AS (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 12 HOUR AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01'))
SELECT CAST(max(l_shipdate) AS DATE) AS latest_result, (SELECT count(*) FROM d) AS n_missing, greatest(0, date_diff('day', CAST(max(l_shipdate) AS DATE), DATE '2000-01-01')) AS age_days,
  CASE WHEN (SELECT count(*) FROM d) > 0 THEN 'lagging' WHEN date_diff('day', CAST(max(l_shipdate) AS DATE), DATE '2000-01-01') > 21 THEN 'check' ELSE 'current' END AS status
FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01'""")
def _(t):
    import datetime as dt

    results = t.lineitem.filter("l_shipdate < TIMESTAMP_NTZ '2000-01-01'").select(
        F.col("l_orderkey").alias("k"), F.col("l_shipdate").cast("date").alias("d"))
    tracked = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("start"))
    out = ev.freshness(results, tracked, ["k"], "d", "start", dt.datetime(2000, 1, 1))
    return out.select("latest_result", "n_missing", "age_days", "status")


_POL = [("active_flat_1u_day_cap2", "1"), ("legacy_2u_at_8_day_cap2", "CASE WHEN net_edge >= CAST(0.08 AS DOUBLE) THEN 2 ELSE 1 END"),
        ("candidate_2u_at_10_day_cap2", "CASE WHEN net_edge >= CAST(0.1 AS DOUBLE) THEN 2 ELSE 1 END")]
POLICY = " UNION ALL ".join(
    f"""SELECT prediction_set, '{n}' AS policy, date, event_key, unit_pnl, CASE WHEN desired > 0 THEN least(desired, greatest(0, 2 - coalesce(sum(desired) OVER (PARTITION BY prediction_set, date ORDER BY net_edge DESC, event_key
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) ELSE 0 END AS stake FROM (SELECT *, CASE WHEN net_edge >= CAST(0.04 AS DOUBLE) THEN {d} ELSE 0 END AS desired FROM {{sets}})"""
    for n, d in _POL)
_POLICY_EVENTS = f"SELECT prediction_set, policy, date, count(*) FILTER (WHERE stake > 0) AS bets, CAST(sum(stake) AS DOUBLE) AS staked, sum(stake * unit_pnl) AS pnl FROM ({POLICY}) GROUP BY 1, 2, 3"
_POLICY_CI = grouped_boot("(SELECT * FROM c WHERE staked > 0)", "prediction_set, policy", "date", {"roi": ("pnl", "staked")})
_BUCKET_EVENTS = f"""SELECT prediction_set, {BUCKET} AS bucket, date, count(*) AS bets, sum(unit_pnl) AS pnl, count(clv) AS clv_bets, coalesce(sum(clv), 0) AS clv
FROM {{sets}} WHERE net_edge >= CAST(0.04 AS DOUBLE) GROUP BY 1, 2, 3"""


@query("E25_policy_comparison", f"""
WITH c AS ({_POLICY_EVENTS}), e AS (SELECT *, sum(pnl) OVER (PARTITION BY prediction_set, policy ORDER BY date) AS eq FROM c),
d AS (SELECT prediction_set, policy, max(pk - eq) AS dd FROM (SELECT *, max(eq) OVER (PARTITION BY prediction_set, policy ORDER BY date) AS pk FROM e) GROUP BY 1, 2)
SELECT prediction_set, policy, CAST(sum(bets) AS BIGINT) AS bets, sum(staked) AS staked, sum(pnl) AS pnl, sum(pnl) / sum(staked) AS roi, any_value(dd) AS max_drawdown,
  any_value(roi_low) AS roi_low, any_value(roi_high) AS roi_high
FROM c JOIN d USING (prediction_set, policy) JOIN {_POLICY_CI} USING (prediction_set, policy) GROUP BY 1, 2""", "staked pnl roi max_drawdown roi_low roi_high", 5)
def _(t):
    return ev.policy_report(t.sets, ["event_key"], by=["prediction_set"], draws=DRAWS)


@query("E25_edge_buckets_by_set", f"""
WITH c AS ({_BUCKET_EVENTS})
SELECT prediction_set, bucket, CAST(sum(bets) AS BIGINT) AS bets, sum(pnl) AS pnl, sum(pnl) / sum(bets) AS roi, CAST(sum(clv_bets) AS BIGINT) AS clv_bets,
  sum(clv) / nullif(sum(clv_bets), 0) AS mean_clv, any_value(roi_low) AS roi_low, any_value(roi_high) AS roi_high, any_value(clv_low) AS clv_low, any_value(clv_high) AS clv_high
FROM c JOIN {grouped_boot('c', 'prediction_set, bucket', 'date', _ROI_CLV)} USING (prediction_set, bucket) GROUP BY 1, 2""", "pnl roi mean_clv roi_low roi_high clv_low clv_high", 5)
def _(t):
    return ev.edge_bucket_report(t.sets, clv="clv", by=["prediction_set"], draws=DRAWS)


_BUCKET_CI = grouped_boot("b", "prediction_set, bucket", "date", _ROI_CLV)


@query("E22_staking_gate", f"""
WITH c AS ({_POLICY_EVENTS}), b AS ({_BUCKET_EVENTS}),
p AS (SELECT max(roi_low) FILTER (WHERE prediction_set = 'production') AS pp, max(roi_low) FILTER (WHERE prediction_set = 'entry') AS ep FROM {_POLICY_CI} WHERE policy = 'candidate_2u_at_10_day_cap2'),
i AS (SELECT max(roi_low) FILTER (WHERE prediction_set = 'production') AS pr, max(roi_low) FILTER (WHERE prediction_set = 'entry') AS er, max(clv_low) FILTER (WHERE prediction_set = 'entry') AS ec
  FROM {_BUCKET_CI} WHERE bucket = '10_plus'),
n AS (SELECT coalesce(sum(bets) FILTER (WHERE prediction_set = 'production'), 0) AS pb, coalesce(sum(bets) FILTER (WHERE prediction_set = 'entry'), 0) AS eb,
  coalesce(sum(clv_bets) FILTER (WHERE prediction_set = 'entry'), 0) AS cb FROM b WHERE bucket = '10_plus')
SELECT v.chk, coalesce(v.observed >= v.least AND (v.least > 0 OR v.observed > 0), false) AS passed, v.observed, v.required FROM p, i, n, (VALUES
  ('production_candidate_bets_at_least_100', CAST(pb AS DOUBLE), 100, '>= 100'), ('entry_candidate_bets_at_least_100', CAST(eb AS DOUBLE), 100, '>= 100'),
  ('entry_candidate_clv_bets_at_least_100', CAST(cb AS DOUBLE), 100, '>= 100'), ('production_candidate_roi_ci_lower_positive', pr, 0, '> 0'),
  ('entry_candidate_roi_ci_lower_positive', er, 0, '> 0'), ('production_candidate_policy_roi_ci_lower_positive', pp, 0, '> 0'),
  ('entry_candidate_policy_roi_ci_lower_positive', ep, 0, '> 0'), ('entry_candidate_clv_ci_lower_positive', ec, 0, '> 0')) v(chk, observed, least, required)""", "observed", 5)
def _(t):
    rows = t.stored("sets")
    buckets = ev.edge_bucket_report(rows, clv="clv", by=["prediction_set"], draws=DRAWS)
    policies = ev.policy_report(rows, ["event_key"], by=["prediction_set"], draws=DRAWS)
    return ev.staking_gate(ev.staking_report(buckets, policies)).withColumnRenamed("check", "chk")


_SN, _SP, _SW = two_sided_sql("e")


@query("E26_model_vs_line_summary", f"""
SELECT e AS min_edge, CAST(year(date) AS INTEGER) AS year, CAST(sum({_SN}) AS BIGINT) AS n_bets, CAST(sum({_SW}) AS BIGINT) AS wins, sum({_SP}) AS pnl, sum({_SP}) / sum({_SN}) AS roi
FROM {{scored}}, (VALUES (CAST(0.0 AS DOUBLE)), (CAST(0.05 AS DOUBLE)), (CAST(0.1 AS DOUBLE))) v(e) GROUP BY 1, 2 HAVING sum({_SN}) > 0""", "min_edge pnl roi", 5)
def _(t):
    return ev.edge_summary(t.scored.withColumn("year", F.year("date")), by=["year"])


@query("E26_line_summary", f"""
SELECT count(*) AS n, avg({ll('y', 'p_model')}) AS model_log_loss, avg({ll('y', 'p_line')}) AS line_log_loss, avg({ll('y', 'p_model')}) - avg({ll('y', 'p_line')}) AS log_loss_delta,
  avg(CAST(CAST(p_model >= 0.5 AS INTEGER) = y AS DOUBLE)) AS model_accuracy, avg(CAST(CAST(p_line >= 0.5 AS INTEGER) = y AS DOUBLE)) AS line_accuracy FROM {{scored}}""",
       "model_log_loss line_log_loss log_loss_delta model_accuracy line_accuracy")
def _(t):
    return ev.line_summary(t.scored)


_BETS = f"""(SELECT e AS min_edge, {_SP} AS pnl FROM {{scored}}, (VALUES (CAST(0.0 AS DOUBLE)), (CAST(0.05 AS DOUBLE)), (CAST(0.1 AS DOUBLE))) v(e) WHERE {_SN} > 0)"""


@query("E26_edge_intervals", f"""
WITH c AS {value_cells(_BETS, 'pnl', 'min_edge')}
SELECT min_edge, CAST(sum(n) AS BIGINT) AS n_bets, sum(total) AS pnl, sum(total) / sum(n) AS roi, any_value(roi_low) AS roi_low, any_value(roi_high) AS roi_high
FROM c JOIN (SELECT min_edge, quantile_cont(ratio, 0.05) AS roi_low, quantile_cont(ratio, 0.95) AS roi_high FROM {counted_boot('c', 'min_edge', 4000, 0)} GROUP BY 1) USING (min_edge)
GROUP BY 1 HAVING sum(n) >= 20""", "min_edge pnl roi roi_low roi_high", 5)
def _(t):
    return ev.edge_intervals(t.scored)


BL = " UNION ALL ".join(
    f"""SELECT CAST({w} AS DOUBLE) AS market_weight, date, event_key, y, odds_a, odds_b, pr_raw, pb_raw, CAST({w} AS DOUBLE) * p_line + (1 - CAST({w} AS DOUBLE)) * p_model AS p, (1 - CAST({w} AS DOUBLE)) * se AS se,
    p_line, CASE WHEN event_key % 4 <> 0 THEN p_line + ((event_key * 17) % 21 - 10) / CAST(400.0 AS DOUBLE) END AS p_close_line FROM {{scored}}"""
    for w in ("0.9", "0.75", "0.5"))


@query("I8_fixed_blends", f"""
WITH s AS (SELECT *, greatest(p - pr_raw, (1 - p) - pb_raw) - se AS net, CASE WHEN p - pr_raw >= (1 - p) - pb_raw THEN 'A' ELSE 'B' END AS side FROM ({BL})),
k AS (SELECT *, CASE WHEN net >= CAST(0.04 AS DOUBLE) AND row_number() OVER (PARTITION BY market_weight, date, net >= CAST(0.04 AS DOUBLE) ORDER BY net DESC, event_key) <= 2 THEN 1 ELSE 0 END AS stake FROM s),
v AS (SELECT *, CASE WHEN stake > 0 THEN ((CASE WHEN side = 'A' THEN p_close_line ELSE 1.0 - p_close_line END) - (CASE WHEN side = 'A' THEN p_line ELSE 1.0 - p_line END)) * 100.0 END AS up FROM k),
c AS (SELECT market_weight, date, count(*) AS n, sum({ll('y', 'p')}) AS ll, sum(pow(least(greatest(p, 0.001), 0.999) - y, 2)) AS br, sum(CAST(CAST(p >= 0.5 AS INTEGER) = y AS INTEGER)) AS hit,
  count(*) FILTER (WHERE stake > 0) AS bets, CAST(sum(stake) AS DOUBLE) AS staked,
  sum(stake * CASE WHEN (side = 'A') = (y = 1) THEN CASE WHEN side = 'A' THEN {profit('odds_a')} ELSE {profit('odds_b')} END ELSE -1.0 END) AS pnl,
  count(up) AS clv_bets, coalesce(sum(up), 0) AS clv, count(*) FILTER (WHERE up > 0) AS ups FROM v GROUP BY 1, 2)
SELECT market_weight, sum(ll) / sum(n) AS log_loss, sum(br) / sum(n) AS brier, sum(hit) / sum(n) AS accuracy, CAST(sum(bets) AS BIGINT) AS bets, sum(staked) AS staked, sum(pnl) AS pnl, sum(pnl) / sum(staked) AS roi,
  CAST(sum(clv_bets) AS BIGINT) AS clv_bets, sum(clv) / nullif(sum(clv_bets), 0) AS mean_clv, sum(ups) / nullif(sum(clv_bets), 0) AS positive_clv_rate,
  any_value(roi_low) AS roi_low, any_value(roi_high) AS roi_high, any_value(clv_low) AS clv_low, any_value(clv_high) AS clv_high,
  CAST(row_number() OVER (ORDER BY sum(ll) / sum(n), market_weight) AS INTEGER) AS rank
FROM c JOIN {grouped_boot('c', 'market_weight', 'date', {'roi': ('pnl', 'staked'), 'clv': ('clv', 'clv_bets')})} USING (market_weight) GROUP BY 1""",
       "market_weight log_loss brier accuracy staked pnl roi mean_clv positive_clv_rate roi_low roi_high clv_low clv_high", 5)
def _(t):
    close = F.col("p_line") + ((F.col("event_key") * 17) % 21 - 10) / 400.0
    rows = t.scored.withColumn("p_close_line", F.when(F.col("event_key") % 4 != 0, close))
    return ev.blend_report(rows, (0.9, 0.75, 0.5), ["event_key"], draws=DRAWS)
