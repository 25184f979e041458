"""Point-in-time histories and ratings."""

from pyspark.sql import functions as F

from duelmark.catalog.registry import query
from duelmark.operators import point_in_time as pit
from duelmark.operators.ratings import period_elo, pool_elo

W = "PARTITION BY entity ORDER BY time, seq"
P = f"{W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query("F1_prior_count", f"SELECT entity, seq, row_number() OVER ({W}) - 1 AS n_prior FROM {{history}}")
def _(t):
    return pit.point_in_time(t.history, "entity", "time", "seq", {"n_prior": pit.prior_count()}, "DAY").select(
        "entity", "seq", "n_prior")


@query("F2_point_in_time_history", f"""
SELECT entity, seq, row_number() OVER ({W}) - 1 AS n_prior, sum(value) OVER ({P}) AS prior_sum,
       avg(value) OVER ({P}) AS prior_mean, avg(value) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS last3_mean,
       lag(time) OVER ({W}) AS prev_time, max(CASE WHEN flag THEN time END) OVER ({P}) AS last_flag_time
FROM {{history}}""", "prior_sum prior_mean last3_mean", 4)
def _(t):
    h = t.history.withColumn("flag_time", F.when(F.col("flag"), F.col("time")))
    return pit.point_in_time(h, "entity", "time", "seq", {
        "n_prior": pit.prior_count(), "prior_sum": pit.prior_sum("value"), "prior_mean": pit.prior_mean("value"),
        "last3_mean": pit.last_mean("value", 3), "prev_time": pit.previous("time"),
        "last_flag_time": pit.prior_max("flag_time")}, "DAY").select(
        "entity", "seq", "n_prior", "prior_sum", "prior_mean", "last3_mean", "prev_time", "last_flag_time")


@query("F2_single_window_form", f"""
SELECT entity, seq, sum(value) OVER ({P}) AS prior_sum, avg(value) OVER ({P}) AS prior_mean FROM {{history}}""",
       "prior_sum prior_mean", 4)
def _(t):
    return pit.point_in_time(t.history, "entity", "time", "seq", {
        "prior_sum": pit.prior_sum("value"), "prior_mean": pit.prior_mean("value")}, None).select(
        "entity", "seq", "prior_sum", "prior_mean")


@query("F3_last_k_mean", f"""
SELECT entity, seq, avg(value) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS last3,
       avg(CAST(won AS DOUBLE)) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS last5_won FROM {{history}}""",
       "last3 last5_won")
def _(t):
    h = t.history.withColumn("won_n", F.col("won").cast("double"))
    return pit.point_in_time(h, "entity", "time", "seq", {
        "last3": pit.last_mean("value", 3), "last5_won": pit.last_mean("won_n", 5)}, "DAY").select(
        "entity", "seq", "last3", "last5_won")


@query("F4_previous_and_gap", f"""
SELECT entity, seq, lag(value) OVER ({W}) AS prev_value,
       date_diff('day', CAST(lag(time) OVER ({W}) AS DATE), CAST(time AS DATE)) AS days_since FROM {{history}}""")
def _(t):
    out = pit.point_in_time(t.history, "entity", "time", "seq", {
        "prev_value": pit.previous("value"), "prev_time": pit.previous("time")}, "DAY")
    return out.select("entity", "seq", "prev_value", F.datediff("time", "prev_time").alias("days_since"))


STREAK = f"""
SELECT entity, seq, i - 1 - coalesce(max(CASE WHEN NOT won THEN i END) OVER ({P}), 0) AS win_streak
FROM (SELECT *, row_number() OVER ({W}) AS i FROM {{history}})"""


@query("F5_win_streak", STREAK)
def _(t):
    return pit.point_in_time(t.history, "entity", "time", "seq", {"win_streak": pit.streak("won")}, "DAY").select(
        "entity", "seq", "win_streak")


@query("F5_win_streak_lag2", f"""
SELECT entity, seq, coalesce(lag(win_streak) OVER (PARTITION BY entity ORDER BY time, seq), 0) AS win_streak
FROM (SELECT s.*, h.time FROM ({STREAK}) s JOIN {{history}} h USING (entity, seq))""")
def _(t):
    s = pit.point_in_time(t.history, "entity", "time", "seq", {"streak1": pit.streak("won")}, "DAY")
    s = pit.point_in_time(s, "entity", "time", "seq", {"lagged": pit.previous("streak1")}, "DAY")
    return s.select("entity", "seq", F.coalesce("lagged", F.lit(0)).alias("win_streak"))


@query("F6_days_since_flag", f"""
SELECT entity, seq, date_diff('day', CAST(max(CASE WHEN flag THEN time END) OVER ({P}) AS DATE), CAST(time AS DATE))
       AS days_since_error FROM {{history}}""")
def _(t):
    return pit.days_since_flag(t.history, "entity", "time", "seq", "flag", "days_since_error", "DAY").select(
        "entity", "seq", "days_since_error")


def bout_long(t):
    """Long bout table with outcome flags; time is the exact start, seq breaks ties by side."""
    b = t.bouts.filter("a <> b")
    long = pit.two_sided_long(b, ["bout_id", "bout_date", "bout_ts", "winner", "method"], {
        "entity": ("a", "b"), "opponent": ("b", "a"), "made": ("stat_a", "stat_b"), "allowed": ("stat_b", "stat_a")})
    won = (F.col("winner") == F.col("side")).cast("double")
    lost = ((F.col("winner") != "draw") & (F.col("winner") != F.col("side"))).cast("double")
    finish = (F.upper("method").contains("KO") | F.upper("method").contains("SUB")).cast("double")
    return long.withColumns({"won": won, "lost": lost, "finish": finish, "minutes": F.col("made") / 50.0 + 1.0})


LONG = """(SELECT *, CAST(winner = side AS DOUBLE) AS won, CAST(winner <> 'draw' AND winner <> side AS DOUBLE) AS lost,
  CAST(method LIKE '%KO%' OR method LIKE '%SUB%' AS DOUBLE) AS finish, made / 50.0 + 1.0 AS minutes FROM (
  SELECT bout_id, bout_date, bout_ts, winner, method, 'A' AS side, 0 AS side_no, a AS entity, b AS opponent,
         stat_a AS made, stat_b AS allowed FROM {bouts} WHERE a <> b
  UNION ALL
  SELECT bout_id, bout_date, bout_ts, winner, method, 'B', 1, b, a, stat_b, stat_a FROM {bouts} WHERE a <> b))"""
WL = "PARTITION BY entity ORDER BY bout_ts, bout_id"
PL = f"{WL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query("F7_career_stats", f"""
SELECT bout_id, side, n AS career_fights, coalesce(w, 0.0) AS career_wins, coalesce(w / nullif(n, 0), 0.5) AS career_winrate,
       coalesce(m, 0.0) AS career_minutes, coalesce(f, 0.0) AS career_finish_rate,
       coalesce(s / nullif(m, 0), 0.0) AS career_made_pm, coalesce(al, 0.0) AS career_allowed_total,
       coalesce(s / nullif(al, 0), 0.0) AS career_accuracy,
       coalesce(date_diff('day', CAST(prev AS DATE), CAST(bout_ts AS DATE)), 365) AS days_since_last,
       i - 1 - coalesce(brk, 0) AS win_streak
FROM (SELECT *, row_number() OVER ({WL}) - 1 AS n, sum(won) OVER ({PL}) AS w, sum(minutes) OVER ({PL}) AS m,
             avg(finish) OVER ({PL}) AS f, sum(made) OVER ({PL}) AS s, sum(allowed) OVER ({PL}) AS al,
             lag(bout_ts) OVER ({WL}) AS prev, max(CASE WHEN won = 0 THEN i END) OVER ({PL}) AS brk
      FROM (SELECT *, row_number() OVER ({WL}) AS i FROM {LONG}))""",
       "career_wins career_winrate career_minutes career_finish_rate career_made_pm career_allowed_total career_accuracy", 5)
def _(t):
    long = bout_long(t)
    out = pit.career_stats(long, "entity", "bout_ts", "bout_id", "won", "finish", "minutes",
                           rate_stats=("made",), total_stats=("allowed",), accuracy=("made", "allowed"), chunk="DAY")
    return out.select("bout_id", "side", "career_fights", "career_wins", "career_winrate", "career_minutes",
                      "career_finish_rate", "career_made_pm", "career_allowed_total", "career_accuracy",
                      "days_since_last", "win_streak")


@query("F8_opponent_adjusted", f"""
WITH p AS (SELECT *, avg(made) OVER ({PL}) AS c_made, avg(allowed) OVER ({PL}) AS c_allowed FROM {LONG}),
d AS (SELECT p.*, p.made - o.c_allowed AS adj_out, p.allowed - o.c_made AS adj_def
      FROM p JOIN p o ON o.bout_id = p.bout_id AND o.side <> p.side)
SELECT bout_id, side, adj_out, adj_def, avg(adj_out) OVER ({PL}) AS c_adj_out, avg(adj_def) OVER ({PL}) AS c_adj_def FROM d""",
       "adj_out adj_def c_adj_out c_adj_def")
def _(t):
    out = pit.opponent_adjusted(bout_long(t), "bout_id", "entity", "bout_ts", "bout_id", "made", "allowed", "DAY")
    return out.select("bout_id", "side", "adj_out", "adj_def", "c_adj_out", "c_adj_def")


@query("F9_method_rates", f"""
WITH r AS (SELECT bout_id, side,
  coalesce(avg(won * CAST(method LIKE '%KO%' AS DOUBLE)) OVER ({PL}), 0.0) AS ko_w,
  coalesce(avg(lost * CAST(method LIKE '%SUB%' AS DOUBLE)) OVER ({PL}), 0.0) AS sub_l,
  row_number() OVER ({WL}) - 1 AS n_pre FROM {LONG})
SELECT bout_id, max(CASE WHEN side='A' THEN ko_w END) AS ko_w_a, max(CASE WHEN side='B' THEN ko_w END) AS ko_w_b,
       max(CASE WHEN side='A' THEN sub_l END) AS sub_l_a, max(CASE WHEN side='B' THEN sub_l END) AS sub_l_b,
       max(CASE WHEN side='A' THEN n_pre END) AS n_pre_a, max(CASE WHEN side='B' THEN n_pre END) AS n_pre_b
FROM r GROUP BY bout_id""", "ko_w_a ko_w_b sub_l_a sub_l_b")
def _(t):
    return method_rates(t).select("bout_id", "ko_w_a", "ko_w_b", "sub_l_a", "sub_l_b", "n_pre_a", "n_pre_b")


def method_rates(t):
    """Prior method rates per side, back on the contest row."""
    from duelmark.functions import method_class

    cls = method_class("method")
    long = bout_long(t)
    long = long.withColumns({f"{m.lower()}_{tag}1": F.col(w) * (cls == m).cast("double")
                             for m in ("KO", "SUB", "DEC") for tag, w in (("w", "won"), ("l", "lost"))})
    names = ["ko_w", "sub_w", "dec_w", "ko_l", "sub_l"]
    out = pit.point_in_time(long, "entity", "bout_ts", "bout_id",
                            {**{n: pit.prior_mean(f"{n}1") for n in names}, "n_pre": pit.prior_count()}, "DAY")
    out = out.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})
    return pit.to_wide(out, ["bout_id", "bout_ts", "winner", "method"], [*names, "n_pre"])


@query("E6_class_z_whole_table", """
SELECT bout_id, (stat_a - avg(stat_a) OVER (PARTITION BY method)) / nullif(stddev_samp(stat_a) OVER (PARTITION BY method), 0)
       AS z FROM {bouts}""", "z", 5)
def _(t):
    return pit.class_z(t.bouts, "method", "stat_a", "z").select("bout_id", "z")


@query("E6_class_z_point_in_time", """
SELECT bout_id, (stat_a - avg(stat_a) OVER w) / nullif(stddev_samp(stat_a) OVER w, 0) AS z FROM {bouts}
WINDOW w AS (PARTITION BY method ORDER BY bout_ts, bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "z", 4)
def _(t):
    return pit.class_z_point_in_time(t.bouts, "method", "bout_ts", "bout_id", "stat_a", "z").select("bout_id", "z")


def _elo_sql(periods: int = 5) -> str:
    """Rating periods unrolled: ratings before each week from the week before."""
    ctes = [f"""b AS (SELECT bout_id, date_diff('week', TIMESTAMP '2024-01-01', date_trunc('week', bout_ts)) AS p, a, b,
      CASE winner WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.0 ELSE 0.5 END AS s,
      32.0 + CASE WHEN method LIKE '%KO%' OR method LIKE '%SUB%' THEN 8.0 ELSE 0.0 END AS k FROM {{bouts}} WHERE a <> b)""",
            "r0 AS (SELECT DISTINCT e AS entity, CAST(1500.0 AS DOUBLE) AS rating FROM (SELECT a AS e FROM b UNION SELECT b FROM b))"]
    for n in range(periods):
        ctes.append(f"""x{n} AS (SELECT b.*, ra.rating AS elo_a_pre, rb.rating AS elo_b_pre,
      b.k * (b.s - 1.0 / (1.0 + pow(10.0, (rb.rating - ra.rating) / 400.0))) AS d
      FROM b JOIN r{n} ra ON ra.entity = b.a JOIN r{n} rb ON rb.entity = b.b WHERE b.p = {n})""")
        ctes.append(f"""r{n + 1} AS (SELECT r.entity, r.rating + coalesce(m.d, 0.0) AS rating FROM r{n} r LEFT JOIN
      (SELECT e, sum(d) AS d FROM (SELECT a AS e, d FROM x{n} UNION ALL SELECT b, -d FROM x{n}) GROUP BY e) m ON m.e = r.entity)""")
    union = " UNION ALL ".join(f"SELECT bout_id, elo_a_pre, elo_b_pre, elo_a_pre - elo_b_pre AS elo_diff FROM x{n}"
                               for n in range(periods))
    return f"WITH {', '.join(ctes)} {union}"


@query("F10_elo_rating_periods", _elo_sql(), "elo_a_pre elo_b_pre elo_diff")
def _(t):
    b = t.bouts.filter("a <> b").withColumn("week", F.date_trunc("week", "bout_ts").cast("date"))
    out, _ratings = period_elo(b, "bout_id", "week", "a", "b", "winner", "method")
    return out.select("bout_id", "elo_a_pre", "elo_b_pre", "elo_diff")


@query("F10_elo_sequential_pools")
def _(t):
    b = t.bouts.filter("a <> b").withColumn("ladder", F.date_trunc("hour", "bout_ts"))
    out = pool_elo(b, "ladder", "bout_ts", "bout_id", "bout_id", "a", "b", "winner", "method")
    return out.select("bout_id", F.round("elo_a_pre", 6).alias("elo_a_pre"), F.round("elo_b_pre", 6).alias("elo_b_pre"),
                      F.round("elo_diff", 6).alias("elo_diff"))
