"""Feature table plan: two-sided bout table to differentials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duelmark.functions._col import col


def per_minute(value, minutes) -> Column:
    """Rate per minute; NULL for zero minutes."""
    return F.try_divide(col(value), F.nullif(col(minutes).cast("double"), F.lit(0.0)))


def share(part, whole) -> Column:
    return F.try_divide(col(part), F.nullif(col(whole).cast("double"), F.lit(0.0)))


def differentials(df: DataFrame, stems: list[str]) -> DataFrame:
    """Add ``<stem>_diff`` = side A minus side B."""
    return df.withColumns({f"{s}_diff": F.col(f"{s}_a") - F.col(f"{s}_b") for s in stems})


def round_totals(rounds: DataFrame, keys: list[str], round_no: str, sums: list[str],
                 fade_of: str | None = None, late: int = 3) -> DataFrame:
    """Per contest and entity: totals (0 when all values are missing) and the last round.

    ``fade`` is the mean per late round minus the first round, NULL without late rounds. A
    pre-aggregation per round makes the distinct-round count an ordinary count, so
    everything runs in two map-side combined aggregations.
    """
    per_round = rounds.groupBy(*keys, round_no).agg(*[F.sum(c).alias(c) for c in sums])
    aggs = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums] + [F.max(round_no).alias("n_rounds")]
    if fade_of:
        is_late = F.col(round_no) >= late
        aggs += [F.count_if(is_late).alias("late_rounds"),
                 F.sum(F.when(is_late, F.coalesce(F.col(fade_of), F.lit(0)))).alias("_late"),
                 F.sum(F.when(F.col(round_no) == 1, F.coalesce(F.col(fade_of), F.lit(0)))).alias("_first")]
    out = per_round.groupBy(*keys).agg(*aggs)
    if fade_of:
        out = out.withColumn("fade", F.try_divide("_late", "late_rounds") - F.col("_first")).drop("_late", "_first")
    return out


def winner_frame(wide: DataFrame, winner_side: Column) -> DataFrame:
    """Method-model features seen from ``winner_side`` ('A' or 'B')."""
    df = wide.withColumn("_w", winner_side)

    def of(stem, winner=True):
        first, second = (f"{stem}_a", f"{stem}_b") if winner else (f"{stem}_b", f"{stem}_a")
        return F.coalesce(F.when(F.col("_w") == "A", F.col(first)).otherwise(F.col(second)).cast("double"), F.lit(0.0))

    cols = {"w_ko_rate": of("ko_w"), "w_sub_rate": of("sub_w"), "w_dec_rate": of("dec_w"), "w_n": of("n_pre"),
            "l_ko_l": of("ko_l", False), "l_sub_l": of("sub_l", False)}
    if {"age_a", "age_b"} <= set(wide.columns):
        cols |= {"l_age": of("age", False), "w_age": of("age")}
    return df.withColumns(cols).drop("_w")


RATE_MEANS = ("lpm", "apm", "acc", "head_share", "dist_share", "kd_pm", "kdd_pm", "ctrl_pm", "ctrld_pm", "sub_pm",
              "fade", "tdd", "won", "ko_win", "is_5rd")
BOUT_FLAGS = ("heavy_bout", "five_rd_bout")


def round_stats(rounds: DataFrame) -> DataFrame:
    """Raw per-round text statistics to totals per (event, bout, fighter)."""
    from duelmark.functions import clock_seconds, x_of_y

    sig, td = x_of_y("`SIG.STR.`"), x_of_y("TD")
    typed = rounds.select(
        F.trim("EVENT").alias("event"), F.trim("BOUT").alias("bout"), F.trim("FIGHTER").alias("fighter_name"),
        F.regexp_extract("ROUND", r"(\d+)", 1).try_cast("int").alias("round_no"),
        sig[0].alias("sig_l"), sig[1].alias("sig_a"), x_of_y("HEAD")[0].alias("head_l"), x_of_y("DISTANCE")[0].alias("dist_l"),
        td[0].alias("td_l"), td[1].alias("td_a"), F.col("KD").try_cast("double").alias("kd"),
        F.col("`SUB.ATT`").try_cast("double").alias("sub_att"), clock_seconds("CTRL").alias("ctrl_s"))
    return round_totals(typed, ["event", "bout", "fighter_name"], "round_no",
                        ["sig_l", "sig_a", "head_l", "dist_l", "td_l", "td_a", "kd", "sub_att", "ctrl_s"], fade_of="sig_l")


def feature_table(bouts: DataFrame, stats: DataFrame, contest: str = "fight_id", ratings: DataFrame | None = None,
                  chunk: str = "YEAR", point_in_time_reach: bool = True) -> tuple[DataFrame, list[str]]:
    """Bout table and round totals to side differentials known before each contest.

    ``bouts`` has ``BOUT_COLUMNS`` and a unique ``contest`` id in source order. ``ratings``
    holds elo_fast_a/b and elo_slow_a/b per contest (see ``elo_features``). Draws are
    dropped at the end; missing differentials become 0. Returns (table, feature columns).
    """
    from duelmark.functions import entity_key, norm_name
    from duelmark.functions.parsing import five_round_flag, heavy_flag
    from duelmark.functions.timing import age_years
    from duelmark.operators import point_in_time as pit

    b = bouts.withColumns({f"key_{s}": entity_key(f"fighter_{s}_id", norm_name(f"fighter_{s}")) for s in "ab"})
    b = b.withColumn("is_5rd", five_round_flag("time_format"))
    long = pit.two_sided_long(
        b, [contest, "date", "event", "bout", "winner", "method", "is_5rd", F.col("fight_time_min").alias("t_min")],
        {"entity": ("key_a", "key_b"), "fighter_name": ("fighter_a", "fighter_b"), "opponent_name": ("fighter_b", "fighter_a")})
    ko, sub = F.upper("method").contains("KO"), F.upper("method").contains("SUB")
    won = F.col("winner") == F.col("side")
    lost = F.col("winner").isin("A", "B") & ~won
    long = long.withColumns({"won": won.cast("double"), "ko_win": (won & ko).cast("double"),
                             "ko_loss": (lost & ko).cast("double"), "sub_loss": (lost & sub).cast("double")})
    # same-day contests: side A rows first, then source order
    long = long.withColumn("_seq", F.struct("side_no", contest))
    rival = stats.select("event", "bout", F.col("fighter_name").alias("opponent_name"),
                         *[F.col(c).alias(f"opp_{c}") for c in ("sig_l", "kd", "ctrl_s", "td_l")])
    long = (long.join(stats, ["event", "bout", "fighter_name"], "left")
            .join(rival, ["event", "bout", "opponent_name"], "left"))
    long = long.withColumns({
        "lpm": per_minute("sig_l", "t_min"), "apm": per_minute("opp_sig_l", "t_min"), "acc": share("sig_l", "sig_a"),
        "head_share": share("head_l", "sig_l"), "dist_share": share("dist_l", "sig_l"), "kd_pm": per_minute("kd", "t_min"),
        "kdd_pm": per_minute("opp_kd", "t_min"), "ctrl_pm": per_minute(F.col("ctrl_s") / 60, "t_min"),
        "ctrld_pm": per_minute(F.col("opp_ctrl_s") / 60, "t_min"), "sub_pm": per_minute("sub_att", "t_min"),
        "tdd": 1 - per_minute("opp_td_l", "t_min"), "_ko_date": F.when(F.col("ko_loss") == 1, F.col("date"))})
    keep = [contest, "side", "entity", "date", "_seq", "t_min", "ko_loss", "sub_loss", "_ko_date", *RATE_MEANS]
    features = {
        **{f"c_{c}": pit.prior_mean(c) for c in RATE_MEANS},
        "c_ko_loss_n": pit.prior_sum("ko_loss"), "c_sub_loss_n": pit.prior_sum("sub_loss"),
        **{f"r3_{c}": pit.last_mean(c, 3) for c in ("won", "lpm", "kdd_pm")},
        "c_fights": pit.prior_count(), "c_minutes": pit.prior_sum("t_min"), "_prev": pit.previous("date"),
        "off_ko": pit.previous("ko_loss"), "_last_ko": pit.prior_max("_ko_date")}
    long = pit.point_in_time(long.select(*keep), "entity", "date", "_seq", features, chunk)
    long = long.withColumns({"days_off": F.datediff("date", "_prev"), "days_since_ko": F.datediff("date", "_last_ko")})
    long = pit.opponent_adjusted(long, contest, "entity", "date", "_seq", "lpm", "apm", chunk, priors=("c_lpm", "c_apm"))
    per_side = [*[f for f in features if not f.startswith("_")], "days_off", "days_since_ko", "c_adj_out", "c_adj_def"]
    wide = pit.to_wide(long, [contest], per_side)

    df = b.join(wide, contest)
    df = df.withColumns({f"age_{s}": age_years(f"dob_{s}", "date") for s in "ab"})
    df = df.withColumns({f"agemile_{s}": F.col(f"age_{s}") * F.coalesce(F.col(f"c_minutes_{s}"), F.lit(0.0)) / 100 for s in "ab"})
    df = df.withColumns({f"southpaw_{s}": F.coalesce(F.col(f"stance_{s}") == "Southpaw", F.lit(False)).cast("double") for s in "ab"})
    stems = ["agemile", *per_side, "age", "reach", "height"]
    if ratings is not None:
        df = df.join(ratings, contest, "left")
        stems = ["elo_fast", "elo_slow", *stems]
    df = differentials(df, stems).filter(F.col("winner").isin("A", "B"))
    df = df.withColumns({"stance_edge": F.col("southpaw_a") - F.col("southpaw_b"), "target": (F.col("winner") == "A").cast("int"),
                         "heavy_bout": heavy_flag("weightclass"), "five_rd_bout": five_round_flag("time_format")})
    columns = [*[f"{s}_diff" for s in stems], "stance_edge"]
    df = df.fillna(0, subset=columns)
    sides = pit.two_sided_long(df, [contest, "date", "weightclass"], {"reach": ("reach_a", "reach_b")})
    if point_in_time_reach:
        z = pit.class_z_point_in_time(sides.withColumn("_seq", F.struct("side_no", contest)), "weightclass", "date", "_seq", "reach", "reach_z")
    else:
        z = pit.class_z(sides, "weightclass", "reach", "reach_z")
    z = pit.to_wide(z, [contest], ["reach_z"])
    df = df.join(z, contest)
    gap = F.col("days_since_ko_diff")
    df = df.withColumns({
        "reach_z_diff": F.coalesce(F.col("reach_z_a") - F.col("reach_z_b"), F.lit(0.0)),
        "age_x_off": F.col("age_diff") * F.col("days_off_diff") / 365.0,
        "ko_recent": F.when((gap != 0) & (F.abs(gap) < 365), F.signum(gap.cast("double"))).otherwise(0.0)})
    columns += ["reach_z_diff", "age_x_off", "ko_recent", *BOUT_FLAGS]
    identity = ["fighter_a", "fighter_b", "fighter_a_id", "fighter_b_id", "fighter_a_url", "fighter_b_url"]
    return df.select(contest, "date", *identity, "target", *columns), columns


def elo_features(bouts: DataFrame, contest: str = "fight_id", period: str = "date", a: str = "fighter_a_id",
                 b: str = "fighter_b_id") -> DataFrame:
    """Fast (K=64) and slow (K=20) ratings before each contest, frozen within ``period``."""
    from duelmark.operators.ratings import period_elo

    out = None
    for tag, k in (("fast", 64.0), ("slow", 20.0)):
        rated, _ = period_elo(bouts, contest, period, a, b, "winner", "method", k=k)
        part = rated.select(contest, F.col("elo_a_pre").alias(f"elo_{tag}_a"), F.col("elo_b_pre").alias(f"elo_{tag}_b"))
        out = part if out is None else out.join(part, contest)
    return out
