"""Refresh plan: landed files to the bout table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def weekly_stamps(df: DataFrame, time: str) -> DataFrame:
    """Every Wednesday 14:00 and Saturday 20:00 between the first and last day of ``time``."""
    span = df.agg(F.min(F.col(time).cast("date")).alias("lo"), F.max(F.col(time).cast("date")).alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day"))
    hour = F.when(F.dayofweek("day") == 4, 14).when(F.dayofweek("day") == 7, 20)
    out = days.withColumn("hour", hour).filter("hour IS NOT NULL")
    return out.select((F.col("day").cast("timestamp") + F.make_dt_interval(F.lit(0), "hour", F.lit(0), F.lit(0))).alias("stamp"))


def build_bouts(events: DataFrame, results: DataFrame, rounds: DataFrame, registry: DataFrame,
                details: DataFrame | None = None, strict: bool = True, seq: str | None = None) -> DataFrame:
    """Raw tables to the two-sided bout table.

    events: EVENT, DATE. results: EVENT, BOUT, OUTCOME, METHOD, ROUND, TIME, TIME FORMAT,
    WEIGHTCLASS. rounds: EVENT, BOUT, FIGHTER, SIG.STR., TD. registry: FIGHTER, HEIGHT,
    WEIGHT, REACH, STANCE, DOB, URL. details: FIRST, LAST, URL. ``seq`` is the source order
    of the results (contests of one day keep it); without it event and bout text order them.
    """
    from duelmark.checks import require_columns
    from duelmark.functions import (alias_of, clean_text, duration_minutes, height_inches, id_from_url, leading_number,
                                    norm_name, outcome_side, parse_date, split_sides, x_of_y)
    from duelmark.operators.joins import build_registry, lookup, resolve_or_mark
    from duelmark.operators.keys import keep_first
    from duelmark.sources.files import trim_strings

    events, results, rounds, registry = (trim_strings(d) for d in (events, results, rounds, registry))
    require_columns(registry, ["FIGHTER", "URL"], "registry")

    days = keep_first(events.select("EVENT", parse_date("DATE").alias("date")), ["EVENT"], ["date"])
    side_a, side_b = split_sides("BOUT")
    bouts = results.join(days, "EVENT", "left").select(
        *([seq] if seq else []), "date", F.col("EVENT").alias("event"), F.col("BOUT").alias("bout"),
        side_a.alias("fighter_a"), side_b.alias("fighter_b"), outcome_side("OUTCOME").alias("winner"),
        F.coalesce("METHOD", F.lit("")).alias("method"), duration_minutes("ROUND", "TIME").alias("fight_time_min"),
        F.coalesce("`TIME FORMAT`", F.lit("")).alias("time_format"), F.coalesce("WEIGHTCLASS", F.lit("")).alias("weightclass"))
    bouts = bouts.dropna(subset=["date", "winner", "fighter_a", "fighter_b"])

    landed, _ = x_of_y("`SIG.STR.`")
    td_landed, td_tried = x_of_y("TD")
    totals = rounds.groupBy(F.col("EVENT").alias("event"), F.col("BOUT").alias("bout"), F.col("FIGHTER").alias("fighter")).agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in (
            ("sig_str_landed", landed), ("td_landed", td_landed), ("td_attempted", td_tried))])
    for s in "ab":
        own = totals.select("event", "bout", F.col("fighter").alias(f"fighter_{s}"),
                            *[F.col(c).alias(f"{c}_{s}") for c in ("sig_str_landed", "td_landed", "td_attempted")])
        # unique by construction (it is an aggregation on these keys)
        bouts = lookup(bouts, own, ["event", "bout", f"fighter_{s}"], validate=False)
    bouts = bouts.withColumns({"sig_str_absorbed_a": F.col("sig_str_landed_b"), "sig_str_absorbed_b": F.col("sig_str_landed_a")})

    base = registry.withColumn("_src", F.lit(0))
    more = base.limit(0)
    if details is not None:
        d = trim_strings(details)
        require_columns(d, ["FIRST", "LAST", "URL"], "details")
        more = d.select(F.trim(F.concat_ws(" ", "FIRST", "LAST")).alias("FIGHTER"), "URL", F.lit(1).alias("_src"))
    people = build_registry(base, more, "FIGHTER", "URL", id_from_url("URL"), norm_name("FIGHTER"),
                            leading_number("WEIGHT", anywhere=True), "_src")
    for s in "ab":
        bouts = bouts.withColumn("_name", alias_of(norm_name(f"fighter_{s}")))
        bouts = resolve_or_mark(bouts, people, "_name", "weightclass", strict=strict)
        bouts = bouts.withColumnRenamed("entity_id", f"fighter_{s}_id").drop("_name", "resolution")
    physical = keep_first(people, ["entity_id"], ["_src", "name_key"]).select(
        "entity_id", F.col("URL").alias("url"), height_inches("HEIGHT").alias("height"), leading_number("REACH").alias("reach"),
        parse_date("DOB").alias("dob"), clean_text("STANCE").alias("stance"))
    for s in "ab":
        side = physical.select(F.col("entity_id").alias(f"fighter_{s}_id"),
                               *[F.col(c).alias(f"{n}_{s}{t}") for c, n, t in (
                                   ("height", "height", ""), ("reach", "reach", ""), ("dob", "dob", ""), ("stance", "stance", ""),
                                   ("url", "fighter", "_url"))])
        bouts = lookup(bouts, side, [f"fighter_{s}_id"], validate=False)
    bouts = bouts.withColumns({f"fighter_{s}_url": F.coalesce(f"fighter_{s}_url", F.lit("")) for s in "ab"})
    return bouts.select(*([seq] if seq else []), *BOUT_COLUMNS)


# --- fixed values: column order of the bout table ---
BOUT_COLUMNS = (
    "date", "event", "bout", "time_format", "weightclass", "stance_a", "stance_b", "fighter_a", "fighter_b", "winner",
    "method", "fighter_a_id", "fighter_b_id", "fighter_a_url", "fighter_b_url", "fight_time_min", "dob_a", "dob_b",
    "reach_a", "reach_b", "height_a", "height_b", "sig_str_landed_a", "sig_str_landed_b", "sig_str_absorbed_a",
    "sig_str_absorbed_b", "td_landed_a", "td_landed_b", "td_attempted_a", "td_attempted_b",
)


def refresh(target: str, bouts: DataFrame, date: str = "date") -> None:
    """A new version of the bout table, if the audit and the regression gate are clean; ``read_current`` reads it."""
    from duelmark.functions import norm_name, pair_key
    from duelmark.operators.quality import audit_bouts, refresh_regressions
    from duelmark.sources.append import current_version, read_current, staged_replace

    spark = bouts.sparkSession
    previous = read_current(spark, target) if current_version(spark, target) else None

    def gates(staged: DataFrame):
        named = staged.withColumns({"name_a": norm_name("fighter_a"), "name_b": norm_name("fighter_b"),
                                    "pair": pair_key("fighter_a_id", "fighter_b_id")})
        out = [audit_bouts(named, date, "fighter_a_id", "fighter_b_id", url_a="fighter_a_url", url_b="fighter_b_url")]
        if previous is not None:
            out.append(refresh_regressions(previous, staged, date, ["fighter_a_id", "fighter_b_id"]))
        return out

    staged_replace(bouts, target, gates)
