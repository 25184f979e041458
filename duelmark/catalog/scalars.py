"""Column functions over text and numbers derived from the given tables."""

from pyspark.sql import functions as F

from duelmark.catalog.fixtures import imp
from duelmark.catalog.registry import query
from duelmark import functions as fn
from duelmark.functions import parsing, timing
from duelmark.functions.ids import event_seed_of_set
from duelmark.operators import betting, quotes as qt
from duelmark.settings import DIVISION_LIMITS, NAME_ALIASES, PROP_TERMS


def _s(c):
    return F.col(c).cast("string")


@query("B1_x_of_y", """
SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 40 AS DOUBLE) END AS landed,
       CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 40 + o_custkey % 10 AS DOUBLE) END AS attempted FROM orders""")
def _(t):
    text = F.when(F.col("o_orderkey") % 13 == 0, "---").otherwise(
        F.concat(F.lit(" "), (F.col("o_orderkey") % 40).cast("string"), F.lit(" of "),
                 (F.col("o_orderkey") % 40 + F.col("o_custkey") % 10).cast("string")))
    landed, attempted = fn.x_of_y(text)
    return t.orders.select("o_orderkey", landed.alias("landed"), attempted.alias("attempted"))


@query("B2_clock_seconds", """
SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 300 AS DOUBLE) END AS seconds FROM orders""")
def _(t):
    s = F.col("o_orderkey") % 300
    text = F.when(F.col("o_orderkey") % 11 == 0, "--").otherwise(
        F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0")))
    return t.orders.select("o_orderkey", fn.clock_seconds(text).alias("seconds"))


@query("B3_body_measures", """
SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN CAST((5 + c_custkey % 2) * 12 + c_custkey % 12 AS DOUBLE) END AS height,
       CAST(60 + c_custkey % 25 AS DOUBLE) AS reach, CAST(115 + c_custkey % 150 AS DOUBLE) AS weight FROM customer""")
def _(t):
    k = F.col("c_custkey")
    height = F.when(k % 9 == 0, "--").otherwise(
        F.concat((5 + k % 2).cast("string"), F.lit("' "), (k % 12).cast("string"), F.lit('"')))
    reach = F.concat((60 + k % 25).cast("string"), F.lit('"'))
    weight = F.concat((115 + k % 150).cast("string"), F.lit(" lbs."))
    return t.customer.select("c_custkey", fn.height_inches(height).alias("height"),
                             fn.leading_number(reach).alias("reach"),
                             fn.leading_number(weight, anywhere=True).alias("weight"))


@query("B4_duration_minutes", """
SELECT o_orderkey, (o_orderkey % 5) * 5 + (o_orderkey % 300) / 60.0 AS minutes FROM orders""", "minutes")
def _(t):
    s = F.col("o_orderkey") % 300
    text = F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    return t.orders.select("o_orderkey", fn.duration_minutes(F.col("o_orderkey") % 5 + 1, text).alias("minutes"))


@query("B5_split_sides", """
SELECT c_custkey, c_name AS side_a, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment || ' vs. x' END AS side_b FROM customer""")
def _(t):
    sep = F.when(F.col("c_custkey") % 2 == 0, " vs. ").otherwise("  vs ")
    text = F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")).otherwise(
        F.concat("c_name", sep, "c_mktsegment", F.lit(" vs. x")))
    a, b = fn.split_sides(text)
    return t.customer.select("c_custkey", a.alias("side_a"), b.alias("side_b"))


@query("B6_outcome_side", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'draw' END END
       AS winner FROM orders""")
def _(t):
    code = (F.when(F.col("o_orderstatus") == "F", "W/L").when(F.col("o_orderstatus") == "O", " L/W ")
            .otherwise(F.when(F.col("o_orderkey") % 2 == 0, "D/D").otherwise("NC/NC")))
    return t.orders.select("o_orderkey", fn.outcome_side(code).alias("winner"))


@query("B7_norm_name", r"""
SELECT doc_id, trim(regexp_replace(replace(replace(lower(strip_accents(text)), '.', ''), '-', ' '), '\s+', ' ', 'g'))
       AS norm FROM documents""")
def _(t):
    return t.documents.select("doc_id", fn.norm_name("text").alias("norm"))


_ALIAS = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(NAME_ALIASES.values()))


@query("B8_alias_map", f"""
SELECT c_custkey, CASE c_custkey % 7 {_ALIAS} ELSE lower(c_mktsegment) END AS name FROM customer""")
def _(t):
    raw = F.lower("c_mktsegment")
    for i, k in enumerate(NAME_ALIASES):
        raw = F.when(F.col("c_custkey") % 7 == i, k).otherwise(raw)
    return t.customer.select("c_custkey", fn.alias_of(raw).alias("name"))


@query("B9_id_from_url", r"""
SELECT page_id, regexp_extract(url, '/([0-9]+)(?:[?#].*)?$', 1) AS id,
       CASE WHEN page_id % 3 = 0 THEN lower(printf('%x', page_id)) ELSE '' END AS profile_id FROM pages""")
def _(t):
    profile = F.when(F.col("page_id") % 3 == 0,
                     F.concat(F.lit("http://x.example/Fighter-Details/"), F.hex("page_id"))).otherwise(F.col("url"))
    return t.pages.select("page_id", fn.id_from_url("url", r"/([0-9]+)(?:[?#].*)?$").alias("id"),
                          fn.id_from_url(profile).alias("profile_id"))


_DIV = " ".join(f"WHEN label LIKE '%{k}%' THEN {v}" for k, v in DIVISION_LIMITS)
_LABELS = [*[k for k, _ in DIVISION_LIMITS], "catch weight"]


@query("B10_division_limit", f"""
SELECT c_custkey, CAST(CASE {_DIV} END AS DOUBLE) AS weight_limit FROM (
SELECT c_custkey, [{', '.join(repr(x) for x in _LABELS)}][c_custkey % {len(_LABELS)} + 1] AS label FROM customer)""")
def _(t):
    label = F.get(F.array(*[F.lit(x.title()) for x in _LABELS]), (F.col("c_custkey") % len(_LABELS)).cast("int"))
    text = F.concat("c_mktsegment", F.lit(" Women's "), label, F.lit(" Bout"))
    return t.customer.select("c_custkey", fn.division_limit(text).alias("weight_limit"))


@query("B11_entity_key", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'name:' || lower(c_name) END AS entity,
       'unresolved:' || lower(c_name) AS unresolved FROM customer""")
def _(t):
    ident = F.when(F.col("c_custkey") % 3 == 0, _s("c_custkey")).when(F.col("c_custkey") % 3 == 1, "  ")
    name = fn.norm_name("c_name")
    return t.customer.select("c_custkey", fn.entity_key(ident, name).alias("entity"),
                             fn.unresolved_key(name).alias("unresolved"))


Q = ["event_key", "book_key", "line", "part"]
QS = "event_key, book_key, line, part"


@query("B12_implied_probability", f"SELECT {QS}, {imp('odds_a')} AS pa, {imp('odds_b')} AS pb FROM {{quotes}}", "pa pb")
def _(t):
    return t.quotes.select(*Q, fn.implied_prob("odds_a").alias("pa"), fn.implied_prob("odds_b").alias("pb"))


@query("B13_unit_profit", f"""
SELECT {QS}, CASE WHEN odds_a < 0 THEN 100.0 / -odds_a ELSE odds_a / 100.0 END AS profit FROM {{quotes}}""", "profit")
def _(t):
    return t.quotes.select(*Q, fn.unit_profit("odds_a").alias("profit"))


@query("B14_devig_overround", f"""
SELECT {QS}, {imp('odds_a')} / ({imp('odds_a')} + {imp('odds_b')}) AS fair_a,
       {imp('odds_a')} + {imp('odds_b')} - 1.0 AS vig FROM {{quotes}}""", "fair_a vig")
def _(t):
    return t.quotes.select(*Q, fn.devig("odds_a", "odds_b").alias("fair_a"), fn.overround("odds_a", "odds_b").alias("vig"))


_P = "((event_key * 7919) % 1000) / CAST(1000.0 AS DOUBLE)"


@query("B15_fair_american", f"""
SELECT event_key, CAST(round_even(CASE WHEN p >= 0.5 THEN -100.0 * p / (1.0 - p) ELSE 100.0 * (1.0 - p) / p END, 0) AS BIGINT) AS fair
FROM (SELECT event_key, least(greatest({_P}, CAST(0.005 AS DOUBLE)), CAST(0.995 AS DOUBLE)) AS p FROM {{consensus}})""")
def _(t):
    return t.consensus.select("event_key", fn.fair_american(((F.col("event_key") * 7919) % 1000) / 1000.0).alias("fair"))


@query("B16_execution_ladder", """
SELECT event_key, tier, CAST(ceil(CASE WHEN q >= 0.5 THEN -100.0 * q / (1.0 - q) ELSE 100.0 * (1.0 - q) / q END) AS BIGINT) AS worst_price
FROM (SELECT event_key, tier, p_model - se - threshold AS q FROM {scored},
      (VALUES ('1u', CAST(0.04 AS DOUBLE)), ('2u_candidate', CAST(0.10 AS DOUBLE))) v(tier, threshold))
WHERE q BETWEEN CAST(0.02 AS DOUBLE) AND CAST(0.98 AS DOUBLE)""")
def _(t):
    return betting.execution_ladder(t.scored, "p_model", "se").select("event_key", "tier", "worst_price")


@query("B17_market_probability", f"""
SELECT {QS}, CASE WHEN s > 0 AND s < 1 THEN s ELSE {imp('odds_a')} / ({imp('odds_a')} + {imp('odds_b')}) END AS p_market
FROM (SELECT *, CASE WHEN event_key % 3 = 0 THEN lead_hours / 60.0 END AS s FROM {{quotes}})""", "p_market")
def _(t):
    s = F.when(F.col("event_key") % 3 == 0, F.col("lead_hours") / 60.0)
    return t.quotes.select(*Q, fn.market_probability("odds_a", "odds_b", s).alias("p_market"))


@query("B18_clipped_logit", """
SELECT event_key, ln(q / (1 - q)) AS line_logit, abs(ln(q / (1 - q))) AS line_abs
FROM (SELECT event_key, least(greatest(p_line, 0.02), 0.98) AS q FROM {scored})""", "line_logit line_abs")
def _(t):
    z = fn.clipped_logit("p_line")
    return t.scored.select("event_key", z.alias("line_logit"), F.abs(z).alias("line_abs"))


@query("B19_quote_age_and_lead", f"""
SELECT {QS}, greatest(0, date_diff('minute', snapshot_ts, commence_time)) * 1.0 AS age_minutes,
       date_diff('hour', snapshot_ts, commence_time) * 1.0 AS lead FROM {{quotes}}""", "age_minutes lead")
def _(t):
    return t.quotes.select(*Q, fn.quote_age_minutes("snapshot_ts", "commence_time").alias("age_minutes"),
                           fn.lead_hours("snapshot_ts", "commence_time").alias("lead"))


@query("B20_scheduled_start", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 3 HOUR WHEN o_orderkey % 3 = 1
       THEN o_orderdate + INTERVAL 20 HOUR ELSE o_orderdate END AS start,
       CASE WHEN o_orderkey % 3 = 2 THEN 'date_only' ELSE 'exact' END AS precision FROM orders""")
def _(t):
    k = F.col("o_orderkey") % 3
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    exact = F.when(k == 0, F.concat(day, F.lit("T03:00:00Z"))).otherwise(" ")
    commence = F.when(k == 1, F.concat(day, F.lit("T20:00:00Z")))
    return t.orders.select("o_orderkey", fn.scheduled_start("o_orderdate", exact, commence).cast("timestamp_ntz").alias("start"),
                           fn.start_precision("o_orderdate", exact, commence).alias("precision"))


@query("B21_hash_ids", """
SELECT o_orderkey, substr(sha256(strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderpriority), 1, 20) AS event_uid,
       substr(sha256(strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderpriority || '|' || printf('%.2f', o_totalprice)), 1, 20)
       AS snapshot_id FROM orders""")
def _(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    price = F.format_string("%.2f", "o_totalprice")
    return t.orders.select("o_orderkey", fn.hash_id(day, "o_orderpriority").alias("event_uid"),
                           fn.hash_id(day, "o_orderpriority", price).alias("snapshot_id"))


@query("B22_event_seed", """
SELECT o_orderkey, ('0x' || substr(sha256('production|' || strftime(o_orderdate, '%Y-%m-%d')), 1, 8))::BIGINT AS seed,
       ('0x' || substr(sha256('production|' || least(o_orderpriority, o_orderstatus) || '|' ||
                              greatest(o_orderpriority, o_orderstatus)), 1, 8))::BIGINT AS set_seed FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", fn.event_seed(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("seed"),
                           event_seed_of_set(F.array("o_orderstatus", "o_orderpriority")).alias("set_seed"))


@query("B23_pair_key", """
SELECT bout_id, least(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) || '|' || greatest(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) AS pair
FROM {bouts}""")
def _(t):
    return t.bouts.select("bout_id", fn.pair_key("a", "b").alias("pair"))


@query("B24_method_class", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'KO' WHEN 'purchase' THEN 'SUB' WHEN 'click' THEN 'DEC' ELSE 'OTHER' END AS cls
FROM events""")
def _(t):
    text = (F.when(F.col("event_type") == "error", "tko (sub attempt)").when(F.col("event_type") == "purchase", "Submission")
            .when(F.col("event_type") == "click", "Decision - Split"))
    return t.events.select("event_id", fn.method_class(text).alias("cls"))


@query("B25_bout_flags", """
SELECT c_custkey, CAST(c_custkey % 2 = 0 AS DOUBLE) AS five_rd, CAST(c_custkey % 3 < 2 AS DOUBLE) AS heavy,
       CAST(c_custkey % 5 = 0 AS DOUBLE) AS women FROM customer""")
def _(t):
    k = F.col("c_custkey")
    fmt = F.when(k % 2 == 0, "5 Rnd (5-5-5-5-5)").otherwise("3 Rnd (5-5-5)")
    div = F.concat(F.when(k % 5 == 0, "Women's ").otherwise(""),
                   F.when(k % 3 == 0, "Heavyweight").when(k % 3 == 1, "Light HEAVYWEIGHT").otherwise("Flyweight"))
    return t.customer.select("c_custkey", parsing.five_round_flag(fmt).alias("five_rd"),
                             parsing.heavy_flag(div).alias("heavy"), parsing.women_flag(div).alias("women"))


@query("B26_differentials", """
SELECT bout_id, stat_a - stat_b AS stat_diff, age_a - age_b AS age_diff, age_a * stat_a / 100 - age_b * stat_b / 100 AS agemile_diff,
       (age_a - age_b) * (stat_a - stat_b) / 365.0 AS age_x_off,
       CASE WHEN stat_a - stat_b <> 0 AND abs(stat_a - stat_b) < 365 THEN sign(stat_a - stat_b) ELSE 0 END AS ko_recent
FROM (SELECT *, date_diff('day', DATE '1990-01-01' + CAST(a AS INTEGER), bout_date) / 365.25 AS age_a,
             date_diff('day', DATE '1990-01-01' + CAST(b AS INTEGER), bout_date) / 365.25 AS age_b FROM {bouts})""",
       "stat_diff age_diff agemile_diff age_x_off ko_recent")
def _(t):
    from duelmark.plans.features import differentials

    b = t.bouts.withColumns({f"born_{s}": F.date_add(F.lit("1990-01-01").cast("date"), F.col(s).cast("int")) for s in "ab"})
    b = b.withColumns({f"age_{s}": timing.age_years(f"born_{s}", "bout_date") for s in "ab"})
    out = differentials(b, ["stat", "age"])
    return out.select("bout_id", "stat_diff", "age_diff",
                      (F.col("age_a") * F.col("stat_a") / 100 - F.col("age_b") * F.col("stat_b") / 100).alias("agemile_diff"),
                      (F.col("age_diff") * F.col("stat_diff") / 365.0).alias("age_x_off"),
                      F.when((F.col("stat_diff") != 0) & (F.abs("stat_diff") < 365), F.signum("stat_diff"))
                      .otherwise(0.0).alias("ko_recent"))


@query("B27_orientation", """
SELECT bout_id, CASE WHEN a <= b THEN stat_a ELSE stat_b END AS stat_a, CASE WHEN a <= b THEN stat_b ELSE stat_a END AS stat_b,
       CASE WHEN a <= b THEN stat_a / 500.0 ELSE 1 - stat_a / 500.0 END AS p,
       CASE WHEN a <= b THEN stat_a - stat_b ELSE -(stat_a - stat_b) END AS diff FROM {bouts}""", "p diff")
def _(t):
    b = t.bouts.withColumns({"p": F.col("stat_a") / 500.0, "diff": F.col("stat_a") - F.col("stat_b")})
    out = qt.orient(b, F.col("a") <= F.col("b"), [("stat_a", "stat_b")], ["p"], ["diff"])
    return out.select("bout_id", "stat_a", "stat_b", "p", "diff")


@query("B28_rates_and_shares", """
SELECT bout_id, stat_a / nullif(m, 0) AS lpm, stat_b / nullif(m, 0) AS apm, stat_a / nullif(stat_a + stat_b, 0) AS acc,
       1 - stat_b / nullif(m, 0) AS tdd, stat_a / 60 / nullif(m, 0) AS ctrl_pm
FROM (SELECT *, CAST(bout_id % 6 AS DOUBLE) AS m FROM {bouts})""", "lpm apm acc tdd ctrl_pm")
def _(t):
    from duelmark.plans.features import per_minute, share

    b = t.bouts.withColumn("m", (F.col("bout_id") % 6).cast("double"))
    return b.select("bout_id", per_minute("stat_a", "m").alias("lpm"), per_minute("stat_b", "m").alias("apm"),
                    share("stat_a", F.col("stat_a") + F.col("stat_b")).alias("acc"),
                    (1 - per_minute("stat_b", "m")).alias("tdd"), per_minute(F.col("stat_a") / 60, "m").alias("ctrl_pm"))


@query("B29_weekly_calendar", """
SELECT d + CASE WHEN isodow(d) = 3 THEN INTERVAL 14 HOUR ELSE INTERVAL 20 HOUR END AS stamp
FROM (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS TIMESTAMP) AS d FROM orders)
WHERE isodow(d) IN (3, 6)""")
def _(t):
    from duelmark.plans.refresh import weekly_stamps

    return weekly_stamps(t.orders, "o_orderdate").select(F.col("stamp").cast("timestamp_ntz").alias("stamp"))


@query("B30_eligibility", """
SELECT event_key, (n_books >= 4 OR n_books IS NULL) AND (age IS NULL OR age <= 360 OR src <> 'the-odds-api-x') AS quality_ok,
       CASE WHEN net_edge >= CAST(0.04 AS DOUBLE) AND n_books >= 4 AND NOT (age > 360 AND src = 'the-odds-api-x') THEN 'eligible'
            WHEN age > 360 AND src = 'the-odds-api-x' THEN 'price stale' WHEN n_books < 4 THEN 'fewer than 4 paired books'
            ELSE 'below edge rule' END AS reason
FROM (SELECT *, (event_key % 500) * 1.0 AS age, CASE WHEN event_key % 2 = 0 THEN 'the-odds-api-x' ELSE 'manual' END AS src FROM {edges})""")
def _(t):
    e = betting.score_picks(t.scored).withColumns({
        "age": (F.col("event_key") % 500).cast("double"),
        "src": F.when(F.col("event_key") % 2 == 0, "the-odds-api-x").otherwise("manual")})
    out = betting.eligibility(e, books="n_books", age="age", source="src", min_books=4)
    return out.select("event_key", "quality_ok", F.col("eligibility_reason").alias("reason"))


@query("B31_price_text", f"""
SELECT {QS}, printf('%+d', CAST(odds_a AS BIGINT)) AS price_text, CASE WHEN event_key % 2 = 0 THEN 'TBD' ELSE CAST(event_key AS VARCHAR) END AS meta
FROM {{quotes}}""")
def _(t):
    meta = F.when(F.col("event_key") % 4 == 0, "  ").when(F.col("event_key") % 2 != 0, F.concat(F.lit(" "), _s("event_key")))
    return t.quotes.select(*Q, fn.signed_price("odds_a").alias("price_text"), fn.clean_text(meta, "TBD").alias("meta"))


_HIT = " OR ".join(f"lower(k) LIKE '%{x}%'" for x in PROP_TERMS)


@query("B32_market_key_filter", f"""
SELECT user_id, coalesce(array_to_string(list_sort(list(DISTINCT k) FILTER (WHERE {_HIT})), ','), '') AS market_keys
FROM (SELECT user_id, CASE event_type WHEN 'error' THEN 'fight_method' WHEN 'click' THEN 'h2h' WHEN 'view' THEN 'total_Rounds'
      ELSE 'spreads' END AS k FROM events) GROUP BY user_id""")
def _(t):
    k = (F.when(F.col("event_type") == "error", "fight_method").when(F.col("event_type") == "click", "h2h")
         .when(F.col("event_type") == "view", "total_Rounds").otherwise("spreads"))
    # de-duplicate first: a payload lists each market key of a book once
    keys = t.events.select("user_id", k.alias("k")).distinct().groupBy("user_id").agg(F.collect_set("k").alias("ks"))
    payload = keys.select("user_id", F.struct(F.array(F.struct(F.transform(
        "ks", lambda x: F.struct(x.alias("key"))).alias("markets"))).alias("bookmakers")).alias("event"))
    out = qt.market_keys(payload, ["user_id"], PROP_TERMS)
    return out.withColumn("market_keys", F.array_join("market_keys", ","))


@query("B33_manifest_status", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'invalid_snapshot_time' WHEN o_custkey % 3 = 0 THEN 'no_match'
       WHEN o_custkey % 5 > 0 THEN 'ok' ELSE 'no_quotes' END AS status FROM orders""")
def _(t):
    o = t.orders.withColumns({
        "snap": F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate")).otherwise(F.col("o_orderdate") - F.expr("INTERVAL 1 HOUR")),
        "matched": F.col("o_custkey") % 3, "rows": F.col("o_custkey") % 5})
    return o.select("o_orderkey", qt.manifest_status("snap", "o_orderdate", "matched", "rows").alias("status"))
