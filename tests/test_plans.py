import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from duelmark.functions import norm_name, pair_key
from duelmark.operators.quality import assert_clean, audit_bouts
from duelmark.plans import audit, features as ft, refresh as rf

URL = "http://stats.example/fighter-details/"


@pytest.fixture(scope="module")
def raw(spark):
    events = spark.createDataFrame([("Card", "Jan 01, 2025"), ("Card", "Jan 01, 2025")], "EVENT string, DATE string")
    results = spark.createDataFrame([
        (0, "Card ", "Sam Twin vs. Fly Opp", "W/L", "DEC", "3", "5:00", "3 Rnd (5-5-5)", "Flyweight Bout"),
        (1, "Card", "Mid Opp vs. Sam Twin", "L/W", "KO/TKO", "1", "2:00", "3 Rnd (5-5-5)", "Middleweight Bout"),
        (2, "Card", "Mid Opp vs. Fly Opp", "NC/NC", "Overturned", "1", "2:00", "3 Rnd (5-5-5)", "Middleweight Bout")],
        "row int, EVENT string, BOUT string, OUTCOME string, METHOD string, ROUND string, TIME string, `TIME FORMAT` string, WEIGHTCLASS string")
    stats = spark.createDataFrame([("Card", b, f, s, t) for b, f, s, t in (
        ("Sam Twin vs. Fly Opp", "Sam Twin", "12 of 20", "1 of 2"), ("Sam Twin vs. Fly Opp", "Sam Twin", "8 of 20", "0 of 0"),
        ("Sam Twin vs. Fly Opp", "Fly Opp", "10 of 30", "0 of 1"), ("Mid Opp vs. Sam Twin", "Mid Opp", "5 of 12", "0 of 0"),
        ("Mid Opp vs. Sam Twin", "Sam Twin", "18 of 25", "---"))], "EVENT string, BOUT string, FIGHTER string, `SIG.STR.` string, TD string")
    registry = spark.createDataFrame([
        ("Sam Twin", "5' 4\"", "125 lbs.", "65\"", "Orthodox", "Mar 16, 1990", URL + "aaaa"), ("Sam Twin", "6' 0\"", "185 lbs.", "74\"", "Orthodox", "Jul 13, 1989", URL + "bbbb"),
        ("Fly Opp", "5' 7\"", "125 lbs.", "67\"", "Southpaw", "Jan 01, 1991", URL + "cccc"), ("Mid Opp", "6' 1\"", "185 lbs.", "--", "", "Jan 01, 1990", URL + "dddd")],
        "FIGHTER string, HEIGHT string, WEIGHT string, REACH string, STANCE string, DOB string, URL string")
    details = spark.createDataFrame([("Sam", "Twin", "", URL + "aaaa"), ("Sam", "Twin", "", URL + "bbbb"), ("New", "Person", "", URL + "eeee")],
                                    "FIRST string, LAST string, NICKNAME string, URL string")
    return events, results, stats, registry, details


def test_build_bouts(spark, raw):
    rows = {r.weightclass: r for r in rf.build_bouts(*raw, seq="row").collect()}
    assert set(rows) == {"Flyweight Bout", "Middleweight Bout"}
    fly, mid = rows["Flyweight Bout"], rows["Middleweight Bout"]
    assert (fly.fighter_a_id, fly.height_a, fly.sig_str_landed_a, fly.sig_str_absorbed_a, fly.td_attempted_a) == ("aaaa", 64.0, 20.0, 10.0, 2.0)
    assert (mid.fighter_b_id, mid.height_b, mid.sig_str_landed_b, mid.td_landed_b) == ("bbbb", 72.0, 18.0, 0.0)
    assert (fly.winner, mid.winner, fly.fight_time_min, mid.fight_time_min) == ("A", "B", 15.0, 2.0)
    assert (mid.reach_a, mid.stance_a, str(fly.dob_b), str(fly.date)) == (None, None, "1991-01-01", "2025-01-01")
    df = rf.build_bouts(*raw)
    named = df.withColumns({"name_a": norm_name("fighter_a"), "name_b": norm_name("fighter_b"), "pair": pair_key("fighter_a_id", "fighter_b_id")})
    assert_clean(audit_bouts(named, "date", "fighter_a_id", "fighter_b_id", url_a="fighter_a_url", url_b="fighter_b_url"))


def test_unknown_people_fail_or_are_marked(spark, raw):
    events, results, stats, registry, _ = raw
    less = registry.filter("FIGHTER <> 'Fly Opp'")
    with pytest.raises(ValueError, match="identity not resolved"):
        rf.build_bouts(events, results, stats, less)
    marked = rf.build_bouts(events, results, stats, less, strict=False).filter("weightclass = 'Flyweight Bout'").first()
    assert (marked.fighter_b_id, marked.fighter_b_url, marked.height_b) == ("unresolved:fly opp", "", None)


def test_refresh_swaps_only_clean_tables(spark, raw):
    from duelmark.session import scratch_path

    path = scratch_path(spark, "bouts")
    df = rf.build_bouts(*raw)
    rf.refresh(path, df)
    with pytest.raises(ValueError, match="rows_shrank=1"):
        rf.refresh(path, df.filter("weightclass = 'Flyweight Bout'"))
    from duelmark.sources.append import read_current

    assert read_current(spark, path).count() == 2


def random_bouts(n=60, seed=1):
    rng = random.Random(seed)
    bouts, rounds = [], []
    for i in range(n):
        a, b = rng.sample(range(8), 2)
        day = dt.date(2023, 1, 1) + dt.timedelta(days=i * 6)
        bout = f"P{a} vs. P{b}"
        bouts.append((i, day, f"Ev{i}", bout, rng.choice(["3 Rnd (5-5-5)", "5 Rnd (5-5-5-5-5)"]), rng.choice(["Heavyweight", "Flyweight"]),
                      rng.choice(["Southpaw", "Orthodox", None]), "Orthodox", f"P{a}", f"P{b}", rng.choice(["A", "B", "draw"]),
                      rng.choice(["KO/TKO", "SUB", "DEC"]), f"id{a}", f"id{b}", "", "", rng.choice([None, 5.0, 12.5, 15.0]),
                      dt.date(1990, 1, 1 + a), dt.date(1990, 1, 1 + b), 70.0 + a, 70.0 + b, 170.0 + a, 170.0 + b, *[None] * 8))
        for name in (f"P{a}", f"P{b}"):
            for r in range(1, rng.choice([1, 3, 4]) + 1):
                x = rng.randrange(1, 30)
                rounds.append((f"Ev{i}", bout, name, f"Round {r}", str(rng.randrange(2)), f"{x} of {x + 9}", "1 of 2", "1", f"{x // 2} of {x}", f"{x // 3} of {x}", "1:05"))
    return bouts, rounds


BOUT_SCHEMA = ("fight_id int, date date, event string, bout string, time_format string, weightclass string, stance_a string, stance_b string, fighter_a string, "
               "fighter_b string, winner string, method string, fighter_a_id string, fighter_b_id string, fighter_a_url string, fighter_b_url string, "
               "fight_time_min double, dob_a date, dob_b date, reach_a double, reach_b double, height_a double, height_b double, sig_str_landed_a double, "
               "sig_str_landed_b double, sig_str_absorbed_a double, sig_str_absorbed_b double, td_landed_a double, td_landed_b double, td_attempted_a double, td_attempted_b double")
ROUND_SCHEMA = "EVENT string, BOUT string, FIGHTER string, ROUND string, KD string, `SIG.STR.` string, TD string, `SUB.ATT` string, HEAD string, DISTANCE string, CTRL string"


def build(spark, bouts, rounds, **kw):
    stats = ft.round_stats(spark.createDataFrame(rounds, ROUND_SCHEMA))
    return ft.feature_table(spark.createDataFrame(bouts, BOUT_SCHEMA), stats, **kw)


def test_features_match_a_plain_loop(spark):
    bouts, rounds = random_bouts()
    table, columns = build(spark, bouts, rounds)
    got = {r.fight_id: r for r in table.collect()}
    assert set(got) == {b[0] for b in bouts if b[10] != "draw"} and len(columns) == len(set(columns))
    landed, fade = {}, {}
    for ev, _, who, rnd, *_rest in rounds:
        landed.setdefault((ev, who), []).append(int(_rest[1].split(" of ")[0]))
    for k, v in landed.items():
        fade[k] = (sum(v[2:]) / len(v[2:]) - v[0]) if len(v) >= 3 else None
    past, want = {}, {}

    def mean(xs):
        xs = [x for x in xs if x is not None]
        return sum(xs) / len(xs) if xs else None

    for b in bouts:
        row, sides = {}, []
        for me, other, s in ((b[8], b[9], "A"), (b[9], b[8], "B")):
            h = past.setdefault(me, [])
            ko = [x["date"] for x in h if x["ko_loss"]]
            sides.append({"c_lpm": mean([x["lpm"] for x in h]), "c_won": mean([x["won"] for x in h]), "c_fade": mean([x["fade"] for x in h]),
                          "r3_lpm": mean([x["lpm"] for x in h[-3:]]), "c_fights": float(len(h)), "c_ko_loss_n": sum(x["ko_loss"] for x in h) if h else None,
                          "days_off": (b[1] - h[-1]["date"]).days if h else None, "days_since_ko": (b[1] - ko[-1]).days if ko else None,
                          "c_apm": mean([x["apm"] for x in h]), "c_adj_out": mean([x["adj_out"] for x in h])})
        for k in sides[0]:
            x, y = sides[0][k], sides[1][k]
            row[k + "_diff"] = 0.0 if x is None or y is None else x - y
        want[b[0]] = row
        for n, (me, other, s) in enumerate(((b[8], b[9], "A"), (b[9], b[8], "B"))):
            t = b[16] or None
            rate = lambda who: sum(landed[(b[2], who)]) / t if t else None
            lpm, foe = rate(me), sides[1 - n]["c_apm"]
            past[me].append({"date": b[1], "won": float(b[10] == s), "lpm": lpm, "apm": rate(other), "fade": fade[(b[2], me)],
                             "ko_loss": float(b[10] in "AB" and b[10] != s and b[11] == "KO/TKO"),
                             "adj_out": lpm - foe if lpm is not None and foe is not None else None})
    for i, r in got.items():
        for k, v in want[i].items():
            assert abs(r[k] - v) < 1e-9, (i, k, r[k], v)


def test_flipping_a_winner_cannot_change_its_own_features(spark):
    bouts, rounds = random_bouts(30)
    last = [b for b in bouts if b[10] != "draw"][-1][0]
    flip = [tuple({"A": "B", "B": "A"}.get(v, v) if i == 10 and b[0] == last else v for i, v in enumerate(b)) for b in bouts]
    a, cols = build(spark, bouts, rounds)
    b, _ = build(spark, flip, rounds)
    x, y = a.filter(F.col("fight_id") <= last).orderBy("fight_id").collect(), b.filter(F.col("fight_id") <= last).orderBy("fight_id").collect()
    assert [[r[c] for c in cols] for r in x] == [[r[c] for c in cols] for r in y]
    assert x[-1].target != y[-1].target


def test_matched_table_moves_to_the_price_frame(spark):
    bouts, rounds = random_bouts(30)
    table, cols = build(spark, bouts, rounds)
    odds = table.select("date", pair_key(F.lower("fighter_a"), F.lower("fighter_b")).alias("pair"), F.lower("fighter_b").alias("key_r"),
                        F.lit(-150.0).alias("odds_a"), F.lit(130.0).alias("odds_b"), F.col("fight_id").alias("n"))
    m = audit.matched_table(table, odds, cols, ["n"], ft.BOUT_FLAGS)
    j = m.alias("m").join(table.alias("t"), "fight_id").select(
        (F.col("m.y") + F.col("t.target")).alias("s"), (F.col("m.c_lpm_diff") + F.col("t.c_lpm_diff")).alias("d"),
        (F.col("m.heavy_bout") - F.col("t.heavy_bout")).alias("h"), "m.p_line").collect()
    assert len(j) == table.count() and all(r.s == 1 and r.d == 0 and r.h == 0 and 0.5 < r.p_line < 0.6 for r in j)


def scored_rows(n=160, seed=9):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        d1 = rng.uniform(-1, 1)
        y = int(rng.random() < 0.5 + 0.3 * d1)
        out.append((i, dt.date(2024, 1, 1) + dt.timedelta(days=i // 4), rng.uniform(-1, 1), d1, y, rng.choice([-150.0, 120.0, 200.0]), rng.choice([-130.0, 110.0])))
    return out


def test_walk_forward_audit_and_candidates(spark):
    from duelmark.functions.pricing import implied_prob

    df = spark.createDataFrame(scored_rows(), "row_key long, date date, line_logit double, d1 double, y int, odds_a double, odds_b double")
    df = df.withColumns({"line_abs": F.abs("line_logit"), "p_line": 1 / (1 + F.exp(-F.col("line_logit"))),
                         "pr_raw": implied_prob("odds_a"), "pb_raw": implied_prob("odds_b")})
    feats, flip = ["line_logit", "line_abs", "d1"], ["line_logit", "d1"]
    folds = [dt.date(2024, 1, 15), dt.date(2024, 1, 29)]
    out = audit.walk_forward_audit(df, feats, flip, folds, ["row_key"], n_models=3, min_train=20).persist()
    rows = out.collect()
    assert len(rows) == df.filter("date >= DATE '2024-01-15'").count()
    per_day = {}
    for r in rows:
        per_day[r.date] = per_day.get(r.date, 0) + r.stake
        assert r.stake == 0 or r.net_edge >= 0.04
        won = (r.y == 1) == (r.pick_side == "A")
        o = r.odds_a if r.pick_side == "A" else r.odds_b
        want = 0.0 if not r.stake else (r.stake * (100 / -o if o < 0 else o / 100) if won else -float(r.stake))
        assert abs(r.pnl - want) < 1e-12
    assert max(per_day.values()) <= 2 and sum(per_day.values()) > 0
    # the model candidate repeats the audit; the market against itself never bets on fair prices
    base = out.withColumnsRenamed({"p_model": "p_c", "se": "s_c"}).drop("edge", "net_edge", "pick_side", "qualified", "desired", "stake", "pnl")
    base = base.withColumns({"zero": F.lit(0.0)})
    got = audit.candidate_report(base.withColumn("p_m", F.col("p_line")), {"current": ("p_c", "s_c"), "market": ("p_m", "zero")}, ["row_key"]).collect()
    rep = {r.candidate: r for r in got}
    assert abs(rep["current"].pnl - sum(r.pnl for r in rows)) < 1e-9 and rep["current"].bets == sum(r.stake > 0 for r in rows)
    assert abs(rep["market"].log_loss - rep["market"].log_loss_market) < 1e-12
    out.unpersist()


def test_card_respects_quality_and_cap(spark):
    from duelmark.operators import models as ml
    from duelmark.plans.card import score_card

    table = ml.model_table(spark, [ml.Fitted(ml.Spec(tag=0), 0.0, [1.0], [1.0], 1.0, 1)])
    rows = [(i, dt.date(2030, 1, 1), 1.5, 150.0, -170.0, books, age, "the-odds-api-x") for i, (books, age) in enumerate(
        ((5, 10.0), (5, 10.0), (5, 10.0), (2, 10.0), (5, 999.0), (None, None)))]
    df = spark.createDataFrame(rows, "id int, date date, f double, odds_a double, odds_b double, market_books int, quote_age_minutes double, odds_source string")
    df = df.withColumns({"pr_raw": F.lit(0.4), "pb_raw": F.lit(0.63)})
    got = {r.id: (r.stake, r.eligibility_reason) for r in score_card(df, table, ["f"], ["f"], ["id"]).collect()}
    assert got == {0: (1, "eligible"), 1: (1, "eligible"), 2: (0, "event-day exposure cap"), 3: (0, "fewer than 3 paired books"),
                   4: (0, "price stale"), 5: (0, "event-day exposure cap")}
