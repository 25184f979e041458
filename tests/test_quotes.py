import json
import statistics

from pyspark.sql import functions as F

from duelmark.operators import quotes as qt


def prob(o):
    return -o / (-o + 100) if o < 0 else 100 / (o + 100)


# per book: price of the home side, price of the away side
BOARD = {"north": (-118, 102), "south": (-240, 195), "east": (-175, 160), "west": (-132, 121), "harbour": (-410, 330)}


def payload(spark, events=("m7",)):
    def market(home, away):
        return {"key": "h2h", "outcomes": [{"name": n, "price": p} for n, p in (("Reds", home), ("Blues", away)) if p is not None]}

    books = [{"key": k, "title": k.title(), "markets": [{"key": "totals", "outcomes": []}, market(*v)]} for k, v in BOARD.items()]
    books.append({"key": "half", "markets": [market(-205, None)]})
    books.append({"key": "second-try", "markets": [market(40, 60), market(-150, 125)]})
    bodies = [json.dumps([{"id": e, "commence_time": "2031-05-04T18:00:00Z", "home_team": "Reds", "away_team": "Blues", "bookmakers": part}])
              for e in events for part in (books[:3], books[3:])]
    return spark.createDataFrame([(b,) for b in bodies], "body string")


def test_live_consensus_hand_values(spark):
    rows = qt.explode_paired_quotes(qt.parse_payload(payload(spark), "body"))
    # two payloads of one event: positions repeat, and every book is kept
    assert sorted(r.book_key for r in rows.collect()) == sorted([*BOARD, "second-try"])
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    prices = [*BOARD.values(), (-150, 125)]
    r = qt.live_consensus(rows, ["event_id"], "book_pos").collect()[0]
    fair = [prob(a) / (prob(a) + prob(b)) for a, b in prices]
    assert (r.odds_a, r.odds_b, r.market_books) == (sorted(a for a, _ in prices)[3], sorted(b for _, b in prices)[3], 6)
    assert (r.best_odds_a, r.best_book_a, r.best_odds_b, r.best_book_b) == (-118, "North", 330, "Harbour")
    assert abs(r.market_prob_a - statistics.median(fair)) < 1e-8 and r.market_spread > 0


def test_archive_keeps_prices_as_delivered(spark):
    rows = qt.archive_quotes(qt.parse_payload(payload(spark), "body"))
    assert sorted(r.book_key for r in rows.collect()) == sorted([*BOARD, "second-try", "second-try"])


def test_a_payload_holds_up_to_100_books_of_an_event(spark):
    from types import SimpleNamespace

    from duelmark.catalog import sources

    # event 1 has seven books far apart, event 2 has 250 books
    rows = [(1, 4001 * b) for b in range(7)] + [(2, 3 * b) for b in range(250)]
    clean = (spark.createDataFrame(rows, "event_key long, book_key long")
             .selectExpr("*", "timestamp_ntz'2031-05-04 18:00:00' commence_time", "timestamp_ntz'2031-05-03 18:00:00' snapshot_ts",
                         "-150.0D odds_a", "130.0D odds_b", "2 line"))
    bodies = sources.payload(SimpleNamespace(clean=clean)).collect()
    sizes = sorted((r.event_key, len(e["bookmakers"])) for r in bodies for e in json.loads(r.body))
    assert sizes == [(1, 7), (2, 50), (2, 100), (2, 100)]
    books = [(r.event_key, int(b["key"])) for r in bodies for e in json.loads(r.body) for b in e["bookmakers"]]
    assert sorted(books) == rows


def test_a_market_is_chosen_once_and_events_are_not_copied_per_book(spark):
    # neither the choice of a market nor the parsed event may appear twice in a plan
    events = qt.parse_payload(payload(spark), "body")
    for rows in (qt.explode_paired_quotes(events), qt.archive_quotes(events)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("transform(filter(") == 1
        assert "posexplode(event" not in plan and "_bookmakers" in plan
    odd = spark.createDataFrame([("[null]",), ("[]",), ("no json",), (None,), ('[{"id": "x", "bookmakers": [null, {"key": "k"}]}]',)], "body string")
    events = qt.parse_payload(odd, "body")
    assert sorted(str(r.event.id) for r in events.collect()) == ["None", "x"]
    assert qt.explode_paired_quotes(events).count() == qt.archive_quotes(events).count() == 0


def test_devig_before_median(spark):
    df = spark.createDataFrame([("e", f"b{i}", "2024-12-30", "2025-01-01 03:00:00", float(a), float(b)) for i, (a, b) in enumerate(BOARD.values())],
                               "event_uid string, book_key string, s string, c string, odds_a double, odds_b double")
    df = df.withColumns({"snapshot_ts": F.col("s").cast("timestamp"), "commence_time": F.col("c").cast("timestamp")})
    clean = qt.clean_quotes(df, ["event_uid"], "book_key", "snapshot_ts", "commence_time", "odds_a", "odds_b")
    r = qt.book_consensus(clean, ["event_uid"], 3).collect()[0]
    fair = [prob(a) / (prob(a) + prob(b)) for a, b in BOARD.values()]
    middle = [statistics.median(side) for side in zip(*BOARD.values())]
    assert abs(r.consensus_prob - statistics.median(fair)) < 1e-12
    assert abs(statistics.median(fair) - prob(middle[0]) / (prob(middle[0]) + prob(middle[1]))) < 0.1
    assert qt.book_consensus(clean, ["event_uid"], 6).count() == 0


def test_cleaning_rejects_bad_rows_and_keeps_the_last(spark):
    data = [("e", "b", 10, 20, "-150", "130"), ("e", "b", 12, 20, "-160", "140"), ("e", "b", 21, 20, "-170", "150"),
            ("e", "c", 10, 20, "-90", "130"), ("e", "d", 10, 20, "n/a", "130"), ("e", None, 10, 20, "-150", "130"), ("e", "f", 10, 20, "NaN", "130")]
    df = spark.createDataFrame(data, "k string, book string, ts int, start int, odds_a string, odds_b string")
    got = qt.clean_quotes(df, ["k"], "book", "ts", "start", "odds_a", "odds_b").collect()
    assert [(r.book, r.ts, r.odds_a) for r in got] == [("b", 12, -160.0)]
    reasons = qt.rejected_quotes(df.withColumns({c: F.col(c).try_cast("double") for c in ("odds_a", "odds_b")}), "ts", "start", "odds_a", "odds_b")
    assert {r.reject_reason for r in reasons.collect()} == {"post_start", "invalid_price"}


def test_closing_wins_over_captured(spark):
    closing = spark.createDataFrame([("2024-01-01", "x|y", -150.0, 130.0)], "date string, pair string, odds_a double, odds_b double")
    log = spark.createDataFrame([("2024-01-01", "x|y", 9, -1.0, 1.0), ("2024-01-02", "u|v", 1, -200.0, 170.0), ("2024-01-02", "u|v", 5, -210.0, 180.0),
                                 ("2025-01-02", "z|w", 5, -210.0, 180.0)], "date string, pair string, at int, odds_a double, odds_b double")
    out = qt.closing_with_fallback(closing, log, ["date", "pair"], "at", "2024-12-31").orderBy("date").collect()
    assert [(r.pair, r.odds_a, r.odds_source, r.odds_is_closing) for r in out] == [("x|y", -150.0, "closing", True), ("u|v", -210.0, "captured", False)]


def test_market_key_filter(spark):
    ev = qt.parse_payload(spark.createDataFrame([(json.dumps([{"id": "e", "bookmakers": [{"markets": [{"key": k} for k in (
        "h2h", "Fight_Method", "total_rounds", "total_rounds", "spreads")]}]}]),)], "body string"), "body")
    assert qt.market_keys(ev, [], ("method", "round")).collect()[0].market_keys == ["Fight_Method", "total_rounds"]
