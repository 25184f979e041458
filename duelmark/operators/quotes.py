"""Book quotes: cleaning, consensus, entry and close selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duelmark.checks import require_columns
from duelmark.functions.pricing import devig, valid_price
from duelmark.functions.timing import lead_hours
from duelmark.operators.keys import keep_last

PAYLOAD_SCHEMA = """
array<struct<id:string, commence_time:string, home_team:string, away_team:string,
  bookmakers:array<struct<key:string, title:string, last_update:string,
    markets:array<struct<key:string, last_update:string,
      outcomes:array<struct<name:string, price:string>>>>>>>>
"""


def clean_quotes(df: DataFrame, keys: list[str], book: str, snapshot: str, start: str,
                 odds_a: str, odds_b: str, tie: list[str] = (), kind: str | None = None,
                 kinds=("entry", "close"), required: list[str] = ()) -> DataFrame:
    """Typed, valid, pre-start quotes, the last one per (keys, kind, book).

    Unparsable values become NULL and are dropped; adds ``book_prob`` (de-vigged side A).
    """
    if kind:
        df = df.filter(F.col(kind).isin(*kinds))
    group = [*keys, *([kind] if kind else []), book]
    ok = valid_quotes(df, group, snapshot, start, odds_a, odds_b, required)
    return keep_last(ok, group, [snapshot, *tie])


def valid_quotes(df: DataFrame, keys: list[str], snapshot: str, start: str, odds_a: str, odds_b: str,
                 required: list[str] = ()) -> DataFrame:
    """All typed, valid, pre-start quotes with ``book_prob``; as-of lookups start from these, not from the last ones."""
    require_columns(df, [*keys, snapshot, start, odds_a, odds_b, *required], "quotes")
    typed = df.withColumns({
        odds_a: F.nanvl(F.col(odds_a).try_cast("double"), F.lit(None).cast("double")),
        odds_b: F.nanvl(F.col(odds_b).try_cast("double"), F.lit(None).cast("double")),
    })
    ok = (typed.dropna(subset=[*keys, snapshot, start, odds_a, odds_b, *required])
          .filter(valid_price(odds_a) & valid_price(odds_b))
          .filter(F.col(snapshot) < F.col(start)))
    return ok.withColumn("book_prob", devig(odds_a, odds_b))


def rejected_quotes(df: DataFrame, snapshot: str, start: str, odds_a: str, odds_b: str) -> DataFrame:
    """Rows that may never enter, with the reason: the complement of ``clean_quotes``."""
    reason = (F.when(F.col(snapshot).isNull() | F.col(start).isNull(), "invalid_time")
              .when(F.col(snapshot) >= F.col(start), "post_start")
              .when(~(valid_price(odds_a) & valid_price(odds_b)), "invalid_price"))
    return df.withColumn("reject_reason", reason).filter(F.col("reject_reason").isNotNull())


def book_consensus(quotes: DataFrame, keys: list[str], min_books: int = 3, book: str = "book_key",
                   snapshot: str = "snapshot_ts", start: str = "commence_time",
                   odds_a: str = "odds_a", odds_b: str = "odds_b", first: dict[str, str] | None = None,
                   first_order: list[str] | None = None, one_row_per_book: bool = True) -> DataFrame:
    """Consensus per key over de-duplicated book quotes.

    Probabilities are de-vigged per book and then aggregated (never the reverse). After
    de-duplication a group has one row per book, so the exact median keeps at most that
    many values; partial aggregation happens before the shuffle. Books are then counted as
    rows: a distinct count would carry every median through a second shuffle. Pass
    ``one_row_per_book=False`` for input that is not de-duplicated on (keys, book).
    """
    n_books = F.count(book) if one_row_per_book else F.countDistinct(book)
    order = F.struct(*[F.col(c) for c in (first_order or [snapshot, book])])
    names = [F.min_by(c, order).alias(n) for n, c in (first or {}).items()]
    out = quotes.groupBy(*keys).agg(
        F.max(snapshot).alias("snapshot_ts"), F.min(start).alias("commence_time"), *names,
        F.percentile(odds_a, 0.5).alias("odds_a"), F.percentile(odds_b, 0.5).alias("odds_b"),
        F.percentile("book_prob", 0.5).alias("consensus_prob"),
        n_books.alias("n_books"),
    ).filter(F.col("n_books") >= min_books)
    out = out.withColumn("lead_hours", lead_hours("snapshot_ts", "commence_time"))
    return out.filter("lead_hours > 0")


def upper_median(c: str) -> Column:
    """``sorted(x)[n // 2]``: the discrete median taken from the top."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)")


def live_consensus(quotes: DataFrame, keys: list[str], seq: str, title: str = "book_title",
                   odds_a: str = "odds_a", odds_b: str = "odds_b") -> DataFrame:
    """Upper-median prices, median probability, spread, and best price with its book.

    Ties for the best price go to the earliest ``seq``.
    """
    best_a = F.max_by(title, F.struct(F.col(odds_a), -F.col(seq)))
    best_b = F.max_by(title, F.struct(F.col(odds_b), -F.col(seq)))
    return quotes.groupBy(*keys).agg(
        upper_median(odds_a).alias("odds_a"), upper_median(odds_b).alias("odds_b"),
        F.bround(F.percentile("book_prob", 0.5), 8).alias("market_prob_a"),
        F.count(F.lit(1)).alias("market_books"),
        F.bround(F.max("book_prob") - F.min("book_prob"), 8).alias("market_spread"),
        F.max(odds_a).alias("best_odds_a"), best_a.alias("best_book_a"),
        F.max(odds_b).alias("best_odds_b"), best_b.alias("best_book_b"),
    )


def one_sided_consensus(quotes: DataFrame, keys: list[str], odds_a: str = "odds_a",
                        odds_b: str = "odds_b") -> DataFrame:
    """Upper median per side without pairing; the count is the smaller side's."""
    out = quotes.groupBy(*keys).agg(
        upper_median(odds_a).alias("odds_a"), upper_median(odds_b).alias("odds_b"),
        F.least(F.count(odds_a), F.count(odds_b)).alias("n_books"))
    return out.filter("n_books > 0")


# --- nested payloads ---------------------------------------------------------

def parse_payload(df: DataFrame, json_col: str, keep: list[str] = ()) -> DataFrame:
    """One row per event of a JSON array payload.

    The events' fields are exploded as columns, so that whoever reads some of them copies no others; a null event has null fields.
    """
    fields = ["id", "commence_time", "home_team", "away_team", "bookmakers"]
    events = df.select(*keep, F.inline(F.from_json(F.col(json_col), PAYLOAD_SCHEMA)).alias(*[f"_{f}" for f in fields]))
    return events.select(*keep, F.struct(*[F.col(f"_{f}").alias(f) for f in fields]).alias("event"))


def _books(events: DataFrame, keep: list[str]) -> DataFrame:
    """One row per book, beside the fields of its event; the event's array of books is not copied into every row."""
    fields = ["id", "commence_time", "home_team", "away_team"]
    flat = events.select(*keep, *[F.col(f"event.{f}").alias(f) for f in (*fields, "bookmakers")])
    books = flat.select(*keep, *fields, F.posexplode("bookmakers").alias("book_pos", "book"))
    return books.select(*keep, *fields, "book_pos", *[F.col(f"book.{f}").alias(f"book_{f}") for f in ("key", "title", "last_update", "markets")])


def _head_to_head(sides) -> Column:
    """``sides(price, market)`` of every head-to-head market of a book."""
    def row(market):
        def price(side):
            # the last outcome of that name wins, as in a dictionary
            hits = F.filter(market["outcomes"], lambda o: o["name"] == F.col(side))
            return F.try_element_at(hits, F.lit(-1))["price"]

        return sides(price, market)

    return F.transform(F.filter("book_markets", lambda m: m["key"] == "h2h"), row)


def explode_paired_quotes(events: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Paired head-to-head quotes with provenance; the first valid market per book.

    The market is chosen inside each book's array, so nothing is shuffled and an event may come in any number of payloads.
    It is exploded and not filtered, since a filter would be pushed down and the market chosen twice.
    """
    keep = list(keep)
    h2h = _head_to_head(lambda price, market: F.struct(price("home_team").try_cast("double").alias("odds_a"),
                                                       price("away_team").try_cast("double").alias("odds_b")))
    valid = F.filter(h2h, lambda m: valid_price(m["odds_a"]) & valid_price(m["odds_b"]))
    rows = _books(events, keep).select("*", F.inline(F.slice(valid, 1, 1)).alias("_odds_a", "_odds_b"))
    return rows.select(
        *keep, F.col("id").alias("event_id"), "commence_time",
        F.col("home_team").alias("side_a"), F.col("away_team").alias("side_b"),
        "book_pos", F.coalesce("book_key", F.lit("")).alias("book_key"),
        F.coalesce("book_title", "book_key", F.lit("")).alias("book_title"),
        F.coalesce("book_last_update", F.lit("")).alias("book_updated_at"),
        F.col("_odds_a").alias("odds_a"), F.col("_odds_b").alias("odds_b"),
        devig("_odds_a", "_odds_b").alias("book_prob"))


def archive_quotes(events: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Every head-to-head market with both sides present; prices kept as delivered.

    Markets are chosen inside each book's array and exploded once, as in ``explode_paired_quotes``.
    """
    keep = list(keep)
    h2h = _head_to_head(lambda price, market: F.struct(price("home_team").alias("raw_a"), price("away_team").alias("raw_b"),
                                                       market["last_update"].alias("at")))
    both = F.filter(h2h, lambda m: m["raw_a"].isNotNull() & m["raw_b"].isNotNull())
    rows = _books(events, keep).select("*", F.inline(both).alias("_raw_a", "_raw_b", "_market_at"))
    return rows.select(
        *keep, F.col("id").alias("event_id"), "commence_time",
        F.col("home_team").alias("side_a"), F.col("away_team").alias("side_b"),
        F.coalesce("book_key", F.lit("")).alias("book_key"),
        F.coalesce("book_title", F.lit("")).alias("book_title"),
        F.coalesce("book_last_update", F.lit("")).alias("book_updated_at"),
        F.coalesce("_market_at", F.lit("")).alias("market_updated_at"),
        F.col("_raw_a").alias("odds_a"), F.col("_raw_b").alias("odds_b"))


def market_keys(events: DataFrame, keep: list[str], terms) -> DataFrame:
    """Distinct market keys per event that contain one of ``terms``, sorted."""
    keys = F.flatten(F.transform("event.bookmakers", lambda b: F.transform(b["markets"], lambda m: m["key"])))

    def wanted(k):
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.lower(k).contains(t)
        return hit

    return events.select(*keep, F.sort_array(F.array_distinct(F.filter(keys, wanted))).alias("market_keys"))


def manifest_status(snapshot, start, matched, quotes) -> Column:
    """Outcome of one snapshot attempt."""
    s, t = F.col(snapshot), F.col(start)
    return (F.when(s.isNull() | t.isNull() | (s >= t), "invalid_snapshot_time")
            .when(F.col(matched) == 0, "no_match")
            .when(F.col(quotes) > 0, "ok").otherwise("no_quotes"))


# --- entry and close ---------------------------------------------------------

def at_or_before_lead(df: DataFrame, key: list[str], hours: float, snapshot: str, lead: str,
                      tie: list[str] = ()) -> DataFrame:
    """As-of: the last snapshot taken at least ``hours`` before the start."""
    return keep_last(df.filter(F.col(lead) >= hours), key, [snapshot, *tie])


def entry_and_close(df: DataFrame, key: list[str], entry_when: Column, close_when: Column,
                    snapshot: str, values: list[str], tie: list[str] = ()) -> DataFrame:
    """Entry and close snapshot per key without a self-join.

    Rows are tagged and the last one per (key, tag) is kept, which limits groups before the shuffle; the two rows left per
    key are then turned into columns.
    """
    tags = F.array_compact(F.array(F.when(entry_when, F.lit("entry")), F.when(close_when, F.lit("close"))))
    last = keep_last(df.withColumn("_which", F.explode(tags)), [*key, "_which"], [snapshot, *tie])
    fields = {"snapshot_ts": snapshot, **{v: v for v in values}}
    return last.groupBy(*key).agg(*[F.max(F.when(F.col("_which") == which, F.col(c))).alias(f"{which}_{f}")
                                    for which in ("entry", "close") for f, c in fields.items()])


def valid_entry_close(start: str = "commence_time", min_entry: float = 24.0,
                      max_close: float = 12.0) -> Column:
    """Both before the start, close later than entry, leads within bounds."""
    return ((F.col("entry_snapshot_ts") < F.col(start)) & (F.col("close_snapshot_ts") < F.col(start))
            & (F.col("close_snapshot_ts") > F.col("entry_snapshot_ts"))
            & (F.col("entry_lead_hours") >= min_entry) & (F.col("close_lead_hours") <= max_close))


def overlay_history(base: DataFrame, update: DataFrame, keys: list[str], entry_cols: list[str],
                    close_cols: list[str], start: str = "commence_time",
                    max_close: float = 12.0) -> DataFrame:
    """Base history with newer entries on top; the later *valid* close wins.

    Entry columns are overridden where the update has a value. A close counts only when it
    lies between entry and start and within ``max_close`` hours of the start.
    """
    renamed = update.select(*keys, *[F.col(c).alias(f"u_{c}") for c in (*entry_cols, *close_cols)])
    j = base.join(renamed, keys, "left")
    entry = {c: F.coalesce(F.col(f"u_{c}"), F.col(c)) for c in entry_cols}
    j = j.withColumns(entry)

    def ok(c):
        return F.coalesce(
            (F.col(c) > F.col("entry_snapshot_ts")) & (F.col(c) < F.col(start))
            & (lead_hours(c, start) <= max_close), F.lit(False))

    j = j.withColumns({"_base": ok("close_snapshot_ts"), "_upd": ok("u_close_snapshot_ts")})
    use = F.col("_upd") & (~F.col("_base") | (F.col("u_close_snapshot_ts") > F.col("close_snapshot_ts")))
    j = j.withColumn("_use", use)
    close = {c: F.when(F.col("_use"), F.col(f"u_{c}")).when(F.col("_base"), F.col(c)) for c in close_cols}
    j = j.withColumns(close)
    j = j.withColumns({"entry_lead_hours": lead_hours("entry_snapshot_ts", start),
                       "close_lead_hours": lead_hours("close_snapshot_ts", start)})
    extra = [c for c in ("entry_lead_hours", "close_lead_hours") if c not in base.columns]
    return j.select(*base.columns, *extra)


def closing_with_fallback(closing: DataFrame, captured: DataFrame, keys: list[str], captured_at: str,
                          max_date, date: str = "date", tie: list[str] = (),
                          labels=("closing", "captured")) -> DataFrame:
    """Closing prices win; otherwise the latest captured quote, labelled by provenance."""
    a = closing.withColumns({"odds_source": F.lit(labels[0]), "odds_is_closing": F.lit(True)})
    b = (captured.filter(F.col(date) <= max_date)
         .withColumns({"odds_source": F.lit(labels[1]), "odds_is_closing": F.lit(False)}))
    both = a.unionByName(b, allowMissingColumns=True)
    return keep_last(both, keys, ["odds_is_closing", captured_at, *tie])


def captured_closes(df: DataFrame, pair: str, captured_at: str, start: str, tie: list[str] = ()) -> DataFrame:
    """Pre-start captures keyed by (start date, pair); the latest capture wins."""
    ok = df.filter(F.col(captured_at) < F.col(start)).withColumn("date", F.col(start).cast("date"))
    return keep_last(ok, ["date", pair], [captured_at, *tie])


def master_closes(df: DataFrame, date: str, pair: str, odds: tuple[str, str], seq: list[str]) -> DataFrame:
    """Listed closes with both prices keyed by (date, pair); the last row wins."""
    ok = df.dropna(subset=[date, *odds])
    return keep_last(ok, [date, pair], seq)


def orient(df: DataFrame, same: Column, swap_pairs: list[tuple[str, str]] = (),
           complement: list[str] = (), negate: list[str] = ()) -> DataFrame:
    """Move rows into the table's side order: swap pairs, 1 - p, negate differentials."""
    out = {}
    for a, b in swap_pairs:
        out[a] = F.when(same, F.col(a)).otherwise(F.col(b))
        out[b] = F.when(same, F.col(b)).otherwise(F.col(a))
    for c in complement:
        out[c] = F.when(same, F.col(c)).otherwise(1 - F.col(c))
    for c in negate:
        out[c] = F.when(same, F.col(c)).otherwise(-F.col(c))
    return df.withColumns(out)
