"""Fail-closed data-quality operators: one aggregation pass gives (check, n) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duelmark.checks import assert_empty
from duelmark.functions.names import clean_text, id_from_url
from duelmark.functions.pricing import inside_unit
from duelmark.operators.keys import dropped_ids


def _checks(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """Evaluate all counters in one pass and unpivot the single result row."""
    one = df.agg(*[c.cast("long").alias(n) for n, c in counts.items()])
    cells = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in counts])
    return one.select(F.explode(cells).alias("c")).select("c.*")


def _count(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def _duplicates(*keys) -> Column:
    return F.count(F.lit(1)) - F.count_distinct(F.struct(*keys))


def _missing_columns(df: DataFrame, required: list[str]) -> DataFrame | None:
    missing = sorted(set(required) - set(df.columns))
    if not missing:
        return None
    rows = [(f"missing_column:{c}", 1) for c in missing]
    return df.sparkSession.createDataFrame(rows, "check string, n long")


def audit_bouts(df: DataFrame, date="date", a="a", b="b", winner="winner", name_a="name_a", name_b="name_b",
                url_a: str | None = None, url_b: str | None = None, pair="pair",
                url_pattern: str | None = None) -> DataFrame:
    """Contest table audit. ``a``/``b`` are stable ids, ``name_*`` normalised names."""
    absent = _missing_columns(df, [date, a, b, winner, name_a, name_b, pair, *[u for u in (url_a, url_b) if u]])
    if absent is not None:
        return absent
    counts = {
        "invalid_date": _count(F.col(date).isNull()),
        "missing_id_a": _count(clean_text(a).isNull()), "missing_id_b": _count(clean_text(b).isNull()),
        "duplicate_date_pair": _duplicates(date, pair),
        "invalid_winner": F.count_if(~F.coalesce(F.col(winner).isin("A", "B", "draw"), F.lit(False))),
        "self_match_name": _count(F.col(name_a) == F.col(name_b)),
        "self_match_id": _count(F.col(a).cast("string") == F.col(b).cast("string")),
    }
    for tag, url, ident in (("a", url_a, a), ("b", url_b, b)):
        if url:
            kw = {"pattern": url_pattern} if url_pattern else {}
            counts[f"missing_url_{tag}"] = _count(clean_text(url).isNull())
            counts[f"url_id_mismatch_{tag}"] = _count(
                id_from_url(url, **kw) != F.lower(F.coalesce(F.col(ident).cast("string"), F.lit(""))))
    return _checks(df, counts)


def audit_upcoming(df: DataFrame, date="date", a="a", b="b", odds_a="odds_a", odds_b="odds_b", pair="pair",
                   prob: str | None = None, books: str | None = None,
                   best: tuple[str, str, str, str] | None = None) -> DataFrame:
    """Upcoming table audit; optional columns are checked only where a value is present."""
    absent = _missing_columns(df, [date, a, b, odds_a, odds_b, pair])
    if absent is not None:
        return absent

    def price(c):
        return F.regexp_replace(F.col(c).cast("string"), r"\+", "").try_cast("double")

    counts = {
        "invalid_date": _count(F.col(date).isNull()),
        "missing_or_zero_price": F.count_if(F.coalesce((price(odds_a) == 0) | (price(odds_b) == 0), F.lit(True))),
        "duplicate_date_pair": _duplicates(date, pair),
        "self_match": _count(F.col(a) == F.col(b)),
    }
    if prob:
        counts["invalid_probability"] = _count(~inside_unit(prob))
    if books:
        counts["invalid_book_count"] = _count(F.col(books) < 1)
    if best:
        best_a, book_a, best_b, book_b = best
        for tag, price_col, book_col in (("a", best_a, book_a), ("b", best_b, book_b)):
            counts[f"invalid_best_{tag}"] = _count(F.abs(F.col(price_col)) < 100)
            counts[f"best_without_book_{tag}"] = _count(
                F.col(price_col).isNotNull() & clean_text(book_col).isNull())
    return _checks(df, counts)


def assert_clean(*audits: DataFrame, message: str = "input quality gate failed") -> None:
    """Raise listing every failed check."""
    failed = [f"{r['check']}={r['n']}" for audit in audits for r in audit.filter("n > 0").collect()]
    if failed:
        raise ValueError(message + ": " + ", ".join(failed))


def late_rows(df: DataFrame, start: str, now) -> DataFrame:
    """Rows that are not demonstrably before their start."""
    return df.filter(F.coalesce(F.lit(now) >= F.col(start), F.lit(True)))


def assert_pre_event(df: DataFrame, start: str, now, show: list[str]) -> DataFrame:
    assert_empty(late_rows(df, start, now).select(*show, start), "refusing retroactive rows")
    return df


def history_checks(df: DataFrame, entry_required: list[str], close_required: list[str],
                   start="commence_time", min_entry: float = 24.0, max_close: float = 12.0) -> DataFrame:
    """Entry complete, order of times, partial closes and lead bounds."""
    present = [F.col(c).isNotNull() for c in close_required]
    any_close, full_close = present[0], present[0]
    for p in present[1:]:
        any_close, full_close = any_close | p, full_close & p
    incomplete = F.lit(False)
    for c in entry_required:
        incomplete = incomplete | F.col(c).isNull()
    entry, close = F.col("entry_snapshot_ts"), F.col("close_snapshot_ts")
    return _checks(df, {
        "incomplete_entry": _count(incomplete),
        "entry_not_pre_event": _count(~(entry < F.col(start))),
        "entry_lead_too_short": _count(F.col("entry_lead_hours") < min_entry),
        "partial_close": _count(any_close & ~full_close),
        "invalid_close_time": _count(full_close & ~((entry < close) & (close < F.col(start)))),
        "close_lead_too_long": _count(full_close & (F.col("close_lead_hours") > max_close)),
    })


def refresh_regressions(old: DataFrame, new: DataFrame, date: str, ids: list[str]) -> DataFrame:
    """Rows shrank, latest date moved backward, ids dropped."""
    def summary(df, tag):
        return df.agg(F.count(F.lit(1)).alias("rows"), F.max(date).alias("latest")).withColumn("t", F.lit(tag))

    both = summary(old, "old").unionByName(summary(new, "new"))
    side = both.agg(*[F.max(F.when(F.col("t") == t, F.col(c))).alias(f"{t}_{c}")
                      for t in ("old", "new") for c in ("rows", "latest")])
    lost = dropped_ids(old, new, ids).agg(F.count(F.lit(1))).scalar()
    side = side.withColumn("lost", lost)
    shrunk = F.greatest(F.col("old_rows") - F.col("new_rows"), F.lit(0))
    cells = F.array(
        F.struct(F.lit("rows_shrank").alias("check"), shrunk.cast("long").alias("n")),
        F.struct(F.lit("latest_moved_backward").alias("check"),
                 F.coalesce(F.col("new_latest") < F.col("old_latest"), F.lit(False)).cast("long").alias("n")),
        F.struct(F.lit("ids_dropped").alias("check"), F.col("lost").cast("long").alias("n")))
    return side.select(F.explode(cells).alias("c")).select("c.*")


def identity_warnings(df: DataFrame, id_columns: list[str], name_columns: list[str] = ()) -> DataFrame:
    """Missing id columns, and participants left ``unresolved:``."""
    missing = sorted(set(id_columns) - set(df.columns))
    if missing:
        return df.sparkSession.createDataFrame([(c, "column_absent", 1) for c in missing],
                                               "subject string, warning string, n long")
    sides = F.array(*[F.struct(F.col(i).cast("string").alias("id"), F.col(n).cast("string").alias("name"))
                      for i, n in zip(id_columns, name_columns or id_columns)])
    rows = df.select(F.explode(sides).alias("s")).filter(F.col("s.id").startswith("unresolved:"))
    return (rows.groupBy(F.col("s.name").alias("subject"))
            .agg(F.lit("unresolved_identity").alias("warning"), F.count(F.lit(1)).alias("n"))
            .select("subject", "warning", "n"))
