"""Entry and close history plan: quote source to model input."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from duelmark.functions import pair_key
from duelmark.operators.quotes import entry_and_close


def result_table(df: DataFrame, date: str, a: str, b: str, winner: str) -> DataFrame:
    """Contests with a result (draws included), with their pair key."""
    return df.dropna(subset=[date, a, b, winner]).withColumn("pair", pair_key(a, b))


def five_stage_history(quotes: DataFrame, key: list[str], path: str, entry_hours: float = 24.0,
                       close_minutes: float = 30.0, max_close: float = 12.0, min_books: int | None = None,
                       tie: list[str] = ()) -> dict[str, DataFrame]:
    """Write source, clean, entry, entry with valid close, and entry with optional close.

    Each stage is written once and the next one reads the written stage, so the source is
    scanned once and a lost executor never recomputes the whole chain.
    """
    spark = quotes.sparkSession

    def stage(name, df):
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    source = stage("source", quotes.dropna(subset=["odds_a", "odds_b", "snapshot_ts", "commence_time"])
                   .filter("odds_a <> 0 AND odds_b <> 0"))
    clean = stage("clean", source.filter("lead_hours > 0"))
    eligible = clean.filter(F.col("n_books") >= min_books) if min_books else clean
    picked = entry_and_close(eligible, [*key, "commence_time"], F.col("lead_hours") >= entry_hours,
                             F.col("lead_hours") >= close_minutes / 60.0, "snapshot_ts",
                             ["lead_hours", "odds_a", "odds_b"], tie)
    picked = picked.filter(F.col("entry_snapshot_ts").isNotNull())
    valid = ((F.col("close_snapshot_ts") > F.col("entry_snapshot_ts"))
             & (F.col("close_snapshot_ts") < F.col("commence_time")) & (F.col("close_lead_hours") <= max_close))
    closes = [c for c in picked.columns if c.startswith("close_")]
    both = picked.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    combined = stage("entry_with_close", both.withColumns({c: F.when(F.col("_ok"), F.col(c)) for c in closes}).drop("_ok"))
    entry = stage("entry", combined.drop(*closes))
    dataset = stage("entry_close", combined.filter(F.col("close_snapshot_ts").isNotNull()))
    return {"source": source, "clean": clean, "entry": entry, "entry_close": dataset, "entry_with_close": combined}
