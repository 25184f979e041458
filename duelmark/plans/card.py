"""Card plan: upcoming contests to scored, allocated picks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F


def features_of_hypothetical(history: DataFrame, hypothetical: DataFrame, identity: list[str],
                             build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Append hypothetical rows to the history, build features, read back the new rows."""
    marked = (history.withColumn("_new", F.lit(False))
              .unionByName(hypothetical.withColumn("_new", F.lit(True)), allowMissingColumns=True))
    return build(marked).filter("_new").drop("_new")


def score_card(card: DataFrame, models: DataFrame, features: list[str], flip: list[str], row_id: list[str],
               date: str = "date", execution: tuple[str, str] | None = None, books: str = "market_books",
               age: str = "quote_age_minutes", source: str = "odds_source") -> DataFrame:
    """Predict, pick the better side at executable prices, check eligibility, allocate.

    ``execution`` names the best available prices; missing ones fall back to the consensus.
    """
    from duelmark.functions.pricing import implied_prob
    from duelmark.operators.betting import allocate, cap_reason, desired_stake, eligibility, score_picks
    from duelmark.operators.models import predict
    from duelmark.settings import EVENT_DAY_CAP

    out = predict(card, models, features, flip, fold=None)
    if execution:
        a, b = execution
        out = out.withColumns({"pr_raw": implied_prob(F.coalesce(a, "odds_a")), "pb_raw": implied_prob(F.coalesce(b, "odds_b"))})
    out = eligibility(score_picks(out), books=books, age=age, source=source)
    out = out.withColumn("desired", desired_stake())
    out = allocate(out, [date], row_id, EVENT_DAY_CAP, eligible=F.col("quality_ok"))
    return out.withColumns({"eligibility_reason": cap_reason(), "bet": F.col("stake") > 0})
