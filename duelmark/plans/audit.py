"""Audit plan: predictions to reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from duelmark.operators.betting import allocate, desired_stake, row_pnl, score_picks
from duelmark.operators.evaluation import clv_points, log_loss_term
from duelmark.operators.models import method_probabilities
from duelmark.settings import EVENT_DAY_CAP


def score_candidates(df: DataFrame, candidates: dict[str, tuple[str, str]], row_id: list[str],
                     date: str = "date") -> DataFrame:
    """Every candidate (name -> probability, uncertainty) scored and allocated in one pass.

    The candidate name is part of the allocation key; rows are copied by exploding an array.
    """
    variants = F.array(*[F.struct(F.lit(n).alias("candidate"), F.col(p).alias("p_model"), F.col(s).alias("se"))
                         for n, (p, s) in candidates.items()])
    drop = [c for pair in candidates.values() for c in pair]
    rows = df.withColumn("_v", F.explode(variants)).drop(*set(drop)).select("*", "_v.*").drop("_v")
    rows = score_picks(rows).withColumn("desired", desired_stake())
    out = allocate(rows, ["candidate", date], row_id, EVENT_DAY_CAP)
    return out.withColumn("pnl", row_pnl())


def candidate_report(df: DataFrame, candidates: dict[str, tuple[str, str]], row_id: list[str],
                     date: str = "date", close: str | None = None) -> DataFrame:
    """One row per candidate: size, stakes, return and log loss against the market."""
    rows = score_candidates(df, candidates, row_id, date)
    aggs = [F.countDistinct(date).alias("events"), F.count(F.lit(1)).alias("contests"),
            F.count_if(F.col("stake") > 0).alias("bets"), F.sum("stake").cast("double").alias("staked"),
            F.sum("pnl").alias("pnl"), F.avg(log_loss_term("y", "p_model")).alias("log_loss"),
            F.avg(log_loss_term("y", "p_line")).alias("log_loss_market")]
    if close:
        clv = F.when(F.col("stake") > 0, clv_points(close=close))
        aggs += [F.count(clv).alias("clv_bets"), F.avg(clv).alias("mean_clv")]
    return rows.groupBy("candidate").agg(*aggs).withColumn("roi", F.try_divide("pnl", "staked"))


def method_prior(train: DataFrame, test: DataFrame, label: str = "method_class") -> DataFrame:
    """One row: sizes, and the log loss of the training shares of the classes on later contests."""
    shares = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = shares.agg(F.sum("_n")).scalar()
    scored = test.join(shares.withColumn("_p", F.col("_n") / total), label, "left")
    out = scored.agg(F.count(F.lit(1)).alias("test_rows"), F.avg(-F.ln(F.greatest(F.coalesce("_p", F.lit(0.0)), F.lit(1e-15)))).alias("log_loss_prior"))
    return out.withColumn("train_rows", total)


def method_audit(model, train: DataFrame, test: DataFrame, classes: list[str],
                 label: str = "method_class") -> DataFrame:
    """Log loss of the method model and of the training class shares on later contests."""
    counts = {r[0]: r[1] for r in train.filter(F.col(label).isin(*classes)).groupBy(label).count().collect()}
    total = sum(counts.values())
    prior = F.create_map(*[x for c in classes for x in (F.lit(c), F.lit(counts.get(c, 0) / total))])
    scored = method_probabilities(model, test.filter(F.col(label).isin(*classes)), classes, label)
    own = reduce(lambda acc, c: acc.when(F.col(label) == c, F.col(f"p_{c}")), classes[1:],
                 F.when(F.col(label) == classes[0], F.col(f"p_{classes[0]}")))
    best = F.greatest(*[F.col(f"p_{c}") for c in classes])
    low = F.lit(1e-15)
    return scored.agg(
        F.lit(total).alias("train_rows"), F.count(F.lit(1)).alias("test_rows"),
        F.avg(-F.ln(F.greatest(own, low))).alias("log_loss_model"),
        F.avg(-F.ln(F.greatest(prior[F.col(label)], low))).alias("log_loss_prior"),
        F.avg((own == best).cast("double")).alias("accuracy_model"))


def matched_table(features: DataFrame, odds: DataFrame, diff_columns: list[str], tie: list[str],
                  bout_columns: tuple[str, ...] = ()) -> DataFrame:
    """Feature table with prices of the same (date, pair), in the price table's side order.

    odds: date, pair, key_r (normalised name of the first side), odds_a, odds_b and
    optionally market_prob. Differentials change sign when the sides are swapped; bout-level
    columns do not.
    """
    from duelmark.functions import clipped_logit, market_probability, norm_name, pair_key
    from duelmark.functions.pricing import implied_prob
    from duelmark.operators.keys import keep_first
    from duelmark.operators.quotes import orient

    f = features.withColumns({"key_a": norm_name("fighter_a"), "key_b": norm_name("fighter_b")})
    f = f.withColumn("pair", pair_key("key_a", "key_b"))
    m = f.join(keep_first(odds, ["date", "pair"], tie), ["date", "pair"])
    m = keep_first(m, ["date", "pair"], tie)
    same = F.col("key_a") == F.col("key_r")
    m = orient(m.withColumn("y", F.col("target")), same, complement=["y"],
               negate=[c for c in diff_columns if c not in bout_columns])
    supplied = F.col("market_prob") if "market_prob" in odds.columns else None
    m = m.withColumns({"p_line": market_probability("odds_a", "odds_b", supplied),
                       "pr_raw": implied_prob("odds_a"), "pb_raw": implied_prob("odds_b")})
    m = m.withColumn("line_logit", clipped_logit("p_line"))
    return m.withColumn("line_abs", F.abs("line_logit"))


def walk_forward_audit(matched: DataFrame, features: list[str], flip: list[str], folds: list, row_id: list[str],
                       date: str = "date", n_models: int = 30, min_train: int = 2000) -> DataFrame:
    """Refit, predict, score, allocate and settle every contest from its first fold on."""
    from duelmark.operators.models import walk_forward

    out = walk_forward(matched, features, flip, date, folds, n_models, min_train=min_train)
    out = score_picks(out).withColumn("desired", desired_stake())
    out = allocate(out, [date], row_id, EVENT_DAY_CAP)
    return out.withColumn("pnl", row_pnl())
