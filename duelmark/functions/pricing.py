"""American prices, probabilities and execution levels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from duelmark.functions._col import col


def implied_prob(odds) -> Column:
    o = col(odds).cast("double")
    return F.when(o < 0, -o / (-o + 100.0)).otherwise(F.try_divide(F.lit(100.0), o + 100.0))


def unit_profit(odds) -> Column:
    """Profit on a winning stake of one unit."""
    o = col(odds).cast("double")
    return F.when(o < 0, 100.0 / -o).otherwise(o / 100.0)


def devig(odds_a, odds_b) -> Column:
    pa, pb = implied_prob(odds_a), implied_prob(odds_b)
    return F.try_divide(pa, pa + pb)


def overround(odds_a, odds_b) -> Column:
    return implied_prob(odds_a) + implied_prob(odds_b) - 1.0


def valid_price(odds, minimum: float = 100.0) -> Column:
    return F.abs(col(odds)) >= minimum


def inside_unit(p) -> Column:
    return (col(p) > 0) & (col(p) < 1)


def market_probability(odds_a, odds_b, supplied=None) -> Column:
    """Supplied consensus when it lies in (0, 1), else the de-vigged prices."""
    fallback = devig(odds_a, odds_b)
    if supplied is None:
        return fallback
    s = F.nanvl(col(supplied).cast("double"), F.lit(None).cast("double"))
    return F.when(inside_unit(s), s).otherwise(fallback)


def clip(p, low: float, high: float) -> Column:
    return F.least(F.greatest(col(p), F.lit(low)), F.lit(high))


def logit(p) -> Column:
    return F.ln(col(p) / (1.0 - col(p)))


def clipped_logit(p, low: float = 0.02, high: float = 0.98) -> Column:
    return logit(clip(p, low, high))


def expit(x) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def _american(p: Column) -> Column:
    return F.when(p >= 0.5, -100.0 * p / (1.0 - p)).otherwise(100.0 * (1.0 - p) / p)


def fair_american(p) -> Column:
    """Fair price of a probability clamped to [.005, .995], rounded half to even."""
    return F.bround(_american(clip(p, 0.005, 0.995)), 0).cast("long")


def ceil_american(p) -> Column:
    """Worst acceptable price of a probability in [.02, .98]; NULL outside."""
    c = col(p)
    return F.when(c.between(0.02, 0.98), F.ceil(_american(c)).cast("long"))


def signed_price(odds) -> Column:
    """``-150`` / ``+130`` text of a price cut to a whole number; NULL stays NULL."""
    whole = col(odds).cast("long")
    return F.when(whole.isNotNull(), F.format_string("%+d", whole))
