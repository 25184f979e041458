"""Walk-forward models. SQL cannot fit a model, so most of these are compared
with plain numpy fits in the tests instead."""

import datetime as dt

from pyspark.sql import Window, functions as F

from duelmark.catalog.fixtures import imp, ll, profit
from duelmark.catalog.registry import query
from duelmark.functions import clipped_logit, fair_american, method_class
from duelmark.operators import entity_state as es, evaluation as ev, models as ml, point_in_time as pit
from duelmark.session import materialize

FEATS = ["line_logit", "line_abs", "d1", "d2", "d3"]
FLIP = ["line_logit", "d1", "d2", "d3"]
OFF = ["d1", "d2", "d3"]
AUDIT = dt.date(2001, 1, 1)     # the audited period, with a refit at every date; earlier contests are only learned from


def model_input(t):
    """Scored events with a market logit and stand-in differentials."""
    k = F.col("event_key")
    z = clipped_logit("p_line")
    return t.stored("scored").withColumns({
        "line_logit": z, "line_abs": F.abs(z), "d1": ((k * 37) % 101) / 50.0 - 1.0, "d2": ((k * 59) % 89) / 44.0 - 1.0,
        "d3": F.col("odds_a") / 400.0, "row_key": k})


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("I1_symmetrize", """
SELECT event_key, s * (((event_key * 37) % 101) / 50.0 - 1.0) AS d1, CASE WHEN s > 0 THEN y ELSE 1 - y END AS y FROM {scored}, (VALUES (1), (-1)) v(s)""", "d1")
def _(t):
    return ml.symmetrize(model_input(t), FLIP).select("event_key", "d1", "y")


def coefficients(model, features):
    rows = [("intercept", float(model.intercept))] + [(f, float(c)) for f, c in zip(features, model.coefficients)]
    return rows


@query("I2_ridge_logistic")
def _(t):
    m = ml.ridge_logistic(ml.symmetrize(model_input(t), FLIP), FEATS)
    return rounded(t.spark.createDataFrame(coefficients(m, FEATS), "term string, value double"), "value")


def optimality(rows, features, model, penalty, offset=None, centred=True):
    """One row per term: the slope of the penalised loss at a fitted model, which is 0 at the optimum."""
    mean = [F.avg(c).alias(f"m{j}") for j, c in enumerate(features)]
    square = [F.avg(F.col(c) * F.col(c)).alias(f"q{j}") for j, c in enumerate(features)]
    at = rows.agg(*mean, *square, F.count("*").alias("n")).first()
    mu = [at[f"m{j}"] if centred else 0.0 for j in range(len(features))]
    sd = [(at[f"q{j}"] - mu[j] ** 2) ** 0.5 for j in range(len(features))]
    z = F.lit(float(model.intercept)) + (F.col(offset) if offset else F.lit(0.0))
    for c, b in zip(features, map(float, model.coefficients)):
        z = z + F.lit(b) * F.col(c)
    miss = 1 / (1 + F.exp(-z)) - F.col("y")
    slopes = [F.sum(miss)] if model.intercept else []
    slopes += [F.sum(miss * (F.col(c) - mu[j]) / sd[j]) + penalty(at["n"]) * float(model.coefficients[j]) * sd[j] for j, c in enumerate(features)]
    terms = (["intercept"] if model.intercept else []) + features
    return rows.agg(F.count("*").alias("n"), *[s.alias(f"s{k}") for k, s in enumerate(slopes)]).select("n", F.inline(F.array(
        *[F.struct(F.lit(t).alias("term"), (F.round(F.col(f"s{k}"), 4) + 0.0).alias("slope")) for k, t in enumerate(terms)])))


def _terms(terms):
    return ", ".join(f"('{t}')" for t in terms)


@query("I2_ridge_optimality", f"""
SELECT term, 2 * count(*) AS n, CAST(0.0 AS DOUBLE) AS slope FROM {{scored}}, (VALUES {_terms(['intercept', *FEATS])}) v(term) GROUP BY term""")
def _(t):
    rows = ml.symmetrize(model_input(t), FLIP)
    fitted = ml.fit_many(rows, FEATS, [ml.Spec()])[0]
    return optimality(rows, FEATS, fitted, lambda n: 1 / ml.ENSEMBLE_C).select("term", "n", "slope")


def slopes_by_fold(rows, features, fitted, time, penalty, offset=None, centred=True):
    """One row per fold and term: the slope of the penalised loss of every fold's model, over the rows before the fold.

    The rows are summed per day first, for every model of a later fold in the same task; the models are broadcast, a few numbers each.
    """
    import numpy as np

    width = len(features) + 1
    models = as_arrays(fitted)
    shared = rows.sparkSession.sparkContext.broadcast(models)
    data = rows.select(*features, "y", F.col(time).alias("_t"), (F.col(offset) if offset else F.lit(0.0)).alias("_o"))

    def add(batches):
        import pandas as pd

        folds, beta = shared.value
        total, seen = np.zeros((len(folds), 1 + 3 * width)), False
        for batch in batches:
            seen = True
            batch = batch.sort_values("_t")
            x = np.column_stack([np.ones(len(batch)), *(batch[c].to_numpy(float) for c in features)])
            n = np.searchsorted(batch["_t"].to_numpy(float), folds, "left")
            for m in np.flatnonzero(n):
                xs = x[:n[m]]
                z = xs @ beta[m] + batch["_o"].to_numpy(float)[:n[m]]
                miss = 1 / (1 + np.exp(-z)) - batch["y"].to_numpy(float)[:n[m]]
                total[m] += np.concatenate([[n[m]], xs.sum(axis=0), (xs * xs).sum(axis=0), miss @ xs])
        if seen:
            yield pd.DataFrame(total, columns=[f"v{k}" for k in range(total.shape[1])]).assign(fold=folds)

    names = [f"v{k}" for k in range(1 + 3 * width)]
    sums = data.mapInPandas(add, ", ".join(f"{c} double" for c in names) + ", fold double").groupBy("fold").agg(*[F.sum(c).alias(c) for c in names])
    weights = rows.sparkSession.createDataFrame([(float(f), [float(v) for v in b]) for f, b in zip(*models)], "fold double, b array<double>")
    j = sums.join(weights, "fold").withColumn("n", F.col("v0"))
    cells = []
    for k, term in enumerate(["intercept", *features]):
        if k == 0 and not centred:
            continue
        mean = F.col(f"v{1 + k}") / F.col("n") if centred else F.lit(0.0)
        sd = F.sqrt(F.col(f"v{1 + width + k}") / F.col("n") - mean * mean)
        g, g0 = F.col(f"v{1 + 2 * width + k}"), F.col(f"v{1 + 2 * width}")
        slope = g if k == 0 else (g - mean * g0) / sd + penalty(F.col("n")) * F.col("b")[k] * sd
        cells.append(F.struct(F.lit(term).alias("term"), (F.round(slope, 4) + 0.0).alias("slope")))
    return j.select("fold", F.col("n").cast("long").alias("n"), F.inline(F.array(*cells)))


def as_arrays(fitted):
    import numpy as np

    return np.array([f.spec.fold for f in fitted]), np.array([[f.intercept, *f.coefficients] for f in fitted])


def by_day(t):
    return model_input(t).withColumn("day", F.datediff("date", F.lit("1970-01-01").cast("date")).cast("double"))


def every_date(t, rows, least: int):
    """Dates with at least ``least`` rows before them, as days: one fold each."""
    dates = rows.groupBy("day").agg(F.count("*").alias("n"))
    dates = dates.withColumn("before", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)))
    return [r.day for r in dates.filter(F.col("before") >= least).orderBy("day").toLocalIterator()]


LEAST = 100                     # rows that a model learns from
_FOLDS = f"""(SELECT date AS fold, before AS n FROM (SELECT date, sum(count(*)) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
FROM {{scored}} GROUP BY date) WHERE before >= {LEAST})"""


@query("I5_walk_forward_optimality", f"""
SELECT date_diff('day', DATE '1970-01-01', fold) * 1.0 AS fold, term, CAST(2 * n AS BIGINT) AS n, CAST(0.0 AS DOUBLE) AS slope FROM {_FOLDS}, (VALUES {_terms(['intercept', *FEATS])}) v(term)""")
def _(t):
    rows = by_day(t)
    folds, train = every_date(t, rows, LEAST), ml.symmetrize(rows, FLIP)
    fitted = ml.fit_many(train, FEATS, [ml.Spec(f) for f in folds], time="day")
    return slopes_by_fold(train, FEATS, fitted, "day", lambda n: 1 / ml.ENSEMBLE_C)


@query("I7_walk_forward_offset_optimality", f"""
SELECT date_diff('day', DATE '1970-01-01', fold) * 1.0 AS fold, term, CAST(n AS BIGINT) AS n, CAST(0.0 AS DOUBLE) AS slope FROM {_FOLDS}, (VALUES {_terms(OFF)}) v(term)""")
def _(t):
    rows = by_day(t)
    fitted = ml.fit_offset(rows, OFF, [ml.Spec(f) for f in every_date(t, rows, LEAST)], time="day")
    return slopes_by_fold(rows, OFF, fitted, "day", lambda n: ml.OFFSET_L2 * n, "line_logit", centred=False)


@query("I7_market_offset_optimality", """
SELECT term, count(*) AS n, CAST(0.0 AS DOUBLE) AS slope FROM {scored}, (VALUES ('d1'), ('d2'), ('d3')) v(term) GROUP BY term""")
def _(t):
    x = model_input(t)
    fitted = ml.fit_offset(x, OFF, [ml.Spec()])[0]
    return optimality(x, OFF, fitted, lambda n: ml.OFFSET_L2 * n, "line_logit", centred=False).select("term", "n", "slope")


# coefficients stated in the query, so that SQL can repeat the prediction
GIVEN = [[0.1, 0.8, -0.2, 0.3, -0.1, 0.05], [0.0, 0.9, -0.1, 0.2, 0.1, 0.0], [0.2, 0.7, 0.1, 0.4, -0.2, 0.1]]


def _given(sign: int) -> str:
    line, d1, d2 = "ln(q / (1 - q))", "((event_key * 37) % 101) / 50.0 - 1.0", "((event_key * 59) % 89) / 44.0 - 1.0"
    dots = [f"{m[0]} + {sign} * {m[1]} * {line} + {m[2]} * abs({line}) + {sign} * ({m[3]} * ({d1}) + {m[4]} * ({d2}) + {m[5]} * odds_a / 400.0)" for m in GIVEN]
    return ", ".join(f"1 / (1 + exp(-({d}))) AS {'p' if sign > 0 else 'q'}{k}" for k, d in enumerate(dots))


@query("I4_symmetric_prediction_given_weights", f"""
WITH s AS (SELECT event_key, odds_a, least(greatest(p_line, 0.02), 0.98) AS q FROM {{scored}}), p AS (SELECT event_key, {_given(1)}, {_given(-1)} FROM s),
m AS (SELECT event_key, (p0 + 1 - q0) / 2 AS a, (p1 + 1 - q1) / 2 AS b, (p2 + 1 - q2) / 2 AS c FROM p)
SELECT event_key, a AS p_model, sqrt((a * a + b * b + c * c) / 3 - ((a + b + c) / 3) ** 2) AS se FROM m""", "p_model se", 5)
def _(t):
    models = t.spark.createDataFrame([(None, GIVEN)], "fold double, models array<array<double>>")
    return ml.predict(model_input(t).drop("p_model", "se"), models, FEATS, FLIP, fold=None).select("event_key", "p_model", "se")


@query("I3_bootstrap_ensemble")
def _(t):
    fitted = ml.fit_many(ml.symmetrize(model_input(t), FLIP), FEATS, ml.ensemble_specs([None], [7], 30))
    rows = [(f.spec.tag, term, v) for f in fitted for term, v in zip(["intercept", *FEATS], [f.intercept, *map(float, f.coefficients)])]
    table = t.spark.createDataFrame(rows, "replicate int, term string, value double")
    return rounded(table.groupBy("term").agg(F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("value"),
                                             F.stddev_pop("value").alias("se")), "value", "se")


def slope_table(t, found, tag: str):
    rows = [(str(a), term, round(value, 4) + 0.0) for a, term, _, value in found]
    return t.spark.createDataFrame(rows, f"{tag} string, term string, slope double")


@query("I3_bootstrap_optimality", f"""
SELECT CAST(r AS VARCHAR) AS replicate, term, CAST(0.0 AS DOUBLE) AS slope FROM range(31) t(r), (VALUES {_terms(['intercept', *FEATS])}) v(term)
WHERE EXISTS (SELECT 1 FROM {{scored}})""")
def _(t):
    rows = ml.symmetrize(model_input(t), FLIP)
    fitted = ml.fit_many(rows, FEATS, ml.ensemble_specs([None], [7], 30))
    return slope_table(t, ml.slopes(rows, FEATS, fitted), "replicate")


@query("I4_symmetric_prediction")
def _(t):
    x = model_input(t)
    fitted = ml.fit_many(ml.symmetrize(x, FLIP), FEATS, ml.ensemble_specs([None], [7], 30))
    models = ml.model_table(t.spark, fitted)
    out = ml.predict(x.drop("p_model", "se"), models, FEATS, FLIP, fold=None)
    return rounded(out.select("event_key", "p_model", "se"), "p_model", "se")


def audit_dates(t, x):
    """Every event date of the audited period."""
    return ml.fold_starts(x, "date", start=AUDIT)


def audited(t, n_models=30):
    x = model_input(t).drop("p_model", "se")
    return ml.walk_forward(x, FEATS, FLIP, "date", audit_dates(t, x), n_models, min_train=LEAST)


@query("I5_walk_forward")
def _(t):
    return rounded(audited(t).select("event_key", "date", "fold", "p_model", "se"), "p_model", "se")


@query("I6_recency_weights", """
SELECT event_key, pow(0.5, date_diff('day', date, DATE '1999-01-01') / 365.25 / 4.0) AS w FROM {scored}""", "w")
def _(t):
    return t.scored.select("event_key", ml.recency_weight("date", F.lit("1999-01-01").cast("date"), 4.0).alias("w"))


@query("I6_recency_weighted_fit")
def _(t):
    day = F.datediff("date", F.lit("1970-01-01").cast("date")).cast("double")
    x = ml.symmetrize(model_input(t).withColumn("day", day), FLIP)
    at = float((dt.date(1998, 1, 1) - dt.date(1970, 1, 1)).days)
    fitted = ml.fit_many(x, FEATS, [ml.Spec(at, half_life_days=h * 365.25, tag=h) for h in (1, 4)], time="day")
    rows = [(float(f.spec.tag), term, v) for f in fitted for term, v in zip(FEATS, map(float, f.coefficients))]
    return rounded(t.spark.createDataFrame(rows, "half_life double, term string, value double"), "value")


@query("I7_market_offset")
def _(t):
    x = model_input(t).drop("p_model", "se")
    out = ml.walk_forward_offset(x, OFF, "date", audit_dates(t, x), 30)
    return rounded(out.select("event_key", "p_model", "se"), "p_model", "se")


_LW = " UNION ALL ".join(f"SELECT date, {w} AS weight, y, CAST({w} AS DOUBLE) * p_line + (1 - CAST({w} AS DOUBLE)) * p_model AS p FROM {{scored}}"
                         for w in ("0.0", "0.25", "0.5", "0.75", "0.9", "1.0"))


@query("I9_past_only_blend", f"""
WITH s AS (SELECT date, weight, sum({ll('y', 'p')}) AS loss, count(*) AS n FROM ({_LW}) GROUP BY 1, 2),
c AS (SELECT date, weight, sum(loss) OVER w AS loss, coalesce(sum(n) OVER w, 0) AS n FROM s WINDOW w AS (PARTITION BY weight ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT date, CASE WHEN max(n) >= 200 THEN arg_min(weight, (loss / n, -weight)) ELSE 1.0 END AS market_weight, CAST(max(n) AS BIGINT) AS history_rows,
  CASE WHEN max(n) >= 200 THEN 'prior_oof_log_loss' ELSE 'default_insufficient_history' END AS selection,
  CASE WHEN max(n) >= 200 THEN min(loss / n) END AS selected_log_loss FROM c GROUP BY date""", "market_weight selected_log_loss")
def _(t):
    return ml.past_only_blend(t.scored, "date", F.year("date"), current="p_model")


@query("I10_candidate_report")
def _(t):
    from duelmark.plans.audit import candidate_report

    x = audited(t).withColumnsRenamed({"p_model": "p_current", "se": "se_current"})
    off_x = model_input(t).drop("p_model", "se")
    off = ml.walk_forward_offset(off_x, OFF, "date", audit_dates(t, off_x), 30, prob="p_market_offset", se="se_market_offset")
    x = x.join(off.select("event_key", "p_market_offset", "se_market_offset"), "event_key")
    weights = ml.past_only_blend(x, "date", F.year("date"))
    x = x.join(weights.select("date", "market_weight"), "date")
    w = F.col("market_weight")
    x = x.withColumns({
        "p_fixed_50": 0.5 * F.col("p_line") + 0.5 * F.col("p_current"), "se_fixed_50": 0.5 * F.col("se_current"),
        "p_nested_blend": w * F.col("p_line") + (1 - w) * F.col("p_current"), "se_nested_blend": (1 - w) * F.col("se_current")})
    out = candidate_report(x, {"current_entry_refit": ("p_current", "se_current"), "market_offset": ("p_market_offset", "se_market_offset"),
                               "fixed_50_50": ("p_fixed_50", "se_fixed_50"), "nested_past_only_blend": ("p_nested_blend", "se_nested_blend")},
                           ["event_key"])
    return rounded(out, "log_loss", "log_loss_market", "pnl", "roi")


@query("I10_candidates_given_probabilities", f"""
WITH l AS ({_LW}), g AS (SELECT date, weight, sum({ll('y', 'p')}) AS loss, count(*) AS n FROM l GROUP BY 1, 2),
c AS (SELECT date, weight, sum(loss) OVER w AS loss, coalesce(sum(n) OVER w, 0) AS n FROM g WINDOW w AS (PARTITION BY weight ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT date, CASE WHEN max(n) >= 200 THEN arg_min(weight, (loss / n, -weight)) ELSE 1.0 END AS mw FROM c GROUP BY date),
v AS (SELECT x.*, mw, unnest(['current_entry_refit', 'fixed_50_50', 'nested_past_only_blend']) AS candidate, unnest([CAST(0.0 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(mw AS DOUBLE)]) AS w FROM {{scored}} x JOIN b USING (date)),
p AS (SELECT * EXCLUDE (p_model, se), w * p_line + (1 - w) * p_model AS p, (1 - w) * se AS s FROM v),
e AS (SELECT *, greatest(p - pr_raw, (1 - p) - pb_raw) - s AS net, CASE WHEN p - pr_raw >= (1 - p) - pb_raw THEN 'A' ELSE 'B' END AS side FROM p),
k AS (SELECT *, CASE WHEN net >= CAST(0.04 AS DOUBLE) AND row_number() OVER (PARTITION BY candidate, date, net >= CAST(0.04 AS DOUBLE) ORDER BY net DESC, event_key) <= 2 THEN 1 ELSE 0 END AS stake FROM e),
m AS (SELECT *, stake * CASE WHEN (side = 'A') = (y = 1) THEN CASE WHEN side = 'A' THEN {profit('odds_a')} ELSE {profit('odds_b')} END ELSE -1.0 END AS pnl FROM k)
SELECT candidate, count(DISTINCT date) AS events, count(*) AS contests, count(*) FILTER (WHERE stake > 0) AS bets, CAST(sum(stake) AS DOUBLE) AS staked, sum(pnl) AS pnl,
  avg({ll('y', 'p')}) AS log_loss, avg({ll('y', 'p_line')}) AS log_loss_market, sum(pnl) / sum(stake) AS roi FROM m GROUP BY 1""", "staked pnl log_loss log_loss_market roi", 5)
def _(t):
    from duelmark.plans.audit import candidate_report

    x = t.scored.withColumnsRenamed({"p_model": "p_current", "se": "se_current"})
    x = x.join(ml.past_only_blend(x, "date", F.year("date")).select("date", "market_weight"), "date")
    for name, w in (("fixed", F.lit(0.5)), ("nested", F.col("market_weight"))):
        x = x.withColumns({f"p_{name}": w * F.col("p_line") + (1 - w) * F.col("p_current"), f"se_{name}": (1 - w) * F.col("se_current")})
    return candidate_report(x, {"current_entry_refit": ("p_current", "se_current"), "fixed_50_50": ("p_fixed", "se_fixed"),
                                "nested_past_only_blend": ("p_nested", "se_nested")}, ["event_key"])


# least squares under order: fitted values never fall, and over each run of equal ones they are the mean of the labels
@query("I11_calibration_optimality", """
SELECT * FROM (VALUES ('platt_intercept', CAST(0.0 AS DOUBLE)), ('platt_slope', 0.0), ('isotonic_falls', 0.0), ('isotonic_gaps', 0.0)) v(chk, value) WHERE EXISTS (SELECT 1 FROM {scored})""")
def _(t):
    train = t.stored("scored").filter("date < DATE '1997-01-01'")
    out = materialize(ml.calibrate(train, ml.fit_calibrators(train)), "calibrated")
    z = F.ln(F.col("p_model") / (1 - F.col("p_model")))
    miss = F.col("p_platt") - F.col("y")
    # one row per distinct probability
    steps = out.groupBy("p_model").agg(F.max("p_isotonic").alias("p"), F.sum("y").alias("y"), F.count("*").alias("n"))
    falls = steps.withColumn("before", F.lag("p").over(Window.orderBy("p_model"))).agg(F.count_if(F.col("before") > F.col("p") + 1e-12).alias("falls"))
    runs = steps.withColumn("run", F.round("p", 9)).groupBy("run").agg(F.abs(F.sum("y") - F.sum(F.col("p") * F.col("n"))).alias("gap"))
    gaps = runs.agg(F.max("gap").alias("gaps"))
    one = out.agg(F.avg(miss).alias("a"), F.avg(miss * z).alias("b")).withColumns({"c": falls.select("falls").scalar(), "d": gaps.select("gaps").scalar()})
    cells = [F.struct(F.lit(name).alias("chk"), (F.round(F.col(c).cast("double"), 4) + 0.0).alias("value"))
             for name, c in (("platt_intercept", "a"), ("platt_slope", "b"), ("isotonic_falls", "c"), ("isotonic_gaps", "d"))]
    return one.select(F.inline(F.array(*cells)))


@query("I11_calibration")
def _(t):
    s = t.stored("scored")
    cal = ml.fit_calibrators(s.filter("date < DATE '1997-01-01'"))
    return rounded(ml.calibrate(s, cal).select("event_key", "p_model", "p_platt", "p_isotonic"), "p_platt", "p_isotonic")


METHOD_FEATS = ["w_ko_rate", "w_sub_rate", "w_dec_rate", "w_n", "l_ko_l", "l_sub_l"]


def method_rows(t):
    """Winner-frame features per decided contest."""
    from duelmark.catalog.history import method_rates
    from duelmark.plans.features import winner_frame
    from duelmark.session import materialize

    rates = materialize(method_rates(t), "method-rates")
    return winner_frame(rates.filter("winner IN ('A', 'B')"), F.col("winner")).withColumn("method_class", method_class("method"))


@query("I12_method_model")
def _(t):
    rows = method_rows(t).filter("method_class <> 'OTHER'")
    model, classes = ml.method_model(rows, METHOD_FEATS)
    out = ml.method_probabilities(model, rows, classes)
    return rounded(out.select("bout_id", *[f"p_{c}" for c in classes]), *[f"p_{c}" for c in classes])


# of the penalised multinomial loss per row, on features over their sample deviation
@query("I12_method_optimality", f"""
SELECT class, term, CAST(0.0 AS DOUBLE) AS slope FROM (VALUES ('DEC'), ('KO'), ('SUB')) c(class), (VALUES {_terms(METHOD_FEATS)}) v(term) WHERE EXISTS (SELECT 1 FROM {{bouts}})""")
def _(t):
    rows = materialize(method_rows(t).filter("method_class <> 'OTHER'"), "method-rows")
    model, classes = ml.method_model(rows, METHOD_FEATS)
    scored = ml.method_probabilities(model, rows, classes)
    at = rows.agg(F.count("*").alias("n"), *[F.stddev_samp(f).alias(f) for f in METHOD_FEATS]).first()
    weights = model.stages[-1].coefficientMatrix.toArray()
    cells = [F.struct(F.lit(c).alias("class"), F.lit(f).alias("term"), (F.round(
        F.avg((F.col(f"p_{c}") - (F.col("method_class") == c).cast("double")) * F.col(f)) / at[f] + F.lit(float(weights[i][j] * at[f] / (0.3 * at["n"]))), 3) + 0.0).alias("slope"))
        for i, c in enumerate(classes) for j, f in enumerate(METHOD_FEATS)]
    return scored.agg(F.array(*cells).alias("c")).select(F.inline("c"))


@query("I13_fair_prices_given_rates", """
SELECT bout_id, side, method, CAST(round_even(CASE WHEN q >= 0.5 THEN -100.0 * q / (1.0 - q) ELSE 100.0 * (1.0 - q) / q END, 0) AS BIGINT) AS fair_price FROM (
  SELECT bout_id, side, method, least(greatest(p * share, CAST(0.005 AS DOUBLE)), CAST(0.995 AS DOUBLE)) AS q FROM (
    SELECT bout_id, s AS side, m AS method, share, CASE WHEN s = 'A' THEN CAST(0.2 AS DOUBLE) + (bout_id % 60) / CAST(100.0 AS DOUBLE) ELSE 1 - (CAST(0.2 AS DOUBLE) + (bout_id % 60) / CAST(100.0 AS DOUBLE)) END AS p
    FROM {bouts}, (VALUES ('A'), ('B')) a(s), (VALUES ('KO', CAST(0.3 AS DOUBLE)), ('SUB', CAST(0.2 AS DOUBLE)), ('DEC', CAST(0.5 AS DOUBLE))) c(m, share)))""")
def _(t):
    p = 0.2 + (F.col("bout_id") % 60) / 100.0
    cells = F.array(*[F.struct(F.lit(side).alias("side"), F.lit(m).alias("method"), fair_american(q * share).alias("fair_price"))
                      for side, q in (("A", p), ("B", 1 - p)) for m, share in (("KO", 0.3), ("SUB", 0.2), ("DEC", 0.5))])
    return t.bouts.select("bout_id", F.inline(cells))


@query("I14_method_prior", """
WITH r AS (SELECT bout_ts, CASE WHEN method LIKE '%KO%' THEN 'KO' WHEN method LIKE '%SUB%' THEN 'SUB' ELSE 'DEC' END AS m FROM {bouts} WHERE winner IN ('A', 'B')),
s AS (SELECT m, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM r WHERE bout_ts < TIMESTAMP '2024-01-20' GROUP BY m)
SELECT (SELECT count(*) FROM r WHERE bout_ts < TIMESTAMP '2024-01-20') AS train_rows, count(*) AS test_rows, avg(-ln(p)) AS log_loss_prior FROM r JOIN s USING (m) WHERE bout_ts >= TIMESTAMP '2024-01-20'""", "log_loss_prior")
def _(t):
    from duelmark.plans.audit import method_prior

    rows = t.bouts.filter("winner IN ('A', 'B')").withColumn("method_class", method_class("method"))
    cut = F.col("bout_ts") < F.lit("2024-01-20").cast("timestamp_ntz")
    return method_prior(rows.filter(cut), rows.filter(~cut))


@query("I13_method_fair_prices")
def _(t):
    from duelmark.catalog.history import method_rates
    from duelmark.plans.features import winner_frame
    from duelmark.session import materialize

    rates = materialize(method_rates(t), "method-rates")
    train = winner_frame(rates.filter("winner IN ('A', 'B')"), F.col("winner")).withColumn("method_class", method_class("method"))
    model, classes = ml.method_model(train.filter("method_class <> 'OTHER'"), METHOD_FEATS)
    p_win = 0.2 + (F.col("bout_id") % 60) / 100.0
    parts = []
    for side, p in (("A", p_win), ("B", 1 - p_win)):
        probs = ml.method_probabilities(model, winner_frame(rates, F.lit(side)), classes)
        cells = F.array(*[F.struct(F.lit(c).alias("method"), fair_american(p * F.col(f"p_{c}")).alias("fair_price")) for c in classes])
        parts.append(probs.select("bout_id", F.lit(side).alias("side"), F.explode(cells).alias("c")).select("bout_id", "side", "c.*"))
    return parts[0].unionByName(parts[1])


@query("I14_method_audit")
def _(t):
    from duelmark.plans.audit import method_audit

    rows = method_rows(t).filter("method_class <> 'OTHER'")
    cut = "bout_ts < TIMESTAMP_NTZ '2024-01-20'"
    model, classes = ml.method_model(rows.filter(cut), METHOD_FEATS)
    return rounded(method_audit(model, rows.filter(cut), rows.filter(f"NOT ({cut})"), classes),
                   "log_loss_model", "log_loss_prior", "accuracy_model")


@query("I15_boosted_baseline")
def _(t):
    x = model_input(t).withColumn("is_validation", F.col("event_key") % 7 == 0)
    train = ml.symmetrize(x.filter("date < DATE '1997-01-01'"), FLIP)
    model = ml.gbt_baseline(train, FEATS)
    test = x.filter("date >= DATE '1997-01-01'")
    out = ml.model_probability(model, test, FEATS, "p_gbt")
    return rounded(out.agg(F.count(F.lit(1)).alias("n"), *ev.prob_metrics("y", "p_gbt")), "log_loss", "brier", "accuracy")


SETS = {"line_only": (0,), "line_and_abs": (0, 1), "line_d1": (0, 2), "all": tuple(range(len(FEATS)))}


def ablated(t):
    cut = float((dt.date(1997, 1, 1) - dt.date(1970, 1, 1)).days)
    rows = ml.symmetrize(by_day(t), FLIP)
    return rows, ml.fit_many(rows, FEATS, [ml.Spec(cut, subset=s, tag=n) for n, s in SETS.items()], time="day")


_USED = ", ".join(f"('{n}', '{term}')" for n, s in SETS.items() for term in ["intercept", *(FEATS[j] for j in s)])


@query("I16_ablation_optimality", f"""
SELECT feature_set, term, CAST(0.0 AS DOUBLE) AS slope FROM (VALUES {_USED}) v(feature_set, term) WHERE EXISTS (SELECT 1 FROM {{scored}})""")
def _(t):
    rows, fitted = ablated(t)
    return slope_table(t, ml.slopes(rows, FEATS, fitted, time="day"), "feature_set")


@query("I16_feature_ablation")
def _(t):
    x = model_input(t)
    _, fitted = ablated(t)
    # one row per feature set; the models are compared in one scan of the test rows
    table = [(f.spec.tag, [f.intercept, *map(float, f.coefficients)]) for f in fitted]
    variants = F.array(*[F.struct(F.lit(n).alias("feature_set"), F.array(*[F.lit(v) for v in m]).alias("m")) for n, m in table])
    test = x.filter("date >= DATE '1997-01-01'").withColumn("v", F.explode(variants)).select(*x.columns, "v.*")
    eta = F.col("m")[0]
    for i, c in enumerate(FEATS, 1):
        eta = eta + F.col("m")[i] * F.col(c)
    scored = test.withColumn("p", 1 / (1 + F.exp(-eta)))
    return rounded(scored.groupBy("feature_set").agg(F.count(F.lit(1)).alias("n"), *ev.prob_metrics("y", "p")), "log_loss", "brier", "accuracy")


def card_rows(t):
    x = model_input(t).drop("p_model", "se").withColumns({
        "quote_age_minutes": (F.col("event_key") % 500).cast("double"), "odds_source": F.lit("the-odds-api-live"),
        "best_odds_a": F.when(F.col("event_key") % 3 != 0, F.col("odds_a") + 5), "best_odds_b": F.when(F.col("event_key") % 4 != 0, F.col("odds_b") + 5)})
    return x.filter("date < DATE '1998-01-01'"), x.filter("date >= DATE '1998-01-01'")


@query("K4_card_scoring")
def _(t):
    from duelmark.plans.card import score_card

    train, card = card_rows(t)
    fitted = ml.fit_many(ml.symmetrize(train, FLIP), FEATS, ml.ensemble_specs([None], [5], 30))
    out = score_card(card, ml.model_table(t.spark, fitted), FEATS, FLIP, ["event_key"], books="n_books", execution=("best_odds_a", "best_odds_b"))
    return rounded(out.select("event_key", "date", "pick_side", "stake", "net_edge", "eligibility_reason"), "net_edge")


_CARD = f"""(WITH s AS (SELECT *, least(greatest(p_line, 0.02), 0.98) AS q, CASE WHEN event_key % 3 <> 0 THEN odds_a + 5 ELSE odds_a END AS ea, CASE WHEN event_key % 4 <> 0 THEN odds_b + 5 ELSE odds_b END AS eb
  FROM {{scored}} WHERE date >= DATE '1998-01-01'), p AS (SELECT event_key, date, n_books, ea, eb, {_given(1)}, {_given(-1)} FROM s),
m AS (SELECT *, (p0 + 1 - q0) / 2 AS a, (p1 + 1 - q1) / 2 AS b, (p2 + 1 - q2) / 2 AS c FROM p),
e AS (SELECT *, sqrt((a * a + b * b + c * c) / 3 - ((a + b + c) / 3) ** 2) AS se, a - {imp('ea')} AS edge_a, 1 - a - {imp('eb')} AS edge_b, event_key % 500 <= 360 AS fresh FROM m),
n AS (SELECT *, CASE WHEN edge_a >= edge_b THEN 'A' ELSE 'B' END AS pick_side, greatest(edge_a, edge_b) - se AS net_edge, n_books >= 3 AND fresh AS ok FROM e),
k AS (SELECT *, CASE WHEN net_edge >= CAST(0.04 AS DOUBLE) AND ok AND row_number() OVER (PARTITION BY date, net_edge >= CAST(0.04 AS DOUBLE) AND ok ORDER BY net_edge DESC, event_key) <= 2 THEN 1 ELSE 0 END AS stake FROM n)
SELECT *, CASE WHEN net_edge >= CAST(0.04 AS DOUBLE) AND ok THEN CASE WHEN stake = 0 THEN 'event-day exposure cap' ELSE 'eligible' END
  WHEN NOT fresh THEN 'price stale' WHEN n_books < 3 THEN 'fewer than 3 paired books' ELSE 'below edge rule' END AS eligibility_reason FROM k)"""


def given_card(t):
    from duelmark.plans.card import score_card

    models = t.spark.createDataFrame([(None, GIVEN)], "fold double, models array<array<double>>")
    return score_card(card_rows(t)[1], models, FEATS, FLIP, ["event_key"], books="n_books", execution=("best_odds_a", "best_odds_b"))


@query("K4_card_given_weights", f"SELECT event_key, date, pick_side, stake, net_edge, eligibility_reason FROM {_CARD}", "net_edge", 5)
def _(t):
    return given_card(t).select("event_key", "date", "pick_side", "stake", "net_edge", "eligibility_reason")


@query("K4_card_execution_ladder", f"""
SELECT event_key, tier, CAST(ceil(CASE WHEN p >= 0.5 THEN -100 * p / (1 - p) ELSE 100 * (1 - p) / p END) AS BIGINT) AS worst_price FROM (
  SELECT event_key, tier, CASE WHEN pick_side = 'A' THEN a ELSE 1 - a END - se - least_edge AS p FROM {_CARD}, (VALUES ('1u', CAST(0.04 AS DOUBLE)), ('2u_candidate', CAST(0.1 AS DOUBLE))) v(tier, least_edge))
WHERE p BETWEEN 0.02 AND 0.98""")
def _(t):
    from duelmark.operators.betting import execution_ladder

    card = given_card(t).withColumn("p_pick", F.when(F.col("pick_side") == "A", F.col("p_model")).otherwise(1 - F.col("p_model")))
    return execution_ladder(card, "p_pick", "se").select("event_key", "tier", F.col("worst_price").cast("long").alias("worst_price"))


STATE = {"n": pit.prior_count(), "mean": pit.prior_mean("value"), "best": pit.prior_max("value"), "run": pit.streak("won"), "last3": pit.last_mean("value", 3),
         "before": pit.previous("value")}


@query("K4_entity_states", """
SELECT entity, count(*) AS n, avg(value) AS mean, max(value) AS best, count(*) - coalesce(max(CASE WHEN NOT won THEN pos END), 0) AS run,
  avg(value) FILTER (WHERE pos > n - 3) AS last3, max(CASE WHEN pos = n THEN value END) AS before
FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY time, seq) AS pos, count(*) OVER (PARTITION BY entity) AS n FROM {history}) GROUP BY entity""", "mean best last3 before")
def _(t):
    # the history in two parts: the states of the first are stored and updated by the second
    first, later = t.history.filter("time < TIMESTAMP_NTZ '2024-01-16'"), t.history.filter("time >= TIMESTAMP_NTZ '2024-01-16'")
    states = materialize(es.entity_states(first, "entity", "time", "seq", STATE), "states")
    states = es.update_states(states, later, "entity", "time", "seq", STATE)
    return es.next_features(states.select("entity"), states, "entity", STATE).select("entity", *STATE)


# the next contest of every entity is against the one with the next larger id; method shares are those of its kinds of event
_METHODS = """(SELECT user_id AS entity, count(*) FILTER (WHERE event_type = 'error') * 1.0 / count(*) AS ko, count(*) FILTER (WHERE event_type = 'purchase') * 1.0 / count(*) AS sub,
  count(*) FILTER (WHERE event_type NOT IN ('error', 'purchase')) * 1.0 / count(*) AS dec, avg(value) AS mean FROM events GROUP BY 1)"""


@query("K4_hypothetical_method_prices", f"""
WITH s AS {_METHODS}, c AS (SELECT a.entity AS a, b.entity AS b, 1 / (1 + exp(-(a.mean - b.mean) / 10)) AS p, a.ko AS ako, a.sub AS asub, a.dec AS adec, b.ko AS bko, b.sub AS bsub, b.dec AS bdec
  FROM s a JOIN s b ON b.entity = a.entity + 1),
r AS (SELECT a, b, 'A' AS side, unnest(['KO', 'SUB', 'DEC']) AS method, unnest([p * ako, p * asub, p * adec]) AS q FROM c
  UNION ALL SELECT a, b, 'B', unnest(['KO', 'SUB', 'DEC']), unnest([(1 - p) * bko, (1 - p) * bsub, (1 - p) * bdec]) FROM c)
SELECT a, b, side, method, greatest(least(q, 0.995), 0.005) AS p FROM r""", "p")
def _(t):
    shares = {"ko": F.col("event_type") == "error", "sub": F.col("event_type") == "purchase", "dec": ~F.col("event_type").isin("error", "purchase")}
    rows = t.history.withColumns({k: v.cast("double") for k, v in shares.items()})
    features = {"mean": pit.prior_mean("value"), **{k: pit.prior_mean(k) for k in shares}}
    states = materialize(es.entity_states(rows, "entity", "time", "seq", features), "states")
    card = states.select(F.col("entity").alias("entity_a"), (F.col("entity") + 1).alias("entity_b"))
    card = card.join(states.select(F.col("entity").alias("entity_b")), "entity_b")
    for side in ("_a", "_b"):
        card = es.next_features(card, states, "entity", features, side)
    p = 1 / (1 + F.exp(-(F.col("mean_a") - F.col("mean_b")) / 10))
    cells = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(m.upper()).alias("method"), (w * F.col(f"{m}_{s.lower()}")).alias("q"))
                      for s, w in (("A", p), ("B", 1 - p)) for m in shares])
    out = card.select(F.col("entity_a").alias("a"), F.col("entity_b").alias("b"), F.inline(cells))
    return out.select("a", "b", "side", "method", F.greatest(F.least("q", F.lit(0.995)), F.lit(0.005)).alias("p"))
