import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelmark.operators import models as ml


def data(n=240, p=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * np.array([1.0, 3.0, 0.2])[:p] + 0.5
    y = (x[:, 0] * 0.8 - x[:, 1] * 0.2 + rng.normal(size=n) > 0.3).astype(int)
    return x, y


def frame(spark, x, y, extra=None):
    names = [f"f{i}" for i in range(x.shape[1])]
    rows = [(i, *map(float, r), int(t), *(map(float, extra[i]) if extra is not None else ())) for i, (r, t) in enumerate(zip(x, y))]
    cols = "row_key long, " + ", ".join(f"{n} double" for n in names) + ", y int" + (", t double, off double" if extra is not None else "")
    return spark.createDataFrame(rows, cols), names


def newton(x, y, penalty, intercept=True, offset=None, w=None, scale="standard"):
    w = np.ones(len(y)) if w is None else w
    mu = np.average(x, axis=0, weights=np.ones(len(y))) if scale == "standard" else np.zeros(x.shape[1])
    sd = x.std(axis=0) if scale == "standard" else np.sqrt((x ** 2).mean(axis=0))
    z = np.column_stack([np.ones(len(y)), (x - mu) / sd])
    on = np.arange(0 if intercept else 1, z.shape[1])
    b = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], penalty)
    ridge[0] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(z @ b + (0 if offset is None else offset))))
        g = z.T @ (w * (y - p)) - ridge * b
        h = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        b[on] += np.linalg.solve(h[np.ix_(on, on)], g[on])
    return b


def test_fit_equals_plain_newton(spark):
    x, y = data()
    df, names = frame(spark, x, y)
    f = ml.fit_many(df, names, [ml.Spec(), ml.Spec(subset=(0, 2))], penalty=1 / 0.05)
    want = newton(x, y, 20.0)
    assert np.allclose(f[0].standardized, want[1:], atol=1e-9)
    raw = want[1:] / x.std(axis=0)
    assert np.allclose(f[0].coefficients, raw, atol=1e-9)
    assert abs(f[0].intercept - (want[0] - (raw * x.mean(axis=0)).sum())) < 1e-9
    sub = newton(x[:, [0, 2]], y, 20.0)
    assert np.allclose(f[1].standardized[[0, 2]], sub[1:], atol=1e-9) and f[1].standardized[1] == 0


def test_folds_use_strictly_earlier_rows_and_recency(spark):
    x, y = data()
    t = np.arange(len(y)) // 20
    df, names = frame(spark, x, y, np.column_stack([t, np.zeros(len(y))]))
    f = ml.fit_many(df, names, [ml.Spec(6.0), ml.Spec(6.0, half_life_days=2.0)], time="t", penalty=2.0)
    past = t < 6
    assert np.allclose(f[0].standardized, newton(x[past], y[past], 2.0)[1:], atol=1e-9) and f[0].n == past.sum()
    w = 0.5 ** ((6.0 - t[past]) / 2.0)
    assert np.allclose(f[1].standardized, newton(x[past], y[past], 2.0, w=w)[1:], atol=1e-9)


def test_mllib_ridge_agrees(spark):
    x, y = data()
    df, names = frame(spark, x, y)
    m = ml.ridge_logistic(df, names, c=0.05)
    f = ml.fit_many(df, names, [ml.Spec()], penalty=20.0)[0]
    assert np.allclose(m.coefficients.toArray(), f.coefficients, rtol=5e-3)


def test_bootstrap_is_reproducible_and_spread_is_plausible(spark):
    x, y = data(400)
    df, names = frame(spark, x, y)
    specs = ml.ensemble_specs([None], [7], 40)
    a = ml.fit_many(df, names, specs, penalty=1.0)
    b = ml.fit_many(df.repartition(5), names, specs, penalty=1.0)
    assert np.allclose([f.coefficients for f in a], [f.coefficients for f in b], atol=1e-8)
    sizes = np.array([f.n for f in a[1:]])
    assert abs(sizes.mean() - 400) < 15 and 10 < sizes.std() < 32
    rng = np.random.default_rng(1)
    plain = []
    for _ in range(60):
        i = rng.integers(0, 400, 400)
        plain.append(newton(x[i], y[i], 1.0)[1:] / x[i].std(axis=0))
    ours = np.std([f.coefficients for f in a[1:]], axis=0)
    assert np.all(ours / np.std(plain, axis=0) > 0.6) and np.all(ours / np.std(plain, axis=0) < 1.6)


def test_prediction_is_symmetric(spark):
    x, y = data()
    df, names = frame(spark, x, y)
    sym = ml.symmetrize(df, names)
    assert sym.count() == 2 * df.count() and sym.select("row_key").distinct().count() == sym.count()
    models = ml.model_table(spark, ml.fit_many(sym, names, ml.ensemble_specs([None], [1], 3)))
    flipped = df.withColumns({n: -F.col(n) for n in names})
    p = ml.predict(df, models, names, names, fold=None).orderBy("row_key").collect()
    q = ml.predict(flipped, models, names, names, fold=None).orderBy("row_key").collect()
    assert all(abs(a.p_model + b.p_model - 1) < 1e-10 and a.se > 0 for a, b in zip(p, q))


@pytest.mark.parametrize("offset", [None, "off"])
def test_an_ensemble_without_folds_scores_by_batch(spark, offset):
    """The same probabilities as by a join with one fold, for missing, undefined and extreme values, too; one matrix product, not 31 interpreted sums a row."""
    values = [(1.0, 2.0, 0.5), (None, 1.0, 0.1), (float("nan"), 1.0, 0.1), (900.0, -3.0, 0.0), (-900.0, 3.0, None), (0.0, 0.0, 0.0)]
    df = spark.createDataFrame([(k, *v) for k, v in enumerate(values)], "id int, f0 double, f1 double, off double")
    weights = np.random.default_rng(5).normal(size=(31, 3)).tolist()
    one = spark.createDataFrame([(None, weights)], "fold double, models array<array<double>>")
    got = ml.predict(df, one, ["f0", "f1"], ["f0"], offset=offset, fold=None)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "transform(" not in plan
    joined = ml.predict(df.withColumn("fold", F.lit(1.0)), one.withColumn("fold", F.lit(1.0)), ["f0", "f1"], ["f0"], offset=offset)
    def read(out):
        return [(r.p_model, r.se) for r in out.orderBy("id").collect()]

    for a, b in zip(read(got), read(joined), strict=True):
        assert (a[0] is None) == (b[0] is None) and (a[0] is None or np.allclose(a, b, rtol=0, atol=1e-14, equal_nan=True))
    none = ml.predict(df, one.filter("false"), ["f0", "f1"], ["f0"], offset=offset, fold=None)
    assert read(none) == [(None, None)] * len(values)
    with pytest.raises(ValueError, match="one row"):
        ml.predict(df, one.union(one), ["f0", "f1"], ["f0"], offset=offset, fold=None)


def test_offset_zero_correction_is_the_market(spark):
    off = np.array([-1.2, -0.8, -0.4, -0.1, 0.1, 0.4, 0.8, 1.2])
    y = np.array([0, 0, 0, 1, 0, 1, 1, 1])
    df, names = frame(spark, np.zeros((8, 3)), y, np.column_stack([np.zeros(8), off]))
    f = ml.fit_offset(df, names, [ml.Spec()], offset="off")
    out = ml.predict(df, ml.model_table(spark, f), names, None, offset="off", fold=None).orderBy("row_key").collect()
    assert np.allclose([r.p_model for r in out], 1 / (1 + np.exp(-off)), atol=1e-12)


def test_offset_matches_newton_and_corner_swap(spark):
    x, y = data(150)
    off = np.random.default_rng(2).normal(size=150)
    df, names = frame(spark, x, y, np.column_stack([np.zeros(150), off]))
    f = ml.fit_offset(df, names, [ml.Spec()], offset="off", l2=0.02)
    assert np.allclose(f[0].standardized, newton(x, y, 0.02 * 150, intercept=False, offset=off, scale="rms")[1:], atol=1e-9)
    table = ml.model_table(spark, f)
    swapped = df.withColumns({**{n: -F.col(n) for n in names}, "off": -F.col("off")})
    p = ml.predict(df, table, names, None, offset="off", fold=None).orderBy("row_key").collect()
    q = ml.predict(swapped, table, names, None, offset="off", fold=None).orderBy("row_key").collect()
    assert all(abs(a.p_model + b.p_model - 1) < 1e-12 for a, b in zip(p, q))


def test_future_rows_cannot_change_the_blend_weight(spark):
    prior = [(dt.date(2025, 1, d), y, pl, pc) for d, y, pl, pc in ((1, 1, .75, .55), (2, 0, .25, .45), (3, 1, .70, .52), (4, 0, .30, .48))]
    future = [(dt.date(2025, 2, 1), i % 2, .99 if i % 2 == 0 else .01, .01 if i % 2 == 0 else .99) for i in range(20)]
    at = [(dt.date(2025, 1, 10), 1, 0.5, 0.5)]
    schema = "d date, y int, p_line double, p_current double"

    def weight(rows):
        out = ml.past_only_blend(spark.createDataFrame(rows, schema), "d", F.year("d"), grid=(0.0, 0.5, 1.0), min_history=4)
        return out.filter("d = DATE '2025-01-10'").first()

    a, b = weight(prior + at), weight(prior + at + future)
    assert a.market_weight == b.market_weight == 1.0 and a.history_rows == b.history_rows == 4
    assert ml.past_only_blend(spark.createDataFrame(prior, schema), "d", F.year("d"), min_history=200).first().market_weight == 1.0


def test_walk_forward_predicts_from_the_right_fold(spark):
    x, y = data(200)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i // 5) for i in range(200)]
    rows = [(i, *map(float, r), int(t), d) for i, (r, t, d) in enumerate(zip(x, y, days))]
    df = spark.createDataFrame(rows, "row_key long, f0 double, f1 double, f2 double, y int, date date")
    folds = [dt.date(2024, 1, 11), dt.date(2024, 1, 25)]
    names = ["f0", "f1", "f2"]
    out = ml.walk_forward(df, names, names, "date", folds, 2, min_train=10).collect()
    assert {r.row_key for r in out} == {i for i in range(200) if days[i] >= folds[0]}
    assert all(r.fold == max(f for f in folds if f <= r.date) for r in out)
    # later labels cannot change earlier predictions
    changed = df.withColumn("y", F.when(F.col("date") >= F.lit(folds[1]), 1 - F.col("y")).otherwise(F.col("y")))
    again = {r.row_key: r.p_model for r in ml.walk_forward(changed, names, names, "date", folds, 2, min_train=10).collect()}
    assert all(abs(again[r.row_key] - r.p_model) < 1e-12 for r in out)
    with pytest.raises(ValueError):
        ml.walk_forward(df, names, names, "date", folds, 2, min_train=10_000)


def test_period_elo_equals_sequential_when_nobody_plays_twice(spark):
    import random

    from duelmark.operators.ratings import period_elo, pool_elo

    rng = random.Random(4)
    bouts = []
    for day in range(6):
        people = [f"p{i}" for i in range(10)]
        rng.shuffle(people)
        for k in range(0, 10, 2):
            bouts.append((len(bouts), dt.date(2024, 1, 1 + day), people[k], people[k + 1], rng.choice(["A", "B", "draw"]),
                          rng.choice(["KO/TKO", "DEC", "SUB", None]), "all"))
    ratings, want = {}, {}
    for i, _, a, b, w, m, _ in bouts:
        ra, rb = ratings.get(a, 1500.0), ratings.get(b, 1500.0)
        want[i] = (ra, rb)
        k = 32 + (8 if m in ("KO/TKO", "SUB") else 0)
        d = k * ({"A": 1, "B": 0, "draw": 0.5}[w] - 1 / (1 + 10 ** ((rb - ra) / 400)))
        ratings[a], ratings[b] = ra + d, rb - d
    df = spark.createDataFrame(bouts, "id int, day date, a string, b string, winner string, method string, pool string")
    out, final = period_elo(df, "id", "day", "a", "b", "winner", "method", checkpoint_every=4)
    for r in out.collect():
        assert abs(r.elo_a_pre - want[r.id][0]) < 1e-9 and abs(r.elo_b_pre - want[r.id][1]) < 1e-9
    assert {r.entity: round(r.rating, 9) for r in final.collect()} == {k: round(v, 9) for k, v in ratings.items()}
    for r in pool_elo(df, "pool", "day", "id", "id", "a", "b", "winner", "method").collect():
        assert abs(r.elo_a_pre - want[r.id][0]) < 1e-9


def test_offset_predictions_ignore_the_future(spark):
    import datetime as dt

    rng = np.random.default_rng(3)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(120)]
    rows = [(i, d, float(rng.normal()), float(rng.normal()), int(rng.integers(0, 2))) for i, d in enumerate(days)]
    folds = [dt.date(2020, 2, 1), dt.date(2020, 3, 1), dt.date(2020, 4, 1)]
    schema = "row_key long, date date, line_logit double, d1 double, y int"
    past = ml.walk_forward_offset(spark.createDataFrame(rows, schema), ["d1"], "date", folds, 3)
    changed = [(i, d, o, -x, 1 - y) if d >= folds[2] else (i, d, o, x, y) for i, d, o, x, y in rows]
    again = ml.walk_forward_offset(spark.createDataFrame(changed, schema), ["d1"], "date", folds, 3)
    keep = {r.row_key: (r.p_model, r.se) for r in past.filter("date < '2020-04-01'").collect()}
    assert len(keep) == sum(folds[0] <= d < folds[2] for d in days)
    assert keep == {r.row_key: (r.p_model, r.se) for r in again.filter("date < '2020-04-01'").collect()}


def test_many_models_are_fitted_block_by_block(spark, monkeypatch):
    x, y = data(200)
    df, names = frame(spark, x, y)
    specs = ml.ensemble_specs([None], [5], 6)
    whole = ml.fit_many(df, names, specs)
    monkeypatch.setattr(ml, "MODELS_AT_ONCE", 3)
    parts = ml.fit_many(df, names, specs)
    assert [f.spec for f in parts] == specs and np.allclose([f.coefficients for f in whole], [f.coefficients for f in parts], atol=1e-9)


def test_folds_are_found_beyond_one_literal_array(spark, monkeypatch):
    monkeypatch.setattr(ml, "LITERAL_RUN", 3)
    df = spark.createDataFrame([(i,) for i in range(-2, 25)], "t int")
    got = {r.t: r.fold for r in ml.assign_fold(df, "t", list(range(0, 20, 2))).collect()}
    assert got == {i: None if i < 0 else min(i // 2 * 2, 18) for i in range(-2, 25)}


@pytest.mark.parametrize("offset", [None, "o"])
def test_folds_by_expansion_equal_exact_steps(spark, monkeypatch, offset):
    rng = np.random.default_rng(4)
    n = 20_000
    x = rng.uniform(-1, 1, (n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + x @ [0.8, -0.5])))).astype(int)
    rows = [(i, float(i // 500), float(a), float(b), 0.1, int(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_key long, t double, a double, b double, o double, y int")
    specs = [ml.Spec(float(f), seed) for f in range(20, 40) for seed in (None, 5)]
    fit = lambda: ml.fit_many(df, ["a", "b"], specs, time="t", offset=offset, intercept=offset is None, scale="rms" if offset else "standard")
    exact = fit()
    monkeypatch.setattr(ml, "LEAST_ROWS", 1000)
    monkeypatch.setattr(ml, "MOST_MISS", 1e-7)
    steps = []
    real = ml._sums
    monkeypatch.setattr(ml, "_sums", lambda data, features, own, *a, **k: steps.append(len(own)) or real(data, features, own, *a, **k))
    near = fit()
    # exact steps are left to the first fold of each block
    assert max(steps) <= 2
    for e, g in zip(exact, near):
        assert e.spec == g.spec and e.n == g.n
        assert np.allclose([e.intercept, *e.coefficients], [g.intercept, *g.coefficients], atol=1e-6)
