"""Walk-forward ridge-logistic models fitted in bulk by distributed Newton steps.

All models of a run (folds x bootstrap replicates x feature subsets) are fitted at the
same time. One Newton step is one Spark job: every task turns its rows into gradient and
Hessian sums for all models with a few matrix products and emits one row per model; Spark
adds them up; the driver only solves tiny p x p systems. Data volume through the driver is
(models x p^2), independent of the number of rows, and is checked.

Refits at every date are neighbours: they start from the model of the first of them, so most need few steps, and a step works
only on models that have not converged.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement
from math import factorial, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from duelmark.functions.pricing import clip, logit
from duelmark.session import materialize
from duelmark.settings import BLEND_GRID, ENSEMBLE_C, OFFSET_L2

LITERAL_RUN = 64                # folds in one literal array
MODELS_AT_ONCE = 4_000          # models whose sums meet in the driver; more are fitted block by block
SHARED_SEEDS = 256              # seeds whose draws of a batch are made at once
MOST_STEP = 4.0                 # of a scaled coefficient
DEGREE = 5                      # of the expansion of the loss around a neighbouring model
LEAST_ROWS = 100_000            # before the first fold of a block whose models are fitted by expansion
MOST_MISS = 1e-10               # of a probability, by an expansion
GROWTH = 1.5                    # of the rows before a fold within a block


@dataclass(frozen=True)
class Spec:
    """One model: rows before ``fold`` (None: all rows), a bootstrap seed (None: each row
    once), the feature positions it uses (None: all) and an optional recency half-life."""

    fold: float | None = None
    seed: int | None = None
    subset: tuple[int, ...] | None = None
    half_life_days: float | None = None
    tag: object = None


@dataclass(frozen=True)
class Fitted:
    spec: Spec
    intercept: float
    coefficients: np.ndarray      # on the raw feature scale
    standardized: np.ndarray      # on the scaled features, for ranking
    n: float
    iterations: int


def symmetrize(df: DataFrame, flip: list[str], label: str = "y", key: str = "row_key") -> DataFrame:
    """Add the side-swapped copy of every row: differentials negated, label flipped.

    The copies come from one explode, so the input is scanned once; each copy gets its own
    row key because a bootstrap draws the two copies independently.
    """
    out = df.withColumn("_sign", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    cols = {c: F.col(c) * F.col("_sign") for c in flip}
    cols[label] = F.when(F.col("_sign") > 0, F.col(label)).otherwise(1 - F.col(label))
    if key in df.columns:
        cols[key] = F.xxhash64(key, "_sign")
    return out.withColumns(cols).drop("_sign")


def draw_copies(keys: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """How often each row appears in each replicate, a Poisson(1) variable from a hash; seed -1 is every row once."""
    cdf = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320], dtype=float))

    def mix(z):
        z = (z + np.uint64(0x9E3779B97F4A7C15))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))

    w = np.ones((len(keys), len(seeds)))
    drawn = np.flatnonzero(seeds >= 0)
    if len(drawn):
        with np.errstate(over="ignore"):
            h = mix(keys[:, None] ^ mix(seeds[drawn].astype(np.uint64))[None, :])
        u = (h >> np.uint64(11)).astype(float) / float(1 << 53)
        w[:, drawn] = np.searchsorted(cdf, u, side="right")
    return w


def _sums(rows: DataFrame, features: list[str], specs: list[Spec], beta, offset: bool, moments: bool):
    """Per-model sums over all rows: (products, gradient)."""
    width = len(features) + 1
    upper = [(i, j) for i in range(width) for j in range(i, width)]
    n_out = len(upper) + width
    groups: dict = {}
    for m, s in enumerate(specs):
        groups.setdefault((s.fold, s.half_life_days), []).append(m)
    # replicates with one seed draw a row alike in every fold, so its copies are drawn once for all folds
    seeds = sorted({-1 if s.seed is None else s.seed for s in specs})
    place = {seed: j for j, seed in enumerate(seeds)}
    seeds = np.array(seeds, dtype=np.int64)
    plan = [(fold, half, np.array(ids), np.array([place[-1 if specs[m].seed is None else specs[m].seed] for m in ids]))
            for (fold, half), ids in groups.items()]
    left = np.array([i for i, _ in upper])
    right = np.array([j for _, j in upper])
    n_models = len(specs)
    names = list(features)

    def partial(batches):
        import numpy as np
        import pandas as pd

        total = np.zeros((n_models, n_out))
        seen = False
        with np.errstate(over="ignore"):
            for batch in batches:
                seen = True
                batch = batch.sort_values("_t", kind="stable")
                x = np.column_stack([np.ones(len(batch))] + [batch[c].to_numpy(float) for c in names])
                y = batch["_y"].to_numpy(float)
                t = batch["_t"].to_numpy(float)
                base = batch["_o"].to_numpy(float)
                keys = batch["_k"].to_numpy(np.int64).astype(np.uint64)
                products = x[:, left] * x[:, right]
                shared = draw_copies(keys, seeds) if len(seeds) <= SHARED_SEEDS else None
                for fold, half, ids, which in plan:
                    # rows before the fold come first
                    n = len(t) if fold is None else int(np.searchsorted(t, fold, "left"))
                    if not n:
                        continue
                    xs, ps = x[:n], products[:n]
                    w = shared[:n][:, which] if shared is not None else draw_copies(keys[:n], seeds[which])
                    if moments:
                        total[ids, :len(left)] += (ps.T @ w).T
                        continue
                    if half:
                        w = w * (0.5 ** ((fold - t[:n]) / half))[:, None]
                    eta = xs @ beta[ids].T
                    if offset:
                        eta += base[:n][:, None]
                    p = 1.0 / (1.0 + np.exp(-np.clip(eta, -35, 35, out=eta)))
                    wp = w * p
                    total[ids, :len(left)] += (ps.T @ (wp * (1 - p))).T
                    total[ids, len(left):] += (xs.T @ (w * y[:n][:, None] - wp)).T
        if seen:
            out = pd.DataFrame(total, columns=[f"v{i}" for i in range(n_out)])
            out.insert(0, "model", np.arange(n_models, dtype=np.int32))
            yield out

    schema = "model int, " + ", ".join(f"v{i} double" for i in range(n_out))
    parts = rows.mapInPandas(partial, schema)
    summed = parts.groupBy("model").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(n_out)])
    got = np.zeros((n_models, n_out))
    for r in summed.collect():      # one row per model: at most MODELS_AT_ONCE
        got[r[0]] = r[1:]
    full = np.zeros((n_models, width, width))
    full[:, left, right] = got[:, :len(upper)]
    full[:, right, left] = got[:, :len(upper)]
    return full, got[:, len(upper):]


def _numbers(rows: DataFrame, features: list[str], label: str, row_key: str, time: str | None, offset: str | None) -> DataFrame:
    t = F.col(time).cast("double") if time else F.lit(0.0)
    return rows.select(*[F.col(c).cast("double").alias(c) for c in features],
                       F.col(label).cast("double").alias("_y"), t.alias("_t"),
                       (F.col(offset).cast("double") if offset else F.lit(0.0)).alias("_o"),
                       F.col(row_key).cast("long").alias("_k"))


class _Expansion:
    """Sums of many folds from one pass: the loss of each replicate as a polynomial around a model ``ref`` of its own.

    A row counts in every later fold. Its Taylor coefficients are added up by the time between two folds, and running totals
    over the folds give each fold its polynomial, so work follows rows x replicates and not rows x folds.
    """

    def __init__(self, data: DataFrame, features: list[str], folds: list[float], seeds: list[int | None], ref: np.ndarray, offset: bool, largest: np.ndarray):
        width = len(features) + 1
        self.folds, self.ref, self.largest = {f: j for j, f in enumerate(folds)}, ref, largest
        self.kinds = {s: k for k, s in enumerate(seeds)}
        powers = [c for k in range(DEGREE + 1) for c in combinations_with_replacement(range(width), k)]
        at = {c: j for j, c in enumerate(powers)}
        parent = [[(at[c[:-1]], c[-1]) for c in powers if len(c) == k] for k in range(1, DEGREE + 1)]
        self.exponents = np.array([[c.count(i) for i in range(width)] for c in powers])
        self.factor = 1 / np.array([prod(map(factorial, e)) for e in self.exponents.tolist()], dtype=float)
        # the place of a power with one factor less, for derivatives
        self.less = np.array([[at[c[:c.index(i)] + c[c.index(i) + 1:]] if i in c else 0 for i in range(width)] for c in powers])
        self.upper = [(i, j) for i in range(width) for j in range(i, width)]
        square = np.array([at[c] for c in self.upper])
        edges, own = np.array(folds), np.array([-1 if s is None else s for s in seeds], dtype=np.int64)
        n_kinds, n_powers, names = len(seeds), len(powers), list(features)
        n_out = n_powers + len(square)

        def add(batches):
            import numpy as np
            import pandas as pd

            total: dict[int, np.ndarray] = {}
            for batch in batches:
                batch = batch[batch["_t"].to_numpy(float) < edges[-1]].sort_values("_t", kind="stable")
                if not len(batch):
                    continue
                x = np.column_stack([np.ones(len(batch))] + [batch[c].to_numpy(float) for c in names])
                w = draw_copies(batch["_k"].to_numpy(np.int64).astype(np.uint64), own)
                eta = x @ ref.T
                if offset:
                    eta += batch["_o"].to_numpy(float)[:, None]
                p = 1.0 / (1.0 + np.exp(-np.clip(eta, -35, 35)))
                # of the logistic curve: value (less the label), then derivatives
                curve = [p - batch["_y"].to_numpy(float)[:, None], p * (1 - p), p * (1 - p) * (1 - 2 * p),
                         p * (1 - p) * (1 - 6 * p + 6 * p * p), p * (1 - p) * (1 - 2 * p) * (1 - 12 * p + 12 * p * p)]
                terms = np.ones((len(batch), n_powers))
                first = 1
                spans = []
                for level in parent:
                    span = slice(first, first + len(level))
                    np.multiply(terms[:, [j for j, _ in level]], x[:, [i for _, i in level]], out=terms[:, span])
                    spans.append(span)
                    first += len(level)
                part = np.searchsorted(edges, batch["_t"].to_numpy(float), "right")
                ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(part))
                weighted = [w * c for c in curve]
                begin = 0
                for end in ends.tolist():
                    rows, segment = slice(begin, end), int(part[begin])
                    begin = end
                    into = total.setdefault(segment, np.zeros((n_kinds, n_out)))
                    for c, span in zip(weighted, spans):
                        into[:, span] += c[rows].T @ terms[rows, span]
                    into[:, n_powers:] += w[rows].T @ terms[rows][:, square]
            for segment, sums in total.items():
                yield pd.DataFrame({"segment": segment, "kind": np.arange(n_kinds), "sums": list(sums)})

        parts = data.filter(F.col("_t") < float(edges[-1])).mapInPandas(add, "segment int, kind int, sums array<double>")

        def meet(part):
            import numpy as np
            import pandas as pd

            # a row per task and replicate
            sums = np.zeros((n_kinds, n_out))
            np.add.at(sums, part["kind"].to_numpy(), np.stack(part["sums"].to_list()))
            return pd.DataFrame({"segment": int(part["segment"].iloc[0]), "kind": np.arange(n_kinds), "sums": list(sums)})

        rows = parts.groupBy("segment").applyInPandas(meet, "segment int, kind int, sums array<double>")
        got = np.zeros((len(folds), n_kinds, n_out))
        for segment, kind, sums in rows.collect():      # at most MODELS_AT_ONCE
            got[segment, kind] = sums
        got = got.cumsum(axis=0)
        self.totals, self.squares = got[:, :, :n_powers] * self.factor, got[:, :, n_powers:]

    def _at(self, specs: list[Spec]) -> tuple[list[int], list[int]]:
        return [self.folds[s.fold] for s in specs], [self.kinds[s.seed] for s in specs]

    def near(self, specs: list[Spec], raw: np.ndarray) -> np.ndarray:
        """Whether what the expansion leaves out of any row's probability is below ``MOST_MISS``."""
        reach = np.abs(raw - self.ref[self._at(specs)[1]]) @ self.largest
        # no fifth derivative of the logistic curve is above a quarter
        return reach ** DEGREE / factorial(DEGREE) / 4 < MOST_MISS

    def sums(self, specs: list[Spec], raw: np.ndarray, moments: bool):
        """What ``_sums`` gives."""
        where, width = self._at(specs), len(self.largest)
        hess, grad = np.zeros((len(specs), width, width)), np.zeros((len(specs), width))
        left, right = np.array(self.upper).T
        if moments:
            hess[:, left, right] = hess[:, right, left] = self.squares[where]
            return hess, grad
        c = self.totals[where]
        d = raw - self.ref[where[1]]
        steps = d[:, :, None] ** np.arange(DEGREE + 1)
        value = np.ones((len(specs), len(self.exponents)))
        for i in range(width):
            value *= steps[:, i, self.exponents[:, i]]
        for i in range(width):
            ci = c * self.exponents[:, i]
            grad[:, i] = -(ci * value[:, self.less[:, i]]).sum(axis=1)
            for j in range(i, width):
                twice = self.exponents[self.less[:, i], j] * (self.exponents[:, i] > 0)
                hess[:, i, j] = hess[:, j, i] = (ci * twice * value[:, self.less[self.less[:, i], j]]).sum(axis=1)
        return hess, grad


def _rows_before(data: DataFrame, folds: list[float]) -> np.ndarray:
    """How many rows lie before each of the sorted folds; distinct times are read one at a time."""
    counts = np.zeros(len(folds) + 1)
    for r in data.groupBy("_t").count().toLocalIterator():
        counts[np.searchsorted(folds, r["_t"], "right")] += r["count"]
    return counts[:-1].cumsum()


def _expanded(data: DataFrame, features: list[str], specs: list[Spec], **how) -> list[Fitted | None]:
    """Models that an expansion around the fit at an earlier fold determines; None for the others, which need exact steps.

    Folds make a block as long as rows grow by no more than ``GROWTH``. Every replicate is fitted by exact steps at the block's first fold, and
    the other folds of the block are solved on the expansions around these fits.
    """
    found: list[Fitted | None] = [None] * len(specs)
    folds = sorted({s.fold for s in specs if s.fold is not None})
    seeds = list(dict.fromkeys(s.seed for s in specs))
    if any(s.fold is None or s.half_life_days or s.subset is not None for s in specs) or len(seeds) > SHARED_SEEDS or len(folds) < 4:
        return found
    before = _rows_before(data, folds)
    largest = np.array([1.0, *data.agg(*[F.max(F.abs(c)) for c in features]).first()])
    ids: dict = {}
    for m, s in enumerate(specs):
        ids.setdefault(s.fold, []).append(m)
    start: dict = {}
    at = int(np.searchsorted(before, LEAST_ROWS))
    while at < len(folds):
        end = min(int(np.searchsorted(before, GROWTH * before[at], "right")), at + max(1, MODELS_AT_ONCE // len(seeds)))
        if end - at >= 4:
            first = _newton(data.filter(F.col("_t") < folds[at]), features, [Spec(folds[at], s) for s in seeds], start, **how)
            start = {(f.spec.seed, None): f for f in first}
            ref = np.array([[f.intercept, *f.coefficients] for f in first])
            near = _Expansion(data, features, folds[at:end], seeds, ref, how["offset"], largest)
            own = [m for f in folds[at:end] for m in ids[f]]
            fitted = _newton(data, features, [specs[m] for m in own], start, **how, sums=near.sums)
            good = near.near([specs[m] for m in own], np.array([[f.intercept, *f.coefficients] for f in fitted]))
            for m, f, ok in zip(own, fitted, good):
                found[m] = f if ok else None
        at = max(end, at + 1)
    return found


def fit_many(rows: DataFrame, features: list[str], specs: list[Spec], label="y", row_key="row_key",
             time: str | None = None, offset: str | None = None, penalty: float = 1.0 / ENSEMBLE_C,
             penalty_per_row: bool = False, intercept: bool = True, scale: str = "standard",
             max_iter: int = 30, tol: float = 1e-10) -> list[Fitted]:
    """Fit every spec by Newton steps on sum(log loss) + penalty/2 * |b|^2.

    ``scale='standard'`` centres and divides by the population deviation of the model's own
    sample; ``'rms'`` divides by the root mean square without centring (keeps symmetry).
    ``penalty_per_row`` multiplies the penalty by the sample size (loss stated as a mean).

    The rows are written once, as numbers. Many folds are fitted on expansions of the loss (``_expanded``) where these miss no
    probability by ``MOST_MISS``; the others by exact steps. Models of many folds start at the fit to the rows before the first of them, so no
    later row has a part in a model; a model whose last step was below the root of ``tol`` has converged, because a Newton
    step squares what is missing.
    """
    data = materialize(_numbers(rows, features, label, row_key, time, offset).sortWithinPartitions("_t"), "model-rows")
    how = dict(offset=bool(offset), penalty=penalty, penalty_per_row=penalty_per_row, intercept=intercept, scale=scale, max_iter=max_iter, tol=tol)
    every, found = specs, _expanded(data, features, specs, **how)
    specs = [s for s, f in zip(every, found) if f is None]
    start: dict = {}
    out: list[Fitted] = []
    for at in range(0, len(specs), MODELS_AT_ONCE):
        block = specs[at:at + MODELS_AT_ONCE]
        folds = [s.fold for s in block if s.fold is not None]
        kinds = list(dict.fromkeys((s.seed, s.subset) for s in block))
        if folds and len(kinds) < len(block):
            # replicates that share a seed start from that replicate of the rows before the block's first fold
            kinds = kinds if len(kinds) <= SHARED_SEEDS else list(dict.fromkeys((None, subset) for _, subset in kinds))
            first = [Spec(min(folds), seed, subset) for seed, subset in kinds]
            start = {(f.spec.seed, f.spec.subset): f for f in _newton(data, features, first, start, **how) if f.n}
        out += _newton(data, features, block, start, **how)
    exact = iter(out)
    return [f or next(exact) for f in found]


@dataclass(frozen=True)
class _Scaling:
    """Per model: sample size, centre and deviation of the features, the map to scaled features, ridge and used coefficients."""

    n: np.ndarray
    mu: np.ndarray
    sd: np.ndarray
    a: np.ndarray
    ridge: np.ndarray
    active: list[np.ndarray]

    def gradient(self, at: np.ndarray, raw: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ascent direction on the scaled coefficients ``b`` from raw gradients, for the models ``at``."""
        return np.einsum("mij,mj->mi", self.a[at], raw) - self.ridge[at] * b


def _scale(data: DataFrame, features: list[str], specs: list[Spec], offset: bool, penalty: float, penalty_per_row: bool, intercept: bool, scale: str,
           given=None) -> _Scaling:
    p = len(features)
    zero = np.zeros((len(specs), p + 1))
    sums, _ = given(specs, zero, True) if given else _sums(data, features, specs, zero, offset, moments=True)
    n = sums[:, 0, 0]
    safe = np.maximum(n, 1.0)
    mean = sums[:, 0, 1:] / safe[:, None]
    square = sums[:, np.arange(1, p + 1), np.arange(1, p + 1)] / safe[:, None]
    if scale == "rms":
        mu = np.zeros_like(mean)
        sd = np.sqrt(square)
    else:
        mu, sd = mean, np.sqrt(np.maximum(square - mean ** 2, 0.0))
    sd = np.where(sd > 1e-12, sd, 1.0)
    # scaled = A @ raw for raw = (1, x)
    a = np.zeros((len(specs), p + 1, p + 1))
    a[:, 0, 0] = 1.0
    idx = np.arange(1, p + 1)
    a[:, idx, idx] = 1.0 / sd
    a[:, 1:, 0] = -mu / sd
    active = []
    for s in specs:
        used = range(p) if s.subset is None else s.subset
        active.append(np.array(([0] if intercept else []) + [1 + j for j in used]))
    ridge = np.full((len(specs), p + 1), float(penalty))
    if penalty_per_row:
        ridge *= safe[:, None]
    ridge[:, 0] = 0.0
    return _Scaling(n, mu, sd, a, ridge, active)


def slopes(rows: DataFrame, features: list[str], fitted: list[Fitted], label="y", row_key="row_key", time: str | None = None,
           penalty: float = 1.0 / ENSEMBLE_C) -> list[tuple[object, str, float, float]]:
    """(tag, term, rows, slope) of the penalised loss at every model, on its own sample: 0 at the optimum."""
    data, specs = _numbers(rows, features, label, row_key, time, None), [f.spec for f in fitted]
    sc = _scale(data, features, specs, False, penalty, False, True, "standard")
    raw = np.array([[f.intercept, *f.coefficients] for f in fitted])
    b = np.column_stack([raw[:, 0] + (raw[:, 1:] * sc.mu).sum(axis=1), raw[:, 1:] * sc.sd])
    g = sc.gradient(np.arange(len(specs)), _sums(data, features, specs, raw, False, moments=False)[1], b)
    terms = ["intercept", *features]
    return [(s.tag, terms[j], float(sc.n[m]), float(g[m, j])) for m, s in enumerate(specs) for j in sc.active[m]]


def _newton(data: DataFrame, features: list[str], specs: list[Spec], start: dict, offset: bool, penalty: float, penalty_per_row: bool,
            intercept: bool, scale: str, max_iter: int, tol: float, sums=None) -> list[Fitted]:
    """Newton steps on sums over ``data``, or on what ``sums`` tells of them."""
    p = len(features)
    sc = _scale(data, features, specs, offset, penalty, penalty_per_row, intercept, scale, sums)
    n, mu, sd, a, active = sc.n, sc.mu, sc.sd, sc.a, sc.active
    b = np.zeros((len(specs), p + 1))
    for m, (s, on) in enumerate(zip(specs, active)):
        # the starting model on the model's own scale; features that it does not use stay 0
        if f := start.get((s.seed, s.subset)) or start.get((None, s.subset)):
            b[m, on] = np.concatenate([[f.intercept + mu[m] @ f.coefficients], sd[m] * f.coefficients])[on]
    todo = np.flatnonzero(n > 0)
    steps = 0
    for steps in range(1, max_iter + 1):
        raw = np.einsum("mj,mjk->mk", b[todo], a[todo])
        own = [specs[m] for m in todo]
        hess, grad = sums(own, raw, False) if sums else _sums(data, features, own, raw, offset, moments=False)
        h = np.einsum("mij,mjk,mlk->mil", a[todo], hess, a[todo])
        g = sc.gradient(todo, grad, b[todo])
        moved = np.zeros(len(todo))
        for k, m in enumerate(todo):
            on = active[m]
            lhs = h[k][np.ix_(on, on)] + np.diag(sc.ridge[m, on]) + 1e-12 * np.eye(len(on))
            step = np.linalg.solve(lhs, g[k, on])
            # far from the optimum a step is held back
            step *= min(1.0, MOST_STEP / max(float(np.abs(step).max()), 1e-300))
            b[m, on] += step
            moved[k] = np.abs(step).max()
        todo = todo[moved >= tol ** 0.5]
        if not len(todo):
            break
    raw = np.einsum("mj,mjk->mk", b, a)
    return [Fitted(s, float(raw[m, 0]), raw[m, 1:], b[m, 1:], float(n[m]), steps) for m, s in enumerate(specs)]


def replicate_seed(event_seed: int, replicate: int) -> int:
    return (int(event_seed) * 1_000_003 + replicate) % (1 << 62)


def ensemble_specs(folds: list[float | None], seeds: list[int], n_models: int, **kw) -> list[Spec]:
    """Base model plus bootstrap replicates for every fold."""
    out = []
    for fold, seed in zip(folds, seeds):
        out.append(Spec(fold, None, tag=0, **kw))
        out += [Spec(fold, replicate_seed(seed, r), tag=r, **kw) for r in range(1, n_models + 1)]
    return out


def model_table(spark: SparkSession, fitted: list[Fitted], fold_values: dict | None = None,
                fold_type: str = "double") -> DataFrame:
    """(fold, models) with one array of coefficient arrays per fold; index 0 is the base model."""
    by_fold: dict = {}
    for f in fitted:
        by_fold.setdefault(f.spec.fold, []).append((f.spec.tag or 0, [f.intercept, *map(float, f.coefficients)]))
    rows = []
    for fold, models in by_fold.items():
        value = fold_values[fold] if fold_values else fold
        rows.append((value, [m for _, m in sorted(models, key=lambda x: x[0])]))
    return spark.createDataFrame(rows, f"fold {fold_type}, models array<array<double>>")


def _ensemble(models: list[list[float]], signs: np.ndarray, offset: bool, flip: bool):
    """UDF from a struct of offset and features to the base model's probability and the deviation over the ensemble, batch by batch."""
    terms = np.array(models, dtype=float).T[:, :, None]         # term, model, row

    @F.arrow_udf("p double, se double")
    def score(rows: pa.Array) -> pa.Array:
        columns = rows.flatten()
        base, *x = [c.to_numpy(zero_copy_only=False).astype(float) for c in columns]
        missing = np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in columns])

        def side(sign):
            total = terms[0] + base * (sign if offset else 1.0)
            for term, values, s in zip(terms[1:], x, signs):
                total += term * (values * (s if sign < 0 else 1.0))
            return 1.0 / (1.0 + np.exp(-total))

        with np.errstate(over="ignore", invalid="ignore"):
            p = (side(1.0) + 1.0 - side(-1.0)) / 2.0 if flip else side(1.0)
            se = np.sqrt(((p - p.mean(axis=0)) ** 2).mean(axis=0))
        return pa.StructArray.from_arrays([pa.array(p[0], mask=missing), pa.array(se, mask=missing)], ["p", "se"])

    return score


def predict(df: DataFrame, models: DataFrame, features: list[str], flip: list[str] | None = None,
            offset: str | None = None, fold: str | None = "fold", prob="p_model", se="se") -> DataFrame:
    """Probability of the base model and the population deviation over the ensemble.

    With ``flip`` the prediction is averaged with the side-swapped one. The model table has
    one row per fold; Spark broadcasts it only when it is measured to be small. Without folds it is one
    row, which goes to the tasks as a matrix, and rows are scored batch by batch.
    """
    base = F.col(offset).cast("double") if offset else F.lit(0.0)
    if not fold:
        found = models.select("models").take(2)
        if len(found) > 1:
            raise ValueError("one row of models expected without folds")
        if not found or not found[0][0]:
            return df.withColumns({c: F.lit(None).cast("double") for c in (prob, se)})
        signs = np.array([-1.0 if flip and c in flip else 1.0 for c in features])
        score = _ensemble(found[0][0], signs, bool(offset), bool(flip))
        x = F.struct(base.alias("_o"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
        return df.withColumn("_scored", score(x)).withColumns({prob: F.col("_scored.p"), se: F.col("_scored.se")}).drop("_scored")

    def dot(m, sign):
        total = m[0] + base * F.lit(sign if offset else 1.0)
        for i, c in enumerate(features, 1):
            s = sign if flip and c in flip else 1.0
            total = total + m[i] * F.col(c).cast("double") * F.lit(float(s))
        return 1.0 / (1.0 + F.exp(-total))

    def one(m):
        return (dot(m, 1.0) + 1.0 - dot(m, -1.0)) / 2.0 if flip else dot(m, 1.0)

    j = df.join(models, fold)
    j = j.withColumn("_p", F.transform("models", one))
    n = F.size("_p")
    mean = F.aggregate("_p", F.lit(0.0), lambda acc, v: acc + v) / n
    j = j.withColumn("_mean", mean)
    var = F.aggregate("_p", F.lit(0.0), lambda acc, v: acc + (v - F.col("_mean")) * (v - F.col("_mean"))) / n
    return (j.withColumns({prob: F.col("_p")[0], se: F.sqrt(var)})
            .drop("_p", "_mean", "models"))


def assign_fold(df: DataFrame, time: str, folds: list, name: str = "fold") -> DataFrame:
    """Latest fold at or before the row; rows before the first fold get NULL.

    A balanced CASE finds a run of folds, and the run is a literal array, so the expression stays small.
    """
    grid, t = sorted(folds), F.col(time)

    def pick(low: int, high: int) -> Column:
        if high - low <= LITERAL_RUN:
            run = F.array(*[F.lit(f) for f in grid[low:high]])
            return F.try_element_at(F.filter(run, lambda f: f <= t), F.lit(-1))
        middle = (low + high) // 2
        return F.when(t < F.lit(grid[middle]), pick(low, middle)).otherwise(pick(middle, high))

    return df.withColumn(name, F.when(t >= F.lit(grid[0]), pick(0, len(grid))))


def fold_starts(df: DataFrame, time: str, refit_every: int = 1, start=None) -> list:
    """Refit schedule: every k-th distinct event time, in order, read one at a time."""
    times = df.select(time).distinct()
    if start is not None:
        times = times.filter(F.col(time) >= F.lit(start))
    return [t for n, (t,) in enumerate(times.orderBy(time).toLocalIterator()) if n % max(1, refit_every) == 0]


def walk_forward(df: DataFrame, features: list[str], flip: list[str], date: str, folds: list,
                 n_models: int, min_train: int = 1, seeds: list[int] | None = None, c: float = ENSEMBLE_C,
                 label="y", row_key="row_key", half_life_years: float | None = None,
                 symmetric: bool = True) -> DataFrame:
    """Predict every row with the ensemble refitted at its fold from strictly earlier rows.

    Adds ``fold``, ``p_model`` and ``se``. Folds with fewer than ``min_train`` training rows
    give no prediction.
    """
    spark = df.sparkSession
    day = {f: float((f - _epoch(f)).days) for f in folds}
    rows = df.withColumn("_day", F.datediff(F.col(date).cast("date"), F.lit("1970-01-01").cast("date")).cast("double"))
    train = symmetrize(rows, flip, label, row_key) if symmetric else rows
    half = half_life_years * 365.25 if half_life_years else None
    specs = ensemble_specs([day[f] for f in folds], seeds or [0] * len(folds), n_models, half_life_days=half)
    fitted = fit_many(train, features, specs, label, row_key, "_day", penalty=1.0 / c)
    copies = 2 if symmetric else 1
    sizes = {f.spec.fold: f.n / copies for f in fitted if not f.spec.tag}
    kept = [f for f in fitted if sizes[f.spec.fold] >= min_train]
    if not kept:
        raise ValueError("no fold has enough training rows")
    values = {v: k for k, v in day.items()}
    models = model_table(spark, kept, values, df.schema[date].dataType.simpleString())
    test = assign_fold(rows, date, folds).filter(F.col("fold").isNotNull())
    return predict(test, models, features, flip if symmetric else None).drop("_day")


def _epoch(value):
    import datetime as dt

    return dt.datetime(1970, 1, 1) if isinstance(value, dt.datetime) else dt.date(1970, 1, 1)


# --- market offset ------------------------------------------------------------

def fit_offset(rows: DataFrame, features: list[str], specs: list[Spec], offset="line_logit",
               l2: float = OFFSET_L2, **kw) -> list[Fitted]:
    """Correction around a market logit whose coefficient stays 1, without intercept."""
    return fit_many(rows, features, specs, offset=offset, penalty=l2, penalty_per_row=True,
                    intercept=False, scale="rms", **kw)


def walk_forward_offset(df: DataFrame, features: list[str], date: str, folds: list, n_models: int, offset="line_logit",
                        seeds: list[int] | None = None, prob="p_model", se="se", l2: float = OFFSET_L2) -> DataFrame:
    """``fit_offset`` refitted at every fold on strictly earlier rows; each row gets its fold's prediction."""
    spark = df.sparkSession
    day = {f: float((f - _epoch(f)).days) for f in folds}
    rows = df.withColumn("_day", F.datediff(F.col(date).cast("date"), F.lit("1970-01-01").cast("date")).cast("double"))
    specs = ensemble_specs([day[f] for f in folds], seeds or [0] * len(folds), n_models)
    fitted = fit_offset(rows, features, specs, offset, l2, time="_day")
    models = model_table(spark, fitted, {v: k for k, v in day.items()}, df.schema[date].dataType.simpleString())
    test = assign_fold(rows, date, folds, "_fold").filter(F.col("_fold").isNotNull())
    out = predict(test, models.withColumnRenamed("fold", "_fold"), features, None, offset=offset, fold="_fold", prob=prob, se=se)
    return out.drop("_day", "_fold")


# --- blends --------------------------------------------------------------------

def past_only_blend(df: DataFrame, event_start: str, bucket: Column, y="y", market="p_line",
                    current="p_current", grid=BLEND_GRID, min_history: int = 200,
                    default: float = 1.0) -> DataFrame:
    """Market weight per event from strictly earlier events only.

    Losses are summed per (event time, weight), accumulated over earlier events, and the
    weight with the smallest loss wins (ties to the larger weight).
    """
    from duelmark.operators.evaluation import explode_params, log_loss_term
    from duelmark.operators.running import running_before

    usable = df.dropna(subset=[y, market, current])
    rows = explode_params(usable, [{"weight": float(w)} for w in grid])
    rows = rows.withColumn("_p", F.col("weight") * F.col(market) + (1 - F.col("weight")) * F.col(current))
    per = rows.groupBy(event_start, "weight").agg(
        F.sum(log_loss_term(y, "_p")).alias("loss"), F.count(F.lit(1)).alias("history_rows"))
    past = running_before(per, event_start, ["loss", "history_rows"], bucket, ["weight"])
    mean = F.col("loss") / F.col("history_rows")
    best = past.groupBy(event_start).agg(
        F.min_by("weight", F.struct(F.try_divide("loss", "history_rows"), -F.col("weight"))).alias("_w"),
        F.max("history_rows").alias("history_rows"),
        F.min(F.when(F.col("history_rows") > 0, mean)).alias("_loss"))
    enough = F.col("history_rows") >= min_history
    return best.select(
        event_start, F.when(enough, F.col("_w")).otherwise(default).alias("market_weight"), "history_rows",
        F.when(enough, "prior_oof_log_loss").otherwise("default_insufficient_history").alias("selection"),
        F.when(enough, F.col("_loss")).alias("selected_log_loss"))


# --- MLlib-backed models ---------------------------------------------------------

def _assemble(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def ridge_logistic(df: DataFrame, features: list[str], label="y", c: float = ENSEMBLE_C,
                   weight: str | None = None):
    """Ridge logistic on standardised features; ``c`` is the inverse penalty on the summed loss."""
    from pyspark.ml.classification import LogisticRegression

    n = df.count()
    lr = LogisticRegression(labelCol=label, featuresCol="features", regParam=1.0 / (c * max(n, 1)),
                            elasticNetParam=0.0, standardization=True, maxIter=200, tol=1e-10)
    if weight:
        lr = lr.setWeightCol(weight)
    return lr.fit(_assemble(df.withColumn(label, F.col(label).cast("double")), features))


def model_probability(model, df: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(_assemble(df, features))
    return (out.withColumn(name, vector_to_array("probability")[1])
            .drop("features", "rawPrediction", "probability", "prediction"))


def recency_weight(time, now, half_life_years: float) -> Column:
    age = F.datediff(F.col(now) if isinstance(now, str) else now, time) / 365.25
    return F.pow(F.lit(0.5), age / half_life_years)


def fit_calibrators(df: DataFrame, p="p_model", y="y"):
    """Platt and isotonic calibration; isotonic input is pre-aggregated per probability."""
    from pyspark.ml.regression import IsotonicRegression

    x = df.withColumn("_x", logit(clip(p, 1e-4, 1 - 1e-4)))
    platt = ridge_logistic(x, ["_x"], y, c=1e6)
    agg = df.groupBy(p).agg(F.avg(F.col(y).cast("double")).alias("label"),
                            F.count(F.lit(1)).cast("double").alias("weight"))
    iso = IsotonicRegression(featuresCol=p, labelCol="label", weightCol="weight").fit(agg)
    return platt, iso


def calibrate(df: DataFrame, calibrators, p="p_model") -> DataFrame:
    platt, iso = calibrators
    x = df.withColumn("_x", logit(clip(p, 1e-4, 1 - 1e-4)))
    out = model_probability(platt, x, ["_x"], "p_platt").drop("_x")
    iso = iso.copy().setPredictionCol("p_isotonic")
    return iso.transform(out)


def method_model(df: DataFrame, features: list[str], label: str = "method_class", c: float = 0.3):
    """Multinomial logistic over method classes; returns (pipeline model, class labels)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    n = df.count()
    stages = [StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip"),
              VectorAssembler(inputCols=features, outputCol="_features"),
              LogisticRegression(labelCol="_label", featuresCol="_features", family="multinomial",
                                 regParam=1.0 / (c * max(n, 1)), standardization=True, maxIter=300, tol=1e-9)]
    fitted = Pipeline(stages=stages).fit(df)
    return fitted, list(fitted.stages[0].labels)


def method_probabilities(model, df: DataFrame, classes: list[str], label: str = "method_class") -> DataFrame:
    """Adds one probability column per class: ``p_<class>``."""
    from pyspark.ml.functions import vector_to_array

    _, assembler, lr = model.stages
    out = lr.transform(assembler.transform(df))
    arr = vector_to_array("probability")
    return (out.withColumns({f"p_{c}": arr[i] for i, c in enumerate(classes)})
            .drop("_features", "rawPrediction", "probability", "prediction"))


def gbt_baseline(df: DataFrame, features: list[str], label="y", holdout: str = "is_validation",
                 max_iter: int = 500, step: float = 0.03, max_depth: int = 4, seed: int = 0):
    """Boosted-tree baseline of at most ``max_iter`` rounds, which stops early on a held-out flag (no numeric parity claimed)."""
    from pyspark.ml.classification import GBTClassifier

    gbt = GBTClassifier(labelCol=label, featuresCol="features", maxIter=max_iter, stepSize=step,
                        maxDepth=max_depth, validationIndicatorCol=holdout, seed=seed)
    return gbt.fit(_assemble(df.withColumn(label, F.col(label).cast("double")), features))
