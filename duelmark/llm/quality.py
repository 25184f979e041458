"""Quality scores by Bradley-Terry ranking: documents compete in pairs, and features explain who wins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from duelmark.llm.batches import cut, prepare, slices, utf8
from duelmark.operators.running import ordered_index, running_before
from duelmark.session import materialize

MOST_ROWS = 20_000              # labelled rows that one task fits, at most; more rows are fitted by jobs
RIVALS = 8                      # pairs that each document of the better label takes part in, at least
RIDGE = 1e-3                    # of the loss per pair
STEPS = 25                      # Newton steps at most
PARTS = 64                      # of equal size, that strengths are ranked in
KEY_SHIFT = 50                  # leaves 2**14 ranges of the hash, in which rows are numbered
SYMBOLS = b"*&%$#@^~=+<>_{}[]\\"

FEATURES = ("upper", "digit", "punctuation", "exclamation", "bar", "symbol", "line", "not_ascii", "word_length", "log_words",
            "repeated_words", "repeated_neighbours", "repeated_pairs", "repeated_lines", "symbol_ends", "entropy")

_KIND = np.zeros((256, 8))
for _i, _of in enumerate((bytes(range(65, 91)), b"0123456789", b".,;:!?'\"()-", b"!", b"|", SYMBOLS, b"\n", bytes(range(128, 256)))):
    _KIND[list(_of), _i] = 1


def describe(text: bytes) -> list[float]:
    """The features of a text; an empty one has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, digit, dots, shouts, bars, symbols, lines, high = (histogram @ _KIND).tolist()
    size = len(text)
    share = histogram[histogram > 0] / size
    same = sum(map(eq, words, words[1:]))
    rows = [line for line in text.split(b"\n") if line]
    ends = sum(w[-1] in SYMBOLS for w in words)
    return [upper / size, digit / size, dots / size, shouts / n, bars / n, symbols / n, lines / n, high / size,
            min((size - n + 1) / n, 40.0), float(np.log(n)), 1 - len(set(words)) / n, same / n,
            1 - len(set(zip(words, words[1:]))) / max(1, n - 1) if n > 1 else 0.0, 1 - len(set(rows)) / len(rows), ends / n,
            -float(share @ np.log2(share))]


class Ranking(NamedTuple):
    """Centre and scale of the features, their weights, and the score that parts the accepted from the rest."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bar: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) / self.scale @ self.weights


def pair_sums(differences: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Slope and curvature of the logistic loss that the first of each pair wins, summed over pairs, in one row."""
    p = 1 / (1 + np.exp(np.clip(differences @ w, -35, 35)))     # of losing
    return np.concatenate([-(p @ differences), ((differences * (p * (1 - p))[:, None]).T @ differences).ravel()])


def newton(sums: Callable[[np.ndarray], np.ndarray], n: int, size: int) -> np.ndarray:
    """Weights of least loss over ``n`` pairs, with a ridge: Newton steps on what ``sums`` gives at the weights."""
    w = np.zeros(size)
    for _ in range(STEPS):
        found = sums(w) / max(1, n)
        step = np.linalg.solve(found[size:].reshape(size, size) + RIDGE * np.eye(size), found[:size] + RIDGE * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_pairs(differences: np.ndarray) -> np.ndarray:
    """Weights of least logistic loss that the first of each pair wins."""
    return newton(lambda w: pair_sums(differences, w), *differences.shape)


def count_pairs(good: int, bad: int) -> int:
    """Enough for each row of the better label to meet ``RIVALS`` of the other, and for each of the other to meet one."""
    return max(good * RIVALS, bad) if good and bad else 0


def learn_ranking(x: np.ndarray, better: np.ndarray) -> Ranking:
    """Ranking from rows in a fixed order; without both labels there are no pairs, and all rows score alike.

    Each row of the better label meets ``RIVALS`` rows of the other or more, dealt round in turn. The bar is the quantile of all
    strengths at the share of the lower label, halfway between the rows next to it.
    """
    if not len(x):
        return Ranking(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)), 0.0)
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = (x - centre) / scale
    good, bad = z[better == 1], z[better == 0]
    pairs = np.arange(count_pairs(len(good), len(bad)))
    w = fit_pairs(good[pairs % max(1, len(good))] - bad[pairs % max(1, len(bad))]) if len(pairs) else np.zeros(z.shape[1])
    if len(pairs):
        ordered = np.sort(z @ w)
        bar = ordered[len(bad) - 1:len(bad) + 1].mean()
    else:
        bar = 0.0
    return Ranking(centre, scale, w, float(bar))


def value_at(rows: DataFrame, value: str, ranks: list[int]) -> list[float]:
    """Values at 0-based ranks of all rows in ascending order; equal values are counted and ranked as one row."""
    counts = materialize(rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")), "ranks")
    cuts = counts.agg(F.percentile_approx(value, [k / PARTS for k in range(1, PARTS)])).first()[0]
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(value)))
    before = running_before(counts.withColumn("end", F.col("n")), value, ["end"], bucket)
    found = before.select(value, "n", "end").filter(" OR ".join(f"end <= {r} AND {r} < end + n" for r in ranks)).collect()
    return [next(row[value] for row in found if row["end"] <= r < row["end"] + row["n"]) for r in ranks]


def learn_spread(rows: DataFrame) -> Ranking:
    """What ``learn_ranking`` learns, from rows (key, label, x) of any number: pairs, sums and ranks are made by jobs.

    A Newton step is one job over the written pairs, in which a task hands on one row of sums.
    """
    size = len(FEATURES)
    of = [F.col("x")[i] for i in range(size)]
    whole = rows.agg(F.count(F.lit(1)), F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0), *map(F.avg, of), *map(F.stddev_pop, of)).first()
    n, n_good, n_bad = whole[:3]
    if not n:
        return learn_ranking(np.empty((0, 0)), np.empty(0))
    centre, scale = (np.array(whole[3 + k * size:3 + (k + 1) * size]) for k in (0, 1))
    scale[scale < 1e-9] = 1.0
    n_pairs = count_pairs(n_good, n_bad)
    if not n_pairs:
        return Ranking(centre, scale, np.zeros(size), 0.0)

    def indexed(label: int, name: str) -> DataFrame:
        part = rows.filter(F.col("label") == label).select("key", F.col("x").alias(f"x_{name}"))
        return ordered_index(part, ["key", f"x_{name}"], F.shiftright("key", KEY_SHIFT), name).drop("key")

    met = rows.sparkSession.range(n_pairs).select("id", (F.col("id") % n_good).alias("good"), (F.col("id") % n_bad).alias("bad"))
    met = met.join(indexed(1, "good"), "good").join(indexed(0, "bad"), "bad").sortWithinPartitions("id")
    pairs = materialize(met.select(F.zip_with("x_good", "x_bad", lambda a, b: a - b).alias("x")), "pairs")

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("x").flatten().to_numpy().reshape(-1, size)

    def sums(w: np.ndarray) -> np.ndarray:
        def add(batches):
            total = np.zeros(size + size * size)
            for batch in batches:
                total += pair_sums(matrix(batch) / scale, w)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

        return np.sum([r.sums for r in pairs.mapInArrow(add, "sums array<double>").collect()], axis=0)

    w = newton(sums, n_pairs, size)

    def strengths(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array((matrix(batch) - centre) / scale @ w)], ["strength"])

    at = [n_bad - 1, min(n_bad, n - 1)]
    return Ranking(centre, scale, w, float(np.mean(value_at(rows.select("x").mapInArrow(strengths, "strength double"), "strength", at))))


def described(texts: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the features ``x`` of their texts in place of the texts, made where the rows are."""
    prepare(texts.sparkSession)
    kept = [c for c in texts.columns if c != text]
    schema = T.StructType([*(texts.schema[c] for c in kept), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def read(batches):
        for batch in slices(batches, text):
            found = [describe(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.list_(pa.float64()))], [*kept, "x"])

    return texts.withColumn(text, utf8(text)).mapInArrow(read, schema)


def train(texts: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "label", most_rows: int = MOST_ROWS) -> Ranking:
    """Learn from every labelled row; rows with a null label are not learned from."""
    rows = texts.filter(F.col(label).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label"), F.col(text).alias("text"))
    return train_described(described(rows), "doc_id", "label", most_rows)


def train_described(rows: DataFrame, doc_id: str = "doc_id", label: str = "label", most_rows: int = MOST_ROWS) -> Ranking:
    """Learn from every row with features ``x`` and a label.

    The rows are written once. Up to ``most_rows`` rows are fitted by one task, in the order of a hash of the id; more rows
    are fitted by jobs over the same pairs.
    """
    rows = rows.filter(F.col(label).isNotNull())
    made = materialize(rows.select(F.xxhash64(doc_id).alias("key"), F.col(label).cast("int").alias("label"), "x"), "quality")
    if made.count() > most_rows:
        return learn_spread(made)

    def fit(batches):
        parts = [(np.array(b.column("x").to_pylist()).reshape(-1, len(FEATURES)), b.column("label").to_numpy()) for b in batches]
        x = np.concatenate([p[0] for p in parts]) if parts else np.empty((0, len(FEATURES)))
        y = np.concatenate([p[1] for p in parts]) if parts else np.empty(0)
        ranking = learn_ranking(x, y)
        yield pa.RecordBatch.from_arrays([pa.array([v.tolist()], pa.list_(pa.float64())) for v in ranking[:3]] + [pa.array([ranking.bar])],
                                         ["centre", "scale", "weights", "bar"])

    fitted = made.repartition(1).sortWithinPartitions("key", "label").mapInArrow(
        fit, "centre array<double>, scale array<double>, weights array<double>, bar double").collect()
    return Ranking(*(np.array(v) for v in fitted[0][:3]), fitted[0][3]) if fitted else learn_ranking(np.empty((0, 0)), np.empty(0))


def quality(spark: SparkSession, ranking: Ranking, text: str = "text", at_bar: float = 0.7) -> Column:
    """The text's score in 0 to 1: a logistic curve of its strength that passes ``at_bar`` where the strength is at the bar."""
    sent = prepare(spark).sparkContext.broadcast(ranking)
    shift = float(np.log(at_bar / (1 - at_bar)))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            done = [np.empty(0)]
            for texts in cut(batch.tolist()):
                strength = sent.value.strengths(np.array([describe(t) for t in texts]))
                done.append(1 / (1 + np.exp(-np.clip(strength - sent.value.bar + shift, -35, 35))))
            yield pd.Series(np.concatenate(done))

    return score(utf8(text))
