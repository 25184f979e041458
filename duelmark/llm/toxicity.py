"""Toxicity by logistic regression, learned online by FTRL-proximal over hashed word features."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from duelmark.llm.batches import cut, lowered, prepare, slices
from duelmark.llm.words import WordHashes, mixed, ODD
from duelmark.session import materialize

BITS = 20                       # feature space
STEM = 4                        # bytes of a word's stem
SKIPS = (1, 2, 3)            # a pair of words at distance 1 is an n-gram, the others are skip-grams
ALPHA, BETA, L1, L2 = 0.3, 1.0, 8.0, 0.1
EPOCHS = 4
MOST_ROWS = 20_000              # labelled rows that are learned from, at most
LETTERS = re.compile(rb"[^a-z\x80-\xff]+")


def word_key(word: bytes) -> bytes:
    """A word without what surrounds or decorates its letters."""
    return LETTERS.sub(b"", word)


def stem(word: bytes) -> bytes:
    """The first letters of a word, marked, so that inflected forms share a unigram."""
    return b"^" + word_key(word)[:STEM]


def features(begins: np.ndarray, hashes: np.ndarray, stems: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts, and the text of each: words, stems, pairs of neighbours and pairs with words skipped."""
    sizes = np.diff(begins)
    text = np.repeat(np.arange(len(sizes)), sizes)
    numbers, owners = [mixed(hashes), mixed(stems)], [text, text]
    for skip in SKIPS:
        if len(hashes) > skip:
            inside = text[skip:] == text[:-skip]
            pair = hashes[:-skip] * ODD[0] + hashes[skip:] * ODD[1] + np.uint64(skip)
            numbers.append(mixed(pair[inside]))
            owners.append(text[skip:][inside])
    shift = np.uint64(64 - BITS)
    return (np.concatenate(numbers) >> shift).astype(np.int64), np.concatenate(owners)


class Ftrl:
    """FTRL-proximal state (z, n) and its steps; each coordinate has a learning rate of its own."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z, n

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        """One step on the distinct features ``at`` (all of value 1) of a row."""
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows if there are more, chosen by a hash of ``key``; all rows if not."""
    n = rows.count()
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < F.lit(most / n * (1 << 20)))


def train(texts: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "label",
          most_rows: int = MOST_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the nonzero weights; number 2**BITS is the intercept.

    Learns from about ``most_rows`` labelled rows at most, chosen by a hash of the id. Their features are made in
    parallel and written once. The learner is online, so one task streams over that bounded table, in the order of the
    hash; an epoch is a job, and the state between epochs is what the driver holds. Rows with a null label are not learned
    from; without rows there are no weights, and every score is one half.
    """
    spark = prepare(texts.sparkSession)
    size = (1 << BITS) + 1
    rows = sample(texts.filter(F.col(label).isNotNull()), doc_id, most_rows).select(
        F.xxhash64(doc_id).alias("key"), F.col(label).cast("int").alias("label"), lowered(text).alias("text"))

    def prepare_rows(batches):
        hashes = WordHashes(word_key, stem)
        for batch in slices(batches, "text"):
            numbers, owners = features(*hashes([t.split() for t in batch.column("text").to_pylist()]))
            order = np.argsort(owners, kind="stable")
            numbers, cuts = numbers[order], np.searchsorted(owners[order], np.arange(1, batch.num_rows))
            found = [np.append(np.unique(f), size - 1).astype(np.int32) for f in np.split(numbers, cuts)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(found, pa.list_(pa.int32()))],
                                             ["key", "label", "numbers"])

    rows = materialize(rows.mapInArrow(prepare_rows, "key long, label int, numbers array<int>"), "toxic")
    line = rows.coalesce(1).sortWithinPartitions("key", "label")       # one task, and nothing is shuffled
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(EPOCHS):
        sent = spark.sparkContext.broadcast((z.astype(np.float32), n.astype(np.float32)))

        def epoch(batches):
            state = Ftrl(*(a.astype(np.float64) for a in sent.value))
            for batch in batches:
                numbers = batch.column("numbers")
                flat, ends = numbers.flatten().to_numpy(), numbers.value_lengths().to_numpy().cumsum()
                for found, y in zip(np.split(flat, ends[:-1]), batch.column("label").to_pylist()):
                    state.learn(found, y)
            at = np.flatnonzero(state.n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(state.z[at].astype(np.float32)), pa.array(state.n[at].astype(np.float32))],
                                             ["at", "z", "n"])

        learned = line.mapInArrow(epoch, "at long, z float, n float").toArrow()
        at = learned.column("at").to_numpy()
        z[at], n[at] = learned.column("z").to_numpy(), learned.column("n").to_numpy()
        sent.unpersist()
    w = Ftrl(z, n).weights()
    at = np.flatnonzero(w)
    return at, w[at].astype(np.float32)


def toxicity(spark: SparkSession, model: tuple[np.ndarray, np.ndarray], text: str = "text") -> Column:
    """The probability of label 1 for the text of each row; null and empty texts have the intercept alone.

    The model that is broadcast has at most 2**BITS + 1 weights, of which L1 leaves few.
    """
    sent = prepare(spark).sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, values = sent.value
        weights = np.zeros((1 << BITS) + 1, np.float32)
        weights[at] = values
        hashes = WordHashes(word_key, stem)
        for batch in batches:
            done = [np.empty(0)]
            for texts in cut(batch.tolist()):
                numbers, owners = features(*hashes([t.split() for t in texts]))
                hit = np.flatnonzero(weights[numbers])      # a feature counts once a text
                pairs = np.unique(owners[hit] << (BITS + 1) | numbers[hit])
                sums = np.bincount(pairs >> (BITS + 1), weights[pairs & ((2 << BITS) - 1)], minlength=len(texts)) + weights[-1]
                done.append(1 / (1 + np.exp(-sums)))
            yield pd.Series(np.concatenate(done))

    return score(lowered(text))


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows that score below the threshold, with all their columns; each row is decided alone, so nothing is joined."""
    return docs.filter(toxicity(docs.sparkSession, model, text) < threshold)
