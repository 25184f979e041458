"""Language-model scores with n-gram counts in a log-frequency Bloom filter."""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from duelmark.llm.batches import gathered, prepare, slices, utf8
from duelmark.llm.words import ODD, WordHashes, mixed
from duelmark.session import drop_path, materialize, scratch_path

END = b"\n"                     # closes every text; no word holds white space
SMOOTHING = 0.1                 # added to every unigram count
WEIGHT = 0.35                   # of the bigram estimate against the unigram one
FREQUENT = 100_000              # words whose counts are broadcast, at most
FLUSH = 100_000                 # distinct words that a task counts before it hands them on
LEXICON = 150_000               # words that a worker keeps at hand
HELD_KEYS = 1_000_000           # n-grams that a task holds before it hands them on
KEY_BITS = 40                   # of an n-gram's hash
PROBES = 4                      # bits set for each level of an n-gram
BITS_PER_ENTRY = 8
MOST_FILTER_BITS = 1 << 27      # 16 MiB, the most that is broadcast; a larger filter is probed slice by slice where it is built
COUNT_BITS = 24                 # of a slice's count beside its key when both are sorted as one number
LEAST_FILTER_BITS = 1 << 20
SLICE = 2 << 20                 # bytes of text scored at once
SEGMENTS = 256                  # slices of the filter, built in parallel, at least


def level(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 for 1, then one more for every doubling."""
    return 1 + np.log2(counts).astype(np.int64)


def expected(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for, the middle of its range; 0 for level 0."""
    return np.where(levels == 0, 0.0, np.where(levels == 1, 1.0, 1.45 * 2.0 ** (levels - 1)))


def unigram_keys(hashes: np.ndarray) -> np.ndarray:
    return mixed(hashes * ODD[2]) >> np.uint64(64 - KEY_BITS)


def bigram_keys(begins: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Keys of the bigrams that end at each token; before a text's first token there is a place of its own."""
    previous = np.empty_like(hashes)
    previous[1:] = hashes[:-1]
    previous[begins[:-1]] = 0
    return mixed(previous * ODD[0] + hashes * ODD[1]) >> np.uint64(64 - KEY_BITS)


def offset(keys: np.ndarray, number: int, probe: int, size: int) -> np.ndarray:
    """Places in a slice of ``size`` bits, one of ``PROBES`` that stand for an n-gram having ``number``."""
    return mixed(keys + np.uint64((number * PROBES + probe) * int(ODD[3]) & 0xFFFFFFFFFFFFFFFF)) & np.uint64(size - 1)


def filter_slice(keys: np.ndarray, levels: np.ndarray, size: int) -> bytes:
    """A slice of the filter: every n-gram is entered with each of the numbers 1 to its level."""
    bits = np.zeros(size, bool)
    for number in range(1, int(levels.max(initial=0)) + 1):
        own = keys[levels >= number]
        for probe in range(PROBES):
            bits[offset(own, number, probe, size)] = True
    return np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """Log-frequency Bloom filter: the largest number that answers yes from 1 on is an n-gram's level.

    One-sided errors only raise a level. All bits of an n-gram lie in the slice that its key's leading bits choose, so
    slices are built apart.
    """

    def __init__(self, data: np.ndarray, segments: int):
        self.data = data
        self.size = len(data) * 8 // segments
        self.shift = np.uint64(KEY_BITS - segments.bit_length() + 1)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Probe with one number after the other until one is missing."""
        out = np.zeros(len(keys), np.int64)
        base = (keys >> self.shift) * np.uint64(self.size)
        active, number = np.arange(len(keys)), 1
        while len(active):
            # most of those that have not the number leave at the first place
            for probe in range(PROBES):
                at = offset(keys[active], number, probe, self.size) + base[active]
                active = active[(self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
            out[active] = number
            number += 1
        return out


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts: differences, byte plane by byte plane, compressed."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    planes = np.concatenate([gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T[:KEY_BITS // 8], counts.astype("<u4").view(np.uint8).reshape(-1, 4).T])
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(KEY_BITS // 8 + 4, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, :KEY_BITS // 8] = planes[:KEY_BITS // 8].T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64), np.ascontiguousarray(planes[KEY_BITS // 8:].T).view("<u4").ravel().astype(np.int64)


def merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their summed counts; small counts are sorted with their keys as one number."""
    if len(counts) and counts.max() < 1 << COUNT_BITS:
        both = np.sort(keys << np.uint64(COUNT_BITS) | counts.astype(np.uint64))
        keys, counts = both >> np.uint64(COUNT_BITS), (both & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def tokens_of(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def unigram_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over the binary column ``text``: counted in each task first, so frequent words are few rows."""
    def read(batches):
        held: Counter = Counter()

        def flushed():
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
            held.clear()
            return made

        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                held.update(tokens_of(text))
            if len(held) > FLUSH:
                yield flushed()
        yield flushed()

    return texts.mapInArrow(read, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def ngram_blocks(texts: DataFrame, segments: int) -> DataFrame:
    """(segment, block): packed n-gram keys and counts of each task, dealt by the slice of the filter they belong to."""
    def read(batches):
        hashes = WordHashes(most=LEXICON)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flushed():
            keys, counts = merge(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            held.clear()
            owner = (keys >> np.uint64(KEY_BITS - segments.bit_length() + 1)).astype(np.int64)
            cuts = np.searchsorted(owner, np.arange(segments + 1))
            found = [s for s in range(segments) if cuts[s] < cuts[s + 1]]
            return pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int32()), pa.array([pack(keys[cuts[s]:cuts[s + 1]], counts[cuts[s]:cuts[s + 1]]) for s in found], pa.binary())],
                ["segment", "block"])

        for batch in gathered(batches, "text", SLICE):
            begins, h = hashes([tokens_of(t) for t in batch.column("text").to_pylist()])
            keys = np.concatenate([unigram_keys(h), bigram_keys(begins, h)])
            keys.sort()
            held.append(merge(keys, np.ones(len(keys), np.int64)))
            if sum(len(k) for k, _ in held) > HELD_KEYS:
                yield flushed()
        if held:
            yield flushed()

    return texts.mapInArrow(read, "segment int, block binary")


def _merged(blocks: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack(b) for b in blocks]
    return merge(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


def filter_shape(tokens: int) -> tuple[int, int]:
    """Bits of the filter and the slices it is cut into.

    The size follows the corpus: at least ``BITS_PER_ENTRY`` for as many entries as tokens. A slice is merged in one task:
    about as many n-grams as two million tokens give.
    """
    bits = max(LEAST_FILTER_BITS, 1 << max(0, tokens * BITS_PER_ENTRY - 1).bit_length())
    return bits, min(bits >> 10, max(SEGMENTS, 1 << (tokens // 2_000_000).bit_length()))


def build_filter(blocks: DataFrame, bits: int, segments: int) -> Filter:
    """The filter of all n-grams of ``blocks``; its slices are built apart."""
    size = bits // segments

    def build(part: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(part["block"])
        return pd.DataFrame({"segment": [int(part["segment"].iloc[0])], "data": [filter_slice(keys, level(counts), size)]})

    data = np.zeros(bits >> 3, np.uint8)
    for segment, piece in blocks.groupBy("segment").applyInPandas(build, "segment int, data binary").collect():
        data[segment * size >> 3:(segment + 1) * size >> 3] = np.frombuffer(piece, np.uint8)
    return Filter(data, segments)


def questions(begins: np.ndarray, at: np.ndarray, table: np.ndarray, learned: np.ndarray, segments: int) -> tuple[list[int], list[bytes]]:
    """What a slice of texts tells and asks a filter that is not broadcast, by the filter's slices.

    The distinct keys of the texts, each with its count in the texts that are ``learned`` from; and, as number -1, the words'
    hashes and every token's place in them, from which the keys follow again.
    """
    present = np.bincount(at, minlength=len(table)) > 0
    words = table[np.flatnonzero(present)]
    places = (np.cumsum(present) - 1)[at]
    taught = np.repeat(learned, np.diff(begins)).astype(np.int64)
    keys, counts = merge(np.concatenate([unigram_keys(words), bigram_keys(begins, words[places])]),
                         np.concatenate([np.bincount(places, taught, len(words)).astype(np.int64), taught]))
    cuts = np.searchsorted((keys >> np.uint64(KEY_BITS - segments.bit_length() + 1)).astype(np.int64), np.arange(segments + 1))
    found = [s for s in range(segments) if cuts[s] < cuts[s + 1]]
    packed = [pack(keys[cuts[s]:cuts[s + 1]], counts[cuts[s]:cuts[s + 1]]) for s in found]
    planes = places.astype("<u4").view(np.uint8).reshape(-1, 4).T[:place_bytes(len(words))]
    stream = b"".join([np.array([len(begins), len(words)], "<i8").tobytes(), begins.astype("<i8").tobytes(), words.astype("<u8").tobytes(), planes.tobytes()])
    return [-1, *found], [zstandard.ZstdCompressor(level=1).compress(stream), *packed]


def place_bytes(words: int) -> int:
    """Bytes of a token's place among the distinct words of its slice."""
    return 3 if words <= 1 << 24 else 4


def sliced_scores(asked: DataFrame, path: str, bits: int, segments: int, tokens: int, vocabulary: int) -> DataFrame:
    """(row, score) from ``questions`` (row of the first text, segment, block), which lie at ``path`` by their kind.

    A slice of the filter gets the keys of all texts that lie in it: their counts are summed and entered, and then the slice
    is probed with every distinct key; the levels go back to the texts that asked. A key is told once per slice of texts,
    so that frequent n-grams are not hot. Nothing is broadcast.
    """
    size = bits // segments

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        told = [unpack(b) for b in part["block"]]
        keys, counts = merge(np.concatenate([k for k, _ in told]), np.concatenate([c for _, c in told]))
        known = counts > 0
        grams = Filter(np.frombuffer(filter_slice(keys[known], level(counts[known]), size), np.uint8), 1)
        levels, compress = grams.levels(keys).astype(np.uint8), zstandard.ZstdCompressor(level=1).compress
        return pd.DataFrame({"row": part["row"], "segment": part["segment"],
                             "levels": [compress(levels[np.searchsorted(keys, k)].tobytes()) for k, _ in told]})

    def score(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        data = zstandard.ZstdDecompressor().decompress(texts["block"].iloc[0])
        n, m = np.frombuffer(data, "<i8", 2).tolist()
        begins, words = np.frombuffer(data, "<i8", n, 16), np.frombuffer(data, "<u8", m, 16 + 8 * n)
        planes = np.frombuffer(data, np.uint8, offset=16 + 8 * (n + m)).reshape(place_bytes(m), -1)
        places = sum(plane.astype(np.int64) << 8 * k for k, plane in enumerate(planes))
        pairs, single = bigram_keys(begins, words[places]), unigram_keys(words)
        keys = np.unique(np.concatenate([single, pairs]))
        answers = answers.sort_values("segment")
        counts = expected(np.frombuffer(b"".join(map(zstandard.ZstdDecompressor().decompress, answers["levels"])), np.uint8).astype(np.int64))
        word = counts[np.searchsorted(keys, single)][places]
        found = text_scores(counts[np.searchsorted(keys, pairs)], word, begins, tokens, vocabulary)
        return pd.DataFrame({"row": int(texts["row"].iloc[0]) + np.arange(len(found)), "score": found})

    levels = asked.filter("kind = 'questions'").groupBy("segment").applyInPandas(answer, "row long, segment int, levels binary")
    levels = materialize(levels, "levels")
    drop_path(asked.sparkSession, f"{path}/kind=questions")     # answered; their disk is free for the next step
    scores = asked.filter("kind = 'streams'").groupBy("row").cogroup(levels.groupBy("row")).applyInPandas(score, "row long, score double")
    return materialize(scores, "scores")


def score_texts(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Log10 probability of every text by a model of the texts that are not held out.

    The model interpolates bigram and smoothed unigram estimates; the counts of both come from a log-frequency Bloom
    filter, by probing level after level. It holds every n-gram and grows with the corpus: up to ``MOST_FILTER_BITS`` every
    worker has it, and beyond that the texts' keys go to its slices. Both ways give the same scores. Beside it stands the exact unigram score: counts of
    frequent words, at most ``FREQUENT``, are broadcast too, and the others are joined, so that no word is a hot key.

    Null and empty texts are the end token alone. Repeated rows count, and are scored, as often as they occur. Without
    any text to learn from all counts are 0. Ids may be null or repeat.

    Returns one row per input row: the id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc"), F.coalesce(held_out, F.lit(False)).alias("held_out"), utf8(text).alias("text"))
    learned = rows.filter(~F.col("held_out")).select("text")
    counts = materialize(unigram_counts(learned), "unigrams")
    tokens, vocabulary = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    norm = float(np.log10(tokens + SMOOTHING * (vocabulary + 1)))
    bits, segments = filter_shape(tokens)
    sliced = bits > MOST_FILTER_BITS
    ngram_filter = spark.sparkContext.broadcast(None if sliced else build_filter(ngram_blocks(learned, segments), bits, segments))

    # the least count that at most FREQUENT words reach, from a histogram of eighths of doublings
    steps = dict(counts.groupBy(F.floor(F.log2("c") * 8).cast("int").alias("step")).count().collect())
    step, held = max(steps, default=0) + 1, 0
    while step - 1 in range(0, 600) and held + steps.get(step - 1, 0) <= FREQUENT:
        step -= 1
        held += steps.get(step, 0)
    common = counts.filter(F.floor(F.log2("c") * 8) >= step).toArrow()
    common = spark.sparkContext.broadcast(dict(zip(common.column("word").to_pylist(), common.column("c").to_pylist())))
    kind = docs.schema[doc_id].dataType.simpleString()

    def read(batches):
        lexicon = Lexicon(common.value, ngram_filter.value)
        made = TaskContext.get().partitionId() << 33
        for batch in gathered(batches, "text", SLICE):
            split = [tokens_of(t) for t in batch.column("text").to_pylist()]
            begins, at = lexicon.places(split)
            if sliced:
                score = pa.nulls(len(split), pa.float64())
                taught = ~batch.column("held_out").to_numpy(zero_copy_only=False)
                asked, packed = questions(begins, at, lexicon.tables[0][:len(lexicon.known)], taught, segments)
                none = {f.name: pa.nulls(len(asked), f.type) for f in made_schema(batch)}
                yield pa.RecordBatch.from_pydict(none | {"row": pa.array([made] * len(asked)), "segment": pa.array(asked, pa.int32()), "block": pa.array(packed, pa.binary())})
            else:
                pair = expected(ngram_filter.value.levels(bigram_keys(begins, lexicon.tables[0][at])))
                score = pa.array(text_scores(pair, lexicon.values[0][at], begins, tokens, vocabulary))
            logs = lexicon.values[1][at]
            rare = np.flatnonzero(np.isnan(logs))
            words = list(chain.from_iterable(split))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, begins), pa.int32()), pa.array([words[i] for i in rare.tolist()], pa.binary()))
            ids = np.arange(made, made + len(split))
            made += len(split)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), batch.column("doc"), batch.column("held_out"), pa.array(np.diff(begins)), pa.array(np.add.reduceat(np.nan_to_num(logs), begins[:-1])),
                 score, lists, pa.nulls(len(split), pa.int32()), pa.nulls(len(split), pa.binary())], made_schema(batch).names)

    def made_schema(batch):
        return pa.schema({"row": pa.int64(), "doc": batch.column("doc").type, "held_out": pa.bool_(), "n_tokens": pa.int64(), "part": pa.float64(),
                          "score": pa.float64(), "rare": pa.list_(pa.binary()), "segment": pa.int32(), "block": pa.binary()})

    scored = rows.mapInArrow(read, f"row long, doc {kind}, held_out boolean, n_tokens long, part double, score double, rare array<binary>, segment int, block binary")
    kinds = F.when(F.col("segment").isNull(), "texts").when(F.col("segment") < 0, "streams").otherwise("questions")
    path = scratch_path(spark, "scored")
    made = materialize(scored.withColumn("kind", kinds), "scored", partition_by="kind", path=path)
    scored = made.filter("kind = 'texts'").drop("segment", "block", "kind")
    rest = scored.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    rest = rest.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + SMOOTHING)).alias("more"), F.count("c").alias("found"))
    out = scored.select("row", "doc", "held_out", "n_tokens", "part", "score", (F.col("n_tokens") - F.size("rare")).alias("common"))
    out = out.join(rest, "row", "left")
    if sliced:
        asked = made.select("kind", "row", "segment", "block")
        out = out.drop("score").join(sliced_scores(asked, path, bits, segments, tokens, vocabulary), "row", "left")
    return out.select(
        F.col("doc").alias(doc_id), "held_out", "n_tokens", (F.col("common") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"), "score")


class Lexicon(WordHashes):
    """Word hashes with two values a word: its unigram's count in the filter (nan if that is not at hand), and the log of its exact count (nan if rare)."""

    def __init__(self, counts: dict[bytes, int], grams: Filter | None):
        self.counts, self.grams = counts, grams
        super().__init__(most=LEXICON)

    def _clear(self) -> None:
        super()._clear()
        self.values = np.empty((2, self.tables.shape[1]))

    def _learn(self, words: set[bytes]) -> None:
        used, words = len(self.known), list(words)
        super()._learn(words)
        while self.values.shape[1] < self.tables.shape[1]:
            self.values = np.concatenate([self.values, np.empty_like(self.values)], axis=1)
        own = slice(used, used + len(words))
        self.values[0, own] = expected(self.grams.levels(unigram_keys(self.tables[0, own]))) if self.grams else np.nan
        self.values[1, own] = np.log10([self.counts.get(w, np.nan) + SMOOTHING for w in words])


def text_scores(pair: np.ndarray, word: np.ndarray, begins: np.ndarray, tokens: int, vocabulary: int) -> np.ndarray:
    """Sum over each text's tokens of log10 of the interpolated probability; ``word`` are the unigram counts, ``pair`` those of the bigrams."""
    # a text's first token has no word before it; as often as an end token, a text began
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[begins[:-1]] = word[begins[1:] - 1]
    pair = np.minimum(pair, np.minimum(before, word))
    single = (word + SMOOTHING) / (tokens + SMOOTHING * (vocabulary + 1))
    p = (1 - WEIGHT) * single + WEIGHT * np.divide(pair, before, out=np.zeros_like(pair), where=before > 0)
    return np.add.reduceat(np.log10(p), begins[:-1]) if len(begins) > 1 else np.empty(0)
