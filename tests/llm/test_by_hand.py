"""Learners, fingerprints and scores again in plain Python, step by step."""

import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from duelmark.llm import lm, quality as qu, toxicity as tox
from duelmark.llm.html import extract_main_text
from duelmark.llm.lm import score_texts
from duelmark.llm.packing import Levels
from duelmark.llm.simhash import drop_near_copies, fingerprint
from duelmark.llm.warc import read_captures, url_key, write_archive
from duelmark.llm.words import WordHashes


def test_ftrl_steps():
    rng = np.random.default_rng(1)
    state = tox.Ftrl(np.zeros(30), np.zeros(30))
    z, n = [0.0] * 30, [0.0] * 30
    for _ in range(400):
        found = np.unique(rng.integers(0, 30, 6))
        label = int(3 in found or rng.random() < 0.2)
        state.learn(found, label)
        # the published update, one coordinate after the other
        w = {}
        for i in found.tolist():
            w[i] = 0.0 if abs(z[i]) <= tox.L1 else -(z[i] - math.copysign(tox.L1, z[i])) / ((tox.BETA + math.sqrt(n[i])) / tox.ALPHA + tox.L2)
        p = 1 / (1 + math.exp(-sum(w.values())))
        for i in w:
            g = p - label
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / tox.ALPHA
            z[i] += g - sigma * w[i]
            n[i] += g * g
    assert np.allclose(state.z, z) and np.allclose(state.n, n)
    assert state.weights(np.array([3]))[0] > 0


def test_toxic_features_are_words_stems_and_pairs():
    texts = [b"a nasty, word", b"x", b"", b"one two three four five"]
    begins, hashes, stems = WordHashes(tox.word_key, tox.stem)([t.split() for t in texts])
    numbers, owners = tox.features(begins, hashes, stems)
    sizes = [len(t.split()) for t in texts]
    want = [2 * k + sum(max(0, k - skip) for skip in tox.SKIPS) for k in sizes]
    assert np.bincount(owners, minlength=4).tolist() == want and numbers.min() >= 0 and numbers.max() < 1 << tox.BITS


def test_bradley_terry_weights_are_at_the_optimum():
    rng = np.random.default_rng(2)
    d = rng.normal(size=(600, 5)) + np.array([0.8, -0.4, 0, 0, 0.1])
    w = qu.fit_pairs(d)

    def loss(v):
        return np.logaddexp(0, -(d @ v)).mean() + qu.RIDGE / 2 * v @ v

    for _ in range(50):
        assert loss(w) <= loss(w + rng.normal(size=5) * 1e-2) and loss(w) <= loss(w + rng.normal(size=5))
    slow = np.zeros(5)
    for _ in range(4000):
        slow -= -(d / (1 + np.exp(d @ slow))[:, None]).mean(axis=0) + qu.RIDGE * slow
    assert np.allclose(w, slow, atol=1e-4)


def test_the_bar_parts_as_many_as_the_labels_say():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, len(qu.FEATURES))), rng.integers(0, 2, 200)
    x[:, 0] += 2 * y
    ranking = qu.learn_ranking(x, y)
    assert (ranking.strengths(x) > ranking.bar).sum() == y.sum()


@pytest.mark.parametrize("text", ["", "one", "one two three", "One TWO three four", "a b c d e f g a b c d e f g", "é ü\tß\nx y z " * 7, "same same same same same same"])
def test_fingerprint_from_its_definition(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in lowered.replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    want = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s.encode(), seed=42) >> bit & 1 for s in shingles)
        want |= (2 * ones > len(shingles)) << bit if shingles else 0
    assert fingerprint(text.encode()) == want


@pytest.mark.parametrize("seed", range(4))
def test_sum_of_squares_level(seed):
    rng = np.random.default_rng(seed)
    levels = Levels(20)
    for _ in range(300):
        size = int(rng.integers(1, 20))
        # counts of windows by fill level; full windows leave
        choices = {}
        for at in range(0, 20 - size + 1):
            if at and not levels.counts[at]:
                continue
            after = levels.counts.copy()
            after[at] -= at > 0
            if at + size < 20:
                after[at + size] += 1
            choices[at] = int((after[1:20] ** 2).sum())
        best = min(choices.values())
        assert levels.level_for(size) == max(at for at, v in choices.items() if v == best)
        levels.place(("d", 0, size, np.zeros(size, np.uint32)), size)


@pytest.mark.parametrize("most", [1 << 27, 1 << 12])
def test_interpolated_scores(spark, monkeypatch, most):
    """Scores from exact n-gram counts at the filter's precision, by broadcast and slice by slice."""
    monkeypatch.setattr(lm, "MOST_FILTER_BITS", most)
    rng = np.random.default_rng(7)
    texts = [(i, " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 30)))) for i in range(60)] + [(60, None), (61, "never seen")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in score_texts(docs, F.col("doc_id") % 10 == 0).collect()}
    tokens = {i: [*(t or "").split(), "</s>"] for i, t in texts}
    single, pair = Counter(), Counter()
    for i, line in tokens.items():
        if i % 10:
            single.update(line)
            pair.update(zip([None, *line], line))
    n, v = sum(single.values()), len(single)

    def about(c):
        return 0.0 if not c else 1.0 if c == 1 else 1.45 * 2.0 ** int(math.log2(c))

    for i, line in tokens.items():
        want = 0.0
        for before, word in zip([None, *line], line):
            c = about(single[word])
            held = about(single["</s>"]) if before is None else about(single[before])
            both = min(about(pair[before, word]), held, c)
            want += math.log10((1 - lm.WEIGHT) * (c + lm.SMOOTHING) / (n + lm.SMOOTHING * (v + 1)) + lm.WEIGHT * (both / held if held else 0.0))
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_pages_with_clashing_columns(spark):
    rows = [(1, "http://a.example/1", "<p>some text</p>", "x", 1, 2, "y"), (2, None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string, page int, host int, text string")
    assert sorted((r.page_id, r.text) for r in extract_main_text(pages).collect()) == [(1, "some text"), (2, "")]
    pages = pages.withColumnsRenamed({"path": "key", "page": "payload", "host": "record_type", "text": "digest"})
    got = read_captures(write_archive(pages), pages.select(url_key("url").alias("key"))).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in got) == [(1, b"<p>some text</p>"), (2, b"")]


def test_near_copies_with_clashing_columns(spark):
    rows = [(1, "a b c d e f", "k", 1), (1, "a b c d e f", "l", 2), (1, "quite another text is here", "m", 3), (None, "a b c d e f", "n", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _fp string, _gone int")
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r.text for r in kept.collect()} == {"a b c d e f", "quite another text is here"} and all(r._fp for r in kept.collect())


def test_quality_learns_from_every_row_by_jobs(spark):
    from duelmark.llm.quality import train

    rng = np.random.default_rng(5)
    words = ["plain", "prose", "goes", "ON", "and", "on!", "12", "***", "line\nbreak"]
    for shares in ((0.7, 300), (0.02, 200)):              # in the second, the other label outnumbers all rivals
        rows = [(i, " ".join(rng.choice(words[:6] if good else words, rng.integers(1, 30))), int(good))
                for i, good in enumerate(rng.random(shares[1]) < shares[0])] + [(9000 + i, "equal copies here", 0) for i in range(40)]
        known = spark.createDataFrame([*rows, (None, "no id", 1)], "doc_id long, text string, label int")
        whole, spread = train(known), train(known, most_rows=50)
        for a, b in zip(whole, spread):
            assert np.allclose(a, b, rtol=1e-6, atol=1e-6)
        assert np.allclose(spread.centre, np.mean([qu.describe(t.encode()) for _, t, _ in rows] + [qu.describe(b"no id")], axis=0))
