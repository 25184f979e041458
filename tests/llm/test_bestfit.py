"""Best-fit packing: sweeps against a plain best fit by decreasing length, whole packings, edge cases."""

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelmark.llm.bestfit import DOCUMENTS, GAPS, MATCH, pack_best_fit, place, sweep
from duelmark.llm.packing import pack_documents
from duelmark.llm.tokens import WordTokens

WINDOW = 64
TOKENIZER = "word_bpe_49k.json"


def plain(lengths, window):
    gaps, bins = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else window
        bins += gap == window
        if gap > n:
            insort(gaps, gap - n)
    return bins


def runs_of(lengths):
    made, rank = [], 0
    for n, k in sorted(Counter(lengths).items(), reverse=True):
        made.append((DOCUMENTS, n, rank, k))
        rank += k
    return made


def check(found, lengths, window):
    """Matches cover every rank once, and sequences are gapless and within the window; their number."""
    line = sorted(lengths, reverse=True)
    seen, used = set(), {}
    for value, first, n, bin, per_bin, offset in found:
        for k in range(n):
            assert line[first + k] == value and first + k not in seen
            seen.add(first + k)
            used.setdefault(bin + k // per_bin, []).append((offset + k % per_bin * value, value))
    assert len(seen) == len(line)
    for pieces in used.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= window
    return len(used)


@pytest.mark.parametrize("seed", range(6))
def test_a_sweep_over_one_range_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [10, 20, 33, 50, 64, 65][seed], 400).tolist()
    want = plain(lengths, WINDOW)
    found = list(sweep(runs_of(lengths) + [(GAPS, WINDOW, 0, want)], WINDOW))
    assert not [f for f in found if f[0] == DOCUMENTS]
    assert check([f[1:] for f in found if f[0] == MATCH], lengths, WINDOW) == want
    left = sum(f[1] * f[3] for f in found if f[0] == GAPS)
    assert left == want * WINDOW - sum(lengths)


@pytest.mark.parametrize("lengths", [[7] * 300, [33] * 50 + [31] * 10 + [1] * 900, [64] * 5, list(range(1, 65)) * 4, [63, 62] * 40 + [2] * 30])
def test_supersteps_place_every_document(spark, lengths):
    documents = spark.createDataFrame(runs_of(lengths), "kind int, value long, first long, n long")
    found = place(documents, WINDOW).select("value", "first", "n", "bin", "per_bin", "offset").collect()
    assert check([tuple(r) for r in found], lengths, WINDOW) <= plain(lengths, WINDOW) + 1


def test_whole_packing(spark):
    long = " ".join(f"word{k}" for k in range(900))
    rows = [(1, None), (2, ""), (3, "x"), (None, "no id"), (4, long), (4, long), (5, " \n"), *((k, f"text number {k} of many") for k in range(10, 210))]
    # columns with the names that the operator uses inside
    docs = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], "doc_id long, text string, doc string, length int, `at` int").repartition(3)
    got = pack_best_fit(docs, TOKENIZER, window=WINDOW, ids=True).collect()
    encode = WordTokens(TOKENIZER)
    want = Counter()
    for i, t in rows:
        ids, _ = encode([(t or "").encode()], 0)
        for k, start in enumerate(range(0, len(ids), WINDOW)):
            want[i, k, start, ids[start:start + WINDOW].astype("<u4").tobytes()] += 1
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in got) == want
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.length * 4 == len(r.ids) for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        assert [o for o, _ in sorted(pieces)] == np.cumsum([0] + [n for _, n in sorted(pieces)])[:-1].tolist()
        assert sum(n for _, n in pieces) <= WINDOW
    assert len(sequences) <= plain([r.length for r in got], WINDOW) + 1
    assert pack_best_fit(docs.limit(0), TOKENIZER).count() == 0


def test_end_ids_of_two_packings_in_one_worker(spark):
    """Both packings share a worker's words, but each closes its texts with its own id."""
    docs = spark.createDataFrame([(1, "some words"), (2, "other words")], "doc_id long, text string").coalesce(1)
    for _ in range(2):
        ones = pack_documents(docs, TOKENIZER).agg(F.max_by("ids", "start")).first()[0]
        zeros = pack_best_fit(docs, TOKENIZER, ids=True).agg(F.max_by("ids", "start")).first()[0]
        assert bytes(ones[-4:]) == b"\1\0\0\0" and bytes(zeros[-4:]) == b"\0\0\0\0"
