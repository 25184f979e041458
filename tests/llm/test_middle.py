"""Fill-in-the-middle: the boundary set against a plain scan, exact round trips, edge cases."""

import hashlib
import re

import numpy as np
import pytest

from duelmark.llm.middle import (CHUNK, ArrayContainer, BitmapContainer, BoundarySet, RunContainer, container, fill_in_middle, restore)

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_cuts(text: str) -> list[int]:
    ends = [0]
    for m in TOKEN.finditer(text):
        ends.append(len(text[:m.end()].encode()))
    return ends


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a ", "é  ü\n😀 \t", "x y " * 40_000, "w" * 200_000 + " end", " " * 70_000 + "z", "a b\n" * 20_000])
def test_boundaries_equal_a_plain_scan(text):
    want = plain_cuts(text)
    got = BoundarySet(text.encode())
    assert len(got) == len(want) - 1
    every = max(1, len(want) // 500)
    assert [got.cut(k) for k in range(0, len(want), every)] == want[::every]
    assert got.cut(len(got)) == want[-1]


@pytest.mark.parametrize("values, kind", [
    (np.arange(0, CHUNK, 17), ArrayContainer), (np.arange(0, CHUNK, 2), BitmapContainer),
    (np.r_[0:9000, 20_000:65_536], RunContainer), (np.array([65_535]), ArrayContainer)])
def test_containers_select_every_value(values, kind):
    made = container(values)
    assert isinstance(made, kind)
    assert [made.select(k) for k in range(0, len(values), 7)] == values[::7].tolist() and made.select(len(values) - 1) == values[-1]


def by_hand(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * k:8 * k + 8], 16) for k in range(4))
    w = TOKEN.findall(text)
    n = len(w)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_examples_equal_brute_force_and_restore(spark):
    long = " ".join(f"wörd{k}" for k in range(60_000))
    texts = [None, "", " ", "a", "two words", " lead and trail \n", "a <P> in it", "<S", "P> <", "< <S < P>", "é😀 ü\t\n x", long]
    rows = [(i * 31 + k, t, "x", "y", 7) for i, t in enumerate(texts) for k in range(12)] + [(None, "no id at all", "x", "y", 7), (3, "two words", "x", "y", 7)]
    # columns with the names that the operator uses inside
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string, output string, h0 int").repartition(3)
    made = fill_in_middle(docs)
    got = made.withColumn("restored", restore(made.output, made.form)).collect()
    want = {(r[0], r[1]): by_hand(r[0], r[1]) for r in rows}
    assert len(got) == len(rows)
    assert {tuple(r)[:-1] for r in got} == set(want.values())
    assert sorted((r.doc_id or -1, r.restored) for r in got) == sorted((r[0] or -1, r[1] or "") for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0)).count() == 0
