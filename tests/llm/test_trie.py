"""Conversation trie: range minima against plain scans, tries against brute force, edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelmark.llm import trie
from duelmark.llm.trie import Extents, common_prefixes, conversation_trie, least_between


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 300])
def test_extents_and_minima(n):
    rng = np.random.default_rng(n)
    links, values = rng.integers(0, 5, n), rng.permutation(n)
    item, depth = np.repeat(np.arange(n), 6), np.tile(np.arange(6), n)
    made = Extents(links)
    left, right = made.left(item, depth), made.right(item, depth)
    for i, d, a, b in zip(item.tolist(), depth.tolist(), left.tolist(), right.tolist()):
        x = y = i
        while x and links[x] >= d:
            x -= 1
        while y + 1 < n and links[y + 1] >= d:
            y += 1
        assert (a, b) == (x, y)
    assert (least_between(values, left, right) == [values[a:b + 1].min() for a, b in zip(left, right)]).all()


def test_common_prefixes():
    turn = [bytes([k]) * 16 for k in range(4)]
    paths = [b"", turn[0], turn[0] + turn[1], turn[0] + turn[1] + turn[2], turn[0] + turn[2], turn[0] + turn[2], turn[3]]
    assert common_prefixes(paths).tolist() == [0, 0, 1, 2, 1, 2, 0]
    assert common_prefixes([b"", b""]).tolist() == [0, 0]


def by_hand(rows, head):
    """rows: (conv_id, turn, role, text); the contract's trie in plain Python."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, digest), role, text))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    built = {c: tuple(own.get(c - c % 5, [])[:head(c)] + turns[head(c):]) for c, turns in own.items()}
    members = {}
    for c, line in built.items():
        for d in range(len(line) + 1):
            members.setdefault(line[:d], []).append(c)
    nodes = {}
    for path, own_members in members.items():
        ends = [c for c in own_members if built[c] == path]
        nodes[path] = [min(own_members), len(path), min(members[path[:-1]]) if path else None, len(own_members), 0, 0, 0,
                       hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest()]
    for path in nodes:
        if path:
            nodes[path[:-1]][4] += 1
    for path, node in nodes.items():
        leaf, saved = node[4] == 0, (node[3] - 1) * len(path[-1][1].encode()) if path else 0
        for k in range(len(path) + 1):
            nodes[path[:k]][5] += leaf
            nodes[path[:k]][6] += saved
    return sorted(tuple(n) for n in nodes.values())


def crc(c):
    return zlib.crc32(str(c).encode()) % 9


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("case", ["mixed", "copies", "chain", "hot first turn"])
def test_trie_equals_brute_force(spark, case):
    rng = random.Random(case)
    rows = []
    for c in range(120):
        if case == "mixed":
            turns = [(rng.choice([None, 0, 1, 2]), rng.choice(["user", None]), rng.choice(["é", "b", None, ""])) for _ in range(rng.randint(1, 5))]
        elif case == "copies":
            turns = [(k, "user", "same" if c % 3 else f"own {c % 7}") for k in range(4)]
        elif case == "chain":
            turns = [(k, "user", "x") for k in range(1 + c % 40)]
        else:
            turns = [(0, "user", "hello"), (1, "bot", f"answer {c % 50}"), (2, "user", rng.choice("abc"))]
        rows += [(c * 3 + (c % 2) * 1000, *t, "z", 5) for t in turns]
    rows += [(None, 0, "user", "nowhere", "z", 5)] + rows[:3]
    # columns with the names that the operator uses inside
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string, depth int").repartition(4)
    got = conversation_trie(table).select(*NAMES).collect()
    want = by_hand([r[:4] for r in rows], crc)
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_heads_and_empty_tables(spark):
    rows = [(0, 0, "user", "a"), (0, 1, "user", "b"), (1, 0, "user", "c"), (2, 0, "user", "a"), (7, 0, "user", "d"), (-3, 0, "user", "e")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversation_trie(table, head=F.lit(1)).select(*NAMES).collect()
    # -3 lies in the group of 0; 7 in that of 5, which is absent
    built = {0: "ab", 1: "a", 2: "a", 7: "", -3: "a"}
    root = next(r for r in got if r.depth == 0)
    assert (root.conv_id, root.n_convs, root.n_children, root.n_leaves) == (-3, len(built), 1, 1)
    assert root.ends_sha256 == hashlib.sha256(b"7").hexdigest()
    one = next(r for r in got if r.depth == 1)
    assert (one.conv_id, one.n_convs, one.parent_conv_id, one.saved_tokens) == (-3, 4, -3, 3)
    assert conversation_trie(table.limit(0)).count() == 0
    # only turnless conversations: the root is the one leaf
    alone = conversation_trie(table.filter("conv_id = 7"), head=F.lit(3)).collect()
    assert [(r.depth, r.n_convs, r.n_children, r.n_leaves) for r in alone] == [(0, 1, 0, 1)]


def test_blocks_of_every_size_give_the_same_trie(spark, monkeypatch):
    rows = [(c, k, "user", f"{c % 4 if k < 2 else c % 9}") for c in range(90) for k in range(1 + c % 5)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = sorted(by_hand(rows, crc), key=repr)
    for turns in (1, 40, 10_000):
        monkeypatch.setattr(trie, "TURNS_PER_BLOCK", turns)
        assert sorted((tuple(r) for r in conversation_trie(table).select(*NAMES).collect()), key=repr) == want
