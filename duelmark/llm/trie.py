"""Prefix trie of conversations: member intervals by range minima over sorted common-prefix lengths."""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from duelmark.llm.batches import prepare
from duelmark.session import materialize

DIGEST = 16                     # bytes of SHA-256 that stand for a turn in a path
TURNS_PER_BLOCK = 200_000       # turns of one range of sorted paths, about
EMPTY = hashlib.sha256().hexdigest()
NODE = ("part int, depth int, conv_id long, n_convs long, n_children long, n_leaves long, shared long, below long, "
        "ends_sha256 string, ends binary, parent long")
TOUCH = ", at_start boolean, at_end boolean, longer boolean, parent_start boolean, parent_end boolean"
EDGE = ", first_path binary, last_path binary, first_bytes array<long>, least int"
OWNER = ", owner int, parent_owner int"


class Extents:
    """Sparse table of minima over ``links`` (what each item shares with the one before it; the first is not read).

    ``left`` and ``right`` binary-search how far a prefix of some depth goes on from an item, each by itself: the table
    halves the step from level to level. Arrays of items and depths are searched together.
    """

    def __init__(self, links: np.ndarray):
        self.size = len(links)
        self.levels = [links[1:]] if self.size > 1 else []
        while self.levels and 2 << len(self.levels) - 1 < self.size:
            step, last = 1 << len(self.levels) - 1, self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def right(self, item: np.ndarray, depth: np.ndarray) -> np.ndarray:
        item = item.copy()
        for k in reversed(range(len(self.levels))):
            step = 1 << k
            inside = item + step < self.size
            item += step * (inside & (self.levels[k][np.where(inside, item, 0)] >= depth))
        return item

    def left(self, item: np.ndarray, depth: np.ndarray) -> np.ndarray:
        item = item.copy()
        for k in reversed(range(len(self.levels))):
            step = 1 << k
            inside = item >= step
            item -= step * (inside & (self.levels[k][np.where(inside, item - step, 0)] >= depth))
        return item


def least_between(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minimum of ``values[begin:end + 1]`` for each interval, from two overlapping powers of two."""
    levels = [values]
    while 1 << len(levels) <= len(values):
        step = 1 << len(levels) - 1
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    power = np.frexp(end - begin + 1)[1] - 1
    out = np.empty(len(begin), values.dtype)
    for k, level in enumerate(levels):
        own = power == k
        out[own] = np.minimum(level[begin[own]], level[end[own] + 1 - (1 << k)])
    return out


def common_prefixes(paths: list[bytes]) -> np.ndarray:
    """Turns that each path shares with the one before it; 0 for the first."""
    data = np.frombuffer(b"".join(paths), "<u8").reshape(-1, DIGEST // 8)
    sizes = np.array([len(p) // DIGEST for p in paths], np.int64)
    begins = np.cumsum(sizes) - sizes
    out = np.zeros(len(paths), np.int64)
    most = np.minimum(sizes[1:], sizes[:-1])
    pair = np.flatnonzero(most)
    turns = most[pair]
    if len(pair):
        starts = np.cumsum(turns) - turns
        place = np.arange(turns.sum()) - np.repeat(starts, turns)
        same = (data[np.repeat(begins[pair], turns) + place] == data[np.repeat(begins[pair + 1], turns) + place]).all(axis=1)
        out[pair + 1] = np.minimum(turns, np.minimum.reduceat(np.where(same, len(data), place), starts))
    return out


def sha_of(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def block_nodes(part: int, conv: np.ndarray, paths: list[bytes], turn_bytes: list[np.ndarray]) -> pa.RecordBatch:
    """All trie nodes of one range of sorted paths, as far as that range shows them.

    Every prefix that a path does not share with the one before it is a candidate; its members are the interval of paths
    between its left and its right extent. Sums over members are differences of running sums. Nodes that reach the range's
    first or last path say so, because their intervals may go on in the ranges beside it.
    """
    n = len(conv)
    sizes = np.array([len(p) // DIGEST for p in paths], np.int64)
    lcp = common_prefixes(paths)
    extents = Extents(lcp)
    begins = np.cumsum(sizes) - sizes
    running = np.concatenate([[0], np.cumsum(np.concatenate(turn_bytes).astype(np.int64))])

    def bytes_to(row, depth):
        return running[begins[row] + depth] - running[begins[row]]

    least = lcp + 1
    least[0] = 0                                            # the root begins at the first path
    counts = sizes - least + 1
    offset = np.cumsum(counts) - counts
    row = np.repeat(np.arange(n), counts)
    depth = least[row] + np.arange(len(row)) - offset[row]
    begin, end = extents.left(row, depth), extents.right(row, depth)

    def node(path, d):
        """The node of depth ``d`` above a path: it begins at the path's left extent."""
        first = extents.left(path, d)
        return offset[first] + d - least[first]

    conv_id = least_between(conv, begin, end)
    shared = np.cumsum(np.where(np.arange(n) > 0, bytes_to(np.arange(n), lcp), 0))
    # the last path's own leaf depends on the next range
    leaf = np.concatenate([[0], np.cumsum(np.append(lcp[1:] < sizes[:-1], False))])
    children = (sizes[begin] > depth).astype(np.int64)
    branch = np.flatnonzero((sizes > lcp) & (np.arange(n) > 0))
    np.add.at(children, node(branch, lcp[branch]), 1)
    up = np.where(depth > least[row], np.arange(len(row)) - 1, -1)
    above = np.flatnonzero((depth == least[row]) & (depth > 0))
    up[above] = node(row[above], depth[above] - 1)
    has_up = up >= 0

    ends_here = np.flatnonzero(depth == sizes[begin])       # nodes in which a conversation ends; its copies follow it
    copies = extents.right(begin[ends_here], depth[ends_here])
    same = np.append((lcp[1:] == sizes[1:]) & (lcp[1:] == sizes[:-1]), False)
    breaks = np.flatnonzero(~same)
    copies = np.minimum(copies, breaks[np.searchsorted(breaks, begin[ends_here])])
    at_start, at_end = begin == 0, end == n - 1
    digest, ends = list(repeat(EMPTY, len(row))), [None] * len(row)
    for k, b, e in zip(ends_here.tolist(), begin[ends_here].tolist(), copies.tolist()):
        digest[k] = sha_of(conv[b:e + 1])
        if at_start[k] or at_end[k]:
            ends[k] = conv[b:e + 1].astype("<i8").tobytes()
    root = np.arange(len(row)) == 0
    edge = [pa.array([paths[0]] + [None] * (len(row) - 1), pa.binary()), pa.array([paths[-1]] + [None] * (len(row) - 1), pa.binary()),
            pa.array([bytes_to(0, np.arange(sizes[0] + 1)).tolist()] + [None] * (len(row) - 1), pa.list_(pa.int64())),
            pa.array(np.full(len(row), lcp[1:].min(initial=np.iinfo(np.int32).max)), pa.int32(), mask=~root)]
    columns = [
        pa.array(np.full(len(row), part), pa.int32()), pa.array(depth, pa.int32()), pa.array(conv_id), pa.array(end - begin + 1),
        pa.array(children), pa.array(leaf[end + 1] - leaf[begin]), pa.array(shared[end] - shared[begin]),
        pa.array(bytes_to(begin, np.maximum(depth - 1, 0))), pa.array(digest, pa.string()), pa.array(ends, pa.binary()),
        pa.array(conv_id[up], mask=~has_up), pa.array(at_start), pa.array(at_end), pa.array(sizes[begin] > depth),
        pa.array(at_start[up] & has_up), pa.array(at_end[up] & has_up), *edge]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in (NODE + TOUCH + EDGE).split(", ")])


def rebuilt(conversations: DataFrame, head: Column, group: int = 5) -> DataFrame:
    """(conv_id, path, turn_bytes): each conversation with the first turns of the one that its group begins with.

    A path is the digests of its turns, one after the other. Only digests and sizes are shuffled, once.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    size = F.octet_length(text).cast("long")
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    conv = F.col("conv_id").cast("long")
    turns = conversations.filter(conv.isNotNull()).select(
        conv.alias("conv_id"), (conv - conv % group).alias("base"), F.struct("turn", digest.alias("digest"), size.alias("size")).alias("turn"))
    own = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("own"))
    first = F.first(F.when(F.col("conv_id") == F.col("base"), F.col("own")), ignorenulls=True).over(Window.partitionBy("base"))
    own = own.withColumn("given", F.coalesce(first, F.slice("own", 1, 0))).withColumn("head", head.cast("int"))
    line = F.concat(F.slice("given", F.lit(1), F.col("head")),
                    F.slice("own", F.col("head") + 1, F.greatest(F.size("own") - F.col("head"), F.lit(0))))
    return own.select("conv_id", line.alias("line")).select(
        "conv_id", F.unhex(F.array_join(F.col("line.digest"), "")).alias("path"), F.col("line.size").alias("turn_bytes"))


class Blocks:
    """What neighbouring ranges share, from their first and last paths: a number or two for each range."""

    def __init__(self, edges):
        self.parts, links, least, first_bytes, last_sizes, last = [], [], [], [], [], None
        for e in edges:
            shared = int(common_prefixes([last, bytes(e.first_path)])[1]) if self.parts else -1
            self.parts.append(e.part)
            links.append(shared)
            least.append(e.least)
            first_bytes.append(e.first_bytes[max(shared, 0)])
            last = bytes(e.last_path)
            last_sizes.append(len(last) // DIGEST)
        self.parts, self.links = np.array(self.parts, np.int64), np.array(links, np.int64)
        self.first_bytes = np.array(first_bytes, np.int64)
        self.next = np.append(self.links[1:], -1)
        self.last_leaf = self.next < np.array(last_sizes, np.int64)
        self.last_leaf[-1:] = True
        # a prefix passes through a range that shares it from its first path to its last
        self.through = Extents(np.minimum(self.links, np.array(least, np.int64)))

    def owner(self, block: np.ndarray, depth: np.ndarray, at_start: np.ndarray, at_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range in which a node begins, -1 for nodes that lie in one range; and whether it began in an earlier one."""
        from_left = at_start & (self.links[block] >= depth)
        to_right = at_end & (self.next[block] >= depth)
        begin = self.through.left(np.maximum(block - 1, 0), depth)
        return np.where(from_left, begin, np.where(to_right, block, -1)), from_left


def conversation_trie(conversations: DataFrame, head: Column | None = None) -> DataFrame:
    """All prefixes that conversations share, with their members.

    Every conversation is first rebuilt: its first ``head`` turns (crc32 of its id modulo 9 by default) are those of the
    first conversation of its group of five. Paths are range-sorted with the id as tie-breaker, so that copies of one
    conversation spread over ranges. A range finds its nodes' intervals alone; the few that reach its edge are merged by
    the range in which they begin, found by the same search over one number per range. The driver and the broadcast hold
    a few numbers per range, and two paths at a time. Ids of conversations that end in one node are hashed as a stream.

    One row per node: conv_id (smallest member), depth, parent_conv_id (the parent's conv_id; null for the root), n_convs,
    n_children, n_leaves (childless nodes below it or itself), saved_tokens (sum over its subtree of members but one,
    times the bytes of the node's last text), ends_sha256 (of the ids, ascending and comma-joined, of conversations that
    end here).

    Turns without a number come first, and turns with equal numbers in the order of their digests; repeated rows are
    turns of their own. Null roles and texts are empty. Rows without conv_id belong to no conversation. An empty table
    gives no rows. Other columns are not read.
    """
    spark = prepare(conversations.sparkSession)
    if head is None:
        head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    lines = materialize(rebuilt(conversations, head), "lines")
    turns = lines.agg(F.sum(F.size("turn_bytes"))).first()[0] or 0
    ranges = max(2 * spark.sparkContext.defaultParallelism, -(-turns // TURNS_PER_BLOCK))
    ordered = lines.repartitionByRange(ranges, "path", "conv_id").sortWithinPartitions("path", "conv_id")

    def nodes(batches):
        rows = list(batches)
        if sum(b.num_rows for b in rows):
            conv = np.concatenate([b.column("conv_id").to_numpy() for b in rows])
            paths = [p for b in rows for p in b.column("path").to_pylist()]
            sizes = [b.column("turn_bytes").flatten().to_numpy() for b in rows]
            yield block_nodes(TaskContext.get().partitionId(), conv, paths, sizes)

    found = materialize(ordered.mapInArrow(nodes, NODE + TOUCH + EDGE), "nodes")
    edges = found.filter(F.col("depth") == 0).select("part", *[f.split()[0] for f in EDGE[2:].split(", ")]).orderBy("part")
    shared = spark.sparkContext.broadcast(Blocks(edges.toLocalIterator()))
    names = [f.split()[0] for f in NODE.split(", ")]

    def resolve(batches):
        blocks = shared.value
        for batch in batches:
            block = np.searchsorted(blocks.parts, batch.column("part").to_numpy())
            depth = batch.column("depth").to_numpy().astype(np.int64)
            at_start, at_end, longer, parent_start, parent_end = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("at_start", "at_end", "longer", "parent_start", "parent_end"))
            owner, from_left = blocks.owner(block, depth, at_start, at_end)
            parent_owner, _ = blocks.owner(block, depth - 1, parent_start, parent_end)
            columns = {c: batch.column(c) for c in names}
            # a child that goes on from the range before was counted there
            known = from_left & longer & (blocks.links[block] > depth)
            columns["n_children"] = pa.array(batch.column("n_children").to_numpy() - known)
            columns["n_leaves"] = pa.array(batch.column("n_leaves").to_numpy() + (at_end & blocks.last_leaf[block]))
            columns["shared"] = pa.array(batch.column("shared").to_numpy() + np.where(from_left, blocks.first_bytes[block], 0))
            columns |= {"owner": pa.array(owner, pa.int32()), "parent_owner": pa.array(np.where(depth > 0, parent_owner, -1), pa.int32())}
            yield pa.RecordBatch.from_pydict(columns)

    resolved = found.select(*names, *[f.split()[0] for f in TOUCH[2:].split(", ")]).mapInArrow(resolve, NODE + OWNER)
    inside = resolved.filter("owner < 0")
    crossing = materialize(resolved.filter("owner >= 0"), "crossing")

    def digests(batches):
        key, state = None, None
        for batch in batches:
            for owner, depth, ends in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "ends"))):
                if (owner, depth) != key:
                    if state:
                        yield pa.RecordBatch.from_pydict({"owner": pa.array([key[0]], pa.int32()), "depth": pa.array([key[1]], pa.int32()),
                                                          "digest": [state.hexdigest()]})
                    key, state, comma = (owner, depth), hashlib.sha256(), b""
                state.update(comma + ",".join(map(str, np.frombuffer(ends, "<i8").tolist())).encode())
                comma = b","
        if state:
            yield pa.RecordBatch.from_pydict({"owner": pa.array([key[0]], pa.int32()), "depth": pa.array([key[1]], pa.int32()),
                                              "digest": [state.hexdigest()]})

    ended = crossing.filter("ends IS NOT NULL").select("owner", "depth", "part", "ends")
    ended = ended.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "part").mapInArrow(
        digests, "owner int, depth int, digest string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "shared")]
    merged = crossing.groupBy("owner", "depth").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("below").alias("below"),
                                                    F.max("parent_owner").alias("parent_owner"))
    merged = merged.join(ended, ["owner", "depth"], "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(EMPTY))).drop("digest")
    merged = materialize(merged, "merged")

    # the parent of a node that lies in one range may be a merged one: told to every range that the parent crosses
    up = merged.select("owner", "depth", F.col("conv_id").alias("told"))
    told = crossing.select("part", "owner", "depth").join(up, ["owner", "depth"])
    told = told.select("part", F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth"), "told")
    own = inside.filter("parent_owner < 0").withColumn("parent_conv_id", F.col("parent"))
    below = inside.filter("parent_owner >= 0").join(told, ["part", "parent_owner", "depth"]).withColumn("parent_conv_id", F.col("told"))
    tops = merged.join(up.select(F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth"), F.col("told").alias("parent_conv_id")),
                       ["parent_owner", "depth"], "left")
    out = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
           (F.col("shared") - (F.col("n_convs") - 1) * F.col("below")).alias("saved_tokens"), "ends_sha256"]
    return own.select(*out).unionByName(below.select(*out)).unionByName(tops.select(*out))
