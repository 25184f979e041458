"""Near duplicates by SimHash fingerprints, searched over their segment bit counts."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from duelmark.llm.batches import prepare, slices, unused, utf8
from duelmark.llm.components import components
from duelmark.session import materialize

SEED = 42
SEGMENT_BITS = 2                # width of the segments whose set bits make the grid
BLOCK = 4096                    # fingerprints of a cell that meet at once; larger cells meet block by block
BUFFER = 1 << 16                # rows a task compares at once, besides a cell that goes on


def fingerprint(data: bytes, shingle: int = 4) -> int:
    """SimHash of a text: bit b is 1 if it is set in over half of the hashes of its word shingles."""
    words = data.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    n = max(1, len(words) - shingle + 1)
    starts = (ends - sizes + 1)[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], "<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """Id and fingerprint (as a signed long) of every row."""
    kind = docs.schema[doc_id].dataType

    def read(batches):
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(found.view(np.int64))], ["doc", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc"), utf8(text).alias("text"))
    return rows.mapInArrow(read, f"doc {kind.simpleString()}, fp long")


def segment_counts(fps: np.ndarray, width: int = SEGMENT_BITS) -> np.ndarray:
    """One row per fingerprint: the set bits of each segment. Their Manhattan distance never exceeds the Hamming distance."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(len(fps), 8), axis=1, bitorder="little")
    return bits.reshape(len(fps), 64 // width, width).sum(axis=2, dtype=np.uint8)


def grid_cells(fps: np.ndarray, most: int, free: int) -> np.ndarray:
    """Cells of each fingerprint, one column per choice of groups.

    The segments form ``most + free`` groups. Counts at Manhattan distance ``most`` or less differ in at most
    ``most`` groups, so two such rows agree on all counts of at least one choice of ``free`` groups: they
    share that cell.
    """
    counts = segment_counts(fps).astype(np.uint64)
    groups = np.array_split(np.arange(counts.shape[1]), most + free)
    codes = np.stack([(counts[:, g] * (np.uint64(SEGMENT_BITS + 1) ** np.arange(len(g), dtype=np.uint64))).sum(axis=1)
                      for g in groups], axis=1)
    cells = []
    for at, chosen in enumerate(combinations(range(most + free), free)):
        cell = np.full(len(fps), at, np.uint64)
        for g in chosen:
            cell = cell * np.uint64((SEGMENT_BITS + 1) ** len(groups[g])) + codes[:, g]
        cells.append(cell)
    return np.stack(cells, axis=1).view(np.int64) if cells else np.empty((len(fps), 0), np.int64)


def agreeing_groups(rows: int, most: int) -> int:
    """How many groups must agree: finer cells hold fewer rows, but a row then lies in more cells.

    Two random segments of two bits have equal counts with probability 3/8. A row that is moved costs about
    fifty comparisons. The choice changes the work only: any number of groups finds all links. It is never one, so that
    the cells of a row do not become three times as many between a small and a middling input.
    """
    def cost(free: int) -> float:
        segments = 64 // SEGMENT_BITS * free / (most + free)
        return comb(most + free, free) * (50 + rows * 0.375 ** segments)

    return min(range(2, 13), key=cost)


def _roots(cell: np.ndarray, block: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints linked inside the given cells, each with the smallest one that links reach there.

    In a cell, rows are sorted by their number of set bits, and a row meets the following ones while that number
    differs by at most ``most``. A pair then needs segment counts at Manhattan distance ``most`` or less, and only
    then its bits are compared. ``block`` is -1, or the half of a pair of blocks: halves meet each other only.
    """
    counts = segment_counts(fps, 8)
    total = counts.sum(axis=1, dtype=np.int16)
    order = np.lexsort((total, cell))
    cell, block, fps, counts, total = cell[order], block[order], fps[order], counts[order], total[order]
    root = np.arange(len(fps))
    active, step = np.arange(len(fps)), 0
    while len(active):
        step += 1
        active = active[:np.searchsorted(active, len(fps) - step)]
        other = active + step
        live = (cell[active] == cell[other]) & (total[other] - total[active] <= most)
        active, other = active[live], other[live]
        meets = (block[active] < 0) | (block[active] != block[other])
        a, b = active[meets], other[meets]
        manhattan = np.abs(counts[a].astype(np.int8) - counts[b].astype(np.int8)).sum(axis=1, dtype=np.int16)
        a, b = a[manhattan <= most], b[manhattan <= most]
        linked = np.bitwise_count(fps[a] ^ fps[b]) <= most
        p, q = root[a[linked]], root[b[linked]]
        fresh = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1)[p != q], axis=0)
        if len(fresh):
            for p, q in fresh.tolist():
                while root[p] != p:
                    p = root[p]
                while root[q] != q:
                    q = root[q]
                root[max(p, q)] = min(p, q)
            while not np.array_equal(root, up := root[root]):
                root = up
    hangs = np.flatnonzero(root != np.arange(len(fps)))
    return fps[hangs], fps[root[hangs]]


def links(distinct: DataFrame, most: int = 4) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``fp`` whose links connect just what bits at distance ``most`` connect.

    Every pair that near shares a cell of the grid; cells with more than ``BLOCK`` rows are compared block by block, so
    no task holds a whole large cell. A cell gives a star for each of its components instead of all its pairs.
    """
    free = agreeing_groups(distinct.count(), most)

    def read(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            cells = grid_cells(fps, most, free)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.ravel()), pa.array(np.repeat(fps.view(np.int64), cells.shape[1]))], ["cell", "fp"])

    rows = distinct.select("fp").mapInArrow(read, "cell long, fp long")
    large = rows.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    large = materialize(large.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "cells")
    if large.isEmpty():
        dealt = rows.select("cell", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(-1).alias("half"), "fp")
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        rows = rows.join(large, "cell", "left").withColumn("own", own)
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(
            F.least("own", b).alias("i"), F.greatest("own", b).alias("j"),
            F.when(F.col("own") == b, -1).otherwise((F.col("own") > b).cast("int")).alias("half")))
        alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(-1).alias("half")))
        dealt = rows.select("cell", "fp", F.inline(F.when(F.col("blocks").isNull(), alone).otherwise(pairs)))

    def meet(batches):
        def linked(group):
            keys = group.select(["cell", "i", "j"]).to_pandas()
            code = (keys != keys.shift()).any(axis=1).cumsum().to_numpy()
            found = _roots(code, group.column("half").to_numpy(), group.column("fp").to_numpy().view(np.uint64), most)
            return pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)) for f in found], ["a", "b"])

        held: pa.Table | None = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            if held.num_rows < BUFFER:
                continue
            held = held.combine_chunks()
            keys = np.stack([held.column(c).to_numpy() for c in ("cell", "i", "j")], axis=1)
            changes = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
            if len(changes):      # the last cell may go on in the next batch
                cut = int(changes[-1]) + 1
                yield linked(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield linked(held)

    return (dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
            .mapInArrow(meet, "a long, b long").distinct())


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """Fingerprint and component of every row.

    Fingerprints are written once. Rows with equal ones form a class, so copies of a text meet nowhere; only distinct
    fingerprints are compared. Two of them are linked at Hamming distance ``most`` or less, and a component is what links
    connect. Null and empty texts have fingerprint zero, which is linked like any other; a text of fewer than ``shingle``
    words is one shingle. ``component_id`` is the smallest id in the component, null if it has none.

    Returns one row per input row: the id, fingerprint (16 hexadecimal digits), component_id.
    """
    prepare(docs.sparkSession)
    marked = materialize(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc").alias("least")), "distinct")
    labels = components(materialize(links(distinct, most), "links"))
    classes = distinct.join(labels.toDF("fp", "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = materialize(classes, "classes")
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(smallest, "root").select("fp", "component_id")
    out = marked.join(classes, "fp")
    return out.select(F.col("doc").alias(doc_id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, **how) -> DataFrame:
    """The row with the smallest id of every component, with all its columns. Rows without an id stay if no row of
    their component has one. Rows are decided one by one, also those that share an id or have none."""
    kept = F.col(doc_id).eqNullSafe(F.col("component_id"))
    groups = near_groups(docs, doc_id, text, shingle=shingle, **how).select(F.col(doc_id).alias("doc"), "fingerprint", kept.alias("kept"))
    groups = materialize(groups, "near")
    ids = groups.groupBy("doc").agg(F.min("kept").alias("all"), F.max("kept").alias("any"))
    mixed = materialize(ids.filter("any AND NOT all").select("doc"), "mixed")
    gone = groups.filter("NOT kept").select(F.col("doc").alias("_gone"))
    if mixed.isEmpty():
        return docs.join(gone, docs[doc_id].eqNullSafe(gone["_gone"]), "left_anti")
    # of an id's rows some leave: a fingerprint lies in one component, so it tells which
    gone = gone.union(mixed)
    plain = docs.join(gone, docs[doc_id].eqNullSafe(gone["_gone"]), "left_anti")

    @F.pandas_udf("string")
    def mark(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: format(fingerprint(t, shingle), "016x"))

    staying = groups.filter("kept").join(mixed, groups["doc"].eqNullSafe(mixed["doc"]), "left_semi")
    staying = staying.select("doc", F.col("fingerprint").alias("_stays")).distinct()
    name = unused(docs, "_fp")
    again = docs.join(mixed, docs[doc_id].eqNullSafe(mixed["doc"]), "left_semi").withColumn(name, mark(utf8(text)))
    again = again.join(staying, again[doc_id].eqNullSafe(staying["doc"]) & (again[name] == staying["_stays"]), "left_semi")
    return plain.unionByName(again.drop(name))
