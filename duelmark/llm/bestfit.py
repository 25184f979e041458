"""Best-fit packing in bulk-synchronous supersteps over range-sorted documents and gaps."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from duelmark.llm.batches import prepare, slices, utf8
from duelmark.llm.tokens import WordTokens
from duelmark.session import materialize

GAPS, DOCUMENTS, MATCH = 0, 1, 2
RANGES = 8                      # ranges of values in the first superstep; each superstep has half as many
ROWS_BITS = 33                  # of monotonically_increasing_id below the partition
# a run of equal documents or gaps; a match says where a run of documents goes
RUN = "kind int, value long, first long, n long, bin long, per_bin long, offset long"


def sweep(runs: Iterable[tuple[int, int, int, int]], window: int) -> Iterator[tuple]:
    """One range of values: documents from the longest on, each run with its successor, the smallest gap that holds one.

    A gap takes as many documents of a run as fit, and its new size is at once a candidate for shorter ones. Where a
    run of documents wants more gaps than there are, those of lower rank come first. Gives matches, and the runs of
    documents and gaps that are left over.
    """
    runs = list(runs)
    gaps = sorted((value, first, n) for kind, value, first, n in runs if kind == GAPS)
    for _, size, rank, left in sorted((r for r in runs if r[0] == DOCUMENTS), key=lambda r: r[2]):
        while left and (at := bisect_left(gaps, (size,))) < len(gaps):
            gap, first, n = gaps.pop(at)
            fit = gap // size
            bins = min(n, left // fit)
            if not bins:
                # the run's last documents share one gap
                bins, fit = 1, left
            yield MATCH, size, rank, bins * fit, first, fit, window - gap
            rank, left = rank + bins * fit, left - bins * fit
            if gap > fit * size:
                insort(gaps, (gap - fit * size, first, bins))
            if n > bins:
                insort(gaps, (gap, first + bins, n - bins))
        if left:
            yield DOCUMENTS, size, rank, left, None, None, None
    for gap, first, n in gaps:
        yield GAPS, gap, first, n, None, None, None


def place(documents: DataFrame, window: int, ranges: int = RANGES) -> DataFrame:
    """Matches for runs of equal documents (kind, value: their length, first: their rank, n).

    A superstep deals the runs of documents and gaps to ranges of values, sweeps every range by itself, and hands on
    what did not find a partner there, with the gaps at their new sizes. The next superstep has half as many ranges, so
    that documents meet gaps of the ranges above. In the last, one range is left and every document that fits has its
    gap; for the others sequences are opened, as many as their ids fill at least, and the supersteps go on.

    Runs are few at any number of documents: a length has one run at first, and a superstep cuts a run once for every
    length, so all are bounded by the window and the supersteps.
    """
    spark = documents.sparkSession

    def swept(batches):
        parts = list(batches)
        if parts and len(table := pd.concat(parts)):
            found = sweep(table[["kind", "value", "first", "n"]].itertuples(index=False, name=None), window)
            yield pd.DataFrame(list(found), columns=["kind", "value", "first", "n", "bin", "per_bin", "offset"]).astype("Int64")

    matches, opened, left = [], 0, documents
    while True:
        waiting = left.filter(F.col("kind") == DOCUMENTS)
        tokens, halves = waiting.agg(F.sum(F.col("value") * F.col("n")), F.sum(F.when(F.col("value") > window // 2, F.col("n")))).first()
        if not tokens:
            break
        if not matches or ranges == 1:
            new = max(-(-tokens // window), halves or 0)
            left = left.unionByName(spark.createDataFrame([(GAPS, window, opened, new)], "kind int, value long, first long, n long"))
            opened += new
        dealt = left.coalesce(1) if ranges == 1 else left.repartitionByRange(ranges, F.desc("value"))
        step = materialize(dealt.mapInPandas(swept, RUN), "superstep")
        matches.append(step.filter(F.col("kind") == MATCH))
        left = step.filter(F.col("kind") != MATCH).select("kind", "value", "first", "n")
        ranges = max(1, ranges // 2)
    found = spark.createDataFrame([], RUN)
    for step in matches:
        found = found.unionByName(step)
    return found


def cut_pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, doc_id: str, text: str, ids: bool) -> DataFrame:
    """(doc, piece, start, length, ids_crc32, key[, ids]): the documents' ids, longer documents cut at the window."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc"), utf8(text).alias("text"))

    def cut(batches):
        encode = WordTokens.shared(tokenizer)
        key = TaskContext.get().partitionId() << ROWS_BITS
        for batch in slices(batches, "text"):
            flat, ends = encode(batch.column("text").to_pylist(), end_id)
            sizes = np.diff(ends, prepend=0)
            pieces = -(-sizes // window)
            row = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * window
            length = np.minimum(window, sizes[row] - start)
            begin = (ends - sizes)[row] + start
            made = [flat[b:b + n].astype("<u4", copy=False).tobytes() for b, n in zip(begin.tolist(), length.tolist())]
            columns = [batch.column("doc").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                       pa.array([zlib.crc32(m) for m in made], pa.int64()), pa.array(np.arange(key, key + len(row)))]
            key += len(row)
            yield pa.RecordBatch.from_arrays(columns + [pa.array(made, pa.binary())] * ids,
                                             ["doc", "piece", "start", "length", "ids_crc32", "key"] + ["ids"] * ids)

    return rows.mapInArrow(cut, f"doc {kind}, piece int, start long, length long, ids_crc32 long, key long" + ", ids binary" * ids)


def pack_best_fit(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 0, ids: bool = False,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack every document's ids, with ``end_id`` after them, into few sequences of at most ``window`` ids.

    Only documents longer than the window are cut. Pieces are range-sorted by length, ties by a key of their own, so that
    a third of all pieces may have one length; a piece's rank is its place in that order. Pieces of one length differ in
    nothing else, so the supersteps (``place``) move runs of them instead of rows, and the result is that of best fit by
    decreasing length but for what the ranges of the first supersteps settle on their own. A piece then finds its
    match by rank. Pieces are shuffled once, without their ids. Broadcast are one number per partition and the matches,
    both bounded by the window and the partitions and not by the documents.

    One row per piece: the id column, piece (from 0), start (ids of its document before it), length, ids_crc32 (of its
    little-endian unsigned 32-bit ids), sequence_id, offset (in the sequence, gapless from 0), and with ``ids`` these ids
    as bytes, stored with the pieces and joined to their places. A null or empty text is the end id alone; a null id
    stays null; repeated rows are packed each. An empty table gives no rows. Other columns are not read. ``tokenizer``
    must be readable at that path, or by name among the installed files, on every executor.
    """
    spark = prepare(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    pieces = materialize(cut_pieces(docs, tokenizer, window, end_id, doc_id, text, ids), "pieces")
    ordered = pieces.drop("ids").repartitionByRange(F.desc("length"), "key").sortWithinPartitions(F.desc("length"), "key")
    ordered = materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")

    part = F.shiftright("at", ROWS_BITS)
    sizes = np.array(ordered.groupBy(part.alias("part")).count().orderBy("part").collect(), np.int64).reshape(-1, 2)
    # at of a partition's first row, and the rows of the partitions before it
    begins, before = sizes[:, 0] << ROWS_BITS, np.cumsum(sizes[:, 1]) - sizes[:, 1]
    lengths = ordered.groupBy("length").agg(F.count("*").alias("n"))
    runs = sorted(lengths.collect(), reverse=True)          # as many as the window has lengths, at most
    first = np.cumsum([0] + [n for _, n in runs]).tolist()
    documents = [(DOCUMENTS, length, rank, n) for (length, n), rank in zip(runs, first)]
    documents = spark.createDataFrame(documents, "kind int, value long, first long, n long")
    found = place(documents, window).select("first", "value", "bin", "per_bin", "offset").orderBy("first").toPandas()
    shared = spark.sparkContext.broadcast((begins, before, *(found[c].to_numpy(np.int64) for c in found.columns)))

    def put(batches):
        begins, before, first, value, bins, per_bin, offset = shared.value
        for batch in batches:
            at = batch.column("at").to_numpy()
            own = np.searchsorted(begins, at, "right") - 1
            rank = at - begins[own] + before[own]
            match = np.searchsorted(first, rank, "right") - 1
            sequence, place_in = np.divmod(rank - first[match], per_bin[match])
            columns = [batch.column(c) for c in ("doc", "piece", "start", "length", "ids_crc32", "key")]
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(bins[match] + sequence), pa.array(offset[match] + place_in * value[match])],
                ["doc", "piece", "start", "length", "ids_crc32", "key", "sequence_id", "offset"])

    out = ordered.mapInArrow(put, f"doc {kind}, piece int, start long, length long, ids_crc32 long, key long, sequence_id long, offset long")
    if ids:
        out = out.join(pieces.select("key", "ids"), "key")
    return out.drop("key").withColumnRenamed("doc", doc_id)
