"""Packing documents into fixed windows by the sum-of-squares rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from duelmark.llm.batches import prepare, slices, utf8
from duelmark.llm.tokens import WordTokens

PIECES = ("start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


class Levels:
    """Open windows by fill level: ``counts[h]`` windows hold h ids each.

    ``level_for`` returns the level at which an item makes the sum of squared counts smallest
    (level 0 opens a window); ties go to the fullest level.
    """

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        w, counts = self.window, self.counts
        # levels 0 .. w - size; a window that becomes full leaves the array and costs nothing
        after = 2 * counts[size:w + 1] + 1
        after[-1] = 0
        before = 1 - 2 * counts[:w - size + 1]
        before[0] = 0
        change = after + before
        change[1:][counts[1:w - size + 1] == 0] = np.iinfo(np.int64).max
        return int(len(change) - 1 - np.argmin(change[::-1]))

    def place(self, piece: tuple, size: int) -> list | None:
        """Put a piece into a window; the window's pieces if that filled it."""
        at = self.level_for(size)
        pieces = self.open[at].pop() if at else []
        self.counts[at] -= at > 0
        pieces.append(piece)
        if at + size == self.window:
            return pieces
        self.open[at + size].append(pieces)
        self.counts[at + size] += 1
        return None

    def left(self) -> Iterator[tuple]:
        """Pieces of the windows that never filled, fullest window first."""
        for level in range(self.window, 0, -1):
            for pieces in self.open[level]:
                yield from pieces


def _regroup(pieces: Iterator[tuple], window: int) -> Iterator[list]:
    """Join what is left over into full windows by cutting, and the last ids into powers of two."""
    line = list(pieces)
    total = sum(len(ids) for *_, ids in line)
    sizes = [window] * (total // window) + [1 << b for b in range(window.bit_length(), -1, -1) if total % window >> b & 1]
    at = 0
    for size in sizes:
        row = []
        while size:
            doc, start, tokens, ids = line[at]
            row.append((doc, start, tokens, ids[:size]))
            if len(ids) > size:
                line[at] = (doc, start + size, tokens, ids[size:])
            else:
                at += 1
            size -= len(row[-1][3])
        yield row


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack every document's ids, with ``end_id`` after them, into sequences of at most ``window`` ids.

    A document longer than the window gives full windows first; its rest is placed online into the fill
    level that makes the sum of squared level counts smallest. Each task packs what it reads, so nothing is
    shuffled and a level array is all a task holds besides the rests in open windows. At a task's end the
    windows still open are joined by cutting, and its last ids go into sequences whose lengths are powers
    of two, so no sequence needs padding.

    One row per piece: the id column, start (ids of its document before it), length, doc_tokens (with the
    end id), sequence_id, offset (in the sequence, gapless from 0), ids (little-endian unsigned 32 bits).
    A null or empty text is the end id alone; a null id stays null; repeated rows are packed each. An empty
    table gives no rows. Other columns are not read. ``tokenizer`` must be readable at that path, or by name among the
    installed files, on every executor.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).alias("doc"), utf8(text).alias("text"))

    def pack(batches):
        encode = WordTokens.shared(tokenizer)
        levels = Levels(window)
        first = TaskContext.get().partitionId() << 32
        made = 0
        out: list[tuple] = []

        def emit(pieces):
            nonlocal made
            offset = 0
            for doc, start, tokens, ids in pieces:
                out.append((doc, start, len(ids), tokens, first + made, offset, ids.tobytes()))
                offset += len(ids)
            made += 1

        def flushed():
            names = ("doc", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
            kinds = (doc_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            made_rows = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], names)
            out.clear()
            return made_rows

        doc_type = None
        for batch in slices(batches, "text"):
            doc_type = batch.schema.field("doc").type
            flat, ends = encode(batch.column("text").to_pylist(), end_id)
            begin = 0
            for doc, end in zip(batch.column("doc").to_pylist(), ends.tolist()):
                ids, begin = flat[begin:end], end
                n = len(ids)
                whole = n - n % window
                for start in range(0, whole, window):
                    emit([(doc, start, n, ids[start:start + window])])
                if whole < n and (full := levels.place((doc, whole, n, ids[whole:].copy()), n - whole)):
                    emit(full)
            yield flushed()
        if doc_type is not None:
            for row in _regroup(levels.left(), window):
                emit(row)
            yield flushed()

    out = rows.mapInArrow(pack, f"doc {kind.simpleString()}, {PIECES}")
    return out.withColumnRenamed("doc", doc_id)
