"""Benchmark items inside documents, by containment of their word shingles."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from duelmark.llm.batches import gathered, lowered, prepare
from duelmark.llm.words import WordHashes, mixed, sequences, ODD
from duelmark.session import materialize

TABLE_BITS = (20, 26)           # of the two bit tables that most shingles miss: at least, and at most (16 MiB a width)
BITS_PER_VALUE = 256            # of a table for each sketch value, where it may grow
ROWS_BITS = 33                  # of a row's number below the partition


def shingle_set(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)}


def size_class_end(n: int) -> int:
    """Largest size in the class of ``n``: classes end at 8, 16, 32, ..."""
    return max(8, 1 << (n - 1).bit_length())


def sketch_size(n: int, threshold: float) -> int:
    """MinHash values that items of a size class keep.

    A document that holds at least ``threshold`` of an item's ``n`` shingles lacks at most (1 - threshold) n of
    them. One more value than that bound, for the largest item of the class, cannot all be lacking.
    """
    return min(n, int((1 - threshold) * size_class_end(n) + 1e-9) + 1)


def sketches(items: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(item, width, value): every item's MinHash sketch; ``items`` has item (a number) and text (lower-cased bytes)."""
    def read(batches):
        for batch in batches:
            numbers, widths, values = [], [], []
            for number, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = text.split()
                if not words:
                    continue
                width = min(shingle, len(words))
                found = shingle_set(words, width)
                hashes = np.array([[xxhash.xxh3_64_intdigest(w) for w in s.split(b" ")] for s in found], np.uint64)
                least = np.sort(mixed((hashes * ODD[:width]).sum(axis=1, dtype=np.uint64)))[:sketch_size(len(found), threshold)]
                numbers += [number] * len(least)
                widths += [width] * len(least)
                values.append(least.view(np.int64))
            flat = np.concatenate(values) if values else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(widths, pa.int32()), pa.array(flat)], ["item", "width", "value"])

    return items.mapInArrow(read, "item long, width int, value long")


def bit_tables(values: DataFrame) -> tuple[int, dict[int, np.ndarray]]:
    """Bits of the tables, and per width two tables: of the leading and of the last bits of the sketch values.

    Tasks mark their own values and tables are joined by OR, so the driver gets two tables per width, of a bounded size.
    """
    n = values.count()
    least, most = TABLE_BITS
    bits = min(most, max(least, (n * BITS_PER_VALUE).bit_length()))

    def mark(parts):
        tables: dict[int, np.ndarray] = {}
        for part in parts:
            for width, own in part.groupby("width"):
                table = tables.setdefault(int(width), np.zeros((2, 1 << bits), bool))
                for side, at in zip(table, places(own["value"].to_numpy(np.int64).view(np.uint64), bits)):
                    side[at] = True
        for width, table in tables.items():
            yield pd.DataFrame({"width": [width], "marks": [np.packbits(table).tobytes()]})

    def either(part: pd.DataFrame) -> pd.DataFrame:
        marks = np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in part["marks"]])
        return pd.DataFrame({"width": [int(part["width"].iloc[0])], "marks": [marks.tobytes()]})

    few = values.coalesce(max(1, -(-n // 1_000_000)))
    made = few.mapInPandas(mark, "width int, marks binary").groupBy("width").applyInPandas(either, "width int, marks binary")
    return bits, {r.width: np.unpackbits(np.frombuffer(r.marks, np.uint8)).astype(bool).reshape(2, -1) for r in made.collect()}


def places(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where values are marked in the two tables."""
    return values >> np.uint64(64 - bits), values & np.uint64((1 << bits) - 1)


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle: int = 5, doc_id: str = "doc_id",
                    text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (document, item) where the document holds at least ``threshold`` of the item's distinct shingles.

    Items are grouped by size, and each keeps as many of its smallest shingle hashes as its class needs for one of
    them to occur in every document that contains the item (``sketch_size``), so no match is missed. All documents are
    scanned once, at any number of items: their shingles are looked up in a broadcast table of bits of a bounded size,
    and only documents with a hit are written, with their hits. Hits join the sketch values; a shared value makes a
    candidate, whose shingles are compared as words. Items stay tables throughout; the driver holds none.

    Words are separated by ASCII white space, in lower case. An item of fewer than ``shingle`` words is
    one shingle of its own width. Null and empty texts hold and are nothing; an item text that occurs under two ids is
    found under both; repeated documents give a row each. An empty table on either side gives no rows.
    """
    spark = prepare(docs.sparkSession)
    doc_kind, item_kind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    known = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("known_id"), lowered(item_text).alias("text"))
    known = materialize(known, "items")
    values = materialize(sketches(known, shingle, threshold), "sketches")
    sent = spark.sparkContext.broadcast(bit_tables(values))
    rows = docs.select(F.col(doc_id).alias("doc"), lowered(text).alias("text"))

    def probe(batches):
        bits, tables = sent.value
        words_of, number = WordHashes(), TaskContext.get().partitionId() << ROWS_BITS
        for batch in gathered(batches, "text"):
            begins, hashes = words_of([t.split() for t in batch.column("text").to_pylist()])
            owners, found, widths = [], [], []
            for width, table in tables.items():
                h, owner = sequences(hashes, begins, width)
                hit = np.flatnonzero(table[0][h >> np.uint64(64 - bits)])
                hit = hit[table[1][places(h[hit], bits)[1]]]
                owners.append(owner[hit])
                found.append(h[hit])
                widths.append(np.full(len(hit), width, np.int32))
            owner, value, width = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (owners, found, widths))
            order = np.argsort(owner, kind="stable")
            suspects, first = np.unique(owner[order], return_index=True)
            lists = pa.array(np.append(first, len(order)), pa.int32())
            hits = pa.StructArray.from_arrays([pa.array(width[order], pa.int32()), pa.array(value[order].astype(np.uint64).view(np.int64))], ["width", "value"])
            some = pa.array(suspects.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(number + suspects.astype(np.int64)), batch.column("doc").take(some), batch.column("text").take(some),
                                              pa.ListArray.from_arrays(lists, hits)], ["row", "doc", "text", "hits"])
            number += batch.num_rows

    suspects = rows.mapInArrow(probe, f"row long, doc {doc_kind}, text binary, hits array<struct<width: int, value: long>>")
    suspects = materialize(suspects, "suspects")
    hits = suspects.select("row", F.explode(F.array_distinct("hits")).alias("h")).select("row", "h.width", "h.value")
    candidates = hits.join(values, ["width", "value"]).select("row", "item").distinct()
    wanted = candidates.join(known, "item").groupBy("row").agg(F.collect_list(F.struct("known_id", "text")).alias("wanted"))

    def verify(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            at, found = [], []
            for i, (data, candidates) in enumerate(zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist())):
                words, have = data.split(), {}
                for candidate in candidates:
                    own = candidate["text"].split()
                    width = min(shingle, len(own))
                    if width not in have:
                        have[width] = shingle_set(words, width)
                    shingles = shingle_set(own, width)
                    shared = len(shingles & have[width])
                    if shared >= threshold * len(shingles) - 1e-9:
                        at.append(i)
                        found.append((candidate["known_id"], shared / len(shingles), shared, len(shingles)))
            columns = list(zip(*found)) or [[]] * 4
            kinds = (to_arrow_type(item_type), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                             ["doc", "item_id", "containment", "shared", "item_shingles"])

    item_type = items.schema[item_id].dataType
    out = suspects.select("row", "doc", "text").join(wanted, "row").select("doc", "text", "wanted").mapInArrow(
        verify, f"doc {doc_kind}, item_id {item_kind}, containment double, shared long, item_shingles long")
    return out.withColumnRenamed("doc", doc_id)


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents that hold no item, with all their columns.

    Whether a row leaves depends on its text alone, so rows are told by 16 bytes of their texts' SHA-256: rows that share an
    id or have none are decided one by one. ``doc_id`` is not read.
    """
    digest = F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32))
    gone = contained_items(docs.select(digest.alias("digest"), text), items, doc_id="digest", text=text, **how)
    gone = materialize(gone.select(F.col("digest").alias("_gone")).distinct(), "contaminated")
    return docs.join(gone, digest == gone["_gone"], "left_anti")
