"""Exact duplicates by recipes of content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from duelmark.llm.batches import WHITE, prepare, slices, unused, utf8
from duelmark.session import materialize

LEAST, MOST = 256, 16384        # bytes of a chunk
BOUNDARY_BITS = 10              # a boundary every 1024 bytes on average
MIX = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)   # odd multipliers of the window hash


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; they depend on the eight bytes before them, not on the position.

    An inserted passage therefore changes only the chunks it touches.
    """
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = np.frombuffer(data, np.uint8).astype(np.uint32)
    for step, mix in zip((1, 2, 4), MIX):
        h = h[:-step] * np.uint32(mix) + h[step:]
    h *= np.uint32(MIX[0])
    marks = np.flatnonzero(h >> np.uint32(32 - BOUNDARY_BITS) == 0) + 8
    ends, start = [], 0
    for mark in [*marks.tolist(), n]:
        while mark - start > MOST:
            start += MOST
            ends.append(start)
        if mark - start >= LEAST or mark == n and mark > start:
            ends.append(mark)
            start = mark
    return ends


def normalise(text: bytes) -> bytes:
    """The text without the six ASCII white space characters."""
    return text.translate(None, WHITE)


def chunks(text: bytes) -> Iterator[bytes]:
    start = 0
    for end in boundaries(text):
        yield text[start:end]
        start = end


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, code points of the original text, SHA-256 of the normalised text, and its chunks' hashes in order."""
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).alias("doc"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("points"),
                       utf8(text).alias("text"))

    def read(batches):
        for batch in slices(batches, "text"):
            sums, lists = [], []
            for data in map(normalise, batch.column("text").to_pylist()):
                sums.append(hashlib.sha256(data).hexdigest())
                lists.append([xxhash.xxh3_64_intdigest(c) - (1 << 63) for c in chunks(data)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("points"), pa.array(sums, pa.string()), pa.array(lists, pa.list_(pa.int64()))],
                ["doc", "points", "sha256", "recipe"])

    return rows.mapInArrow(read, f"doc {kind.simpleString()}, points long, sha256 string, recipe array<bigint>")


def chunk_contents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Chunks of all rows with their hashes, each once per Arrow batch."""
    def read(batches):
        for batch in slices(batches, "text"):
            found = {c for data in batch.column("text").to_pylist() for c in chunks(normalise(data))}
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_64_intdigest(c) - (1 << 63) for c in found], pa.int64()), pa.array(found, pa.binary())],
                ["hash", "content"])

    return docs.select(utf8(text).alias("text")).mapInArrow(read, "hash long, content binary")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows whose texts are equal without white space, and which of them stays.

    1. Texts are cut into content-defined chunks; a text's recipe is the ordered list of its chunks' hashes.
       Recipes are written once and are all that later steps move.
    2. Only recipes that several rows share can hold copies. The chunks of those rows, and no others, are
       brought together by hash, each content once a task: a hash with one content is a verified identifier.
    3. Rows are equal if their ordered identifiers are. Should a hash ever stand for two contents, rows with
       it are told apart by the SHA-256 of the whole text too.

    Of equal rows the one with the most code points in the original text stays, then the one with the
    smallest id (null ids last). Rows that tie in both, as repeated rows do, carry the same ``keep_id`` and
    are all kept: an id, not a row, stays. Null texts count as empty; empty texts form one group.

    Returns one row per input row: the id, keep_id, group_size, kept, text_sha256, points.
    """
    prepare(docs.sparkSession)
    made = materialize(recipes(docs, doc_id, text), "recipes")
    # written before they are joined back: the joins then have exchanges of their own, whose hot parts Spark can split
    shared = materialize(made.groupBy("recipe").agg(F.count("*").alias("n")).filter("n > 1 AND size(recipe) > 0"), "shared")
    suspects = materialize(made.join(shared, "recipe", "left_semi").select("doc"), "suspects")
    read = docs.join(suspects, docs[doc_id].eqNullSafe(suspects["doc"]), "left_semi").select(text)
    contents = chunk_contents(read, text).distinct()
    clashes = materialize(contents.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "clashes")

    if clashes.isEmpty():
        told = made.withColumn("apart", F.lit(""))
    else:
        # rows are found by the hash; the whole text's digest then tells their contents apart
        marked = (made.select(F.explode(F.array_distinct("recipe")).alias("hash"), "recipe").join(clashes, "hash", "left_semi")
                  .select("recipe").distinct().withColumn("clash", F.lit(True)))
        told = (made.join(marked, "recipe", "left")
                .withColumn("apart", F.when(F.col("clash"), F.col("sha256")).otherwise("")).drop("clash"))

    rank = F.struct((-F.col("points")).alias("points"), F.col("doc").isNull().alias("none"), F.col("doc").alias("doc"))
    groups = (told.groupBy("recipe", "apart").agg(F.min(rank).alias("first"), F.count("*").alias("group_size"))
              .filter("group_size > 1"))
    groups = materialize(groups.select("recipe", "apart", F.col("first.doc").alias("keep"), "group_size", F.lit(True).alias("found")), "groups")
    out = told.join(groups, ["recipe", "apart"], "left")
    keep = F.when(F.col("found"), F.col("keep")).otherwise(F.col("doc"))
    return out.select(
        F.col("doc").alias(doc_id), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc").eqNullSafe(keep).alias("kept"), F.col("sha256").alias("text_sha256"), "points")


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of rows that tie for staying (repeated rows) one stays.

    Rows leave by an anti join with the ids to drop. Only ids that several rows carry are told by their texts.
    """
    groups = materialize(exact_groups(docs, doc_id, text).select(
        F.col(doc_id).alias("doc"), "kept", F.col("text_sha256").alias("sha")), "exact")
    several = materialize(groups.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select("doc"), "several")
    dropped = groups.filter(~F.col("kept")).select("doc")
    if several.isEmpty():
        return docs.join(dropped, docs[doc_id].eqNullSafe(dropped["doc"]), "left_anti")
    gone = dropped.union(several).toDF("_gone")
    plain = docs.join(gone, docs[doc_id].eqNullSafe(gone["_gone"]), "left_anti")
    name = unused(docs, "_sha")
    staying = groups.filter("kept").select("doc", F.col("sha").alias("_stays"))
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]", ""), 256)
    again = docs.join(several, docs[doc_id].eqNullSafe(several["doc"]), "left_semi").withColumn(name, sha)
    again = again.join(staying, again[doc_id].eqNullSafe(staying["doc"]) & (again[name] == staying["_stays"]), "left_semi")
    return plain.unionByName(again.dropDuplicates([doc_id, name]).drop(name))
