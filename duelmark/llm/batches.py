"""Arrow batches of texts, cut so that a task holds few texts at a time."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WHITE = b" \t\n\x0b\x0c\r"
ROWS_PER_BATCH = 1000
BYTES_PER_SLICE = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches: texts are long, and a Python worker holds one batch at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str) -> Column:
    """The text's UTF-8 bytes, empty for null; Python then gets bytes and decodes nothing it does not need."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def lowered(text: str) -> Column:
    """UTF-8 bytes of the text in lower case, empty for null."""
    return F.lower(F.coalesce(F.col(text), F.lit(""))).cast("binary")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = BYTES_PER_SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut at about ``most`` bytes of ``column``, at least one row each."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < len(sizes):
            yield batch.slice(start)


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int = BYTES_PER_SLICE) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` bytes of ``column``: small ones are put together, large ones cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, column, most):
        own = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and size + own > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def cut(texts: list[bytes], most: int = BYTES_PER_SLICE) -> Iterator[list[bytes]]:
    """The texts in runs of about ``most`` bytes, at least one text each."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield texts[start:i]
            start, held = i, 0
        held += len(t)
    if texts:
        yield texts[start:]


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column has it."""
    while name in df.columns:
        name = "_" + name
    return name


def crc(value: str) -> int:
    return zlib.crc32(value.encode())
