"""File sources, fingerprints and manifests."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

WHOLE_FILE_BYTES = 1 << 29      # a file that is read as one value, at most
BLOCK_BYTES = 64 << 20          # of a file that one task hashes
PIECE_BYTES = 4 << 20           # held at a time
# microseconds survive the text form
_JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
               "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def trim_strings(df: DataFrame) -> DataFrame:
    """Trim every string column."""
    def quoted(name):
        return F.col("`" + name.replace("`", "``") + "`")

    return df.select(*[F.trim(quoted(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else quoted(f.name)
                       for f in df.schema.fields])


def read_trimmed(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV scan with an explicit schema; blanks around values are trimmed, blanks are NULL."""
    return trim_strings(spark.read.schema(schema).csv(
        path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True))


def write_fragments(df: DataFrame, path: str, partition_by: str | None = None) -> str:
    """Compressed JSON fragments."""
    writer = df.write.mode("errorifexists").options(**_JSON_TIMES)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.json(path, compression="gzip")
    return path


def read_fragments(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).options(**_JSON_TIMES).json(path)


def file_fingerprint(spark: SparkSession, path: str, glob: str = "*", block: int = BLOCK_BYTES, at_once: int = WHOLE_FILE_BYTES) -> DataFrame:
    """Name, size and SHA-256 of every file, and a Merkle root over its blocks; files of any size.

    ``merkle`` is the SHA-256 of the SHA-256s of the file's blocks of ``block`` bytes, one after the other; roots compare
    if they were made with one block size. Files of up to ``at_once`` bytes are read by Spark as one value. Larger ones are
    never loaded: each block is read from its own range by its own task, so many tasks check one file at once, and the
    whole file's SHA-256, which has to see the bytes in order, is a stream through one task. Empty files are not listed.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    count = F.greatest(F.ceil(F.col("length") / block), F.lit(1)).cast("int")
    numbers = F.sequence(F.lit(0), count - 1)
    pieces = F.transform(numbers, lambda n: F.sha2(F.substring("content", n * block + 1, F.lit(block)), 256))
    small = files.filter(F.col("length") <= at_once).select("path", "length", F.sha2("content", 256).alias("sha256"), _root(pieces).alias("merkle"))

    large = files.filter(F.col("length") > at_once).select("path", "length")
    start = F.col("block").cast("long") * block
    parts = large.select("path", F.explode(numbers).alias("block"), "length").select(
        "path", "block", start.alias("start"), F.least(F.lit(block).cast("long"), F.col("length") - start).alias("size"))
    whole = large.select("path", F.lit(-1).alias("block"), F.lit(0).cast("long").alias("start"), F.col("length").alias("size"))

    def digests(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            made = []
            for where, begin, size in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "size"))):
                digest = hashlib.sha256()
                for piece in read_range(where, begin, size):
                    digest.update(piece)
                made.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("block"), pa.array(made, pa.string())], ["path", "block", "digest"])

    hashed = whole.unionByName(parts).repartition("path", "block").mapInArrow(digests, "path string, block int, digest string")
    told = F.transform(F.sort_array(F.collect_list(F.when(F.col("block") >= 0, F.struct("block", "digest")))), lambda b: b["digest"])
    roots = hashed.groupBy("path").agg(F.max(F.when(F.col("block") < 0, F.col("digest"))).alias("sha256"), _root(told).alias("merkle"))
    out = small.unionByName(large.join(roots, "path").select(*small.columns))
    return out.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), "sha256", "merkle")


def _root(digests: Column) -> Column:
    return F.sha2(F.unhex(F.array_join(digests, "")), 256)


def read_range(where: str, start: int, size: int) -> Iterator[bytes]:
    """Bytes of a file from a place on, piece by piece; for tasks, through the file system that the path names."""
    from pyarrow import fs

    if where.startswith("file:") or where.startswith("/"):
        files, name = fs.LocalFileSystem(), "/" + where.removeprefix("file:").lstrip("/")
    else:
        files, name = fs.FileSystem.from_uri(where)
    with files.open_input_file(name) as source:
        source.seek(start)
        while size > 0 and (piece := source.read(min(size, PIECE_BYTES))):
            size -= len(piece)
            yield piece


def table_fingerprint(df: DataFrame, columns: list[str | Column]) -> DataFrame:
    """Order-independent content hash of any size: row count and sum of row hashes."""
    texts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 8), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(digest).alias("fingerprint"))


def table_manifest(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))
