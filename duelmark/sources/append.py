"""Append-only tables, schema migration and gated replacement."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from duelmark.operators.keys import keep_first, unseen
from duelmark.operators.quality import assert_clean


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.option("mergeSchema", "true")
    return (reader.schema(schema) if schema else reader).parquet(path)


def new_rows(rows: DataFrame, target: DataFrame | None, key: list[str], order: list[str]) -> DataFrame:
    """Rows to append: unseen keys only, one row per key inside the batch."""
    first = keep_first(rows, key, order)
    return first if target is None else unseen(first, target, key)


def append_dedup(rows: DataFrame, path: str, key: list[str], order: list[str],
                 partition_by: list[str] = ()) -> None:
    """Append only unseen keys; repeating a batch appends nothing."""
    spark = rows.sparkSession
    target = read_table(spark, path).select(*key) if table_exists(spark, path) else None
    writer = new_rows(rows, target, key, order).write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def append_evolving(rows: DataFrame, path: str) -> None:
    """Append rows with more or fewer columns; readers merge the schemas, gaps are NULL."""
    rows.write.mode("append").parquet(path)


def conform(df: DataFrame, schema) -> DataFrame:
    """Select ``schema``'s columns in order; missing ones are NULL, extra ones dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema.fields])


ROWS_PER_FILE = 2_000_000       # of a month's log, at most


def write_by_month(df: DataFrame, path: str, time: str, mode: str = "append", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Month-partitioned log: a filter on ``month`` prunes folders, and one on ``time`` row groups, which are sorted by it.

    Rows are dealt by (month, time) ranges whose number follows the rows, so a month gets as many tasks and files as its size
    asks for and a small one shares a task; a file holds ``rows_per_file`` rows at most.
    """
    rows = df.withColumn("month", F.date_format(time, "yyyy-MM"))
    files = max(1, -(-df.count() // rows_per_file))
    (rows.repartitionByRange(files, "month", time, F.xxhash64(*df.columns)).sortWithinPartitions("month", time)
     .write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("month").parquet(path))


# --- versioned replacement -----------------------------------------------------------
# A table is a folder of versions, each complete and never changed, and of small numbered pointer files, each with the name of
# a version. Creating a file that must not exist is atomic, on file systems and on object stores with conditional writes, so readers
# see the old version or the new one and never half of a swap, and two writers cannot both get one number.

_POINTER = "_current-"


class ConcurrentReplace(RuntimeError):
    """Another writer replaced the table in between."""


def _fs(spark: SparkSession, table: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(table).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _pointers(spark: SparkSession, table: str) -> list[tuple[int, str | None]]:
    """(number, version), newest last; the version of a pointer that a writer left unfinished is None."""
    fs, path = _fs(spark, table)
    if not fs.exists(path(table)):
        return []
    found = []
    for file in fs.listStatus(path(table)):
        name = file.getPath().getName()
        if name.startswith(_POINTER):
            source = fs.open(file.getPath())
            found.append((int(name.removeprefix(_POINTER)), source.readLine()))
            source.close()
    return sorted(found, key=lambda p: p[0])


def current_version(spark: SparkSession, table: str) -> str | None:
    """Folder of the version that readers see; None before the first one."""
    done = [version for _, version in _pointers(spark, table) if version]
    return f"{table.rstrip('/')}/version={done[-1]}" if done else None


def read_current(spark: SparkSession, table: str, schema=None) -> DataFrame:
    """The current version, as it was when the frame was made: later replacements do not change it."""
    folder = current_version(spark, table)
    if folder is None:
        raise FileNotFoundError(f"{table} has no version yet")
    return (spark.read.schema(schema) if schema else spark.read).parquet(folder)


def staged_replace(new: DataFrame, target: str, audits, keep: int = 2) -> None:
    """Write a new version, run the gates on what was written, then point to it.

    ``audits`` maps the staged version to (check, n) tables. Readers see the old version until the pointer is there; a
    failure before that leaves an unseen folder, or an unfinished pointer that everyone passes over. Raises
    ``ConcurrentReplace`` if another writer took the next number. The ``keep`` newest versions stay for readers that still
    hold them; older ones are deleted.
    """
    spark, target = new.sparkSession, target.rstrip("/")
    fs, path = _fs(spark, target)
    before = _pointers(spark, target)
    version = uuid.uuid4().hex
    folder = f"{target}/version={version}"
    new.write.mode("errorifexists").parquet(folder)
    staged = spark.read.schema(new.schema).parquet(folder)
    try:
        assert_clean(*audits(staged), message="refresh rejected")
    except ValueError:
        fs.delete(path(folder), True)
        raise
    _publish(fs, path(f"{target}/{_POINTER}{before[-1][0] + 1 if before else 1:08d}"), version, path(folder))
    for number, old in before[:max(0, len(before) + 1 - keep)]:
        fs.delete(path(f"{target}/{_POINTER}{number:08d}"), False)
        if old:
            fs.delete(path(f"{target}/version={old}"), True)


def _publish(fs, pointer, version: str, folder) -> None:
    from py4j.protocol import Py4JJavaError

    try:
        out = fs.create(pointer, False)
    except Py4JJavaError as exc:
        fs.delete(folder, True)
        raise ConcurrentReplace(f"another writer made {pointer.toString()}") from exc
    out.write(bytearray(version.encode()))
    out.close()
