"""Web archives: WARC records, a two-level capture index over them, and range reads through it."""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from duelmark.llm.batches import prepare, slices, utf8
from duelmark.session import materialize, scratch_path

BLOCK_LINES = 256               # captures in a compressed block of the index
LEVEL = 4                       # of compression
DATE = "2000-01-01T00:00:00Z"   # pages carry no capture time
MOST_SHARDS = 1 << 16           # index files, whose first keys are broadcast
CAPTURES = "key string, page {kind}, file string, offset long, length long"

_CONTROL = re.compile(r"[\x00-\x20\x7f]")


class Archive(NamedTuple):
    """Where the archives are: captures as written, index files, and the first key of each."""

    folder: str
    captures: DataFrame
    shards: DataFrame


def url_key(url: str) -> Column:
    """Sort key of a URL: host labels from last to first, then what follows the host, without the fragment.

    ``http://www.a.example/b?c#d`` becomes ``example,a,www)/b?c``. Control characters and spaces become ``_``. A null URL has
    the empty key; text without a scheme is its own key after ``)``.
    """
    value = F.coalesce(F.col(url), F.lit(""))
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?)?([^#]*)"
    labels = F.reverse(F.split(F.lower(F.regexp_extract(value, parts, 1)), r"\."))
    key = F.concat(F.concat_ws(",", labels), F.lit(")"), F.regexp_extract(value, parts, 2))
    return F.when(value == "", F.lit("")).otherwise(F.regexp_replace(key, r"[\x00-\x20\x7F]", "_"))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _escape(value: str) -> str:
    return _CONTROL.sub(lambda m: f"%{ord(m.group()):02X}", value)


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record as a gzip member of its own."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, wbits=31)
    return packer.compress(raw) + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one member."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record length differs from its header")
    return headers, rest[:size]


def capture_records(page, url: str | None, payload: bytes, target=None, target_url: str | None = None, target_key: str | None = None) -> bytes:
    """The response record of a page, or its revisit record if ``target`` names another page of equal payload."""
    headers = [("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", DATE), ("X-Page-Id", "" if page is None else str(page))]
    if url is not None:
        headers.append(("WARC-Target-URI", _escape(url)))
    headers.append(("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"))
    if target is None or page == target:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        return record("response", [*headers, ("Content-Type", "application/http;msgtype=response")], block)
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                ("WARC-Refers-To", f"<urn:page:{target}>"), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Key", target_key or "")]
    if target_url is not None:
        headers.append(("WARC-Refers-To-Target-URI", _escape(target_url)))
    return record("revisit", [*headers, ("Content-Type", "application/http;msgtype=response")], b"HTTP/1.1 200 OK\r\n\r\n")


def _create(folder: str, name: str) -> tuple[str, pa.NativeFile]:
    """A new file that all executors can read. The attempt is part of its name, so a task that runs again harms nothing."""
    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(root, recursive=True)
    task = TaskContext.get()
    name = f"{name}-{task.partitionId():06d}-{task.taskAttemptId()}"
    return f"{folder}/{name}", where.open_output_stream(f"{root}/{name}")


class Ranges:
    """Range reads of files, one open at a time."""

    def __init__(self):
        self.path, self.file = None, None

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            self.close()
            where, name = fs.FileSystem.from_uri(path)
            self.path, self.file = path, where.open_input_file(name)
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def write_archives(pages: DataFrame, folder: str, least: int = 0, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Write a record per row, one archive file a task, and return where each capture lies.

    Of rows whose payloads are equal and have at least ``least`` bytes, those with the largest id are responses, the others
    revisit it; shorter payloads are all responses. Only digests that several ids share are joined back: a table of
    one row per such digest, written first, so that Spark sees its size. A null id is below all others. Equal ids with equal
    payloads (repeated rows) are alike: all of them responses, or none.
    """
    kind = pages.schema[page_id].dataType.simpleString()
    size = F.octet_length(F.coalesce(F.col(page), F.lit("")))
    rows = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"), url_key(url).alias("key"), utf8(page).alias("payload"),
                        F.when(size >= least, F.sha1(utf8(page))).alias("digest"))
    seen = rows.select("page", "url", "digest").filter("digest IS NOT NULL").groupBy("digest")
    copies = seen.agg(F.max("page").alias("target"), F.min("page").alias("first"), F.count("*").alias("n"), F.count("page").alias("named"))
    copies = copies.filter("n > 1 AND target IS NOT NULL AND (first < target OR named < n)").select("digest", "target")
    copies = materialize(copies, "digests")
    named = rows.select("digest", F.col("page").alias("target"), F.struct("key", "url").alias("at"))
    copies = named.join(copies, ["digest", "target"]).groupBy("digest", "target").agg(F.min("at").alias("at"))
    copies = materialize(copies.select("digest", "target", F.col("at.url").alias("target_url"), F.col("at.key").alias("target_key")), "copies")

    def write(batches):
        path = out = None
        found: list[tuple] = []
        at = 0
        for batch in slices(batches, "payload"):
            if out is None:
                path, out = _create(folder, "pages")
                at += out.write(record("warcinfo", [("WARC-Record-ID", f"<urn:file:{path.rpartition('/')[2]}>"), ("WARC-Date", DATE)],
                                       b"format: WARC File Format 1.1\r\n"))
            columns = [batch.column(c).to_pylist() for c in ("key", "page", "url", "payload", "target", "target_url", "target_key")]
            for key, page, *rest in zip(*columns):
                member = capture_records(page, *rest)
                out.write(member)
                found.append((key, page, path, at, len(member)))
                at += len(member)
        if out is not None:
            out.close()         # captures are told only once their file is whole
            kinds = (pa.string(), batch.schema.field("page").type, pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["key", "page", "file", "offset", "length"])

    return rows.join(copies, "digest", "left").select("key", "page", "url", "payload", "target", "target_url", "target_key").mapInArrow(
        write, CAPTURES.format(kind=kind))


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the captures in key order as compressed blocks and, after each file's blocks, the sparse directory of their first keys.

    A hot key is spread over files, since the page and the place of a capture sort after it. Returns a row per file:
    first_key, file, directory_offset, directory_length.
    """
    def write(batches):
        path = out = None
        directory: list[bytes] = []
        lines: list[bytes] = []
        at, first = 0, None

        def flush():
            nonlocal at
            block = zlib.compress(b"\n".join(lines), LEVEL)
            out.write(block)
            directory.append(b"\t".join((lines[0].partition(b"\t")[0], b"%d" % at, b"%d" % len(block))))
            at += len(block)
            lines.clear()

        for batch in batches:
            if out is None and batch.num_rows:
                path, out = _create(folder, "index")
                first = batch.column("key")[0].as_py()
            for key, file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length"))):
                lines.append(b"\t".join((key.encode(), file.rpartition("/")[2].encode(), b"%d" % offset, b"%d" % length)))
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            table = zlib.compress(b"\n".join(directory), LEVEL)
            out.write(table)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([path]), pa.array([at]), pa.array([len(table)])],
                                             ["first_key", "file", "directory_offset", "directory_length"])

    ordered = captures.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return ordered.select("key", "file", "offset", "length").mapInArrow(
        write, "first_key string, file string, directory_offset long, directory_length long")


def write_archive(pages: DataFrame, least: int = 0, **columns) -> Archive:
    """Archives of all rows with their index, in a new folder of the shared one (or any that Arrow's file systems reach)."""
    spark = prepare(pages.sparkSession)
    folder = scratch_path(spark, "warc")
    captures = materialize(write_archives(pages, folder, least, **columns), "captures")
    return Archive(folder, captures, materialize(write_index(captures, folder), "shards"))


def look_up(archive: Archive, keys: DataFrame) -> DataFrame:
    """(key, file, offset, length) of all captures of the distinct ``key`` values.

    The first keys of the index files, at most ``MOST_SHARDS``, are broadcast; a key goes to the files that may hold it. A
    task then reads a file's directory, finds the key's blocks by binary search, reads and unpacks these ranges, and finds
    the key's lines in a block by binary search.
    """
    spark = archive.shards.sparkSession
    shards = sorted((r.first_key.encode(), r.file, r.directory_offset, r.directory_length) for r in archive.shards.limit(MOST_SHARDS + 1).collect())
    if len(shards) > MOST_SHARDS:
        raise ValueError("write the index with fewer shuffle partitions")
    sent = spark.sparkContext.broadcast(shards)

    def deal(batches):
        firsts = [s[0] for s in sent.value]
        for batch in batches:
            keys, numbers = [], []
            for key in batch.column("key").to_pylist():
                own = key.encode()
                for n in range(max(0, bisect.bisect_left(firsts, own) - 1), bisect.bisect_right(firsts, own)):
                    keys.append(key)
                    numbers.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(numbers, pa.int32())], ["key", "shard"])

    def search(batches):
        ranges, shard, block_at = Ranges(), None, None
        for batch in batches:
            found: list[tuple] = []
            for key, number in zip(batch.column("key").to_pylist(), batch.column("shard").to_pylist()):
                own = key.encode()
                if number != shard:
                    _, path, offset, length = sent.value[number]
                    rows = [line.split(b"\t") for line in zlib.decompress(ranges.read(path, offset, length)).split(b"\n")]
                    firsts, places = [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]
                    shard, block_at = number, None
                for n in range(max(0, bisect.bisect_left(firsts, own) - 1), bisect.bisect_right(firsts, own)):
                    if n != block_at:
                        lines = zlib.decompress(ranges.read(path, *places[n])).split(b"\n")
                        block_at = n
                    at = bisect.bisect_left(lines, own + b"\t")
                    while at < len(lines) and lines[at].startswith(own + b"\t"):
                        _, file, offset, length = lines[at].split(b"\t")
                        found.append((key, file.decode(), int(offset), int(length)))
                        at += 1
            columns = list(zip(*found)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()),
                                              pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], ["key", "file", "offset", "length"])
        ranges.close()

    dealt = keys.select("key").distinct().mapInArrow(deal, "key string, shard int")
    return dealt.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(search, "key string, file string, offset long, length long")


def read_records(archive: Archive, places: DataFrame, page_type: str, payload: bool) -> DataFrame:
    """Range-read the records at ``places``, each file's in order, and check them against their headers."""
    folder = archive.folder

    def read(batches):
        ranges = Ranges()
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                headers, block = parse_record(ranges.read(f"{folder}/{file}", offset, length))
                body = block.partition(b"\r\n\r\n")[2]
                revisit = headers["warc-type"] == "revisit"
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                if not revisit and base32_sha1(body) != digest:
                    raise ValueError(f"{file} at {offset}: the payload does not have its digest")
                refers = headers.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">") or None
                rows.append((headers["x-page-id"] or None, headers.get("warc-target-uri"), headers["warc-type"], refers,
                             headers.get("x-refers-to-key"), digest, None if revisit else len(body), body if payload and not revisit else None))
            columns = list(zip(*rows)) or [[]] * 8
            kinds = (pa.string(),) * 6 + (pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             ["page", "url", "record_type", "refers_to", "refers_key", "payload_digest", "payload_bytes", "payload"])
        ranges.close()

    # a place is a few bytes and its record many, so the number of tasks is stated rather than left to the places' size
    tasks = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = places.repartition(tasks, "file", F.floor(F.col("offset") / (64 << 20))).sortWithinPartitions("file", "offset")
    found = ordered.select("file", "offset", "length").mapInArrow(
        read, "page string, url string, record_type string, refers_to string, refers_key string, payload_digest string, payload_bytes long, payload binary")
    return found.withColumn("page", F.col("page").cast(page_type)).withColumn("refers_to", F.col("refers_to").cast(page_type))


def read_captures(archive: Archive, keys: DataFrame, payload: bool = True) -> DataFrame:
    """All captures of the given keys, read back from the archives through the index.

    A revisit's payload is that of the response it refers to, which is looked up by the key its record names. In URLs
    control characters and spaces come back percent-encoded, as headers hold them.

    Returns page_id, url, record_type, refers_to, payload_digest (base32 SHA-1), payload_bytes, payload (null if not asked for).
    """
    page_type = archive.captures.schema["page"].dataType.simpleString()
    found = materialize(read_records(archive, look_up(archive, keys), page_type, payload), "records")
    own = found.filter("record_type <> 'revisit'")
    columns = (F.col("page").alias("page_id"), "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")
    revisits = found.filter("record_type = 'revisit'")
    if revisits.isEmpty():
        return own.select(*columns)
    targets = read_records(archive, look_up(archive, revisits.select(F.col("refers_key").alias("key"))), page_type, payload)
    targets = materialize(targets.filter("record_type <> 'revisit'").select(
        F.col("page").alias("refers_to"), "payload_digest", "payload_bytes", "payload"), "targets")
    targets = targets.dropDuplicates(["refers_to", "payload_digest"])
    full = revisits.drop("payload_bytes", "payload").join(targets, ["refers_to", "payload_digest"], "left")
    return own.select(*columns).unionByName(full.select(*columns))
