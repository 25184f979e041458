"""Fill-in-the-middle examples: texts cut at two token boundaries, whose places come from a Roaring-style set."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from duelmark.llm.batches import WHITE, prepare, slices, utf8

CHUNK = 1 << 16                 # values of one container
WORD = 512                      # bits of a bitmap that one cumulative count stands for
IS_WHITE = np.isin(np.arange(256), np.frombuffer(WHITE, np.uint8))
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
# what is written before, between and after the parts, and the order of the parts
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}


class ArrayContainer:
    """Few values: each of them, in two bytes."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.values[k])


class BitmapContainer:
    """Many values: a bit for every possible one, with the number of bits set before each word."""

    def __init__(self, values: np.ndarray):
        bits = np.zeros(CHUNK, bool)
        bits[values] = True
        self.bits = np.packbits(bits)
        counts = bits.reshape(-1, WORD).sum(axis=1)
        self.before = np.cumsum(counts) - counts

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        own = np.unpackbits(self.bits[word * WORD // 8:(word + 1) * WORD // 8])
        return word * WORD + int(np.flatnonzero(own)[k - self.before[word]])


class RunContainer:
    """Values in a row: the first of each run and the number of values before it."""

    def __init__(self, starts: np.ndarray, before: np.ndarray):
        self.starts, self.before = starts.astype(np.uint16), before

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def container(values: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest of the three forms for sorted values below ``CHUNK``."""
    first = np.flatnonzero(np.diff(values, prepend=-2) != 1)
    sizes = {"run": 4 * len(first), "array": 2 * len(values), "bitmap": CHUNK // 8}
    best = min(sizes, key=sizes.get)
    if best == "run":
        return RunContainer(values[first], first)
    return ArrayContainer(values) if best == "array" else BitmapContainer(values)


class BoundarySet:
    """Where the tokens of a UTF-8 text end, in containers of 65,536 bytes each with cumulative cardinalities.

    A token is a word with the white space before it, or the white space at the text's end. The text is read
    container by container, so little more than the set itself is held beside it.
    """

    def __init__(self, text: bytes):
        data = np.frombuffer(text, np.uint8)
        self.bases: list[int] = []
        self.containers = []
        sizes = []
        for base in range(0, len(data), CHUNK):
            white = IS_WHITE[data[base:base + CHUNK + 1]]
            # the last byte of a word, or of the text
            last = np.append(~white[:-1] & white[1:], base + CHUNK >= len(data)) if base + CHUNK >= len(data) else ~white[:-1] & white[1:]
            values = np.flatnonzero(last)
            if len(values):
                self.bases.append(base)
                self.containers.append(container(values))
                sizes.append(len(values))
        self.cumulative = np.cumsum(sizes, dtype=np.int64)

    def __len__(self) -> int:
        return int(self.cumulative[-1]) if len(self.cumulative) else 0

    def cut(self, tokens: int) -> int:
        """Bytes in the first ``tokens`` tokens: the container by cumulative cardinality, then a select inside it."""
        if not tokens:
            return 0
        at = int(np.searchsorted(self.cumulative, tokens, "left"))
        before = int(self.cumulative[at - 1]) if at else 0
        return self.bases[at] + self.containers[at].select(tokens - before - 1) + 1


def characters(text: bytes) -> int:
    """Code points: bytes that do not continue one."""
    return int(np.count_nonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80))


def example(text: bytes, draws: tuple[int, int, int, int], middle_share: int, spm_share: int) -> tuple:
    """(tokens, form, prefix characters, middle characters, output) of one text."""
    ends = BoundarySet(text)
    n = len(ends)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= middle_share:
        return n, "plain", None, None, text
    begin, end = (ends.cut(k) for k in sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    form = "spm" if draws[3] % 100 < spm_share else "psm"
    part = {PREFIX: text[:begin], MIDDLE: text[begin:end], SUFFIX: text[end:]}
    return n, form, characters(part[PREFIX]), characters(part[MIDDLE]), b"".join(m + part[m] for m in FORMS[form])


def fill_in_middle(docs: DataFrame, seed: int = 42, middle_share: int = 50, spm_share: int = 80,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rearrange documents so that a model learns to fill in their middle.

    Two cuts between tokens, drawn from SHA-256 of ``seed:id``, part a text into prefix, middle and suffix. Of 100
    documents about ``middle_share`` are rearranged, of these ``spm_share`` of 100 with the suffix first; the others stay
    plain. Texts are read in place and nothing is shuffled; what a task holds is one slice of texts and one text's set.

    One row per input row: the id column, n (tokens), form (plain, psm or spm), prefix_chars and middle_chars (code points;
    null if plain), output (``restore`` gives the text back). A null text is empty; empty texts and texts with one of the markers
    stay plain; a null id draws as the empty string; repeated ids draw alike. An empty table gives no rows. Other
    columns are not read.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    rows = docs.select(F.col(doc_id).alias("doc"), utf8(text).alias("text"), *draws)

    def make(batches):
        for batch in slices(batches, "text"):
            drawn = zip(*(batch.column(f"h{k}").to_pylist() for k in range(4)))
            made = [example(t, h, middle_share, spm_share) for t, h in zip(batch.column("text").to_pylist(), drawn)]
            n, form, before, middle, output = zip(*made) if made else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())],
                ["doc", "n", "form", "prefix_chars", "middle_chars", "output"])

    out = rows.mapInArrow(make, f"doc {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("doc", doc_id)


def restore(output: Column, form: Column) -> Column:
    """The text again, from an output and its form; a marker is never part of a rearranged text."""
    def between(before: bytes, after: bytes | None) -> Column:
        rest = F.substring_index(output, before.decode(), -1)
        return rest if after is None else F.substring_index(rest, after.decode(), 1)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
