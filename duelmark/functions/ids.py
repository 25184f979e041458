"""Deterministic ids, seeds and hash-picked indices."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from duelmark.functions._col import col


def hash_id(*parts, length: int = 20) -> Column:
    """First ``length`` hex digits of SHA-256 over ``|``-joined parts; NULL counts as empty.

    Parts are used as text: format numbers before passing them.
    """
    texts = [F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *texts), 256), 1, length)


def event_seed(value, namespace: str = "production") -> Column:
    """32-bit seed from a date (or text): first four SHA-256 bytes, big-endian."""
    text = F.concat_ws("|", F.lit(namespace), col(value).cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def event_seed_of_set(values, namespace: str = "production") -> Column:
    """Seed of an array value: independent of the order of its elements."""
    return event_seed(F.array_join(F.sort_array(col(values)), "|"), namespace)


def uniform_index(n, *parts) -> Column:
    """Reproducible index in [0, n): hash of the parts, never ``rand()``."""
    digest = F.md5(F.concat_ws("|", *[col(p).cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % col(n)
