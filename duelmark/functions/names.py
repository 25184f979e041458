"""Names, aliases and identity keys."""

import sys
from functools import cache
from itertools import chain

from pyspark.sql import Column, functions as F

from duelmark.functions._col import col
from duelmark.settings import NAME_ALIASES, PROFILE_ID_PATTERN

_NON_ASCII = r"[^\x00-\x7F]"


@cache
def _combining_marks() -> dict[int, None]:
    """Every combining mark mapped to nothing, built once per worker."""
    import unicodedata

    return {c: None for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))}


def _fold_udf():
    """Arrow UDF for values with non-ASCII characters (there is no NFKD built-in)."""
    import pandas as pd

    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        import unicodedata

        marks = _combining_marks()

        def one(text):
            folded = unicodedata.normalize("NFKD", text).translate(marks)
            return " ".join(folded.lower().replace(".", "").replace("-", " ").split())

        known = {v: one(v) for v in values.dropna().unique()}
        return pd.Series([known.get(v) for v in values], dtype=object)

    return fold


def squeeze_ascii(c) -> Column:
    """Lower, drop dots, dashes to blanks, squeeze blanks: the ASCII case, JVM-side."""
    text = F.translate(F.lower(col(c)), "-.", " ")
    return F.trim(F.regexp_replace(text, r"[\s\x1c-\x1f]+", " "))


def norm_name(c, unicode: bool = True) -> Column:
    """Normalised name: no accents, lower case, no dots, dashes as blanks, single blanks.

    ASCII values never leave the JVM; the UDF receives NULL for them, so only values
    that really need Unicode decomposition are sent through Arrow.
    """
    value = col(c).cast("string")
    if not unicode:
        return squeeze_ascii(value)
    hard = value.rlike(_NON_ASCII)
    folded = _fold_udf()(F.when(hard, value))
    return F.when(hard, folded).otherwise(squeeze_ascii(value))


def alias_of(key, aliases: dict[str, str] = NAME_ALIASES) -> Column:
    """Replace a normalised name by its registered spelling."""
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(aliases.items())])
    return F.coalesce(lookup[col(key)], col(key))


def id_from_url(c, pattern: str = PROFILE_ID_PATTERN) -> Column:
    """Lower-cased id captured by ``pattern``; empty string when there is none."""
    return F.lower(F.regexp_extract(F.coalesce(col(c), F.lit("")), pattern, 1))


def clean_text(c, default: str | None = None) -> Column:
    """Trimmed text; NULL or blank becomes ``default``."""
    text = F.nullif(F.trim(col(c).cast("string")), F.lit(""))
    return text if default is None else F.coalesce(text, F.lit(default))


def entity_key(id_col, name_key) -> Column:
    """Stable id when present, else ``name:<normalised name>``."""
    return F.coalesce(clean_text(id_col), F.concat(F.lit("name:"), col(name_key)))


def unresolved_key(name_key) -> Column:
    return F.concat(F.lit("unresolved:"), col(name_key))


def pair_key(a, b) -> Column:
    """Unordered pair as ``"x|y"``; the same for (a, b) and (b, a)."""
    left, right = col(a).cast("string"), col(b).cast("string")
    return F.concat_ws("|", F.least(left, right), F.greatest(left, right))
