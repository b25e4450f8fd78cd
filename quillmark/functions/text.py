"""Text columns: normalisation, keys, path parts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    import unicodedata

    return text.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFKC", x))


def normalize_text(text: Column, nfkc: bool = True) -> Column:
    """NFKC, lower case, everything but letters, digits, `_` and white space to a space, runs of white space to one. Null gives "".

    Give nfkc=False for texts known to be in that form: all else is built in, so no batch leaves the JVM.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    text = F.lower(_nfkc(text) if nfkc else text)
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " "))


def text_key(normalized: Column) -> Column:
    """16 hex digits of the SHA-1 of a normalised text."""
    return F.substring(F.sha1(normalized.cast("binary")), 1, 16)


def provenance_key(text: Column, nfkc: bool = True) -> Column:
    """The other key: lower-cased a-z and 0-9 only."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.regexp_replace(F.lower(_nfkc(text) if nfkc else text), "[^a-z0-9]+", "")


def subcategory(path: Column, suffix: str = r"_(val|test)_[0-9]+$", lenient: bool = True) -> Column:
    """Second part of a path, without a split suffix. Lenient: null where there is none, and `\\` parts paths too."""
    path = F.translate(path, "\\", "/") if lenient else path
    part = F.get(F.split(F.regexp_replace(path, "^/+|/+$", ""), "/"), F.lit(1))
    part = part if lenient else F.when(part.isNull(), F.raise_error(F.concat(F.lit("no sub-category in "), path))).otherwise(part)
    return F.regexp_replace(part, suffix, "")


def image_key(ok: Column, sha1: Column, path: Column) -> Column:
    """Content where it is known, else the lower-cased path."""
    return F.when(ok, F.concat(F.lit("sha1:"), sha1)).otherwise(F.concat(F.lit("path:"), F.lower(F.translate(path, "\\", "/"))))


def short_label(name: Column) -> Column:
    """Initials by pairs, `ab_cd`, of names with four parts or more; others stay."""
    parts = F.split(name, "_")
    first = lambda k: F.substring(parts[k], 1, 1)
    return F.when(F.size(parts) >= 4, F.concat(first(0), first(1), F.lit("_"), first(2), first(3))).otherwise(name)


def joined_set(value: Column) -> Column:
    """Aggregate: the distinct values, sorted, joined by `|`."""
    return F.array_join(F.array_sort(F.collect_set(value)), "|")
