"""Deterministic identities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

SLUG_LENGTH = 48
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def fnv1a_base36(text: str) -> str:
    """32-bit FNV-1a over UTF-16 code units in base 36, seven digits."""
    h = 0x811C9DC5
    data = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(data), 2):
        h = ((h ^ (data[i] | data[i + 1] << 8)) * 0x01000193) & 0xFFFFFFFF
    out = ""
    while h:
        h, r = divmod(h, 36)
        out = _DIGITS[r] + out
    return out.rjust(7, "0")[:7]


def stable_id(kind: Column, name: Column) -> Column:
    """STABLE_kind_slug: lower case, other characters folded to one dash, 48 at most.

    Names that are not ASCII, fold to nothing or are cut get a hash of the name, so that they stay apart. Only those
    rows reach Python. A null name is an empty one.
    """

    @F.pandas_udf("string")
    def suffix(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None else fnv1a_base36(n))

    raw = F.coalesce(name, F.lit(""))
    slug = F.regexp_replace(F.regexp_replace(F.lower(raw), r"[^a-z0-9._-]+", "-"), r"^-+|-+$", "")
    special = raw.rlike(r"[^\x00-\x7F]") | (slug == "") | (F.length(slug) > SLUG_LENGTH)
    cut = F.substring(slug, 1, SLUG_LENGTH)
    hashed = suffix(F.when(special, raw))
    return F.concat(F.lit("STABLE_"), kind, F.lit("_"), F.when(special, F.concat(F.when(cut == "", "h").otherwise(cut), F.lit("-"), hashed)).otherwise(cut))


def edge_id(from_id: Column, to_id: Column, kind: Column, file: Column, line: Column) -> Column:
    """A connection's id from its key; parts are length-prefixed, so that keys never run together."""
    parts = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in (from_id, to_id, kind, file, line)]
    return F.concat(F.lit("CONN_"), kind, F.lit("_"), F.substring(F.sha2(F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]), 256), 1, 16))
