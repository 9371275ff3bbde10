"""Stable keys and checksums."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def stable_key(seed: object, *cols: Column | str, namespace: str | None = None) -> Column:
    """SHA-256 of seed:namespace:value, the order of all seeded selections."""
    lead = [F.lit(str(seed))] + ([F.lit(namespace)] if namespace is not None else [])
    return F.sha2(F.concat_ws(":", *lead, *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]), 256)


def hash_int(c: Column, digits: int = 8) -> Column:
    """The first hex digits of a SHA-256 as a number."""
    return F.conv(F.substr(F.sha2(c, 256), F.lit(1), F.lit(digits)), 16, 10).cast("bigint")


@F.pandas_udf(StringType())  # a type object: text would need a running session at import
def canonical_json_hash(s: pd.Series) -> pd.Series:
    """SHA-256 of JSON text with sorted keys, ', ' and ': ' separators and non-ASCII kept; null for broken JSON."""

    def one(t):
        try:
            return hashlib.sha256(json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False).encode()).hexdigest()
        except (TypeError, ValueError):
            return None

    return s.map(one)


def row_hash(cols: list[str]) -> Column:
    """SHA-256 of the columns' text, nulls as the two characters \\N, separated by U+0001."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols]), 256)


def id_list_hash(df: DataFrame, groups: list[str], key: str, digits: int = 2) -> DataFrame:
    """(groups, ids, checksum) per group, for groups of any size.

    Ids are dealt to pieces by the first hex digits of their own SHA-256; each piece is hashed over its sorted ids, each ended by
    a line end, and the piece hashes, joined by line ends in order of the pieces, are hashed again.  No task holds a whole
    group.  With 0 digits it is the plain SHA-256 of the sorted ids.
    """
    text = F.col(key).cast("string")
    piece = F.substr(F.sha2(text, 256), F.lit(1), F.lit(digits)) if digits else F.lit("")
    inner = F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list(text)), "\n"), F.lit("\n")), 256)
    part = df.groupBy(*groups, piece.alias("_p")).agg(F.count("*").alias("_n"), inner.alias("_h"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_p", "_h"))), lambda x: x["_h"])
    whole = F.sha2(F.array_join(ordered, "\n"), 256) if digits else F.max("_h")
    return part.groupBy(*groups).agg(F.sum("_n").alias("ids"), whole.alias("checksum"))
