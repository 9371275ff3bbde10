"""One row per identity, and unions of keyed record sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each identity by an explicit order that must end in a unique column; nulls order last.

    An aggregation rather than a window: a hot identity is reduced to one row per task before the shuffle.
    """
    rank = F.struct(*[x.alias(f"_{i}") for i, x in enumerate(x for c in order for x in (F.col(c).isNull(), F.col(c)))])
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """As keep_first, for the last row; nulls still lose."""
    rank = F.struct(*[x.alias(f"_{i}") for i, x in enumerate(x for c in order for x in (F.col(c).isNotNull(), F.col(c)))])
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def keep_first_slim(df: DataFrame, identity: Column, key: str, order: list[str]) -> DataFrame:
    """As keep_first for wide rows: chooses keys by a hash aggregation with map-side combine, then joins them back.

    Only (identity hash, order, key) is shuffled before the choice, never the payload of the losers, and a hot identity is
    reduced on the map side.
    """
    rank = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.col(key).alias("_key"))
    chosen = df.select(F.sha2(identity, 256).alias("_i"), rank.alias("_o")).groupBy("_i").agg(F.min("_o").alias("_o"))
    return df.join(chosen.select(F.col("_o._key").alias(key)), key, "left_semi")


def keep_min(df: DataFrame, keys: list[str], by: Column, value: str) -> DataFrame:
    """Per group the value of least ``by`` (map-side combined)."""
    return df.groupBy(*keys).agg(F.min_by(F.col(value), by).alias(value))


def merge_shards(shards: list[DataFrame], key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(first row per key over the shards in the order given, one row with the number of rows and of repeated rows)."""
    whole = None
    for i, s in enumerate(shards):
        s = s.withColumn("_shard", F.lit(i))
        whole = s if whole is None else whole.unionByName(s, allowMissingColumns=True)
    kept = keep_first(whole, [key], ["_shard", *order]).drop("_shard")
    return kept, whole.agg(F.count("*").alias("rows"), (F.count("*") - F.count_distinct(key)).alias("repeated"))


def overlay(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Rows of both; where both have the key, the right row stands for both, with its nulls."""
    cols = [c for c in base.columns if c != key]
    b, o = base.alias("b"), over.withColumn("_over", F.lit(True)).alias("o")
    return b.join(o, F.col(f"b.{key}") == F.col(f"o.{key}"), "full_outer").select(
        F.coalesce(f"o.{key}", f"b.{key}").alias(key), *[F.when(F.col("o._over"), F.col(f"o.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in cols]
    )


def repeated_units_removed(df: DataFrame, key: str, text: str, least: int = 12) -> DataFrame:
    """(key, text) with each sentence of at least ``least`` characters kept once per text.

    Works inside the row by higher-order functions: a unit stays if it is short or no earlier unit has the same form.
    """
    unit = T.units(F.col(text))
    staged = df.select(key, unit.alias("_u")).withColumn("_n", F.transform("_u", lambda x: F.lower(T.spaced(x))))
    kept = F.filter("_u", lambda x, i: (F.length(F.get("_n", i)) < least) | (F.array_position("_n", F.get("_n", i)) == i + 1))
    return staged.select(key, F.trim(F.array_join(kept, "")).alias(text))
