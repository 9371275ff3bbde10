"""What the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import small
from ..operators.lineage import cut_lineage

__all__ = ["SENT_ROWS", "cut_lineage", "latest_rows", "small", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Sides up to this many rows may be sent to all tasks; the number is counted first, and beyond it a join shuffles.
SENT_ROWS = 200_000


def latest_rows(df: DataFrame, key: str, order: str | None, content: list[str]) -> DataFrame:
    """One version of each key without shuffling the content.

    Rows with the same key and the same ``content`` are interchangeable, so only keys delivered with different contents need
    a choice: the row with the greatest ``order`` (nulls first), ties by the hash of the content.  These keys come out of an
    aggregation over (key, hash, order); the losers are removed by an anti join that is left out when there are none, and that
    shuffles only if they are too many to send.  Exact repeats stay and must be harmless to the caller.
    """
    version = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in content])
    stamped = df.withColumn("_version", version)
    rank = F.struct(F.col(order) if order else F.lit(0), F.col("_version"))
    seen = cut_lineage(
        stamped.groupBy(F.col(key).alias("_key"))
        .agg(F.max(rank).alias("_best"), F.min("_version").alias("_lo"), F.max("_version").alias("_hi"))
        .filter("_lo <> _hi")
        .select("_key", F.col("_best._version").alias("_keep"))
    )
    if seen.isEmpty():
        return df
    stale = (stamped[key] == seen["_key"]) & (stamped["_version"] != seen["_keep"])
    return stamped.join(small(seen, SENT_ROWS), stale, "left_anti").drop("_version")
