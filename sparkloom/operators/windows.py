"""Ranks, slices, runs and arbitration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", start: int = 1) -> DataFrame:
    """Exact global row numbers without a one-task window: range partitions are sorted, kept, counted and offset.

    The order must be total.  One range shuffle; the sorted rows are written once, as sampled range bounds may differ between
    two runs of the same plan, and only one count per partition is gathered.
    """
    parts = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id())
    )
    counts = parts.groupBy("_pid").agg(F.count("*").alias("_n"), F.min("_seq").alias("_low"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = counts.withColumn("_before", before).select("_pid", "_low", "_before")
    number = F.col("_before") + F.col("_seq") - F.col("_low") + start
    return parts.join(offset, "_pid").withColumn(name, number).drop("_pid", "_seq", "_low", "_before")


def rank_in(df: DataFrame, groups: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))


def slices(rank: Column, sizes: list[tuple[str, int]], rest: str) -> Column:
    """Name of the consecutive slice a rank (from 1) falls in."""
    out, upto = F.when(F.lit(False), F.lit("")), 0
    for name, size in sizes:
        out = out.when((rank > upto) & (rank <= upto + size), F.lit(name))
        upto += size
    return out.otherwise(F.lit(rest))


def first_in_group_then_fill(df: DataFrame, group: str, key: str, first: Column, fill: Column, target: int) -> DataFrame:
    """One row per group by one hash order, then the rest by another up to ``target`` rows."""
    lead = df.withColumn("_h", first).groupBy(group).agg(F.min_by(key, F.struct("_h", key)).alias(key)).select(key).withColumn("_lead", F.lit(0))
    marked = df.join(lead, key, "left").withColumn("_lead", F.coalesce("_lead", F.lit(1))).withColumn("_f", fill)
    return marked.orderBy("_lead", "_f", key).limit(target).drop("_lead", "_f")


def interleave(df: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """Round robin over the groups in their order: the first of each, the second of each, ... up to ``limit`` rows."""
    ranked = rank_in(df, [group], order, "_turn").filter(F.col("_turn") <= limit)  # pushed below the shuffle as a group limit
    return ranked.orderBy("_turn", group).limit(limit).drop("_turn")


def arbitrate(df: DataFrame, event: str, order: list[str], action: str | None = None) -> DataFrame:
    """The row of each event that is greatest in the listed columns, the number of its rows, and, if ``action`` names a column,
    whether its non-null actions disagree.

    A maximum over a struct is combined on the map side, so a hot event costs one row per task.
    """
    rest = [c for c in df.columns if c != event and c not in order]
    best = df.groupBy(event).agg(
        F.max(F.struct(*order, *rest)).alias("_b"), F.count("*").alias("candidates"), *([(F.min(action) != F.max(action)).alias("disagree")] if action else [])
    )
    return best.select(event, "_b.*", "candidates", *(["disagree"] if action else []))


def breaches(df: DataFrame, source: str, time: str, bad: Column, least: int) -> DataFrame:
    """Rows with the number of consecutive bad samples so far, and whether an alarm fires there (the run reaches ``least``)."""
    by = Window.partitionBy(source).orderBy(time)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = df.withColumn("_bad", F.coalesce(bad, F.lit(False))).withColumn("_island", F.sum(F.when(F.col("_bad"), 0).otherwise(1)).over(upto))
    run = F.sum(F.when(F.col("_bad"), 1).otherwise(0)).over(Window.partitionBy(source, "_island").orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return flagged.withColumn("run", run).withColumn("alarm", (F.col("run") == least)).drop("_bad", "_island")


def elapsed(df: DataFrame, source: str, time: str, value: str) -> DataFrame:
    """Milliseconds since the first sample of the source, and the highest value so far."""
    by = Window.partitionBy(source).orderBy(time)
    ms = (F.unix_micros(time) - F.min(F.unix_micros(time)).over(Window.partitionBy(source))) / F.lit(1000.0)
    return df.withColumn("elapsed_ms", ms).withColumn("peak", F.max(value).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def failing_from(df: DataFrame, order: str, ok: Column) -> DataFrame:
    """Rows up to and with the first that is not ok (for short control tables: one task orders them)."""
    before = F.coalesce(F.sum(F.when(ok, 0).otherwise(1)).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_failed", before).filter("_failed = 0").drop("_failed")
