"""Counts, accuracies, percentiles, votes, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_true(c: str) -> Column:
    """Null counts as not true."""
    return F.coalesce(F.col(c).cast("boolean"), F.lit(False))


def accuracy(df: DataFrame, groups: list[str], correct: str, denominator: int | None = None) -> DataFrame:
    """(groups, correct, rows, accuracy): share of true rows, of a fixed denominator if one is given; 0 for no rows."""
    good = F.count_if(is_true(correct))
    below = F.lit(denominator) if denominator else F.count("*")
    return df.groupBy(*groups).agg(good.alias("correct_rows"), F.count("*").alias("rows"), F.coalesce(F.try_divide(good.cast("double"), below), F.lit(0.0)).alias("accuracy"))


def micro_macro(df: DataFrame, group: str, correct: str) -> DataFrame:
    """One row: share over all rows, and unweighted mean of the groups' shares."""
    by = accuracy(df, [group], correct)
    return by.agg((F.sum("correct_rows") / F.sum("rows")).alias("micro"), F.avg("accuracy").alias("macro"))


def retention(base: DataFrame, student: DataFrame, key: str, group: str, correct: str) -> DataFrame:
    """(group, base_correct, student_correct, rows, ratio, capped): correct answers kept, over ids that both have.

    ratio is 0 for a base of 0; capped is at most 1.
    """
    b, s = base.alias("b"), student.alias("s")
    by = b.join(s, F.col(f"b.{key}") == F.col(f"s.{key}")).groupBy(F.col(f"b.{group}").alias(group)).agg(
        F.count_if(F.coalesce(F.col(f"b.{correct}"), F.lit(False))).alias("base_correct"), F.count_if(F.coalesce(F.col(f"s.{correct}"), F.lit(False))).alias("student_correct"), F.count("*").alias("rows")
    )
    ratio = F.coalesce(F.try_divide(F.col("student_correct").cast("double"), F.col("base_correct")), F.lit(0.0))
    return by.withColumn("ratio", ratio).withColumn("capped", F.least(ratio, F.lit(1.0)))


def floor_percentiles(df: DataFrame, groups: list[str], value: str, shares: list[float]) -> DataFrame:
    """Per group the value at index min(n - 1, floor(n * share)) of the sorted values, for each share as p<percent>.

    Counts per distinct value come first (map-side combined), so a hot group is reduced to its distinct values before it is
    ordered; the result is exact.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_k"))
    by = Window.partitionBy(*groups)
    ordered = counted.withColumn("_upto", F.sum("_k").over(by.orderBy(value))).withColumn("_n", F.sum("_k").over(by))
    at = lambda s: F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(s)))
    return ordered.groupBy(*groups).agg(*[F.min(F.when(F.col("_upto") > at(s), F.col(value))).alias(f"p{round(s * 100)}") for s in shares])


def spread(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """mean, median, linear-interpolated p95 and max."""
    return df.groupBy(*groups).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.percentile(value, 0.95).alias("p95"), F.max(value).alias("peak"))


def majority_vote(df: DataFrame, key: str, ordinal: str, answer: str) -> DataFrame:
    """(key, winner, votes, tied): most frequent non-empty answer, the one that came first among equals."""
    counted = df.filter(F.coalesce(F.col(answer), F.lit("")) != "").groupBy(key, answer).agg(F.count("*").alias("_c"), F.min(ordinal).alias("_f"))
    best = counted.groupBy(key).agg(F.max(F.struct("_c", (-F.col("_f")).alias("_f"), answer)).alias("_b"), F.collect_list("_c").alias("_all"))
    return best.select(key, F.col(f"_b.{answer}").alias("winner"), F.col("_b._c").alias("votes"), (F.size(F.filter("_all", lambda x: x == F.col("_b._c"))) > 1).alias("tied"))


def group_advantage(df: DataFrame, group: str, value: str, flat: float = 1e-4) -> DataFrame:
    """Each row's distance from its group's mean in population standard deviations; 0 where the group is flat.

    Mean and deviation come from an aggregation that is joined back, so a group of any size is combined on the map side.
    """
    stats = df.groupBy(group).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = F.when(F.col("_s") < flat, F.lit(0.0)).otherwise(F.try_divide(F.col(value) - F.col("_m"), F.col("_s")))
    return df.join(stats, group).withColumn("advantage", z).drop("_m", "_s")


def error_count(df: DataFrame, groups: list[str], error: str) -> DataFrame:
    """(groups, rows, errors): rows whose error text is not empty."""
    return df.groupBy(*groups).agg(F.count("*").alias("rows"), F.count_if(F.coalesce(F.length(error), F.lit(0)) > 0).alias("errors"))


def row_checksum(df: DataFrame, groups: list[str], cols: list[str], order: list[str], rows_each: int = 100_000) -> DataFrame:
    """(groups, rows, checksum) of the rows in an order: SHA-256 over the hashes of pieces, each over its rows' hashes in order.

    Rows are numbered by range partitions and hashed in pieces of ``rows_each``, so no task holds more than one piece.  A change
    of any value or of the order changes the checksum.
    """
    from ..functions.hashing import row_hash
    from .windows import global_rank

    hashed = df.select(*groups, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], row_hash(cols).alias("_h"))
    at = [F.col(f"_o{i}") for i in range(len(order))]
    ranked = global_rank(hashed, [*[F.col(g) for g in groups], *at], "_r", 0)
    ranked = ranked.withColumn("_g", F.to_json(F.struct(F.lit(0).alias("_"), *groups)))
    first = ranked.groupBy("_g").agg(F.min("_r").alias("_low"))  # one row per group
    pieces = ranked.join(first, "_g").select(
        *groups, F.floor((F.col("_r") - F.col("_low")) / rows_each).alias("_p"), F.struct(F.col("_r"), F.col("_h")).alias("_x")
    )
    inner = F.sha2(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["_h"]), "\n"), F.lit("\n")), 256)
    part = pieces.groupBy(*groups, "_p").agg(F.count("*").alias("_n"), inner.alias("_h"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_h"))), lambda x: x["_h"]), "\n"), 256)
    return part.groupBy(*groups).agg(F.sum("_n").alias("rows"), whole.alias("checksum"))


def inventory(files: DataFrame, group: str, name: str, extension: str, size: str, modified: str, first: int = 3) -> DataFrame:
    """(group, files, bytes, newest, extensions, samples): extensions as a map to their counts, samples the first names in order."""
    by = files.groupBy(group, extension).agg(F.count("*").alias("_n"), F.sum(size).alias("_b"), F.max(modified).alias("_m"), F.min(name).alias("_f"))
    names = files.select(group, name).distinct()
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy(group).orderBy(name))
    lead = names.withColumn("_r", rank).filter(F.col("_r") <= first).groupBy(group).agg(F.array_sort(F.collect_list(name)).alias("samples"))
    whole = by.groupBy(group).agg(
        F.sum("_n").alias("files"), F.sum("_b").alias("bytes"), F.max("_m").alias("newest"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(extension, F.lit("")), "_n")))).alias("extensions")
    )
    return whole.join(lead, group, "left")


def zero_filled(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Count of each listed value, 0 where there is none."""
    listed = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return listed.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").fillna(0, ["n"])


def rolled_up(df: DataFrame, groups: list[str], *aggs: Column) -> DataFrame:
    """Per group and grand total; the total has null groups."""
    return df.rollup(*groups).agg(*aggs)


def relation_stats(df: DataFrame, node: list[str], group: str) -> DataFrame:
    """One row: distinct nodes, edges (rows) and distinct groups of an observation table."""
    return df.agg(F.count_distinct(F.struct(*node)).alias("nodes"), F.count("*").alias("edges"), F.count_distinct(group).alias("groups"))


def conflict_metrics(df: DataFrame, event: str, action: str) -> DataFrame:
    """One row: events, rows, events with more than one action, their share."""
    by = df.groupBy(event).agg(F.count("*").alias("_r"), F.count_distinct(action).alias("_a"))
    hit = F.count_if(F.col("_a") > 1)
    return by.agg(F.count("*").alias("events"), F.sum("_r").alias("rows"), hit.alias("conflicts"), F.coalesce(F.try_divide(hit.cast("double"), F.count("*")), F.lit(0.0)).alias("conflict_share"))


def resolution_metrics(df: DataFrame, event: str, action: str, settled: str) -> DataFrame:
    """One row: events, conflicts (events of several actions), unresolved ones (no row of them settled), and the shares of
    unresolved events and of resolved conflicts; the latter is 1 where there is no conflict."""
    by = df.groupBy(event).agg(F.count_distinct(action).alias("_a"), F.max(F.coalesce(F.col(settled), F.lit(False))).alias("_s"))
    hit, open_ = F.count_if(F.col("_a") > 1), F.count_if((F.col("_a") > 1) & ~F.col("_s"))
    share = lambda a, b, empty: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(empty))
    return by.agg(
        F.count("*").alias("events"), hit.alias("conflicts"), open_.alias("unresolved"), share(open_, F.count("*"), 0.0).alias("unresolved_share"), share(hit - open_, hit, 1.0).alias("resolved_share")
    )


def repeated_keys(df: DataFrame, key: str, limit: int = 5) -> DataFrame:
    """The first keys, in order, that are empty or stand in several rows."""
    by = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias(key)).agg(F.count("*").alias("n"))
    return by.filter((F.col("n") > 1) | (F.trim(key) == "")).orderBy(key).limit(limit)


def most_called(df: DataFrame, key: str, code: str) -> DataFrame:
    """(key, name, calls): the function called most often in a text of code, first name in order among equals."""
    calls = df.select(key, F.explode(F.regexp_extract_all(F.col(code), F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1))).alias("name"))
    by = calls.groupBy(key, "name").agg(F.count("*").alias("calls"))
    best = by.groupBy(key).agg(F.min(F.struct((-F.col("calls")).alias("c"), "name")).alias("_b"))
    return best.select(key, F.col("_b.name").alias("name"), (-F.col("_b.c")).alias("calls"))
