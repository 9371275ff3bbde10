"""Hash-ordered selection: exact smallest-q per group without ranking a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def salted_hash(salt: str, *cols: str | Column) -> Column:
    """A 64-bit hash of the columns' text that depends on nothing but the salt and the values."""
    return F.xxhash64(F.lit(salt), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])


def take_smallest_per_group(
    df: DataFrame, quota: DataFrame, groups: list[str], order: str, tie: str, bits: int = 12
) -> DataFrame:
    """Rows of each group with the ``quota`` smallest (order, tie); ``quota`` has the group columns and a column quota.

    ``order`` is a uniform 64-bit hash.  Its top ``bits`` bits cut each group into cells; counts per cell tell which cells are
    taken whole, and only the one cell per group that crosses the quota is ranked.  A group of any size is thus spread over
    the tasks, and the result equals a full row_number per group.  Groups without a quota give nothing.
    """
    cell = F.shiftright(F.col(order), 64 - bits) if bits else F.lit(0)
    cells = df.withColumn("_cell", cell)
    by = Window.partitionBy(*groups).orderBy("_cell")
    plan = (
        cells.groupBy(*groups, "_cell").agg(F.count("*").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(by))
        .join(quota.select(*groups, F.col("quota").cast("long").alias("_quota")), groups)
        .filter(F.col("_upto") - F.col("_n") < F.col("_quota"))
        .select(*groups, "_cell", F.when(F.col("_upto") > F.col("_quota"), F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_need"))
    )
    met = cells.join(plan, [*groups, "_cell"])
    whole = met.filter("_need is null").select(*df.columns)
    rank = F.row_number().over(Window.partitionBy(*groups, "_cell").orderBy(order, tie))
    cut = met.filter("_need is not null").withColumn("_rank", rank).filter("_rank <= _need").select(*df.columns)
    return whole.unionByName(cut)
