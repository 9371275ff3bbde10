"""Loss weights: shares of mass by task, by quality, and normalised views.

Totals are aggregated first and joined back, so no task holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with_totals(df: DataFrame, group: str, total: Column) -> DataFrame:
    rows = df.groupBy(group).agg(total.alias("_t"), F.count("*").alias("_k")).withColumn("_n", F.sum("_k").over(Window.partitionBy()))
    return df.join(rows.drop("_k"), group)


def task_mass(df: DataFrame, task: str, mass: dict[str, float]) -> DataFrame:
    """weight = mass of the task * all rows / rows of the task."""
    share = F.coalesce(*[F.when(F.col(task) == k, F.lit(float(v))) for k, v in mass.items()], F.lit(0.0))
    return _with_totals(df, task, F.count("*")).withColumn("weight", share * F.col("_n") / F.col("_t")).drop("_t", "_n")


def quality_mass(df: DataFrame, group: str, quality: str, mass: dict[str, float]) -> DataFrame:
    """weight = mass of the group * all rows * quality / quality of the group."""
    share = F.coalesce(*[F.when(F.col(group) == k, F.lit(float(v))) for k, v in mass.items()], F.lit(0.0))
    return _with_totals(df, group, F.sum(quality)).withColumn("weight", F.coalesce(F.try_divide(share * F.col("_n") * F.col(quality), F.col("_t")), F.lit(0.0))).drop("_t", "_n")


def mean_one(df: DataFrame, weight: str) -> DataFrame:
    mean = df.agg(F.avg(weight)).first()[0]
    return df.withColumn(weight, F.col(weight) / F.lit(mean)) if mean else df


def mass_shares(df: DataFrame, task: str, weight: str) -> DataFrame:
    """(task, mass, share of all mass)."""
    by = df.groupBy(task).agg(F.sum(weight).alias("mass"))
    whole = F.sum("mass").over(Window.partitionBy())  # over one row per task
    return by.select(task, "mass", F.coalesce(F.try_divide(F.col("mass"), whole), F.lit(0.0)).alias("share"))


def floored(c: Column, least: float = 2.0) -> Column:
    return F.greatest(F.lit(least), c)
