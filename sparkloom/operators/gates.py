"""Selection among candidates and pass/fail gates over small tables of metrics, with the rules as parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import all_reasons


def pick_best(df: DataFrame, order: list[Column], groups: list[str] = ()) -> DataFrame:
    """The first candidate (per group) in an order whose last column breaks ties."""
    rank = F.row_number().over((Window.partitionBy(*groups) if groups else Window.partitionBy()).orderBy(*order))
    return df.withColumn("_r", rank).filter("_r = 1").drop("_r")


def eligible(candidates: DataFrame, base: DataFrame, group: str, metric: str, gains: dict[str, float], candidate: str, tolerance: float = 1e-12) -> DataFrame:
    """(candidate, macro, failures, eligible): gain over the base of at least the group's minimum, in every group."""
    least = F.coalesce(*[F.when(F.col(group) == k, F.lit(float(v))) for k, v in gains.items()], F.lit(0.0))
    both = candidates.join(base.select(group, F.col(metric).alias("_b")), group, "left")
    bad = F.coalesce(F.col(metric) - F.col("_b") + tolerance < least, F.lit(True))
    by = both.groupBy(candidate).agg(F.avg(metric).alias("macro"), F.array_sort(F.collect_set(F.when(bad, F.col(group)))).alias("failures"))
    return by.withColumn("eligible", F.size("failures") == 0)


def ratio_gate(row: DataFrame, student: str, base: str, threshold: float, tolerance: float = 0.0, denominator: int | None = None, zero: str = "zero") -> DataFrame:
    """Adds ratio (capped at 1) and passed; ``zero`` says whether a base of 0 gives ratio 0 or an error."""
    s, b = F.col(student).cast("double"), F.col(base).cast("double")
    if denominator:
        s, b = s / denominator, b / denominator
    ratio = F.coalesce(F.try_divide(s, b), F.lit(0.0))
    if zero == "error":
        ratio = F.when(b == 0, F.raise_error(F.lit("the base has no correct row")).cast("double")).otherwise(ratio)
    out = row.withColumn("ratio", F.least(ratio, F.lit(1.0)))
    return out.withColumn("passed", F.col("ratio") + tolerance >= threshold)


def checks(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds failures (names of the rules that hold) and passed."""
    return df.withColumn("failures", all_reasons(rules)).withColumn("passed", F.size("failures") == 0)


def three_levels(row: DataFrame, first: Column, second: Column) -> DataFrame:
    """Adds decision: reject unless the first condition holds, candidate unless the second does too, else full."""
    held = lambda c: F.coalesce(c, F.lit(False))
    return row.withColumn("decision", F.when(~held(first), "reject").when(~held(second), "candidate").otherwise("full"))


def full_gate(kept: DataFrame, ratio: str, least: float, least_macro: float) -> DataFrame:
    """One row (groups, least_ratio, macro, passed): every group's ratio and their mean reach their thresholds."""
    out = kept.agg(F.count("*").alias("groups"), F.min(ratio).alias("least_ratio"), F.avg(ratio).alias("macro"))
    return out.withColumn("passed", F.coalesce((F.col("groups") > 0) & (F.col("least_ratio") >= least) & (F.col("macro") >= least_macro), F.lit(False)))


def better_variant(variants: DataFrame, base: DataFrame, value: str, canonical: str, gain: float, least_canonical: float, order: list[Column]) -> DataFrame:
    """The first variant in an order that gains enough over the one-row base and keeps the canonical share; no row if none does.

    The gain is compared without a tolerance.
    """
    both = variants.crossJoin(F.broadcast(base.limit(1).select(F.col(value).alias("_b"))))
    fits = (F.col(value) - F.col("_b") >= gain) & (F.col(canonical) >= least_canonical)
    return pick_best(both.filter(F.coalesce(fits, F.lit(False))).drop("_b"), order)


def non_inferior(candidates: DataFrame, base: DataFrame, candidate: str, item: str, value: str, least: dict[str, float]) -> DataFrame:
    """(candidate, gains, passed): the gain on every listed item is at least its minimum, which may be negative."""
    both = candidates.join(base.select(item, F.col(value).alias("_b")), item)
    gain = lambda i: F.max(F.when(F.col(item) == i, F.col(value) - F.col("_b")))
    by = both.groupBy(candidate).agg(*[gain(i).alias(f"gain_{n}") for n, i in enumerate(least)])
    fits = F.lit(True)
    for n, low in enumerate(least.values()):
        fits &= F.coalesce(F.col(f"gain_{n}") >= low, F.lit(False))
    return by.select(candidate, F.array(*[F.col(f"gain_{n}") for n in range(len(least))]).alias("gains"), fits.alias("passed"))


def stopped_early(log: DataFrame, step: str, loss: str, patience: int) -> DataFrame:
    """One row about a log of evaluations: steps, best_step, steps after the best, and problems that speak against an early stop.

    Problems: repeated steps, a missing loss, a best step that is too near the end for the patience, no row at all.
    """
    best = log.agg(
        F.count("*").alias("steps"), F.count_distinct(step).alias("_d"), F.count(loss).alias("_l"), F.max(step).alias("_last"),
        F.min(F.when(F.col(loss).isNotNull(), F.struct(loss, step))).getField(step).alias("best_step"),
    )
    after = log.join(F.broadcast(best.select("best_step")), F.col(step) > F.col("best_step")).agg(F.count("*").alias("after_best"))
    both = best.crossJoin(F.broadcast(after))
    rules = [
        ("empty", F.col("steps") == 0), ("repeated_steps", F.col("_d") < F.col("steps")), ("missing_loss", F.col("_l") < F.col("steps")), ("too_early", F.col("after_best") < patience),
    ]
    return both.select("steps", "best_step", "after_best", all_reasons(rules).alias("problems"))


def never_worse(candidates: DataFrame, base: DataFrame, candidate: str, item: str, value: str) -> DataFrame:
    """(candidate, worse, gain): items below the base and the total gain; null-safe for items the base lacks."""
    both = candidates.join(base.select(item, F.col(value).alias("_b")), item)
    return both.groupBy(candidate).agg(F.count_if(F.col(value) < F.col("_b")).alias("worse"), F.sum(F.col(value) - F.col("_b")).alias("gain"))
