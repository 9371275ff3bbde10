"""Decision tables over requests: ordered rules give an action, a route with its latency, and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decide(df: DataFrame, rules: list[tuple[str, Column]], name: str = "action") -> DataFrame:
    """Adds the first rule's name whose condition holds, null if none; missing inputs make a condition false."""
    out = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules])
    return df.withColumn(name, out)


def weak_link(available: Column, rtt: Column, loss: Column, bandwidth: Column, limits: tuple[float, float, float]) -> Column:
    """Not available, or at or beyond one of the limits (round trip, loss, bandwidth)."""
    top_rtt, top_loss, low_bandwidth = limits
    return ~F.coalesce(available, F.lit(False)) | (rtt >= top_rtt) | (loss >= top_loss) | (bandwidth <= low_bandwidth)


def route(weak: Column, far: Column, far_cost: Column, near_cost: Column, deadline: Column) -> Column:
    """struct(path, reason, latency): near when the link is weak, far when wanted and in time, near otherwise; near is cut at the deadline."""
    near = lambda why: F.struct(F.lit("near").alias("path"), F.lit(why).alias("reason"), F.least(near_cost, deadline).alias("latency"))
    away = F.struct(F.lit("far").alias("path"), F.lit("wanted").alias("reason"), far_cost.alias("latency"))
    return F.when(weak, near("weak_link")).when(far & (far_cost <= deadline), away).otherwise(near("default"))


def with_fallback(df: DataFrame, result: str, other: str, name: str) -> DataFrame:
    """The result, or the other one where it is null, and which of them it is."""
    return df.withColumn(name, F.coalesce(result, other)).withColumn(f"{name}_fallback", F.col(result).isNull())


def simulate_requests(spark, n: int, weak_every: int, far_every: int, seed: int = 7) -> DataFrame:
    """n synthetic requests: modular flags, values from a hash of the number."""
    u = lambda salt: F.pmod(F.xxhash64(F.lit(f"{seed}{salt}"), "id"), F.lit(1000)) / F.lit(1000.0)
    return spark.range(n).select(
        "id", (F.pmod("id", F.lit(weak_every)) == 0).alias("weak"), (F.pmod("id", F.lit(far_every)) == 0).alias("far"), u("c").alias("confidence"), u("r").alias("risk")
    )
