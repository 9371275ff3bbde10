"""Problem 3: sources mixed to target shares, small sources repeated at most a capped number of times.

Method: Poisson replication.  Each record of a source has a uniform number from a salted hash of gate and record id; the
inverse of a Poisson distribution at that number, cut at the cap, is its count, and the record is exploded by it.  The mean of
the distribution is chosen so that the mean of the cut count is goal / usable; a source that cannot reach its goal takes the
cap for every record, and is known to be short by that.  A last range partitioning by another salted hash shuffles the mixture globally.

Defined results: a trace_id counts once; a null or blank split or source is in no mixture; a null repeat_field, an unknown
column or a null value caps at 1; a gate without a rehearsal row has no mixture; a source with goal 0 or no usable record
gives nothing, and is reported if its goal is above 0.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sampling import salted_hash
from .common import SENT_ROWS, cut_lineage, latest_rows, small
from .split_overlap import label


def capped_poisson(mean: float, cap: int) -> list[float]:
    """Cumulative probabilities P(X <= 0), ..., P(X <= cap - 1) of the Poisson variable whose mean, cut at cap, is ``mean``.

    A hash-seeded uniform number u has the count of entries that are <= u.  At mean >= cap every entry is 0.
    """
    if cap <= 0 or mean <= 0:
        return [2.0] * max(cap, 0)
    if mean >= cap:
        return [0.0] * cap

    def cumulative(rate: float) -> list[float]:
        out, total = [], 0.0
        for k in range(cap):
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            out.append(min(total, 1.0))
        return out

    low, high = 0.0, max(2.0 * cap, 1.0)
    while sum(1 - x for x in cumulative(high)) < mean and high < 1e12:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if sum(1 - x for x in cumulative(mid)) < mean:
            low = mid
        else:
            high = mid
    return cumulative(high)


def train_records(traces: DataFrame) -> DataFrame:
    """rid and source (compared without outer blanks and letter case) of the train split."""
    slim = traces.select(
        F.col("trace_id").alias("rid"), F.col("created_ts").alias("_ts"), label(F.col("split")).alias("split"), label(F.col("source_dataset")).alias("source")
    ).filter("rid is not null")
    slim = latest_rows(slim, "rid", "_ts", ["split", "source"])
    return slim.filter((F.col("split") == "train") & F.col("source").isNotNull()).select("rid", "source").distinct()


def mixture_plan(records: DataFrame, rehearsal: DataFrame, mix: DataFrame) -> DataFrame:
    """One row per gate and listed source: usable, total, goal, cap."""
    caps = [f.name for f in rehearsal.schema.fields if f.name.endswith("_repeat")]
    first = Window.partitionBy("gate").orderBy(F.col("created_ts").desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in ("total_permille", *caps)])
    held = rehearsal.filter("gate is not null").withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("gate", "total_permille", *caps)
    listed = (
        mix.filter("gate is not null and source_dataset is not null")
        .withColumn("source", label(F.col("source_dataset")))
        .groupBy("gate", "source")
        .agg(F.max(F.struct("target_permille", "source_dataset", "repeat_field")).alias("m"))
        .select("gate", "source", "m.*")
    )
    usable = records.groupBy("source").agg(F.count("*").alias("usable"))
    cap = F.coalesce(*[F.when(F.col("repeat_field") == c, F.col(c)) for c in caps], F.lit(1).cast("long"))
    return (
        listed.join(held, "gate").join(usable, "source", "left")
        .withColumn("usable", F.coalesce("usable", F.lit(0)))
        .withColumn("total", F.expr("total_permille * sum(usable) over (partition by gate) div 1000"))
        .withColumn("goal", F.expr("(target_permille * total + 999) div 1000"))
        .withColumn("cap", F.greatest(cap, F.lit(0).cast("long")))
        .select("gate", "source_dataset", "source", "target_permille", "repeat_field", "usable", "total", "goal", "cap")
    )


def replicas(traces: DataFrame, rehearsal: DataFrame, mix: DataFrame, salt: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(gate, source_dataset, trace_id, copies of each record; plan).  A record drawn 0 times has no row.

    The plan has one row per gate and listed source and is sent to the records, so a source of any size is never shuffled.
    """
    records = train_records(traces)
    plan = mixture_plan(records, rehearsal, mix)

    def invert(frames):
        for f in frames:
            f["steps"] = [capped_poisson(g / u if u else 0.0, int(c)) for g, u, c in zip(f.goal, f.usable, f.cap)]
            yield f[["gate", "source_dataset", "source", "steps"]]

    steps = plan.filter("usable > 0 and goal > 0").select("gate", "source_dataset", "source", "usable", "goal", "cap").mapInPandas(
        invert, "gate string, source_dataset string, source string, steps array<double>"
    )
    unit = (F.shiftrightunsigned(salted_hash(salt, "gate", "rid"), 11)).cast("double") * F.lit(2.0**-53)
    drawn = (
        records.join(small(cut_lineage(steps), SENT_ROWS), "source").withColumn("u", unit)
        .withColumn("copies", F.expr("size(filter(steps, x -> x <= u))")).filter("copies > 0")
        .select("gate", "source_dataset", F.col("rid").alias("trace_id"), "copies")
    )
    return drawn, plan


def mixture(traces: DataFrame, rehearsal: DataFrame, mix: DataFrame, salt: str = "mix") -> DataFrame:
    """(gate, source_dataset, trace_id, copy, position), sorted globally by gate and position."""
    drawn = replicas(traces, rehearsal, mix, salt)[0]
    rows = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    rows = rows.withColumn("position", salted_hash(salt + "-order", "gate", "trace_id", "copy"))
    return rows.orderBy("gate", "position", "trace_id", "copy")


def mixture_report(traces: DataFrame, rehearsal: DataFrame, mix: DataFrame, salt: str = "mix") -> DataFrame:
    """The plan with the rows that the mixture really has, their share per gate, and the sources that fall short.

    A source is short when the replication repeated every one of its records up to the cap and still did not reach the goal.
    """
    drawn, plan = replicas(traces, rehearsal, mix, salt)
    real = drawn.groupBy("gate", "source_dataset").agg(
        F.sum("copies").alias("actual"), F.max("copies").alias("most_copies"), F.count("*").alias("_drawn"), F.min("copies").alias("_least")
    )
    out = plan.join(real, ["gate", "source_dataset"], "left").fillna(0, ["actual", "most_copies", "_drawn", "_least"])
    exhausted = (F.col("_drawn") == F.col("usable")) & ((F.col("_least") >= F.col("cap")) | (F.col("usable") == 0)) | (F.col("cap") == 0)
    share = F.expr("round(1000 * actual / nullif(sum(actual) over (partition by gate), 0), 3)")
    return out.withColumn("short", exhausted & (F.col("actual") < F.col("goal"))).withColumn("actual_permille", share).drop("source", "_drawn", "_least")
