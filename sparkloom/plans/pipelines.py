"""Whole flows: operators put together the way a curation or evaluation run uses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import first_reason, reason_counts
from ..operators import aggregates, joins
from ..operators.dedup import keep_first_slim


def curation_funnel(docs: DataFrame, held_out: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Texts per language after the reject rules, exact duplicates (first id stays) and held-out texts are gone."""
    x = F.col("text")
    good = docs.select("doc_id", "text", "lang").filter(first_reason(rules).isNull())
    first = keep_first_slim(good, T.squash(x), "doc_id", ["doc_id"])
    clean = joins.exclude_by(first, held_out, T.squash, "text", "text")
    by = clean.groupBy(F.lower(F.trim("lang")).alias("lang")).agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters"))
    whole = F.sum("documents").over(Window.partitionBy())  # over one row per language
    return by.select("lang", "documents", "characters", F.round(F.col("documents") / whole, 6).alias("share"))


def filter_with_dedup(rows: DataFrame, rules: list[tuple[str, Column]], form: Column) -> DataFrame:
    """Histogram of first-failing reasons where only rows that pass every check can shadow a later duplicate of their form.

    Of the rows of a form that pass, one stays; they are counted by an aggregation, so a hot form costs a row per task.
    """
    judged = rows.select(F.sha2(form, 256).alias("_f"), first_reason(rules).alias("reject_reason"))
    passed = judged.filter("reject_reason is null").groupBy("_f").agg((F.count("*") - 1).alias("_later"))
    both = passed.agg(F.count("*").alias("kept"), F.coalesce(F.sum("_later"), F.lit(0)).alias("later"))
    entry = lambda name, n: F.struct(F.lit(name).alias("reject_reason"), F.col(n).alias("n"))
    counts = both.select(F.explode(F.array(entry("accepted", "kept"), entry("duplicate", "later"))).alias("x")).select("x.*").filter("n > 0")
    return reason_counts(judged.filter("reject_reason is not null").select("reject_reason")).unionByName(counts)


def assemble(key: Column, right: Column, wrong: list[Column]) -> Column:
    """Options in a fixed order per key: wrong ones sorted by hash, the right one put in at hash % (number of options)."""
    slot = F.conv(F.substr(F.sha2(key, 256), F.lit(1), F.lit(8)), 16, 10).cast("bigint") % (len(wrong) + 1)
    keyed = F.array_sort(F.array(*[F.struct(F.sha2(F.concat(key, F.lit(":"), w), 256).alias("h"), w.alias("w")) for w in wrong]))
    return F.array_insert(F.transform(keyed, lambda x: x["w"]), (slot + 1).cast("int"), right)


def merge_and_gate(base: DataFrame, shards: list[DataFrame], key: str, group: str, correct: str, threshold: float) -> DataFrame:
    """Evaluation shards merged first-wins, matched with the base, and gated per group on the capped retention."""
    from ..operators.dedup import merge_shards

    merged, _ = merge_shards(shards, key, [])
    kept = aggregates.retention(base, merged, key, group, correct)
    return kept.withColumn("passed", F.col("capped") >= threshold)


def decide_and_arbitrate(requests: DataFrame, rules: list[tuple[str, Column]], event: str, order: list[str], default: Column) -> DataFrame:
    """An action per request (rules, else the default), and per event the decision that wins by the order."""
    from ..operators import decision, windows

    acted = decision.decide(requests, rules).withColumn("action", F.coalesce("action", default))
    return windows.arbitrate(acted, event, order)
