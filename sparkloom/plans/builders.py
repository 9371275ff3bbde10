"""Flows that build training and evaluation sets out of the operators.  Limits, columns and rules are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import first_reason
from ..operators import joins, quality
from ..operators.dedup import keep_first, keep_last, overlay
from ..operators.lineage import cut_lineage
from ..operators.windows import global_rank, slices



def budget_hold_out(df: DataFrame, key: str, order: list[Column], held_fits: Column, train_fits: Column, held: int) -> DataFrame:
    """(row, role): the first ``held`` rows of an order that keep the budget of evaluation, and of the rest those that keep the
    budget of training."""
    first = df.filter(held_fits).orderBy(*order).limit(held).select(key, F.lit("held_out").alias("role"))
    first = cut_lineage(first)
    rest = df.filter(train_fits).join(first.select(key), key, "left_anti").select(key, F.lit("train").alias("role"))
    return first.unionByName(rest)


def fresh_only(df: DataFrame, key: str, prompt: str, history: DataFrame, others: DataFrame, order: list[str], identity=T.squash) -> DataFrame:
    """Rows with ``reason``: id in the history, prompt in the history, prompt in another source, or a repeated prompt; null if fresh.

    Only rows that pass the earlier checks can make a later one a duplicate.  Prompts are compared under ``identity``.
    """
    form = df.withColumn("_f", F.sha2(identity(F.col(prompt)), 256))
    marks = lambda h, name: h.select(F.sha2(identity(F.col(prompt)), 256).alias("_f")).filter("_f is not null").distinct().withColumn(name, F.lit(True))
    seen = history.select(key).distinct().withColumn("_id", F.lit(True))
    judged = form.join(seen, key, "left").join(marks(history, "_past"), "_f", "left").join(marks(others, "_other"), "_f", "left")
    judged = cut_lineage(judged.withColumn("reason", first_reason([("seen_id", F.col("_id")), ("seen_prompt", F.col("_past")), ("other_source", F.col("_other"))])))
    fresh = judged.filter("reason is null")
    lead = fresh.groupBy("_f").agg(F.min(F.struct(*dict.fromkeys([*order, key]))).alias("_lead")).select("_f", F.col(f"_lead.{key}").alias("_first"))
    marked = fresh.join(lead, "_f").withColumn("reason", F.when(F.col(key) != F.col("_first"), "duplicate"))
    return marked.select(*df.columns, "reason").unionByName(judged.filter("reason is not null").select(*df.columns, "reason"))


def joined_tests(first: Column, second: Column, lead: str = "assert ", least: int = 3) -> Column:
    """The distinct tests of two lists, null unless there are at least ``least`` and all begin with ``lead``."""
    both = F.array_distinct(F.concat(F.coalesce(first, F.array().cast("array<string>")), F.coalesce(second, F.array().cast("array<string>"))))
    return F.when((F.size(both) >= least) & F.forall(both, lambda t: F.startswith(F.trim(t), F.lit(lead))), both)


def with_setup(tests: Column, setup: Column) -> Column:
    """Each test with the set-up code in front of it."""
    return F.transform(tests, lambda t: F.when(F.coalesce(F.trim(setup), F.lit("")) != "", F.concat(setup, F.lit("\n"), t)).otherwise(t))


def cached_phases(phases: list[DataFrame], key: str) -> DataFrame:
    """Results of several phases of a run; a later phase's row replaces an earlier one."""
    whole = phases[0]
    for more in phases[1:]:
        whole = overlay(whole, more, key)
    return whole


def strict_unique(df: DataFrame, form: Column, what: str) -> DataFrame:
    """The rows; an error if two of them have the same form."""
    counted = df.withColumn("_f", F.sha2(form, 256))
    many = counted.groupBy("_f").agg(F.count("*").alias("_n"))
    bad = F.raise_error(F.lit(f"repeated {what}")).cast("boolean")
    return counted.join(many, "_f").filter(F.when(F.col("_n") > 1, bad).otherwise(True)).drop("_f", "_n")


def remainder(full: DataFrame, part: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """Rows of the full set that the part lacks; an error if one of them is a training row."""
    rest = full.join(part.select(key).distinct(), key, "left_anti")
    flagged = joins.flag_seen(rest, train, [key], "_train")
    bad = F.raise_error(F.concat(F.lit("training row "), F.col(key).cast("string"))).cast("boolean")
    return flagged.filter(F.when(F.col("_train"), bad).otherwise(True)).drop("_train")


def floored_mix(fresh: DataFrame, replay: DataFrame, key: str, weight: str, least: float) -> DataFrame:
    """Fresh and replayed rows in one set with weights of at least ``least``; a fresh row wins over a replayed one."""
    both = fresh.withColumn("_o", F.lit(0)).unionByName(replay.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, [key], ["_o"]).drop("_o").withColumn(weight, F.greatest(F.lit(float(least)), F.coalesce(F.col(weight), F.lit(0.0))))


def exclusive_roles(df: DataFrame, flags: list[str]) -> DataFrame:
    """Rows with ``role``, the one flag that is set; ``role_problem`` names rows with none or several."""
    on = F.filter(F.array(*[F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(c)) for c in flags]), lambda x: x.isNotNull())
    return df.withColumn("_on", on).withColumns({"role": F.when(F.size("_on") == 1, F.get("_on", F.lit(0))), "role_problem": F.when(F.size("_on") == 0, "none").when(F.size("_on") > 1, "several")}).drop("_on")


def isolated_split(df: DataFrame, key: str, form: Column, order: list[Column], sizes: list[tuple[str, int]], rest: str, forbidden: DataFrame | None = None, marker: Column | None = None) -> DataFrame:
    """(key, role) of one row per form: slices of an order, so no form stands in two roles.

    Ids in ``forbidden`` and rows with the marker are left out first; of equal forms the first in the order stays.
    """
    pool = df.filter(~F.coalesce(marker, F.lit(False))) if marker is not None else df
    pool = joins.exclude(pool, forbidden, [key]) if forbidden is not None else pool
    ranked = pool.select(key, F.sha2(form, 256).alias("_f"), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    at = [f"_o{i}" for i in range(len(order))]
    one = keep_first(ranked.filter("_f is not null"), ["_f"], [*at, key])
    numbered = global_rank(one, [*[F.col(c) for c in at], F.col(key)], "_r")
    return numbered.select(key, slices(F.col("_r"), sizes, rest).alias("role"))


def staged(df: DataFrame, domain: str, stages: dict[str, list[str]], content: Column, markers: Column) -> DataFrame:
    """Rows with ``stage`` by domain and ``problem``: no content, or a forbidden marker."""
    stage = F.coalesce(*[F.when(F.col(domain).isin(d), F.lit(s)) for s, d in stages.items()])
    return df.withColumns({"stage": stage, "problem": first_reason([("no_stage", stage.isNull()), ("no_content", F.coalesce(F.trim(content), F.lit("")) == ""), ("marker", markers)])})


def first_over_sources(sources: list[DataFrame], identity: Column, key: str, order: list[str], top: int) -> DataFrame:
    """The first ``top`` distinct rows over sources in the order given; a form in an earlier source hides later ones."""
    whole = None
    for i, s in enumerate(sources):
        s = s.withColumn("_source", F.lit(i))
        whole = s if whole is None else whole.unionByName(s, allowMissingColumns=True)
    kept = keep_first(whole.withColumn("_f", F.sha2(identity, 256)).filter("_f is not null"), ["_f"], ["_source", *order, key])
    return kept.orderBy("_source", *order, key).limit(top).drop("_f", "_source")


def resume_without(log: DataFrame, key: str, order: list[str], bad: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to keep for a resumed run, rows to archive): the latest row per key, split by whether it is bad."""
    last = cut_lineage(keep_last(log, [key], order))
    flag = F.coalesce(bad, F.lit(False))
    return last.filter(~flag), last.filter(flag)


def gate_view(df: DataFrame, rule: Column, label: dict[str, Column], key: str, expected: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of a view with new labels, its problems: repeated keys and a wrong number of rows)."""
    view = df.filter(rule).withColumns(label)
    found = quality.key_problems(view, key).select(F.col(key).cast("string").alias("what"), F.lit("key").alias("problem"))
    if expected is not None:
        n = view.agg(F.count("*").alias("n")).filter(F.col("n") != expected)
        found = found.unionByName(n.select(F.col("n").cast("string").alias("what"), F.lit("rows").alias("problem")))
    return view, found


def quota_per_domain(df: DataFrame, domain: str, identity: Column, key: str, order: list[str], sizes: dict[str, list[tuple[str, int]]]) -> DataFrame:
    """(key, domain, role): per domain the first of equal forms, cut into slices of its own sizes; an error if a form is in two domains."""
    from pyspark.sql import Window

    form = df.withColumn("_f", F.sha2(identity, 256)).filter("_f is not null")
    first = keep_first(form.select(key, domain, "_f", *[c for c in order if c not in (key, domain)]), [domain, "_f"], [*order, key])
    spread = first.groupBy("_f").agg(F.count("*").alias("_d"))
    bad = F.raise_error(F.lit("a form stands in two domains")).cast("boolean")
    one = first.join(spread, "_f").filter(F.when(F.col("_d") > 1, bad).otherwise(True))
    top = max(sum(n for _, n in s) for s in sizes.values())
    rank = F.row_number().over(Window.partitionBy(domain).orderBy(*order, key))
    ranked = one.withColumn("_r", rank).filter(F.col("_r") <= top)  # a group limit before the shuffle
    role = F.coalesce(*[F.when(F.col(domain) == d, slices(F.col("_r"), s, "")) for d, s in sizes.items()], F.lit(""))
    return ranked.select(key, domain, role.alias("role")).filter("role <> ''")
