"""Constraint checks that return their findings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import all_reasons


def key_problems(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that are empty or repeated."""
    by = df.groupBy(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")).alias(key)).agg(F.count("*").alias("n"))
    return by.filter((F.col("n") > 1) | (F.col(key) == ""))


def count_problems(df: DataFrame, group: str, expected: dict[str, int]) -> DataFrame:
    """(group, expected, actual) where the two differ, also for groups on one side only."""
    want = df.sparkSession.createDataFrame(list(expected.items()), f"{group} string, expected long")
    have = df.groupBy(group).agg(F.count("*").alias("actual"))
    return want.join(have, group, "full_outer").fillna(0, ["expected", "actual"]).filter("expected <> actual")


def split_overlaps(df: DataFrame, key: str, split: str) -> DataFrame:
    """(split_a, split_b, keys): keys that stand in two splits, for each pair of splits that shares any."""
    by = df.filter(F.col(key).isNotNull() & F.col(split).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("_s")).filter(F.size("_s") > 1)
    pair = by.select(F.posexplode("_s").alias("_i", "split_a"), "_s").select("split_a", F.explode(F.slice("_s", F.col("_i") + 2, F.size("_s"))).alias("split_b"))
    return pair.groupBy("split_a", "split_b").agg(F.count("*").alias("keys"))


def leaking(train: DataFrame, held_out: DataFrame, identity, mine: str, theirs: str) -> DataFrame:
    """Held-out rows whose text equals, under ``identity``, a train text."""
    known = train.select(identity(F.col(mine)).alias("_i")).filter("_i <> ''").distinct()
    return held_out.withColumn("_i", identity(F.col(theirs))).join(known, "_i", "left_semi").drop("_i")


def row_problems(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Rows that break a rule, with the names of all broken rules."""
    return df.withColumn("problems", all_reasons(rules)).filter(F.size("problems") > 0)


def json_problems(df: DataFrame, key: str, column: str, placeholders: list[str]) -> DataFrame:
    """(key, path, problem) for every null or placeholder value at any depth of a JSON column, and for broken JSON."""
    import json

    import pandas as pd

    marks = {p.lower() for p in placeholders}

    def walk(value, path):
        if value is None:
            yield path, "null"
        elif isinstance(value, str) and value.strip().lower() in marks:
            yield path, "placeholder"
        elif isinstance(value, dict):
            for k in sorted(value):
                yield from walk(value[k], f"{path}.{k}")
        elif isinstance(value, list):
            for i, v in enumerate(value):
                yield from walk(v, f"{path}[{i}]")

    def run(frames):
        for f in frames:
            rows = []
            for k, text in zip(f.iloc[:, 0], f.iloc[:, 1]):
                if text is None:
                    continue
                try:
                    rows += [(k, p, w) for p, w in walk(json.loads(text), "$")]
                except ValueError:
                    rows.append((k, "$", "broken"))
            yield pd.DataFrame(rows, columns=[key, "path", "problem"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInPandas(run, f"{key} {kind}, path string, problem string")


def nested_problems(df: DataFrame, key: str, required: list[str], enums: dict[str, list], whole: list[str], parts: str | None = None, total: str | None = None) -> DataFrame:
    """(key, problem): required columns (dots reach into structs) that are null, values outside their list, numbers that are
    negative or not whole, and a map whose values do not add up to a total."""
    rules = [(f"missing {c}", F.col(c).isNull()) for c in required] + [(f"value {c}", F.col(c).isNotNull() & ~F.col(c).isin(v)) for c, v in enums.items()]
    rules += [(f"number {c}", F.col(c).isNotNull() & ((F.col(c) < 0) | (F.col(c) != F.floor(F.col(c))))) for c in whole]
    if parts and total:
        sum_ = F.aggregate(F.map_values(parts), F.lit(0).cast("double"), lambda a, b: a + F.coalesce(b.cast("double"), F.lit(0.0)))
        rules.append((f"sum {parts}", F.col(parts).isNotNull() & (F.abs(sum_ - F.col(total)) > 1e-9)))
    return row_problems(df, rules).select(key, F.explode("problems").alias("problem"))


def config_problems(config: DataFrame, rules: list[tuple[str, Column]], artifacts: DataFrame, name: str, stated: str, content: str, splits: DataFrame, key: str, split: str) -> DataFrame:
    """(problem, what) of a protocol: broken rules of its configuration, artifacts whose digest is not the stated one, keys in two splits."""
    broken = row_problems(config, rules).select(F.lit("config").alias("problem"), F.explode("problems").alias("what"))
    changed = artifacts.filter(~F.sha2(content, 256).eqNullSafe(F.col(stated))).select(F.lit("digest").alias("problem"), F.col(name).cast("string").alias("what"))
    shared = split_overlaps(splits, key, split).select(F.lit("overlap").alias("problem"), F.concat_ws("/", "split_a", "split_b").alias("what"))
    return broken.unionByName(changed).unionByName(shared)


def audit_differences(rows: DataFrame, audit: DataFrame, group: str, correct: str, tolerance: float = 1e-9) -> DataFrame:
    """(group, problem) where an audit (group, rows, correct_rows, accuracy) is not what its rows give, or lacks a group."""
    from .aggregates import accuracy

    real = accuracy(rows, [group], correct).select(group, F.col("rows").alias("_n"), F.col("correct_rows").alias("_c"), F.col("accuracy").alias("_a"))
    both = audit.join(real, group, "full_outer")
    rules = [
        ("not_audited", F.col("rows").isNull()), ("no_rows", F.col("_n").isNull()), ("rows", F.col("rows") != F.col("_n")), ("correct_rows", F.col("correct_rows") != F.col("_c")),
        ("accuracy", F.abs(F.col("accuracy") - F.col("_a")) > tolerance),
    ]
    return row_problems(both, rules).select(group, F.explode("problems").alias("problem"))


def presence(expected: DataFrame, files: DataFrame, group: str) -> DataFrame:
    """(group, files, present) of each expected group of a listing."""
    have = files.groupBy(group).agg(F.count("*").alias("files"))
    return expected.join(have, group, "left").fillna(0, ["files"]).withColumn("present", F.col("files") > 0)


def same_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row (only_left, only_right, equal) about the distinct non-null keys of two tables."""
    a, b = left.select(key).filter(F.col(key).isNotNull()).distinct(), right.select(key).filter(F.col(key).isNotNull()).distinct()
    both = a.withColumn("_l", F.lit(1)).join(b.withColumn("_r", F.lit(1)), key, "full_outer")
    out = both.agg(F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"))
    return out.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def missing_tables(spark, names: list[str]) -> list[str]:
    return [n for n in names if not spark.catalog.tableExists(n)]
