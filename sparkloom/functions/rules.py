"""Ordered rules as data: the first that holds names the row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that is true, null if none; a rule that is null does not hold."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules])


def all_reasons(rules: list[tuple[str, Column]]) -> Column:
    """Names of all rules that are true, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())


def reason_counts(df: DataFrame, reason: str = "reject_reason", keep: str = "accepted") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(reason), F.lit(keep)).alias(reason)).agg(F.count("*").alias("n"))


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether the folded text contains one of the words."""
    low = F.lower(c)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.lower())) for w in words], F.lit(False))


def labels(c: Column, classes: dict[str, list[str]], default: str | None = None) -> Column:
    """All classes with a marker in the text, in the order given; ``[default]`` if there is none."""
    found = all_reasons([(k, contains_any(c, v)) for k, v in classes.items()])
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default))) if default else found


def primary(found: Column, order: list[str]) -> Column:
    """The label that comes first in ``order``."""
    return F.get(F.filter(F.array(*[F.lit(x) for x in order]), lambda x: F.array_contains(found, x)), F.lit(0))
