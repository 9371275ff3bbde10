"""Parts of the two set-similarity joins: classes of equal shingle sets, rare-first prefixes, exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Tokens, distinct_per_text, pieces, set_signature

RUN = 3


def shingle_sets(texts: list[str], k: int = RUN):
    """For each piece of texts: first index, distinct k-token runs, their bounds, and the two halves of the sets' signature."""
    lowered = [t.lower() for t in texts]
    for i, j in pieces(lowered):
        grams, bounds = Tokens(lowered[i:j]).grams(k)
        values, bounds = distinct_per_text(grams, bounds)
        yield i, values, bounds, *set_signature(values, bounds)


def ranks(order: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each entry in its text under ``order``, and the number of entries of its text."""
    count = np.diff(bounds)
    text = np.repeat(np.arange(len(count)), count)
    at = np.lexsort((order, text))
    rank = np.empty(len(order), np.int64)
    rank[at] = np.arange(len(order)) - np.repeat(bounds[:-1], count)
    return rank, np.repeat(count, count)


def least_overlap(a, b, threshold: float):
    """Column: least number of common entries of sets of a and b entries whose likeness reaches the threshold."""
    share = threshold / (1 + threshold)
    return F.ceil((a + b) * F.lit(share) - F.lit(1e-9))


def verify_pairs(pairs: DataFrame, texts: DataFrame, measure, schema: str) -> DataFrame:
    """Join both texts of each pair of classes (a1, a2, b1, b2) and run ``measure(list_a, list_b) -> dict`` over batches.

    ``texts`` has one row (c1, c2, text) per class that occurs in a pair.
    """
    ta = texts.select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("text").alias("text_a"))
    tb = texts.select(F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("text").alias("text_b"))
    both = pairs.join(ta, ["a1", "a2"]).join(tb, ["b1", "b2"]).select("a1", "a2", "b1", "b2", "text_a", "text_b")
    extra = schema.strip()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            made = measure(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(4)] + list(made.values()), names=["a1", "a2", "b1", "b2", *made]
            )

    return both.mapInArrow(run, "a1 long, a2 long, b1 long, b2 long, " + extra)


def likeness(left: list[str], right: list[str], k: int = RUN) -> np.ndarray:
    """Exact likeness of each pair of texts: common distinct k-token runs over all distinct ones."""
    out = np.zeros(len(left))
    at = 0
    step = 512
    for s in range(0, len(left), step):
        a, b = left[s : s + step], right[s : s + step]
        merged: list = [None] * (2 * len(a))
        merged[0::2], merged[1::2] = a, b
        lowered = [t.lower() for t in merged]
        sets = []
        for i, j in pieces(lowered):
            grams, bounds = Tokens(lowered[i:j]).grams(k)
            values, bounds = distinct_per_text(grams, bounds)
            sets += [values[bounds[x] : bounds[x + 1]] for x in range(j - i)]
        for x in range(len(a)):
            both = len(np.intersect1d(sets[2 * x], sets[2 * x + 1], assume_unique=True))
            either = len(sets[2 * x]) + len(sets[2 * x + 1]) - both
            out[at] = both / either if either else 0.0
            at += 1
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
