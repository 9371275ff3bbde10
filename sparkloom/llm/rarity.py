"""Frequency of token runs over a whole collection as a table of bounded size.

Prefix filters need one global order of the runs, rarest first.  Any order is right as long as all tasks use the same, so the
exact frequency is not needed: runs are counted in 2**bits buckets by hash, and the counts are kept as one byte each on a
logarithmic scale.  The table covers every text; it grows with the number of texts up to ``MOST_BITS`` (16 MB) and is the only
thing broadcast.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .kernels import Tokens, pieces

LEAST_BITS, MOST_BITS = 16, 24
SLICES = 64


def bits_for(texts: int) -> int:
    """About 16 buckets per text, within the bounds."""
    return min(max(int(texts).bit_length() + 4, LEAST_BITS), MOST_BITS)


def bucket(grams: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(65 - len(table).bit_length())).astype(np.int64)


def order_of(grams: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A global order key, rarest bucket first and then by hash; never 0."""
    return (table[bucket(grams, table)].astype(np.uint64) << np.uint64(56)) | (grams >> np.uint64(8)) | np.uint64(1)


def estimated(grams: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Estimated number of occurrences of each run."""
    return np.exp2(table[bucket(grams, table)] / 8.0) - 1


def run_counts(df: DataFrame, text_of, k: int) -> np.ndarray:
    """Counts, as round(8 * log2(1 + n)), of the k-token runs of all rows, by hash bucket.

    ``text_of(batch) -> list[str]`` gives a batch's texts.  Each task adds up its own table and sends it once, in compressed
    slices; slices are added in two rounds, so no task reads more than a slice of some tasks' tables, and the driver gets one
    table.
    """
    bits = bits_for(df.count())
    width = (1 << bits) // SLICES

    def packed(x: np.ndarray) -> bytes:
        return zlib.compress(x.tobytes(), 1)

    def count(batches):
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            texts = text_of(batch)
            for i, j in pieces(texts):
                grams, _ = Tokens(texts[i:j]).grams(k)
                at, n = np.unique(bucket(grams, total), return_counts=True)
                total[at] += n.astype(np.uint32)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(SLICES), pa.int32()),
                    pa.array([part % 61] * SLICES, pa.int32()),
                    pa.array([packed(total[s * width : (s + 1) * width]) for s in range(SLICES)], pa.binary()),
                ],
                names=["slice", "part", "counts"],
            )

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint64)
        for x in t.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.uint32)
        small = packed(np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32))
        return pa.table(
            [t.column("slice").slice(0, 1), t.column("part").slice(0, 1), pa.array([small], pa.binary())],
            names=["slice", "part", "counts"],
        )

    def scale(t: pa.Table) -> pa.Table:
        n = np.frombuffer(zlib.decompress(add(t).column("counts")[0].as_py()), np.uint32)
        code = packed(np.minimum(np.round(8 * np.log2(1.0 + n)), 255).astype(np.uint8))
        return pa.table([t.column("slice").slice(0, 1), pa.array([code], pa.binary())], names=["slice", "codes"])

    schema = "slice int, part int, counts binary"
    sums = df.mapInArrow(count, schema).groupBy("slice", "part").applyInArrow(add, schema).groupBy("slice").applyInArrow(scale, "slice int, codes binary")
    out = np.zeros(1 << bits, np.uint8)
    for row in sums.collect():
        out[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(zlib.decompress(bytes(row["codes"])), np.uint8)
    return out


MOST_KEY_BITS = 26


def key_slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bit of each 64-bit key in a table of 2**bits bits."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def key_bits(df: DataFrame, keys: str, per_row: int = 512) -> np.ndarray:
    """One bit per hash slot: whether any row's array ``keys`` has a key there.  8 MB at most, whatever the number of keys.

    A slot without a bit proves that a key is absent; with more keys than slots it only proves less.
    """
    bits = min(max(int(df.count() * per_row).bit_length(), LEAST_BITS), MOST_KEY_BITS)
    width = (1 << bits) // SLICES

    def mark(batches):
        have = np.zeros(1 << bits, bool)
        for batch in batches:
            have[key_slots(batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64), bits)] = True
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        if have.any():
            cut = [zlib.compress(np.packbits(have[s * width : (s + 1) * width]).tobytes(), 1) for s in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part % 61] * SLICES, pa.int32()), pa.array(cut, pa.binary())], names=["slice", "part", "counts"])

    def merge(t: pa.Table) -> pa.Table:
        out = np.zeros(width // 8, np.uint8)
        for x in t.column("counts").to_pylist():
            out |= np.frombuffer(zlib.decompress(x), np.uint8)
        return pa.table([t.column("slice").slice(0, 1), t.column("part").slice(0, 1), pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())], names=["slice", "part", "counts"])

    schema = "slice int, part int, counts binary"
    sums = df.select(keys).mapInArrow(mark, schema).groupBy("slice", "part").applyInArrow(merge, schema).groupBy("slice").applyInArrow(merge, schema)
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in sums.collect():
        out[row["slice"] * width // 8 : (row["slice"] + 1) * width // 8] = np.frombuffer(zlib.decompress(bytes(row["counts"])), np.uint8)
    return out


def repeat_bits(df: DataFrame, keys_of, keys: int) -> np.ndarray:
    """One bit per hash slot: whether the slot met at least two keys of ``keys_of(batch)`` over all rows; 8 MB at most.

    A slot without a bit proves that its key stands alone in the table and can be left out of a join with itself.  ``keys`` is
    about the number of keys and sizes the table.
    """
    bits = min(max(int(keys).bit_length() + 3, LEAST_BITS), MOST_KEY_BITS)
    width = (1 << bits) // SLICES // 8

    def mark(batches):
        once, twice = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
        for batch in batches:
            at, n = np.unique(key_slots(keys_of(batch), bits), return_counts=True)
            twice[at[(n > 1) | once[at]]] = True
            once[at] = True
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        if once.any():
            a, b = np.packbits(once), np.packbits(twice)
            cut = [zlib.compress(a[s * width : (s + 1) * width].tobytes() + b[s * width : (s + 1) * width].tobytes(), 1) for s in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part % 61] * SLICES, pa.int32()), pa.array(cut, pa.binary())], names=["slice", "part", "counts"])

    def merge(t: pa.Table) -> pa.Table:
        once, twice = np.zeros(width, np.uint8), np.zeros(width, np.uint8)
        for x in t.column("counts").to_pylist():
            both = np.frombuffer(zlib.decompress(x), np.uint8)
            twice |= both[width:] | (once & both[:width])
            once |= both[:width]
        return pa.table([t.column("slice").slice(0, 1), t.column("part").slice(0, 1), pa.array([zlib.compress(once.tobytes() + twice.tobytes(), 1)], pa.binary())], names=["slice", "part", "counts"])

    schema = "slice int, part int, counts binary"
    sums = df.mapInArrow(mark, schema).groupBy("slice", "part").applyInArrow(merge, schema).groupBy("slice").applyInArrow(merge, schema)
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in sums.collect():
        out[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(zlib.decompress(bytes(row["counts"])), np.uint8)[width:]
    return out


def has_key(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each key's slot has a bit (packed as by key_bits)."""
    at = key_slots(keys, (len(table) * 8).bit_length() - 1)
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
