"""Problem 7: documents of varying length packed into training sequences of fixed capacity.

Method: cost-balanced packing.  A document of n tokens costs LINEAR * n + QUADRATIC * n * n (its own attention block).  Documents
go in descending order to the open sequence of lowest cost that still has room; as many sequences are open as the tokens need,
and a document that fits in none opens another.  A document over the capacity is cut into full sequences of its own, and only
its rest is packed.

Documents are dealt by hash to shards of about ``SHARD`` documents, so a task packs a bounded list of numbers whatever the size
of the collection; the loss is less than one sequence per shard.  Texts are tokenised once and never shuffled.

Defined results: null and empty texts have 0 tokens and get no sequence (sequence_id null); repeated doc_ids count once each
row; special-token strings in a text are ordinary text; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import salted_hash
from .common import cut_lineage

CAPACITY, SHARD = 4096, 20_000
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The word pattern that goes with the vocabulary files, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are handed to the tokenizer in parts of at most this length, cut where the word pattern always ends a word, so counts are
#: those of the whole text.  Only one unbroken run of letters longer than this is cut inside, which keeps its time linear.
PART = 8_000
_BREAK = re.compile(r"(?<=\S) (?=\S)|(?<=[^\W_])(?=[^\w\s]|_)")


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    if not text:
        return 0
    enc, total, at = encoder(path), 0, 0
    while len(text) - at > PART:
        # a single blank between two words, or the place between a letter and a sign
        cut = text.rfind(" ", at + 1, at + PART)
        while cut > at and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.rfind(" ", at + 1, cut)
        if cut <= at:
            cut = max((m.start() for m in _BREAK.finditer(text, at + 1, at + PART)), default=at + PART)
        total += len(enc.encode_ordinary(text[at:cut]))
        at = cut
    return total + len(enc.encode_ordinary(text[at:]))


def token_sizes(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and n_tokens of each document."""

    def run(batches):
        for batch in batches:
            sizes = [count_tokens(t, tokenizer) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long")


def assign(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Sequence number of each item (all within the capacity), lowest cost first, in descending order of size."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    room_for = -(-int(sizes.sum()) // capacity)
    room = np.full(room_for, capacity, np.int64)
    cost = np.zeros(room_for)
    out = np.zeros(len(sizes), np.int64)
    price = LINEAR * sizes + QUADRATIC * sizes.astype(float) ** 2
    for i in np.argsort(-sizes, kind="stable"):
        at = int(np.argmin(np.where(room >= sizes[i], cost, np.inf)))
        if room[at] < sizes[i]:
            room, cost, at = np.append(room, capacity), np.append(cost, 0.0), len(room)
        out[i] = at
        room[at] -= sizes[i]
        cost[at] += price[i]
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_tokens, n_parts, part, part_start, part_tokens, sequence_id): one row per part, parts of a document in order."""
    sizes = cut_lineage(token_sizes(docs, tokenizer))
    shards = max(1, -(-sizes.filter("n_tokens > 0").count() // shard))
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = sizes.withColumn("shard", F.pmod(salted_hash("pack", "doc_id"), F.lit(shards)))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["n_tokens", "doc_id"], ascending=[False, True], ignore_index=True)
        n = f.n_tokens.to_numpy()
        name = str(f.shard.iloc[0])
        rest, full = n % capacity, n // capacity
        rest, full = np.where((rest == 0) & (full > 0), capacity, rest), np.where((rest == 0) & (full > 0), full - 1, full)
        seq = assign(rest, capacity)
        parts = full + 1
        row = np.repeat(np.arange(len(n)), parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        last = part == full[row]
        own = np.cumsum(~last) - 1
        ids = np.where(last, np.char.add(name + "-p", seq[row].astype(str)), np.char.add(name + "-f", own.astype(str)))
        return pd.DataFrame(
            {
                "doc_id": f.doc_id.to_numpy()[row], "n_tokens": n[row], "n_parts": parts[row], "part": part, "part_start": part * capacity,
                "part_tokens": np.where(last, rest[row], capacity), "sequence_id": ids,
            }
        )

    schema = f"doc_id {kind}, n_tokens long, n_parts long, part long, part_start long, part_tokens long, sequence_id string"
    packed = keyed.filter("n_tokens > 0").groupBy("shard").applyInPandas(run, schema)
    nothing = keyed.filter("n_tokens = 0").select(
        "doc_id", "n_tokens", *[F.lit(0).cast("long").alias(c) for c in ("n_parts", "part", "part_start", "part_tokens")], F.lit(None).cast("string").alias("sequence_id")
    )
    return packed.union(nothing)


def oversized(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id of the documents that the packing had to cut."""
    return pack(docs, capacity, tokenizer).filter("n_parts > 1 and part = 0").select("doc_id")


def packing_report(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row: documents, tokens, sequences, share of the room left over, and the spread of the attention cost."""
    by = (
        pack(docs, capacity, tokenizer).filter("sequence_id is not null").groupBy("sequence_id")
        .agg(F.sum("part_tokens").alias("used"), F.count("*").alias("parts"), F.sum(LINEAR * F.col("part_tokens") + QUADRATIC * F.col("part_tokens") ** 2).alias("cost"))
    )
    return by.agg(
        F.sum("parts").alias("parts"), F.sum("used").alias("tokens"), F.count("*").alias("sequences"), F.max("used").alias("fullest"),
        F.round(1 - F.sum("used") / (F.count("*") * capacity), 6).alias("unused_share"), F.round(F.max("cost") / F.avg("cost"), 6).alias("cost_spread"),
    )
