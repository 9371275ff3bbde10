"""Problem 8: evaluation texts that stand, wholly or partly, in a training corpus.

Method: greedy string tiling.  Texts are compared as tokens after compatibility normalisation (full and half width), without
letter case, punctuation, spacing and invisible format characters.  Runs of ``least`` tokens of the test items are seeds in a
sorted table of rolling (Karp-Rabin) hashes; a document is hashed once and looked up in it, and each (document, item) pair with
a seed is tiled: the longest common stretch of unmarked tokens is marked, again and again, until none of ``least`` tokens is
left.  Tiles do not overlap, so reordered passages add up to the coverage of the item.

A test set of at most ``BLOCK`` characters (measured, not assumed) goes to all tasks, and the corpus is not shuffled.  A larger
one is met by a join of winnowed seeds, with one pass over the corpus for the seeds and one for the texts that met an item.

Defined results: null and empty texts have no tokens; an item of under ``least`` tokens cannot leak; items with equal texts are
reported each under its own id; a repeated (document, item) pair comes out once per document row.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SENT_ROWS, cut_lineage, small
from .kernels import Tokens, pieces, winnow
from .rarity import has_key, key_bits

BLOCK = 2_000_000
LEAST = 15
#: Shortest tile when reordered passages are to be caught too.
PART = 6
_FORMAT = re.compile("[\\u00ad\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\ufeff]")


def plain(text: str | None) -> str:
    if not text:
        return ""
    if not text.isascii():
        text = _FORMAT.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    return text.lower()


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token arrays: (start in doc, start in item, length), longest first.

    Each round finds, for every pair of equal seeds of ``least`` unmarked tokens, how far the equality runs, and marks the
    longest stretches that do not touch one marked before.
    """
    out: list[tuple[int, int, int]] = []
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    where: dict[bytes, list[int]] = {}
    for j in range(len(item) - least + 1):
        where.setdefault(item[j : j + least].tobytes(), []).append(j)
    if not where:
        return out
    firsts = np.flatnonzero(np.isin(doc[: max(len(doc) - least + 1, 0)], item))
    seeds = [(i, j) for i in firsts for j in where.get(doc[i : i + least].tobytes(), ())]
    while seeds:
        best, length = [], least
        begun = set(seeds)
        for i, j in seeds:
            if (i - 1, j - 1) in begun and free_d[i - 1] and free_i[j - 1]:
                continue
            n = 0
            while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_d[i + n] and free_i[j + n]:
                n += 1
            if n > length:
                best, length = [(i, j)], n
            elif n == length:
                best.append((i, j))
        if not best:
            break
        for i, j in best:
            if free_d[i : i + length].all() and free_i[j : j + length].all():
                free_d[i : i + length] = False
                free_i[j : j + length] = False
                out.append((int(i), int(j), length))
        seeds = [(i, j) for i, j in seeds if free_d[i : i + least].all() and free_i[j : j + least].all()]
    return out


def leaks(docs: DataFrame, items: DataFrame, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, tiles, matched, longest, coverage): pairs with a tile of at least ``least`` tokens.

    ``coverage`` is the share of the item's tokens that tiles cover.
    """
    slim_items = items.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    kind_d, kind_i = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind_d}, item_id {kind_i}, tiles int, matched int, longest int, coverage double"
    size = slim_items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if int(size) > block:
        return _leaks_joined(docs, slim_items, least, schema)
    rows = slim_items.orderBy("item_id", "text").collect()  # at most ``block`` characters
    return _leaks_of(docs, [x["item_id"] for x in rows], [x["text"] for x in rows], least, schema)


def _seed_rows(rows: DataFrame, key: str, least: int, known: np.ndarray | None = None) -> DataFrame:
    """(key, seeds) of each text: the winnowed runs of about half of ``least`` tokens, without those that ``known`` rules out.

    Of every ``least`` consecutive tokens the run of smallest hash is chosen, so two texts that share them share a seed.
    """
    run_of = least // 2 + 1
    held = rows.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def run(batches):
        for batch in batches:
            raw = [plain(t) for t in batch.column(1).to_pylist()]
            for i, j in pieces(raw):
                grams, bounds = Tokens(raw[i:j]).grams(run_of)
                keep = winnow(grams, bounds, least - run_of + 1)
                if held is not None and len(grams):
                    keep &= has_key(grams, held.value)
                text = np.repeat(np.arange(j - i), np.diff(bounds))[keep]
                cut = np.zeros(j - i + 1, np.int32)
                np.cumsum(np.bincount(text, minlength=j - i), out=cut[1:])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(cut), pa.array(grams[keep].view(np.int64)))], names=[key, "seeds"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "text").mapInArrow(run, f"{key} {kind}, seeds array<long>")


def _leaks_joined(docs: DataFrame, items: DataFrame, least: int, schema: str) -> DataFrame:
    """leaks() for a test set of any size: one pass over the corpus for the seeds, a join on them, and one for the met texts.

    Seeds that no item has are left out before the shuffle by a table of one bit per hash slot (8 MB at most); texts are one
    row per distinct text.
    """
    texts = docs.filter("text is not null").select(F.unhex(F.md5("text")).alias("sig"), "text")
    item_seeds = cut_lineage(_seed_rows(items.withColumnRenamed("item_id", "item"), "item", least))
    known = key_bits(item_seeds, "seeds")
    each = lambda df, key: df.select(key, F.explode("seeds").alias("seed")).distinct()
    met = each(_seed_rows(texts, "sig", least, known), "sig").join(each(item_seeds, "item"), "seed").select("sig", "item").distinct()
    met = cut_lineage(met)
    wanted = texts.join(small(met.select("sig").distinct(), SENT_ROWS), "sig", "left_semi").groupBy("sig").agg(F.min("text").alias("text"))
    both = met.join(wanted, "sig").join(items.select(F.col("item_id").alias("item"), F.col("text").alias("item_text")), "item")

    def run(batches):
        for batch in batches:
            keep, rows = [], []
            for x, (doc, item) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                part = Tokens([plain(doc), plain(item)])
                cut = int(part.bounds[1])
                found = tiles(part.hashes[:cut], part.hashes[cut:], least)
                if found:
                    keep.append(x)
                    matched = sum(t[2] for t in found)
                    rows.append((len(found), matched, max(t[2] for t in found), matched / (len(part.hashes) - cut)))
            at = pa.array(keep, pa.int32())
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *made], names=["sig", "item_id", "tiles", "matched", "longest", "coverage"])

    kind_i = items.schema["item_id"].dataType.simpleString()
    found = both.select("sig", "item", "text", "item_text").mapInArrow(run, f"sig binary, item_id {kind_i}, tiles int, matched int, longest int, coverage double")
    named = docs.filter("text is not null").select("doc_id", F.unhex(F.md5("text")).alias("sig"))
    return named.join(found, "sig").select("doc_id", "item_id", "tiles", "matched", "longest", "coverage")


def _leaks_of(docs: DataFrame, ids: list, texts: list[str], least: int, schema: str) -> DataFrame:
    tokens = Tokens([plain(t) for t in texts] or [""])
    grams, bounds = tokens.grams(least)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.argsort(grams, kind="stable")
    held = docs.sparkSession.sparkContext.broadcast((ids, tokens.hashes, tokens.bounds, grams[at], owner[at]))

    def run(batches):
        ids, item_tokens, item_bounds, table, owner = held.value
        for batch in batches:
            raw = [plain(t) for t in batch.column(1).to_pylist()]
            row, item, count, matched, longest, share = [], [], [], [], [], []
            for i, j in pieces(raw):
                part = Tokens(raw[i:j])
                g, b = part.grams(least)
                if not len(g) or not len(table):
                    continue
                low = np.searchsorted(table, g, "left")
                hit = np.flatnonzero((low < len(table)) & (table[np.minimum(low, len(table) - 1)] == g))
                if not len(hit):
                    continue
                high = np.searchsorted(table, g[hit], "right")
                doc_of = np.searchsorted(b, hit, "right") - 1
                pairs = {(int(d), int(o)) for d, lo, hi in zip(doc_of, low[hit], high) for o in owner[lo:hi]}
                for d, o in sorted(pairs):
                    mine = item_tokens[item_bounds[o] : item_bounds[o + 1]]
                    found = tiles(part.hashes[part.bounds[d] : part.bounds[d + 1]], mine, least)
                    if found:
                        row.append(i + d)
                        item.append(ids[o])
                        count.append(len(found))
                        matched.append(sum(t[2] for t in found))
                        longest.append(max(t[2] for t in found))
                        share.append(matched[-1] / len(mine))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int32())), pa.array(item, _plain_type(ids)), pa.array(count, pa.int32()),
                    pa.array(matched, pa.int32()), pa.array(longest, pa.int32()), pa.array(share, pa.float64()),
                ],
                names=["doc_id", "item_id", "tiles", "matched", "longest", "coverage"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _plain_type(ids: list):
    return pa.string() if ids and isinstance(ids[0], str) else pa.int64()


def partial_leaks(docs: DataFrame, items: DataFrame, share: float = 0.6, part: int = PART, least: int = LEAST) -> DataFrame:
    """As leaks(), with tiles from ``part`` tokens on: pairs with a tile of ``least`` tokens, or whose tiles, in any order, cover
    at least ``share`` of the item."""
    return leaks(docs, items, part).filter((F.col("longest") >= least) | (F.col("coverage") >= share))


def leak_report(docs: DataFrame, items: DataFrame, least: int = LEAST, whole: float = 0.8) -> DataFrame:
    """Per item: documents that hold part of it, documents that hold at least ``whole`` of it, and the greatest coverage."""
    hits = leaks(docs, items, least).groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("documents"),
        F.count_distinct(F.when(F.col("coverage") >= whole, F.col("doc_id"))).alias("whole_documents"),
        F.round(F.max("coverage"), 6).alias("most_coverage"),
    )
    named = items.select("item_id", "dataset_key", "split").distinct()
    return named.join(hits, "item_id", "left").fillna(0, ["documents", "whole_documents"])
