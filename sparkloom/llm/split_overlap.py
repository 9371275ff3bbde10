"""Problem 2: records of evaluation splits that also stand, exactly or almost, in the train split.

Method: the runs of three tokens of a record, in one global order (rarest run first, then rolling hash).  Runs of the train
split are joined with those of the other splits, and the exact likeness of the pairs that meet decides.  The winnowed runs that
a found pair has in common (minima over windows of four runs) are chained in order and extended by alignment to both sides,
which gives the coverage of each record.

What bounds the join: a pair of likeness t has at least ceil(t / (1 + t) * (a + b)) common runs, so its ``DEGREE`` rarest common
runs stand among the first n - ceil(t * n) + DEGREE runs of either record.  Only these are joined, a joined pair of ranks that
cannot belong to one of the ``DEGREE`` rarest common runs is dropped at once, and a pair must meet in ``DEGREE`` runs (or in as
many as the threshold asks for, if fewer).  No pair is lost, however frequent its runs are and however short its texts.

Equal run sets form one class; a task sends the fingerprints of a class once, so a group of copies of any size costs a few
rows per task, and only the final list of pairs expands it.

Defined results: null, empty or unparsable evidence gives no text, and no text is like no other; a null or blank split
belongs to no side; equal digests match whatever the texts; a trace_id counts once, with its latest version.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SENT_ROWS, cut_lineage, latest_rows, small
from .kernels import Tokens, pieces, set_signature, winnow
from .rarity import has_key, key_bits, order_of, run_counts
from .set_join import RUN, least_overlap, likeness, signed, verify_pairs

WINDOW, DEGREE = 4, 3


def evidence_text(raw: str | None) -> str:
    """The ``text`` of the evidence items in order of ``rank``, joined by blanks; empty if it cannot be parsed."""
    if not raw:
        return ""
    try:
        items = json.loads(raw)
    except ValueError:
        return ""
    if not isinstance(items, list):
        return ""
    found = []
    for at, item in enumerate(items):
        if isinstance(item, dict) and isinstance(item.get("text"), str):
            try:
                rank = float(item.get("rank"))
            except (TypeError, ValueError):
                rank = math.inf
            found.append((rank, at, item["text"]))
    return " ".join(t for _, _, t in sorted(found))


def digest(column):
    """A SHA-256 digest in one form, or null for missing and placeholder values."""
    plain = F.regexp_replace(F.lower(F.trim(column)), r"^(sha-?256[:=\s]*|0x)", "")
    plain = F.regexp_replace(plain, r"[\s:\-]", "")
    return F.when(plain.rlike("^[0-9a-f]{64}$") & ~plain.rlike(r"^(.)\1{63}$"), plain)


def label(column):
    plain = F.lower(F.trim(column))
    return F.when(plain != "", plain)


def records(traces: DataFrame) -> DataFrame:
    """rid, train (boolean), split, source, digest, evidence of the records that belong to a known split."""
    slim = traces.select(
        F.col("trace_id").alias("rid"),
        F.col("created_ts").alias("_ts"),
        label(F.col("split")).alias("split"),
        label(F.col("source_dataset")).alias("source"),
        digest(F.col("sample_hash")).alias("digest"),
        F.col("evidence_items_json").alias("evidence"),
    ).filter("rid is not null")
    slim = latest_rows(slim, "rid", "_ts", ["split", "source", "digest", "evidence"]).drop("_ts")
    return slim.filter("split is not null").withColumn("train", F.col("split") == "train")


def _evidence_texts(batch: pa.RecordBatch) -> list[str]:
    return [evidence_text(x) for x in batch.column("evidence").to_pylist()]


def _seeds(grams: np.ndarray, bounds: np.ndarray, table: np.ndarray, threshold: float):
    """The prefix of degree DEGREE of some texts: (text, run) arrays, rarest first, and each text's number of distinct runs and
    set signature."""
    count = np.diff(bounds)
    where = np.repeat(np.arange(len(count)), count)
    order = order_of(grams, table)
    at = np.lexsort((order, where))
    first = np.ones(len(at), bool)
    first[1:] = (order[at][1:] != order[at][:-1]) | (where[at][1:] != where[at][:-1])
    values, text = grams[at][first], where[at][first]
    size = np.bincount(text, minlength=len(count))
    low = np.zeros(len(count) + 1, np.int64)
    np.cumsum(size, out=low[1:])
    rank = np.arange(len(text)) - low[text]
    limit = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + DEGREE
    used = rank < limit[text]
    return (text[used], values[used]), size, set_signature(values, low)


def fingerprints(rows: DataFrame, text_of, counts: np.ndarray, threshold: float, k: int = RUN) -> DataFrame:
    """One row (rid, train, c1, c2, n, keys) per record that has a text; ``rows`` has rid, train and what text_of reads.

    The keys stand in the order of their rank.  A class that this task has already sent has none."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        table = shared.value
        seen: set[tuple[bool, int, int]] = set()
        for batch in batches:
            texts = [t.lower() for t in text_of(batch)]
            train = batch.column("train").to_pylist()
            for i, j in pieces(texts):
                grams, bounds = Tokens(texts[i:j]).grams(k)
                if not len(grams):
                    continue
                (text, key), size, (a, b) = _seeds(grams, bounds, table, threshold)
                a, b = signed(a), signed(b)
                have = np.flatnonzero(size)
                fresh = np.zeros(j - i, bool)
                for x in have:
                    if (own := (train[i + x], int(a[x]), int(b[x]))) not in seen:
                        seen.add(own)
                        fresh[x] = True
                if len(seen) > 200_000:
                    seen.clear()
                keep = fresh[text]
                at = np.zeros(j - i + 1, np.int32)
                np.cumsum(np.bincount(text[keep], minlength=j - i), out=at[1:])
                keys = pa.ListArray.from_arrays(pa.array(at), pa.array(signed(key[keep])))
                out = pa.RecordBatch.from_arrays(
                    [batch.column("rid").slice(i, j - i), batch.column("train").slice(i, j - i), pa.array(a), pa.array(b), pa.array(size.astype(np.int32)), keys],
                    names=["rid", "train", "c1", "c2", "n", "keys"],
                )
                yield out.take(pa.array(have))

    kind = rows.schema["rid"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"rid {kind}, train boolean, c1 long, c2 long, n int, keys array<long>"
    )


def seed_pairs(prints: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a1, b1) of first class halves, train and other, whose common runs allow the threshold.

    Runs that the other side cannot have, by a table of one bit per hash slot, are left out before the shuffle.  A joined row is
    (key, c1, n and n - rank in one number); the second halves of the classes are looked up for the few pairs left.
    """
    sent = prints.filter(F.size("keys") > 0)
    sides = {flag: key_bits(sent.filter(F.col("train") != flag), "keys") for flag in (True, False)}
    other = prints.sparkSession.sparkContext.broadcast(sides)

    def run(batches):
        for batch in batches:
            keys = batch.column("keys")
            flat = keys.flatten().to_numpy(zero_copy_only=False)
            start = keys.offsets.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(start))
            rank = np.arange(len(flat)) - (start[:-1] - start[0])[row]
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)[row]
            may = np.where(train, has_key(flat.view(np.uint64), other.value[True]), has_key(flat.view(np.uint64), other.value[False]))
            row, flat, rank = row[may], flat[may], rank[may]
            n = batch.column("n").to_numpy().astype(np.int64)[row]
            own = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("train").take(own), pa.array(flat), batch.column("c1").take(own), pa.array((n << 32) | (n - rank))], names=["train", "key", "c1", "p"])

    posts = sent.select("train", "c1", "n", "keys").mapInArrow(run, "train boolean, key long, c1 long, p long")
    side = lambda flag, c, p: posts.filter(F.col("train") == flag).select("key", F.col("c1").alias(c), F.col("p").alias(p))
    count = lambda p: F.shiftright(p, 32)
    left = lambda p: F.col(p).bitwiseAND(F.lit(0xFFFFFFFF))
    need = least_overlap(count("pa"), count("pb"), threshold)
    fits = (F.least(left("pa"), left("pb")) + (DEGREE - 1) >= need) & (F.least(count("pa"), count("pb")) >= need)
    met = side(True, "a1", "pa").join(side(False, "b1", "pb"), "key").filter(fits)
    # a class sent by several tasks only raises the count
    by = met.groupBy("a1", "b1").agg(F.count("*").alias("_k"), F.min(need).alias("_need"))
    return by.filter(F.col("_k") >= F.least(F.lit(DEGREE), F.col("_need"))).select("a1", "b1")


def chain(a: list[int], b: list[int]) -> int:
    """Length of the longest chain of equal entries that ascends in both lists, with one bit per entry of ``b``."""
    where: dict[int, int] = {}
    for y, g in enumerate(b):
        where[g] = where.get(g, 0) | 1 << y
    full = (1 << len(b)) - 1
    row = full
    for g in a:
        if hit := row & where.get(g, 0):
            row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def longest(ids: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each position of ``own``, the most entries from there on that also stand from a position of ``other`` on.

    Positions are ranked by the next 1, 2, 4, ... entries; the best partner is a neighbour in the last order.
    """
    levels = [np.unique(ids, return_inverse=True)[1] + 1]
    n, h = len(ids), 1
    while h < n and levels[-1].max() < n:
        rank = levels[-1]
        after = np.zeros(n, np.int64)
        after[:-h] = rank[h:]
        levels.append(np.unique(rank * (n + 1) + after, return_inverse=True)[1] + 1)
        h *= 2
    order = np.sort(levels[-1][other])
    place = np.zeros(n + 2, np.int64)
    place[levels[-1]] = np.arange(n)
    at = np.searchsorted(order, levels[-1][own])
    best = np.zeros(len(own), np.int64)
    for pick in (np.maximum(at - 1, 0), np.minimum(at, len(order) - 1)):
        x, y = own.copy(), place[order[pick]]
        for j in range(len(levels) - 1, -1, -1):
            same = (x < n) & (y < n)
            same[same] = levels[j][x[same]] == levels[j][y[same]]
            x, y = x + (same << j), y + (same << j)
        best = np.maximum(best, x - own)
    return best


def align(left: str, right: str, k: int = RUN) -> tuple[float, float, int, int]:
    """Coverage of each text by extended seeds, the number of seeds, and of those in the longest collinear chain.

    Seeds are the meetings of common winnowed runs, each occurrence with each; a seed grows to both sides while the tokens agree.
    """
    both = Tokens([left.lower(), right.lower()])
    n, m = int(both.bounds[1]), int(both.bounds[2] - both.bounds[1])
    grams, bounds = both.grams(k)
    keep = winnow(grams, bounds, WINDOW)
    spot = [np.flatnonzero(keep[bounds[s] : bounds[s + 1]]) for s in (0, 1)]
    runs = [grams[bounds[s] + spot[s]] for s in (0, 1)]
    held = [np.isin(runs[s], runs[1 - s]) for s in (0, 1)]
    (p, q), (ga, gb) = (spot[s][held[s]] for s in (0, 1)), (runs[s][held[s]] for s in (0, 1))
    if not len(p):
        return 0.0, 0.0, 0, 0
    _, ca = np.unique(ga, return_counts=True)
    _, cb = np.unique(gb, return_counts=True)
    # the texts with an end mark of their own each; read forwards from a seed's first token and backwards from its last
    known = np.unique(both.hashes, return_inverse=True)[1]
    ids = np.concatenate([known[:n], [n + m], known[n:], [n + m + 1]])
    last = len(ids) - 1
    back = np.concatenate([ids[:-1][::-1], ids[-1:]])
    share = []
    for own, other, size, low in ((p, q + n + 1, n, 0), (q + n + 1, p, m, n + 1)):
        ahead = longest(ids, own, other)
        behind = longest(back, last - 1 - (own + k - 1), last - 1 - (other + k - 1)) - k
        step = np.zeros(size + 1, np.int64)
        np.add.at(step, own - low - behind, 1)
        np.add.at(step, own - low + ahead, -1)
        share.append(float((np.cumsum(step)[:size] > 0).mean()))
    return share[0], share[1], int((ca * cb).sum()), chain(ga.tolist(), gb.tolist())


def like_classes(
    rows: DataFrame, prints: DataFrame, text_of, threshold: float, raw: str
) -> DataFrame:
    """Pairs of classes (a1, a2, b1, b2) whose likeness reaches the threshold, with coverage_a, coverage_b, seeds, chained."""
    halves = cut_lineage(seed_pairs(prints, threshold))
    wanted = halves.selectExpr("a1 c1").union(halves.selectExpr("b1")).distinct()
    one = cut_lineage(prints.select("rid", "c1", "c2").join(small(wanted, SENT_ROWS), "c1", "left_semi").groupBy("c1", "c2").agg(F.min("rid").alias("rid")))
    pairs = halves.join(one.selectExpr("c1 a1", "c2 a2"), "a1").join(one.selectExpr("c1 b1", "c2 b2"), "b1").select("a1", "a2", "b1", "b2")
    texts = rows.select("rid", raw).join(small(one, SENT_ROWS), "rid").groupBy("c1", "c2").agg(F.min(raw).alias("text"))

    def measure(left, right):
        left = text_of(pa.RecordBatch.from_arrays([pa.array(left, pa.string())], names=[raw]))
        right = text_of(pa.RecordBatch.from_arrays([pa.array(right, pa.string())], names=[raw]))
        like = likeness(left, right)
        marks = [align(x, y) if v >= threshold else (0.0, 0.0, 0, 0) for x, y, v in zip(left, right, like)]
        return {
            "likeness": pa.array(like),
            "coverage_a": pa.array([m[0] for m in marks], pa.float64()),
            "coverage_b": pa.array([m[1] for m in marks], pa.float64()),
            "seeds": pa.array([m[2] for m in marks], pa.int64()),
            "chained": pa.array([m[3] for m in marks], pa.int32()),
        }

    schema = "likeness double, coverage_a double, coverage_b double, seeds long, chained int"
    return verify_pairs(pairs, texts, measure, schema).filter(F.col("likeness") >= threshold)


def compared(traces: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, membership rid, train, c1, c2, pairs of classes with their likeness and coverage)."""
    rows = records(traces)
    counts = run_counts(rows.select("evidence"), lambda b: [t.lower() for t in _evidence_texts(b)], RUN)
    prints = cut_lineage(fingerprints(rows.select("rid", "train", "evidence"), _evidence_texts, counts, threshold))
    found = like_classes(rows, prints, _evidence_texts, threshold, "evidence")
    return rows, prints.select("rid", "train", "c1", "c2").distinct(), found


def split_overlaps(traces: DataFrame, threshold: float = 0.6) -> DataFrame:
    """All pairs (train_id, other_id, same_digest, likeness, coverage_train, coverage_other, seeds, chained).

    A pair found by digest only has a null likeness and coverage.
    """
    rows, member, found = compared(traces, threshold)
    near = (
        found.join(member.filter("train").selectExpr("rid train_id", "c1 a1", "c2 a2"), ["a1", "a2"])
        .join(member.filter("not train").selectExpr("rid other_id", "c1 b1", "c2 b2"), ["b1", "b2"])
        .select(
            "train_id", "other_id", F.lit(False).alias("same_digest"), "likeness",
            F.col("coverage_a").alias("coverage_train"), F.col("coverage_b").alias("coverage_other"), "seeds", "chained",
        )
    )
    keyed = rows.filter("digest is not null").select("rid", "train", "digest")
    same = (
        keyed.filter("train").selectExpr("rid train_id", "digest")
        .join(keyed.filter("not train").selectExpr("rid other_id", "digest"), "digest")
        .select("train_id", "other_id", F.lit(True).alias("same_digest"))
    )
    return (
        near.unionByName(same, allowMissingColumns=True)
        .groupBy("train_id", "other_id")
        .agg(
            F.max("same_digest").alias("same_digest"),
            *[F.max(c).alias(c) for c in ("likeness", "coverage_train", "coverage_other", "seeds", "chained")],
        )
    )


def overlap_report(traces: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Per split and source: records, records with an overlap on the other side, by digest, by text, and mean coverage.

    Works on classes of equal texts and on digests, so no pair of records is written out: a class of a third of all rows that
    meets another one costs a row per record.
    """
    rows, member, found = compared(traces, threshold)
    side = lambda flag, c, cover: found.select(F.lit(flag).alias("train"), F.col(c + "1").alias("c1"), F.col(c + "2").alias("c2"), F.col(cover).alias("coverage"))
    classes = side(True, "a", "coverage_a").union(side(False, "b", "coverage_b")).groupBy("train", "c1", "c2").agg(F.max("coverage").alias("coverage"))
    by_text = member.join(classes, ["train", "c1", "c2"]).select("rid", "coverage", F.lit(True).alias("by_text")).distinct()
    slim = rows.select("rid", "split", "source", "train", "digest").distinct()
    on_both = slim.filter("digest is not null").groupBy("digest").agg(F.min("train").alias("lo"), F.max("train").alias("hi")).filter("lo <> hi")
    by_digest = on_both.select("digest", F.lit(True).alias("by_digest"))
    return (
        slim.join(by_text, "rid", "left").join(by_digest, "digest", "left")
        .groupBy("split", F.col("source").alias("source_dataset"))
        .agg(
            F.count("*").alias("records"),
            F.count_if(F.col("by_text").isNotNull() | F.col("by_digest").isNotNull()).alias("overlapping"),
            F.count("by_digest").alias("by_digest"),
            F.count("by_text").alias("by_text"),
            F.round(F.avg("coverage"), 6).alias("mean_coverage"),
        )
    )
