"""Problem 5: groups of records whose texts are nearly the same, at any table size.

Method: size-aware heavy-light join.  A record is its set of distinct 3-token runs, in one global order (rarest first).  A
pair of likeness t has at least ceil(t / (1 + t) * (a + b)) common runs, so the L rarest common runs stand among the first
n - ceil(t * n) + L runs of either record (its prefix of degree L).

* light sets (n up to a boundary): every 2-subset of the prefix of degree 2 is a key; equal keys join light sets, and a pair
  that is like another one has a 2-subset in common;
* heavy sets: every run of the prefix of degree 1 has an inverted list; heavy sets are looked up in the lists of the heavy
  sets and of those light sets that are large enough to be like a heavy one, and a pair that is like another one has a list in
  common.

Pairs that meet grow with the square of the collection and are never shuffled.  The keys are dealt to blocks by hash, a class
goes once to each block that has keys of it, with a sketch of its whole set, and a block tries its pairs in place: by size, by
rank, and by the sketches, in which two sets differ in at most as many bits as they have runs alone.  What is written is the
keys and the few pairs that are left.  All these tests are necessary conditions, so no pair is lost, and the exact likeness of
what is left decides.  Lists beyond ``CELL`` entries are cut into cells, which different blocks try.

Most subset keys and most rare runs stand alone in a collection; the counts of the runs and, for subsets, a table of one bit
per hash slot (8 MB at most) tell which do, and these are left out before the shuffle.  The boundary is the size of least cost:
seconds for the subset keys of the light sets, and for the list entries that the others would meet, from the estimated
frequency of their runs.  It reads a histogram of sizes (one row per size up to ``MAX_LIGHT``).  List entries grow with the
collection and subset keys of a set do not, so the boundary rises with it, as far as the subset keys do not outgrow the list
entries on disk.  A pair with only one common run (possible for sets of one run, where a 2-subset does not exist) is covered by
treating sets with a prefix of one run as heavy.

Records with equal sets form a class: the join runs over classes only, and copies are expanded by membership.

Defined results: null prompt or reference count as empty; a text of under three tokens has no runs and is like no other;
a sample_id counts once, with its latest version; ties and repeated rows change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SENT_ROWS, cut_lineage, latest_rows, small
from .kernels import Tokens, mix, pieces, set_signature
from .rarity import estimated, has_key, order_of, repeat_bits, run_counts
from .set_join import RUN, likeness, signed, verify_pairs

MAX_LIGHT = 256
DEGREE = 2
#: Core seconds for a million subset keys and for a million list entries as ``prefixes`` estimates them, measured where pairs
#: are tried in their blocks: 8.3 s for 14.5 million keys, 17 s for 1,630 million entries.
SUBSET_COST = 0.5
LIST_COST = 0.01
#: Subset keys are written, so they stay below so many times the list entries of all sets.
MOST_SUBSETS = 2
#: Lists beyond CELL entries are cut; entries and pairs tried at once; largest rank that is sent.
CELL, SLICE, CHUNK, RANK = 30_000, 300_000, 2_000_000, 0x1FFF
#: Bytes of a key, of a class in a block besides its sketch, and of a block at most.
KEY_BYTES, CLASS_BYTES, BLOCK_BYTES = 6, 13, 96 << 20
#: Estimated count of a bucket beyond which a run may stand in another text.
ALONE = 1.5


def records(data: DataFrame, key: str = "sample_id") -> DataFrame:
    """rid and text of each record."""
    slim = data.select(
        F.col(key).alias("rid"),
        F.col("created_ts").alias("_ts"),
        F.concat(F.coalesce("prompt", F.lit("")), F.lit("\n"), F.coalesce("reference", F.lit(""))).alias("text"),
    ).filter("rid is not null")
    return latest_rows(slim, "rid", "_ts", ["text"]).drop("_ts")


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [x.lower() for x in batch.column("text").to_pylist()]


def prefixes(rows: DataFrame, counts: np.ndarray, threshold: float) -> DataFrame:
    """(rid, c1, c2, n, sketch, runs, cost): the prefix of degree DEGREE, rarest first; empty for a class this task has already sent.

    ``runs`` holds 32 bits of each run: runs that fall together only meet once more.  ``cost`` estimates the list entries that
    the prefix meets.
    """
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        table = shared.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            texts = _texts(batch)
            for i, j in pieces(texts):
                grams, bounds = Tokens(texts[i:j]).grams(RUN)
                if not len(grams):
                    continue
                order = order_of(grams, table)
                text = np.repeat(np.arange(j - i), np.diff(bounds))
                at = np.lexsort((order, text))
                order, text, grams = order[at], text[at], grams[at]
                first = np.ones(len(at), bool)
                first[1:] = (order[1:] != order[:-1]) | (text[1:] != text[:-1])
                grams, text = grams[first], text[first]
                size = np.bincount(text, minlength=j - i)
                low = np.zeros(j - i + 1, np.int64)
                np.cumsum(size, out=low[1:])
                rank = np.arange(len(text)) - low[text]
                a, b = set_signature(grams, low)
                a, b = signed(a), signed(b)
                base = size - np.ceil(threshold * size - 1e-9).astype(np.int64)
                have = np.flatnonzero(size)
                fresh = np.zeros(j - i, bool)
                for x in have:
                    if (key := (int(a[x]), int(b[x]))) not in seen:
                        seen.add(key)
                        fresh[x] = True
                if len(seen) > 200_000:
                    seen.clear()
                rare = np.where(rank < base[text] + DEGREE, estimated(grams, table), 0.0)
                cost = np.bincount(text, weights=rare, minlength=j - i)
                keep = (rank < base[text] + DEGREE) & fresh[text]
                words, at = sketch_of(grams[fresh[text]], text[fresh[text]], np.where(fresh, size, 0))
                cut = np.zeros(j - i + 1, np.int32)
                np.cumsum(np.bincount(text[keep], minlength=j - i), out=cut[1:])
                out = pa.RecordBatch.from_arrays(
                    [
                        batch.column("rid").slice(i, j - i), pa.array(a), pa.array(b), pa.array(size.astype(np.int32)),
                        pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(words)]),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array((grams[keep] >> np.uint64(32)).astype(np.uint32).view(np.int32))), pa.array(cost),
                    ],
                    names=["rid", "c1", "c2", "n", "sketch", "runs", "cost"],
                )
                yield out.take(pa.array(have))

    kind = rows.schema["rid"].dataType.simpleString()
    return rows.mapInArrow(run, f"rid {kind}, c1 long, c2 long, n int, sketch binary, runs array<int>, cost double")


def boundary(sets: DataFrame, threshold: float) -> int:
    """The light size of least estimated cost; reads one row per size up to MAX_LIGHT.

    A light set that is too small to be like any heavy one saves its list entries; the larger light ones stand in the lists too.
    Sizes at which subset keys would outgrow the list entries do not come into question.
    """
    sized = sets.filter(F.size("runs") > 0).withColumn("size", F.least("n", F.lit(MAX_LIGHT + 1)))
    by = {r["size"]: (r["k"], r["cost"]) for r in sized.groupBy("size").agg(F.count("*").alias("k"), F.sum("cost").alias("cost")).collect()}
    prefix = {n: min(n - int(np.ceil(threshold * n - 1e-9)) + DEGREE, n) for n in by}
    entries = sum(k * prefix[n] for n, (k, _) in by.items())
    best, least = 0, None
    for b in range(MAX_LIGHT + 1):
        keys = sum(k * prefix[n] * (prefix[n] - 1) / 2 for n, (k, _) in by.items() if n <= b)
        if keys > MOST_SUBSETS * entries:
            break
        total = SUBSET_COST * keys + sum(LIST_COST * cost for n, (_, cost) in by.items() if n > b or n >= threshold * (b + 1))
        if least is None or total < least:
            best, least = b, total
    return best


def _runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All runs of a batch, and where those of each row begin and end."""
    runs = batch.column("runs")
    return runs.flatten().to_numpy(zero_copy_only=False).view(np.uint32), runs.offsets.to_numpy().astype(np.int64) - runs.offsets[0].as_py()


def _often(runs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return estimated(runs.astype(np.uint64) << np.uint64(32), counts)


def _subsets(batch: pa.RecordBatch, counts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(key, row, rank, how often at most) of each 2-subset of each row's runs; rank 0, as subsets have no place in the order."""
    runs, start = _runs(batch)
    flat, size = mix(runs.astype(np.uint64)), np.diff(start)
    often = np.zeros(len(runs)) if counts is None else _often(runs, counts)
    keys, owner, most = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for p in np.unique(size):
        if p < 2:
            continue
        rows = np.flatnonzero(size == p)
        x, y = np.triu_indices(int(p), 1)
        at = start[rows][:, None] + np.arange(p)
        keys.append((flat[at][:, x] + flat[at][:, y]).ravel())
        most.append(np.minimum(often[at][:, x], often[at][:, y]).ravel())
        owner.append(np.repeat(rows, len(x)))
    made = mix(np.concatenate(keys))
    return made, np.concatenate(owner), np.zeros(len(made), np.int64), np.concatenate(most)


def _entries(batch: pa.RecordBatch, counts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(key, row, rank, how often at most) of each run of the prefix of degree 1, which ``listed`` gives the length of."""
    runs, start = _runs(batch)
    row = np.repeat(np.arange(batch.num_rows), np.diff(start))
    rank = np.arange(len(row)) - start[row]
    keep = rank < batch.column("listed").to_numpy()[row]
    runs = runs[keep]
    return mix(runs.astype(np.uint64)), row[keep], rank[keep], np.zeros(len(runs)) if counts is None else _often(runs, counts)


def _cells(key: np.ndarray, often: np.ndarray, c1: np.ndarray, most: int = CELL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, entry, side) of the cells that each entry stands in.

    A list of more than ``most`` entries is cut into b parts by class; a cell holds two parts, or one part alone.  Entries of
    different sides meet, and those of side 0 (a part alone) meet each other, so each pair of entries meets in one cell.
    """
    b = np.maximum(np.ceil(often / most).astype(np.int64), 1)
    at = np.repeat(np.arange(len(key)), b)
    wide = b[at]
    x = (mix(c1[at].view(np.uint64)) % wide.astype(np.uint64)).astype(np.int64)
    y = np.arange(len(at)) - np.repeat(np.cumsum(b) - b, b)
    cell = (np.minimum(x, y) * wide + np.maximum(x, y)).astype(np.uint64)
    return np.where(wide > 1, mix(key[at] + mix(cell)), key[at]), at, np.where(x == y, 0, np.where(x < y, 1, 2))


def _planes(x: np.ndarray) -> bytes:
    """The bytes of an array, first all lowest ones, so that empty high bytes compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(x: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _met(sets: DataFrame, keys_of, keys: int, counts: np.ndarray, threshold: float) -> DataFrame:
    """(a1, b1): first halves of the names of classes that meet in a key and may be alike by their sizes, ranks and sketches.

    ``keys_of(batch, counts)`` gives the keys.  A block takes the keys of one share of the hash space; a class goes there once,
    with its sketch and its keys in that block, so that pairs are tried where they meet and only those left are written.
    """
    sc = sets.sparkSession.sparkContext
    rows, sketch = sets.agg(F.count("*"), F.coalesce(F.avg(F.length("sketch")), F.lit(0.0))).first()
    parts = blocks(keys, rows, sketch, sc.defaultParallelism)
    # a run's own count tells whether it stands alone; a subset of frequent runs may
    repeats = repeat_bits(sets.select("runs", "listed"), lambda b: keys_of(b)[0], keys) if keys_of is _subsets else None
    shared = sc.broadcast((repeats, counts))
    columns = ("c1", "n", "sketch", "count", "key", "code")

    def send(batches):
        repeats, table = shared.value
        for batch in batches:
            c1, n, light = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("c1", "n", "light"))
            key, row, rank, often = keys_of(batch, table)
            keep = often > ALONE
            if repeats is not None:
                keep &= has_key(key, repeats)
            key, row, rank = key[keep], row[keep], rank[keep]
            key, at, side = _cells(key, often[keep], c1[row])
            row, rank = row[at], rank[at]
            part = ((key & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)
            at = np.lexsort((row, part))
            row, part, key = row[at], part[at], (key[at] >> np.uint64(32)).astype(np.uint32)
            # a rank cut at RANK only lets more pairs through
            code = (np.minimum(rank[at], RANK) | side[at] << 13 | light[row].astype(np.int64) << 15).astype(np.uint16)
            cut = np.searchsorted(part, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cut)):
                own = slice(cut[p], cut[p + 1])
                rows, count = np.unique(row[own], return_counts=True)
                sketch = b"".join(batch.column("sketch").take(pa.array(rows)).to_pylist())
                made = (c1[rows].tobytes(), _planes(n[rows]), sketch, _planes(count.astype(np.int32)), key[own].tobytes(), _planes(code[own]))
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x], pa.binary()) for x in made)], names=["part", *columns])

    def meet(batches):
        got: dict[str, list] = {c: [] for c in columns}
        read = {"c1": np.int64, "n": np.int32, "sketch": np.uint64, "count": np.int32, "key": np.uint32, "code": np.uint16}
        for batch in batches:
            for c, kind in read.items():
                plain = c in ("c1", "sketch", "key")
                got[c] += [np.frombuffer(x, kind) if plain else _unplanes(x, kind) for x in batch.column(c).to_pylist()]
        if not got["c1"]:
            return
        c1 = np.concatenate(got["c1"])
        for i, j in pairs_in_block(*(np.concatenate(got.pop(c)) for c in columns), threshold):
            a, b = c1[i], c1[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a1", "b1"])

    slim = sets.select("c1", "n", "sketch", "light", "listed", "runs")
    sent = slim.mapInArrow(send, "part int, " + ", ".join(f"{c} binary" for c in columns))
    return sent.repartitionById(parts, F.col("part")).drop("part").mapInArrow(meet, "a1 long, b1 long")


def blocks(keys: int, rows: int, sketch: float, least: int) -> int:
    """The fewest blocks, about, of which none takes more than BLOCK_BYTES: with fewer blocks a class is sent to fewer of them."""
    parts, each = least, keys / max(rows, 1)
    while keys * KEY_BYTES + rows * min(parts * (1 - (1 - 1 / parts) ** each), each) * (CLASS_BYTES + sketch) > parts * BLOCK_BYTES:
        parts += max(1, parts // 8)
    return parts


def pairs_in_block(c1, n, sketch, count, key, code, threshold: float):
    """Batches of pairs of rows that meet in a key and may reach the threshold; a batch has each pair once.

    Entries of a list are ordered by size: an entry at rank r of a set of n leaves n - r common runs at most, so its partners
    of at least its size are one range, and a partner's own rank is tried next.  Sketches decide the rest.
    """
    share = threshold / (1 + threshold)
    row = np.repeat(np.arange(len(n), dtype=np.int32), count)
    place = key.astype(np.uint64) << np.uint64(32) | n[row].astype(np.uint64)
    at = np.argsort(place)
    place, row, code = place[at], row[at], code[at]
    del at
    fits = sketches_fit(n, sketch, threshold)
    first = 0
    while first < len(row):
        # whole lists, about SLICE entries
        last = int(np.searchsorted(place, place[min(first + SLICE, len(row)) - 1] | np.uint64(0xFFFFFFFF), "right"))
        for i, j in _pairs_in_lists(place[first:last], code[first:last].astype(np.int64), share):
            i, j = row[first:last][i], row[first:last][j]
            ok = fits(i, j)
            i, j = i[ok].astype(np.int64), j[ok].astype(np.int64)
            own = (c1[i] == c1[j]) & (n[i] == n[j])
            if own.any():  # a class that several tasks have sent; two classes with one first half differ in the sketch
                same = np.zeros(len(i), bool)
                same[own] = fits.equal(i[own], j[own])
                i, j = i[~same], j[~same]
            pair = np.unique(np.minimum(i, j) * len(n) + np.maximum(i, j))
            if len(pair):
                yield pair // len(n), pair % len(n)
        first = last


def _pairs_in_lists(place: np.ndarray, code: np.ndarray, share: float):
    """Batches of pairs of entries (key and size in ``place``, ordered) that sizes, ranks, sides and kinds let through."""
    size = (place & np.uint64(0xFFFFFFFF)).astype(np.int64)
    most = np.floor((size - (code & RANK) + 1e-6) / share).astype(np.int64) - size  # the largest size of a partner
    high = np.clip(most, 0, 0x7FFFFFFF).astype(np.uint64)
    start = np.arange(1, len(place) + 1)
    some = np.maximum(np.searchsorted(place, (place >> np.uint64(32) << np.uint64(32)) | high, "right") - start, 0)
    flagged = bool((code >> 13).any())
    side, light = code >> 13 & 3, code >> 15
    total = np.concatenate([[0], np.cumsum(some)])
    low = 0
    while low < len(place):
        top = max(int(np.searchsorted(total, total[low] + CHUNK, "right")) - 1, low + 1)
        i = np.repeat(np.arange(low, top), some[low:top])
        j = np.arange(len(i)) - np.repeat(total[low:top] - total[low] - start[low:top], some[low:top])
        low = top
        keep = size[i] <= most[j]
        if flagged:
            keep &= ((side[i] == 0) | (side[i] != side[j])) & ~((light[i] & light[j]) == 1)
        yield i[keep], j[keep]


def sketch_words(n: np.ndarray) -> np.ndarray:
    """Words of 64 bits of the sketch of a set of n runs: a power of two, at least 1.5 bits a run."""
    return 1 << np.ceil(np.log2(np.maximum(n * 1.5 / 64, 1))).astype(np.int64)


def sketch_of(grams: np.ndarray, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, bounds per text): each run turns one bit.  Bits in which two sketches differ are at most the runs that one set has alone."""
    bounds = np.zeros(len(size) + 1, np.int64)
    words = np.where(size > 0, sketch_words(size), 0)
    np.cumsum(words, out=bounds[1:])
    bit = bounds[:-1][text] * 64 + (grams & (words[text] * 64 - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(bit, minlength=int(bounds[-1]) * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64), bounds


class sketches_fit:
    """Whether the sketches of rows i and j leave the runs in common that the threshold needs; a wider one is folded."""

    def __init__(self, n: np.ndarray, sketch: np.ndarray, threshold: float):
        self.n, self.share = n.astype(np.int64), threshold / (1 + threshold)
        self.words = sketch_words(self.n)
        start = np.cumsum(self.words) - self.words
        self.table: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.words):
            largest = self.n[self.words == w].max() / threshold + 1
            rows, made = [], []
            for own in np.unique(self.words[self.words >= w]):
                at = np.flatnonzero((self.words == own) & (self.n <= largest))
                block = sketch[start[at][:, None] + np.arange(own)] if len(at) else np.zeros((0, own), np.uint64)
                while block.shape[1] > w:
                    half = block.shape[1] // 2
                    block = block[:, :half] ^ block[:, half:]
                rows.append(at)
                made.append(block)
            place = np.full(len(n), -1, np.int32)
            place[np.concatenate(rows)] = np.arange(sum(map(len, rows)))
            self.table[int(w)] = place, np.concatenate(made)

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        width = np.minimum(self.words[i], self.words[j])
        for w, (place, block) in self.table.items():
            at = np.flatnonzero(width == w)
            out[at] = np.bitwise_count(block[place[i[at]]] ^ block[place[j[at]]]).sum(axis=1, dtype=np.int64)
        return out

    def equal(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.differ(i, j) == 0

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        both = self.n[i] + self.n[j]
        return self.differ(i, j) <= both - 2 * np.ceil(both * self.share - 1e-9).astype(np.int64)


def candidate_classes(sets: DataFrame, counts: np.ndarray, threshold: float) -> DataFrame:
    """Distinct pairs (a1, b1) of the first halves of the names of classes that the heavy-light join meets."""
    edge = boundary(sets, threshold)
    light = (F.col("n") <= edge) & (F.size("runs") >= 2)
    base = (F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")
    fresh = sets.filter(F.size("runs") > 0).withColumn("light", light).withColumn("listed", F.least(base, F.size("runs")))
    subsets, lists = fresh.filter("light").withColumn("light", F.lit(False)), fresh.filter(~F.col("light") | (F.col("n") >= F.lit(threshold) * (edge + 1)))
    total = lambda df, x: df.agg(F.coalesce(F.sum(x), F.lit(0)).cast("long")).first()[0]
    by_list = _met(lists, _entries, total(lists, F.col("listed")), counts, threshold)
    keys = total(subsets, F.size("runs") * (F.size("runs") - 1) / 2)
    # a class sent by several tasks only raises the count
    return (by_list.union(_met(subsets, _subsets, keys, counts, threshold)) if keys else by_list).distinct()


def like_classes(data: DataFrame, threshold: float = 0.6, key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """(pairs of classes with their likeness, membership rid to class of classes that have copies or like classes)."""
    rows = records(data, key)
    counts = run_counts(rows.select("text"), _texts, RUN)
    sets = cut_lineage(prefixes(rows, counts, threshold))
    met = cut_lineage(candidate_classes(sets, counts, threshold))
    wanted = met.selectExpr("a1 c1").union(met.selectExpr("b1")).distinct()
    one = cut_lineage(sets.select("rid", "c1", "c2").join(small(wanted, SENT_ROWS), "c1", "left_semi").groupBy("c1", "c2").agg(F.min("rid").alias("rid")))
    pairs = met.join(one.selectExpr("c1 a1", "c2 a2"), "a1").join(one.selectExpr("c1 b1", "c2 b2"), "b1").filter("struct(a1, a2) < struct(b1, b2)")
    texts = rows.join(small(one, SENT_ROWS), "rid").groupBy("c1", "c2").agg(F.min("text").alias("text"))
    measure = lambda left, right: {"likeness": pa.array(likeness(left, right))}
    found = verify_pairs(pairs.select("a1", "a2", "b1", "b2"), texts, measure, "likeness double").filter(F.col("likeness") >= threshold)
    found = cut_lineage(found)
    # a class without copies and without a like class has no part in any result
    several = sets.groupBy("c1", "c2").agg(F.count("*").alias("k")).filter("k > 1").select("c1", "c2")
    used = cut_lineage(found.selectExpr("a1 c1", "a2 c2").union(found.selectExpr("b1", "b2")).union(several).distinct())
    return found, sets.select("rid", "c1", "c2").join(small(used, SENT_ROWS), ["c1", "c2"], "left_semi").distinct()


def near_duplicate_pairs(data: DataFrame, threshold: float = 0.6, key: str = "sample_id") -> DataFrame:
    """All pairs (id_a, id_b, likeness) of records whose likeness reaches the threshold, smaller id first."""
    found, member = like_classes(data, threshold, key)
    ma, mb = member.selectExpr("rid ra", "c1 a1", "c2 a2"), member.selectExpr("rid rb", "c1 b1", "c2 b2")
    across = found.join(ma, ["a1", "a2"]).join(mb, ["b1", "b2"]).select("ra", "rb", "likeness")
    within = ma.join(mb, (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2")) & (F.col("ra") < F.col("rb"))).select(
        "ra", "rb", F.lit(1.0).alias("likeness")
    )
    return across.union(within).select(F.least("ra", "rb").alias("id_a"), F.greatest("ra", "rb").alias("id_b"), "likeness")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component of edges (u, v), by hooking and pointer jumping."""
    both = cut_lineage(edges.select("u", "v").union(edges.select("v", "u")).distinct())
    label = cut_lineage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")))
    while True:
        near = both.join(label.selectExpr("node v", "root near"), "v").groupBy("u").agg(F.min("near").alias("near"))
        step = label.join(near.withColumnRenamed("u", "node"), "node").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root")
        )
        jump = step.selectExpr("node root", "root far")
        new = cut_lineage(
            step.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root"))
        )
        if new.filter("root <> old").isEmpty():
            return label
        label = new.select("node", "root")


def near_duplicate_groups(data: DataFrame, threshold: float = 0.6, key: str = "sample_id") -> DataFrame:
    """(id, group_id, group_size, links): one row per record that is like another; links counts its like records.

    The group is a connected component and its id the least member id.
    """
    found, member = like_classes(data, threshold, key)
    name = lambda p: F.concat_ws(":", p + "1", p + "2")
    size = member.groupBy("c1", "c2").agg(F.count("*").alias("members"), F.min("rid").alias("least"))
    size = cut_lineage(size.withColumn("node", name("c")))
    edges = found.select(name("a").alias("u"), name("b").alias("v"))
    root = components(edges)
    weight = edges.union(edges.select("v", "u")).join(size.selectExpr("node v", "members w"), "v").groupBy(F.col("u").alias("node")).agg(
        F.sum("w").alias("outer_links")
    )
    classes = (
        size.join(root, "node", "left").join(weight, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
        .withColumn("links", F.coalesce("outer_links", F.lit(0)) + F.col("members") - 1)
        .filter("links > 0")
    )
    groups = classes.groupBy("root").agg(F.min("least").alias("group_id"), F.sum("members").alias("group_size"))
    return (
        member.join(classes.select("c1", "c2", "root", "links"), ["c1", "c2"]).join(groups, "root")
        .select(F.col("rid").alias("id"), "group_id", "group_size", "links")
    )
