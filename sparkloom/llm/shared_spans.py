"""Problem 9: long spans that stand word for word in more than one document.

Method: seed and extend.  Anchors are winnowed hashes of ``GRAM`` characters: of every ``least - GRAM + 1`` consecutive windows
the one of smallest hash, so each span of ``least`` equal characters has a common anchor.  Documents are joined on anchors,
each match is extended to both sides, and maximal stretches of at least ``least`` characters are kept.

An anchor is three quarters of the length asked for, so few joined pairs fail the extension.  Copies of a text are one class
(a 128-bit digest of the text): a task sends a class's anchors once, only one text per class is fetched for the extension, and
the pairs of documents come from the membership at the end.  The coverage of each document needs no pairs at all.

Defined results: null, empty and short texts share nothing; characters count as they are (letter case, width and blanks too);
a repeated doc_id with the same text counts once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SENT_ROWS, cut_lineage, small
from .kernels import char_grams, codes, pieces, slide
from .set_join import signed

LEAST, GRAM = 240, 180


def _anchors(texts: list[str], least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Selected window hashes, the index of their texts, and their positions in these."""
    grams, bounds = char_grams(texts, gram)
    w, n = least - gram + 1, len(grams)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    if n < w:
        return grams[:0], text[:0], text[:0]
    low = slide(grams, w, np.minimum)
    low[text[: n - w + 1] != text[w - 1 :]] = 0
    wide = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(slide(wide, w, np.maximum)[:n] == grams)
    return grams[at], text[at], at - bounds[text[at]]


def anchors(texts: list[str], least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    values, text, _ = _anchors(texts, least, gram)
    return values, text


#: Beyond this many anchor meetings in one pair (periodic texts) the pair is compared window by window, in linear time.
MEETINGS = 5_000


def maximal_repeats(left: str, right: str, least: int, gram: int) -> list[tuple[int, int, int]] | None:
    """(start in left, start in right, length) of all maximal common stretches of at least ``least`` characters.

    Each common anchor is checked and extended to both sides; an anchor inside a stretch found before, on the same diagonal,
    is skipped.  None if there are too many meetings.
    """
    values, text, at = _anchors([left, right], least, gram)
    mine, theirs = text == 0, text == 1
    order = np.argsort(values[theirs], kind="stable")
    vb, pb = values[theirs][order], at[theirs][order]
    lo, hi = np.searchsorted(vb, values[mine], "left"), np.searchsorted(vb, values[mine], "right")
    if int((hi - lo).sum()) > MEETINGS:
        return None
    a, b = codes(left), codes(right)
    found: list[tuple[int, int, int]] = []
    reached: dict[int, int] = {}
    for i, s, e in zip(at[mine].tolist(), lo.tolist(), hi.tolist()):
        for j in pb[s:e].tolist():
            if i < reached.get(i - j, -1) or left[i : i + gram] != right[j : j + gram]:
                continue
            back = min(i, j)
            differ = np.flatnonzero(a[i - back : i] != b[j - back : j])
            back = back - int(differ[-1]) - 1 if len(differ) else back
            ahead = min(len(a) - i, len(b) - j)
            differ = np.flatnonzero(a[i : i + ahead] != b[j : j + ahead])
            ahead = int(differ[0]) if len(differ) else ahead
            reached[i - j] = i + ahead
            if back + ahead >= least:
                found.append((i - back, j - back, back + ahead))
    return found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def shared_stretches(left: str, right: str, least: int = LEAST, gram: int = GRAM) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Stretches [from, to) of each text that stand in the other, from the maximal repeats; overlapping ones are one."""
    repeats = maximal_repeats(left, right, least, gram)
    if repeats is None:
        return _by_windows(left, right, least), _by_windows(right, left, least)
    return _merged([(i, i + n) for i, _, n in repeats]), _merged([(j, j + n) for _, j, n in repeats])


def _by_windows(mine: str, theirs: str, least: int) -> list[tuple[int, int]]:
    """As shared_stretches for one side: every window of ``least`` characters whose hash the other text has, checked."""
    g, b = char_grams([mine, theirs], least)
    own, other = g[: b[1]], g[b[1] :]
    values, first = np.unique(other, return_index=True)
    at = np.flatnonzero(np.isin(own, values))
    where = first[np.searchsorted(values, own[at])]
    return _merged([(p, p + least) for p, q in zip(at.tolist(), where.tolist()) if mine[p : p + least] == theirs[q : q + least]])


def classes(docs: DataFrame) -> DataFrame:
    """did, sig (16 bytes) and text of the documents long enough to share a span."""
    return docs.select(F.col("doc_id").alias("did"), F.unhex(F.md5("text")).alias("sig"), "text").filter("did is not null")


def like_classes(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """(sig_a, sig_b, stretches_a, stretches_b) of classes with different texts that share a span."""
    rows = classes(docs).filter(F.length("text") >= least)

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            texts, sigs = batch.column("text").to_pylist(), batch.column("sig").to_pylist()
            fresh = []
            for x, s in enumerate(sigs):
                if s not in seen:
                    seen.add(s)
                    fresh.append(x)
            if len(seen) > 200_000:
                seen.clear()
            chosen = [texts[x] for x in fresh]
            for i, j in pieces(chosen):
                values, text = anchors(chosen[i:j], least, gram)
                if not len(values):
                    continue
                at = np.lexsort((values, text))
                values, text = values[at], text[at]
                first = np.ones(len(at), bool)
                first[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
                own = pa.array(np.array(fresh)[i:j][text[first]])
                yield pa.RecordBatch.from_arrays([pa.array(signed(values[first])), batch.column("sig").take(own)], names=["anchor", "sig"])

    posts = rows.select("sig", "text").mapInArrow(run, "anchor long, sig binary")
    a, b = posts.select("anchor", F.col("sig").alias("sig_a")), posts.select("anchor", F.col("sig").alias("sig_b"))
    pairs = cut_lineage(a.join(b, "anchor").filter("sig_a < sig_b").select("sig_a", "sig_b").distinct())
    wanted = pairs.selectExpr("sig_a sig").union(pairs.selectExpr("sig_b")).distinct()
    texts = rows.select("sig", "text").join(small(wanted, SENT_ROWS), "sig", "left_semi").groupBy("sig").agg(F.min("text").alias("text"))
    both = (
        pairs.join(texts.selectExpr("sig sig_a", "text text_a"), "sig_a").join(texts.selectExpr("sig sig_b", "text text_b"), "sig_b")
        .select("sig_a", "sig_b", "text_a", "text_b")
    )
    spans = pa.list_(pa.struct([("f", pa.int32()), ("t", pa.int32())]))

    def extend(batches):
        for batch in batches:
            keep, left, right = [], [], []
            for x, (p, q) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                sa, sb = shared_stretches(p, q, least, gram)
                if sa:
                    keep.append(x)
                    left.append([{"f": s, "t": e} for s, e in sa])
                    right.append([{"f": s, "t": e} for s, e in sb])
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(left, spans), pa.array(right, spans)], names=["sig_a", "sig_b", "spans_a", "spans_b"]
            )

    kind = "array<struct<f: int, t: int>>"
    return both.mapInArrow(extend, f"sig_a binary, sig_b binary, spans_a {kind}, spans_b {kind}")


def shared_pairs(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """All pairs (doc_id_a, doc_id_b) of documents that share a span of at least ``least`` characters, smaller id first."""
    found = like_classes(docs, least, gram)
    member = classes(docs).filter(F.length("text") >= least).select("did", "sig").distinct()
    ma, mb = member.selectExpr("did da", "sig sig_a"), member.selectExpr("did db", "sig sig_b")
    across = found.select("sig_a", "sig_b").join(ma, "sig_a").join(mb, "sig_b").select("da", "db")
    within = ma.join(mb, F.col("sig_a") == F.col("sig_b")).filter("da < db").select("da", "db")
    return across.union(within).select(F.least("da", "db").alias("doc_id_a"), F.greatest("da", "db").alias("doc_id_b")).filter("doc_id_a < doc_id_b").distinct()


def _anchor_rows(rows: DataFrame, least: int, gram: int) -> DataFrame:
    """(sig, at, anchor, around): the anchors of each text a task sees first, with a hash of the ``least - gram`` characters on
    both sides; null where the text ends before."""
    side = least - gram

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            texts, sigs = batch.column("text").to_pylist(), batch.column("sig").to_pylist()
            fresh = []
            for x, s in enumerate(sigs):
                if s not in seen:
                    seen.add(s)
                    fresh.append(x)
            if len(seen) > 200_000:
                seen.clear()
            chosen = [texts[x] for x in fresh]
            for i, j in pieces(chosen):
                values, text, at = _anchors(chosen[i:j], least, gram)
                if not len(values):
                    continue
                whole, bounds = char_grams(chosen[i:j], gram + 2 * side)
                low = at - side
                inside = (low >= 0) & (low < np.diff(bounds)[text])
                around = np.zeros(len(at), np.uint64)
                around[inside] = whole[bounds[text[inside]] + low[inside]]
                own = pa.array(np.array(fresh)[i:j][text])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("sig").take(own), pa.array(at.astype(np.int32)), pa.array(signed(values)), pa.array(signed(around), mask=~inside)],
                    names=["sig", "at", "anchor", "around"],
                )

    return rows.select("sig", "text").mapInArrow(run, "sig binary, at int, anchor long, around long")


def _windows_at(rows: DataFrame, least: int, gram: int) -> DataFrame:
    """(sig, at, anchor, window): hashes of the windows of ``least`` characters that hold an anchor; rows (sig, text, spots)."""

    def run(batches):
        for batch in batches:
            sigs = batch.column("sig")
            for x, (text, spots) in enumerate(zip(batch.column("text").to_pylist(), batch.column("spots").to_pylist())):
                grams, _ = char_grams([text], least)
                starts, names = [], []
                for spot in spots:
                    low, high = max(spot["at"] - (least - gram), 0), min(spot["at"], len(text) - least)
                    starts.append(np.arange(low, high + 1))
                    names.append(np.full(max(high + 1 - low, 0), spot["anchor"], np.int64))
                at = np.concatenate(starts)
                yield pa.RecordBatch.from_arrays(
                    [sigs.take(pa.array(np.full(len(at), x))), pa.array(at.astype(np.int32)), pa.array(np.concatenate(names)), pa.array(signed(grams[at]))],
                    names=["sig", "at", "anchor", "window"],
                )

    return rows.select("sig", "text", "spots").mapInArrow(run, "sig binary, at int, anchor long, window long")


def _in_two_texts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _lo): keys that stand in more than one text and the least of these, by an aggregation with map-side combine."""
    return rows.groupBy(*keys).agg(F.min("sig").alias("_lo"), F.max("sig").alias("_hi")).filter("_lo <> _hi").select(*keys, "_lo")


def shared_stretches_of_texts(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(sig, f, t): stretches of each text that stand in a different text, found without writing out pairs of texts.

    Every window of ``least`` characters holds an anchor, so only windows around anchors that two texts have can be shared.  An
    anchor whose surroundings, as far as such a window can reach, are equal in two texts is shared with all of them; this
    settles the inside of a repeated passage with one row per text.  Only for anchors near the ends of a passage the windows
    themselves are compared, with those of one text for each kind of surroundings.  A passage in a third of all texts therefore costs rows in proportion to the texts, not to pairs.
    """
    rows = classes(docs).filter(F.length("text") >= least)
    posts = cut_lineage(_anchor_rows(rows, least, gram))
    shared = _in_two_texts(posts, ["anchor"]).select("anchor")
    alike = _in_two_texts(posts.filter("around is not null"), ["anchor", "around"])
    marked = cut_lineage(posts.join(small(shared, SENT_ROWS), "anchor").join(small(alike, SENT_ROWS), ["anchor", "around"], "left").select("sig", "at", "anchor", "_lo"))
    side = least - gram
    whole = marked.filter("_lo is not null").select("sig", (F.col("at") - side).alias("f"), (F.col("at") + least).alias("t"))
    edges = marked.filter("_lo is null")
    # texts of equal surroundings need no comparison, but one of them stands for all where others end earlier
    stand_in = marked.filter("_lo = sig").join(small(edges.select("anchor").distinct(), SENT_ROWS), "anchor", "left_semi")
    spots = edges.select("sig", "at", "anchor").union(stand_in.select("sig", "at", "anchor")).groupBy("sig").agg(F.collect_set(F.struct("at", "anchor")).alias("spots"))
    text = rows.join(small(spots.select("sig"), SENT_ROWS), "sig", "left_semi").groupBy("sig").agg(F.min("text").alias("text"))
    windows = cut_lineage(_windows_at(text.join(spots, "sig"), least, gram))
    met = windows.join(small(_in_two_texts(windows, ["anchor", "window"]).drop("_lo"), SENT_ROWS), ["anchor", "window"])
    return whole.union(met.select("sig", "at", F.col("at") + least)).distinct()


def shared_coverage(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share, stretches, copies): how much of each such document stands elsewhere.

    ``stretches`` counts the separate shared parts, ``copies`` the other documents with the same text, which make the whole
    document shared.
    """
    each = shared_stretches_of_texts(docs, least, gram)
    # merge overlapping stretches of a text in order of their starts
    by = Window.partitionBy("sig").orderBy("f", "t")
    before = F.coalesce(F.max("t").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    gain = F.greatest(F.lit(0), F.col("t") - F.greatest(F.col("f"), before))
    merged = each.withColumn("gain", gain).withColumn("new", F.col("f") > before)
    covered = merged.groupBy("sig").agg(F.sum("gain").alias("covered"), F.count_if("new").alias("parts"))
    member = classes(docs).filter(F.length("text") >= least).select("did", "sig", F.length("text").cast("long").alias("n_chars")).distinct()
    copies = member.groupBy("sig").agg((F.count("*") - 1).alias("copies"))
    out = member.join(copies, "sig").join(covered, "sig", "left").filter("copies > 0 or covered > 0")
    shared = F.when(F.col("copies") > 0, F.col("n_chars")).otherwise(F.col("covered"))
    return out.select(
        F.col("did").alias("doc_id"), "n_chars", shared.cast("long").alias("shared_chars"), F.round(shared / F.col("n_chars"), 6).alias("shared_share"),
        F.when(F.col("copies") > 0, F.lit(1)).otherwise(F.col("parts")).cast("long").alias("stretches"), "copies",
    )
