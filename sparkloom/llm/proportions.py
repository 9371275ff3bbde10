"""Problem 1: a sample whose categories have target shares, with a minimum from each.

Method: swap repair on category signatures.  Records are grouped by the set of categories their labels map to; a signature
decides the category a record belongs to.  The only thing on the driver is one count per signature (at most 2**c for c
categories, checked).  A random sample that keeps the minima is drawn as counts, then counts are exchanged between signatures
of over- and under-represented categories while that lowers the deviation from the targets, and between signatures of one
category while that lowers the deviation from their own shares; the final counts are materialised as the records with the
smallest salted hashes of each signature.  A category whose records are all in the repaired sample and that is still below
its need is reported as short.

Defined results: rows that are not verified, have a null flag, or no mapped label are not usable; null labels and null arrays
are ignored; labels compare without outer blanks and letter case; a record counts once, with its latest version; with no
usable rows the sample is empty and every category that asks for rows is reported.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import salted_hash, take_smallest_per_group
from .common import cut_lineage, latest_rows

MAX_LABELS = 20_000
MAX_SIGNATURES = 100_000


def _rows_within(df: DataFrame, limit: int, what: str):
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it is meant to be a small control table")
    return rows


def with_signature(data: DataFrame, labels: DataFrame, targets: DataFrame) -> DataFrame:
    """rid, signature (sorted categories by priority, joined by '|') and category of each usable record."""
    known = {r["category"]: (r["priority"], r["category"]) for r in _rows_within(targets.filter("category is not null"), MAX_LABELS, "category_target")}
    maps: dict[str, dict[str, set[str]]] = {"domain": {}, "task_type": {}}
    for r in _rows_within(labels, MAX_LABELS, "category_label"):
        if r["label"] is not None and r["category"] in known and r["label_kind"] in maps:
            maps[r["label_kind"]].setdefault(r["label"].strip(" ").lower(), set()).add(r["category"])

    def mapped(entries: Column, kind: str) -> Column:
        pairs = [x for k, v in sorted(maps[kind].items()) for x in (F.lit(k), F.array(*[F.lit(c) for c in sorted(v)]))]
        if not pairs:
            return F.array().cast("array<string>")
        table = F.create_map(*pairs)
        found = F.transform(entries, lambda e: F.try_element_at(table, F.lower(F.trim(e))))
        return F.coalesce(F.flatten(F.filter(found, lambda x: x.isNotNull())), F.array().cast("array<string>"))

    slim = data.select(
        F.col("sample_id").alias("rid"), F.col("created_ts").alias("_ts"), "human_verified", "domain", F.col("task_type.major").alias("major")
    ).filter("rid is not null")
    slim = latest_rows(slim, "rid", "_ts", ["human_verified", "domain", "major"]).filter("human_verified")
    if not known:
        return slim.select("rid", F.lit("").alias("signature"), F.lit("").alias("category")).filter("false")
    ordered = sorted(known, key=lambda c: (known[c][0] is None, known[c]))
    has = F.array_union(mapped(F.col("domain"), "domain"), mapped(F.col("major"), "task_type"))
    # the categories in order of priority, so the first of a signature is the record's own
    sign = F.filter(F.array(*[F.when(F.array_contains("_has", c), F.lit(c)) for c in ordered]), lambda x: x.isNotNull())
    return (
        slim.withColumn("_has", has).withColumn("_sign", sign).filter(F.size("_sign") > 0)
        .select("rid", F.array_join("_sign", "|").alias("signature"), F.get("_sign", F.lit(0)).alias("category"))
        .distinct()
    )


def swap_repair(
    sizes: dict[tuple[str, str], int], goals: dict[str, float], floors: dict[str, int], n: int, seed: int
) -> tuple[dict[tuple[str, str], int], dict[str, int]]:
    """(counts per (signature, category) of a sample of n records, records per category that could still be exchanged in).

    The floors are kept, and no exchange of records lowers the deviation from the goals.  Which signatures of a category give
    and take is a goal of its own: each should have the share of its category that it has among all usable records, so records
    of one signature do not stand in for the others; exchanges inside a category go on until that deviation is least too.
    """
    rng = np.random.default_rng(seed)
    keys = sorted(sizes)
    have = np.array([sizes[k] for k in keys], np.int64)
    take = np.zeros(len(keys), np.int64)
    cats = sorted({c for _, c in keys})
    where = {c: np.array([i for i, k in enumerate(keys) if k[1] == c], np.int64) for c in cats}

    def draw(ids, count: int) -> None:
        # multivariate hypergeometric, one signature after another, in exact integers of any size
        left = int(sum(have[i] - take[i] for i in ids))
        count = min(count, left)
        for i in ids:
            room = int(have[i] - take[i])
            if left <= 0:
                break
            if left < 10**9:
                got = int(rng.hypergeometric(room, left - room, count)) if count else 0
            else:
                got = min(room, count, max(count - (left - room), round(count * room / left)))
            take[i] += got
            count -= got
            left -= room

    def settle(c: str, count: int) -> None:
        """The signatures of a category at ``count`` records, as near to their shares as whole records allow."""
        ids = where[c]
        total = int(have[ids].sum())
        exact = [int(have[i]) * count for i in ids]
        take[ids] = [x // total if total else 0 for x in exact]
        left = count - int(take[ids].sum())
        for j in sorted(range(len(ids)), key=lambda j: (-(exact[j] % total), keys[ids[j]]))[:left] if left else ():
            take[ids[j]] += 1

    for c in cats:
        draw(where[c], min(floors.get(c, 0), n - int(take.sum())))
    draw(list(range(len(keys))), n - int(take.sum()))
    now = {c: int(take[where[c]].sum()) for c in cats}
    room = {c: int(have[where[c]].sum()) for c in cats}
    # exchange counts from the category most above its goal to the one most below it while the deviation falls
    done = False
    while not done:
        over = sorted((c for c in cats if now[c] > max(goals.get(c, 0), floors.get(c, 0))), key=lambda c: goals.get(c, 0) - now[c])
        under = sorted((c for c in cats if now[c] < min(goals.get(c, 0), room[c])), key=lambda c: now[c] - goals.get(c, 0))
        done = True
        for o, u in ((o, u) for o in over for u in under):
            move = min(now[o] - max(goals.get(o, 0), floors.get(o, 0)), goals.get(u, 0) - now[u])
            move = min(max(int(move), 1), room[u] - now[u], now[o] - floors.get(o, 0))
            change = abs(now[o] - move - goals.get(o, 0)) + abs(now[u] + move - goals.get(u, 0))
            if move > 0 and change < abs(now[o] - goals.get(o, 0)) + abs(now[u] - goals.get(u, 0)) - 1e-9:
                now[o], now[u], done = now[o] - move, now[u] + move, False
                break
    for c in cats:
        settle(c, now[c])
    return {k: int(t) for k, t in zip(keys, take)}, {c: int((have[where[c]] - take[where[c]]).sum()) for c in cats}


def plan(data: DataFrame, labels: DataFrame, targets: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(usable records with signature, quota per signature, report per category)."""
    spark = data.sparkSession
    usable = cut_lineage(with_signature(data, labels, targets))
    sizes = {(r["signature"], r["category"]): r["n"] for r in _rows_within(usable.groupBy("signature", "category").agg(F.count("*").alias("n")), MAX_SIGNATURES, "the list of signatures")}
    asked = {r["category"]: (r["target_permille"] or 0, r["min_rows"] or 0) for r in targets.filter("category is not null").collect()}
    n = sum(sizes.values()) // 2
    goals = {c: p * n / 1000 for c, (p, _) in asked.items()}
    by: dict[str, int] = dict.fromkeys(asked, 0)
    for (_, c), k in sizes.items():
        by[c] += k
    floors = {c: min(m, by[c]) for c, (_, m) in asked.items()}
    chosen, spare = swap_repair(sizes, goals, floors, n, seed) if n else ({}, {})
    drawn: dict[str, int] = dict.fromkeys(asked, 0)
    for (_, c), k in chosen.items():
        drawn[c] += k
    need = {c: max(m, -(-p * n // 1000)) for c, (p, m) in asked.items()}
    # short: below its need with every record exchanged in; goals beyond the sample size leave records that no category can give up
    beyond = sum(need.values()) > n + len(need)
    short = {c: drawn[c] < need[c] and (not spare.get(c, 0) or beyond and drawn[c] + spare[c] < need[c]) for c in asked}
    quota = spark.createDataFrame([(s, k) for (s, _), k in chosen.items() if k], "signature string, quota long")
    report = spark.createDataFrame(
        [(c, p, m, n, by[c], need[c], drawn[c], round(1000 * drawn[c] / n, 6) if n else 0.0, short[c]) for c, (p, m) in sorted(asked.items())],
        "category string, target_permille int, min_rows int, sample_size long, usable_rows long, needed_rows long, "
        "sample_rows long, actual_permille double, short boolean",
    )
    return usable, quota, report


def proportional_sample(data: DataFrame, labels: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """(sample_id, signature, category) of the sample."""
    usable, quota, _ = plan(data, labels, targets, seed)
    hashed = usable.withColumn("_h", salted_hash(f"proportions-{seed}", "rid"))
    taken = take_smallest_per_group(hashed, quota, ["signature"], "_h", "rid")
    return taken.select(F.col("rid").alias("sample_id"), "signature", "category")


def proportion_report(data: DataFrame, labels: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    return plan(data, labels, targets, seed)[2]
