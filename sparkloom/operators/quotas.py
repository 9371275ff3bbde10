"""Quota arithmetic on small tables of group sizes, and the selections that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import take_smallest_per_group

#: Group tables (one row per category) may come to the driver up to this size.
MAX_GROUPS = 10_000


def group_sizes(df: DataFrame, group: str) -> dict[str, int]:
    rows = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).orderBy(group).limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"{group} has more than {MAX_GROUPS} values")
    return {r[group]: r["n"] for r in rows}


def proportional_floor(sizes: dict[str, int], total: int) -> dict[str, int]:
    """floor(total * size / sum), then one more each in order of the keys until the total is reached."""
    whole = sum(sizes.values())
    out = {k: total * v // whole if whole else 0 for k, v in sizes.items()}
    left = total - sum(out.values())
    while left > 0 and any(out[k] < sizes[k] for k in sizes):
        for k in sorted(sizes):
            if left and out[k] < sizes[k]:
                out[k] += 1
                left -= 1
    return out


def largest_remainder(sizes: dict[str, int], total: int) -> dict[str, int]:
    """Proportional quotas that add up to the total; what is left goes by remainder, size and key, all descending."""
    whole = sum(sizes.values())
    total = min(total, whole)
    out = {k: total * v // whole if whole else 0 for k, v in sizes.items()}
    rest = sorted(sizes, key=lambda k: (total * sizes[k] % whole, sizes[k], k), reverse=True) if whole else []
    left = total - sum(out.values())
    while left > 0:
        for k in rest:
            if left and out[k] < sizes[k]:
                out[k] += 1
                left -= 1
    return out


def equal_shares(keys: list[str], total: int) -> dict[str, int]:
    """total // k each, and one more for the first total % k keys."""
    each, more = divmod(total, len(keys)) if keys else (0, 0)
    return {k: each + (i < more) for i, k in enumerate(keys)}


def take_quotas(df: DataFrame, group: str, quotas: dict[str, int], order: Column, tie: str) -> DataFrame:
    """The quota of each group, smallest ``order`` (a 64-bit hash) first."""
    q = df.sparkSession.createDataFrame(list(quotas.items()), f"{group} string, quota long")
    return take_smallest_per_group(df.withColumn("_o", order), q, [group], "_o", tie).drop("_o")


def scarcest_first(have: dict[str, int], quotas: dict[str, int]) -> list[str]:
    """Groups by rows per row asked for, ascending, then by name: the order in which quotas are filled."""
    return sorted(quotas, key=lambda k: (have.get(k, 0) / quotas[k] if quotas[k] else float("inf"), k))


def require_filled(df: DataFrame, group: str, quotas: dict[str, int]) -> None:
    """Raises when a group has fewer rows than its quota; lists the groups scarcest first."""
    have = group_sizes(df, group)
    short = [k for k in scarcest_first(have, quotas) if have.get(k, 0) < quotas[k]]
    if short:
        raise ValueError("too few rows for " + ", ".join(f"{k} ({have.get(k, 0)} of {quotas[k]})" for k in short))


def balanced_fill(df: DataFrame, group: str, order: list[Column], target: int, floor_share: float) -> DataFrame:
    """A minimum of floor(floor_share * floor(target / groups)) per group, then round robin in group order up to the target."""
    sizes = group_sizes(df, group)
    least = int(floor_share * (target // max(len(sizes), 1)))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    # no group gives more than the target: the filter lets each task keep that many rows per group before the shuffle
    return df.withColumn("_r", rank).filter(F.col("_r") <= target).orderBy(F.col("_r") > least, "_r", group).limit(target).drop("_r")


def greedy_domains(df: DataFrame, domain: str, identity: str, order: Column, total: int) -> DataFrame:
    """Equal quotas filled domain by domain, scarcest first; an identity taken by one domain is gone for the later ones.

    One pass per domain (a short list), each an anti join with what is taken so far, which is written out after each pass.
    """
    from .lineage import cut_lineage

    sizes = group_sizes(df, domain)
    quotas = equal_shares(sorted(sizes), total)
    taken = None
    for d in sorted(sizes, key=lambda k: (sizes[k], k)):
        pool = df.filter(F.col(domain) == d)
        if taken is not None:
            pool = pool.join(taken.select(identity), identity, "left_anti")
        rest = [c for c in df.columns if c != identity]
        one = pool.withColumn("_o", order).groupBy(identity).agg(F.min(F.struct("_o", *rest)).alias("_m")).select(identity, "_m.*")
        mine = one.orderBy("_o", identity).limit(quotas[d]).select(*df.columns)
        taken = cut_lineage(mine if taken is None else taken.unionByName(mine))
    return taken if taken is not None else df.limit(0)


def label_balanced(df: DataFrame, group: str, label: str, key: str, order: Column, held_out: int, train: int) -> DataFrame:
    """Per group and label the first ``held_out`` rows as validation, the next ``train`` as train, the rest as spare.

    ``order`` is a 64-bit hash and ``key`` unique: only the hash cells that hold the first rows of a group are ranked, so a
    group of any size is spread over the tasks.
    """
    keyed = df.withColumn("_o", order)
    sizes = keyed.select(group, label).distinct().withColumn("quota", F.lit(held_out + train))
    first = take_smallest_per_group(keyed.select(group, label, key, "_o").filter(F.col(group).isNotNull() & F.col(label).isNotNull()), sizes, [group, label], "_o", key)
    rank = F.row_number().over(Window.partitionBy(group, label).orderBy("_o", key))  # over the chosen rows only
    roles = first.withColumn("role", F.when(rank <= held_out, "validation").otherwise("train")).select(key, "role")
    return df.join(roles, key, "left").withColumn("role", F.coalesce("role", F.lit("spare")))


def fresh_first(df: DataFrame, group: str, seen: str, order: list[Column], top: int) -> DataFrame:
    """Top rows per group, those not seen before ahead of the others."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col(seen), *order))
    return df.withColumn("_r", rank).filter(F.col("_r") <= top).drop("_r")


def failure_curriculum(df: DataFrame, correct: str, order: list[Column], rule: str = "half") -> DataFrame:
    """All failures, and as many successes as the rule says: ``half`` rounds half to even, ``ceil`` up, ``floor`` down (1 at least)."""
    failed = F.count_if(~F.coalesce(F.col(correct), F.lit(False)))
    count = {"half": F.bround(failed * F.lit(0.5), 0), "ceil": F.ceil(failed / 2), "floor": F.greatest(F.lit(1), F.floor(failed / 2))}[rule]
    want = df.agg(count.cast("int")).first()[0] or 0
    bad = df.filter(~F.coalesce(F.col(correct), F.lit(False))).withColumn("role", F.lit("failure"))
    good = df.filter(correct).orderBy(*order).limit(want).withColumn("role", F.lit("replay"))
    return bad.unionByName(good)


def until_accepted(df: DataFrame, order: list[Column], accept, target: int, batch: int) -> DataFrame:
    """The first ``target`` accepted rows in order, running the costly ``accept`` on rank ranges until there are enough."""
    from .lineage import cut_lineage
    from .windows import global_rank

    ranked = global_rank(df, order, "_r")
    total, done, low, have = ranked.count(), None, 0, 0
    while low < total and have < target:
        # each part is accepted once and written; only its size is asked again
        part = cut_lineage(accept(ranked.filter((F.col("_r") > low) & (F.col("_r") <= low + batch))))
        have += part.count()
        done = part if done is None else done.unionByName(part)
        low += batch
    return (done if done is not None else ranked).orderBy("_r").limit(target).drop("_r")
