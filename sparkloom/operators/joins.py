"""Joins by identity: audits of two record sets, exclusion lists, resume, and n-gram overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: A side is broadcast by hint only below this many rows, counted first; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: And only if these rows are not larger than this.
BROADCAST_BYTES = 64 << 20


def _bytes(df: DataFrame) -> Column:
    """About the size of a row: text and bytes as they are, list entries and other values with 16 bytes."""
    def one(name: str, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.octet_length(name)
        return F.size(name) * 16 if kind.startswith(("array", "map")) else F.lit(16)

    return sum((F.coalesce(one(f"`{c}`", k), F.lit(0)) for c, k in df.dtypes), F.lit(0))


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows of together at most ``most`` bytes (counted, up to the limit)."""
    n, size = df.select(_bytes(df).cast("long").alias("b")).limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return F.broadcast(df) if n <= limit and size <= most else df


def match_audit(left: DataFrame, right: DataFrame, key: str, compare: list[str] = ()) -> DataFrame:
    """One row: matched, only_left, only_right, and for each compared column how many matched rows differ (null-safe)."""
    a, b = left.alias("a"), right.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    has_a, has_b = F.col(f"a.{key}").isNotNull(), F.col(f"b.{key}").isNotNull()
    return both.agg(
        F.count_if(has_a & has_b).alias("matched"), F.count_if(has_a & ~has_b).alias("only_left"), F.count_if(~has_a & has_b).alias("only_right"),
        *[F.count_if(has_a & has_b & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(f"{c}_differs") for c in compare],
    )


def strict_inner(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that raises when a key stands on one side only."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    both = a.join(b, key, "full_outer")
    bad = F.col("_l").isNull() | F.col("_r").isNull()
    return both.filter(F.when(bad, F.raise_error(F.concat(F.lit("unmatched key "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).drop("_l", "_r")


def exclude(df: DataFrame, seen: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not in ``seen``; null keys stay."""
    return df.join(seen.select(*on).distinct(), on, "left_anti")


def exclude_by(df: DataFrame, seen: DataFrame, identity, mine: str, theirs: str) -> DataFrame:
    """Rows whose text has no equal, under an identity function of Columns, among the texts of ``seen``."""
    other = seen.select(identity(F.col(theirs)).alias("_i")).filter("_i is not null").distinct()
    return df.withColumn("_i", identity(F.col(mine))).join(other, "_i", "left_anti").drop("_i")


def flag_seen(df: DataFrame, seen: DataFrame, on: list[str], flag: str = "seen") -> DataFrame:
    known = seen.select(*on).distinct().withColumn(flag, F.lit(True))
    return df.join(known, on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def in_given_order(ids: DataFrame, records: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Records of the listed ids in the order of the list; ids without a record have nulls."""
    return ids.join(records, key, "left").orderBy(ordinal)


def zipped(left: DataFrame, right: DataFrame, ordinal: str, key: str) -> DataFrame:
    """Rows of two tables at the same place, whose keys must agree; an error names the first places where they do not.

    A place that only one of the tables has is an error too.
    """
    a, b = left.withColumn("_l", F.col(key)), right.withColumnRenamed(key, "_r")
    both = a.join(b, ordinal, "full_outer")
    bad = ~F.col("_l").eqNullSafe(F.col("_r"))
    told = F.raise_error(F.concat(F.lit("different keys at "), F.col(ordinal).cast("string"))).cast("boolean")
    return both.filter(F.when(bad, told).otherwise(True)).drop("_l", "_r")


def override(trace: DataFrame, manifest: DataFrame, key: str, prefer_left: list[str] = ()) -> DataFrame:
    """Inner join where the manifest's columns win, but for ``prefer_left``, which take the trace's value if it has one."""
    t, m = trace.alias("t"), manifest.alias("m")
    both = set(trace.columns) & set(manifest.columns) - {key}
    cols = [F.col(f"t.{key}")]
    for c in dict.fromkeys([*trace.columns, *manifest.columns]):
        if c == key:
            continue
        if c in both:
            first, second = (f"t.{c}", f"m.{c}") if c in prefer_left else (f"m.{c}", f"t.{c}")
            cols.append(F.coalesce(first, second).alias(c))
        else:
            cols.append(F.col(f"t.{c}" if c in trace.columns else f"m.{c}"))
    return t.join(m, F.col(f"t.{key}") == F.col(f"m.{key}")).select(*cols)


def pairing(left: DataFrame, right: DataFrame, key: str, prefer: Column | None = None) -> DataFrame:
    """(key, state): paired, left_only or right_only for the distinct keys of two inventories."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    state = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("paired")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def hits_and_misses(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Requests with their cached result, and requests to compute."""
    return requests.join(cache, key), requests.join(cache.select(key), key, "left_anti")


def reusable(requests: DataFrame, accepted: DataFrame, key: str, hashes: list[str]) -> DataFrame:
    """Requests whose accepted row still has the same value in every hash column."""
    r, a = requests.alias("r"), accepted.alias("a")
    same = F.col(f"r.{key}") == F.col(f"a.{key}")
    for h in hashes:
        same &= F.col(f"r.{h}") == F.col(f"a.{h}")
    return r.join(a, same, "left_semi")


def pending(requests: DataFrame, done: DataFrame, key: str, accepted: Column | None = None) -> DataFrame:
    """Requests not done yet, or not accepted yet when ``accepted`` is given."""
    return requests.join((done.filter(accepted) if accepted is not None else done).select(key), key, "left_anti")


def gram_overlap(docs: DataFrame, refs: DataFrame, doc: str, ref: str, text: str, n: int = 4) -> DataFrame:
    """(doc, ref, common, doc_grams, ref_grams, jaccard, containment) for all pairs with a common n-gram, by an inverted join.

    Grams are joined by 64-bit hash.  Sizes travel with the grams, so there is one shuffle for the join and one for the count.
    Grams that references do not have are dropped on the map side when the reference grams are few enough to be sent.
    """

    def exploded(df: DataFrame, key: str, size: str) -> DataFrame:
        # tokens and grams are columns of their own: inside a lambda they would be computed again for every element
        staged = df.select(key, T.word_tokens(F.col(text)).alias("_t")).select(key, T.grams(F.col("_t"), n).alias("_g"))
        # the size is taken before the explode, which would else carry the whole list along with every entry
        sized = staged.select(key, F.size("_g").alias(size), "_g")
        # explode would infer a filter on the list and push it into the scan, where the lambda holds the tokeniser itself
        each = sized.select(key, size, F.explode_outer("_g").alias("_x")).filter("_x is not null")
        return each.select(key, size, F.xxhash64("_x").alias("_x"))

    pairs = exploded(docs, doc, "doc_grams").join(small(exploded(refs, ref, "ref_grams")), "_x").groupBy(doc, ref, "doc_grams", "ref_grams").agg(F.count("*").alias("common"))
    return pairs.select(
        doc, ref, "common", "doc_grams", "ref_grams", (F.col("common") / (F.col("doc_grams") + F.col("ref_grams") - F.col("common"))).alias("jaccard"),
        (F.col("common") / F.col("ref_grams")).alias("containment"),
    )


def without_near(docs: DataFrame, refs: DataFrame, doc: str, ref: str, text: str, threshold: float = 0.45, measure: str = "jaccard", n: int = 4) -> DataFrame:
    """Documents without a reference of at least the given gram overlap."""
    near = gram_overlap(docs, refs, doc, ref, text, n).filter(F.col(measure) >= threshold).select(doc).distinct()
    return docs.join(near, doc, "left_anti")
