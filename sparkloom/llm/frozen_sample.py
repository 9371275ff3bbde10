"""Problem 6: a sample that is the same in every run and keeps its members as data arrives.

Method: frozen batch bottom-k.  Every key belongs to the immutable batch in which it first arrived; of each batch exactly
ceil(rate * size) keys with the smallest salted hashes are taken, and the union of the batches is append-only.

What makes a batch immutable is a *ledger*: one row (batch, label, key, chosen) per key that has ever arrived.  ``seal``
takes a delivery and the ledger so far and returns the rows to append: only keys that the ledger does not have are new, they
are put into batches that have never been sealed, and nothing about a sealed batch is computed again.  A delivery may name
the batches of its rows by a label (a load, a day).  New keys under a label that is already sealed (late rows), or under none,
form one further batch of their own.  So every key has a batch, and a chosen key can neither be pushed out by a later row nor
leave because its row is corrected.  A delivery that comes twice adds nothing.

``advance`` keeps the ledger as a table: read, seal, append.  The sample queries seal a whole table as the first delivery.

Defined results: a null or blank key is no record; placeholder digests are no key, the record is then known by its trace id;
a key under several labels of one delivery belongs to the least; repeated rows change nothing; an empty delivery adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_key
from ..operators.sampling import take_smallest_per_group
from .common import SENT_ROWS, cut_lineage, small
from .split_overlap import digest

LEDGER = "batch long, label string, key string, chosen boolean"


def seal(delivery: DataFrame, ledger: DataFrame | None, rate: float, salt: str) -> DataFrame:
    """The ledger rows (batch, label, key, chosen) that a delivery of rows (key, label) adds."""
    named = F.col("label").cast("string")
    first = delivery.filter("key is not null").groupBy(F.col("key").cast("string").alias("key")).agg(F.min(named).alias("label"))
    last = -1
    if ledger is not None:
        known = ledger.groupBy("batch", "label").agg(F.lit(1).alias("_old"))
        last = known.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
        sealed = known.filter("label is not null").select("label", "_old").distinct()
        first = first.join(ledger.select("key"), "key", "left_anti")
        first = first.join(small(sealed, SENT_ROWS), "label", "left").withColumn("label", F.when(F.col("_old").isNull(), F.col("label"))).drop("_old")
    # the first 60 bits of a SHA-256, which any other system can compute too
    first = cut_lineage(first.withColumn("_h", F.conv(F.substr(stable_key(salt, "key"), F.lit(1), F.lit(15)), 16, 10).cast("long")))
    # one row per batch of this delivery, numbered behind the batches of the ledger
    sizes = first.groupBy("label").agg(F.ceil(F.count("*") * F.lit(rate) - F.lit(1e-9)).alias("quota"))
    number = F.row_number().over(Window.orderBy(F.col("label").asc_nulls_first())) + F.lit(last)
    batches = cut_lineage(sizes.withColumn("batch", number.cast("long")))
    placed = first.join(small(batches, SENT_ROWS), first["label"].eqNullSafe(batches["label"])).select("batch", first["label"], "key", "_h")
    chosen = take_smallest_per_group(placed, batches.select("batch", "quota"), ["batch"], "_h", "key", bits=16)
    flag = chosen.select("batch", "key", F.lit(True).alias("chosen"))
    return placed.join(flag, ["batch", "key"], "left").select("batch", "label", "key", F.coalesce("chosen", F.lit(False)).alias("chosen"))


def advance(delivery: DataFrame, path: str, rate: float, salt: str) -> DataFrame:
    """Seal a delivery into the ledger table at ``path`` and return the whole ledger.

    The new rows are computed before the table is appended to; a run that is repeated after a failure finds its keys in the
    ledger and adds nothing.
    """
    spark = delivery.sparkSession
    seal(delivery, read_ledger(spark, path), rate, salt).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at ``path``, cut off from the files that an append will add; None where there is none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(LEDGER).parquet(path)


def trace_delivery(traces: DataFrame) -> DataFrame:
    """(key, label): distinct digests of the traces, or trace ids where there is none, by day of creation."""
    plain = F.when(F.trim("trace_id") != "", F.col("trace_id"))
    return traces.select(F.coalesce(digest(F.col("sample_hash")), plain).alias("key"), F.date_format("created_ts", "yyyy-MM-dd").alias("label"))


def load_delivery(records: DataFrame) -> DataFrame:
    """(key, label): sample ids by load."""
    plain = F.when(F.trim("sample_id") != "", F.col("sample_id"))
    return records.select(plain.alias("key"), F.lpad(F.col("load_batch").cast("string"), 10, "0").alias("label"))


def _sample(delivery: DataFrame, ledger: DataFrame | None, rate: float, salt: str, name: str) -> DataFrame:
    rows = seal(delivery, ledger, rate, salt)
    rows = rows if ledger is None else ledger.select(rows.columns).unionByName(rows)
    return rows.filter("chosen").select(F.col("key").alias(name), "batch")


def trace_sample(traces: DataFrame, ledger: DataFrame | None = None, rate: float = 0.1, salt: str = "frozen") -> DataFrame:
    """(sample_key, batch) of the sample of the traces, with the members that the ledger already has."""
    return _sample(trace_delivery(traces), ledger, rate, salt, "sample_key")


def load_sample(records: DataFrame, ledger: DataFrame | None = None, rate: float = 0.1, salt: str = "frozen") -> DataFrame:
    """(sample_id, batch) of the sample of the loaded records, with the members that the ledger already has."""
    return _sample(load_delivery(records), ledger, rate, salt, "sample_id")
