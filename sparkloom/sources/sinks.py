"""Writers.  Spark's commit protocol stages files and publishes them at the end, so a failed job leaves no partial result."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    """JSON lines with the keys in order of their names."""
    w = df.select(*sorted(df.columns)).write.mode(mode)
    (w.option("compression", compression) if compression else w).json(path)


def write_document(document: dict, path: str) -> str:
    """A control document, written beside its place and moved there; returns its SHA-256."""
    from hashlib import sha256

    text = json.dumps(document, ensure_ascii=False, indent=2, sort_keys=True)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.part", path)
    return sha256(text.encode()).hexdigest()


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists", escape: str = "\\") -> None:
    """CSV with a fixed header; arrays, maps and structs as JSON text.  read_csv expects quotes escaped by a quote."""
    kinds = dict(df.dtypes)
    nested = lambda c: kinds[c].startswith(("array", "map", "struct"))
    df.select(*[F.to_json(c).alias(c) if nested(c) else F.col(c) for c in columns]).write.mode(mode).option("header", True).option("escape", escape).csv(path)


def write_samples(df: DataFrame, path: str, source: str, time: str) -> None:
    """Samples as CSV with the milliseconds since their source's first."""
    from pyspark.sql import Window

    start = F.min(F.unix_micros(time)).over(Window.partitionBy(source))
    df.withColumn("elapsed_ms", (F.unix_micros(time) - start) / F.lit(1000.0)).drop(time).write.option("header", True).option("escape", '"').csv(path)


def write_splits(df: DataFrame, path: str, dataset: str, split: str, key: str) -> DataFrame:
    """One text folder per dataset and split with an id per line, and (dataset, split, ids, checksum) as the result."""
    from ..functions.hashing import id_list_hash

    df.select(dataset, split, F.col(key).cast("string").alias("value")).repartition(dataset, split).sortWithinPartitions("value").write.mode("errorifexists").partitionBy(dataset, split).text(path)
    return id_list_hash(df, [dataset, split], key)


def write_sealed(df: DataFrame, path: str) -> None:
    """Parquet that may not exist yet; the result is marked read-only where the file system allows."""
    df.write.mode("errorifexists").parquet(path)
    # by the file system of the path, so a shared store is sealed too where it knows permissions
    spark = df.sparkSession
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    read_only = jvm.org.apache.hadoop.fs.permission.FsPermission("440")
    for status in fs.listStatus(root):
        if status.isFile():
            fs.setPermission(status.getPath(), read_only)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_text(df: DataFrame, path: str, column: str) -> None:
    """Plain text, records separated by a blank line."""
    df.select(F.col(column).cast("string").alias("value")).write.option("lineSep", "\n\n").mode("errorifexists").text(path)


def create_tables(spark, ddl: dict[str, str], location: str | None = None) -> None:
    """Tables by name and column list; those that exist stay."""
    for name, columns in ddl.items():
        place = f" LOCATION '{location}/{name}'" if location else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{place}")


def insert_into(df: DataFrame, table: str) -> int:
    """Append rows to a table by column name; returns the table's rows after that."""
    spark = df.sparkSession
    df.select(*spark.table(table).columns).write.insertInto(table)
    return spark.table(table).count()
