"""Readers: record files by format, listings of files as tables, control files."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | StructType, forbidden: str | None = None, expected: int | None = None) -> DataFrame:
    """One JSON object per line (plain or gzip); blank lines are skipped, anything else that is no object raises, and so
    does a number of rows that is not the expected one."""
    paths = [path] if isinstance(path, str) else path
    if forbidden:
        refuse_below(paths, forbidden)
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    if expected is not None and (n := df.count()) != expected:
        raise ValueError(f"{n} rows instead of {expected}")
    return df


def refuse_below(paths: list[str], folder: str) -> None:
    """Raises for a path inside a folder that must not be opened (after resolving links and ..)."""
    root = os.path.realpath(folder)
    for p in paths:
        real = os.path.realpath(p)
        if real == root or real.startswith(root + os.sep):
            raise PermissionError(f"{p} lies below {folder}")


def stem() -> Column:
    """Name of the row's file without its extension."""
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def read_csv(spark: SparkSession, path: str | list[str], header: bool = True, columns: list[str] | None = None, subject: str | None = None) -> DataFrame:
    """CSV with or without header.  ``columns`` names positions; rows with fewer are dropped.  ``subject`` adds the file stem.

    A byte order mark before the first name is removed.
    """
    reader = spark.read.option("header", header).option("multiLine", True).option("escape", '"')
    if columns and not header:
        raw = reader.schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
        df = raw.filter(F.col(columns[-1]).isNotNull())
    else:
        df = reader.csv(path)
        df = df.toDF(*[c.lstrip("﻿") for c in df.columns]) if df.columns and df.columns[0].startswith("﻿") else df
    return df.withColumn(subject, stem()) if subject else df


def numbered(df: DataFrame, group: str, order: list[str], prefix: Column, name: str = "sample_id") -> DataFrame:
    """An id of prefix and the row's number in its group; the order must be explicit and total."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return df.withColumn(name, F.concat_ws("/", prefix, n.cast("string")))


def read_any(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """Parquet, CSV, JSON lines, or a JSON document that is a list or holds one under ``data``; by suffix."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return read_csv(spark, path)
    if kind in ("jsonl", "gz"):
        return read_jsonl(spark, path, schema) if schema else spark.read.option("mode", "FAILFAST").json(path)
    if kind == "json":
        df = spark.read.option("multiLine", True).json(path)
        return df.select(F.explode("data").alias("_d")).select("_d.*") if df.columns == ["data"] else df
    if kind == "orc":
        return spark.read.orc(path)
    raise ValueError(f"unknown kind of file: {path}")


def pinned(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """A Parquet file whose content must have the given digest."""
    got = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    if got != sha256:
        raise ValueError(f"{path} has digest {got}")
    return spark.read.parquet(path)


def split_files(spark: SparkSession, folder: str, split: str) -> list[str]:
    """Files of a split in one of three layouts: folder/split/*, folder/*_split.*, folder/*/split.*; never a test file.

    The listing is that of the folder's own file system, so a shared store works like a local disk.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.makeQualified(root).toString().rstrip("/")
    each, found = fs.listFiles(root, True), []
    while each.hasNext():
        inside = each.next().getPath().toString()[len(top) + 1 :]
        *folders, file = inside.split("/")
        name = os.path.splitext(file)[0].lower()
        last = folders[-1].lower() if folders else os.path.basename(os.path.normpath(folder)).lower()
        if (last == split or name == split or name.endswith(f"_{split}")) and (split == "test" or "test" not in inside.lower()):
            found.append(f"{folder.rstrip('/')}/{inside}")
    return sorted(found)


def read_ids(spark: SparkSession, path: str | list[str], key_pattern: str | None = None) -> DataFrame:
    """(sample_id[, dataset_key]) from text files with an id per line; the key comes from the file name by a pattern."""
    df = spark.read.text(path)
    ids = df.select(F.trim("value").alias("sample_id"), *([F.regexp_extract(F.col("_metadata.file_name"), key_pattern, 1).alias("dataset_key")] if key_pattern else []))
    return ids.filter("sample_id <> ''")


def read_fields(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Blank-separated text lines as columns; lines with fewer fields are skipped."""
    parts = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    return spark.read.text(path).filter(F.size(parts) >= len(names)).select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_shards(spark: SparkSession, pattern: str, shards: list[int] | None = None) -> DataFrame:
    """Parquet shards of a pattern with {} for the number; all that exist (``*``) or the listed ones, with the number in ``shard``."""
    paths = [pattern.format("*")] if shards is None else [pattern.format(n) for n in shards]
    lead, _, tail = pattern.rsplit("/", 1)[-1].partition("{}")
    number = F.regexp_extract(F.col("_metadata.file_path"), re.escape(lead) + r"(\d+)" + re.escape(tail), 1).try_cast("int")
    return spark.read.parquet(*paths).withColumn("shard", number)


def labelled_files(spark: SparkSession, folder: str, levels: list[str], pattern: str = "*") -> DataFrame:
    """A listing whose last folder levels are columns, such as split and class; files at a lesser depth have nulls."""
    df = listing(spark, folder, pattern)
    inside = F.split(F.regexp_replace(F.col("path"), "^.*?" + re.escape("/" + os.path.basename(os.path.normpath(folder)) + "/"), ""), "/")
    at = lambda i: F.when(F.size(inside) == len(levels) + 1, F.get(inside, F.lit(i)))
    return df.withColumns({n: at(i) for i, n in enumerate(levels)})


def line_count(spark: SparkSession, path: str | list[str]) -> int:
    return spark.read.text(path).filter(F.trim("value") != "").count()


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, extension, parent, size, modified) of all files below a folder; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return df.select(
        "path", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("extension"), F.element_at(F.split("path", "/"), -2).alias("parent"),
        F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
    )


def read_boxes(spark: SparkSession, path: str, first: int = 5) -> DataFrame:
    """(name, objects, kept) from annotation XML: number of objects and the first of them with their boxes."""
    schema = "object array<struct<name: string, bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>"
    df = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(path)
    return df.select(F.input_file_name().alias("path"), F.coalesce(F.size("object"), F.lit(0)).alias("objects"), F.slice("object", 1, first).alias("kept"))


def nth_record(ids: DataFrame, records: DataFrame, id_column: str = "sample_id") -> DataFrame:
    """Records looked up by an id of the form dataset/split/number; ``records`` has dataset, split, ordinal."""
    part = F.split(id_column, "/")
    keyed = ids.select(id_column, F.get(part, F.lit(0)).alias("dataset"), F.get(part, F.lit(1)).alias("split"), F.get(part, F.lit(2)).try_cast("long").alias("ordinal"))
    return keyed.join(records, ["dataset", "split", "ordinal"], "left")


def by_prefix(spark: SparkSession, ids: DataFrame, loaders: dict[str, object], id_column: str = "sample_id") -> DataFrame:
    """Union of what the loader registered for each id prefix makes of its ids; an unknown prefix raises."""
    prefix = F.get(F.split(id_column, "/"), F.lit(0))
    # one prefix more than there are loaders has an unknown one among them
    known = [r[0] for r in ids.select(prefix.alias("p")).distinct().limit(len(loaders) + 1).collect()]
    lost = [p for p in known if p not in loaders]
    if lost:
        raise KeyError(f"no loader for {lost}")
    out = None
    for p in sorted(known):
        one = loaders[p](spark, ids.filter(prefix == p))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def paired_assets(images: DataFrame, notes: DataFrame) -> DataFrame:
    """Images and annotations of one stem; among several, one of the same class first, then by path.  Columns stem, class, path."""
    from pyspark.sql import Window

    both = images.select("stem", F.col("class").alias("image_class"), F.col("path").alias("image")).join(notes.select("stem", F.col("class").alias("note_class"), F.col("path").alias("note")), "stem")
    rank = F.row_number().over(Window.partitionBy("image").orderBy((F.col("image_class") != F.col("note_class")), "note"))
    return both.withColumn("_r", rank).filter("_r = 1").drop("_r")


def parse_meminfo(c: Column) -> Column:
    """struct(total_kb, available_kb): available falls back to free + buffers + cached."""
    kb = lambda n: F.regexp_extract(c, rf"(?m)^{n}:\s+(\d+)", 1).try_cast("long")
    rest = F.coalesce(kb("MemFree"), F.lit(0)) + F.coalesce(kb("Buffers"), F.lit(0)) + F.coalesce(kb("Cached"), F.lit(0))
    return F.struct(kb("MemTotal").alias("total_kb"), F.coalesce(kb("MemAvailable"), rest).alias("available_kb"))


def config(path: str) -> dict:
    """A small JSON or YAML control file on the driver."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yml", ".yaml")):
            import yaml

            return yaml.safe_load(f)
        return json.load(f)


def read_sql_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database with the PostgreSQL protocol (its driver must be on the class path)."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def json_array_items(read, size: int = 1 << 20) -> Iterator[dict]:
    """Objects of a JSON array from ``read(size) -> str``, one at a time; an array that ends early raises."""
    decoder, buffer, begun = json.JSONDecoder(), "", False
    while True:
        chunk = read(size)
        buffer += chunk
        while True:
            buffer = buffer.lstrip()
            if not begun:
                if not buffer:
                    break
                if buffer[0] != "[":
                    raise ValueError("not a JSON array")
                buffer, begun = buffer[1:], True
                continue
            buffer = buffer.lstrip(", \t\r\n")
            if buffer.startswith("]"):
                return
            try:
                item, end = decoder.raw_decode(buffer)
            except ValueError:
                break
            if end == len(buffer) and chunk and not isinstance(item, (dict, list)):
                break
            yield item
            buffer = buffer[end:]
        if not chunk:
            raise ValueError("the JSON array ends early")


def array_source():
    """A Python data source ``json_array``: large JSON-array files, read item by item, one task per file.

    Options: path (a file or a folder), item schema by ``.schema(...)``.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class JsonArray(DataSource):
        @classmethod
        def name(cls) -> str:
            return "json_array"

        def schema(self) -> str:
            return "value string"

        def reader(self, schema):
            return Reader(self.options["path"], schema)

    class Reader(DataSourceReader):
        def __init__(self, path, schema):
            self.path, self.names = path, schema.fieldNames()

        def partitions(self):
            files = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(self.path, n) for n in os.listdir(self.path) if n.endswith(".json"))
            return [InputPartition(p) for p in files]

        def read(self, partition):
            with open(partition.value, encoding="utf-8") as f:
                for item in json_array_items(f.read):
                    yield (json.dumps(item, ensure_ascii=False),) if self.names == ["value"] else tuple(item.get(n) for n in self.names)

    return JsonArray
