"""Queries that write tables with the sinks and read them back with the readers, in the session's shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators.lineage import scratch
from ..sources import readers as S
from ..sources import sinks as K
from .registry import query


def _place(df) -> str:
    return scratch(df.sparkSession)


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def jsonl_round_trip(t):
    d = t("supplier").select("s_suppkey", "s_name", "s_nationkey")
    K.write_jsonl(d, path := _place(d), compression="gzip")
    return S.read_jsonl(d.sparkSession, path, d.schema, forbidden="/nowhere/eval", expected=d.count())


@query("""SELECT n_nationkey, n_name, n_name || '/x "y"' AS names FROM nation""")
def csv_round_trip(t):
    d = t("nation").select("n_nationkey", "n_name", F.array("n_name", F.lit('x "y"')).alias("names"))
    K.write_csv(d, path := _place(d), ["n_nationkey", "n_name", "names"], escape='"')
    back = S.read_csv(d.sparkSession, path)
    return back.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.array_join(F.from_json("names", "array<string>"), "/").alias("names"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS a, n_name AS b FROM nation")
def csv_positions(t):
    d = t("nation").select("n_nationkey", "n_name")
    d.write.option("header", False).csv(path := _place(d))
    return S.read_csv(d.sparkSession, path, header=False, columns=["a", "b"])


@query("SELECT s_suppkey, s_nationkey % 3 AS shard FROM supplier WHERE s_nationkey % 3 IN (0, 2)")
def parquet_shards(t):
    d = t("supplier")
    path = _place(d)
    for i in range(3):
        d.filter(F.col("s_nationkey") % 3 == i).select("s_suppkey").write.parquet(f"{path}/shard-{i}.parquet")
    return S.read_shards(d.sparkSession, path + "/shard-{}.parquet", [0, 2]).select("s_suppkey", F.col("shard").cast("long").alias("shard"))


@query("SELECT r_regionkey, r_name FROM region")
def pinned_parquet(t):
    d = t("region").select("r_regionkey", "r_name")
    spark, path = d.sparkSession, _place(d)
    d.coalesce(1).write.parquet(path)
    file = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", F.sha2("content", 256).alias("h")).first()
    return S.pinned(spark, file["path"], file["h"])


@query("SELECT r_regionkey, r_name, 4 AS kinds FROM region")
def any_format(t):
    d = t("region").select("r_regionkey", "r_name")
    spark, path = d.sparkSession, _place(d)
    d.write.parquet(f"{path}/a.parquet")
    d.write.option("header", True).csv(f"{path}/a.csv")
    d.write.json(f"{path}/a.jsonl")
    d.agg(F.to_json(F.struct(F.collect_list(F.struct(*d.columns)).alias("data"))).alias("value")).coalesce(1).write.text(f"{path}/a.json")
    all_ = None
    for kind in ("parquet", "csv", "jsonl", "json"):
        one = S.read_any(spark, f"{path}/a.{kind}").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")
        all_ = one if all_ is None else all_.unionByName(one)
    return all_.groupBy("r_regionkey", "r_name").agg(F.count("*").alias("kinds"))


@query("SELECT trim(sample_id) AS sample_id, 'first' AS dataset_key FROM build_p0a5_data WHERE trim(coalesce(sample_id, '')) <> '' GROUP BY 1")
def id_files(t):
    d = t("build_p0a5_data").filter("sample_id is not null").select(F.concat(F.lit("  "), F.col("sample_id"), F.lit(" ")).alias("value")).distinct()
    spark, path = d.sparkSession, _place(d)
    d.union(spark.createDataFrame([("",), ("   ",)], "value string")).write.text(f"{path}/first_train.txt")
    return S.read_ids(spark, f"{path}/first_train.txt").withColumn("dataset_key", F.lit("first"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS a, CAST(l_linenumber AS VARCHAR) AS b FROM lineitem WHERE l_linenumber <> 3")
def blank_separated(t):
    d = t("lineitem").select(F.when(F.col("l_linenumber") == 3, F.col("l_orderkey").cast("string")).otherwise(F.concat_ws("  \t", F.lit(" "), "l_orderkey", "l_linenumber")).alias("value"))
    d.write.text(path := _place(d))
    return S.read_fields(d.sparkSession, path, ["a", "b"])


@query("SELECT count(*) AS lines FROM nation")
def line_counts(t):
    d = t("nation").select(F.explode(F.array("n_name", F.lit(" "))).alias("value"))
    d.write.text(path := _place(d))
    return d.sparkSession.createDataFrame([(S.line_count(d.sparkSession, path),)], "lines long")


@query("SELECT lang AS class, 'train' AS split, count(*) > 0 AS any FROM documents WHERE lang IN ('en', 'de', 'es', 'zh') GROUP BY 1")
def labelled_listing(t):
    d = t("documents").filter("lang in ('en', 'de', 'es', 'zh')").select("lang", F.col("doc_id").cast("string").alias("value"))
    spark, path = d.sparkSession, _place(d)
    for lang in ("en", "de", "es", "zh"):
        d.filter(F.col("lang") == lang).select("value").write.text(f"{path}/train/{lang}")
    found = S.labelled_files(spark, path, ["split", "class"], "*.txt")
    return found.groupBy("class", "split").agg((F.count("*") > 0).alias("any"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")
def json_array_items(t):
    d = t("documents").filter("trim(text) <> ''").select("doc_id", "text")
    spark, path = d.sparkSession, _place(d)
    # one array a file, whole files only, as a producer would write them
    body = d.withColumn("_p", F.pmod("doc_id", F.lit(4))).groupBy("_p").agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("doc_id", "text"))), ", "), F.lit("]")).alias("value"))
    body.select("value").repartition(4).write.text(path)
    files = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<struct<doc_id: bigint, text: string>>").alias("a"))
    return files.select(F.explode("a").alias("x")).select("x.*")


@query("SELECT p_name AS name, 7 AS objects, 5 AS kept FROM part WHERE p_size > 45")
def annotation_boxes(t):
    d = t("part").filter("p_size > 45").select("p_name")
    box = "<object><name>x</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object>"
    spark, path = d.sparkSession, _place(d)
    d.select(F.concat(F.lit("<annotation><filename>"), F.col("p_name"), F.lit("</filename>" + box * 7 + "</annotation>")).alias("value")).write.text(path)
    # one row a file is read back per annotation; the name comes from the same files as text
    names = spark.read.text(path).select(F.regexp_extract("value", "<filename>(.*?)</filename>", 1).alias("name"))
    boxes = S.read_boxes(spark, path).agg(F.max("objects").cast("long").alias("objects"), F.max(F.size("kept")).cast("long").alias("kept"), F.count("*").alias("n"))
    return names.crossJoin(F.broadcast(boxes)).select("name", "objects", "kept")


@query("SELECT 'orders/train/' || o_orderkey AS sample_id, o_totalprice FROM orders WHERE o_orderkey % 5 = 0")
def nth_records(t):
    o = t("orders").select(F.lit("orders").alias("dataset"), F.lit("train").alias("split"), F.col("o_orderkey").alias("ordinal"), "o_totalprice")
    ids = t("orders").filter("o_orderkey % 5 = 0").select(F.concat(F.lit("orders/train/"), F.col("o_orderkey").cast("string")).alias("sample_id"))
    return S.nth_record(ids, o).select("sample_id", "o_totalprice")


@query("SELECT 'n/' || n_nationkey AS sample_id, n_name AS name FROM nation UNION ALL SELECT 'r/' || r_regionkey, r_name FROM region")
def loaders_by_prefix(t):
    number = F.substring_index("sample_id", "/", -1).cast("long")
    load = lambda table, key, name: lambda spark, ids: ids.join(t(table), number == F.col(key)).select("sample_id", F.col(name).alias("name"))
    keyed = lambda table, key, p: t(table).select(F.concat(F.lit(p), F.col(key).cast("string")).alias("sample_id"))
    ids = keyed("nation", "n_nationkey", "n/").unionByName(keyed("region", "r_regionkey", "r/"))
    return S.by_prefix(ids.sparkSession, ids, {"n": load("nation", "n_nationkey", "n_name"), "r": load("region", "r_regionkey", "r_name")})


@query("SELECT p_partkey AS stem, CASE WHEN p_size > 10 THEN 'b' ELSE 'a' END AS note_class FROM part")
def asset_pairs(t):
    p = t("part").select(F.col("p_partkey").alias("stem"), F.expr("if(p_size > 10, 'b', 'a')").alias("class"))
    notes = p.select("stem", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("class")).withColumn("path", F.concat_ws("/", "class", "stem"))
    return S.paired_assets(p.withColumn("path", F.concat(F.lit("i/"), F.col("stem").cast("string"))), notes).select("stem", "note_class")


@query("SELECT p_partkey, p_size * 10 AS total_kb, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 6 END AS available_kb FROM part")
def memory_texts(t):
    head = F.concat(F.lit("MemTotal:   "), (F.col("p_size") * 10).cast("string"), F.lit(" kB\nMemFree: 1 kB\nBuffers: 2 kB\nCached: 3 kB\n"))
    text = F.concat(head, F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("MemAvailable: "), F.col("p_size").cast("string"), F.lit(" kB\n"))).otherwise(F.lit("")))
    return t("part").select("p_partkey", S.parse_meminfo(text).alias("m")).select("p_partkey", "m.total_kb", "m.available_kb")


@query("SELECT user_id, event_id, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000.0, 3) AS elapsed_ms FROM events WHERE event_type = 'purchase'")
def sample_files(t):
    e = t("events").filter("event_type = 'purchase'").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    K.write_samples(e, path := _place(e), "user_id", "ts")
    back = S.read_csv(e.sparkSession, path)
    return back.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), F.round(F.col("elapsed_ms").cast("double"), 3).alias("elapsed_ms"))


@query("SELECT lang, source, count(*) AS ids FROM documents WHERE lang IN ('en', 'zh') AND source IS NOT NULL GROUP BY 1, 2")
def split_files(t):
    d = t("documents").filter("lang in ('en', 'zh') and source is not null").select("lang", "source", "doc_id")
    spark, path = d.sparkSession, _place(d)
    sums = K.write_splits(d, path, "lang", "source", "doc_id")
    back = spark.read.text(path).groupBy("lang", "source").agg(F.count("*").alias("ids"))
    return back.join(sums.select("lang", "source", F.col("ids").alias("_n")), ["lang", "source"]).filter("ids = _n").drop("_n")


@query("SELECT r_regionkey, r_name FROM region")
def sealed_table(t):
    d = t("region").select("r_regionkey", "r_name")
    K.write_sealed(d, path := _place(d))
    return d.sparkSession.read.parquet(path)


@query("SELECT n_nationkey FROM nation UNION ALL SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def appended_log(t):
    d = t("nation").select("n_nationkey")
    K.append(d, path := _place(d))
    K.append(t("nation").filter("n_regionkey = 1").select("n_nationkey"), path)
    return d.sparkSession.read.parquet(path)


@query("SELECT n_name AS record FROM nation")
def text_corpus(t):
    d = t("nation").select("n_name")
    K.write_text(d, path := _place(d), "n_name")
    return d.sparkSession.read.option("lineSep", "\n\n").text(path).select(F.col("value").alias("record"))


@query("SELECT r_regionkey AS k, r_name AS v, 5 AS rows FROM region")
def inserted_table(t):
    d = t("region").select(F.col("r_name").alias("v"), F.col("r_regionkey").alias("k"))
    spark, name = d.sparkSession, "loom_" + _place(d).rsplit("/", 1)[-1]
    K.create_tables(spark, {name: "k bigint, v string"}, _place(d))
    n = K.insert_into(d, name)
    return spark.table(name).withColumn("rows", F.lit(n))


@query("SELECT c_custkey, sha256(concat_ws(chr(1), CAST(c_custkey AS VARCHAR), coalesce(c_name, '\\N'), coalesce(c_mktsegment, '\\N'))) AS digest FROM customer")
def row_digests(t):
    return t("customer").select("c_custkey", H.row_hash(["c_custkey", "c_name", "c_mktsegment"]).alias("digest"))
