import datetime
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import readers as S
from sparkloom.sources import sinks as K
from sparkloom.streaming import outbox as O


def put(path, text, opener=open):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with opener(path, "wt", encoding="utf-8") as f:
        f.write(text)
    return str(path)


def test_jsonl(spark, tmp_path):
    p = put(f"{tmp_path}/a.jsonl", '{"id": "1"}\n\n{"id": "2"}\n')
    z = put(f"{tmp_path}/b.jsonl.gz", '{"id": "3"}\n', gzip.open)
    assert {r["id"] for r in S.read_jsonl(spark, [p, z], "id string").collect()} == {"1", "2", "3"}
    bad = put(f"{tmp_path}/c.jsonl", '{"id": "1"}\nnot json\n')
    with pytest.raises(Exception):
        S.read_jsonl(spark, bad, "id string").collect()
    with pytest.raises(PermissionError):
        S.read_jsonl(spark, f"{tmp_path}/eval/../eval/x.jsonl", "id string", forbidden=f"{tmp_path}/eval")


def test_csv_and_any(spark, tmp_path):
    p = put(f"{tmp_path}/law.csv", "﻿Question,A\n\"one,\n two\",x\nq2,y\n")
    df = S.read_csv(spark, p, subject="subject")
    assert set(df.columns) == {"Question", "A", "subject"} and {r["subject"] for r in df.collect()} == {"law"}
    ids = S.numbered(df, "subject", ["Question"], F.col("subject"))
    assert {r["sample_id"] for r in ids.collect()} == {"law/0", "law/1"}
    h = put(f"{tmp_path}/raw/n.csv", "a,b,c\nshort\nd,e,f\n")
    assert S.read_csv(spark, h, header=False, columns=["x", "y", "z"]).count() == 2
    j = put(f"{tmp_path}/d.json", json.dumps({"data": [{"q": "1"}, {"q": "2"}]}))
    k = put(f"{tmp_path}/e.json", json.dumps([{"q": "1"}]))
    assert S.read_any(spark, j).count() == 2 and S.read_any(spark, k).count() == 1 and S.read_any(spark, p).count() == 2
    spark.range(3).write.parquet(f"{tmp_path}/f.parquet")
    spark.range(3).write.orc(f"{tmp_path}/g.orc")
    assert S.read_any(spark, f"{tmp_path}/f.parquet").count() == S.read_any(spark, f"{tmp_path}/g.orc").count() == 3
    with pytest.raises(ValueError):
        S.read_any(spark, "x.zip")


def test_files_and_ids(spark, tmp_path):
    for n in ("val/a.csv", "b_val.csv", "x/val.jsonl", "val/test_a.csv", "dev/c.csv"):
        put(f"{tmp_path}/{n}", "h\n")
    assert [os.path.relpath(p, tmp_path) for p in S.split_files(spark, str(tmp_path), "val")] == ["b_val.csv", "val/a.csv", "x/val.jsonl"]
    put(f"{tmp_path}/ids/gsm_val.txt", " a/1 \n\nb/2\n")
    got = S.read_ids(spark, f"{tmp_path}/ids/*_val.txt", r"^(.*)_val\.txt$").collect()
    assert {(r["sample_id"], r["dataset_key"]) for r in got} == {("a/1", "gsm"), ("b/2", "gsm")}
    t = put(f"{tmp_path}/obs.txt", "1 2 3\n\n4 5\n 6  7 8 9\n")
    assert [tuple(r) for r in S.read_fields(spark, t, ["a", "b", "c"]).collect()] == [("1", "2", "3"), ("6", "7", "8")] and S.line_count(spark, t) == 3
    names = {(r["name"], r["extension"]) for r in S.listing(spark, f"{tmp_path}/val").collect()}
    assert names == {("a.csv", ".csv"), ("test_a.csv", ".csv")}
    rec = spark.createDataFrame([("a", "v", 0, "zero"), ("a", "v", 1, "one")], "dataset string, split string, ordinal long, t string")
    assert {r["t"] for r in S.nth_record(spark.createDataFrame([("a/v/1",), ("a/v/x",)], "sample_id string"), rec).collect()} == {"one", None}
    ids = spark.createDataFrame([("a/1",), ("b/2",)], "sample_id string")
    both = S.by_prefix(spark, ids, {"a": lambda s, d: d.withColumn("k", F.lit(1)), "b": lambda s, d: d.withColumn("m", F.lit(2))})
    assert {(r["k"], r["m"]) for r in both.collect()} == {(1, None), (None, 2)}
    with pytest.raises(KeyError):
        S.by_prefix(spark, ids, {"a": lambda s, d: d})


def test_an_unknown_prefix_among_many_raises(spark):
    def load(s, d):
        raise AssertionError("loaded although a prefix is unknown")

    ids = spark.range(20_001).select(F.format_string("p%d/x", "id").alias("sample_id"))
    with pytest.raises(KeyError):
        S.by_prefix(spark, ids, {f"p{i}": load for i in range(20_000)})


def test_xml_and_meminfo(spark, tmp_path):
    box = "<object><name>n{0}</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object>"
    p = put(f"{tmp_path}/a.xml", "<annotation>" + "".join(box.format(i) for i in range(7)) + "</annotation>")
    r = S.read_boxes(spark, p).first()
    assert r["objects"] == 7 and len(r["kept"]) == 5 and r["kept"][0]["bndbox"]["ymax"] == 4.0
    df = spark.createDataFrame([("MemTotal: 10 kB\nMemAvailable: 4 kB\n",), ("MemTotal: 10 kB\nMemFree: 1 kB\nBuffers: 2 kB\nCached: 3 kB\n",)], "t string")
    assert [tuple(r[0]) for r in df.select(S.parse_meminfo(F.col("t"))).collect()] == [(10, 4), (10, 6)]
    img = spark.createDataFrame([("s", "x", "i1")], "stem string, class string, path string")
    notes = spark.createDataFrame([("s", "y", "n1"), ("s", "x", "n2")], "stem string, class string, path string")
    assert S.paired_assets(img, notes).first()["note"] == "n2"


def test_json_array(spark, tmp_path):
    doc = json.dumps([{"a": i, "t": "x" * i} for i in range(50)])
    import io

    assert [x["a"] for x in S.json_array_items(io.StringIO(doc).read, 7)] == list(range(50))
    with pytest.raises(ValueError, match="early"):
        list(S.json_array_items(io.StringIO(doc[:-5]).read, 64))
    put(f"{tmp_path}/m/x.json", doc)
    put(f"{tmp_path}/m/y.json", "[]")
    spark.dataSource.register(S.array_source())
    df = spark.read.format("json_array").schema("a int, t string").load(f"{tmp_path}/m")
    assert df.agg(F.sum("a"), F.max(F.length("t"))).first()[:] == (1225, 49)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, ["x", "y"]), ("a", 2, None)], "k string, n int, l array<string>")
    K.write_jsonl(df, f"{tmp_path}/j")
    text = "".join(open(os.path.join(tmp_path, "j", f)).read() for f in sorted(os.listdir(f"{tmp_path}/j")) if f.endswith(".json"))
    assert '{"k":"b","l":["x","y"],"n":1}' in text
    with pytest.raises(Exception):
        K.write_jsonl(df, f"{tmp_path}/j")
    K.write_csv(df, f"{tmp_path}/c", ["n", "l"])
    assert {(r["n"], r["l"]) for r in spark.read.option("header", True).option("escape", "\\").csv(f"{tmp_path}/c").collect()} == {("1", '["x","y"]'), ("2", None)}
    digest = K.write_document({"b": 1, "a": "é"}, f"{tmp_path}/d/doc.json")
    assert json.load(open(f"{tmp_path}/d/doc.json")) == {"a": "é", "b": 1} and len(digest) == 64
    sums = K.write_splits(df.withColumn("d", F.lit("gsm")).withColumn("s", F.lit("val")), f"{tmp_path}/s", "d", "s", "k").first()
    assert sums["ids"] == 2 and os.path.isdir(f"{tmp_path}/s/d=gsm/s=val")
    K.write_sealed(df, f"{tmp_path}/sealed")
    with pytest.raises(Exception):
        K.write_sealed(df, f"{tmp_path}/sealed")
    K.append(df.select("k"), f"{tmp_path}/log")
    K.append(df.select("k"), f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4
    K.write_text(df.coalesce(1), f"{tmp_path}/t", "k")
    body = "".join(open(os.path.join(tmp_path, "t", f)).read() for f in os.listdir(f"{tmp_path}/t") if f.startswith("part"))
    assert body == "b\n\na\n\n"
    K.create_tables(spark, {"t_sink_check": "a STRING, b BIGINT"}, f"{tmp_path}/w")
    assert spark.catalog.tableExists("t_sink_check")
    spark.sql("DROP TABLE t_sink_check")


LOG = [("k1", "pending", 1), ("k1", "pending", 2), ("k2", "pending", 3), ("k1", "sent", 4), ("k1", "pending", 5), ("k2", "sent", 6), ("k3", "sent", 7), ("k3", "pending", 8), (None, "pending", 9)]


def test_outbox_fold(spark):
    df = spark.createDataFrame(LOG, "k string, status string, offset long")
    assert {r["k"] for r in O.pending_fold(df, "k", "status", ["offset"]).collect()} == {"k1", "k3"}
    assert {r["offset"] for r in O.accepted_enqueues(df, "k", "status", ["offset"]).filter("k is not null").collect()} == {1, 3, 5, 8}


def run_stream(spark, tmp_path, rows, schema, build, name):
    folder = f"{tmp_path}/{name}"
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}-cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def test_outbox_stream_equals_fold(spark, tmp_path):
    rows = [r for r in LOG if r[0]]
    got = run_stream(spark, tmp_path, rows, "k string, status string, offset long", lambda s: O.outbox_stream(s, "k", "status"), "outbox_check")
    assert {r["offset"] for r in got} == {1, 3, 5, 8}


def test_breach_stream(spark, tmp_path):
    rows = [("p", b, i) for i, b in enumerate([True, True, False, True, True, True, True, True])]
    got = run_stream(spark, tmp_path, rows, "s string, bad boolean, offset long", lambda s: O.breach_stream(s, "s", "bad", 3), "breach_check")
    assert [r["offset"] for r in got] == [5]


def test_event_windows(spark):
    t0 = datetime.datetime(2026, 1, 1)
    df = spark.createDataFrame([(t0 + datetime.timedelta(minutes=m), "a") for m in (0, 5, 12, 50)], "ts timestamp, g string")
    assert sorted(r["n"] for r in O.windowed_counts(df, "ts", "g", "10 minutes", "1 minute").collect()) == [1, 1, 2]
    assert len(O.windowed_counts(df, "ts", "g", "10 minutes", "1 minute", "5 minutes").collect()) == 6
    assert sorted(r["n"] for r in O.sessions(df, "ts", "g", "10 minutes", "1 minute").collect()) == [1, 3]
