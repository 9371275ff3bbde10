import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import aggregates as A
from sparkloom.operators import decision as D
from sparkloom.operators import dedup, gates, joins, quality, quotas, weights, windows
from sparkloom.plans import pipelines


def test_keep_first_variants(spark):
    rows = [(i, f"t{i % 5}", f"x{i}") for i in range(40)] + [(40, None, "n"), (41, None, "m")]
    df = spark.createDataFrame(rows, "id int, t string, v string").repartition(5)
    want = {0, 1, 2, 3, 4, 40}
    assert {r["id"] for r in dedup.keep_first(df, ["t"], ["id"]).collect()} == want
    assert {r["id"] for r in dedup.keep_first_slim(df, F.coalesce("t", F.lit("")), "id", ["id"]).collect()} == want
    assert {r["id"] for r in dedup.keep_first_slim(df, F.coalesce("t", F.lit("")), "id", ["v", "id"]).collect()} == {0, 1, 12, 13, 14, 41}
    assert {r["id"] for r in dedup.keep_last(df, ["t"], ["id"]).collect()} == {35, 36, 37, 38, 39, 41}
    assert df.limit(0).transform(lambda d: dedup.keep_first(d, ["t"], ["id"])).count() == 0


def test_merge_and_overlay(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, None)], "k int, v string")
    kept, audit = dedup.merge_shards([a, b], "k", ["v"])
    assert {tuple(r) for r in kept.collect()} == {(1, "a"), (2, "b"), (3, None)} and tuple(audit.first()) == (4, 1)
    assert {tuple(r) for r in dedup.overlay(a, b, "k").collect()} == {(1, "a"), (2, "c"), (3, None)}


def test_repeated_units(spark):
    text = "A long unit of text here. ok。ok。A long unit of text here. ok。 a LONG unit  of text here. ok。end"
    df = spark.createDataFrame([(1, text)], "k int, t string")
    assert dedup.repeated_units_removed(df, "k", "t").first()["t"] == "A long unit of text here. ok。ok。end"


def test_joins(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (4, None)], "k int, h string"), spark.createDataFrame([(2, "z"), (3, "w"), (4, None)], "k int, h string")
    assert joins.match_audit(a, b, "k", ["h"]).first().asDict() == {"matched": 2, "only_left": 1, "only_right": 1, "h_differs": 1}
    with pytest.raises(Exception, match="unmatched key"):
        joins.strict_inner(a, b, "k").collect()
    assert joins.strict_inner(a, a.withColumnRenamed("h", "g"), "k").count() == 3
    assert {r["k"] for r in joins.pending(a, b, "k").collect()} == {1}
    hit, miss = joins.hits_and_misses(a, b.withColumnRenamed("h", "r"), "k")
    assert {r["k"] for r in hit.collect()} == {2, 4} and {r["k"] for r in miss.collect()} == {1}
    assert [r["h"] for r in joins.in_given_order(spark.createDataFrame([(4, 1), (1, 2), (9, 3)], "k int, o int"), a, "k", "o").collect()] == [None, "x", None]
    assert {(r["k"], r["h"]) for r in joins.override(a, b, "k", ["h"]).collect()} == {(2, "y"), (4, None)}


def test_gram_overlap_equals_brute_force(spark):
    rng = random.Random(1)
    make = lambda: " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randint(0, 14)))
    docs, refs = [(i, make()) for i in range(30)], [(i, make()) for i in range(10)]

    def grams(t):
        w = t.split()
        return {" ".join(w)} if 0 < len(w) < 3 else {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}

    want = {(d, r, len(grams(x) & grams(y))) for d, x in docs for r, y in refs if grams(x) & grams(y)}
    d, r = spark.createDataFrame(docs, "d int, text string"), spark.createDataFrame(refs, "r int, text string")
    got = {(x["d"], x["r"], x["common"]) for x in joins.gram_overlap(d, r, "d", "r", "text", 3).collect()}
    assert got == want


def test_percentiles_votes_and_advantage(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), float(rng.randrange(9)), i, rng.choice(["x", "y", "", None])) for i in range(101)]
    df = spark.createDataFrame(rows, "g string, v double, i int, a string").repartition(4)
    got = {r["g"]: (r["p50"], r["p95"]) for r in A.floor_percentiles(df, ["g"], "v", [0.5, 0.95]).collect()}
    for g in "ab":
        s = sorted(v for x, v, _, _ in rows if x == g)
        assert got[g] == tuple(s[min(len(s) - 1, int(len(s) * f))] for f in (0.5, 0.95))
        c = Counter(a for x, _, _, a in rows if x == g and a)
        first = {k: min(i for x, _, i, a in rows if x == g and a == k) for k in c}
        top = max(c.values())
        win = min((k for k in c if c[k] == top), key=first.get)
        r = A.majority_vote(df.filter(F.col("g") == g), "g", "i", "a").first()
        assert (r["winner"], r["votes"], r["tied"]) == (win, top, sum(v == top for v in c.values()) > 1)
    flat = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0), ("b", 3.0)], "g string, v double")
    assert sorted((r["g"], r["advantage"]) for r in A.group_advantage(flat, "g", "v").collect()) == [("a", 0.0), ("a", 0.0), ("b", -1.0), ("b", 1.0)]


def test_accuracy_and_retention(spark):
    b = spark.createDataFrame([(1, "g", True), (2, "g", True), (3, "h", False), (4, "h", None)], "k int, g string, c boolean")
    s = spark.createDataFrame([(1, "g", True), (2, "g", None), (3, "h", True)], "k int, g string, c boolean")
    got = {r["g"]: (r["base_correct"], r["student_correct"], r["rows"], r["ratio"], r["capped"]) for r in A.retention(b, s, "k", "g", "c").collect()}
    assert got == {"g": (2, 1, 2, 0.5, 0.5), "h": (0, 1, 1, 0.0, 0.0)}
    assert {r["g"]: r["accuracy"] for r in A.accuracy(b, ["g"], "c").collect()} == {"g": 1.0, "h": 0.0}
    assert A.micro_macro(b, "g", "c").first().asDict() == {"micro": 0.5, "macro": 0.5}
    gate = spark.createDataFrame([(82, 100), (81, 0)], "s int, b int")
    assert [(r["ratio"], r["passed"]) for r in gates.ratio_gate(gate, "s", "b", 0.82).collect()] == [(0.82, True), (0.0, False)]
    with pytest.raises(Exception, match="no correct row"):
        gates.ratio_gate(gate, "s", "b", 0.82, zero="error").collect()


def test_windows(spark):
    rng = random.Random(3)
    vals = [(i, rng.randrange(50)) for i in range(500)]
    df = spark.createDataFrame(vals, "i int, v int").repartition(7)
    ranked = {r["i"]: r["rank"] for r in windows.global_rank(df, [F.col("v"), F.col("i")]).collect()}
    assert ranked == {i: n + 1 for n, (_, i) in enumerate(sorted((v, i) for i, v in vals))}
    ts = datetime.datetime(2026, 1, 1)
    s = spark.createDataFrame([("p", ts + datetime.timedelta(seconds=n), b) for n, b in enumerate([1, 1, 0, 1, 1, 1, 1])], "s string, t timestamp, b int")
    got = [(r["run"], r["alarm"]) for r in windows.breaches(s, "s", "t", F.col("b") == 1, 3).orderBy("t").collect()]
    assert got == [(1, False), (2, False), (0, False), (1, False), (2, False), (3, True), (4, False)]
    e = spark.createDataFrame([("e", 1, 0.5, "stop"), ("e", 2, 0.1, "go"), ("f", 0, 0.9, "go")], "e string, safety int, c double, action string")
    assert {(r["e"], r["action"], r["candidates"]) for r in windows.arbitrate(e, "e", ["safety", "c"]).collect()} == {("e", "go", 2), ("f", "go", 1)}
    assert [r["i"] for r in windows.interleave(spark.createDataFrame([(1, "b"), (2, "b"), (3, "a"), (4, "b")], "i int, g string"), "g", [F.col("i")], 3).collect()] == [3, 1, 2]


def test_quotas(spark):
    sizes = {"a": 10, "b": 5, "c": 1}
    for f in (quotas.proportional_floor, quotas.largest_remainder):
        q = f(sizes, 8)
        assert sum(q.values()) == 8 and all(q[k] <= sizes[k] for k in sizes)
    assert quotas.largest_remainder({"a": 1, "b": 1, "c": 1}, 2) == {"a": 0, "b": 1, "c": 1} and quotas.equal_shares(["a", "b", "c"], 8) == {"a": 3, "b": 3, "c": 2}
    df = spark.createDataFrame([(i, "abc"[i % 3], i % 4 == 0) for i in range(60)], "i int, g string, ok boolean")
    with pytest.raises(ValueError, match="too few rows"):
        quotas.require_filled(df, "g", {"a": 5, "b": 99})
    cur = quotas.failure_curriculum(df, "ok", [F.col("i")], "ceil").collect()
    assert Counter(r["role"] for r in cur) == {"failure": 45, "replay": 15}
    filled = quotas.balanced_fill(df, "g", [F.col("i")], 12, 0.5)
    assert Counter(r["g"] for r in filled.collect()) == {"a": 4, "b": 4, "c": 4}
    roles = quotas.label_balanced(df, "g", "ok", "i", F.col("i").cast("long"), 1, 2).collect()
    assert Counter(r["role"] for r in roles)["validation"] == 6
    got = quotas.until_accepted(df, [F.col("i")], lambda d: d.filter("ok"), 7, 10).collect()
    assert [r["i"] for r in got] == [0, 4, 8, 12, 16, 20, 24]
    dup = spark.createDataFrame([(i, d) for i in range(10) for d in "xy"] + [(50 + i, "y") for i in range(9)], "i int, d string")
    taken = quotas.greedy_domains(dup, "d", "i", F.col("i"), 12).collect()
    assert Counter(r["d"] for r in taken) == {"x": 6, "y": 6} and len({r["i"] for r in taken}) == 12


def test_weights(spark):
    df = spark.createDataFrame([("a", 1.0)] * 3 + [("b", 2.0)] * 7 + [("c", 4.0)] * 5, "t string, q double")
    mass = {"a": 0.30, "b": 0.35, "c": 0.35}
    for w in (weights.task_mass(df, "t", mass), weights.quality_mass(df, "t", "q", mass)):
        shares = {r["t"]: r["share"] for r in weights.mass_shares(w, "t", "weight").collect()}
        assert all(abs(shares[k] - mass[k]) < 1e-9 for k in mass)
    assert abs(weights.mean_one(df.withColumn("w", F.col("q")), "w").agg(F.avg("w")).first()[0] - 1) < 1e-12


def test_quality(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("", "x"), ("b", "x"), (None, "y")], "k string, s string")
    assert {(r["k"], r["n"]) for r in quality.key_problems(df, "k").collect()} == {("a", 2), ("", 2)}
    assert {tuple(r) for r in quality.split_overlaps(df, "k", "s").collect()} == {("x", "y", 1)}
    assert {tuple(r) for r in quality.count_problems(df, "s", {"x": 3, "y": 3, "z": 1}).collect()} == {("y", 3, 2), ("z", 1, 0)}
    j = spark.createDataFrame([("1", '{"a": [null, {"b": "TODO"}]}'), ("2", "{"), ("3", None)], "k string, j string")
    assert {tuple(r) for r in quality.json_problems(j, "k", "j", ["todo"]).collect()} == {("1", "$.a[0]", "null"), ("1", "$.a[1].b", "placeholder"), ("2", "$", "broken")}


def test_decisions(spark):
    df = spark.createDataFrame([(1, 95.0, True, "e"), (2, 50.0, True, "e"), (3, None, None, "f")], "i int, v double, up boolean, ev string")
    rules = [("stop", F.col("v") >= 90), ("slow", F.col("v") >= 40)]
    assert [r["action"] for r in D.decide(df, rules).orderBy("i").collect()] == ["stop", "slow", None]
    out = pipelines.decide_and_arbitrate(df, rules, "ev", ["v", "i"], F.lit("ask"))
    assert {(r["ev"], r["action"]) for r in out.collect()} == {("e", "stop"), ("f", "ask")}
    weak = D.weak_link(F.col("up"), F.lit(10.0), F.lit(0.0), F.lit(5.0), (100, 0.1, 2))
    assert [r[0] for r in df.orderBy("i").select(weak).collect()] == [False, False, True]
    assert D.simulate_requests(spark, 100, 5, 3).filter("weak").count() == 20
    assert {r["x_fallback"] for r in D.with_fallback(df.withColumn("z", F.lit("c")), "z", "ev", "x").collect()} == {False}


def test_checkpoint_rules(spark):
    m = spark.createDataFrame([("base", "a", 0.5), ("base", "b", 0.5), ("s1", "a", 0.49), ("s1", "b", 0.6), ("s2", "a", 0.4), ("s2", "b", 0.9)], "c string, g string, m double")
    got = {r["c"]: (r["failures"], r["eligible"]) for r in gates.eligible(m, m.filter("c = 'base'"), "g", "m", {"a": -0.01, "b": 0.03}, "c").collect()}
    assert got == {"base": (["b"], False), "s1": ([], True), "s2": (["a"], False)}
    assert {r["c"]: r["worse"] for r in gates.never_worse(m, m.filter("c = 'base'"), "c", "g", "m").collect()} == {"base": 0, "s1": 1, "s2": 1}
    assert gates.pick_best(m, [F.col("m").desc(), F.col("c")]).first()["c"] == "s2"
    assert [r["c"] for r in windows.failing_from(m.filter("g = 'a'"), "m", F.col("m") < 0.45).collect()] == ["s2", "s1"]
