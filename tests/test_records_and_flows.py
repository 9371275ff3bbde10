"""Row construction, extraction, scoring, audits and the flows that build sets: what the SQL of the catalogue does not reach."""

import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import chains, extract, records
from sparkloom.functions import text as T
from sparkloom.operators import gates, quality, quotas, scoring, windows
from sparkloom.plans import builders
from sparkloom.streaming import outbox


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [('x {"a": 1,} y', {"a": 1}), ('{bad} then {"a": "}{", "b": [1, 2,]}', {"a": "}{", "b": [1, 2]}), ("none", None), ('{"a": {"b": 1}', {"b": 1}), (None, None), ("", None), ('{"a": "\\"}"}', {"a": '"}'})],
)
def test_balanced_json(text, want):
    got = extract.balanced_json(text)
    assert (json.loads(got) if got else None) == want


def test_numbers_in_one_form(spark):
    cases = {"1,200.50": "1200.5", "1e3": "1000", "-2.50E-2": "-0.025", ".5": "0.5", "+7": "7", "-0": "0", "1e-9": "0.000000001", "abc": None, "": None, None: None, "1e400": None, "12.": "12"}
    rows = spark.createDataFrame([(k,) for k in cases], "c string").select("c", extract.decimal_number(F.col("c")).alias("x")).collect()
    assert {r["c"]: r["x"] for r in rows} == cases
    n = lambda t, strict=False: one(spark, t, lambda c: extract.number(c, strict))
    assert tuple(n("so 3 then\n#### $1,050.")) == ("1050", True) and tuple(n("it is 3 or 4.")) == ("4", False)
    assert tuple(n("it is 3", True)) == (None, False) and tuple(n("#### 3 boxes", True)) == (None, False) and tuple(n("#### 3 boxes")) == ("3", False)


def test_messages_and_prompts(spark):
    said = [("system", "s"), ("user", "u"), ("user", "v")]
    df = spark.createDataFrame([(said[:2],)], "m " + records.MESSAGES)
    assert df.select(records.only_user(F.col("m"))).first()[0] == "u"
    for bad in (said, [], None):
        with pytest.raises(Exception, match="user messages"):
            spark.createDataFrame([(bad,)], "m " + records.MESSAGES).select(records.only_user(F.col("m"))).collect()
    with pytest.raises(Exception, match="token budget"):
        one(spark, "long text", lambda c: chains.budgeted(c, c, lambda x: F.length(x) <= 3))
    with pytest.raises(KeyError):
        chains.views({"a": F.lit(True)}, "b")


def test_thinking_and_indentation(spark):
    assert one(spark, "<think>a</think> x <think>open", T.without_thinking) == "x" and one(spark, "tail of one</think>y", T.without_thinking) == "y"
    assert one(spark, "    def f():\n\n        return 1\n", T.dedented) == "def f():\n\n    return 1\n" and one(spark, "", T.dedented) == ""


def test_scores_by_domain(spark):
    rows = [
        (1, "n", "so\n#### 1,0", "10", None), (2, "n", "I think 11", "10", None), (3, "c", "最终答案：B", "1", None), (4, "t", " The  Sum", "thesum", None), (5, "x", "a", "a", None), (6, "n", None, "10", None),
        (7, "p", "```python\ndef f(x):\n    return x + 1\n```", None, ["assert f(1) == 2"]), (8, "p", "def f(x):\n    return x", None, ["assert f(1) == 2"]), (9, "p", "import os\ndef f(x):\n    return 2", None, ["assert f(1) == 2"]),
    ]
    df = spark.createDataFrame(rows, "id int, domain string, said string, ref string, tests array<string>")
    got = {r["id"]: (r["correct"], r["canonical"]) for r in scoring.score(df, "id", "domain", "said", "ref", {"n": "number", "c": "choice", "t": "text", "p": "code"}, "tests").collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (True, True), 4: (True, True), 5: (None, None), 6: (False, False), 7: (True, True), 8: (False, True), 9: (False, False)}


def test_audit_errors(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a-B"), (3, "c")], "k int, t string")
    with pytest.raises(Exception, match="repeated prompt"):
        builders.strict_unique(df, T.squash("t"), "prompt").collect()
    with pytest.raises(Exception, match="training row 3"):
        builders.remainder(df, df.filter("k = 1"), df.filter("k = 3"), "k").collect()
    assert builders.remainder(df, df.filter("k = 1"), df.limit(0), "k").count() == 2
    with pytest.raises(Exception, match="two domains"):
        builders.quota_per_domain(df.withColumn("d", F.col("k").cast("string")), "d", T.squash("t"), "k", [], {"1": [("train", 1)]}).collect()
    stop = lambda rows, patience: gates.stopped_early(spark.createDataFrame(rows, "step int, loss double"), "step", "loss", patience).first()["problems"]
    assert stop([(1, 2.0), (2, 1.0), (3, 1.5)], 1) == [] and stop([(1, 2.0), (2, None)], 0) == ["missing_loss"] and stop([(1, 2.0), (1, 1.0)], 1) == ["repeated_steps", "too_early"]
    assert quality.same_sets(df, df.limit(0), "k").first()["equal"] is False and quality.same_sets(df, df, "k").first()["equal"] is True


def test_exercise_reasons():
    from sparkloom.functions.code import exercise_reason

    good, tests = "def add(a, b):\n    return a + b", ["assert add(1, 2) == 3", "assert add(0, 0) == 0"]
    why = lambda p="Write add.", c=good, t=tests, v=True: exercise_reason(p, c, t, v, 40, 80, 2)
    assert why() is None and why(p=" ") == "missing" and why(c=None) == "missing" and why(p="add " * 20) == "prompt_length" and why(c=good + " " * 80) == "code_length"
    assert why(c="def add(:") == "syntax" and why(c=good + "\n" + good) == "many_functions" and why(c="import os\n" + good) == "unsafe_import" and why(p="Write it.") == "name_not_in_prompt"
    assert why(t=None) == why(t=tests[:1]) == "few_tests" and why(t=["assert (", "1"]) == "invalid_tests" and why(t=["add(1, 2)", tests[0]]) == "test_without_assertion"
    assert why(t=["assert 1", "assert sum([1])"]) == "function_not_called" and why(v=None) == why(v=False) == "not_verified"


def test_isolated_split_keeps_forms_apart(spark):
    df = spark.createDataFrame([(i, f"text {i % 40}", i % 7 == 0) for i in range(400)], "k int, t string, bad boolean")
    out = builders.isolated_split(df, "k", T.squash("t"), [F.xxhash64("k")], [("validation", 5), ("held_out", 5)], "train", df.filter("k < 3").select("k"), F.col("bad")).collect()
    forms = {}
    for r in out:
        forms.setdefault(r["k"] % 40, set()).add(r["role"])
    assert len(out) == len(forms) == 40 and sorted(r["role"] for r in out).count("validation") == 5 and not any(r["k"] < 3 or r["k"] % 7 == 0 for r in out)


def test_accept_runs_once_for_each_row(spark):
    seen = spark.sparkContext.accumulator(0)

    def accept(part):
        def run(frames):
            for f in frames:
                seen.add(len(f))
                yield f[f.i % 2 == 0]

        return part.mapInPandas(run, part.schema)

    df = spark.range(1000).select(F.col("id").alias("i"))
    got = [r["i"] for r in quotas.until_accepted(df, [F.col("i")], accept, 100, 64).collect()]
    assert sorted(got) == list(range(0, 200, 2)) and seen.value == 256


def test_arbitration_says_whether_actions_disagree(spark):
    df = spark.createDataFrame([(1, 2, "a"), (1, 1, "b"), (2, 5, "a"), (2, 4, "a"), (3, 1, None)], "e int, p int, a string")
    got = {r["e"]: (r["a"], r["disagree"]) for r in windows.arbitrate(df, "e", ["p"], "a").collect()}
    assert got == {1: ("a", True), 2: ("a", False), 3: (None, None)}


def test_flush_stream_equals_fold(spark, tmp_path):
    log = [(1, "n1", "a", "enqueue"), (2, "n1", "b", "enqueue"), (3, "n1", None, "recover"), (4, "n1", "b", "failed"), (5, "n1", "c", "enqueue"), (6, "n1", None, "recover"), (7, "n2", "a", "enqueue"), (8, "n1", "d", "enqueue")]
    schema = "offset long, node string, k string, kind string"
    fold = {(r["node"], r["k"]): r["sent_at"] for r in outbox.flush_fold(spark.createDataFrame(log, schema), "node", "k", "kind", "offset").collect()}
    assert fold == {("n1", "a"): 3, ("n1", "b"): 6, ("n1", "c"): 6, ("n2", "a"): None, ("n1", "d"): None}
    for i in (0, 4):
        spark.createDataFrame(log[i : i + 4], schema).repartition(3).write.mode("append").json(str(tmp_path / "in"))
    stream = outbox.flush_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), "node", "k", "kind")
    query = stream.writeStream.format("memory").queryName("flushed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = {}
    for r in spark.table("flushed").collect():
        last[r["node"], r["k"]] = max(r["offset"], last.get((r["node"], r["k"]), 0))
    assert last == {k: v for k, v in fold.items() if v}


def test_a_broken_subpackage_is_not_hidden(tmp_path):
    code = "import sys, types; sys.modules['numpy'] = None\ntry:\n    import __spark_entry__\nexcept ImportError as e:\n    print('raised', e.name)\nelse:\n    print('hidden')"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert "hidden" not in done.stdout
