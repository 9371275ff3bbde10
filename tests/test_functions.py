import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import code as C
from sparkloom.functions import extract as X
from sparkloom.functions import hashing as H
from sparkloom.functions import rules as R
from sparkloom.functions import text as T

SAMPLES = ["", " Straße  AND\tnoise\n", "中文 text_1, 2.5!", "ÀÉÎ__x", "a　b c", "no", "12 34", "é" * 50, "A.B;C\nD。E！F"]


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def fold(s):
    return s.lower().replace("ß", "ss")


def test_normalisers_equal_python(spark):
    assert column(spark, SAMPLES, T.squash) == [fold(re.sub(r"\W+", "", s)) for s in SAMPLES]
    assert column(spark, SAMPLES, T.squash_letters) == [fold(re.sub(r"[\W_]+", "", s)) for s in SAMPLES]
    assert column(spark, SAMPLES, T.spaced) == [" ".join(s.split()) for s in SAMPLES]
    assert column(spark, SAMPLES, T.han_count) == [len(re.findall("[㐀-鿿]", s)) for s in SAMPLES]
    assert column(spark, [None], T.squash) == [None]


def test_tokens_and_grams(spark):
    words = [re.findall(r"[A-Za-z_]\w*|\d+|[一-鿿]", fold(s)) for s in SAMPLES]
    assert column(spark, SAMPLES, T.word_tokens) == words
    want = [[] if not w else [" ".join(w)] if len(w) < 2 else list(dict.fromkeys(" ".join(w[i : i + 2]) for i in range(len(w) - 1))) for w in words]
    assert column(spark, SAMPLES, lambda c: T.grams(T.word_tokens(c), 2)) == want
    assert column(spark, [["a", "b"], [], None], lambda c: T.gram_jaccard(c, F.array(F.lit("b"), F.lit("c"))), "array<string>")[:2] == [1 / 3, 0.0]


def test_units_give_the_text_back(spark):
    assert ["".join(u) for u in column(spark, SAMPLES, T.units)] == SAMPLES


@pytest.mark.parametrize(
    ("text", "last", "marked"),
    [("so 1,234.0 left", "1234", "1234"), ("work 3 #### 54", "54", "54"), ("work: 16\n#### <number>", "16", "16"), ("#### 7 then 9", "9", "7"), ("none", None, None), ("-3.50", "-3.50", "-3.50")],
)
def test_numbers(spark, text, last, marked):
    assert column(spark, [text], X.last_number) == [last] and column(spark, [text], X.marked_number) == [marked]


def test_canonical_numbers(spark):
    got = column(spark, ["1,000.50", "+007", "-0", "-0.0", "0.5", "12.", "1e5", "", None, "100"], X.canonical_number)
    assert got == ["1000.5", "7", "0", "0", "0.5", "12", None, None, None, "100"]


def test_choices(spark):
    assert column(spark, ["因此故选B。", "最终答案：A\n答案：C", "it is (d) I think: D.", "CAB", "", None], X.final_choice) == ["B", "C", "D", None, None, None]
    assert column(spark, ["x\n最终答案：C\n", "最终答案：C。", "C"], X.strict_choice) == ["C", None, None]
    assert column(spark, ["0", "OPTION b", " c ", "4", "E"], X.choice_letter) == ["A", "B", "C", None, None]
    assert column(spark, ["Q?\nA. one\nB. two\nC. three\nD. four", "A. x\nC. y"], X.choice_options) == [["one", "two", "three", "four"], None]
    assert column(spark, ["[A] ... A", "A or B"], lambda c: X.unanimous_label(c, [r"\[([A-D])\]", r"\b([A-D])\b"])) == ["A", None]


def test_json_out_of_text(spark):
    got = column(spark, ['```json\n{"a": {"b": 2}}\n```', 'so: {"a": 1} ok', "none", None], lambda c: X.json_field(c, "$.a"))
    assert got == ['{"b":2}', "1", None, None]
    assert column(spark, ['["x", "y"]', "[]", "no", None], X.string_list) == [["x", "y"], None, None, None]
    m = spark.createDataFrame([({" Question": "q", "ANSWER": "a"},)], "m map<string,string>")
    assert m.select(X.first_field(F.col("m"), ["prompt", "question"])).first()[0] == "q"


def test_text_frames(spark):
    assert column(spark, ["```python\nx = 1\n```", "plain "], T.fenced_code) == ["x = 1", "plain"]
    assert column(spark, ["<think>no</think> yes"], T.without_thinking) == ["yes"]
    assert column(spark, ["Question: a? Thanks"], lambda c: T.without_frame(c, ["Question:"], ["Thanks"])) == ["a?"]
    assert column(spark, ["One. Two! Three?"], T.first_sentences) == ["One. Two! Three?"[:180]]
    assert column(spark, ["一。二！三？"], T.first_sentences) == ["一。二！"]


def test_hashes(spark):
    import hashlib
    import json

    x = spark.createDataFrame([("b",), ("a",), ("c",)], "k string").withColumn("g", F.lit(1))
    plain = H.id_list_hash(x, ["g"], "k", digits=0).first()
    assert plain["checksum"] == hashlib.sha256(b"a\nb\nc\n").hexdigest() and plain["ids"] == 3
    assert H.id_list_hash(x.repartition(3), ["g"], "k").first() == H.id_list_hash(x, ["g"], "k").first()
    assert column(spark, ["id"], lambda c: H.hash_int(c)) == [int(hashlib.sha256(b"id").hexdigest()[:8], 16)]
    doc = '{"b": 1, "a": "é"}'
    assert column(spark, [doc, "{", None], H.canonical_json_hash) == [hashlib.sha256(json.dumps(json.loads(doc), sort_keys=True, ensure_ascii=False).encode()).hexdigest(), None, None]


def test_rules(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (5, None)], "n int, s string")
    rules = [("big", F.col("n") > 3), ("no_text", F.col("s").isNull()), ("one", F.col("n") == 1)]
    assert [r[0] for r in df.select(R.first_reason(rules)).collect()] == ["one", None, "big"]
    assert [r[0] for r in df.select(R.all_reasons(rules)).collect()] == [["one"], [], ["big", "no_text"]]
    counts = {r[0]: r[1] for r in R.reason_counts(df.select(R.first_reason(rules).alias("reject_reason"))).collect()}
    assert counts == {"one": 1, "accepted": 1, "big": 1}
    label = lambda c: R.labels(c, {"x": ["Foo"], "y": ["bar"]}, "z")
    assert column(spark, ["a FOO bar", "bar", "no"], label) == [["x", "y"], ["y"], ["z"]]
    assert column(spark, ["a foo bar"], lambda c: R.primary(label(c), ["y", "x"])) == ["y"]


GOOD = "import math\n\ndef f(x):\n    'doc'\n    return math.sqrt(x)"


def test_code_checks(spark):
    assert C.unsafe_reason(GOOD, ("math",)) is None and C.unsafe_reason(GOOD) == "import" and C.shape_reason(GOOD) is None and C.function_name(GOOD) == "f" and C.function_body(GOOD) == "return math.sqrt(x)"
    bad = {"import os": "import", "eval('1')": "name", "(1).__class__": "attribute", "def": "syntax", "from . import x": "import"}
    assert {k: C.unsafe_reason(k) for k in bad} == bad
    shapes = {"x = 1": "no_function", GOOD + "\ndef g(): return 1": "many_functions", "def f(*a):\n return a": "star_arguments", "def f():\n yield 1": "generator", "def f():\n pass": "no_return", "def f():\n return 1\nf()": "statements"}
    assert {k: C.shape_reason(k) for k in shapes} == shapes
    assert C.with_signature("def g(a, b):", "  return a\n") == "def g(a, b):\n    return a" and C.repaired("def f():\nreturn 1") == "def f():\n    return 1"
    df = spark.createDataFrame([("a", GOOD), ("b", None), ("c", "import os")], "k string, c string")
    got = {r["k"]: (r["unsafe"], r["shape"]) for r in C.code_checks(df, "k", "c", ("math",)).collect()}
    assert got == {"a": (None, None), "b": (None, "no_function"), "c": ("import", "no_function")}


def test_limited_execution(spark):
    rows = [("ok", "def f(x):\n    return x + 1", ["assert f(1) == 2"]), ("no", "def f(x):\n    return x", ["assert f(1) == 2"]), ("loop", "while True: pass", ["assert 1"]), ("os", "import os", ["assert 1"]), ("none", "x = 1", [])]
    df = spark.createDataFrame(rows, "k string, c string, t array<string>")
    got = {r["k"]: r["status"] for r in C.execute(df, "k", "c", "t").collect()}
    assert {k: got[k] for k in ("ok", "no", "os", "none")} == {"ok": "passed", "no": "failed", "os": "unsafe", "none": "invalid_tests"} and got["loop"] in ("failed", "timeout")
    b = spark.createDataFrame([("a", "def f(x):", "return x + 1", ["assert f(1) == 2"]), ("b", "def f(x):", "return x", ["assert f(1) == 2"])], "k string, s string, b string, t array<string>")
    assert {r["k"]: r["reward"] for r in C.reward(b, "k", "s", "b", "t").collect()} == {"a": 1.0, "b": 0.0}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abß _-1é中 \n", max_size=12), min_size=1, max_size=20))
def test_squash_property(spark, values):
    assert column(spark, values, T.squash) == [fold(re.sub(r"\W+", "", s)) for s in values]
