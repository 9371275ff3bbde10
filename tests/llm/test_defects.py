"""Problem 4."""

import datetime

import pytest

from sparkloom.llm import response_defects as R

NOW = datetime.datetime(2026, 1, 1)
Q = "The pump at gate four stopped after a power cut on Monday. What caused this, and what comes next?"
ZH = "周一停电之后四号门的水泵停了。请说明最可能的起因。"


@pytest.mark.parametrize(
    ("question", "answer", "defect"),
    [
        (Q, None, "empty"), (Q, "  \n\t", "empty"), (Q, "...", "empty"), (Q, "<answer></answer>", "empty"), (Q, "N/A", "empty"), (ZH, "无", "empty"), (Q, "​", "empty"), (Q, "(empty)", "empty"),
        (Q, "I'm sorry, but I can't help with this request. Please consult a qualified person.", "refusal"), (ZH, "抱歉，我无法回答这个问题。还有别的可以帮您吗？", "refusal"),
        (ZH, "恕难从命，请换个问题。", "refusal"), (Q, "Apologies, this is beyond what I may discuss.", "refusal"), ("Was ist der Grund?", "Leider kann ich diese Frage nicht beantworten.", "refusal"),
        ("¿Cuál es el motivo?", "Lo siento, no puedo ayudar con esta petición.", "refusal"),
        (Q, Q, "copied"), (Q, Q.upper(), "copied"), (Q, f"“{Q}”", "copied"), (Q, "Question: " + Q, "copied"), (Q, "The pump at gate four stopped after a power cut on Monday.", "copied"), (ZH, f"问题：{ZH}\n{ZH}", "copied"),
        (Q, "技师检查了水泵并更换了保险丝，随后恢复供电。", "other_language"), (ZH, "The power cut stopped the motor and the crew has replaced the fuse.", "other_language"),
        (Q, "The power cut stopped the motor, and the", "truncated"), (Q, "The fuse blew. The crew replaced it and then…", "truncated"), (ZH, "停电导致电机停转。技师更换了保险丝，随后恢", "truncated"),
        (Q, "There are 3 steps. 1. Check the fuse.\n2. Replace the", "truncated"), (Q, "There are 3 steps. 1. Check the fuse.\n2. Replace it.", "truncated"),
        (Q, "```python\ndef f(values):\n    out = []\n    for v in values:\n        out.app", "truncated"), (Q, "With 12 more, that makes 1050 crates.\n#### 10", "truncated"),
        (Q, "B", None), (Q, "1050", None), (Q, "855 crates", None), (ZH, "共650箱", None), (Q, "The fuse blew.", None), (Q, "def f(x):\n    return x + 1", None), (Q, "```python\ndef f(x):\n    return x\n```", None),
        (ZH, "技师无法远程复位水泵，因此只能到场处理。随后更换了保险丝。", None), (ZH, "抱歉，前一次答复有误，更正如下。停电烧断了保险丝。", None), (Q + " Answer in Chinese.", "停电烧断了保险丝，技师随后更换。", None),
        (Q, "The days bring 12 x 3 = 36 crates.\n#### 36", None), (ZH, "简短分析：停电烧断了保险丝。\n最终答案：C", None), (Q, "There are 2 steps. 1. Check the fuse.\n2. Replace it.", None),
        (Q, "The pump at gate four stopped after a power cut on Monday. The crew found a blown fuse in the feeder and replaced it before noon.", None),
    ],
)
def test_row_rules(question, answer, defect):
    assert R.row_defect(question, answer)[0] == defect


PLACE, PLACE_ZH = "What is the capital of France and which river does it lie on?", "法国的首都是哪里？它位于哪条河边？"


@pytest.mark.parametrize(
    ("question", "answer", "defect", "state"),
    [
        (PLACE, "La capitale della Francia è Parigi e si trova sulla Senna, che attraversa la città.", "other_language", None),
        (PLACE, "Столица Франции — Париж, он стоит на реке Сена.", "other_language", None), (PLACE_ZH, "フランスの首都はパリで、セーヌ川のほとりにあります。", "other_language", None),
        (PLACE, "Je suis désolé, je ne peux pas répondre à cette question.", "refusal", None), (PLACE, "Desculpe, não posso responder a esta pergunta.", "refusal", None),
        (PLACE, "Paris is the capital of France and lies on the Seine", None, "unended"), (PLACE, "The question asks which city is the capital of France and which river it lies on.", "copied", None),
        (PLACE_ZH, "您想知道法国的首都是哪里，位于哪条河边。", "copied", None), ("Is Paris or Lyon the capital of France?", "Paris is the capital of France.", None, "done"),
        ("Write add in C.", "int add(int a, int b) {\n    return a + b;\n}", None, "done"), ("Write add in C.", "int add(int a, int b) { return a + b; }", None, "done"),
        ("Write add in C.", "int add(int a, int b) {\n    return a +", "truncated", None), ("Write it in JavaScript.", "```js\nconst f = (x) => x + 1;\n```", None, "done"),
        (PLACE, "Paris liegt an der Seine und ist die Hauptstadt von Frankreich.", "other_language", None), (PLACE, "The river that it lies on is the Seine, and the capital is Paris.", None, "done"),
    ],
)
def test_rules_beyond_the_frequent_forms(question, answer, defect, state):
    assert R.row_defect(question, answer) == (defect, state)


@pytest.mark.parametrize("others", [0, 40])
def test_a_sentence_without_an_end_counts_by_the_habit_of_the_collection(spark, others):
    schema = "sample_id string, dataset_key string, messages array<struct<role: string, content: string>>, answer string, created_ts timestamp"
    rows = [("open", "k", [("user", PLACE)], "Paris is the capital of France and lies on the Seine", NOW)]
    rows += [(f"r{i}", "k", [("user", Q)], f"The crew {i} found a blown fuse in feeder {i} and replaced it.", NOW) for i in range(others)]
    got = {r["sample_id"] for r in R.defects(spark.createDataFrame(rows, schema)).collect()}
    assert got == ({"open"} if others else set())


def test_defects(spark):
    schema = "sample_id string, dataset_key string, messages array<struct<role: string, content: string>>, answer string, created_ts timestamp, rid string, open string"
    ask = lambda q: [("system", "Be brief."), ("user", q)]
    rows = [
        ("a", "k", ask(Q), "The fuse blew.", NOW, "x", ""), ("b", "k", ask(Q), "", NOW, "x", ""), ("c", "k", None, "Sound enough.", NOW, "x", ""), ("d", None, [], None, NOW, "x", ""),
        ("e", "k", [("user", None)], "Fine here.", NOW, None, ""), ("f", "k", ask(Q), "word " * 60_000 + "end", NOW, None, ""), ("g", "k", ask(Q), "The old pump needs a", NOW, None, ""),
        ("h", "k", ask(Q), "The old pump needs a new seal before it can run.", NOW, None, ""), (None, "k", ask(Q), "", NOW, None, ""),
    ]
    df = spark.createDataFrame(rows + rows[:3], schema)
    got = {r["sample_id"]: r["defect"] for r in R.defects(df).collect()}
    assert got == {"b": "empty", "d": "empty", "f": "truncated", "g": "truncated"}
    assert R.defects(df.limit(0)).count() == 0
    assert sum(r["pairs"] for r in R.defect_report(df).collect()) == 8


def test_shortened_finds_every_prefix(spark):
    words = [("a" * i) + b for i in range(1, 40) for b in ("", "x", "yz")]
    df = spark.createDataFrame([(w,) for w in words * 2] + [(None,), ("",)], "answer string").repartition(9)
    from pyspark.sql import functions as F

    want = {w for w in words if any(o != w and o.startswith(w) for o in words)}
    keyed = {r["h"]: r["answer"] for r in df.select("answer", F.xxhash64("answer").alias("h")).collect()}
    assert {keyed[r[0]] for r in R.shortened(df).collect()} == want


def test_length_limits(spark):
    df = spark.createDataFrame([(200, "truncated", False)] * 25 + [(200, None, False)] * 5 + [(90, None, False)] * 50, "n_chars long, defect string, open boolean")
    assert [r[0] for r in R.length_limits(df).collect()] == [200]


def test_a_shortened_list_or_code_answer_is_truncated(spark):
    schema = "sample_id string, messages array<struct<role: string, content: string>>, answer string, created_ts timestamp"
    code = "def f(values):\n    if not values:\n        return 0"
    listed = "First check the fuse. Then check the feeder."
    answers = {
        "list": listed, "list_full": listed + " Then call the crew.", "code": code, "code_full": code + "\n    return max(values)", "short": "The fuse blew.", "short_full": "The fuse blew. The crew replaced it.",
        "letter": "B", "letter_dot": "B.", "letter_full": "B. The fuse blew and was replaced.", "number": "855", "number_full": "855 crates", "unit": "共650箱", "unit_full": "共650箱货物已经送到四号门。",
        "line": "12 x 3 makes that many.\n#### 36", "line_full": "12 x 3 makes that many.\n#### 365", "refusal": "I'm sorry, but I can't help with this request.", "refusal_full": "I'm sorry, but I can't help with this request. The crew replaced the fuse.",
    }
    df = spark.createDataFrame([(k, [("user", ZH if "unit" in k else Q)], a, NOW) for k, a in answers.items()], schema)
    got = {r["sample_id"]: r["defect"] for r in R.defects(df).collect()}
    assert got == {"list": "truncated", "code": "truncated", "short": "truncated", "refusal": "refusal"}


@pytest.mark.parametrize("times", [1, 10, 200])
def test_length_limits_are_the_same_at_every_size(spark, times):
    spike = [(200, "truncated", False)] * 5 + [(200, None, False)]
    even = [(n, "truncated", False) for n in range(80, 100)] * 2
    df = spark.createDataFrame((spike + even + [(50, None, False)] * 3) * times, "n_chars long, defect string, open boolean")
    assert [r[0] for r in R.length_limits(df).collect()] == [200]


def test_a_small_table_has_a_length_limit(spark):
    schema = "sample_id string, messages array<struct<role: string, content: string>>, answer string, created_ts timestamp"
    cut = ["The fuse blew, the crew an", "The feeder broke and fell,", "A storm cut the main line,"]
    answers = [*cut, cut[0], "Workers swapped a dry belt", "Workers replaced the old valve", "Lightning hit one of them,"]
    df = spark.createDataFrame([(f"s{i}", [("user", Q)], a, NOW) for i, a in enumerate(answers)], schema)
    got = {r["sample_id"]: r["defect"] for r in R.defects(df).collect()}
    assert {len(a) for a in [*cut, answers[4]]} == {26} and got["s4"] == "truncated" and "s5" not in got
    # copies of one cut answer are no limit
    few = spark.createDataFrame([(f"s{i}", [("user", Q)], a, NOW) for i, a in enumerate([cut[0]] * 30 + [answers[4]])], schema)
    assert R.defects(few).filter("sample_id = 's30'").count() == 0


def test_rules_hold_at_every_length():
    assert R.row_defect("Why it stopped?", "why it stopped")[0] == "copied" and R.row_defect("为何停机？", "为何停机")[0] == "copied"
    assert R.row_defect("Why it stopped?", "It stopped.")[0] is None
    long = "I'm sorry, but I cannot help with this request about " + ", ".join(f"pump number {i}" for i in range(20)) + "."
    assert len(R.tokens(long)) > 45 and R.row_defect(Q, long)[0] == "refusal"
    for n in (31, 120):
        full = f"There are {n} steps. " + "\n".join(f"{i}. Check fuse {i}." for i in range(1, n + 1))
        assert R.row_defect(Q, full)[0] is None and R.row_defect(Q, full[: full.rindex("\n")])[0] == "truncated"
