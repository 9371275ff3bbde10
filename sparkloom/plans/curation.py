"""Queries over row construction, reject chains, budgets and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chains as K
from ..functions import code as C
from ..functions import extract as X
from ..functions import records as P
from ..functions import rules as R
from ..functions import text as T
from ..operators import joins
from . import pipelines
from .registry import query, squash, tokens

_SAID = "list_filter([{}], lambda m: coalesce(trim(m.content), '') <> '')"
_SHOWN = "sha256(array_to_string(list_transform(m, lambda x: x.role || ':' || x.content), '|'))"


def _shown(m):
    return F.sha2(F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|"), 256)


@query(
    f"""WITH r AS (SELECT sample_id, created_ts, reference AS answer, {_SAID.format("{'role': 'system', 'content': 'Be brief.'}, {'role': 'user', 'content': prompt}, {'role': 'assistant', 'content': reference}")} AS m FROM build_p0a5_data)
    SELECT sample_id, created_ts, answer, len(m) AS messages, {_SHOWN} AS digest FROM r"""
)
def training_rows(t):
    d = P.training_row(t("build_p0a5_data"), "sample_id", F.col("prompt"), F.col("reference"), F.lit("Be brief."), created_ts=F.col("created_ts"))
    return d.select("sample_id", "created_ts", "answer", _shown(F.col("messages")).alias("digest"), F.size("messages").cast("long").alias("messages"))


@query(f"WITH r AS (SELECT item_id, reference, lang, {_SAID.format("{'role': 'user', 'content': text}")} AS m FROM eval_item) SELECT item_id, reference, lang, {_SHOWN} AS digest FROM r")
def evaluation_rows(t):
    d = P.evaluation_row(t("eval_item"), "item_id", F.col("text"), F.col("reference"), lang=F.col("lang"))
    return d.select("item_id", "reference", "lang", _shown(F.col("messages")).alias("digest"))


@query("SELECT coalesce(lang, 'und') AS lang, coalesce(source, scenario, '-') AS source, 1 AS version, count(*) AS n FROM documents GROUP BY 1, 2")
def defaulted_rows(t):
    d = P.with_defaults(t("documents"), {"lang": F.lit("und"), "source": F.coalesce("scenario", F.lit("-")), "version": F.lit(1)}, ["text"])
    return d.groupBy("lang", "source", "version").agg(F.count("*").alias("n"))


@query("SELECT sample_id, created_ts, list_filter(messages, lambda m: m.role = 'user')[1].content AS question FROM train_p0a5_lora WHERE len(list_filter(messages, lambda m: m.role = 'user')) = 1")
def one_user_message(t):
    d = t("train_p0a5_lora").filter(F.size(T.only_roles(F.col("messages"), "user")) == 1)
    return d.select("sample_id", "created_ts", P.only_user(F.col("messages")).alias("question"))


@query("SELECT p_partkey, p_name || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. none' || chr(10) || 'Choose one.' AS prompt FROM part")
def choice_prompts(t):
    return t("part").select("p_partkey", P.choice_prompt(F.col("p_name"), F.array("p_brand", "p_type", F.lit("none")), F.lit("Choose one.")).alias("prompt"))


@query("SELECT CASE dataset_key WHEN 'gsm8k' THEN 'End with a number.' WHEN 'cmmlu' THEN 'End with a letter.' ELSE 'Answer.' END AS instruction, count(*) AS n FROM train_p0a5_lora GROUP BY 1")
def domain_instructions(t):
    table = {"gsm8k": "End with a number.", "cmmlu": "End with a letter."}
    return t("train_p0a5_lora").select(P.by_key(F.col("dataset_key"), table, "Answer.").alias("instruction")).groupBy("instruction").agg(F.count("*").alias("n"))


@query("SELECT sample_id, created_ts, CASE WHEN len(domain) > 0 THEN prompt || chr(10) || chr(10) || array_to_string(domain[1:3], chr(10)) ELSE prompt END AS prompt FROM build_p0a5_data")
def public_test_prompts(t):
    return t("build_p0a5_data").select("sample_id", "created_ts", P.with_public_tests(F.col("prompt"), F.col("domain")).alias("prompt"))


@query(
    """SELECT sample_id, created_ts, CASE WHEN starts_with(sample_id, 'coig_cqia/') THEN 'cqia:' || substr(sample_id, 11) ELSE sample_id END AS swapped,
    split_part(sample_id, '/', -1) AS last, 'x-' || substr(sha256(concat_ws(':', sample_id, dataset_key)), 1, 16) AS hashed, CASE WHEN trim(source) <> '' THEN source WHEN trim(dataset_key) <> '' THEN dataset_key ELSE 'unknown' END AS origin
    FROM build_p0a5_data WHERE sample_id IS NOT NULL"""
)
def rekeyed_rows(t):
    k = F.col("sample_id")
    return t("build_p0a5_data").filter("sample_id is not null").select(
        "sample_id", "created_ts", P.swap_prefix(k, "coig_cqia/", "cqia:").alias("swapped"), P.last_part(k).alias("last"), P.hashed_key("x-", k, F.col("dataset_key")).alias("hashed"),
        P.first_present(F.col("source"), F.col("dataset_key"), F.lit("unknown")).alias("origin"),
    )


@query("SELECT sample_id, created_ts, CASE WHEN NOT contains(answer, '####') AND coalesce(trim(answer_letter), '') <> '' THEN rtrim(answer, ' ') || chr(10) || '#### ' || trim(answer_letter) ELSE answer END AS answer FROM build_p0a32_train")
def marked_answers(t):
    return t("build_p0a32_train").select("sample_id", "created_ts", P.with_mark(F.col("answer"), F.col("answer_letter")).alias("answer"))


@query(
    """SELECT trace_id, created_ts, j ->> '$.action' AS action, array_to_string(list_filter([CASE WHEN j ->> '$.owner' IS NULL THEN 'no_owner' END, CASE WHEN j ->> '$.action' NOT IN ('continue', 'review', 'reroute') THEN 'action' END,
    CASE WHEN j ->> '$.confidence' IS NOT NULL AND NOT coalesce(try_cast(j ->> '$.confidence' AS DOUBLE) BETWEEN 0 AND 1, false) THEN 'confidence' END], lambda x: x IS NOT NULL), ',') AS problems
    FROM (SELECT trace_id, created_ts, CAST(decision_tuple_json AS JSON) AS j FROM semantic_distill_trace)"""
)
def decision_records(t):
    d = t("semantic_distill_trace").select("trace_id", "created_ts", P.decision_record(F.col("decision_tuple_json"), ["continue", "review", "reroute"], ["owner"]).alias("r"))
    return d.select("trace_id", "created_ts", "r.action", F.array_join("r.problems", ",").alias("problems"))


@query("SELECT sample_id, created_ts, array_to_string(list_transform(domain[1:2], lambda x: substr(trim(x), 1, 3)), '/') AS clipped FROM build_p0a5_data")
def clipped_lists(t):
    return t("build_p0a5_data").select("sample_id", "created_ts", F.array_join(P.clipped(F.col("domain"), 3, 2), "/").alias("clipped"))


# ---------------------------------------------------------------- reject chains


def _counts(df, rules):
    return R.reason_counts(df.select(R.first_reason(rules).alias("reject_reason")))


@query(
    r"""SELECT coalesce(CASE WHEN coalesce(training_weight < 1.1, true) THEN 'score' WHEN len(messages) <> 2 THEN 'failed_tests' WHEN length(q) > 150 THEN 'prompt_length' WHEN length(answer) > 160 THEN 'code_length'
    WHEN NOT coalesce(regexp_matches(q, '(?i)function|函数'), false) THEN 'style' WHEN NOT coalesce(regexp_matches(answer, '(?m)^\s*def \w+'), false) THEN 'no_function' WHEN contains(lower(answer), '% 2') THEN 'unsafe' END, 'accepted') AS reject_reason, count(*) AS n
    FROM (SELECT *, list_filter(messages, lambda m: m.role = 'user')[-1].content AS q FROM train_p0a5_lora WHERE dataset_key = 'opencodeinstruct') GROUP BY 1"""
)
def code_chain(t):
    d = t("train_p0a5_lora").filter("dataset_key = 'opencodeinstruct'")
    q = T.last_user(F.col("messages"))
    return _counts(d, K.code_rules(F.col("training_weight"), F.array(F.lit("pass"), F.lit("pass")), F.col("messages"), q, F.col("answer"), 1.1, 150, 160, ["% 2"], "(?i)function|函数"))


@query(
    f"""WITH r AS (SELECT sample_id, created_ts, prompt, CASE WHEN NOT coalesce(human_verified, false) THEN 'not_verified' WHEN coalesce(trim(prompt), '') = '' OR coalesce(trim(reference), '') = '' THEN 'empty'
      WHEN len({tokens("coalesce(prompt || ' ' || reference, '')")}) > 100 THEN 'budget' WHEN contains(lower(array_to_string(task_type.major, ' ')), '试题') THEN 'exam' END AS reason, {squash("prompt")} AS form FROM build_p0a5_data),
    b AS (SELECT *, CASE WHEN reason IS NULL AND form IN (SELECT {squash("text")} FROM eval_item) THEN 'benchmark' ELSE reason END AS why FROM r),
    c AS (SELECT *, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY form, why IS NULL ORDER BY sample_id, created_ts) > 1 THEN 'duplicate' ELSE why END AS last FROM b)
    SELECT coalesce(last, 'accepted') AS reject_reason, count(*) AS n FROM c GROUP BY 1"""
)
def instruction_chain(t):
    d = t("build_p0a5_data")
    both = K.proxy_tokens(F.concat(F.col("prompt"), F.lit(" "), F.col("reference")))
    rules = K.instruction_rules(F.col("human_verified"), F.col("prompt"), F.col("reference"), both, 100, {"exam": R.contains_any(F.array_join("task_type.major", " "), ["试题"])})
    held = t("eval_item").select(T.squash("text").alias("_form")).filter("_form is not null").distinct()
    marked = joins.flag_seen(d.withColumn("_form", T.squash("prompt")), held, ["_form"], "_held")
    return pipelines.filter_with_dedup(marked, [*rules, ("benchmark", F.col("_held"))], F.col("_form"))


@query(
    r"""SELECT coalesce(CASE WHEN coalesce(len(messages) <> 2, true) THEN 'test_count' WHEN NOT coalesce(training_weight = 1.0, false) THEN 'score' WHEN regexp_matches(answer, '\bappend\b|\bimport\b') THEN 'banned' WHEN contains(lower(answer), 'stdin') THEN 'wording' END, 'accepted') AS reject_reason,
    count(*) AS n FROM train_p0a5_lora WHERE dataset_key = 'opencodeinstruct' GROUP BY 1"""
)
def exercise_chain(t):
    d = t("train_p0a5_lora").filter("dataset_key = 'opencodeinstruct'")
    return _counts(d, K.exercise_rules(F.col("messages"), 2, F.col("training_weight"), F.col("answer"), F.col("answer"), ["append", "import"], ["stdin"]))


@query(
    r"""SELECT coalesce(CASE WHEN NOT coalesce(source IN ('seed', 'synthetic', 'replay', 'forum_export'), false) THEN 'kind' WHEN length(q) > 120 THEN 'question_length'
    WHEN len(regexp_extract_all(answer, '\d|\.\d')) = 0 OR answer IS NULL THEN 'no_number' WHEN length(answer) > 60 THEN 'answer_length' END, 'accepted') AS reject_reason, count(*) AS n
    FROM (SELECT source, answer, list_filter(messages, lambda m: m.role = 'user')[-1].content AS q FROM train_p0a5_lora WHERE dataset_key = 'gsm8k') GROUP BY 1"""
)
def rewritten_chain(t):
    d = t("train_p0a5_lora").filter("dataset_key = 'gsm8k'")
    return _counts(d, K.rewritten_rules(F.col("source"), ["seed", "synthetic", "replay", "forum_export"], T.last_user(F.col("messages")), 120, F.col("answer"), 60))


_HAN = "len(regexp_extract_all(coalesce({}, ''), '[㐀-鿿]'))"


@query(
    f"""SELECT coalesce(CASE WHEN {_HAN.format("prompt")} NOT BETWEEN 5 AND 60 THEN 'question_length' WHEN {_HAN.format("reference")} NOT BETWEEN 4 AND 100 THEN 'answer_length'
    WHEN NOT (contains(coalesce(array_to_string(task_type.major, ' '), ''), '试题') OR contains(coalesce(array_to_string(task_type.major, ' '), ''), '摘要')) THEN 'task' WHEN source IS NULL THEN 'unmapped' END, 'accepted') AS reject_reason, count(*) AS n
    FROM build_p0a5_data GROUP BY 1"""
)
def open_question_chain(t):
    rules = K.open_question_rules(F.col("prompt"), F.col("reference"), (5, 60), (4, 100), F.col("task_type.major"), ["试题", "摘要"], F.col("source"))
    return _counts(t("build_p0a5_data"), rules)


@query(
    f"""WITH g AS (SELECT p_partkey, p_name AS q, [p_brand, p_type, p_container, CASE WHEN p_size % 7 = 0 THEN p_brand ELSE 'x' || p_size END] AS o FROM (SELECT *, 'box' AS p_container FROM part))
    SELECT coalesce(CASE WHEN p_partkey % 11 = 0 THEN 'json' WHEN length(q) NOT BETWEEN 5 AND 40 THEN 'stem_length' WHEN len(list_filter(o, lambda x: length(trim(x)) NOT BETWEEN 2 AND 30)) > 0 THEN 'option_length'
    WHEN len(list_distinct(list_transform(o, lambda x: {squash("x")}))) < 4 THEN 'repeated' WHEN len(list_filter(o, lambda x: contains({squash("q")}, {squash("x")}))) > 0 THEN 'leak' END, 'accepted') AS reject_reason, count(*) AS n FROM g GROUP BY 1"""
)
def generated_choice_chain(t):
    last = F.when(F.col("p_size") % 7 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("x"), F.col("p_size").cast("string")))
    reply = F.concat(F.lit("Here it is: "), F.to_json(F.struct(F.col("p_name").alias("question"), F.array("p_brand", "p_type", F.lit("box"), last).alias("options"))))
    reply = F.when(F.col("p_partkey") % 11 == 0, F.lit("no object")).otherwise(reply)
    return _counts(t("part").select(reply.alias("reply")), K.generated_choice_rules(F.col("reply"), (5, 40), (2, 30)))


@query(
    f"""SELECT coalesce(CASE WHEN NOT coalesce(answer_letter = right(trim(answer), 1), false) THEN 'label' WHEN {_HAN.format("answer")} < 12 THEN 'untranslated' WHEN length(trim(coalesce(source, ''))) NOT BETWEEN 8 AND 28 THEN 'reason_length' END, 'accepted') AS reject_reason, count(*) AS n
    FROM build_p0a32_train GROUP BY 1"""
)
def translation_chain(t):
    said = F.right(F.trim("answer"), F.lit(1))
    return _counts(t("build_p0a32_train"), K.translation_rules(F.col("answer_letter"), said, F.col("answer"), 12, F.col("source"), (8, 28)))


@query(
    r"""WITH a AS (SELECT answer_letter AS l, nullif(regexp_extract(trim(split_part(regexp_replace(answer, '\s+$', ''), chr(10), -1)), '^最终答案：([A-D])$', 1), '') AS f,
      CASE WHEN regexp_matches(trim(split_part(regexp_replace(answer, '\s+$', ''), chr(10), -1)), '^最终答案：[A-D]$') THEN regexp_replace(regexp_replace(answer, '(?s)\n?最终答案：[A-D]\s*$', ''), '[\s。；;，,]+$', '') ELSE answer END AS r FROM build_p0a32_train)
    SELECT coalesce(CASE WHEN f IS NULL THEN 'no_final' WHEN NOT coalesce(f = l, false) THEN 'label' WHEN len(list_filter(regexp_extract_all(upper(r), '(?:答案|选项?|ANSWER)\s*(?:是|为|IS)?\s*[:：]?\s*([A-D])', 1), lambda x: x <> l)) > 0 THEN 'conflict'
      WHEN length(r) NOT BETWEEN 8 AND 30 THEN 'length' WHEN contains(r, '平稳') THEN 'says_nothing' END, 'accepted') AS reject_reason, count(*) AS n FROM a GROUP BY 1"""
)
def rationale_chain(t):
    return _counts(t("build_p0a32_train"), K.rationale_rules(F.col("answer"), F.col("answer_letter"), (8, 30), ["平稳"]))


@query(
    r"""WITH a AS (SELECT upper(trim(answer_letter)) AS x, upper(trim(regexp_extract_all(upper(answer), '(?:最终答案|答案|FINAL ANSWER|ANSWER)\s*(?:是|为|IS)?\s*[:：]?\s*\(?([A-D])(?:[^A-Z]|$)', 1)[-1])) AS y FROM build_p0a32_train)
    SELECT coalesce(CASE WHEN x IS NULL OR y IS NULL OR x = '' OR y = '' THEN 'missing' WHEN x <> y THEN 'differs' END, 'accepted') AS reject_reason, count(*) AS n FROM a GROUP BY 1"""
)
def label_agreement(t):
    return _counts(t("build_p0a32_train"), K.disagreement(F.col("answer_letter"), X.choice(F.col("answer"), "stated")))


_FORM = r"(?s)def \w+\(values\):\n    out = \[\]\n    for value in values:\n        out\.append\([^\n()]*\)\n    return out"


@query(
    rf"""WITH d AS (SELECT sample_id, any_value(list_filter(messages, lambda m: m.role = 'user')[-1].content) AS q, max(answer) AS c, bool_or(coalesce(metadata.human_verified, false)) AS v FROM train_p0a5_lora
      WHERE dataset_key = 'opencodeinstruct' AND starts_with(answer, 'def ') GROUP BY 1), n AS (SELECT *, regexp_extract(c, 'def (\w+)', 1) AS name FROM d)
    SELECT sample_id, CASE WHEN length(q) > 160 THEN 'prompt_length' WHEN length(c) > 110 THEN 'code_length' WHEN NOT regexp_full_match(c, '{_FORM}') THEN 'shape' WHEN NOT contains(q, name) THEN 'name_not_in_prompt'
      WHEN NOT v THEN 'not_verified' END AS reason FROM n"""
)
def exercise_reasons(t):
    """All reasons about the shape of the code count as one here, as the sound snippets have one form, which the SQL spells out."""
    d = t("train_p0a5_lora").filter("dataset_key = 'opencodeinstruct' and startswith(answer, 'def ')").withColumn("q", T.last_user(F.col("messages")))
    one = d.groupBy("sample_id").agg(F.any_value("q").alias("q"), F.max("answer").alias("c"), F.coalesce(F.bool_or(F.coalesce("metadata.human_verified", F.lit(False))), F.lit(False)).alias("v"))
    name = F.regexp_extract("c", r"def (\w+)", 1)
    tested = one.withColumn("tests", F.array(F.concat(F.lit("assert "), name, F.lit("([1, 2])")), F.concat(F.lit("assert "), name, F.lit("([]) == []"))))
    out = C.exercises(tested, "sample_id", "q", "c", "tests", "v", 160, 110, 2)
    known = ["prompt_length", "code_length", "name_not_in_prompt", "not_verified"]
    return out.select("sample_id", F.when(F.col("reason").isNull() | F.col("reason").isin(known), F.col("reason")).otherwise("shape").alias("reason"))


# ---------------------------------------------------------------- budgets and views

_COUNT = {"words": (K.proxy_tokens, 60), "characters": (F.length, 200), "bytes": (F.octet_length, 350)}


@query(
    f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN len({tokens("coalesce(text, '')")}) > 60 THEN 'words' END, CASE WHEN length(text) > 200 THEN 'characters' END, CASE WHEN strlen(text) > 350 THEN 'bytes' END], lambda x: x IS NOT NULL), ',') AS over,
    coalesce(len({tokens("coalesce(text, '')")}) <= 60 AND length(text) <= 200 AND strlen(text) <= 350, false) AS fits FROM documents"""
)
def token_budgets(t):
    c = F.col("text")
    return t("documents").select("doc_id", F.array_join(K.over_budget(c, _COUNT), ",").alias("over"), F.coalesce(K.within_all(c, _COUNT), F.lit(False)).alias("fits"))


@query("SELECT sample_id, created_ts, CASE WHEN length(reference) <= 40 THEN reference ELSE 'see source' END AS answer FROM build_p0a5_data")
def budget_fallback(t):
    return t("build_p0a5_data").select("sample_id", "created_ts", K.budgeted(F.col("reference"), F.lit("see source"), lambda c: F.length(c) <= 40).alias("answer"))


@query(f"SELECT sample_id, created_ts, CAST(2 + list_sum(list_transform(messages, lambda m: 4 + len({tokens("coalesce(m.content, '')")}))) AS BIGINT) AS tokens FROM train_p0a5_lora WHERE len(messages) > 0")
def chat_lengths(t):
    d = t("train_p0a5_lora").filter(F.size("messages") > 0)
    return d.select("sample_id", "created_ts", K.chat_length(F.col("messages"), K.proxy_tokens).alias("tokens"))


@query("SELECT 'math' AS view, count(*) AS n FROM train_p0a5_lora WHERE dataset_key = 'gsm8k' UNION ALL SELECT 'heavy', count(*) FROM train_p0a5_lora WHERE training_weight > 1.2")
def named_views(t):
    d, rules = t("train_p0a5_lora"), {"math": F.col("dataset_key") == "gsm8k", "heavy": F.col("training_weight") > 1.2, "all": F.lit(True)}
    one = lambda n: d.filter(K.views(rules, n)).agg(F.lit(n).alias("view"), F.count("*").alias("n"))
    return one("math").unionByName(one("heavy"))


# ---------------------------------------------------------------- extraction


@query(
    r"""WITH a AS (SELECT sample_id, created_ts, trim(CASE WHEN contains(answer, '####') THEN split_part(answer, '####', -1) END) AS tail FROM train_p0a5_lora WHERE answer IS NOT NULL)
    SELECT sample_id, created_ts, coalesce(regexp_full_match(tail, '\$?[-+]?(\d[\d,]*\.?\d*|\.\d+)([eE][-+]?\d+)?\.?'), false) AS canonical,
    CASE WHEN regexp_full_match(tail, '\$?[-+]?(\d[\d,]*\.?\d*|\.\d+)([eE][-+]?\d+)?\.?') THEN CAST(replace(regexp_replace(tail, '^\$|\.$', '', 'g'), ',', '') AS DOUBLE) END AS value FROM a"""
)
def strict_numbers(t):
    d = t("train_p0a5_lora").filter("answer is not null").select("sample_id", "created_ts", X.number(F.col("answer"), True).alias("n"))
    return d.select("sample_id", "created_ts", F.col("n.value").cast("double").alias("value"), "n.canonical")


@query(r"SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS price, CAST(l_discount AS DOUBLE) AS discount FROM lineitem")
def decimal_numbers(t):
    # a number written out in full and with an exponent has one form
    full = X.decimal_number(F.concat(F.lit(" +"), F.format_number(F.col("l_extendedprice").cast("double"), 4)))
    small = X.decimal_number(F.concat(F.regexp_replace(F.format_number(F.col("l_discount").cast("double") * 1000, 0), ",", ""), F.lit("e-3")))
    return t("lineitem").select("l_orderkey", "l_linenumber", full.cast("double").alias("price"), small.cast("double").alias("discount"))


@query(
    r"""SELECT sample_id, created_ts, nullif(regexp_extract(regexp_replace(upper(answer), '([^A-Z])', '\1\1', 'g'), '(?:^|[^A-Z])([A-D])(?:[^A-Z]|$)', 1), '') AS first FROM build_p0a32_train"""
)
def first_letters(t):
    return t("build_p0a32_train").select("sample_id", "created_ts", X.choice(F.col("answer"), "first").alias("first"))


@query("SELECT trace_id, created_ts, decision_tuple_json ->> '$.action' AS action, decision_tuple_json ->> '$.risk' AS risk FROM semantic_distill_trace")
def repaired_replies(t):
    # prose around the object, braces inside a string, and a comma before the last brace
    broken = F.concat(F.lit("Decision {see below}: "), F.regexp_replace("decision_tuple_json", r"\}\s*$", ', "note": "a } in text",}'), F.lit(" Done."))
    d = t("semantic_distill_trace").select("trace_id", "created_ts", X.repaired_json(broken).alias("j"))
    return d.select("trace_id", "created_ts", F.get_json_object("j", "$.action").alias("action"), F.get_json_object("j", "$.risk").alias("risk"))


@query("SELECT event_type, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS rank, count(*) AS n FROM events GROUP BY 1")
def enum_ranks(t):
    return t("events").groupBy("event_type", X.rank_of(F.col("event_type"), ["view", "click", "purchase"]).alias("rank")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, strftime(date_trunc('second', created_ts), '%Y-%m-%dT%H:%M:%SZ') AS at, round(n_chars / 1e6, 9) AS mb, round(n_chars / 1048576.0, 9) AS mib, abs(n_chars / 3.0 * 3.0 - n_chars) <= 1e-9 AS near FROM documents WHERE created_ts IS NOT NULL")
def units_and_times(t):
    d = t("documents").filter("created_ts is not null")
    n = F.col("n_chars").cast("double")
    seconds = F.floor(F.unix_micros(F.col("created_ts").cast("timestamp")) / 1e6)
    return d.select("doc_id", X.iso_time(seconds).alias("at"), F.round(X.megabytes(n), 9).alias("mb"), F.round(X.megabytes(n, True), 9).alias("mib"), X.near(n / 3 * 3, n, 1e-9).alias("near"))


@query("SELECT sample_id, created_ts, answer AS code, trim(answer) AS said FROM train_p0a5_lora WHERE dataset_key = 'opencodeinstruct' AND starts_with(answer, 'def ')")
def dedented_code(t):
    d = t("train_p0a5_lora").filter("dataset_key = 'opencodeinstruct' and startswith(answer, 'def ')")
    framed = F.concat(F.lit("<think>first\nlines</think>"), F.col("answer"), F.lit("<think>never closed"))
    return d.select("sample_id", "created_ts", T.dedented(F.regexp_replace("answer", r"(?m)^", "      ")).alias("code"), T.without_thinking(framed).alias("said"))


# ---------------------------------------------------------------- smaller functions


@query("SELECT p_partkey, sha256(lower(concat_ws(' ', p_name, p_brand, p_type))) AS identity FROM part")
def choice_identities(t):
    return t("part").select("p_partkey", T.choice_identity(F.col("p_name"), F.array("p_brand", "p_type")).alias("identity"))


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'D' WHEN 2 THEN 'C' WHEN 3 THEN 'B' END AS letter FROM part")
def choice_letters(t):
    said = F.get(F.array(*[F.lit(x) for x in (" 0", "3 ", "c", "Option b", "E", "")]), F.col("p_size") % 6)
    return t("part").select("p_partkey", X.choice_letter(said).alias("letter"))


@query("SELECT p_partkey, trim(p_name) AS bare FROM part")
def unframed_texts(t):
    framed = F.concat(F.lit("Sure! "), F.col("p_name"), F.lit(" Hope this helps."))
    return t("part").select("p_partkey", T.without_frame(framed, ["Sure!"], ["Hope this helps."]).alias("bare"))


@query("SELECT sample_id, created_ts, CASE WHEN len(domain) > 0 THEN array_to_string(domain, '|') END AS items FROM build_p0a5_data WHERE NOT coalesce(list_contains(list_transform(domain, lambda x: x IS NULL), true), false)")
def string_lists(t):
    d = t("build_p0a5_data").filter(~F.coalesce(F.exists("domain", lambda x: x.isNull()), F.lit(False)))
    return d.select("sample_id", "created_ts", F.array_join(X.string_list(F.to_json("domain")), "|").alias("items"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS value FROM part")
def synonymous_fields(t):
    m = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit(" Title "), F.col("p_name"), F.lit("brand"), F.col("p_brand"))).otherwise(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("x"), F.lit("y")))
    return t("part").select("p_partkey", X.first_field(m, ["title", "brand"]).alias("value"))


@query("SELECT trace_id, created_ts, coalesce(regexp_full_match(sample_hash, '[0-9a-f]{64}'), false) AS plain FROM semantic_distill_trace")
def plain_digests(t):
    from ..operators.quality import is_sha256

    return t("semantic_distill_trace").select("trace_id", "created_ts", is_sha256(F.col("sample_hash")).alias("plain"))


@query("SELECT sample_id, created_ts, CASE WHEN len(l) = 1 THEN l[1] END AS label FROM (SELECT sample_id, created_ts, list_distinct(list_concat(regexp_extract_all(upper(answer), '答案[:：]\\s*([A-D])', 1), regexp_extract_all(upper(answer), '([A-D])$', 1))) AS l FROM build_p0a32_train)")
def unanimous_labels(t):
    return t("build_p0a32_train").select("sample_id", "created_ts", X.unanimous_label(F.col("answer"), [r"答案[:：]\s*([A-D])", r"([A-D])$"]).alias("label"))


@query("SELECT trace_id, created_ts, decision_tuple_json ->> '$.action' AS action FROM semantic_distill_trace")
def fenced_json(t):
    reply = F.concat(F.lit("Here:\n```json\n"), F.col("decision_tuple_json"), F.lit("\n```\nDone."))
    return t("semantic_distill_trace").select("trace_id", "created_ts", X.json_field(reply, "$.action").alias("action"))
