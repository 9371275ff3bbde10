"""Queries over scoring, audits, gates and the flows that build sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import decision, gates, joins, quality, quotas, scoring, windows
from ..streaming import outbox
from . import builders as B
from .registry import hash_order, query, squash

# ---------------------------------------------------------------- scoring

_STRICT = r"nullif(regexp_extract(trim(split_part(regexp_replace(coalesce(answer, ''), '\s+$', ''), chr(10), -1)), '^最终答案：([A-D])$', 1), '')"


@query(f"SELECT sample_id, created_ts, domain, CASE WHEN domain IN ('nlp', 'exam') THEN coalesce({_STRICT} = answer_letter, false) END AS correct, CASE WHEN domain IN ('nlp', 'exam') THEN {_STRICT} IS NOT NULL END AS canonical FROM build_p0a32_train")
def choice_scores(t):
    d = t("build_p0a32_train").withColumn("k", F.struct("sample_id", "created_ts"))
    s = scoring.score(d, "k", "domain", "answer", "answer_letter", {"nlp": "choice", "exam": "choice"}, strict=True)
    return s.select("k.sample_id", "k.created_ts", "domain", "correct", "canonical")


@query(
    r"""WITH a AS (SELECT sample_id, created_ts, dataset_key AS domain, trim(CASE WHEN contains(answer, '####') THEN split_part(answer, '####', -1) END) AS tail, coalesce(answer, '') AS r FROM train_p0a5_lora WHERE dataset_key IN ('gsm8k', 'cmmlu')),
    n AS (SELECT *, coalesce(regexp_full_match(tail, '\$?[-+]?(\d[\d,]*\.?\d*|\.\d+)([eE][-+]?\d+)?\.?'), false) AS good FROM a)
    SELECT sample_id, created_ts, domain, CASE WHEN domain = 'gsm8k' THEN good AND len(regexp_extract_all(r, '\d')) > 0 ELSE true END AS correct, CASE WHEN domain = 'gsm8k' THEN good ELSE r <> '' END AS canonical FROM n"""
)
def response_scores(t):
    # each answer against itself: a number counts only behind its mark, a text always
    d = t("train_p0a5_lora").filter("dataset_key in ('gsm8k', 'cmmlu')").select(F.struct("sample_id", "created_ts").alias("k"), "dataset_key", "answer", F.coalesce("answer", F.lit("")).alias("reference"))
    s = scoring.score(d, "k", "dataset_key", "answer", "reference", {"gsm8k": "number", "cmmlu": "text"}, strict=True)
    return s.select("k.sample_id", "k.created_ts", F.col("dataset_key").alias("domain"), "correct", "canonical")


@query()
def code_scores(t):
    """Runs code answers in the limited interpreter against a test of their own function; without SQL."""
    d = t("train_p0a5_lora").filter("dataset_key = 'opencodeinstruct' and answer is not null").groupBy("sample_id").agg(F.max_by("answer", F.struct("created_ts", "answer")).alias("answer"))
    name = F.regexp_extract("answer", r"def (\w+)\(", 1)
    d = d.filter(name != "").select("sample_id", F.lit("code").alias("domain"), "answer", F.lit("").alias("reference"), F.array(F.concat(F.lit("assert callable("), name, F.lit(")"))).alias("tests"))
    return scoring.score(d, "sample_id", "domain", "answer", "reference", {"code": "code"}, "tests").select("sample_id", "correct")


@query("SELECT e.event_id, e.event_type, r.v AS response FROM events e LEFT JOIN (SELECT event_id, event_type, value AS v FROM events WHERE event_type IN ('click', 'view')) r ON r.event_id = e.event_id")
def routed_outputs(t):
    e = t("events")
    routes = t("region").sparkSession.createDataFrame([("click", "a"), ("view", "b"), ("refund", "c")], "event_type string, model string")
    outputs = e.select("event_id", F.when(F.col("event_type") == "click", "a").when(F.col("event_type") == "view", "b").otherwise("z").alias("model"), F.col("value").alias("response"))
    return scoring.routed(e.select("event_id", "event_type"), routes, outputs, "event_id", "event_type", "model").select("event_id", "event_type", "response")


@query("SELECT sample_id, created_ts, CASE WHEN coalesce(human_verified, false) AND reference IS NOT NULL THEN reference ELSE prompt END AS answer, CASE WHEN coalesce(human_verified, false) AND reference IS NOT NULL THEN 'generated' WHEN prompt IS NOT NULL THEN 'given' END AS answer_from FROM build_p0a5_data")
def verified_answers(t):
    d = t("build_p0a5_data").select("sample_id", "created_ts", "prompt", "reference", "human_verified")
    return scoring.verified_or(d, "reference", "prompt", "human_verified").select("sample_id", "created_ts", "answer", "answer_from")


@query(
    """SELECT user_id, round((min(epoch_us(ts)) FILTER (event_type <> 'view') - min(epoch_us(ts))) / 1000.0, 3) AS first_event_ms, round((min(epoch_us(ts)) FILTER (event_type = 'purchase') - min(epoch_us(ts))) / 1000.0, 3) AS first_token_ms,
    count(*) FILTER (event_type <> 'view') AS events FROM events GROUP BY 1"""
)
def token_latency(t):
    said = F.when(F.col("event_type") == "purchase", "token").when(F.col("event_type") != "view", "")
    e = t("events").select("user_id", said.alias("text"), F.col("ts").cast("timestamp").alias("ts"))
    s = scoring.first_token_latency(e, "user_id", "text", "ts")
    return s.select("user_id", F.round("first_event_ms", 3).alias("first_event_ms"), F.round("first_token_ms", 3).alias("first_token_ms"), "events")


# ---------------------------------------------------------------- counts and checksums


@query("SELECT source, count(*) AS rows, count(*) FILTER (coalesce(length(repair_trace_json), 0) > 0) AS errors FROM (SELECT lower(trim(source_dataset)) AS source, repair_trace_json FROM semantic_distill_trace) GROUP BY 1")
def error_counts(t):
    d = t("semantic_distill_trace").select(F.lower(F.trim("source_dataset")).alias("source"), "repair_trace_json")
    return A.error_count(d, ["source"], "repair_trace_json")


@query(
    """WITH b AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS a, bool_or(l_quantity > 45) AS s FROM lineitem GROUP BY 1)
    SELECT count(*) AS events, count(*) FILTER (a > 1) AS conflicts, count(*) FILTER (a > 1 AND NOT s) AS unresolved, round(count(*) FILTER (a > 1 AND NOT s) * 1.0 / count(*), 6) AS unresolved_share,
    round(coalesce(count(*) FILTER (a > 1 AND s) * 1.0 / nullif(count(*) FILTER (a > 1), 0), 1), 6) AS resolved_share FROM b"""
)
def resolution_metrics(t):
    d = t("lineitem").select("l_orderkey", "l_returnflag", (F.col("l_quantity") > 45).alias("settled"))
    out = A.resolution_metrics(d, "l_orderkey", "l_returnflag", "settled")
    return out.withColumns({c: F.round(c, 6) for c in ("unresolved_share", "resolved_share")})


@query(
    """WITH h AS (SELECT n_regionkey, n_nationkey, sha256(concat_ws(chr(1), CAST(n_nationkey AS VARCHAR), n_name)) AS h, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS r FROM nation),
    p AS (SELECT n_regionkey, r // 3 AS p, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY r) || chr(10)) AS h FROM h GROUP BY 1, 2)
    SELECT n_regionkey, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(h, chr(10) ORDER BY p)) AS checksum FROM p GROUP BY 1"""
)
def ordered_checksums(t):
    return A.row_checksum(t("nation").select("n_regionkey", "n_nationkey", "n_name"), ["n_regionkey"], ["n_nationkey", "n_name"], ["n_nationkey"], 3)


@query(
    """WITH d AS (SELECT lang, coalesce(source, '') AS source, doc_id, n_chars, created_ts FROM documents WHERE lang IS NOT NULL)
    SELECT lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, max(created_ts) AS newest, list_sort(list(doc_id))[1:3]::VARCHAR AS samples,
    (SELECT string_agg(s || '=' || n, ',' ORDER BY s) FROM (SELECT source AS s, count(*) AS n FROM d x WHERE x.lang = d.lang GROUP BY 1)) AS extensions FROM d GROUP BY lang"""
)
def file_inventory(t):
    d = t("documents").filter("lang is not null").select("lang", F.coalesce("source", F.lit("")).alias("source"), "doc_id", "n_chars", "created_ts")
    out = A.inventory(d, "lang", "doc_id", "source", "n_chars", "created_ts")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("extensions")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("lang", "files", "bytes", "newest", shown.alias("extensions"), F.concat(F.lit("["), F.array_join("samples", ", "), F.lit("]")).alias("samples"))


# ---------------------------------------------------------------- gates

_KEPT = """WITH p AS (SELECT trace_id, lower(trim(any_value(source_dataset))) AS source, bool_or(coalesce(CAST(student_probe_trace_json ->> '$.correct' AS BOOLEAN), false)) AS b,
    bool_or(coalesce(CAST(student_probe_trace_json ->> '$.correct' AS BOOLEAN), false) AND coalesce(CAST(quant_behavior_trace_json ->> '$.drift' AS DOUBLE) < 0.1, false)) AS s FROM semantic_distill_trace GROUP BY 1),
    g AS (SELECT source, least(coalesce(count(*) FILTER (s) * 1.0 / nullif(count(*) FILTER (b), 0), 0), 1) AS capped FROM p GROUP BY 1)"""


def _kept(t):
    correct = F.coalesce(F.get_json_object("student_probe_trace_json", "$.correct").cast("boolean"), F.lit(False))
    drift = F.get_json_object("quant_behavior_trace_json", "$.drift").cast("double")
    d = t("semantic_distill_trace").groupBy("trace_id").agg(F.lower(F.trim(F.max("source_dataset"))).alias("source"), F.max(correct).alias("b"), F.max(correct & F.coalesce(drift < 0.1, F.lit(False))).alias("s"))
    return A.retention(d.select("trace_id", "source", F.col("b").alias("correct")), d.select("trace_id", "source", F.col("s").alias("correct")), "trace_id", "source", "correct")


@query(_KEPT + " SELECT count(*) AS groups, round(min(capped), 6) AS least_ratio, round(avg(capped), 6) AS macro, min(capped) >= 0.2 AND avg(capped) >= 0.4 AS passed FROM g")
def full_retention_gate(t):
    return gates.full_gate(_kept(t), "capped", 0.2, 0.4).withColumns({c: F.round(c, 6) for c in ("least_ratio", "macro")})


@query(_KEPT + " SELECT source, CASE WHEN NOT capped >= 0.3 THEN 'reject' WHEN NOT capped >= 0.5 THEN 'candidate' ELSE 'full' END AS decision FROM g")
def gate_levels(t):
    return gates.three_levels(_kept(t), F.col("capped") >= 0.3, F.col("capped") >= 0.5).select("source", "decision")


_VARIANT = "WITH v AS (SELECT event_type AS name, avg(value) AS acc, count(*) FILTER (value > 1) * 1.0 / count(*) AS canon FROM events GROUP BY 1)"


def _variants(t):
    return t("events").groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("acc"), (F.count_if(F.col("value") > 1) / F.count("*")).alias("canon"))


@query(_VARIANT + " SELECT name, round(acc, 6) AS acc FROM v WHERE acc - (SELECT min(acc) FROM v) >= 0.0001 AND canon >= 0.5 ORDER BY acc DESC, name LIMIT 1")
def better_variants(t):
    v = _variants(t)
    base = v.agg(F.min("acc").alias("acc"))
    return gates.better_variant(v, base, "acc", "canon", 0.0001, 0.5, [F.col("acc").desc(), F.col("name")]).select("name", F.round("acc", 6).alias("acc"))


_MODE = "WITH m AS (SELECT l_linenumber AS candidate, l_returnflag AS item, count(*) AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT item, v FROM m WHERE candidate = 3)"


def _modes(t):
    m = t("lineitem").groupBy(F.col("l_linenumber").alias("candidate"), F.col("l_returnflag").alias("item")).agg(F.count("*").alias("v"))
    return m, m.filter("candidate = 3")


@query(_MODE + " SELECT candidate, max(m.v - b.v) FILTER (item = 'A') AS gain_a, max(m.v - b.v) FILTER (item = 'R') AS gain_r, coalesce(max(m.v - b.v) FILTER (item = 'A') >= 3 AND max(m.v - b.v) FILTER (item = 'R') >= -50, false) AS passed FROM m JOIN b USING (item) GROUP BY 1")
def non_inferiority(t):
    out = gates.non_inferior(*_modes(t), "candidate", "item", "v", {"A": 3, "R": -50})
    return out.select("candidate", F.col("gains")[0].alias("gain_a"), F.col("gains")[1].alias("gain_r"), "passed")


@query(
    """WITH b AS (SELECT count(*) AS steps, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS best_step FROM orders)
    SELECT steps, best_step, (SELECT count(*) FROM orders WHERE o_orderkey > best_step) AS after_best, CASE WHEN (SELECT count(*) FROM orders WHERE o_orderkey > best_step) < 100000 THEN 'too_early' ELSE '' END AS problems FROM b"""
)
def early_stop(t):
    out = gates.stopped_early(t("orders"), "o_orderkey", "o_totalprice", 100000)
    return out.withColumn("problems", F.array_join("problems", ","))


@query("WITH m AS (SELECT l_linenumber AS c, count(*) AS k, abs(avg(l_discount) - 0.05) AS off, avg(l_discount) AS scale FROM lineitem GROUP BY 1) SELECT c FROM m ORDER BY k DESC, off, scale, c LIMIT 1")
def best_scale(t):
    m = t("lineitem").groupBy(F.col("l_linenumber").alias("c")).agg(F.count("*").alias("k"), F.avg("l_discount").alias("scale"))
    return gates.pick_best(m, [F.col("k").desc(), F.abs(F.col("scale") - 0.05), F.col("scale"), F.col("c")]).select("c")


@query("SELECT o_orderpriority AS task, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS step FROM orders GROUP BY 1")
def least_loss_steps(t):
    o = t("orders").select(F.col("o_orderpriority").alias("task"), F.col("o_orderkey").alias("step"), "o_totalprice")
    return gates.pick_best(o, [F.col("o_totalprice"), F.col("step")], ["task"]).select("task", "step")


@query("WITH m AS (SELECT l_linenumber AS c, l_returnflag AS task, count(*) AS k FROM lineitem GROUP BY 1, 2) SELECT task, arg_min(c, (-k, list_position([3, 1, 2], c), c)) AS c FROM m GROUP BY 1")
def declared_order_best(t):
    from ..functions.extract import rank_of

    m, _ = _modes(t)
    place = rank_of(F.col("candidate"), [3, 1, 2], 99)
    return gates.pick_best(m, [F.col("v").desc(), place, F.col("candidate")], ["item"]).select(F.col("item").alias("task"), F.col("candidate").alias("c"))


# ---------------------------------------------------------------- audits


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))) AS only_left, (SELECT count(*) FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)) AS only_right, false AS equal")
def set_equality(t):
    return quality.same_sets(t("orders").select(F.col("o_custkey").alias("k")), t("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


@query(
    """WITH r AS (SELECT sample_id, created_ts, metadata, training_weight FROM train_p0a5_lora)
    SELECT sample_id, problem FROM (SELECT sample_id, unnest(list_filter([CASE WHEN metadata.nlp_category IS NULL THEN 'missing metadata.nlp_category' END, CASE WHEN metadata.answer_from NOT IN ('human') THEN 'value metadata.answer_from' END,
    CASE WHEN training_weight < 0 OR training_weight <> floor(training_weight) THEN 'number training_weight' END], lambda x: x IS NOT NULL)) AS problem FROM r)"""
)
def nested_checks(t):
    d = t("train_p0a5_lora")
    return quality.nested_problems(d, "sample_id", ["metadata.nlp_category"], {"metadata.answer_from": ["human"]}, ["training_weight"])


@query(
    """SELECT 'config' AS problem, 'total' AS what FROM category_target WHERE target_permille > 200 UNION ALL SELECT 'digest', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 2 = 1 AND text IS NOT NULL UNION ALL
    SELECT 'overlap', a || '/' || b FROM (SELECT DISTINCT x.s AS a, y.s AS b FROM (SELECT DISTINCT sample_hash AS k, lower(trim(split)) AS s FROM semantic_distill_trace WHERE sample_hash IS NOT NULL AND split IS NOT NULL) x JOIN (SELECT DISTINCT sample_hash AS k, lower(trim(split)) AS s FROM semantic_distill_trace WHERE sample_hash IS NOT NULL AND split IS NOT NULL) y ON x.k = y.k AND x.s < y.s)"""
)
def protocol_audit(t):
    x = F.col("text")
    files = t("documents").filter("text is not null").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 1, F.lit("?")).otherwise(F.sha2(x, 256)).alias("stated"))
    splits = t("semantic_distill_trace").select("sample_hash", F.lower(F.trim("split")).alias("split"))
    return quality.config_problems(t("category_target"), [("total", F.col("target_permille") > 200)], files, "doc_id", "stated", "text", splits, "sample_hash", "split")


@query(
    """WITH r AS (SELECT lang, count(*) AS n, count(*) FILTER (coalesce(n_chars > 500, false)) AS c FROM documents WHERE lang IS NOT NULL GROUP BY 1), a AS (SELECT lang, n + CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS rows, c AS correct_rows, round(c * 1.0 / n, 3) AS accuracy, n, c FROM r WHERE lang <> 'de')
    SELECT lang, 'not_audited' AS problem FROM r WHERE lang = 'de' UNION ALL SELECT lang, 'rows' FROM a WHERE rows <> n UNION ALL SELECT lang, 'accuracy' FROM a WHERE abs(accuracy - c * 1.0 / n) > 1e-9"""
)
def audit_checks(t):
    d = t("documents").filter("lang is not null").select("lang", (F.col("n_chars") > 500).alias("ok"))
    real = A.accuracy(d, ["lang"], "ok").filter("lang <> 'de'")
    audit = real.select("lang", (F.col("rows") + (F.col("lang") == "en").cast("int")).alias("rows"), "correct_rows", F.round("accuracy", 3).alias("accuracy"))
    return quality.audit_differences(d, audit, "lang", "ok")


@query("SELECT e.name, coalesce(n, 0) AS files, coalesce(n, 0) > 0 AS present FROM (SELECT n_name AS name FROM nation UNION ALL SELECT 'en') e LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) d ON d.lang = e.name")
def dataset_presence(t):
    want = t("nation").select(F.col("n_name").alias("name")).unionByName(t("region").limit(1).select(F.lit("en").alias("name")))
    return quality.presence(want, t("documents").select(F.col("lang").alias("name")), "name")


@query("SELECT dataset_key, n AS expected, 0 AS actual FROM (VALUES ('absent', 3)) v(dataset_key, n) UNION ALL SELECT dataset_key, 0, count(*) FROM train_p0a5_lora WHERE dataset_key IS NOT NULL GROUP BY 1")
def count_checks(t):
    return quality.count_problems(t("train_p0a5_lora").filter("dataset_key is not null"), "dataset_key", {"absent": 3}).select("dataset_key", "expected", "actual")


@query(f"SELECT item_id FROM eval_item WHERE {squash('text')} <> '' AND {squash('text')} IN (SELECT {squash('text')} FROM documents)")
def leaking_rows(t):
    return quality.leaking(t("documents"), t("eval_item"), T.squash, "text", "text").select("item_id")


# ---------------------------------------------------------------- logs


@query(
    """WITH e AS (SELECT user_id, props AS k, min(event_id) AS at FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2), h AS (SELECT user_id, event_id FROM events WHERE event_type = 'purchase')
    SELECT e.user_id, e.k, coalesce((SELECT min(h.event_id) FROM h WHERE h.user_id = e.user_id AND h.event_id > e.at), -1) AS sent_at FROM e"""
)
def recovery_flush(t):
    kind = F.when(F.col("event_type") == "purchase", "recover").when(F.col("event_type").isin("click", "view"), "enqueue").otherwise("other")
    return outbox.flush_fold(t("events").select("user_id", F.col("props").alias("k"), kind.alias("kind"), "event_id"), "user_id", "k", "kind", "event_id").fillna(-1, ["sent_at"])


# ---------------------------------------------------------------- flows that build sets

_H = hash_order(21, "doc_id")


@query(
    f"""WITH h AS (SELECT doc_id FROM documents WHERE n_chars BETWEEN 1 AND 300 ORDER BY {_H}, doc_id LIMIT 40)
    SELECT doc_id, 'held_out' AS role FROM h UNION ALL SELECT doc_id, 'train' FROM documents WHERE n_chars BETWEEN 1 AND 2000 AND doc_id NOT IN (SELECT doc_id FROM h)"""
)
def two_budgets(t):
    d = t("documents").select("doc_id", "n_chars")
    fits = lambda top: (F.col("n_chars") >= 1) & (F.col("n_chars") <= top)
    return B.budget_hold_out(d, "doc_id", [H.stable_key(21, "doc_id"), F.col("doc_id")], fits(300), fits(2000), 40)


@query("SELECT p_partkey, CAST(regexp_extract(p_name, '^\\D*(\\d+)', 1) AS BIGINT) AS number FROM part WHERE regexp_matches(p_name, '^\\D*\\d+') AND p_size % 2 = 1")
def numbered_prompts(t):
    n = F.regexp_extract("p_name", r"^\D*(\d+)", 1)
    return t("part").filter((F.col("p_size") % 2 == 1) & F.col("p_name").rlike(r"^\D*\d+")).select("p_partkey", n.cast("bigint").alias("number"))


@query(
    """WITH b AS (SELECT sample_id, created_ts, list_distinct(list_concat(list_transform(coalesce(domain, []), lambda x: 'assert ' || x), list_transform(coalesce(task_type.major, []), lambda x: CASE WHEN length(x) > 2 THEN x ELSE 'assert ' || x END))) AS b, domain, task_type.major AS m FROM build_p0a5_data)
    SELECT sample_id, created_ts, CASE WHEN len(b) >= 2 AND len(list_filter(b, lambda x: NOT starts_with(x, 'assert '))) = 0 THEN len(b) ELSE 0 END AS tests FROM b
    WHERE len(list_filter(coalesce(domain, []), lambda x: x IS NULL)) = 0 AND len(list_filter(coalesce(m, []), lambda x: x IS NULL)) = 0"""
)
def joined_tests(t):
    none = lambda c: F.coalesce(F.exists(c, lambda x: x.isNull()), F.lit(False))
    d = t("build_p0a5_data").filter(~none(F.col("domain")) & ~none(F.col("task_type.major")))
    first = F.transform("domain", lambda x: F.concat(F.lit("assert "), x))
    second = F.transform("task_type.major", lambda x: F.when(F.length(x) > 2, x).otherwise(F.concat(F.lit("assert "), x)))
    return d.select("sample_id", "created_ts", F.coalesce(F.size(B.joined_tests(first, second, least=2)), F.lit(0)).cast("long").alias("tests"))


@query("SELECT sample_id, created_ts, array_to_string(list_transform(domain, lambda x: 'import re' || chr(10) || x), '|') AS tests FROM build_p0a5_data")
def tests_with_setup(t):
    return t("build_p0a5_data").select("sample_id", "created_ts", F.array_join(B.with_setup(F.col("domain"), F.lit("import re")), "|").alias("tests"))


_FRESH = f"""WITH d AS (SELECT doc_id, {squash("text")} AS f FROM documents WHERE doc_id > 200), h AS (SELECT doc_id, {squash("text")} AS f FROM documents WHERE doc_id <= 260), o AS (SELECT {squash("text")} AS f FROM eval_item),
    j AS (SELECT doc_id, f, CASE WHEN doc_id IN (SELECT doc_id FROM h) THEN 'seen_id' WHEN f IN (SELECT f FROM h WHERE f IS NOT NULL) THEN 'seen_prompt' WHEN f IN (SELECT f FROM o WHERE f IS NOT NULL) THEN 'other_source' END AS r FROM d WHERE f IS NOT NULL)"""


@query(_FRESH + " SELECT doc_id, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY f, r IS NULL ORDER BY doc_id) > 1 THEN 'duplicate' ELSE r END AS reason FROM j")
def fresh_remainder(t):
    d = t("documents").filter("text is not null").select("doc_id", "text")
    return B.fresh_only(d.filter("doc_id > 200"), "doc_id", "text", d.filter("doc_id <= 260"), t("eval_item").select("text"), ["doc_id"]).select("doc_id", "reason")


@query("SELECT k, arg_max(v, p) AS v FROM (SELECT s_suppkey AS k, s_name AS v, 0 AS p FROM supplier UNION ALL SELECT p_partkey, p_name, 1 FROM part WHERE p_size < 20 UNION ALL SELECT p_partkey, p_brand, 2 FROM part WHERE p_size < 5) GROUP BY 1")
def cache_phases(t):
    part = lambda top, v: t("part").filter(F.col("p_size") < top).select(F.col("p_partkey").alias("k"), F.col(v).alias("v"))
    return B.cached_phases([t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), part(20, "p_name"), part(5, "p_brand")], "k")


@query("SELECT n_nationkey FROM nation")
def unique_prompts(t):
    return B.strict_unique(t("nation"), T.squash("n_name"), "name").select("n_nationkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_totalprice > 1000")
def validation_remainder(t):
    o = t("orders").filter("o_totalprice > 1000").select("o_orderkey")
    return B.remainder(o, o.filter("o_orderkey % 3 = 0"), t("orders").filter("o_orderkey < 0"), "o_orderkey")


@query("SELECT k, greatest(2.0, coalesce(arg_min(w, o), 0)) AS weight FROM (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS w, 0 AS o FROM part WHERE p_size > 10 UNION ALL SELECT s_suppkey, CAST(s_nationkey AS DOUBLE), 1 FROM supplier) GROUP BY 1")
def floored_weights(t):
    fresh = t("part").filter("p_size > 10").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("weight"))
    return B.floored_mix(fresh, t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("double").alias("weight")), "k", "weight", 2.0)


@query("SELECT event_id, CASE WHEN a::INT + b::INT + c::INT = 1 THEN CASE WHEN a THEN 'a' WHEN b THEN 'b' ELSE 'c' END END AS role, CASE a::INT + b::INT + c::INT WHEN 0 THEN 'none' WHEN 1 THEN NULL ELSE 'several' END AS role_problem FROM (SELECT event_id, value > 10 AS a, value < 2 AS b, event_type = 'view' AS c FROM events)")
def role_flags(t):
    e = t("events").select("event_id", (F.col("value") > 10).alias("a"), (F.col("value") < 2).alias("b"), (F.col("event_type") == "view").alias("c"))
    return B.exclusive_roles(e, ["a", "b", "c"]).select("event_id", "role", "role_problem")


@query(
    f"""WITH p AS (SELECT doc_id, {squash("text")} AS f FROM documents WHERE text IS NOT NULL AND NOT contains(lower(text), 'salt tax') AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 17 = 0)),
    o AS (SELECT doc_id FROM p QUALIFY row_number() OVER (PARTITION BY f ORDER BY {_H}, doc_id) = 1), r AS (SELECT doc_id, row_number() OVER (ORDER BY {_H}, doc_id) AS r FROM o)
    SELECT doc_id, CASE WHEN r <= 50 THEN 'validation' WHEN r <= 90 THEN 'held_out' ELSE 'train' END AS role FROM r"""
)
def isolated_roles(t):
    d = t("documents").select("doc_id", "text").filter("text is not null")
    return B.isolated_split(d, "doc_id", T.squash("text"), [H.stable_key(21, "doc_id")], [("validation", 50), ("held_out", 40)], "train", d.filter("doc_id % 17 = 0").select("doc_id"), F.contains(F.lower("text"), F.lit("salt tax")))


@query("SELECT stage, problem, count(*) AS n FROM (SELECT CASE WHEN lang IN ('zh') THEN 'second' WHEN lang IN ('en', 'de') THEN 'first' END AS stage, CASE WHEN lang IS NULL OR lang NOT IN ('zh', 'en', 'de') THEN 'no_stage' WHEN coalesce(trim(text), '') = '' THEN 'no_content' WHEN contains(lower(text), 'signal') THEN 'marker' END AS problem FROM documents) GROUP BY 1, 2")
def staged_rows(t):
    out = B.staged(t("documents"), "lang", {"first": ["en", "de"], "second": ["zh"]}, F.col("text"), F.contains(F.lower("text"), F.lit("signal")))
    return out.groupBy("stage", "problem").agg(F.count("*").alias("n"))


@query(
    f"""WITH u AS (SELECT 0 AS s, item_id AS k, {squash("text")} AS f FROM eval_item UNION ALL SELECT 1, doc_id, {squash("text")} FROM documents),
    o AS (SELECT * FROM u WHERE f IS NOT NULL QUALIFY row_number() OVER (PARTITION BY f ORDER BY s, k) = 1) SELECT k FROM o ORDER BY s, k LIMIT 400"""
)
def first_over_sources(t):
    a, b = t("eval_item").select(F.col("item_id").alias("k"), "text"), t("documents").select(F.col("doc_id").alias("k"), "text")
    return B.first_over_sources([a, b], T.squash("text"), "k", [], 400).select("k")


@query("WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1) SELECT user_id, last = 'error' AS archived FROM l")
def resume_rows(t):
    keep, gone = B.resume_without(t("events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return keep.select("user_id", F.lit(False).alias("archived")).unionByName(gone.select("user_id", F.lit(True).alias("archived")))


@query("SELECT what, problem FROM (SELECT CAST(count(*) AS VARCHAR) AS what, 'rows' AS problem FROM nation WHERE n_regionkey = 1)")
def gate_view_problems(t):
    return B.gate_view(t("nation"), F.col("n_regionkey") == 1, {"split": F.lit("gate")}, "n_nationkey", 0)[1]


@query(
    f"""WITH d AS (SELECT domain, sample_id, answer FROM (SELECT coalesce(domain, '-') AS domain, sample_id, coalesce(domain, '-') || answer AS answer FROM build_p0a32_train WHERE sample_id IS NOT NULL AND answer IS NOT NULL)),
    o AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY domain, answer ORDER BY sample_id) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY sample_id, answer) AS r FROM o)
    SELECT sample_id, domain, CASE WHEN r <= 5 THEN 'validation' ELSE 'train' END AS role FROM r WHERE domain = 'nlp' AND r <= 25"""
)
def domain_quotas(t):
    d = t("build_p0a32_train").filter("sample_id is not null and answer is not null").select("sample_id", F.coalesce("domain", F.lit("-")).alias("domain"), "answer")
    d = d.withColumn("answer", F.concat("domain", "answer"))
    out = B.quota_per_domain(d, "domain", F.col("answer"), "sample_id", ["sample_id", "answer"], {"nlp": [("validation", 5), ("train", 20)]})
    return out.select("sample_id", "domain", "role")


@query(f"SELECT sample_id, created_ts FROM build_p0a32_train WHERE NOT coalesce({_STRICT} = answer_letter, false)")
def mined_failures(t):
    d = t("build_p0a32_train").select(F.struct("sample_id", "created_ts").alias("k"), F.lit("c").alias("domain"), "answer", "answer_letter")
    return scoring.score(d, "k", "domain", "answer", "answer_letter", {"c": "choice"}, strict=True).filter("not correct").select("k.sample_id", "k.created_ts")


@query("WITH s AS (SELECT coalesce(lang, '-') AS g, count(*) AS n FROM documents GROUP BY 1) SELECT g, row_number() OVER (ORDER BY n * 1.0 / 100, g) AS place FROM s")
def scarcest_groups(t):
    have = quotas.group_sizes(t("documents").select(F.coalesce("lang", F.lit("-")).alias("g")), "g")
    order = quotas.scarcest_first(have, dict.fromkeys(have, 100))
    return t("region").sparkSession.createDataFrame([(g, i) for i, g in enumerate(order, 1)], "g string, place long")


@query("SELECT user_id, max(value) AS value, count(*) AS candidates, count(DISTINCT event_type) > 1 AS disagree FROM events GROUP BY 1")
def arbitrated_flags(t):
    e = t("events").select("user_id", "value", "ts", "event_id", "event_type")
    return windows.arbitrate(e, "user_id", ["value", "ts", "event_id"], "event_type").select("user_id", "value", "candidates", "disagree")


# ---------------------------------------------------------------- lookups and decisions


@query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS ordinal, o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000")
def records_in_order(t):
    o = t("orders")
    ids = windows.global_rank(o.filter("o_totalprice > 100000").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], "ordinal").select("ordinal", "o_orderkey")
    return joins.in_given_order(ids, o.select("o_orderkey", "o_custkey"), "o_orderkey", "ordinal").select("ordinal", "o_orderkey", "o_custkey")


@query("SELECT o_orderkey AS place, o_custkey, o_totalprice FROM orders")
def zipped_rows(t):
    o = t("orders").withColumn("place", F.col("o_orderkey"))
    return joins.zipped(o.select("place", "o_custkey"), o.select("place", "o_custkey", "o_totalprice"), "place", "o_custkey").select("place", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderkey % 4 = 0 AS cached FROM orders")
def cached_results(t):
    o = t("orders").select("o_orderkey")
    hits, misses = joins.hits_and_misses(o, o.filter("o_orderkey % 4 = 0").withColumn("r", F.lit(1)), "o_orderkey")
    return hits.select("o_orderkey", F.lit(True).alias("cached")).unionByName(misses.select("o_orderkey", F.lit(False).alias("cached")))


@query("SELECT 'no_such_table' AS name")
def missing_tables(t):
    r = t("region")
    r.createOrReplaceTempView("loom_region")
    spark = r.sparkSession
    return spark.createDataFrame([(n,) for n in quality.missing_tables(spark, ["loom_region", "no_such_table"])], "name string")


@query("WITH c AS (SELECT sample_id, created_ts, unnest(regexp_extract_all(answer, '([A-Za-z_]\\w*)\\s*\\(', 1)) AS name FROM train_p0a5_lora WHERE dataset_key = 'opencodeinstruct'), n AS (SELECT sample_id, name, count(*) AS calls FROM c GROUP BY 1, 2) SELECT sample_id, arg_min(name, (-calls, name)) AS name, max(calls) AS calls FROM n GROUP BY 1")
def most_called(t):
    return A.most_called(t("train_p0a5_lora").filter("dataset_key = 'opencodeinstruct'"), "sample_id", "answer")


@query("SELECT event_id, CASE WHEN value > 10 THEN value ELSE 0.5 END AS latency, coalesce(value <= 10, true) AS latency_fallback FROM events")
def fallbacks(t):
    e = t("events").select("event_id", F.when(F.col("value") > 10, F.col("value")).alias("far"), F.lit(0.5).cast("double").alias("near"))
    return decision.with_fallback(e, "far", "near", "latency").select("event_id", "latency", "latency_fallback")


@query("SELECT count(*) AS requests, count(*) FILTER (i % 7 = 0) AS weak, count(*) FILTER (i % 3 = 0) AS far, true AS unit FROM range(5000) r(i)")
def simulated_requests(t):
    r = decision.simulate_requests(t("region").sparkSession, 5000, 7, 3)
    unit = F.bool_and((F.col("confidence") >= 0) & (F.col("confidence") < 1) & (F.col("risk") >= 0) & (F.col("risk") < 1))
    return r.agg(F.count("*").alias("requests"), F.count_if("weak").alias("weak"), F.count_if("far").alias("far"), unit.alias("unit"))


@query("SELECT lang, array_to_string(list_filter([CASE WHEN n < 100 THEN 'few' END, CASE WHEN c < 300000 THEN 'short' END], lambda x: x IS NOT NULL), ',') AS failures, n >= 100 AND c >= 300000 AS passed FROM (SELECT lang, count(*) AS n, sum(n_chars) AS c FROM documents WHERE lang IS NOT NULL GROUP BY 1)")
def metric_checks(t):
    by = t("documents").filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    return gates.checks(by, [("few", F.col("n") < 100), ("short", F.col("c") < 300000)]).select("lang", F.array_join("failures", ",").alias("failures"), "passed")


_EVENT_ACTION = "CASE WHEN value >= 40 THEN 'stop' WHEN event_type = 'view' AND value < 2 THEN 'go' ELSE 'review' END"


@query(f"SELECT user_id, arg_max({_EVENT_ACTION}, (value, event_id)) AS action, count(*) AS candidates FROM events GROUP BY 1")
def decided_events(t):
    from . import pipelines

    rules = [("stop", F.col("value") >= 40), ("go", (F.col("event_type") == "view") & (F.col("value") < 2))]
    out = pipelines.decide_and_arbitrate(t("events").select("user_id", "value", "event_id", "event_type"), rules, "user_id", ["value", "event_id"], F.lit("review"))
    return out.select("user_id", "action", "candidates")


@query("WITH e AS (SELECT event_id, user_id, event_type = 'click' AS b, value > 5 AS s FROM events) SELECT user_id % 3 AS grp, count(*) FILTER (b) AS base_correct, count(*) FILTER (s) AS student_correct, least(coalesce(count(*) FILTER (s) * 1.0 / nullif(count(*) FILTER (b), 0), 0), 1) >= 0.9 AS passed FROM e GROUP BY 1")
def merged_gate(t):
    from . import pipelines

    e = t("events").select("event_id", (F.col("user_id") % 3).alias("grp"), (F.col("event_type") == "click").alias("correct"), (F.col("value") > 5).alias("s"))
    shard = lambda rule: e.filter(rule).select("event_id", "grp", F.col("s").alias("correct"))
    out = pipelines.merge_and_gate(e.drop("s"), [shard("event_id % 2 = 0"), shard("event_id % 3 = 0"), shard("event_id % 2 = 1")], "event_id", "grp", "correct", 0.9)
    return out.select("grp", "base_correct", "student_correct", "passed")
