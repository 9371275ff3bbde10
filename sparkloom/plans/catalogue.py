"""All queries over the reference's own operators, each with the SQL that gives the same rows where SQL can.

Every query runs over its whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import extract as X
from ..functions import hashing as H
from ..functions import rules as R
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import decision as D
from ..operators import dedup, gates, joins, quality, quotas, weights, windows
from ..streaming import outbox
from . import pipelines
from .registry import fold, grams, hash_order, oracle_sql, queries, query, spaced, squash, tokens

__all__ = ["oracle_sql", "queries"]


# ---------------------------------------------------------------- curation of texts


@query(
    f"""WITH base AS (SELECT doc_id, text, lang, {squash("text")} AS form FROM documents),
    judged AS (SELECT *, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) < 60 THEN 'short'
        WHEN length(text) > 20000 THEN 'long' WHEN lang IS NULL THEN 'no_language' END AS reason FROM base),
    first AS (SELECT * FROM judged WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY form ORDER BY doc_id) = 1),
    clean AS (SELECT * FROM first WHERE NOT EXISTS (SELECT 1 FROM eval_item e WHERE {squash("e.text")} = form))
    SELECT lower(trim(lang)) AS lang, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters,
        round(count(*) * 1.0 / (SELECT count(*) FROM clean), 6) AS share FROM clean GROUP BY 1"""
)
def curation_funnel(t):
    x = F.col("text")
    rules = [("empty", x.isNull() | (F.trim(x) == "")), ("short", F.length(x) < 60), ("long", F.length(x) > 20000), ("no_language", F.col("lang").isNull())]
    return pipelines.curation_funnel(t("documents"), t("eval_item"), rules)


@query(f"SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY {squash('coalesce(text, chr(1))')} ORDER BY doc_id) = 1")
def dedup_keep_first(t):
    return dedup.keep_first_slim(t("documents"), T.squash(F.coalesce("text", F.lit("\u0001"))), "doc_id", ["doc_id"]).select("doc_id")


@query(
    f"""SELECT count(DISTINCT {squash("text")}) AS squashed, count(DISTINCT {fold(spaced("text"))}) AS spaced_folded,
    count(DISTINCT {spaced("text")}) AS spaced, count(DISTINCT {fold("regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')")}) AS letters FROM documents"""
)
def normalise_counts(t):
    d = t("documents")
    h = lambda c: F.count_distinct(c)
    return d.agg(h(T.squash("text")).alias("squashed"), h(T.spaced_fold(F.col("text"))).alias("spaced_folded"), h(T.spaced(F.col("text"))).alias("spaced"), h(T.squash_letters("text")).alias("letters"))


@query("SELECT trace_id, created_ts, split, source_dataset FROM semantic_distill_trace QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY created_ts DESC NULLS LAST, source_dataset DESC NULLS LAST, split DESC NULLS LAST) = 1")
def keep_last_trace(t):
    return dedup.keep_last(t("semantic_distill_trace").select("trace_id", "created_ts", "split", "source_dataset"), ["trace_id"], ["created_ts", "source_dataset", "split"])


@query("SELECT lang, source, arg_min(doc_id, sha256(concat_ws(':', '7', doc_id))) AS doc_id FROM documents GROUP BY 1, 2")
def keep_min_key(t):
    return dedup.keep_min(t("documents"), ["lang", "source"], H.stable_key(7, "doc_id"), "doc_id")


@query(
    """SELECT coalesce(CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) < 60 THEN 'short'
    WHEN length(text) > 5000 THEN 'long' WHEN lang IS NULL THEN 'no_language' WHEN source IS NULL THEN 'no_source'
    WHEN contains(lower(text), 'http') OR contains(lower(text), '<div') THEN 'markup' END, 'accepted') AS reject_reason, count(*) AS n
    FROM documents GROUP BY 1"""
)
def reject_reasons(t):
    x = F.col("text")
    rules = [
        ("empty", x.isNull() | (F.trim(x) == "")), ("short", F.length(x) < 60), ("long", F.length(x) > 5000), ("no_language", F.col("lang").isNull()),
        ("no_source", F.col("source").isNull()), ("markup", R.contains_any(x, ["http", "<div"])),
    ]
    return R.reason_counts(t("documents").select(R.first_reason(rules).alias("reject_reason")))


@query(
    f"""WITH r AS (SELECT sample_id, created_ts, {squash("coalesce(prompt, '')")} AS form,
      CASE WHEN NOT coalesce(human_verified, false) THEN 'not_verified' WHEN trim(coalesce(prompt, '')) = '' OR trim(coalesce(reference, '')) = '' THEN 'empty'
      WHEN length(prompt) + length(reference) > 600 THEN 'budget' WHEN contains(lower(array_to_string(domain, ' ')), '代码') THEN 'code' END AS reason FROM build_p0a5_data),
    s AS (SELECT *, CASE WHEN reason IS NOT NULL THEN reason WHEN row_number() OVER (PARTITION BY form, reason IS NULL ORDER BY created_ts, sample_id) > 1 THEN 'duplicate' END AS why FROM r)
    SELECT coalesce(why, 'accepted') AS reject_reason, count(*) AS n FROM s GROUP BY 1"""
)
def ordered_filter_with_dedup(t):
    p, r = F.coalesce("prompt", F.lit("")), F.coalesce("reference", F.lit(""))
    rules = [
        ("not_verified", ~F.coalesce("human_verified", F.lit(False))), ("empty", (F.trim(p) == "") | (F.trim(r) == "")),
        ("budget", F.length("prompt") + F.length("reference") > 600), ("code", F.contains(F.lower(F.array_join("domain", " ")), F.lit("代码"))),
    ]
    return pipelines.filter_with_dedup(t("build_p0a5_data"), rules, T.squash(p))


@query(f"SELECT doc_id FROM documents d WHERE text IS NULL OR NOT EXISTS (SELECT 1 FROM eval_item e WHERE {squash('e.text')} = {squash('d.text')})")
def exact_decontamination(t):
    return joins.exclude_by(t("documents").select("doc_id", "text"), t("eval_item"), T.squash, "text", "text").select("doc_id")


_GRAM_SQL = f"""WITH d AS (SELECT doc_id, {tokens("text")} AS t FROM documents), e AS (SELECT item_id, {tokens("text")} AS t FROM eval_item),
    dg AS (SELECT doc_id, {grams("t")} AS g FROM d), eg AS (SELECT item_id, {grams("t")} AS g FROM e),
    dx AS (SELECT doc_id, len(g) AS doc_grams, unnest(g) AS x FROM dg), ex AS (SELECT item_id, len(g) AS ref_grams, unnest(g) AS x FROM eg),
    p AS (SELECT doc_id, item_id, doc_grams, ref_grams, count(*) AS common FROM dx JOIN ex USING (x) GROUP BY ALL)"""


@query(
    _GRAM_SQL + """ SELECT doc_id, item_id, common, round(common * 1.0 / (doc_grams + ref_grams - common), 6) AS jaccard,
    round(common * 1.0 / ref_grams, 6) AS containment FROM p WHERE common * 1.0 / ref_grams >= 0.45"""
)
def gram_containment(t):
    p = joins.gram_overlap(t("documents"), t("eval_item"), "doc_id", "item_id", "text").filter("containment >= 0.45")
    return p.select("doc_id", "item_id", "common", F.round("jaccard", 6).alias("jaccard"), F.round("containment", 6).alias("containment"))


@query(_GRAM_SQL + " SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM p WHERE common * 1.0 / (doc_grams + ref_grams - common) >= 0.3)")
def gram_decontamination(t):
    return joins.without_near(t("documents"), t("eval_item"), "doc_id", "item_id", "text", 0.3).select("doc_id")


@query(
    f"""WITH u AS (SELECT doc_id, regexp_extract_all(text, '[^。！？!?；;\\n]*[。！？!?；;\\n]|[^。！？!?；;\\n]+$') AS u FROM documents WHERE text IS NOT NULL),
    n AS (SELECT doc_id, u, list_transform(u, lambda x: lower({spaced("x")})) AS n FROM u)
    SELECT doc_id, length(trim(array_to_string(list_filter(u, lambda x, i: length(n[i]) < 12 OR list_position(n, n[i]) = i), ''))) AS kept FROM n"""
)
def repeated_units(t):
    return dedup.repeated_units_removed(t("documents").filter("text is not null"), "doc_id", "text").select("doc_id", F.length("text").cast("long").alias("kept"))


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[㐀-鿿]')) AS han FROM documents")
def han_characters(t):
    return t("documents").select("doc_id", T.han_count(F.coalesce("text", F.lit(""))).cast("long").alias("han"))


@query(f"SELECT doc_id, sha256(coalesce(text, '')) AS digest, sha256({squash("coalesce(text, '')")}) AS identity, substr(sha256(concat_ws(':', '11', 'docs', doc_id)), 1, 16) AS key, CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) AS seed FROM documents")
def stable_keys(t):
    x = F.coalesce("text", F.lit(""))
    return t("documents").select(
        "doc_id", F.sha2(x, 256).alias("digest"), F.sha2(T.squash(x), 256).alias("identity"), F.substr(H.stable_key(11, "doc_id", namespace="docs"), F.lit(1), F.lit(16)).alias("key"),
        H.hash_int(F.col("doc_id").cast("string")).alias("seed"),
    )


@query("SELECT category, count(*) AS n FROM (SELECT CASE WHEN contains(lower(text), 'salt tax') OR contains(text, '盐税') THEN 'tax' WHEN contains(lower(text), 'camera') OR contains(text, '镜头') THEN 'vision' WHEN contains(lower(text), 'signal') OR contains(text, '信号') THEN 'signal' ELSE 'general' END AS category FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def primary_label(t):
    classes = {"signal": ["signal", "信号"], "tax": ["salt tax", "盐税"], "vision": ["camera", "镜头"]}
    found = R.labels(F.col("text"), classes, "general")
    return t("documents").filter("text is not null").select(R.primary(found, ["tax", "vision", "signal", "general"]).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- chat records and answers


@query(
    """SELECT sample_id, created_ts, length(list_filter(messages, lambda m: m.role = 'user')[-1].content) AS question_chars, len(messages) AS messages,
    len(list_filter(messages, lambda m: m.role IN ('system', 'user'))) AS prompt_messages FROM train_p0a5_lora"""
)
def last_user_message(t):
    d = t("train_p0a5_lora")
    return d.select("sample_id", "created_ts", F.length(T.last_user(F.col("messages"))).cast("long").alias("question_chars"), F.size("messages").cast("long").alias("messages"), F.size(T.only_roles(F.col("messages"), "system", "user")).cast("long").alias("prompt_messages"))


@query(
    """SELECT sample_id, created_ts, sha256(array_to_string(list_transform(list_filter(messages, lambda m: coalesce(trim(m.content), '') <> ''),
    lambda m: '<|im_start|>' || m.role || chr(10) || trim(m.content) || '<|im_end|>'), chr(10))) AS digest FROM train_p0a5_lora"""
)
def render_chat(t):
    return t("train_p0a5_lora").select("sample_id", "created_ts", F.sha2(T.render_chat(F.col("messages")), 256).alias("digest"))


@query("SELECT m.role AS role, count(*) AS n FROM (SELECT unnest(messages) AS m FROM train_p0a5_lora) GROUP BY 1")
def role_counts(t):
    return t("train_p0a5_lora").select(F.explode("messages.role").alias("role")).groupBy("role").agg(F.count("*").alias("n"))


_NUM = r"[-+]?\d[\d,]*(?:\.\d+)?"


@query(
    rf"""WITH a AS (SELECT sample_id, created_ts, coalesce(answer, '') AS a FROM train_p0a5_lora),
    b AS (SELECT *, CASE WHEN contains(a, '####') THEN split_part(a, '####', -1) END AS tail FROM a)
    SELECT sample_id, created_ts, regexp_replace(replace(trim(regexp_extract_all(coalesce(tail, a), '{_NUM}')[-1]), ',', ''), '\.0$', '') AS last_number,
    regexp_replace(replace(trim(coalesce(regexp_extract_all(tail, '{_NUM}')[1], regexp_extract_all(a, '{_NUM}')[-1])), ',', ''), '\.0$', '') AS marked_number FROM b"""
)
def answer_numbers(t):
    a = F.coalesce("answer", F.lit(""))
    return t("train_p0a5_lora").select("sample_id", "created_ts", X.last_number(a).alias("last_number"), X.marked_number(a).alias("marked_number"))


@query(
    r"""SELECT sample_id, created_ts, nullif(regexp_extract(trim(split_part(regexp_replace(answer, '\s+$', ''), chr(10), -1)), '^最终答案：([A-D])$', 1), '') AS strict_letter,
    regexp_extract_all(upper(answer), '(?:最终答案|答案|FINAL ANSWER|ANSWER)\s*(?:是|为|IS)?\s*[:：]?\s*\(?([A-D])(?:[^A-Z]|$)', 1)[-1] AS said_letter FROM build_p0a32_train"""
)
def answer_letters(t):
    said = X.choice(F.col("answer"), "stated")
    return t("build_p0a32_train").select("sample_id", "created_ts", X.strict_choice(F.col("answer")).alias("strict_letter"), said.alias("said_letter"))


_LETTER = "regexp_extract_all(u, '{}', 1)[-1]"


@query(
    f"""WITH a AS (SELECT sample_id, created_ts, upper(coalesce(answer, '')) AS u FROM train_p0a5_lora)
    SELECT sample_id, created_ts, coalesce({_LETTER.format(r"(?:最终答案|答案|FINAL ANSWER|ANSWER)\s*(?:是|为|IS)?\s*[:：]?\s*\(?([A-D])(?:[^A-Z]|$)")},
    {_LETTER.format(r"选(?:择)?\s*([A-D])(?:[^A-Z]|$)")}, regexp_extract_all(regexp_replace(u, '([^A-Z])', '\\1\\1', 'g'), '(?:^|[^A-Z])([A-D])(?:[^A-Z]|$)', 1)[-1]) AS letter FROM a"""
)
def final_letters(t):
    return t("train_p0a5_lora").select("sample_id", "created_ts", X.final_choice(F.coalesce("answer", F.lit(""))).alias("letter"))


@query(
    r"""WITH p AS (SELECT sample_id, created_ts, list_filter(messages, lambda m: m.role = 'user')[-1].content AS q FROM build_p0a32_train),
    o AS (SELECT *, regexp_extract(q, '(?s)(?:^|\n)\s*A[.、:：]\s*(.*?)\s*\n\s*B[.、:：]\s*(.*?)\s*\n\s*C[.、:：]\s*(.*?)\s*\n\s*D[.、:：]\s*(.*?)\s*(?:\n|$)', ['a', 'b', 'c', 'd']) AS m FROM p)
    SELECT sample_id, created_ts, CASE WHEN m.d <> '' THEN m.a || '/' || m.b || '/' || m.c || '/' || m.d END AS options FROM o"""
)
def choice_options(t):
    return t("build_p0a32_train").select("sample_id", "created_ts", F.array_join(X.choice_options(T.last_user(F.col("messages"))), "/").alias("options"))


@query(
    r"""SELECT sample_id, created_ts, nullif(regexp_extract(trim(split_part(regexp_replace(answer, '\s+$', ''), chr(10), -1)), '^最终答案：([A-D])$', 1), '') AS letter,
    length(CASE WHEN regexp_matches(trim(split_part(regexp_replace(answer, '\s+$', ''), chr(10), -1)), '^最终答案：[A-D]$')
      THEN regexp_replace(regexp_replace(answer, '(?s)\n?最终答案：[A-D]\s*$', ''), '[\s。；;，,]+$', '') ELSE answer END) AS reason_chars FROM build_p0a32_train"""
)
def reason_and_letter(t):
    return t("build_p0a32_train").select("sample_id", "created_ts", X.reason_and_letter(F.col("answer")).alias("r")).select("sample_id", "created_ts", "r.letter", F.length("r.reason").cast("long").alias("reason_chars"))


@query("SELECT trace_id, created_ts, decision_tuple_json ->> '$.action' AS action, round(CAST(decision_tuple_json ->> '$.confidence' AS DOUBLE), 6) AS confidence FROM semantic_distill_trace")
def json_fields(t):
    j = F.col("decision_tuple_json")
    return t("semantic_distill_trace").select("trace_id", "created_ts", X.json_field(j, "$.action").alias("action"), F.round(X.json_field(j, "$.confidence").cast("double"), 6).alias("confidence"))


@query(
    r"""SELECT sample_id, created_ts, CASE WHEN regexp_matches(answer, '(?is)```(?:python)?\s*.*?```') THEN trim(regexp_replace(regexp_extract(answer, '(?is)```(?:python)?\s*(.*?)```', 1), '\s+$', ''))
    ELSE trim(answer) END AS code FROM train_p0a5_lora WHERE dataset_key = 'opencodeinstruct'"""
)
def fenced_code(t):
    return t("train_p0a5_lora").filter("dataset_key = 'opencodeinstruct'").select("sample_id", "created_ts", T.fenced_code(F.col("answer")).alias("code"))


@query(r"SELECT sample_id, created_ts, substr(trim(array_to_string(list_filter(regexp_extract_all(answer, '[^。！？!?]*[。！？!?]|[^。！？!?]+$'), lambda x: trim(x) <> '')[1:2], '')), 1, 180) AS short FROM train_p0a5_lora WHERE answer IS NOT NULL")
def first_sentences(t):
    return t("train_p0a5_lora").filter("answer is not null").select("sample_id", "created_ts", T.first_sentences(F.col("answer")).alias("short"))


@query(
    r"""WITH d AS (SELECT DISTINCT sample_id, CASE WHEN regexp_matches(answer, '(?is)```(?:python)?\s*.*?```') THEN trim(regexp_replace(regexp_extract(answer, '(?is)```(?:python)?\s*(.*?)```', 1), '\s+$', ''))
      ELSE trim(answer) END AS c FROM train_p0a5_lora WHERE dataset_key = 'opencodeinstruct' AND answer IS NOT NULL)
    SELECT sample_id, CASE WHEN regexp_full_match(c, '(?s)def \w+\(values\):\n    out = \[\]\n    for value in values:\n        out\.append\([^\n()]*\)\n    return out') THEN regexp_extract(c, 'def (\w+)', 1) END AS name FROM d"""
)
def whole_functions(t):
    """Names of the snippets that are exactly one plain function; these texts have one form, which the SQL spells out."""
    d = t("train_p0a5_lora").filter("dataset_key = 'opencodeinstruct' and answer is not null").select("sample_id", T.fenced_code(F.col("answer")).alias("code")).distinct()
    return C.code_checks(d, "sample_id", "code").select("sample_id", F.when(F.col("unsafe").isNull() & F.col("shape").isNull(), F.col("name")).alias("name"))


@query()
def code_shapes(t):
    d = t("train_p0a5_lora").filter("dataset_key = 'opencodeinstruct' and answer is not null").select("sample_id", T.fenced_code(F.col("answer")).alias("code")).distinct()
    return C.code_checks(d, "sample_id", "code", ("math", "re")).select("sample_id", "unsafe", "shape", "name")


@query()
def canonical_json(t):
    return t("semantic_distill_trace").select("trace_id", "created_ts", H.canonical_json_hash("decision_tuple_json").alias("digest"))


@query(
    """WITH d AS (SELECT DISTINCT trace_id, evidence_items_json AS j FROM semantic_distill_trace WHERE evidence_items_json IS NOT NULL),
    w AS (SELECT trace_id, e.fullkey AS path, e.type AS kind, e.atom ->> '$' AS v FROM d, json_tree(CASE WHEN json_valid(j) THEN j END) AS e)
    SELECT trace_id, path, CASE WHEN kind = 'NULL' THEN 'null' ELSE 'placeholder' END AS problem FROM w WHERE kind = 'NULL' OR (kind = 'VARCHAR' AND lower(trim(v)) IN ('pending', 'todo', 'tbd'))
    UNION ALL SELECT trace_id, '$', 'broken' FROM d WHERE NOT json_valid(j)"""
)
def json_findings(t):
    d = t("semantic_distill_trace").select("trace_id", "evidence_items_json").distinct()
    return quality.json_problems(d, "trace_id", "evidence_items_json", ["pending", "todo", "tbd"])


@query(
    """WITH r AS (SELECT DISTINCT sample_id, answer_letter FROM build_p0a32_train WHERE answer_letter IS NOT NULL),
    s AS (SELECT *, CAST(('0x' || substr(sha256(sample_id), 1, 8)) AS BIGINT) % 4 AS slot,
      list_sort([sha256(sample_id || ':' || x) || x FOR x IN ['p', 'q', 's']]) AS d FROM r)
    SELECT sample_id, answer_letter, array_to_string(list_transform(list_concat(list_concat(d[1:slot], [repeat('*', 64) || 'right']), d[slot + 1:3]), lambda x: substr(x, 65)), ',') AS options FROM s"""
)
def assembled_options(t):
    d = t("build_p0a32_train").filter("answer_letter is not null").select("sample_id", "answer_letter").distinct()
    return d.select("sample_id", "answer_letter", F.array_join(pipelines.assemble(F.col("sample_id"), F.lit("right"), [F.lit(x) for x in "pqs"]), ",").alias("options"))


# ---------------------------------------------------------------- identity joins and sets


@query(
    """WITH l AS (SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_quantity > 25 GROUP BY 1)
    SELECT count(*) FILTER (o_orderkey IS NOT NULL AND l_orderkey IS NOT NULL) AS matched, count(*) FILTER (l_orderkey IS NULL) AS only_left,
    count(*) FILTER (o_orderkey IS NULL) AS only_right, count(*) FILTER (o_orderkey IS NOT NULL AND l_orderkey IS NOT NULL AND 2 IS DISTINCT FROM lines) AS lines_differs
    FROM orders FULL JOIN l ON o_orderkey = l_orderkey"""
)
def match_audit(t):
    lines = t("lineitem").filter("l_quantity > 25").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("lines"))
    return joins.match_audit(t("orders").select(F.col("o_orderkey").alias("k"), F.lit(2).cast("long").alias("lines")), lines, "k", ["lines"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'task_prompt')")
def history_exclusion(t):
    d = t("documents").select("doc_id", "source")
    return joins.exclude(d, d.filter("source = 'task_prompt'"), ["doc_id"]).select("doc_id")


@query("SELECT sample_id, bool_or(load_batch < 4) AS seen FROM build_p0a32_train GROUP BY 1")
def seen_flag(t):
    d = t("build_p0a32_train")
    return joins.flag_seen(d.select("sample_id").distinct(), d.filter("load_batch < 4"), ["sample_id"])


@query("SELECT s.c_custkey, o.o_orderkey FROM customer s JOIN orders o ON o.o_custkey = s.c_custkey WHERE s.c_acctbal > 9000")
def strict_lookup(t):
    return t("customer").filter("c_acctbal > 9000").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query("SELECT n.n_nationkey, n.n_name, r.r_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey")
def strict_match(t):
    n, r = t("nation").withColumnRenamed("n_regionkey", "k"), t("region").withColumnRenamed("r_regionkey", "k")
    return joins.strict_inner(n, r, "k").select("n_nationkey", "n_name", "r_name")


@query("WITH d AS (SELECT DISTINCT sample_id, load_batch, answer FROM build_p0a32_train) SELECT DISTINCT sample_id FROM build_p0a32_train r WHERE load_batch > 4 AND EXISTS (SELECT 1 FROM d WHERE d.sample_id = r.sample_id AND d.answer = r.answer AND d.load_batch <= 4)")
def reusable_rows(t):
    d = t("build_p0a32_train").select("sample_id", "load_batch", "answer")
    return joins.reusable(d.filter("load_batch > 4"), d.filter("load_batch <= 4"), "sample_id", ["answer"]).select("sample_id").distinct()


@query("SELECT DISTINCT sample_id FROM build_p0a32_train WHERE sample_id NOT IN (SELECT sample_id FROM build_p0a32_train WHERE load_batch <= 4 AND quality_weight >= 1)")
def pending_rows(t):
    d = t("build_p0a32_train")
    return joins.pending(d.select("sample_id").distinct(), d.filter("load_batch <= 4"), "sample_id", F.col("quality_weight") >= 1)


@query("SELECT coalesce(o_orderkey, l_orderkey) AS o_orderkey, CASE WHEN l_orderkey IS NULL THEN 'left_only' WHEN o_orderkey IS NULL THEN 'right_only' ELSE 'paired' END AS state FROM (SELECT o_orderkey FROM orders WHERE o_totalprice > 150000) FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_discount > 0.05) ON o_orderkey = l_orderkey")
def asset_pairing(t):
    return joins.pairing(t("orders").filter("o_totalprice > 150000").select("o_orderkey"), t("lineitem").filter("l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT c.c_custkey, coalesce(n.n_name, c.c_name) AS name, c.c_mktsegment FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey")
def column_override(t):
    c = t("customer").select(F.col("c_nationkey").alias("k"), "c_custkey", F.col("c_name").alias("name"), "c_mktsegment")
    n = t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return joins.override(c, n, "k").drop("k")


@query("SELECT coalesce(b.k, a.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.v ELSE a.v END AS v FROM (SELECT s_suppkey AS k, s_name AS v FROM supplier) a FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_size > 3 THEN p_name END AS v FROM part WHERE p_size < 10) b ON a.k = b.k")
def overlay_rows(t):
    a = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    return dedup.overlay(a, t("part").filter("p_size < 10").select(F.col("p_partkey").alias("k"), F.expr("if(p_size > 3, p_name, null)").alias("v")), "k")


@query(
    """WITH w AS (SELECT 0 AS s, l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 30 UNION ALL SELECT 1, l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 20)
    SELECT count(*) AS rows, count(*) - count(DISTINCT l_orderkey) AS repeated FROM w"""
)
def shard_merge(t):
    d = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return dedup.merge_shards([d.filter("l_quantity < 30"), d.filter("l_quantity > 20")], "l_orderkey", ["l_linenumber", "l_quantity"])[1]


@query(
    """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
    SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a,
    (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either"""
)
def set_sizes(t):
    u = t("events").groupBy("user_id").agg(F.max(F.col("event_type") == "click").alias("a"), F.max(F.col("event_type") == "error").alias("b"))
    return u.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("a") | F.col("b")).alias("either"))


@query(
    """WITH s AS (SELECT DISTINCT sample_hash AS k, lower(trim(split)) AS s FROM semantic_distill_trace WHERE sample_hash IS NOT NULL AND split IS NOT NULL)
    SELECT a.s AS split_a, b.s AS split_b, count(*) AS keys FROM s a JOIN s b ON a.k = b.k AND a.s < b.s GROUP BY 1, 2"""
)
def split_overlap_matrix(t):
    d = t("semantic_distill_trace").select("sample_hash", F.lower(F.trim("split")).alias("split"))
    return quality.split_overlaps(d, "sample_hash", "split")


@query(
    """WITH i AS (SELECT split_role, CAST(sample_id AS VARCHAR) AS s FROM (SELECT DISTINCT split_role, sample_id FROM build_p0a5_data)),
    p AS (SELECT split_role, substr(sha256(s), 1, 2) AS p, count(*) AS n, sha256(string_agg(s, chr(10) ORDER BY s) || chr(10)) AS h FROM i GROUP BY 1, 2)
    SELECT split_role, CAST(sum(n) AS BIGINT) AS ids, sha256(string_agg(h, chr(10) ORDER BY p)) AS checksum FROM p GROUP BY 1"""
)
def split_checksums(t):
    return H.id_list_hash(t("build_p0a5_data").select("split_role", "sample_id").distinct(), ["split_role"], "sample_id")


@query("SELECT coalesce(trim(trace_id), '') AS trace_id, count(*) AS n FROM semantic_distill_trace GROUP BY 1 HAVING count(*) > 1 OR coalesce(trim(trace_id), '') = ''")
def key_problems(t):
    return quality.key_problems(t("semantic_distill_trace"), "trace_id")


@query("SELECT sample_id, n FROM (SELECT coalesce(sample_id, '') AS sample_id, count(*) AS n FROM build_p0a32_train GROUP BY 1) WHERE n > 1 OR trim(sample_id) = '' ORDER BY sample_id LIMIT 5")
def first_repeated_keys(t):
    return A.repeated_keys(t("build_p0a32_train"), "sample_id")


@query(
    """SELECT item_id, array_to_string(list_filter([CASE WHEN text IS NULL OR trim(text) = '' THEN 'no_text' END, CASE WHEN lang NOT IN ('en', 'zh') THEN 'language' END,
    CASE WHEN length(reference) > 3 THEN 'long_reference' END], lambda x: x IS NOT NULL), ',') AS problems FROM eval_item
    WHERE text IS NULL OR trim(text) = '' OR lang NOT IN ('en', 'zh') OR length(reference) > 3"""
)
def row_problems(t):
    rules = [("no_text", F.col("text").isNull() | (F.trim("text") == "")), ("language", ~F.col("lang").isin("en", "zh")), ("long_reference", F.length("reference") > 3)]
    return quality.row_problems(t("eval_item"), rules).select("item_id", F.array_join("problems", ",").alias("problems"))


# ---------------------------------------------------------------- aggregates

_CORRECT = "coalesce(CAST(student_probe_trace_json ->> '$.correct' AS BOOLEAN), false)"


def _probe(t):
    correct = F.get_json_object("student_probe_trace_json", "$.correct").cast("boolean")
    drift = F.get_json_object("quant_behavior_trace_json", "$.drift").cast("double")
    return t("semantic_distill_trace").select("trace_id", "created_ts", F.lower(F.trim("source_dataset")).alias("source"), correct.alias("correct"), (correct & (drift < 0.1)).alias("kept"))


@query(f"SELECT lower(trim(source_dataset)) AS source, count(*) FILTER ({_CORRECT}) AS correct_rows, count(*) AS rows, round(count(*) FILTER ({_CORRECT}) * 1.0 / count(*), 6) AS accuracy FROM semantic_distill_trace GROUP BY 1")
def accuracy_by_source(t):
    return A.accuracy(_probe(t), ["source"], "correct").withColumn("accuracy", F.round("accuracy", 6))


@query(f"SELECT lower(trim(source_dataset)) AS source, count(*) FILTER ({_CORRECT}) AS correct_rows, count(*) AS rows, round(count(*) FILTER ({_CORRECT}) / 100.0, 6) AS accuracy FROM semantic_distill_trace GROUP BY 1")
def accuracy_fixed_base(t):
    return A.accuracy(_probe(t), ["source"], "correct", 100).withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH b AS (SELECT lower(trim(source_dataset)) AS source, count(*) FILTER ({_CORRECT}) AS c, count(*) AS n FROM semantic_distill_trace GROUP BY 1) SELECT round(sum(c) * 1.0 / sum(n), 6) AS micro, round(avg(c * 1.0 / n), 6) AS macro FROM b")
def micro_macro(t):
    return A.micro_macro(_probe(t), "source", "correct").select(F.round("micro", 6).alias("micro"), F.round("macro", 6).alias("macro"))


_RETAIN = f"""WITH p AS (SELECT trace_id, lower(trim(any_value(source_dataset))) AS source, bool_or({_CORRECT}) AS b,
    bool_or({_CORRECT} AND coalesce(CAST(quant_behavior_trace_json ->> '$.drift' AS DOUBLE) < 0.1, false)) AS s FROM semantic_distill_trace GROUP BY 1),
    g AS (SELECT source, count(*) FILTER (b) AS base_correct, count(*) FILTER (s) AS student_correct, count(*) AS rows FROM p GROUP BY 1)"""


def _retained(t):
    d = _probe(t).groupBy("trace_id").agg(F.max("source").alias("source"), F.coalesce(F.max("correct"), F.lit(False)).alias("correct"), F.coalesce(F.max("kept"), F.lit(False)).alias("kept"))
    return A.retention(d.select("trace_id", "source", "correct"), d.select("trace_id", "source", F.col("kept").alias("correct")), "trace_id", "source", "correct")


@query(_RETAIN + " SELECT source, base_correct, student_correct, rows, round(coalesce(student_correct * 1.0 / nullif(base_correct, 0), 0), 6) AS ratio, round(least(coalesce(student_correct * 1.0 / nullif(base_correct, 0), 0), 1), 6) AS capped FROM g")
def retention_by_source(t):
    return _retained(t).withColumn("ratio", F.round("ratio", 6)).withColumn("capped", F.round("capped", 6))


@query(_RETAIN + " SELECT source, base_correct, student_correct, round(least(coalesce(student_correct * 1.0 / nullif(base_correct, 0), 0), 1), 6) AS ratio, least(coalesce(student_correct * 1.0 / nullif(base_correct, 0), 0), 1) >= 0.5 AS passed FROM g")
def ratio_gate(t):
    r = _retained(t).select("source", "base_correct", "student_correct")
    return gates.ratio_gate(r, "student_correct", "base_correct", 0.5).withColumn("ratio", F.round("ratio", 6))


_PCT = "list_sort(list(value))[least(count(*) - 1, CAST(floor(count(*) * {0}) AS BIGINT)) + 1]"


@query(f"SELECT event_type, {_PCT.format(0.5)} AS p50, {_PCT.format(0.95)} AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def percentile_floor_index(t):
    return A.floor_percentiles(t("events"), ["event_type"], "value", [0.5, 0.95])


@query("SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS peak FROM events GROUP BY 1")
def value_spread(t):
    return A.spread(t("events"), ["event_type"], "value").select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95")], "peak")


@query(
    """WITH c AS (SELECT user_id, event_type, count(*) AS k, min(event_id) AS f FROM events WHERE coalesce(event_type, '') <> '' GROUP BY 1, 2),
    m AS (SELECT *, max(k) OVER (PARTITION BY user_id) AS top FROM c)
    SELECT user_id, arg_min(event_type, f) AS winner, max(k) AS votes, count(*) > 1 AS tied FROM m WHERE k = top GROUP BY 1"""
)
def majority_vote(t):
    return A.majority_vote(t("events"), "user_id", "event_id", "event_type")


@query(
    """SELECT event_id, round(CASE WHEN s < 1e-4 THEN 0 ELSE (value - m) / s END, 6) AS advantage
    FROM (SELECT event_id, value, avg(value) OVER (PARTITION BY user_id) AS m, stddev_pop(value) OVER (PARTITION BY user_id) AS s FROM events)"""
)
def group_advantage(t):
    return A.group_advantage(t("events").select("event_id", "user_id", "value"), "user_id", "value").select("event_id", F.round("advantage", 6).alias("advantage"))


@query("WITH v AS (SELECT unnest(['click', 'view', 'purchase', 'refund']) AS event_type) SELECT v.event_type, count(e.event_id) AS n FROM v LEFT JOIN events e USING (event_type) GROUP BY 1")
def distribution_zero_fill(t):
    return A.zero_filled(t("events"), "event_type", ["click", "view", "purchase", "refund"])


@query("SELECT lang, source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS characters, max(created_ts) AS newest FROM documents GROUP BY ROLLUP (lang, source)")
def inventory_rollup(t):
    return A.rolled_up(t("documents"), ["lang", "source"], F.count("*").alias("documents"), F.sum("n_chars").alias("characters"), F.max("created_ts").alias("newest"))


@query("SELECT count(DISTINCT (l_partkey, l_suppkey)) AS nodes, count(*) AS edges, count(DISTINCT l_orderkey) AS groups FROM lineitem")
def relation_stats(t):
    return A.relation_stats(t("lineitem"), ["l_partkey", "l_suppkey"], "l_orderkey")


@query(
    """WITH b AS (SELECT l_orderkey, count(*) AS r, count(DISTINCT l_returnflag) AS a FROM lineitem GROUP BY 1)
    SELECT count(*) AS events, CAST(sum(r) AS BIGINT) AS rows, count(*) FILTER (a > 1) AS conflicts, round(count(*) FILTER (a > 1) * 1.0 / count(*), 6) AS conflict_share FROM b"""
)
def conflict_metrics(t):
    return A.conflict_metrics(t("lineitem"), "l_orderkey", "l_returnflag").withColumn("conflict_share", F.round("conflict_share", 6))


@query("SELECT group_key, min(n) AS least FROM (SELECT split_role AS group_key, coalesce(source, '-') AS source, count(*) AS n FROM build_p0a5_data GROUP BY 1, 2) GROUP BY 1")
def least_stratum(t):
    by = t("build_p0a5_data").groupBy(F.col("split_role").alias("group_key"), F.coalesce("source", F.lit("-")).alias("source")).agg(F.count("*").alias("n"))
    return by.groupBy("group_key").agg(F.min("n").alias("least"))


# ---------------------------------------------------------------- windows


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {hash_order(42, 'doc_id')}, doc_id) AS rank FROM documents")
def hash_rank(t):
    return windows.global_rank(t("documents").select("doc_id", H.stable_key(42, "doc_id").alias("h")), [F.col("h"), F.col("doc_id")]).select("doc_id", "rank")


@query(f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {hash_order(42, 'doc_id')}, doc_id) AS rank FROM documents) SELECT doc_id, CASE WHEN rank <= 100 THEN 'gate' WHEN rank <= 300 THEN 'validation' ELSE 'train' END AS role FROM r")
def three_way_split(t):
    r = windows.global_rank(t("documents").select("doc_id", H.stable_key(42, "doc_id").alias("h")), [F.col("h"), F.col("doc_id")])
    return r.select("doc_id", windows.slices(F.col("rank"), [("gate", 100), ("validation", 200)], "train").alias("role"))


@query(f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {hash_order(42, 'doc_id')}, doc_id) AS rank FROM documents) SELECT (rank - 1) % 4 AS shard, count(*) AS n, min(doc_id) AS least FROM r GROUP BY 1")
def modulo_shards(t):
    r = windows.global_rank(t("documents").select("doc_id", H.stable_key(42, "doc_id").alias("h")), [F.col("h"), F.col("doc_id")])
    return r.groupBy(F.pmod(F.col("rank") - 1, F.lit(4)).alias("shard")).agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))


@query(f"SELECT doc_id FROM documents WHERE n_chars > 0 ORDER BY n_chars, {hash_order(5, 'doc_id')}, doc_id LIMIT 50")
def shortest_first(t):
    d = t("documents").filter("n_chars > 0").select("doc_id", "n_chars", H.stable_key(5, "doc_id").alias("h"))
    return d.orderBy("n_chars", "h", "doc_id").limit(50).select("doc_id")


@query(
    f"""WITH l AS (SELECT coalesce(source, '-') AS s, arg_min(doc_id, {hash_order(1, 'doc_id')}) AS doc_id FROM documents GROUP BY 1)
    SELECT doc_id FROM documents ORDER BY doc_id NOT IN (SELECT doc_id FROM l), {hash_order(2, 'doc_id')}, doc_id LIMIT 60"""
)
def first_per_group_then_fill(t):
    d = t("documents").select("doc_id", F.coalesce("source", F.lit("-")).alias("s"))
    return windows.first_in_group_then_fill(d, "s", "doc_id", H.stable_key(1, "doc_id"), H.stable_key(2, "doc_id"), 60).select("doc_id")


@query(
    """WITH r AS (SELECT doc_id, coalesce(lang, '-') AS l, row_number() OVER (PARTITION BY coalesce(lang, '-') ORDER BY doc_id) AS rn FROM documents)
    SELECT doc_id, l FROM r ORDER BY rn, l LIMIT 100"""
)
def round_robin_interleave(t):
    return windows.interleave(t("documents").select("doc_id", F.coalesce("lang", F.lit("-")).alias("l")), "l", [F.col("doc_id")], 100)


@query(
    """WITH r AS (SELECT user_id, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS candidates FROM events)
    SELECT user_id, value, event_id, candidates FROM r WHERE rn = 1"""
)
def arbitrate_conflicts(t):
    return windows.arbitrate(t("events").select("user_id", "value", "ts", "event_id"), "user_id", ["value", "ts", "event_id"]).drop("ts")


@query(
    """WITH f AS (SELECT event_id, user_id, ts, value > 20 AS bad, sum(CASE WHEN value > 20 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
    r AS (SELECT event_id, user_id, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM f)
    SELECT event_id, run, run = 3 AS alarm FROM r"""
)
def consecutive_breaches(t):
    e = t("events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), "value")
    return windows.breaches(e, "user_id", "at", F.col("value") > 20, 3).select("event_id", "run", "alarm")


@query("SELECT event_id, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000.0, 3) AS elapsed_ms, max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM events")
def elapsed_and_peak(t):
    e = t("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return windows.elapsed(e, "user_id", "ts", "value").select("event_id", F.round("elapsed_ms", 3).alias("elapsed_ms"), "peak")


@query(
    """WITH g AS (SELECT split_role, count(*) FILTER (human_verified) * 1.0 / count(*) AS share FROM build_p0a5_data WHERE split_role IS NOT NULL GROUP BY 1),
    o AS (SELECT *, sum(CASE WHEN share >= 0.75 THEN 0 ELSE 1 END) OVER (ORDER BY split_role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS failed FROM g)
    SELECT split_role, round(share, 6) AS share FROM o WHERE coalesce(failed, 0) = 0"""
)
def fail_fast(t):
    g = t("build_p0a5_data").filter("split_role is not null").groupBy("split_role").agg((F.count_if(F.col("human_verified")) / F.count("*")).alias("share"))
    return windows.failing_from(g, "split_role", F.col("share") >= 0.75).withColumn("share", F.round("share", 6))


# ---------------------------------------------------------------- quotas, weights


def _hash60(seed: int, key: str):
    return F.conv(F.substr(H.stable_key(seed, key), F.lit(1), F.lit(15)), 16, 10).cast("bigint")


_FLOORQ = """WITH s AS (SELECT coalesce(lang, '-') AS g, count(*) AS n FROM documents GROUP BY 1),
    q AS (SELECT g, n, 200 * n // sum(n) OVER () AS f, row_number() OVER (ORDER BY g) AS k, count(*) OVER () AS m FROM s),
    z AS (SELECT g, n, CAST(f + CASE WHEN k <= 200 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q)"""


@query(_FLOORQ + f" SELECT doc_id, g FROM (SELECT doc_id, coalesce(lang, '-') AS g, row_number() OVER (PARTITION BY coalesce(lang, '-') ORDER BY substr({hash_order(9, 'doc_id')}, 1, 15), doc_id) AS rn FROM documents) JOIN z USING (g) WHERE rn <= quota")
def proportional_quota(t):
    d = t("documents").select("doc_id", F.coalesce("lang", F.lit("-")).alias("g"))
    return quotas.take_quotas(d, "g", quotas.proportional_floor(quotas.group_sizes(d, "g"), 200), _hash60(9, "doc_id"), "doc_id")


_REMQ = """WITH s AS (SELECT coalesce(source, '-') AS g, count(*) AS n FROM documents GROUP BY 1),
    q AS (SELECT g, n, CAST(300 * n // sum(n) OVER () AS BIGINT) AS f, 300 * n % sum(n) OVER () AS rem FROM s),
    z AS (SELECT g, CAST(f + CASE WHEN row_number() OVER (ORDER BY rem DESC, n DESC, g DESC) <= 300 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q)"""


@query(_REMQ + f" SELECT doc_id, g FROM (SELECT doc_id, coalesce(source, '-') AS g, row_number() OVER (PARTITION BY coalesce(source, '-') ORDER BY substr({hash_order(3, 'doc_id')}, 1, 15), doc_id) AS rn FROM documents) JOIN z USING (g) WHERE rn <= quota")
def largest_remainder(t):
    d = t("documents").select("doc_id", F.coalesce("source", F.lit("-")).alias("g"))
    return quotas.take_quotas(d, "g", quotas.largest_remainder(quotas.group_sizes(d, "g"), 300), _hash60(3, "doc_id"), "doc_id")


@query(
    f"""WITH r AS (SELECT doc_id, coalesce(lang, '-') AS g, row_number() OVER (PARTITION BY coalesce(lang, '-') ORDER BY {hash_order(4, 'doc_id')}, doc_id) AS rn FROM documents),
    k AS (SELECT CAST(floor(0.5 * (120 // count(DISTINCT g))) AS BIGINT) AS least FROM r)
    SELECT doc_id, g FROM r, k ORDER BY rn > least, rn, g LIMIT 120"""
)
def balanced_fill(t):
    d = t("documents").select("doc_id", F.coalesce("lang", F.lit("-")).alias("g"), H.stable_key(4, "doc_id").alias("h"))
    return quotas.balanced_fill(d, "g", [F.col("h"), F.col("doc_id")], 120, 0.5).drop("h")


@query(
    f"""WITH d AS (SELECT DISTINCT sample_id, domain, answer_letter FROM build_p0a32_train WHERE answer_letter IS NOT NULL),
    r AS (SELECT *, CASE WHEN domain IS NULL THEN 99 ELSE row_number() OVER (PARTITION BY domain, answer_letter ORDER BY substr({hash_order(6, 'sample_id')}, 1, 15), sample_id) END AS rn FROM d)
    SELECT sample_id, domain, answer_letter, CASE WHEN rn <= 10 THEN 'validation' WHEN rn <= 40 THEN 'train' ELSE 'spare' END AS role FROM r"""
)
def label_balanced(t):
    d = t("build_p0a32_train").filter("answer_letter is not null").select("sample_id", "domain", "answer_letter").distinct()
    return quotas.label_balanced(d, "domain", "answer_letter", "sample_id", _hash60(6, "sample_id"), 10, 30)


@query(
    f"""WITH d AS (SELECT sample_id, any_value(domain) AS domain, bool_or(load_batch < 3) AS seen FROM build_p0a32_train GROUP BY 1)
    SELECT sample_id, domain, seen FROM d QUALIFY row_number() OVER (PARTITION BY domain ORDER BY seen, {hash_order(8, 'sample_id')}, sample_id) <= 25"""
)
def fresh_before_replay(t):
    d = t("build_p0a32_train").groupBy("sample_id").agg(F.any_value("domain").alias("domain"), F.max(F.col("load_batch") < 3).alias("seen"))
    return quotas.fresh_first(d, "domain", "seen", [H.stable_key(8, "sample_id"), F.col("sample_id")], 25)


@query(
    f"""WITH p AS (SELECT trace_id, bool_or({_CORRECT}) AS c FROM semantic_distill_trace GROUP BY 1), n AS (SELECT round_even(count(*) FILTER (NOT c) * 0.5, 0) AS k FROM p)
    SELECT trace_id, 'failure' AS role FROM p WHERE NOT c UNION ALL
    SELECT trace_id, 'replay' FROM (SELECT trace_id, row_number() OVER (ORDER BY {hash_order(12, 'trace_id')}, trace_id) AS rn FROM p WHERE c), n WHERE rn <= k"""
)
def failure_curriculum(t):
    d = _probe(t).groupBy("trace_id").agg(F.coalesce(F.max("correct"), F.lit(False)).alias("correct"))
    return quotas.failure_curriculum(d, "correct", [H.stable_key(12, "trace_id"), F.col("trace_id")]).select("trace_id", "role")


_DOMS = "SELECT DISTINCT sample_id, coalesce(teacher_model_id, '-') AS domain FROM build_p0a32_train"


@query(
    f"""WITH RECURSIVE d AS ({_DOMS}), size AS (SELECT domain, count(*) AS n FROM d GROUP BY 1),
    quota AS (SELECT domain, row_number() OVER (ORDER BY n, domain) AS turn, 120 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY domain) <= 120 % count(*) OVER () THEN 1 ELSE 0 END AS q FROM size),
    taken(turn, ids, rows) AS (
      SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS STRUCT(sample_id VARCHAR, domain VARCHAR)[])
      UNION ALL
      SELECT k.turn + 1, list_concat(k.ids, m.ids), list_concat(k.rows, list_transform(m.ids, lambda i: {{'sample_id': i, 'domain': m.domain}}))
      FROM taken k JOIN (SELECT turn, domain, q FROM quota) z ON z.turn = k.turn + 1, LATERAL (
        SELECT z.domain AS domain, list(d.sample_id ORDER BY {hash_order(13, "d.sample_id")}, d.sample_id)[1:z.q] AS ids FROM d WHERE d.domain = z.domain AND NOT list_contains(k.ids, d.sample_id)) m
    ), last AS (SELECT unnest(rows) AS r FROM taken WHERE turn = (SELECT count(*) FROM quota))
    SELECT r.sample_id AS sample_id, r.domain AS domain FROM last"""
)
def greedy_domains(t):
    d = t("build_p0a32_train").select("sample_id", F.coalesce("teacher_model_id", F.lit("-")).alias("domain")).distinct()
    return quotas.greedy_domains(d, "domain", "sample_id", H.stable_key(13, "sample_id"), 120)


@query(f"SELECT doc_id FROM documents WHERE length(text) > 400 ORDER BY {hash_order(14, 'doc_id')}, doc_id LIMIT 150")
def batches_until_target(t):
    d = t("documents").select("doc_id", "text", H.stable_key(14, "doc_id").alias("h"))
    return quotas.until_accepted(d, [F.col("h"), F.col("doc_id")], lambda x: x.filter(F.length("text") > 400), 150, 256).select("doc_id")


_MASS = {"cmmlu": 0.3, "gsm8k": 0.35, "opencodeinstruct": 0.35}
_MASS_SQL = "CASE dataset_key WHEN 'cmmlu' THEN 0.3 WHEN 'gsm8k' THEN 0.35 WHEN 'opencodeinstruct' THEN 0.35 END"


@query(f"SELECT sample_id, created_ts, round({_MASS_SQL} * count(*) OVER () / count(*) OVER (PARTITION BY dataset_key), 6) AS weight FROM (SELECT * FROM train_p0a5_lora WHERE dataset_key IS NOT NULL)")
def task_mass(t):
    d = t("train_p0a5_lora").filter("dataset_key is not null").select("sample_id", "created_ts", "dataset_key")
    return weights.task_mass(d, "dataset_key", _MASS).select("sample_id", "created_ts", F.round("weight", 6).alias("weight"))


@query(
    f"""WITH d AS (SELECT sample_id, created_ts, dataset_key, CAST(length(answer) AS DOUBLE) AS q FROM train_p0a5_lora WHERE dataset_key IS NOT NULL AND answer IS NOT NULL)
    SELECT sample_id, created_ts, round({_MASS_SQL} * count(*) OVER () * q / sum(q) OVER (PARTITION BY dataset_key), 6) AS weight FROM d"""
)
def quality_mass(t):
    d = t("train_p0a5_lora").filter("dataset_key is not null and answer is not null").select("sample_id", "created_ts", "dataset_key", F.length("answer").cast("double").alias("q"))
    return weights.quality_mass(d, "dataset_key", "q", _MASS).select("sample_id", "created_ts", F.round("weight", 6).alias("weight"))


@query("SELECT doc_id, round(n_chars / avg(n_chars) OVER (), 6) AS weight FROM documents")
def mean_one_weights(t):
    return weights.mean_one(t("documents").select("doc_id", F.col("n_chars").cast("double").alias("weight")), "weight").select("doc_id", F.round("weight", 6).alias("weight"))


@query("SELECT coalesce(lang, '-') AS lang, CAST(sum(n_chars) AS BIGINT) AS mass, round(sum(n_chars) * 1.0 / sum(sum(n_chars)) OVER (), 6) AS share FROM documents GROUP BY 1")
def mass_shares(t):
    d = t("documents").select(F.coalesce("lang", F.lit("-")).alias("lang"), "n_chars")
    return weights.mass_shares(d, "lang", "n_chars").withColumn("share", F.round("share", 6))


# ---------------------------------------------------------------- gates

_STEP = f"WITH m AS (SELECT schema_version AS candidate, lower(trim(source_dataset)) AS grp, count(*) FILTER ({_CORRECT}) * 1.0 / count(*) AS acc FROM semantic_distill_trace WHERE source_dataset IS NOT NULL GROUP BY 1, 2)"


def _steps(t):
    correct = F.coalesce(F.get_json_object("student_probe_trace_json", "$.correct").cast("boolean"), F.lit(False))
    d = t("semantic_distill_trace").filter("source_dataset is not null")
    return d.groupBy(F.col("schema_version").alias("candidate"), F.lower(F.trim("source_dataset")).alias("grp")).agg((F.count_if(correct) / F.count("*")).alias("acc"))


@query(
    _STEP + """, j AS (SELECT a.candidate, a.grp, a.acc, a.acc - b.acc + 1e-12 < -0.05 AS bad FROM m a JOIN m b ON b.grp = a.grp AND b.candidate = '1.2')
    SELECT candidate, round(avg(acc), 6) AS macro, count(*) FILTER (bad) AS failures, count(*) FILTER (bad) = 0 AS eligible FROM j GROUP BY 1"""
)
def checkpoint_eligibility(t):
    m = _steps(t)
    gains = {g: -0.05 for g in quotas.group_sizes(m, "grp")}
    e = gates.eligible(m, m.filter("candidate = '1.2'"), "grp", "acc", gains, "candidate")
    return e.select("candidate", F.round("macro", 6).alias("macro"), F.size("failures").cast("long").alias("failures"), "eligible")


@query(_STEP + " SELECT candidate, round(avg(acc), 6) AS macro FROM m GROUP BY 1 ORDER BY avg(acc) DESC, candidate LIMIT 1")
def best_checkpoint(t):
    by = _steps(t).groupBy("candidate").agg(F.avg("acc").alias("macro"))
    return gates.pick_best(by, [F.col("macro").desc(), F.col("candidate")]).withColumn("macro", F.round("macro", 6))


@query(_STEP + " SELECT a.candidate, count(*) FILTER (a.acc < b.acc) AS worse, round(sum(a.acc - b.acc), 6) AS gain FROM m a JOIN m b ON b.grp = a.grp AND b.candidate = '1.2' GROUP BY 1")
def never_worse(t):
    m = _steps(t)
    return gates.never_worse(m, m.filter("candidate = '1.2'"), "candidate", "grp", "acc").withColumn("gain", F.round("gain", 6))


# ---------------------------------------------------------------- decisions and logs


@query(
    """SELECT action, count(*) AS n FROM (SELECT CASE WHEN value >= 40 THEN 'stop' WHEN value >= 25 THEN 'slow' WHEN event_type = 'view' AND value < 2 THEN 'go' END AS action FROM events) GROUP BY 1"""
)
def decision_table(t):
    rules = [("stop", F.col("value") >= 40), ("slow", F.col("value") >= 25), ("go", (F.col("event_type") == "view") & (F.col("value") < 2))]
    return D.decide(t("events"), rules).groupBy("action").agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT event_id, value, CAST(props ->> '$.k' AS DOUBLE) AS k, event_type = 'error' AS down FROM events),
    w AS (SELECT *, down OR k >= 90 AS weak FROM e)
    SELECT event_id, CASE WHEN weak THEN 'near' WHEN value > 15 AND 70 + k <= 120 THEN 'far' ELSE 'near' END AS path,
    round(CASE WHEN NOT weak AND value > 15 AND 70 + k <= 120 THEN 70 + k ELSE least(115, 110) END, 3) AS latency FROM w"""
)
def routing(t):
    k = F.get_json_object("props", "$.k").cast("double")
    e = t("events").select("event_id", "value", k.alias("k"), (F.col("event_type") == "error").alias("down"))
    weak = D.weak_link(~F.col("down"), F.col("k"), F.lit(0.0), F.lit(10.0), (90, 0.5, 2))
    near = D.route(weak, F.col("value") > 15, 70 + F.col("k"), F.lit(115.0), F.when(weak | (70 + F.col("k") > 120) | (F.col("value") <= 15), F.lit(110.0)).otherwise(F.lit(120.0)))
    return e.select("event_id", near.alias("r")).select("event_id", "r.path", F.round("r.latency", 3).alias("latency"))


_LOG = "WITH l AS (SELECT sha256(concat_ws(':', user_id, props)) AS k, CASE WHEN event_type = 'purchase' THEN 'sent' ELSE 'pending' END AS status, ts, event_id FROM events)"


def _log(t):
    status = F.when(F.col("event_type") == "purchase", "sent").otherwise("pending")
    return t("events").select(outbox.outbox_id("user_id", "props").alias("k"), status.alias("status"), "ts", "event_id")


@query(_LOG + " SELECT k FROM l GROUP BY 1 HAVING arg_max(status, (ts, event_id)) = 'pending'")
def outbox_pending(t):
    return outbox.pending_fold(_log(t), "k", "status", ["ts", "event_id"])


@query(_LOG + ", b AS (SELECT *, lag(status) OVER (PARTITION BY k ORDER BY ts, event_id) AS before FROM l) SELECT k, event_id FROM b WHERE status = 'pending' AND coalesce(before, 'sent') = 'sent'")
def outbox_enqueued(t):
    return outbox.accepted_enqueues(_log(t), "k", "status", ["ts", "event_id"]).select("k", "event_id")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS end, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3")
def tumbling_windows(t):
    e = t("events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    w = outbox.windowed_counts(e, "ts", "event_type", "1 day", "1 hour")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n")


@query(
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS id FROM s)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS end, count(*) AS n FROM g GROUP BY user_id, id"""
)
def session_windows(t):
    e = t("events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    w = outbox.sessions(e, "ts", "user_id", "6 hours", "1 hour")
    return w.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT i AS group_no, i % 5 AS kind, 2 + i % 3 AS nodes, array_to_string([concat('n', (i + j) % 50) FOR j IN range(2 + i % 3)], ',') AS node_ids FROM range(500) r(i)")
def synthetic_groups(t):
    spark = t("region").sparkSession
    n = F.col("id")
    size = 2 + F.pmod(n, F.lit(3))
    return spark.range(500).select(
        n.alias("group_no"), F.pmod(n, F.lit(5)).alias("kind"), size.alias("nodes"),
        F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), size - 1), lambda j: F.concat(F.lit("n"), F.pmod(n + j, F.lit(50)).cast("string"))), ",").alias("node_ids"),
    )


from . import curation, evaluation, storage  # noqa: E402, F401 - these register their queries
