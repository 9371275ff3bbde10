"""SQL for the pN_ queries that SQL can express, by brute force over all runs or windows of the whole tables."""

from __future__ import annotations


def tokens(c: str) -> str:
    """Chinese characters one by one, other letters, digits and underscores in unbroken runs, in lower case."""
    return f"regexp_extract_all(regexp_replace(lower({c}), '([\\x{{4E00}}-\\x{{9FFF}}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}_]+')"


def runs(t: str, k: int) -> str:
    return f"CASE WHEN len({t}) >= {k} THEN list_transform(range(1, len({t}) - {k - 2}), lambda i: array_to_string({t}[i:i + {k - 1}], ' ')) ELSE [] END"


def digest(c: str) -> str:
    plain = f"regexp_replace(regexp_replace(lower(trim({c})), '^(sha-?256[:=\\s]*|0x)', ''), '[\\s:\\-]', '', 'g')"
    return f"CASE WHEN regexp_full_match({plain}, '[0-9a-f]{{64}}') AND replace({plain}, left({plain}, 1), '') <> '' THEN {plain} END"


#: Half-width forms of the full-width signs, a fixed correspondence of code points.
WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + chr(0x3000)
NARROW = "".join(chr(0x21 + i) for i in range(94)) + " "


def plain(c: str) -> str:
    narrow = f"translate({c}, '{WIDE}', '{NARROW.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace({narrow}, '[\\x{{00AD}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g')"


_TRACES = f"""
WITH rec AS (
  SELECT trace_id, lower(trim(v.split)) AS split, {digest("v.sample_hash")} AS digest, v.evidence_items_json AS raw
  FROM (SELECT trace_id, arg_max({{'split': split, 'sample_hash': sample_hash, 'evidence_items_json': evidence_items_json}}, created_ts) AS v
    FROM semantic_distill_trace WHERE trace_id IS NOT NULL GROUP BY 1)
  WHERE trim(v.split) <> ''
), item AS (
  SELECT trace_id, j.value ->> '$.text' AS t, coalesce(try_cast(j.value ->> '$.rank' AS DOUBLE), 'inf') AS r, CAST(j.key AS INT) AS i
  FROM rec, json_each(CASE WHEN json_valid(raw) AND json_type(CASE WHEN json_valid(raw) THEN raw END) = 'ARRAY' THEN raw END) AS j
  WHERE json_type(j.value) = 'OBJECT' AND json_type(j.value, '$.text') = 'VARCHAR'
), said AS (
  SELECT trace_id, {tokens("string_agg(t, ' ' ORDER BY r, i)")} AS t FROM item GROUP BY 1
), run AS (
  SELECT trace_id, len(x) AS n, unnest(x) AS g FROM (SELECT trace_id, list_distinct({runs("t", 3)}) AS x FROM said)
), side AS (
  SELECT trace_id, split = 'train' AS train, n, g FROM run JOIN rec USING (trace_id)
), pair AS (
  SELECT a.trace_id AS x, b.trace_id AS y FROM side a JOIN side b ON a.g = b.g AND a.train AND NOT b.train
  GROUP BY a.trace_id, b.trace_id, a.n, b.n HAVING count(*) >= 0.6 * (a.n + b.n - count(*)) - 1e-9
  UNION
  SELECT a.trace_id, b.trace_id FROM rec a JOIN rec b ON a.digest = b.digest AND a.split = 'train' AND b.split <> 'train'
)
"""

_PAIRS5 = f"""
WITH RECURSIVE rec AS (
  SELECT sample_id, coalesce(v.prompt, '') || chr(10) || coalesce(v.reference, '') AS text
  FROM (SELECT sample_id, arg_max({{'prompt': prompt, 'reference': reference}}, created_ts) AS v FROM build_p0a5_data WHERE sample_id IS NOT NULL GROUP BY 1)
), run AS (
  SELECT sample_id, len(x) AS n, unnest(x) AS g FROM (SELECT sample_id, list_distinct({runs("t", 3)}) AS x FROM (SELECT sample_id, {tokens("text")} AS t FROM rec))
), pair AS (
  SELECT a.sample_id AS x, b.sample_id AS y FROM run a JOIN run b ON a.g = b.g AND a.sample_id < b.sample_id
  GROUP BY a.sample_id, b.sample_id, a.n, b.n HAVING count(*) >= 0.6 * (a.n + b.n - count(*)) - 1e-9
)
"""


def batches(source: str, key: str, label: str, name: str) -> str:
    """The first sealing of a table: the least label of a key is its batch, a tenth of each batch by salted hash is in the sample."""
    return f"""
WITH first AS (SELECT {key} AS k, min({label}) AS l FROM {source} WHERE {key} IS NOT NULL GROUP BY 1),
numbered AS (
  SELECT k, dense_rank() OVER (ORDER BY l NULLS FIRST) - 1 AS batch,
    row_number() OVER (PARTITION BY l ORDER BY substr(sha256('frozen:' || k), 1, 15), k) AS rn, count(*) OVER (PARTITION BY l) AS n FROM first
)
SELECT k AS {name}, batch FROM numbered WHERE rn <= ceil(n * 0.1 - 1e-9)"""


_WINDOWS9 = """
WITH doc AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 240),
win AS (SELECT doc_id, text, i, md5(substr(text, i, 240)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 238)) AS i FROM doc)),
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _TRACES + "SELECT least(x, y) AS trace_id_a, greatest(x, y) AS trace_id_b FROM pair",
        "p5_found": _PAIRS5 + "SELECT x AS sample_id_a, y AS sample_id_b FROM pair",
        "p5_groups": _PAIRS5
        + """, link AS (SELECT x, y FROM pair UNION ALL SELECT y, x FROM pair), reach AS (
  SELECT DISTINCT x AS id, x AS seen FROM link UNION SELECT r.id, b.y FROM reach r JOIN link b ON b.x = r.seen
), own AS (SELECT id, min(seen) AS group_id, count(*) AS group_size FROM reach GROUP BY 1)
SELECT id, group_id, group_size, (SELECT count(*) FROM link b WHERE b.x = id) AS links FROM own""",
        "p6_trace_sample": batches(
            "semantic_distill_trace", f"coalesce({digest('sample_hash')}, CASE WHEN trim(trace_id) <> '' THEN trace_id END)", "strftime(created_ts, '%Y-%m-%d')", "sample_key"
        ),
        "p6_load_sample": batches("build_p0a32_train", "CASE WHEN trim(sample_id) <> '' THEN sample_id END", "load_batch", "sample_id"),
        # a plain tokenizer: Chinese characters, up to six letters or three digits, signs; no document lies near the limit for any usual one
        "p7_found": "SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[\\x{4E00}-\\x{9FFF}]|[A-Za-z]{1,6}|\\p{N}{1,3}|[^\\s\\p{L}\\p{N}]|\\p{L}')) > 4096",
        "p8_found": f"""
WITH d AS (SELECT doc_id, {tokens(plain("text"))} AS t FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, {tokens(plain("text"))} AS t FROM eval_item WHERE text IS NOT NULL AND item_id IS NOT NULL),
dx AS (SELECT DISTINCT doc_id, unnest({runs("t", 15)}) AS g FROM d), ex AS (SELECT DISTINCT item_id, unnest({runs("t", 15)}) AS g FROM e)
SELECT DISTINCT doc_id, item_id FROM dx JOIN ex USING (g)""",
        "p9_found": _WINDOWS9
        + """one AS (SELECT DISTINCT doc_id, h FROM win)
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM one a JOIN one b ON a.h = b.h AND a.doc_id < b.doc_id""",
        "p9_coverage": _WINDOWS9
        + """hot AS (SELECT h FROM win GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
start AS (SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), i + 240) AS next FROM win JOIN hot USING (h)),
covered AS (SELECT doc_id, CAST(sum(least(240, next - i)) AS BIGINT) AS shared_chars, 1 + count(*) FILTER (next > i + 240) AS stretches FROM start GROUP BY 1),
same AS (SELECT doc_id, count(*) OVER (PARTITION BY text) - 1 AS copies, length(text) AS n_chars FROM doc)
SELECT doc_id, n_chars, shared_chars, round(shared_chars * 1.0 / n_chars, 6) AS shared_share, stretches, copies FROM covered JOIN same USING (doc_id)""",
    }
