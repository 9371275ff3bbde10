"""The pN_ queries with their production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    eval_leakage,
    frozen_sample,
    near_duplicates,
    oracles,
    packing,
    proportions,
    response_defects,
    shared_spans,
    source_mixing,
    split_overlap,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(f: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, d: f(*[table(spark, d, n) for n in names])


def queries() -> dict[str, Query]:
    category = ("build_p0a5_data", "category_label", "category_target")
    mixing = ("semantic_distill_trace", "capability_rehearsal", "mix_target")
    trace = "semantic_distill_trace"
    return {
        "p1_found": _on(lambda *t: proportions.proportion_report(*t).filter("short").select("category"), *category),
        "p1_sample": _on(proportions.proportional_sample, *category),
        "p1_report": _on(proportions.proportion_report, *category),
        "p2_found": _on(
            lambda t: split_overlap.split_overlaps(t).select(
                F.least("train_id", "other_id").alias("trace_id_a"), F.greatest("train_id", "other_id").alias("trace_id_b")
            ),
            trace,
        ),
        "p2_report": _on(split_overlap.overlap_report, trace),
        "p3_found": _on(
            lambda *t: source_mixing.mixture_report(*t).filter("short").select("gate", "source_dataset"), *mixing
        ),
        "p3_mixture": _on(source_mixing.mixture, *mixing),
        "p3_report": _on(source_mixing.mixture_report, *mixing),
        "p4_found": _on(response_defects.defects, "train_p0a5_lora"),
        "p4_report": _on(response_defects.defect_report, "train_p0a5_lora"),
        "p5_found": _on(
            lambda t: near_duplicates.near_duplicate_pairs(t).select(F.col("id_a").alias("sample_id_a"), F.col("id_b").alias("sample_id_b")),
            "build_p0a5_data",
        ),
        "p5_groups": _on(near_duplicates.near_duplicate_groups, "build_p0a5_data"),
        "p6_trace_sample": _on(frozen_sample.trace_sample, trace),
        "p6_load_sample": _on(frozen_sample.load_sample, "build_p0a32_train"),
        "p7_found": _on(packing.oversized, "documents"),
        "p7_packing": _on(packing.pack, "documents"),
        "p7_report": _on(packing.packing_report, "documents"),
        "p8_found": _on(lambda d, e: eval_leakage.leaks(d, e).select("doc_id", "item_id"), "documents", "eval_item"),
        "p8_leaks": _on(eval_leakage.partial_leaks, "documents", "eval_item"),
        "p8_report": _on(eval_leakage.leak_report, "documents", "eval_item"),
        "p9_found": _on(shared_spans.shared_pairs, "documents"),
        "p9_coverage": _on(shared_spans.shared_coverage, "documents"),
    }


_USABLE = """
WITH lab AS (
  SELECT label_kind, lower(trim(label)) AS label, category FROM category_label
), rec AS (
  SELECT sample_id, any_value(domain) AS domain, any_value(task_type) AS task_type
  FROM build_p0a5_data WHERE human_verified AND sample_id IS NOT NULL GROUP BY sample_id
), said AS (
  SELECT sample_id, 'domain' AS label_kind, lower(trim(u.x)) AS label FROM rec, unnest(domain) AS u(x)
  UNION ALL
  SELECT sample_id, 'task_type', lower(trim(u.x)) FROM rec, unnest(task_type.major) AS u(x)
), own AS (
  SELECT sample_id, arg_min(t.category, t.priority) AS category
  FROM said JOIN lab USING (label_kind, label) JOIN category_target t USING (category) GROUP BY sample_id
), size AS (
  SELECT count(*) // 2 AS n FROM own
), per AS (
  SELECT t.category, t.target_permille, t.min_rows, size.n, count(o.sample_id) AS usable
  FROM category_target t CROSS JOIN size LEFT JOIN own o ON o.category = t.category GROUP BY ALL
)
"""

_MIX = """
WITH held AS (
  SELECT * FROM capability_rehearsal QUALIFY row_number() OVER (PARTITION BY gate ORDER BY created_ts DESC, total_permille DESC) = 1
), rec AS (
  SELECT lower(trim(source_dataset)) AS source, count(DISTINCT trace_id) AS usable FROM semantic_distill_trace
  WHERE lower(trim(split)) = 'train' AND trim(source_dataset) <> '' GROUP BY 1
), listed AS (
  SELECT m.gate, m.source_dataset, m.target_permille, coalesce(r.usable, 0) AS usable, h.total_permille,
    coalesce(CASE m.repeat_field
      WHEN 'synthetic_gsm8k_repeat' THEN h.synthetic_gsm8k_repeat
      WHEN 'synthetic_gsm8k_complex_repeat' THEN h.synthetic_gsm8k_complex_repeat
      WHEN 'synthetic_gsm8k_challenge_repeat' THEN h.synthetic_gsm8k_challenge_repeat
      WHEN 'synthetic_code_repeat' THEN h.synthetic_code_repeat
      WHEN 'cmmlu_validation_repeat' THEN h.cmmlu_validation_repeat END, 1) AS cap
  FROM mix_target m JOIN held h USING (gate) LEFT JOIN rec r ON r.source = lower(trim(m.source_dataset))
), goals AS (
  SELECT *, (total_permille * sum(usable) OVER (PARTITION BY gate)) // 1000 AS total FROM listed
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        **oracles.oracle_sql(),
        "p1_found": _USABLE + "SELECT category FROM per WHERE usable < greatest(min_rows, (target_permille * n + 999) // 1000)",
        "p3_found": _MIX + "SELECT gate, source_dataset FROM goals WHERE usable * cap < (target_permille * total + 999) // 1000",
    }
