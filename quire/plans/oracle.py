"""Independent ANSI SQL (DuckDB) for each registered query.

Written directly against the base tables (through fixture CTEs), not generated from
the DataFrame code. Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from quire.plans.fixture_sql import with_fixtures as W

ORACLE: dict[str, str] = {}

RUN = "reasoning_type, model, prompt_type"

ORACLE["x7_score_parse"] = W("scored") + """
SELECT example_id, model, prompt_type, reasoning_type, judge_raw, accuracy, em_accuracy FROM scored"""

ORACLE["j1_evals_tracker"] = W("scored", "tracker") + """
SELECT s.example_id, model, prompt_type, reasoning_type, accuracy, t.table_validity
FROM scored s LEFT JOIN tracker t ON t.example_id = s.example_id"""


def _stats(where: str, extra_keys: str = "") -> str:
    return f"""
SELECT {extra_keys}{RUN}, count(*) AS n, round(avg(accuracy), 6) AS mean,
       round(median(accuracy), 6) AS median, round(stddev_samp(accuracy), 6) AS stdev,
       max(accuracy) AS max, min(accuracy) AS min, round(avg(em_accuracy), 6) AS em_accuracy
FROM scored s LEFT JOIN tracker t ON t.example_id = s.example_id
WHERE accuracy IS NOT NULL AND ({where})
GROUP BY {extra_keys}{RUN}"""


ORACLE["a1_run_stats"] = W("scored", "tracker") + _stats("TRUE")
ORACLE["f1_run_stats_no_invalid"] = W("scored", "tracker") + _stats(
    "t.table_validity IS NULL OR t.table_validity <> 0")
ORACLE["f1_run_stats_only_valid"] = W("scored", "tracker") + _stats(
    "t.table_validity IS NOT NULL AND t.table_validity <> 0")
ORACLE["a1_run_stats_all_modes"] = W("scored", "tracker") + """
SELECT validity, reasoning_type, model, prompt_type, count(*) AS n, round(avg(accuracy), 6) AS mean,
       round(median(accuracy), 6) AS median, round(stddev_samp(accuracy), 6) AS stdev,
       max(accuracy) AS max, min(accuracy) AS min, round(avg(em_accuracy), 6) AS em_accuracy
FROM (SELECT 'all' AS validity, s.* FROM scored s
      UNION ALL
      SELECT 'no_invalid', s.* FROM scored s LEFT JOIN tracker t ON t.example_id = s.example_id
      WHERE t.table_validity IS NULL OR t.table_validity <> 0
      UNION ALL
      SELECT 'only_valid', s.* FROM scored s JOIN tracker t ON t.example_id = s.example_id
      WHERE t.table_validity <> 0) x
WHERE accuracy IS NOT NULL
GROUP BY validity, reasoning_type, model, prompt_type"""

ORACLE["a2_em_rate"] = W("scored") + f"""
SELECT {RUN}, round(avg(CASE WHEN accuracy IN (9, 10) THEN 1 ELSE 0 END), 6) AS em
FROM scored GROUP BY {RUN}"""


def _wide(src: str, scale: str) -> str:
    cells = ["\"zero-shot\"", "\"zero-shot-CoT\"", "\"few-shot\"", "\"few-shot-CoT\""]
    present = " + ".join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)" for c in cells)
    total = " + ".join(f"coalesce({c}, 0)" for c in cells)
    return f"""
SELECT reasoning_type, model,
       round("zero-shot" * {scale}, 6) AS "zero-shot", round("zero-shot-CoT" * {scale}, 6) AS "zero-shot-CoT",
       round("few-shot" * {scale}, 6) AS "few-shot", round("few-shot-CoT" * {scale}, 6) AS "few-shot-CoT",
       round(CASE WHEN ({present}) > 0 THEN ({total}) / ({present}) END * {scale}, 6) AS "Overall"
FROM (SELECT reasoning_type, model,
             max(CASE WHEN prompt_type = 'zero-shot' THEN v END) AS "zero-shot",
             max(CASE WHEN prompt_type = 'zero-shot-CoT' THEN v END) AS "zero-shot-CoT",
             max(CASE WHEN prompt_type = 'few-shot' THEN v END) AS "few-shot",
             max(CASE WHEN prompt_type = 'few-shot-CoT' THEN v END) AS "few-shot-CoT"
      FROM ({src}) q GROUP BY reasoning_type, model) w"""


_MEANS = f"SELECT {RUN}, avg(accuracy) AS v FROM scored WHERE accuracy IS NOT NULL GROUP BY {RUN}"
_EMS = f"SELECT {RUN}, avg(CASE WHEN accuracy IN (9, 10) THEN 1.0 ELSE 0.0 END) AS v FROM scored GROUP BY {RUN}"
ORACLE["v1_score_report"] = W("scored") + _wide(_MEANS, "10.0")
ORACLE["v2_em_report"] = W("scored") + _wide(_EMS, "100.0")
ORACLE["v3_all_reports"] = W("scored") + f"""
SELECT *, 'score' AS report FROM ({_wide(_MEANS, "10.0")}) a
UNION ALL
SELECT *, 'em' AS report FROM ({_wide(_EMS, "100.0")}) b"""

_BREAKDOWN = """
SELECT s.reasoning_type, b.characteristic, s.prompt_type, b.level, s.model,
       avg(coalesce(s.accuracy, 0)) AS v
FROM scored s JOIN binned b ON b.example_id = s.example_id
{where}
GROUP BY s.reasoning_type, b.characteristic, s.prompt_type, b.level, s.model"""


def _breakdown_wide(where: str, digits: bool = True) -> str:
    r = (lambda x: f"round({x}, 6)") if digits else (lambda x: x)
    return f"""
SELECT k.reasoning_type, k.characteristic, k.prompt_type, l.level,
       {r("max(CASE WHEN g.model = 'model_a' THEN g.v END) * 10.0")} AS model_a,
       {r("max(CASE WHEN g.model = 'model_b' THEN g.v END) * 10.0")} AS model_b,
       {r("max(CASE WHEN g.model = 'model_c' THEN g.v END) * 10.0")} AS model_c
FROM (SELECT DISTINCT reasoning_type, characteristic, prompt_type FROM ({_BREAKDOWN.format(where=where)}) z) k
CROSS JOIN (VALUES (0), (1)) AS l(level)
LEFT JOIN ({_BREAKDOWN.format(where=where)}) g
  ON g.reasoning_type = k.reasoning_type AND g.characteristic = k.characteristic
 AND g.prompt_type = k.prompt_type AND g.level = l.level
GROUP BY k.reasoning_type, k.characteristic, k.prompt_type, l.level"""


ORACLE["a3_characteristic_breakdown"] = W("scored", "binned") + _breakdown_wide(
    "WHERE b.characteristic = 'multi-hop' AND s.prompt_type = 'zero-shot-CoT'")
ORACLE["v4_breakdown_all"] = W("scored", "binned") + _breakdown_wide("")
ORACLE["a4_overall_breakdown"] = W("scored", "binned") + f"""
SELECT reasoning_type, characteristic, level,
       round(CASE WHEN count(model_a) = 4 THEN avg(model_a) END, 6) AS model_a,
       round(CASE WHEN count(model_b) = 4 THEN avg(model_b) END, 6) AS model_b,
       round(CASE WHEN count(model_c) = 4 THEN avg(model_c) END, 6) AS model_c
FROM ({_breakdown_wide("", digits=False)}) v
GROUP BY reasoning_type, characteristic, level"""

ORACLE["a5_dataset_characteristics"] = W("binned") + """
SELECT l.level,
       count(*) FILTER (WHERE b.characteristic = 'multi-hop') AS "multi-hop",
       count(*) FILTER (WHERE b.characteristic = 'temporal') AS temporal,
       count(*) FILTER (WHERE b.characteristic = 'numeric') AS numeric,
       count(*) FILTER (WHERE b.characteristic = 'information_aggregation') AS information_aggregation,
       count(*) FILTER (WHERE b.characteristic = 'soft_reasoning') AS soft_reasoning
FROM (VALUES (0), (1)) AS l(level) LEFT JOIN binned b ON b.level = l.level
GROUP BY l.level"""

ORACLE["a6_score_frequency"] = W("characteristics") + """
SELECT characteristic, score, count(*) AS frequency FROM characteristics GROUP BY characteristic, score"""

ORACLE["a11_balanced_binning"] = W("binned") + "SELECT example_id, characteristic, score, level FROM binned"

ORACLE["j3_eval_characteristics"] = W("scored", "binned") + """
SELECT s.example_id, s.model, s.prompt_type, s.reasoning_type, b.characteristic, b.level, s.accuracy
FROM scored s JOIN binned b ON b.example_id = s.example_id"""

ORACLE["a8_validity_agreement"] = W("examples") + """
SELECT count(*) AS n_labelled,
       round(avg(CASE WHEN human_validity = (CASE WHEN validity_scalar IN (4, 5) THEN 1 ELSE 0 END) THEN 1 ELSE 0 END), 6) AS proportion_matching,
       round(avg(human_validity), 6) AS proportion_valid,
       round(avg(CASE WHEN validity_scalar IN (4, 5) THEN 1 ELSE 0 END), 6) AS proportion_valid_llm,
       round(CASE WHEN sum(CASE WHEN validity_scalar IN (4, 5) THEN 1 ELSE 0 END) > 0 THEN
             sum(CASE WHEN human_validity <> 0 AND validity_scalar IN (4, 5) THEN 1 ELSE 0 END) * 1.0
             / sum(CASE WHEN validity_scalar IN (4, 5) THEN 1 ELSE 0 END) END, 6) AS valid_proportion_matching,
       CAST(sum(CASE WHEN human_validity <> 0 AND validity_scalar IN (4, 5) THEN 1 ELSE 0 END) AS BIGINT) AS n_both_valid
FROM examples WHERE human_validity IS NOT NULL"""

ORACLE["n6_validity_records"] = W("examples") + """
SELECT example_id, CAST(human_validity AS INTEGER) AS human_validity,
       CASE WHEN validity_scalar IN (4, 5) THEN 1 ELSE 0 END AS llm_validity,
       CASE WHEN human_validity = (CASE WHEN validity_scalar IN (4, 5) THEN 1 ELSE 0 END) THEN 1 ELSE 0 END AS correct_validity
FROM examples WHERE human_validity IS NOT NULL"""

ORACLE["p9_llm_validity"] = W("examples") + """
SELECT example_id, validity_scalar IN (4, 5) AS llm_valid FROM examples"""
ORACLE["v3_reports_from_checkpoint"] = ORACLE["v3_all_reports"]

ORACLE["v2_em_report_only_valid"] = W("scored", "tracker") + _wide(
    f"SELECT {RUN}, avg(CASE WHEN accuracy IN (9, 10) THEN 1.0 ELSE 0.0 END) AS v FROM scored s "
    "JOIN tracker t ON t.example_id = s.example_id WHERE t.table_validity <> 0 GROUP BY " + RUN, "100.0")
ORACLE["a4_overall_from_checkpoint"] = ORACLE["a4_overall_breakdown"]
