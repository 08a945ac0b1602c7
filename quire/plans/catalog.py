"""Registered queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Each runs over the whole test tables (through the fixture views) and returns a lazy
DataFrame. Column names equal those of the matching oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.constants import ALL, NO_INVALID, ONLY_VALID
from quire.operators import characteristics as ch
from quire.operators import reports as rp
from quire.operators import scoring as sc
from quire.sources import tables as tb

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _scored(spark, d):
    return sc.parse_scores(tb.evaluations(spark, d))


def _binned(spark, d):
    return ch.balanced_binning(tb.characteristics(spark, d))


# ---------------------------------------------------------------- scoring
@query("x7_score_parse")
def x7_score_parse(spark, d):
    return _scored(spark, d).select("example_id", "model", "prompt_type", "reasoning_type",
                                    "judge_raw", "accuracy", "em_accuracy")


@query("j1_evals_tracker")
def j1_evals_tracker(spark, d):
    return sc.with_validity(_scored(spark, d), tb.tracker(spark, d)).select(
        "example_id", "model", "prompt_type", "reasoning_type", "accuracy", "table_validity")


@query("a1_run_stats")
def a1_run_stats(spark, d):
    return sc.evaluate_runs(tb.evaluations(spark, d), tb.tracker(spark, d), ALL)


@query("f1_run_stats_no_invalid")
def f1_run_stats_no_invalid(spark, d):
    return sc.evaluate_runs(tb.evaluations(spark, d), tb.tracker(spark, d), NO_INVALID)


@query("f1_run_stats_only_valid")
def f1_run_stats_only_valid(spark, d):
    return sc.evaluate_runs(tb.evaluations(spark, d), tb.tracker(spark, d), ONLY_VALID)


@query("a1_run_stats_all_modes")
def a1_run_stats_all_modes(spark, d):
    return sc.evaluate_runs_all_modes(tb.evaluations(spark, d), tb.tracker(spark, d))


# ---------------------------------------------------------------- reports
@query("a2_em_rate")
def a2_em_rate(spark, d):
    return rp.em_rates(_scored(spark, d))


@query("v1_score_report")
def v1_score_report(spark, d):
    return rp.score_report(sc.evaluate_runs(tb.evaluations(spark, d), tb.tracker(spark, d), ALL, digits=None))


@query("v2_em_report")
def v2_em_report(spark, d):
    return rp.em_report(_scored(spark, d))


@query("v3_all_reports")
def v3_all_reports(spark, d):
    ev = _scored(spark, d)
    return rp.all_reports(sc.run_statistics(ev, digits=None), ev)


@query("a3_characteristic_breakdown")
def a3_characteristic_breakdown(spark, d):
    return rp.characteristic_breakdown(_scored(spark, d), _binned(spark, d), tb.FIXTURE_MODELS,
                                       characteristic="multi-hop", prompt_type="zero-shot-CoT")


@query("v4_breakdown_all")
def v4_breakdown_all(spark, d):
    return rp.characteristic_breakdown(_scored(spark, d), _binned(spark, d), tb.FIXTURE_MODELS)


@query("a4_overall_breakdown")
def a4_overall_breakdown(spark, d):
    v4 = rp.characteristic_breakdown(_scored(spark, d), _binned(spark, d), tb.FIXTURE_MODELS, digits=None)
    return rp.overall_breakdown(v4, tb.FIXTURE_MODELS)


@query("a5_dataset_characteristics")
def a5_dataset_characteristics(spark, d):
    return rp.dataset_characteristic_counts(_binned(spark, d))


@query("a6_score_frequency")
def a6_score_frequency(spark, d):
    return rp.score_frequency(tb.characteristics(spark, d))


@query("a11_balanced_binning")
def a11_balanced_binning(spark, d):
    return _binned(spark, d)


@query("j3_eval_characteristics")
def j3_eval_characteristics(spark, d):
    return rp.breakdown_long(_scored(spark, d), _binned(spark, d)).select(
        "example_id", "model", "prompt_type", "reasoning_type", "characteristic", "level", "accuracy")


@query("a8_validity_agreement")
def a8_validity_agreement(spark, d):
    return rp.validity_agreement(tb.examples(spark, d))


@query("n6_validity_records")
def n6_validity_records(spark, d):
    return rp.validity_records(tb.examples(spark, d))


@query("p9_llm_validity")
def p9_llm_validity(spark, d):
    return tb.examples(spark, d).select("example_id", sc.llm_valid("validity_scalar").alias("llm_valid"))


FLAGSHIP = "v1_score_report"


@query("v3_reports_from_checkpoint")
def v3_reports_from_checkpoint(spark, d):
    """V3 through the evaluate-and-report flow (scored table materialized once)."""
    from quire.operators.evaluation import evaluate_and_report

    out = evaluate_and_report(tb.evaluations(spark, d), tb.tracker(spark, d), _binned(spark, d), tb.FIXTURE_MODELS,
                              reports=("scores", "em"))
    return out["scores"].withColumn("report", F.lit("score")).unionByName(
        out["em"].withColumn("report", F.lit("em")))


@query("v2_em_report_only_valid")
def v2_em_report_only_valid(spark, d):
    """V2 with the validity filter applied (the optional filtered EM population)."""
    ev = sc.with_validity(_scored(spark, d), tb.tracker(spark, d))
    return rp.em_report(ev, validity=ONLY_VALID)


@query("a4_overall_from_checkpoint")
def a4_overall_from_checkpoint(spark, d):
    """A4 through the evaluate-and-report flow: scored evaluations and characteristic levels
    stored bucketed on example_id, joined without a shuffle."""
    from quire.operators.evaluation import evaluate_and_report

    out = evaluate_and_report(tb.evaluations(spark, d), tb.tracker(spark, d), _binned(spark, d), tb.FIXTURE_MODELS,
                              reports=("overall_breakdown",))
    return out["overall_breakdown"]
