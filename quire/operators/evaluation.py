"""Evaluate-and-report flow: judge replies to every report in one plan.

X7 -> J1/F1 -> A1 -> V1/V2 (V3), and J3 -> A3 -> V4 -> A4, from one scored table that is
materialized once as a table in the shared checkpoint folder, so the reports do not
each re-derive it and a lost executor restarts from that table. The scored table and the
characteristic levels are stored bucketed on ``example_id``, so the characteristic join
is co-located (no shuffle of the largest table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from quire.constants import ALL, PROMPT_TYPES
from quire.operators import reports as rp
from quire.operators import scoring as sc
from quire.session import materialize


ALL_REPORTS = ("run_stats", "scores", "em", "breakdown", "overall_breakdown")


def evaluate_and_report(evals_raw: DataFrame, tracker: DataFrame, chars_binned: DataFrame, models: list[str],
                        validity: str = ALL, prompt_types: list[str] = PROMPT_TYPES,
                        checkpoint: bool = True, reports: tuple[str, ...] = ALL_REPORTS) -> dict[str, DataFrame]:
    """Cross-run reports from raw judge replies.

    Returns the requested ``reports``: ``run_stats`` (A1 under ``validity``), ``scores``
    (V1), ``em`` (V2), ``breakdown`` (V4) and ``overall_breakdown`` (A4). Tables are
    stored only for what is requested (the characteristic levels only for breakdowns).
    """
    unknown = set(reports) - set(ALL_REPORTS)
    if unknown:
        raise ValueError(f"unknown reports {sorted(unknown)}")
    breakdowns = bool({"breakdown", "overall_breakdown"} & set(reports))
    scored = sc.with_validity(sc.parse_scores(evals_raw), tracker)
    if checkpoint:
        # both sides of the characteristic join stored bucketed on example_id: the join
        # (J3) then reads co-located buckets and shuffles neither side
        scored = materialize(scored, "scored_evaluations", bucket_by=["example_id"] if breakdowns else None)
        if breakdowns:
            chars_binned = materialize(chars_binned.select("example_id", "characteristic", "level"), "levels",
                                       bucket_by=["example_id"])
    out: dict[str, DataFrame] = {}
    if "run_stats" in reports:
        out["run_stats"] = sc.run_statistics(sc.validity_filter(scored, validity))
    if "scores" in reports:
        out["scores"] = rp.score_report(sc.run_statistics(sc.validity_filter(scored, validity), digits=None),
                                        prompt_types)
    if "em" in reports:
        out["em"] = rp.em_report(scored, prompt_types)
    if "breakdown" in reports:
        out["breakdown"] = rp.characteristic_breakdown(scored, chars_binned, models)
    if "overall_breakdown" in reports:
        out["overall_breakdown"] = rp.overall_breakdown(
            rp.characteristic_breakdown(scored, chars_binned, models, digits=None), models)
    return out
