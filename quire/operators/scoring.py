"""Judge-score parsing, validity filtering and per-run statistics.

Run statistics are computed from a per-run score histogram: the first aggregation
``(run, score) -> count`` combines map-side, so the shuffle carries at most one row
per distinct score per run and per partition, however many evaluations a run holds.
Mean, sample deviation, min, max, EM rate and the exact interpolated median are then
read off that histogram. No per-group value buffer (``percentile``/``median``) is
ever built, so a run holding a third of all rows costs the same as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.constants import ALL, NO_INVALID, ONLY_VALID
from quire.functions.text import parse_int

RUN_KEYS = ["reasoning_type", "model", "prompt_type"]


def em_flag(score) -> Column:
    """P10: exact-match flag, score > 8; NULL when the score did not parse."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s.isNotNull(), (s > 8).cast("int"))


def parse_scores(evals: DataFrame, raw: str = "judge_raw") -> DataFrame:
    """X7 + P10: add ``accuracy`` (strict int or NULL) and ``em_accuracy``."""
    acc = parse_int(raw)
    return evals.select("*", acc.alias("accuracy"), em_flag(acc).alias("em_accuracy"))


def llm_valid(validity_scalar) -> Column:
    """The generator's own validity score is 4 or 5."""
    v = F.col(validity_scalar) if isinstance(validity_scalar, str) else validity_scalar
    return v.isin(4, 5)


def with_validity(evals: DataFrame, tracker: DataFrame, key: str = "example_id") -> DataFrame:
    """Attach the human label; an id missing from the tracker is unlabelled (NULL).

    No broadcast hint: the tracker grows with the dataset, so the planner picks
    broadcast only when adaptive execution has measured it below the threshold.
    """
    return evals.join(tracker, key, "left")


def validity_predicate(mode: str, label: str = "table_validity") -> Column:
    """``all`` keeps every row; ``no_invalid`` drops 0 and keeps unlabelled;
    ``only_valid`` drops 0 and unlabelled."""
    v = F.col(label)
    if mode == ALL:
        return F.lit(True)
    if mode == NO_INVALID:
        return v.isNull() | (v != 0)
    if mode == ONLY_VALID:
        return v.isNotNull() & (v != 0)
    raise ValueError(f"unknown validity mode {mode!r}")


def validity_filter(df: DataFrame, mode: str, label: str = "table_validity") -> DataFrame:
    """F1 as a filter."""
    return df if mode == ALL else df.where(validity_predicate(mode, label))


def scored_only(df: DataFrame, score: str = "accuracy") -> DataFrame:
    """F2: only rows whose score parsed as an integer count."""
    return df.where(F.col(score).isNotNull())


def score_histogram(df: DataFrame, keys: list[str], score: str = "accuracy") -> DataFrame:
    """``(keys, score) -> n`` over parsed scores; combines map-side."""
    return scored_only(df, score).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n"))


def histogram_statistics(hist: DataFrame, keys: list[str], score: str = "accuracy",
                         em_threshold: int = 8, digits: int | None = 6) -> DataFrame:
    """Exact mean, median (interpolated), sample stdev, max, min and EM rate per key."""
    s = F.col(score)
    w_cum = Window.partitionBy(*keys).orderBy(s).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = hist.select("*", F.sum("_n").over(w_cum).alias("_cum"),
                    F.sum("_n").over(Window.partitionBy(*keys)).alias("_tot"))
    n = F.col("_tot")
    lo_k = F.floor((n - 1) / 2)  # 0-based ranks of the middle pair
    hi_k = F.floor(n / 2)
    agg = h.groupBy(*keys).agg(
        F.max("_tot").alias("n"),
        F.sum(F.col("_n") * s).alias("_s1"),
        F.sum(F.col("_n") * s * s).alias("_s2"),
        F.min(F.when(F.col("_cum") > lo_k, s)).alias("_m_lo"),
        F.min(F.when(F.col("_cum") > hi_k, s)).alias("_m_hi"),
        F.max(s).alias("max"), F.min(s).alias("min"),
        F.sum(F.when(s > em_threshold, F.col("_n")).otherwise(0)).alias("_em"))
    nn = F.col("n").cast("double")
    s1 = F.col("_s1").cast("double")
    var = (nn * F.col("_s2").cast("double") - s1 * s1) / (nn * (nn - 1))
    def r(c: Column) -> Column:
        return F.round(c, digits) if digits is not None else c

    return agg.select(
        *keys, "n",
        r(s1 / nn).alias("mean"),
        r((F.col("_m_lo") + F.col("_m_hi")) / 2.0).alias("median"),
        r(F.when(F.col("n") > 1, F.sqrt(F.greatest(var, F.lit(0.0))))).alias("stdev"),
        F.col("max").cast("bigint").alias("max"), F.col("min").cast("bigint").alias("min"),
        r(F.col("_em") / nn).alias("em_accuracy"))


def run_statistics(evals: DataFrame, keys: list[str] = RUN_KEYS, score: str = "accuracy",
                   digits: int | None = 6) -> DataFrame:
    """A1: statistics per run over rows with a parsed score."""
    return histogram_statistics(score_histogram(evals, keys, score), keys, score, digits=digits)


def evaluate_runs(evals_raw: DataFrame, tracker: DataFrame, mode: str = ALL,
                  keys: list[str] = RUN_KEYS, digits: int | None = 6) -> DataFrame:
    """X7 -> J1 -> F1 -> F2 -> A1: the per-run accuracy summary under a validity mode."""
    ev = parse_scores(evals_raw)
    if mode != ALL:
        ev = validity_filter(with_validity(ev, tracker), mode)
    return run_statistics(ev, keys, digits=digits)


def evaluate_runs_all_modes(evals_raw: DataFrame, tracker: DataFrame,
                            keys: list[str] = RUN_KEYS, digits: int | None = 6) -> DataFrame:
    """A1 for the three validity modes in one pass: one join, one histogram.

    Each parsed row is tagged with the modes it passes (an ``explode`` of at most three
    literals), so the three summaries share one scan and one shuffle.
    """
    ev = with_validity(parse_scores(evals_raw), tracker)
    modes = F.array(*[F.when(validity_predicate(m), F.lit(m)) for m in (ALL, NO_INVALID, ONLY_VALID)])
    tagged = ev.select("*", F.explode(F.filter(modes, lambda x: x.isNotNull())).alias("validity"))
    return run_statistics(tagged, ["validity", *keys], digits=digits)
