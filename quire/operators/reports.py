"""Cross-run reports: EM rates, model x prompt pivots, characteristic breakdowns,
dataset counts, generation-score statistics, human/LLM agreement (A2-A8, V1-V4).

All pivots take an explicit value list: a fixed output schema and no extra job to
discover the values. Inputs to pivots are already aggregated (one row per run), so
the pivot shuffles a handful of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.constants import ALL, CHARACTERISTICS, LEVELS, PROMPT_TYPES
from quire.operators.scoring import RUN_KEYS, llm_valid, run_statistics, validity_filter


def _round(c: Column, digits: int | None) -> Column:
    return F.round(c, digits) if digits is not None else c


def em_rates(evals: DataFrame, keys: list[str] = RUN_KEYS, digits: int | None = 6) -> DataFrame:
    """A2: share of rows scoring 9 or 10; the denominator is every row, unparsed included."""
    hit = F.when(F.col("accuracy").isin(9, 10), 1).otherwise(0)
    return evals.groupBy(*keys).agg(_round(F.avg(hit), digits).alias("em"))


def mean_of_present(cols: list[Column]) -> Column:
    """Mean of the non-NULL cells of a row; NULL when all are NULL."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.when(count > 0, total / count)


def wide_by_prompt_type(long: DataFrame, value: str, index: list[str], scale: float,
                        prompt_types: list[str] = PROMPT_TYPES, digits: int | None = 6) -> DataFrame:
    """V1/V2: pivot prompt types into columns (fixed order), add Overall, scale."""
    wide = long.groupBy(*index).pivot("prompt_type", prompt_types).agg(F.max(value))  # one value per cell
    cells = [F.col(f"`{p}`") for p in prompt_types]
    return wide.select(*index, *[_round(c * scale, digits).alias(p) for c, p in zip(cells, prompt_types)],
                       _round(mean_of_present(cells) * scale, digits).alias("Overall"))


def score_report(run_stats: DataFrame, prompt_types: list[str] = PROMPT_TYPES,
                 digits: int | None = 6) -> DataFrame:
    """V1 (+V3): model x prompt-type mean scores x10 per context type."""
    return wide_by_prompt_type(run_stats, "mean", ["reasoning_type", "model"], 10.0, prompt_types, digits)


def em_report(evals: DataFrame, prompt_types: list[str] = PROMPT_TYPES, digits: int | None = 6,
              validity: str = ALL) -> DataFrame:
    """V2 (+V3): model x prompt-type EM rate x100 per context type.

    By default from all rows, as the original report (its EM table ignores the validity
    filter the score table applies); ``validity`` applies F1 here too (``evals`` then
    needs the ``table_validity`` column, see :func:`quire.operators.scoring.with_validity`).
    """
    ev = evals if validity == ALL else validity_filter(evals, validity)
    return wide_by_prompt_type(em_rates(ev, digits=None), "em", ["reasoning_type", "model"], 100.0,
                               prompt_types, digits)


def all_reports(run_stats: DataFrame, evals: DataFrame, prompt_types: list[str] = PROMPT_TYPES,
                digits: int | None = 6, em_validity: str = ALL) -> DataFrame:
    """V3: both reports for both context types, tagged by ``report``."""
    a = score_report(run_stats, prompt_types, digits).withColumn("report", F.lit("score"))
    b = em_report(evals, prompt_types, digits, em_validity).withColumn("report", F.lit("em"))
    return a.unionByName(b)


def level_frame(spark: SparkSession, levels: list[int] = LEVELS) -> DataFrame:
    return spark.createDataFrame([(lv,) for lv in levels], "level int")


def breakdown_long(evals: DataFrame, chars: DataFrame, characteristic: str | None = None,
                   prompt_type: str | None = None) -> DataFrame:
    """J3 + A3 input: evaluations joined to (binned) characteristic levels.

    Unparsed scores count as 0 here (the reference's rule for this report).
    """
    c = chars.select("example_id", "characteristic", F.col("level"))
    if characteristic is not None:
        c = c.where(F.col("characteristic") == characteristic)
    e = evals if prompt_type is None else evals.where(F.col("prompt_type") == prompt_type)
    return e.join(c, "example_id").withColumn("_score0", F.coalesce(F.col("accuracy"), F.lit(0)))


def characteristic_breakdown(evals: DataFrame, chars: DataFrame, models: list[str],
                             characteristic: str | None = None, prompt_type: str | None = None,
                             levels: list[int] = LEVELS, digits: int | None = 6) -> DataFrame:
    """A3 / V4: mean score x10 per difficulty level and model.

    Keyed by ``(reasoning_type, characteristic, prompt_type, level)``; filtering one
    characteristic and prompt type gives the single A3 table. Every level of the fixed
    list appears; an empty cell is NULL.
    """
    keys = ["reasoning_type", "characteristic", "prompt_type"]
    j = breakdown_long(evals, chars, characteristic, prompt_type)
    agg = j.groupBy(*keys, "level").pivot("model", models).agg(F.avg("_score0"))
    # every key combination seen (read off the small aggregate) times the fixed level list
    combos = agg.select(*keys).distinct().select(
        *keys, F.explode(F.array(*[F.lit(lv) for lv in levels])).alias("level"))
    out = combos.join(agg, [*keys, "level"], "left")
    return out.select(*keys, "level", *[_round(F.col(m) * 10.0, digits).alias(m) for m in models])


def overall_breakdown(breakdown: DataFrame, models: list[str], n_prompt_types: int = 4,
                      digits: int | None = 6) -> DataFrame:
    """A4: mean of the per-prompt-type breakdowns; NULL unless all four cells exist."""
    keys = ["reasoning_type", "characteristic", "level"]
    return breakdown.groupBy(*keys).agg(*[
        _round(F.when(F.count(m) == n_prompt_types, F.avg(m)), digits).alias(m) for m in models])


def dataset_characteristic_counts(chars: DataFrame, names: list[str] = CHARACTERISTICS,
                                  levels: list[int] = LEVELS) -> DataFrame:
    """A5: level x characteristic counts, zeros filled, every fixed level present."""
    spark = chars.sparkSession
    counts = chars.groupBy("level").pivot("characteristic", names).count()
    out = level_frame(spark, levels).join(counts, "level", "left")
    return out.select("level", *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).cast("bigint").alias(n) for n in names])


def score_frequency(chars: DataFrame) -> DataFrame:
    """Frequency of each score per characteristic."""
    return chars.groupBy("characteristic", "score").agg(F.count(F.lit(1)).alias("frequency"))


def generation_score_stats(logs: DataFrame, kinds: dict[str, str], digits: int | None = 6) -> DataFrame:
    """Mean, min, max and sample stdev per score kind (unpivot, then one aggregate)."""
    stacked = logs.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(c).cast("bigint").alias("score")) for k, c in kinds.items()
    ])).alias("s")).select("s.kind", "s.score").where(F.col("score").isNotNull())
    return stacked.groupBy("kind").agg(
        _round(F.avg("score"), digits).alias("mean"), F.min("score").alias("min"),
        F.max("score").alias("max"), _round(F.stddev_samp("score"), digits).alias("stdev"),
        F.count(F.lit(1)).alias("n"))


def validity_agreement(examples: DataFrame, human: str = "human_validity",
                       scalar: str = "validity_scalar", digits: int | None = 6) -> DataFrame:
    """A8 (+F7, P9, U4): agreement between human labels and the generator's validity score."""
    lab = examples.where(F.col(human).isNotNull())  # F7
    h = F.col(human).cast("int")
    llm = llm_valid(scalar).cast("int")
    both = F.when((h != 0) & (llm == 1), 1).otherwise(0)
    agg = lab.agg(F.count(F.lit(1)).alias("n_labelled"),
                  F.avg((h == llm).cast("int")).alias("proportion_matching"),
                  F.avg(h).alias("proportion_valid"),
                  F.avg(llm).alias("proportion_valid_llm"),
                  F.sum(both).alias("n_both_valid"),
                  F.sum(llm).alias("n_llm_valid"))
    return agg.select(
        "n_labelled", _round(F.col("proportion_matching"), digits).alias("proportion_matching"),
        _round(F.col("proportion_valid"), digits).alias("proportion_valid"),
        _round(F.col("proportion_valid_llm"), digits).alias("proportion_valid_llm"),
        _round(F.try_divide(F.col("n_both_valid").cast("double"), F.col("n_llm_valid")), digits)
        .alias("valid_proportion_matching"),
        F.col("n_both_valid").cast("bigint").alias("n_both_valid"))


def validity_records(examples: DataFrame, human: str = "human_validity",
                     scalar: str = "validity_scalar") -> DataFrame:
    """Per labelled example, the human label and whether the generator agreed."""
    lab = examples.where(F.col(human).isNotNull())
    return lab.select("example_id", F.col(human).cast("int").alias("human_validity"),
                      llm_valid(scalar).cast("int").alias("llm_validity"),
                      (F.col(human).cast("int") == llm_valid(scalar).cast("int")).cast("int")
                      .alias("correct_validity"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["run_statistics"]
