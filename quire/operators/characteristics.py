"""Characteristic scores: reply parsing, map reshaping, balanced binning.

Long form ``(example_id, characteristic, score)`` is the working shape: it never
needs a per-example map in memory and joins on ``example_id`` like any other table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import schemas

REPLY_SCHEMA = schemas.CHARACTERISTIC_REPLY


def balanced_binning(chars: DataFrame, score: str = "score") -> DataFrame:
    """Bin 0/1/2 scores to 0/1 per characteristic, choosing the more balanced split.

    With counts n0, n1, n2 over all examples: if |n0+n1-n2| < |n1+n2-n0| then
    level = (score >= 2) else level = (score > 0); ties take the second rule.
    The counts are one partial aggregate (a row per characteristic); adaptive
    execution broadcasts that side once it has measured it.
    """
    s = F.col(score)
    counts = chars.groupBy("characteristic").agg(
        F.count_if(s == 0).alias("n0"), F.count_if(s == 1).alias("n1"), F.count_if(s == 2).alias("n2"))
    rule = counts.select("characteristic", (F.abs(F.col("n0") + F.col("n1") - F.col("n2"))
                                            < F.abs(F.col("n1") + F.col("n2") - F.col("n0"))).alias("_merge_low"))
    j = chars.join(rule, "characteristic")
    level = F.when(s.isNull(), F.lit(None)).when(F.col("_merge_low"), F.when(s < 2, 0).otherwise(1)) \
             .otherwise(F.when(s > 0, 1).otherwise(0))
    return j.select("example_id", "characteristic", score, level.cast("int").alias("level"))


def _one_per_pair(chars: DataFrame, value: str) -> DataFrame:
    """One value per (example, characteristic): repeated rows are combined map-side first,
    so the per-example collect below is bounded by the number of characteristic names."""
    return chars.groupBy("example_id", "characteristic").agg(F.max(value).alias(value))


def scores_to_map(chars: DataFrame, value: str = "score") -> DataFrame:
    """N4 (rows -> map): one ``characteristic -> value`` map per example."""
    return _one_per_pair(chars, value).groupBy("example_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("characteristic", value)))).alias("scores"))


def map_to_scores(df: DataFrame, col: str = "scores", value: str = "score") -> DataFrame:
    """N4 (map -> rows)."""
    return df.select("example_id", F.explode(col).alias("characteristic", value))


def render_replies(chars: DataFrame) -> DataFrame:
    """Characteristic replies as JSON text ``{"scores": {c: {"rationale", "score"}}}``."""
    entry = F.struct(F.concat(F.lit("level "), F.col("score").cast("string")).alias("rationale"),
                     F.col("score").alias("score"))
    m = _one_per_pair(chars, "score").groupBy("example_id").agg(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("characteristic", entry)))).alias("scores"))
    return m.select("example_id", F.to_json(F.struct(F.lit("").alias("concise_answers"), "scores")).alias("reply"))


def parse_replies(replies: DataFrame, text: str = "reply") -> DataFrame:
    """N2 + N3 + J6: parse replies, project ``{c: {score, rationale}} -> {c: score}``,
    keep the example id (join by key, never by position). Unparsable replies drop out
    here and are reported by :func:`quire.operators.jsonops.quarantine`."""
    parsed = replies.select("example_id", F.from_json(F.col(text), REPLY_SCHEMA).alias("r"))
    ok = parsed.where(F.col("r.scores").isNotNull())
    return ok.select("example_id", F.transform_values("r.scores", lambda k, v: v["score"]).alias("scores"))
