"""Conversation tables ``(conv_id, turn, role, text)``.

Aggregates are partial; ordered work runs over ranges of (conversation, turn), so a conversation of any length is spread
over tasks (:mod:`quire.operators.ranges`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.constants import DONT_KNOW, TERMINATE
from quire.operators.ranges import CHUNK_BYTES, ranged, text_chunks, whole_texts


def final_answers(conv: DataFrame, key: str = "conv_id") -> DataFrame:
    """E3 + E2: last message that is not ``TERMINATE``; a conversation with none gets the
    fixed don't-know reply. ``max_by`` keeps one value per group, no list is built."""
    last = F.max_by(F.when(F.col("text") != TERMINATE, F.col("text")),
                    F.when(F.col("text") != TERMINATE, F.col("turn")))
    return conv.groupBy(key).agg(F.coalesce(last, F.lit(DONT_KNOW)).alias("answer"))


def chat_chunks(conv: DataFrame, key: str = "conv_id", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Z2 for conversations of any length: (key, seq, text) chunks of a conversation's messages joined by line breaks,
    in turn order. Joining a conversation's chunks by line breaks gives its :func:`chat_text`."""
    c = text_chunks(conv, key, ["turn"], F.col("text"), chunk_bytes=chunk_bytes)
    return c.where("whole OR n_lines > 0").select(F.col("key").alias(key), "seq", "text")


def chat_text(conv: DataFrame, key: str = "conv_id", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A conversation's messages joined by line breaks, in turn order (ties: of the text; NULL texts are left out).

    Ranges of turns are joined where they lie, so a long conversation's messages are never gathered in one task."""
    c = text_chunks(conv, key, ["turn"], F.col("text"), chunk_bytes=chunk_bytes)
    return whole_texts(c).select(F.col("key").alias(key), F.col("text").alias("chat"))


def transition_violations(conv: DataFrame, allowed: DataFrame, key: str = "conv_id") -> DataFrame:
    """Z3: turns whose (previous role -> role) edge is not in the allowed graph (ties in turn: ordered by role).

    Conversations are cut into ranges of turns and each range's last role is carried over to the next, so a
    conversation that holds most rows is spread over many tasks. ``allowed`` is ``(src, dst)`` rows; the planner
    broadcasts them when they are small.
    """
    t = ranged(conv.select(key, "turn", "role"), key, ["turn"], lag=["role"], name="turns")
    t = t.select(key, "turn", F.col("prev_role").alias("src"), F.col("role").alias("dst")).where(F.col("src").isNotNull())
    return t.join(allowed, ["src", "dst"], "left_anti").select(key, "turn", "src", "dst")


def edges_from_map(spark, graph: dict[str, list[str]]) -> DataFrame:
    """Adjacency lists (config) to ``(src, dst)`` edge rows."""
    return spark.createDataFrame([(s, d) for s, ds in graph.items() for d in ds], "src string, dst string")


def flatten_batches(df: DataFrame, nested: str, keep: list[str]) -> DataFrame:
    """An ``array<array<T>>`` column flattened one level (order kept), one row per
    element with its 1-based position. Row-local: no grouping."""
    flat = df.select(*keep, F.flatten(F.col(nested)).alias("_f"))
    ex = flat.select(*keep, F.posexplode_outer("_f").alias("_i", "value")).where(F.col("_i").isNotNull())
    return ex.select(*keep, (F.col("_i") + 1).cast("int").alias("position"), "value")
