"""Completions: lookup of stored replies, the caller-supplied batch scorer, keyed
assembly of outputs (J11, Z1, E1, J4, J5).

The stored-reply lookup is a join on a prompt key: prompts with a stored reply are done, the rest are pending and go to
the scorer. A key is the SHA-256 of model and prompt (:func:`prompt_key`), or of the hashes of the prompt's parts
(:func:`quire.operators.prompts.grid_keys`): then the lookup reads no text, and prompts are built for pending rows only.
Only pending prompts enter Python, as Arrow batches through ``mapInArrow``. Stores are kept bucketed by key
(:func:`reply_store`), so they are not shuffled; where a store is large and few keys are asked, the engine's
runtime filters (a Bloom filter of the keys) prune its scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import sys as _sys

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle as _cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.constants import ANSWER_KEY, COT, INPUT_KEY, NO_RESPONSE, OUTPUT_KEY


def prompt_key(model: Column, prompt: Column) -> Column:
    """Cache key of a prompt for a model.

    Declared non-nullable (``coalesce``): a nullable join key makes the optimizer infer
    an ``IS NOT NULL`` filter and push it below the projections, which would build every
    prompt a second time just to test it.
    """
    return F.coalesce(F.sha2(F.concat(model, F.lit("\u001f"), prompt), 256), F.lit(""))


def lookup(prompts: DataFrame, store: DataFrame, key: str = "prompt_key") -> tuple[DataFrame, DataFrame]:
    """(done, pending). ``store`` is ``(prompt_key, reply)``; one reply per key is kept."""
    st = store.groupBy(key).agg(F.max("reply").alias("reply"))
    done = prompts.join(st, key, "inner")
    pending = prompts.join(st, key, "left_anti")
    return done, pending


def reply_store(replies: DataFrame, key: str = "prompt_key") -> DataFrame:
    """Replies (key, reply) as a stored table with one reply per key, bucketed by key."""
    from quire.session import materialize

    return materialize(replies.groupBy(key).agg(F.max("reply").alias("reply")), "replies", [key])


def with_fallback(prompts: DataFrame, store: DataFrame, key: str = "prompt_key") -> DataFrame:
    """Every prompt with its reply, ``No Response`` where none exists."""
    st = store.groupBy(key).agg(F.max("reply").alias("reply"))
    j = prompts.join(st, key, "left")
    return j.withColumn("reply", F.coalesce(F.col("reply"), F.lit(NO_RESPONSE)))


def offline_scorer(prompts: pd.Series) -> pd.Series:
    """Deterministic stand-in scorer: answers with the prompt's question (what stands between the
    last ``Q: `` and the answer mark, without the reasoning instruction)."""
    def one(p: str) -> str:
        i = p.rfind(f"\n{INPUT_KEY} ")
        start = i + 4 if i >= 0 else (3 if p.startswith(f"{INPUT_KEY} ") else -1)
        if start < 0:
            return ANSWER_KEY
        return ANSWER_KEY + p[start:].removesuffix(f"\n{OUTPUT_KEY}").removesuffix(f"\n{COT}")
    return prompts.map(one)


#: prompts in one call of the scorer (the batch size of the original)
BATCH_SIZE = 10
#: a task stops when so many prompts in a row fail and none was answered: the scorer itself is broken
GIVE_UP_AFTER = 100


class ScorerError(RuntimeError):
    """A scorer that answers nothing."""


def _answer(scorer, prompts: list, counts: dict) -> list[tuple]:
    """(reply, calls, error) of every prompt: a failed call is split in halves until single prompts are left."""
    counts["calls"] += 1
    try:
        replies = list(scorer(pd.Series(prompts)))
        if len(replies) != len(prompts):
            raise ValueError(f"scorer returned {len(replies)} replies for {len(prompts)} prompts")
        return [(r, 1, None) for r in replies]
    except Exception as e:  # noqa: BLE001  (any failure of the caller's function is counted and reported)
        if len(prompts) == 1:
            return [(NO_RESPONSE, 1, f"{type(e).__name__}: {e}"[:500])]
    half = len(prompts) // 2
    out = _answer(scorer, prompts[:half], counts) + _answer(scorer, prompts[half:], counts)
    return [(r, n + 1, e) for r, n, e in out]


def score_batches(pending: DataFrame, scorer: Callable[[pd.Series], pd.Series] = offline_scorer,
                  prompt: str = "prompt", keep: list[str] | None = None, batch_size: int = BATCH_SIZE,
                  accounts: bool = False, give_up_after: int = GIVE_UP_AFTER) -> DataFrame:
    """Z1 + E1: run a batch scorer over pending prompts with ``mapInArrow``, ``batch_size`` prompts a call.

    A batch whose call fails (or returns another number of replies) is split in halves until the failing prompts
    stand alone; such a prompt gets ``No Response``, so it never loses the rest of its batch. With ``accounts``, each
    row carries ``calls`` (how many calls held its prompt: more than one if it was retried) and ``error`` (the reason
    its prompt was lost, else NULL); :func:`scoring_summary` adds them up. A task whose first ``give_up_after`` prompts
    are all lost raises :class:`ScorerError` with the last reason. Order inside a batch is kept.
    """
    keep = keep or [c for c in pending.columns if c != prompt]
    cols = keep + [prompt]
    # the prompt goes to Python but does not come back: only the keys and the reply do
    schema = pending.select(*keep).schema.add("reply", "string")
    if accounts:
        schema = schema.add("calls", "integer").add("error", "string")

    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answered, lost, counts = False, 0, {"calls": 0}
        for batch in batches:
            prompts = batch.column(len(keep))
            got = []
            for i in range(0, len(prompts), batch_size):  # the prompts of one call at a time leave Arrow
                part = _answer(scorer, prompts.slice(i, batch_size).to_pylist(), counts)
                got += part
                answered = answered or any(e is None for _, _, e in part)
                lost += len(part)
                if not answered and lost >= give_up_after:
                    raise ScorerError(f"no reply to the first {lost} prompts of a task; the last reason: {part[-1][2]}")
            out = [pa.array([r for r, _, _ in got], pa.string(), from_pandas=True)]
            if accounts:
                out += [pa.array([n for _, n, _ in got], pa.int32()), pa.array([e for _, _, e in got], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + out, names=names)
            del batch, prompts, got, out
            pa.default_memory_pool().release_unused()  # batches of long prompts differ in size

    return pending.select(*cols).mapInArrow(run, schema)


def scoring_summary(scored: DataFrame, *by: str) -> DataFrame:
    """What ``score_batches(accounts=True)`` lost and retried, per group: n_prompts, n_retried, n_lost, and the most
    frequent reason (ties: the smaller text)."""
    reasons = scored.groupBy(*by, "error").agg(F.count("*").alias("n"), F.count_if(F.col("calls") > 1).alias("r"))
    why = F.when(F.col("error").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("error").alias("e")))
    return reasons.groupBy(*by).agg(F.sum("n").alias("n_prompts"), F.sum("r").alias("n_retried"),
                                    F.coalesce(F.sum(F.when(F.col("error").isNotNull(), F.col("n"))), F.lit(0)).alias("n_lost"),
                                    F.min(why)["e"].alias("reason"))


def ensure_scored(scored: DataFrame) -> DataFrame:
    """``scored`` itself, unless every prompt of it was lost: then :class:`ScorerError`. Runs one aggregation, so pass a
    stored frame."""
    n, lost, reason = scored.agg(F.count("*"), F.count("error"), F.max("error")).first()
    if n and n == lost:
        raise ScorerError(f"no reply to any of {n} prompts; a reason: {reason}")
    return scored


def latest_per_key(outputs: DataFrame, key: str, order: str) -> DataFrame:
    """J4 helper: one output per key, the latest by ``order`` (a later duplicate wins).

    ``max_by`` is a partial aggregate: a key holding many duplicates is combined
    map-side instead of being sorted in one task.
    """
    from pyspark.sql.types import MapType

    others = [c for c in outputs.columns if c != key]
    orderable = not any(isinstance(f.dataType, MapType) for f in outputs.schema.fields if f.name in others)
    if orderable:
        # max of (order, row): rows tied on ``order`` are broken by content, so a recomputed
        # task (after an executor loss) always keeps the same row
        rest = [c for c in others if c != order]
        g = outputs.groupBy(key).agg(F.max(F.struct(F.col(order).alias(order), *rest)).alias("_x"))
    else:
        g = outputs.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_x"))
    return g.select(key, *[F.col(f"_x.{c}").alias(c) for c in others])


def key_outputs(outputs: DataFrame, prompts: DataFrame, key: str, order: str) -> DataFrame:
    """Model outputs joined to prompt metadata by key, never by position."""
    return latest_per_key(outputs, key, order).join(prompts, key)


# functions of this module run on executors (Arrow batches): ship them by value, so the
# workers need no installed copy of the package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
