"""Schemas of the data model (explicit, so reads never infer types over the data).

Entities: example, model output, evaluation, run summary, validity tracker,
characteristic scores (long form) and replies, model config, generation log.
"""

from __future__ import annotations

from pyspark.sql import types as T

from quire.constants import LOG_FIELDS

EXAMPLE = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("ground_truth", T.StringType()),
    T.StructField("documents", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("characteristic_breakdown", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("validity_scalar", T.IntegerType()),
    T.StructField("example_id", T.StringType()),
])

MODEL_OUTPUT = T.StructType([
    T.StructField("example_id", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("prompt_type", T.StringType()),
    T.StructField("reasoning_type", T.StringType()),
    T.StructField("model_response", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("ground_truth", T.StringType()),
    T.StructField("characteristic_breakdown", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("validity_scalar", T.IntegerType()),
])

# judge score kept twice: the raw reply, and the strict integer (NULL when it did not parse)
EVALUATION = T.StructType([
    T.StructField("example_id", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("prompt_type", T.StringType()),
    T.StructField("reasoning_type", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("rationale", T.StringType()),
    T.StructField("predicted_answer", T.StringType()),
    T.StructField("correct_answer", T.StringType()),
    T.StructField("judge_raw", T.StringType()),
    T.StructField("accuracy", T.LongType()),
    T.StructField("em_accuracy", T.IntegerType()),
    T.StructField("gpt_eval", T.StringType()),
])

RUN_SUMMARY = T.StructType([
    T.StructField("reasoning_type", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("prompt_type", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("median", T.DoubleType()),
    T.StructField("stdev", T.DoubleType()),
    T.StructField("max", T.LongType()),
    T.StructField("min", T.LongType()),
    T.StructField("em_accuracy", T.DoubleType()),
])

# tri-state labels: 0, 1, or NULL (not labelled yet)
VALIDITY_TRACKER = T.StructType([
    T.StructField("example_id", T.StringType()),
    T.StructField("table_validity", T.IntegerType()),
    T.StructField("docs_validity", T.IntegerType()),
])

CHARACTERISTIC_SCORES = T.StructType([
    T.StructField("example_id", T.StringType()),
    T.StructField("characteristic", T.StringType()),
    T.StructField("score", T.IntegerType()),
])

CHARACTERISTIC_REPLY = T.StructType([
    T.StructField("concise_answers", T.StringType()),
    T.StructField("scores", T.MapType(T.StringType(), T.StructType([
        T.StructField("rationale", T.StringType()), T.StructField("score", T.IntegerType())]))),
])

MODEL_CONFIG = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("tokenizer", T.StringType()),
    T.StructField("task", T.StringType()),
    T.StructField("remote", T.BooleanType()),
])

_LOG_TYPES = {"Validity Scalar": T.StringType(), "Encouraged Characteristics": T.ArrayType(T.StringType())}
# every field read as text except the characteristic list; scores parse downstream
GENERATION_LOG = T.StructType([T.StructField(f, _LOG_TYPES.get(f, T.StringType())) for f in LOG_FIELDS])


def ddl(schema: T.StructType) -> str:
    """DDL string of a schema (for ``spark.read.schema`` / ``from_json``)."""
    return schema.simpleString()[len("struct<"):-1]
