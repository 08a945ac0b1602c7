"""From raw documents to token files, by operators of :mod:`quire.llm`.

1. toxicity       documents that the classifier rejects go
2. near_dedup     one document of each near-duplicate class stays (the smallest doc_id)
3. decontaminate  documents contaminated by benchmark items go
4. mix            documents are taken as often as the target weights of their sources ask
5. tokens         the mix is written as token files and read back: one row per document

Stages 1 to 4 return the columns of ``documents``. Each stage is written as Parquet in the shared
checkpoint folder and read again as the input of the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, mixing, neardup, tokens, toxicity
from quire.llm.frames import load, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, load(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.digest(docs)


STAGES = [("toxicity", reject_toxic), ("near_dedup", near_dedup), ("decontaminate", remove_contaminated),
          ("mix", mix_sources), ("tokens", write_tokens)]

#: The classifier, the alignment and the tokenizer have no SQL form: the pipeline is tested against a
#: brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
