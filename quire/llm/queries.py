"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import (bytespans, decontaminate, digestindex, fingerprints, lloyd, mixing, neardup, periods, secrets, substrings, tokens,
                       toxicity, urlfilter)
from quire.llm.frames import load, pick
from quire.llm.sql import ORACLE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    return decontaminate.digest(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows that smaller documents hold."""
    return substrings.digest(load(spark, sf_dir, "documents"))


@query
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the byte strings that occur elsewhere."""
    return bytespans.digest(load(spark, sf_dir, "documents"))


@query
def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class."""
    return neardup.digest(load(spark, sf_dir, "documents"))


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files, and read back."""
    return tokens.digest(load(spark, sf_dir, "documents"))


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by rule, else by its aliases."""
    return urlfilter.digest(load(spark, sf_dir, "pages"))


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets through a blob ledger that starts empty."""
    return secrets.digest(load(spark, sf_dir, "documents"))


@query
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to the source weights."""
    return mixing.digest(load(spark, sf_dir, "documents"))


@query
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash, its edited text's, and the neighbours of the query documents."""
    return fingerprints.digest(load(spark, sf_dir, "documents"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a classifier fitted on all labels that are not held out."""
    return toxicity.digest(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through a digest index that starts empty."""
    return digestindex.digest(load(spark, sf_dir, "documents"))


def with_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by their id's crc32, end in copies of their first words from a on."""
    d = pick(docs, "doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    n = F.size("w").cast("bigint")
    g = F.floor(h / 10)
    a, p = F.col("a"), F.col("p")
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1)))
    edited = F.array_join(F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.col("w")[
        F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")]), " ")
    return (d.withColumn("w", words)
             .withColumn("a", F.when(n > 0, g % n))
             .withColumn("p", F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)))
             .select("doc_id", F.when(a.isNotNull(), edited).otherwise(F.col("text")).alias("text")))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs, after a tenth of them got repeated tails."""
    return periods.digest(with_tails(load(spark, sf_dir, "documents"))).drop("n_words")


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector coded by 16 codebooks of 64 entries."""
    return lloyd.digest(load(spark, sf_dir, "embeddings"))


__all__ = ["QUERIES", "ORACLE"]
