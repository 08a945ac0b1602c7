"""Document sets generated from tables (R4 -> W7/X8 -> Z1 -> N2 -> W5 -> A12).

One generation prompt per table row, a caller-supplied batch writer (Z1, ``mapInPandas``)
returns JSON replies, the ``resultant_document`` field is parsed (N2; a reply that is not
JSON becomes NULL and is reported in ``error``), and each table's documents are numbered
in a seeded shuffle order and joined (A12). The per-table collect is bounded by the size
gate applied when the table text was rendered.
"""

from __future__ import annotations

import json
import re

import sys as _sys

import pandas as pd
from pyspark import cloudpickle as _cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.constants import CONTEXTUAL_OUTLINE, DOC_RANDOM_SEED
from quire.functions.ids import seeded_hash
from quire.operators.completions import score_batches
from quire.operators.tables import document_prompts

_ROW = re.compile(r"document for Row (\d+)\.")


def offline_document_writer(prompts: pd.Series) -> pd.Series:
    """Deterministic stand-in writer: the document for row ``n`` is that row's table line,
    returned as ``{"resultant_document": ...}`` JSON like the generation model's reply."""
    def one(p: str) -> str:
        m = _ROW.search(p)
        start = p.find("Table:\n")
        end = p.find("\nThe goal of the document set")
        if m is None or start < 0 or end < 0:
            return "not json"
        lines = p[start + len("Table:\n"):end].split("\n")
        n = int(m.group(1))
        doc = lines[n] if n < len(lines) else ""
        return json.dumps({"instructions": f"Describe row {n}.", "resultant_document": doc})
    return prompts.map(one)


def generate_document_sets(tables: DataFrame, writer=offline_document_writer, template: str = CONTEXTUAL_OUTLINE,
                           seed: int = DOC_RANDOM_SEED, shuffle: bool = False, **slots) -> DataFrame:
    """``(table_id, table)`` -> ``(table_id, documents, n_documents, n_failed)``."""
    prompts = document_prompts(tables, template, seed, **slots)
    replies = score_batches(prompts.select("table_id", "doc_row", "prompt"), writer)
    docs = replies.select("table_id", "doc_row",
                          F.from_json("reply", "resultant_document string")["resultant_document"].alias("doc"))
    order = seeded_hash(seed, "table_id", "doc_row") if shuffle else F.lit("")
    g = docs.groupBy("table_id").agg(
        F.array_sort(F.collect_list(F.struct(order.alias("_h"), F.col("doc_row"), F.col("doc")))).alias("_d"),
        F.count_if(F.col("doc").isNull()).alias("n_failed"))
    ok = F.filter("_d", lambda x: x["doc"].isNotNull())
    text = F.array_join(F.transform(ok, lambda x, i: F.concat(
        F.lit("Document "), (i + 1).cast("string"), F.lit(": "), x["doc"])), "\n\n")
    return g.select("table_id", text.alias("documents"), F.size(ok).cast("bigint").alias("n_documents"),
                    F.col("n_failed").cast("bigint").alias("n_failed"))


# functions of this module run on executors (Arrow batches): ship them by value, so the
# workers need no installed copy of the package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
