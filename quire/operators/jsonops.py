"""JSON text in model replies and logs (N1, N2, N5, F8-style quarantine).

Parsing is ``try_parse_json`` / ``from_json`` with an explicit schema, JVM-side;
malformed text never fails the job, it lands in a quarantine DataFrame instead.
"""

from __future__ import annotations

import functools
import json

import sys as _sys

import pandas as pd
from pyspark import cloudpickle as _cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_json(text) -> Column:
    """The text is one JSON value (strict, as a JSON decoder sees it).

    ``try_parse_json`` stops after the first value and accepts trailing text (``4501 abc``,
    ``{"a": 1} x``); wrapping the text in ``[...]`` and reading it as an array of exactly one
    value makes any trailing token a syntax error or a second value. Single quotes do not
    quote. Blank text is not JSON. JVM-side, no Python.
    """
    t = F.col(text) if isinstance(text, str) else text
    wrapped = F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>", {"allowSingleQuotes": "false"})
    return F.coalesce((F.size(wrapped) == 1) & (F.trim(t) != ""), F.lit(False))


def extract_fields(df: DataFrame, text: str, schema: str, keep: list[str]) -> DataFrame:
    """Good rows with the schema's fields as columns (malformed rows excluded)."""
    ok = df.where(is_json(text))
    parsed = ok.select(*keep, F.from_json(F.col(text), schema).alias("_j"))
    return parsed.select(*keep, "_j.*")


def quarantine(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Rows whose text is not JSON, with the reason."""
    return df.where(~is_json(text)).select(*keep, F.col(text), F.lit("malformed json").alias("reason"))


def _pretty_batch(texts: pd.Series) -> pd.Series:
    def one(t):
        try:
            return json.dumps(json.loads(t), indent=4, sort_keys=True)
        except (TypeError, ValueError):
            return None
    return texts.map(one)


@functools.lru_cache(maxsize=1)
def _pretty():
    # built on first use: declaring a pandas UDF needs an active session
    return F.pandas_udf(_pretty_batch, "string")


def pretty_json(text) -> Column:
    """JSON text re-serialised with sorted keys and four-space indent (the exact layout
    of the original reports); NULL when the text is not JSON.

    A vectorised helper (Arrow batches): only JSON bodies of reports reach it, so callers
    apply it under a JSON test.
    """
    t = F.col(text) if isinstance(text, str) else text
    return _pretty()(t)


# functions of this module run on executors (Arrow batches): ship them by value, so the
# workers need no installed copy of the package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
