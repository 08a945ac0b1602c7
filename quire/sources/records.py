"""Multi-line records of delimited text files, read by byte ranges.

A record ends at a line break outside quotes, so where a record ends depends on all quotes before it. Spark's
text reader still splits such files: every split yields its physical lines in order. A first pass over narrow
columns counts, per split, the quotes and the records that would end in it for both cases (the split begins inside
quotes or not). A prefix over the splits of each file, one row per split, then tells which case holds and how many
records end before the split. A second pass joins lines to records inside each split, numbered
throughout their file. Only a record that runs over a split's border is put together from its pieces, by a
shuffle of these pieces alone.

What goes to all tasks is one entry of 17 bytes for each split that does not begin its file, so its size is
bounded by the input over the split size (``spark.sql.files.maxPartitionBytes``), whatever the number of files.

Defined results: quotes are balanced in every record (doubled inside quoted cells); a file whose last record leaves a
quote open yields that record with ``closed`` false. Line breaks are LF or CR LF; a CR before a record's end is
not part of it. Blank lines between records are skipped. An empty file has no record.
"""

from __future__ import annotations

import sys as _sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle as _cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import materialize


def physical_lines(spark: SparkSession, path: str, glob: str = "*", quote: str = '"') -> DataFrame:
    """(source_file, block, key, quotes, blank, value): every line with the start of its split."""
    raw = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "\n").text(path))
    value = F.col("value")
    return raw.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
                      F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("key"),
                      (F.length(value) - F.length(F.replace(value, F.lit(quote), F.lit("")))).alias("quotes"),
                      value.isin("", "\r").alias("blank"), value)


def _segments(key: np.ndarray):
    """Ranges of rows with one key."""
    cut = np.flatnonzero(key[1:] != key[:-1]) + 1
    return zip(np.concatenate([[0], cut]).tolist(), np.append(cut, len(key)).tolist())


def _count(batches):
    """Per split: parity of its quotes, and the records that end in it if it begins outside and inside quotes."""
    now, rows = None, []
    for batch in batches:
        if not len(batch):
            continue
        key = batch.column(2).to_numpy()
        quotes = batch.column(3).to_numpy()
        shown = ~batch.column(4).to_numpy(zero_copy_only=False)
        for a, b in _segments(key):
            if now is None or now[2] != key[a]:
                if now is not None:
                    rows.append(now)
                now = [batch.column(0)[a].as_py(), batch.column(1)[a].as_py(), int(key[a]), 0, 0, 0]
            after = (now[3] + np.cumsum(quotes[a:b])) % 2
            now[4] += int(((after == 0) & shown[a:b]).sum())
            now[5] += int(((after == 1) & shown[a:b]).sum())
            now[3] = int(after[-1])
        if len(rows) > 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(_COUNTS, r)) for r in rows], _COUNT_TYPES)
            rows = []
    if now is not None:
        rows.append(now)
    yield pa.RecordBatch.from_pylist([dict(zip(_COUNTS, r)) for r in rows], _COUNT_TYPES)


_COUNTS = ["source_file", "block", "key", "odd", "ends_out", "ends_in"]
_COUNT_TYPES = pa.schema([("source_file", pa.string()), ("block", pa.int64()), ("key", pa.int64()), ("odd", pa.int32()),
                          ("ends_out", pa.int64()), ("ends_in", pa.int64())])


def splits(lines: DataFrame) -> DataFrame:
    """(source_file, block, key, inside, before, open): whether each split begins inside quotes, how many records end in
    its file before it, and whether its file ends inside quotes. One row per split."""
    c = lines.select("source_file", "block", "key", "quotes", "blank").mapInArrow(
        _count, "source_file string, block bigint, key bigint, odd int, ends_out bigint, ends_in bigint")
    w = Window.partitionBy("source_file").orderBy("block")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2
    c = c.select("source_file", "block", "key", "odd", inside.alias("inside"),
                 F.when(inside == 1, F.col("ends_in")).otherwise(F.col("ends_out")).alias("ends"))
    return c.select("source_file", "block", "key", F.col("inside").cast("int").alias("inside"),
                    F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("before"),
                    (F.sum("odd").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) % 2 == 1).alias("open"))


def _join_lines(keys, inside, before):
    """Lines to records and pieces of records. ``keys`` (sorted), ``inside``, ``before``: the splits that do not begin
    their file."""
    def run(batches):
        now = {"key": None}

        def piece():  # an open record at a split's end
            return [(now["file"], now["n"], now["block"], False, False, None, "\n".join(now["lines"]))] if now["key"] is not None and now["lines"] else []

        for batch in batches:
            if not len(batch):
                continue
            key = batch.column(2).to_numpy()
            quotes = batch.column(3).to_numpy()
            blank = batch.column(4).to_numpy(zero_copy_only=False)
            text = batch.column(5)
            out = []
            for a, b in _segments(key):
                if now["key"] != key[a]:
                    out += piece()
                    block = batch.column(1)[a].as_py()
                    at = int(np.searchsorted(keys, key[a])) if block else 0
                    if block and (at == len(keys) or keys[at] != key[a]):
                        raise RuntimeError("the files or the split size changed between the two passes")
                    s, n = (int(inside[at]), int(before[at])) if block else (0, 0)
                    now = {"key": int(key[a]), "file": batch.column(0)[a].as_py(), "block": block, "inside": s, "n": n,
                           "lines": [], "head": s == 1, "first": None}
                after = (now["inside"] + np.cumsum(quotes[a:b])) % 2
                prior = np.concatenate([[now["inside"]], after[:-1]])
                ends = (after == 0) & ~(blank[a:b] & (prior == 0))
                number = now["n"] + np.cumsum(ends) - ends
                single = np.flatnonzero(ends & (prior == 0))
                opens = np.flatnonzero((prior == 0) & (after == 1)).tolist()
                closes = np.flatnonzero((prior == 1) & (after == 0)).tolist()
                if prior[0] == 1:
                    opens = [0] + opens
                spans = list(zip(opens, closes + [b - a - 1] * (len(opens) - len(closes))))
                done = {}
                for i, j in spans:
                    part = text.slice(a + i, j - i + 1).to_pylist()
                    if i == 0 and prior[0] == 1:
                        part = now["lines"] + part
                    if after[j] == 0:
                        whole = not (i == 0 and prior[0] == 1 and now["head"])
                        done[i] = (int(number[j]), whole, "\n".join(part))
                        now["lines"], now["head"] = [], False
                    else:
                        now["lines"] = part
                        now["head"] = now["head"] and i == 0 and prior[0] == 1
                if now["block"] == 0 and now["first"] is None and ends.any():
                    if len(single) and number[single[0]] == 0:
                        now["first"] = text[a + int(single[0])].as_py()
                    else:
                        now["first"] = next((t for n, w, t in done.values() if n == 0 and w), None)
                for n, w, t in done.values():
                    out.append((now["file"], n, now["block"], w, True, now["first"], t))
                if len(single):
                    yield _records(now, number[single], text.slice(a, b - a).take(pa.array(single)))
                now["n"] += int(ends.sum())
                now["inside"] = int(after[-1])
            if out:
                yield _pieces(out)
        rest = piece()
        if rest:
            yield _pieces(rest)
    return run


_OUT = ["source_file", "record_no", "block", "whole", "closes", "first", "text"]
_OUT_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.string()]


def _pieces(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OUT_TYPES)], names=_OUT)


def _records(now, number, text):
    n = len(number)
    same = [pa.array([v], t) for v, t in ((now["file"], pa.string()), (now["block"], pa.int64()), (True, pa.bool_()), (now["first"], pa.string()))]
    zeros = pa.array(np.zeros(n, np.int32))
    f, b, y, first = (v.take(zeros) for v in same)
    return pa.RecordBatch.from_arrays([f, pa.array(number, pa.int64()), b, y, y, first, text.cast(pa.string())], names=_OUT)


def read_records(spark: SparkSession, path: str, glob: str = "*", quote: str = '"') -> DataFrame:
    """(source_file, record_no, text, first, closed): every record of every file under ``path``, numbered from 0 in its file.

    ``first`` is the text of the file's first record where the record lies in the file's first split (always,
    for files of one split), else NULL.
    """
    lines = physical_lines(spark, path, glob, quote)
    known = splits(lines)
    later = known.where("block > 0").select("key", "inside", "before")
    rows = later.orderBy("key").collect()  # one row per split that does not begin its file
    keys = np.array([r.key for r in rows], np.int64)
    inside = np.array([r.inside for r in rows], np.int8)
    before = np.array([r.before for r in rows], np.int64)
    out = lines.mapInArrow(_join_lines(keys, inside, before),
                           "source_file string, record_no bigint, block bigint, whole boolean, closes boolean, first string, text string")
    cr = lambda c: F.when(F.col(c).endswith("\r"), F.col(c).substr(F.lit(1), F.length(c) - 1)).otherwise(F.col(c)).alias(c)
    if not rows and not known.where("open").limit(1).count():  # every file is one split, and no record stays open
        return out.select("source_file", "record_no", cr("text"), cr("first"), F.lit(True).alias("closed"))
    out = materialize(out, "records")
    parts = out.where("NOT whole").groupBy("source_file", "record_no").agg(
        F.array_sort(F.collect_list(F.struct("block", "text"))).alias("_p"), F.bool_or("closes").alias("closed"))
    parts = parts.select("source_file", "record_no", F.array_join(F.transform("_p", lambda p: p["text"]), "\n").alias("text"),
                         F.lit(None).cast("string").alias("first"), "closed")
    return (out.where("whole").select("source_file", "record_no", "text", "first", F.lit(True).alias("closed")).unionByName(parts)
            .select("source_file", "record_no", cr("text"), cr("first"), "closed"))


_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
