"""Ordered work inside large groups: ranges, not whole groups, meet in a task.

Rows are range-partitioned by (key, order) and sorted, so a key that holds a third of all rows is spread over a third
of the partitions, and every partition holds contiguous ranges of groups. What a window or a collect of a whole
group would give is computed range by range, and what crosses a partition's border is carried over from one small
row per partition:

* :func:`text_chunks`, :func:`whole_texts`: ordered concatenation. A range of lines becomes one chunk of at most
  ``CHUNK_BYTES``; chunks of one group are joined in order. Only groups that cross a border or fill several chunks
  are shuffled again, chunk by chunk. Readers of very large groups take the chunks, which come in order.
* :func:`stored_lines`, :func:`joined_lines`: the same of lines that hold their positions. :func:`text_digests` streams chunks.
* :func:`ranged`: position in the group and the previous row's values (a segmented ``row_number`` and ``lag``).

What goes to the driver or to all tasks is one row per partition, of narrow columns.
"""

from __future__ import annotations

import hashlib
import sys as _sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark import cloudpickle as _cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from quire.session import materialize

CHUNK_BYTES = 8 << 20


def _runs(h: np.ndarray, last: int | None) -> np.ndarray:
    """Where a new key begins, given the last key's hash before these rows."""
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if len(h) and last is not None:
        new[0] = h[0] != last
    return new


def _joiner(sep: str, chunk_bytes: int):
    """Sorted (key, hash, head, line) to chunks (key, seq, head, n_lines, whole, text). NULL lines are left out."""
    def run(batches):
        part = TaskContext.get().partitionId()
        now, seq, out = None, 0, []

        def close(ends):
            nonlocal seq
            whole = ends and now["from_start"] and not now["border"]
            out.append((now["key"], (part << 33) + seq, now["head"], now["n"], whole, sep.join(now["lines"])))
            seq += 1

        for batch in batches:
            if not len(batch):
                continue
            keys, h, heads, lines = batch.columns
            h = h.to_numpy()
            start = np.flatnonzero(_runs(h, None)).tolist() + [len(h)]
            for a, b in zip(start, start[1:]):
                if now is None or now["h"] != h[a]:
                    if now is not None:
                        close(True)
                    now = {"h": h[a], "key": keys[a].as_py(), "head": heads[a].as_py(), "lines": [], "n": 0, "size": 0,
                           "from_start": True, "border": now is None}
                step = 4096
                for i in range(a, b, step):
                    got = [x for x in lines.slice(i, min(step, b - i)).to_pylist() if x is not None]
                    now["lines"] += got
                    now["n"] += len(got)
                    now["size"] += sum(map(len, got))
                    if now["size"] >= chunk_bytes:
                        close(False)
                        now.update(lines=[], n=0, size=0, from_start=False)
                        if len(out) > 1:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _chunk_types(keys.type))], names=_CHUNK)
                            out.clear()
            if sum(len(r[5]) for r in out) > chunk_bytes:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _chunk_types(keys.type))], names=_CHUNK)
                out.clear()
        if now is not None:
            close(False)  # the group may go on in the next partition
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _chunk_types(keys.type))], names=_CHUNK)
    return run


_CHUNK = ["key", "seq", "head", "n_lines", "whole", "text"]


def _chunk_types(key_type):
    return [key_type, pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string()]


def text_chunks(rows: DataFrame, key: str, order: list[str], line: Column, sep: str = "\n", head: Column | None = None,
                chunk_bytes: int = CHUNK_BYTES, ties: list[str] | None = None) -> DataFrame:
    """Chunks (key, seq, head, n_lines, whole, text) of the ``line`` s of every group, joined by ``sep`` in the order of
    ``order`` (ties: of the line, or of the columns ``ties``). ``seq`` orders a group's chunks; ``head`` is taken from a chunk's first row; ``whole``
    marks a chunk that is its group's only one. Rows come out in the order of (key, seq)."""
    head = head if head is not None else F.lit(None).cast("string")
    if ties is None:
        d = rows.select(F.col(key).alias("key"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], head.alias("head"), line.alias("line"))
        o = [f"_o{i}" for i in range(len(order))]
        d = d.repartitionByRange("key", *o).sortWithinPartitions("key", *o, "line")
    else:
        d = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order, *ties)
        d = d.select(F.col(key).alias("key"), head.alias("head"), line.alias("line"))
    key_type = d.schema["key"].dataType.simpleString()
    return d.select("key", F.xxhash64("key").alias("h"), "head", "line").mapInArrow(
        _joiner(sep, chunk_bytes), f"key {key_type}, seq bigint, head string, n_lines bigint, whole boolean, text string")


def whole_texts(chunks: DataFrame, sep: str = "\n") -> DataFrame:
    """(key, head, text): the chunks of every group joined in order. A group's text must fit in one row."""
    parts = chunks.where("NOT whole").groupBy("key").agg(
        F.min_by("head", "seq").alias("head"),
        F.array_sort(F.collect_list(F.when(F.col("n_lines") > 0, F.struct("seq", "text")))).alias("_c"))
    joined = parts.select("key", "head", F.array_join(F.transform("_c", lambda c: c["text"]), sep).alias("text"))
    return chunks.where("whole").select("key", "head", "text").unionByName(joined)


#: code points that no text holds (Unicode noncharacters): between lines that are still to be numbered, and for a NULL line
_BREAK, _NULL = "\ufdd4", "\ufdd5"


def stored_lines(rows: DataFrame, key: str, order: list[str], ties: list[str], line: Column, head: Column | None = None,
                 chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """:func:`text_chunks` of lines that are still to be numbered, NULL lines too, written once to the shared folder: rows are
    shuffled once, whatever is made of them with :func:`joined_lines`."""
    return materialize(text_chunks(rows, key, order, F.coalesce(line, F.lit(_NULL)), _BREAK, head, chunk_bytes, ties), "lines")


def joined_lines(lines: DataFrame, numbered, sep: str = "\n") -> DataFrame:
    """Chunks as of :func:`text_chunks` from :func:`stored_lines`: ``numbered(position, line)``, a Column, is made of every line
    and its 1-based position in the group (NULL lines count, and are left out). Lines are counted by chunk."""
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = lines.where("NOT whole").select(F.col("seq").alias("_seq"), F.coalesce(F.sum("n_lines").over(w), F.lit(0)).alias("_before"))
    # one narrow row per chunk of a group that fills several, or crosses a border
    t = lines.join(F.broadcast(before), lines["seq"] == before["_seq"], "left")
    first = F.coalesce("_before", F.lit(0)) + 1
    made = F.transform(F.split("text", _BREAK, -1), lambda x, i: F.when(x != _NULL, numbered(first + i, x)))
    t = t.select("key", "seq", "head", "whole", F.when(F.col("n_lines") > 0, F.filter(made, lambda x: x.isNotNull())).alias("_l"))
    return t.select("key", "seq", "head", F.coalesce(F.size("_l"), F.lit(0)).cast("bigint").alias("n_lines"), "whole",
                    F.coalesce(F.array_join("_l", sep), F.lit("")).alias("text"))


def _digester(sep: str, start: str, end: str):
    """Sorted (key, hash, head, n_lines, text) to (key, chars, sha256) of head, ``start``, the texts joined by ``sep`` and ``end``."""
    def run(batches):
        now, out = None, []

        def close():
            now["sha"].update(end.encode())
            ok = now["head"] is not None
            out.append((now["key"], now["chars"] + len(end) if ok else None, now["sha"].hexdigest() if ok else None))

        key_type = None
        for batch in batches:
            keys, h, heads, n_lines, texts = batch.columns
            key_type = keys.type
            for i in range(len(batch)):
                x = h[i].as_py()
                if now is None or now["h"] != x:
                    if now is not None:
                        close()
                    head = heads[i].as_py()
                    first = (head or "") + start
                    now = {"h": x, "key": keys[i].as_py(), "head": head, "chars": len(first), "sha": hashlib.sha256(first.encode()), "any": False}
                if n_lines[i].as_py():
                    text = texts[i].as_py()
                    if now["any"]:
                        text = sep + text
                    now["any"] = True
                    now["chars"] += len(text)
                    now["sha"].update(text.encode())
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [key_type, pa.int64(), pa.string()])], names=_DIGEST)
                out.clear()
        if now is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [key_type, pa.int64(), pa.string()])], names=_DIGEST)
    return run


_DIGEST = ["key", "chars", "text_sha256"]


def text_digests(chunks: DataFrame, sep: str = "\n", start: str = "", end: str = "") -> DataFrame:
    """(key, chars, text_sha256) of every group's head, ``start``, its chunks joined in order, and ``end``. Chunks are streamed:
    a group's text may be of any size, and is never in one row. A NULL head makes both NULL."""
    d = chunks.select("key", F.xxhash64("key").alias("_h"), "head", "n_lines", "text", "seq").repartition("key").sortWithinPartitions("key", "seq")
    key_type = d.schema["key"].dataType.simpleString()
    return d.drop("seq").mapInArrow(_digester(sep, start, end), f"key {key_type}, chars bigint, text_sha256 string")


def _placer(lag_at: list[int]):
    """Sorted rows (.., hash) with their partition, run, place in the run, and the previous row's values in the run."""
    def run(batches):
        part = TaskContext.get().partitionId()
        last_h, runs, at, seq, carried = None, -1, 0, 0, [None] * len(lag_at)
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            h = batch.column(batch.num_columns - 1).to_numpy()
            new = _runs(h, last_h)
            run_no = runs + np.cumsum(new)
            start = np.maximum.accumulate(np.where(new, np.arange(n), -at if not new[0] else 0))
            place = np.arange(n) - start + 1
            prior = []
            for c, i in enumerate(lag_at):
                col = batch.column(i)
                moved = pa.concat_arrays([pa.array([carried[c]], col.type), col.slice(0, n - 1)])
                prior.append(pa.array(np.where(new, None, np.arange(n)), pa.int64()))
                prior[-1] = moved.take(prior[-1])
                carried[c] = col[n - 1].as_py()
            yield pa.RecordBatch.from_arrays(
                list(batch.columns) + [pa.array(np.full(n, part, np.int32)), pa.array(run_no), pa.array(place),
                                       pa.array(np.arange(seq, seq + n))] + prior,
                names=batch.schema.names + ["_part", "_run", "_place", "_seq"] + [f"_prev{c}" for c in range(len(lag_at))])
            last_h, runs, at, seq = h[-1], int(run_no[-1]), int(place[-1]), seq + n
    return run


def ranged(rows: DataFrame, key: str, order: list[str], lag: list[str] = (), name: str = "ranged") -> DataFrame:
    """``rows`` with ``position`` (1-based, in the order of ``order`` within its ``key``) and, for each column of ``lag``,
    ``prev_<column>`` of the row before it in the group (NULL for the first). Ties are ordered by the remaining
    columns. Rows are written once, to the shared folder."""
    columns = list(rows.columns)
    rest = [c for c, t in rows.dtypes if c not in (key, *order) and not t.startswith("map")]
    d = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order, *rest).withColumn("_h", F.xxhash64(key))
    extra = [StructField("_part", IntegerType()), StructField("_run", LongType()), StructField("_place", LongType()), StructField("_seq", LongType())]
    prev = [StructField(f"_prev{i}", rows.schema[c].dataType) for i, c in enumerate(lag)]
    t = materialize(d.mapInArrow(_placer([columns.index(c) for c in lag]), StructType(d.schema.fields + extra + prev)), name)
    ends = t.groupBy("_part").agg(  # one row per partition
        F.min(F.struct("_seq", "_h")).alias("first"), F.max(F.struct("_seq", "_h", "_run", "_place")).alias("last"),
        *[F.max_by(c, "_seq").alias(f"_l{i}") for i, c in enumerate(lag)]).orderBy("_part").collect()
    carry, before = [], None
    for r in ends:
        goes_on = before is not None and before[0] == r.first["_h"]
        shift = before[1] if goes_on else 0
        carry.append((r["_part"], shift, goes_on, *[before[2][i] if goes_on else None for i in range(len(lag))]))
        n_last = r.last["_place"] + (shift if r.last["_run"] == 0 else 0)
        before = (r.last["_h"], n_last, [r[f"_l{i}"] for i in range(len(lag))])
    table = StructType([StructField("_part", IntegerType()), StructField("_shift", LongType()), StructField("_on", BooleanType())]
                       + [StructField(f"_c{i}", rows.schema[c].dataType) for i, c in enumerate(lag)])
    c = rows.sparkSession.createDataFrame(carry, table)
    j = t.join(F.broadcast(c), "_part")  # at most one row per partition
    first_run = F.col("_run") == 0
    return j.select(*columns, (F.col("_place") + F.when(first_run, F.col("_shift")).otherwise(F.lit(0))).alias("position"),
                    *[F.when(first_run & (F.col("_place") == 1), F.col(f"_c{i}")).otherwise(F.col(f"_prev{i}")).alias(f"prev_{c}")
                      for i, c in enumerate(lag)])


_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
