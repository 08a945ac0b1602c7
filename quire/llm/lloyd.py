"""Vector code compression by member-resident Lloyd rounds.

Vectors are cut into parts, and each part position has a codebook of its own. A part lives with its owner: the
partition of (position, entry, salt), where entry is the codebook entry the part is assigned to. In a round
owners sum up their resident members where they lie (a bucketed table, aggregated without a shuffle), the new
codebooks come from these sums, and every owner assigns its members again. Members whose entry stays are
neither moved nor written: only those that change their entry go through the shuffle, into a new bucketed
table at their new owners. A part of an older table is resident there as long as the codebooks since leave it at
the entry it was dealt to, which its owner computes again from them.

All numbers are integers: components become floor(256 * x), distances are squared Euclidean, ties go to
the lower entry, and entries are componentwise floors of their members' means. So results do not depend on
the order or the place of the sums. An entry without members stays as it is.

Scale: a part travels when it is first dealt and when it changes its entry. Entries are salted by their measured member
counts, so an entry or a vector that holds a third of all rows is spread over many owners. Codebooks
(positions x entries x components numbers) are the only data that pass through the driver and to all tasks.

Defined results: rows are dropped whose vector is null, holds nulls or non-finite components, is empty, has a
number of components that is no multiple of the parts, or another number than most rows that are left (ties: the
smaller number). Fewer kept rows than entries: the codebook has as many entries as rows. Among repeated ids the
smaller vector comes first; null ids come last. Components beyond ``limit`` (2**29 for parts of four)
count as the limit, so that distances fit 64 bits; sums beyond 64 bits count as the largest number. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textops as T
from quire.llm.frames import attach, pick, shuffle_partitions, written
from quire.llm.shipping import ship
from quire.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
OWNERS_PER_TASK = 4
TOP = (1 << 63) - 1


def limit(width: int) -> int:
    """Largest component, so that a part's squared distance fits 64 bits."""
    return 1 << ((62 - max(1, width).bit_length() + 1) // 2 - 1)


def packed(x: np.ndarray) -> pa.Array:
    """Rows of 32-bit integers as bytes that sort like the integers."""
    n, width = x.shape
    data = (x.astype(np.int64) + (1 << 31)).astype(">u4")
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 4 * n * width + 1, max(1, 4 * width), dtype=np.int32)[:n + 1]),
                                                  pa.py_buffer(data.tobytes())])


def unpacked(column: pa.Array) -> np.ndarray:
    """Rows of integers from rows of bytes of one length."""
    return (T.flat(column)[0].view(">u4").astype(np.int64) - (1 << 31)).reshape(len(column), -1)


def _integers(parts, scale):
    """Arrow batches (vec_id, label, vector) to (vec_id, label, int32 components as bytes, count), well-formed rows only."""
    def run(batches):
        for batch in batches:
            ids, labels, vec = batch.column(0), batch.column(1), batch.column(2)
            n = len(vec)
            if not n:
                continue
            if pa.types.is_fixed_size_list(vec.type):
                vec = vec.cast(pa.list_(vec.type.value_type))
            size = vec.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = vec.flatten()
            x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null reads as NaN
            ends = np.cumsum(size)
            bad = np.zeros(len(x) + 1, np.int64)
            np.cumsum(~np.isfinite(x), out=bad[1:])
            ok = (size > 0) & (size % parts == 0) & (bad[ends] == bad[ends - size])
            keep = np.flatnonzero(ok)
            for n in np.unique(size[keep]).tolist():  # vectors of one length together
                own, top = keep[size[keep] == n], limit(n // parts)
                v = np.clip(np.floor(x[(ends[own] - n)[:, None] + np.arange(n)] * scale), -top, top)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(own)), labels.take(pa.array(own)), packed(v), pa.array(size[own], pa.int32())],
                    names=["vec_id", "label", "x", "n"])
    return run


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry of ``book`` to each row of ``x``; ties to the lower."""
    best = np.zeros(len(x), np.int64)
    least = np.full(len(x), TOP)
    columns = np.ascontiguousarray(x.T)
    for k, entry in enumerate(book):
        d = np.zeros(len(x), np.int64)
        for c, e in zip(columns, entry.tolist()):
            step = c - e
            step *= step
            d += step
        closer = d < least
        best[closer] = k
        np.minimum(least, d, out=least)
    return best, least


def _deal(parts, book):
    """Vectors to parts, each at the entry of the first codebooks: (position, entry, row, x)."""
    def run(batches):
        for batch in batches:
            rows = batch.column(0)
            for a in range(0, len(batch), 4096):
                x = unpacked(batch.column(1).slice(a, 4096))
                width = x.shape[1] // parts
                for p in range(parts):
                    part = np.ascontiguousarray(x[:, p * width:(p + 1) * width])
                    entry, _ = nearest(part, book[p])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), p, np.int32)), pa.array(entry.astype(np.int32)), rows.slice(a, len(part)),
                         packed(part)], names=["position", "entry", "row", "x"])
    return run


def _resident(books, last):
    """Members (position, entry, row, x) that the codebooks ``books``, in turn, leave at their entry; with ``last``, the
    entry and distance it gives them."""
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            pos = batch.column(0).to_numpy()
            old = batch.column(1).to_numpy()
            x = unpacked(batch.column(3))
            stays = np.ones(len(pos), bool)
            now, dist = old.astype(np.int64), np.zeros(len(pos), np.int64)
            for p in np.unique(pos):
                at = np.flatnonzero(pos == p)
                for book in books:
                    at = at[nearest(x[at], book[p])[0] == old[at]]
                alive = np.zeros(len(pos), bool)
                alive[at] = True
                stays[(pos == p) & ~alive] = False
                if last is not None:
                    now[at], dist[at] = nearest(x[at], last[p])
            keep = pa.array(np.flatnonzero(stays))
            yield pa.RecordBatch.from_arrays(
                [c.take(keep) for c in batch.columns[:4]] + [pa.array(now[stays].astype(np.int32)), pa.array(dist[stays])],
                names=["position", "entry", "row", "x", "now", "dist"])
    return run


def _sums(width):
    """Owners' members (position, entry, row, x) to partial sums (position, entry, count, sums as decimal strings)."""
    def run(batches):
        total: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            if not len(batch):
                continue
            key = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            x = unpacked(batch.column(3))
            names, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
            s = np.zeros((len(names), width), np.int64)  # at most an Arrow batch of 32-bit numbers
            np.add.at(s, inverse, x)
            for k, n, row in zip(names.tolist(), counts.tolist(), s.tolist()):
                have = total.setdefault((k >> 32, k & 0xFFFFFFFF), [0] * (width + 1))
                for i, v in enumerate([n, *row]):
                    have[i] += v
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                 pa.array([total[k][0] for k in keys], pa.int64()),
                 pa.array([[str(v) for v in total[k][1:]] for k in keys], pa.list_(pa.string()))],
                names=["position", "entry", "count", "sums"])
    return run


PART = "position int, entry int, row bigint, x binary"


def _update(tables, books, width):
    """New codebooks and the members per (position, entry): partial sums of the resident members of every table, added
    up per entry."""
    sums = None
    for t, since in tables:
        part = t.select("position", "entry", "row", "x")
        if since:
            part = part.mapInArrow(_resident(since, None), PART + ", now int, dist bigint")
        part = part.mapInArrow(_sums(width), "position int, entry int, count bigint, sums array<string>")
        sums = part if sums is None else sums.unionByName(part)
    added = sums.groupBy("position", "entry").agg(
        F.sum("count").alias("count"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)])
    new, count = books[-1].copy(), np.zeros(books[-1].shape[:2], np.int64)
    for r in added.collect():  # positions x entries rows
        count[r.position, r.entry] = r["count"]
        new[r.position, r.entry] = [int(r[f"s{i}"]) // r["count"] for i in range(width)]
    return new, count


def _assigned(tables, book):
    """The resident members of every table, each with the entry and distance that ``book`` gives it."""
    out = None
    for t, since in tables:
        m = t.select("position", "entry", "row", "x").mapInArrow(_resident(since, book), PART + ", now int, dist bigint")
        out = m if out is None else out.unionByName(m)
    return out


def _owned(df, count, tasks, name):
    """Members dealt to their owners: salted by the members of their entry, bucketed by (position, entry, salt)."""
    share = max(1, int(count.sum()) // (tasks * OWNERS_PER_TASK))
    salts = F.array(*[F.lit(int(1 + c // share)) for c in count.ravel()])  # positions x entries numbers
    salt = F.pmod(F.xxhash64("row"), salts[F.col("position") * count.shape[1] + F.col("entry")]).cast("int")
    return materialize(df.withColumn("salt", salt), name, ["position", "entry", "salt"])


def train(x: DataFrame, first: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS):
    """Lloyd rounds over ``x`` (row, x: int32 components as bytes) from the codebooks ``first`` (positions, entries,
    components). Returns the codebooks, and (position, entry, row, dist) of every part by a last assignment."""
    width, tasks = first.shape[2], shuffle_partitions(x.sparkSession)
    books = [first]
    dealt = x.mapInArrow(_deal(parts, first), PART)
    count = np.zeros(first.shape[:2], np.int64)
    for r in dealt.groupBy("position", "entry").count().collect():  # positions x entries rows
        count[r.position, r.entry] = r["count"]
    tables = [(_owned(dealt, count, tasks, "lloyd_members"), [])]
    for r in range(rounds):
        book, count = _update(tables, books, width)
        books.append(book)
        if r + 1 < rounds:
            tables = [(t, since + [book]) for t, since in tables] + [
                (_owned(_assigned(tables, book).where("now <> entry").select("position", F.col("now").alias("entry"), "row", "x"),
                        count, tasks, f"lloyd_moved_{r}"), [])]
    final = _assigned(tables, books[-1]).select("position", F.col("now").alias("entry"), "row", "dist")
    return books[-1], final


def vectors(df: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, label, x) of the rows that are kept, written to the shared folder."""
    d = pick(df, "vec_id", "label", "embedding")
    types = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    v = written(d.mapInArrow(_integers(parts, scale), f"vec_id {types['vec_id']}, label {types['label']}, x binary, n int")
                 .withColumn("row", F.monotonically_increasing_id()), "lloyd_vectors")
    sizes = v.groupBy("n").count().orderBy(F.desc("count"), "n").first()
    return v.where(F.col("n") == F.lit(sizes[0] if sizes else 0)).drop("n")


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE):
    """(codebooks, frame): integer codebooks (positions, entries, components) and, per kept vector, vec_id, label, code
    (two hex digits per part), error (squared distances summed over its parts)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    v = vectors(df, parts, scale)
    seed = v.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    if not seed:
        return np.zeros((parts, 0, 0), np.int64), v.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
    first = np.stack([x.reshape(parts, -1) for x in unpacked(pa.array([bytes(r.x) for r in seed], pa.binary()))], 1)
    book, final = train(v.select("row", "x"), first, parts, rounds)
    # eight parts' digits to a 64-bit word
    lanes = [F.bit_or(F.when((F.col("position") / 8).cast("int") == k, F.expr("shiftleft(cast(entry as bigint), cast(8 * (7 - position % 8) as int))"))
                      .otherwise(F.lit(0).cast("bigint"))).alias(f"w{k}") for k in range(-(-parts // 8))]
    codes = final.groupBy("row").agg(*lanes, F.sum(F.col("dist").cast("decimal(38,0)")).alias("e"))
    text = F.concat(*[F.lpad(F.lower(F.hex(f"w{k}")), 16, "0").substr(1, 2 * min(8, parts - 8 * k)) for k in range(-(-parts // 8))])
    out = v.select("row", "vec_id", "label").join(codes, "row").select(
        "vec_id", "label", text.alias("code"), F.least("e", F.lit(TOP).cast("decimal(38,0)")).cast("bigint").alias("error"))
    return book, out


def book_sha256(book: np.ndarray) -> str:
    """SHA-256 of all components as decimal integers, comma-joined by part, entry and place."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def digest(df: DataFrame, **kw) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels, nulls together), codebooks_sha256."""
    book, coded = compress(df, **kw)
    name = F.coalesce(F.to_json(F.struct("label"), {"ignoreNullFields": "false"}), F.lit(""))
    coded = written(coded.withColumn("_label", name), "lloyd_codes")
    groups = written(coded.groupBy("_label").agg(F.count("*").alias("_n"), F.least(
        F.sum(F.col("error").cast("decimal(38,0)")), F.lit(TOP).cast("decimal(38,0)")).cast("bigint").alias("label_error")), "lloyd_labels")
    total = groups.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return attach(coded, groups, "_label", "_n", total).select(
        "vec_id", "code", "error", "label_error", F.lit(book_sha256(book)).alias("codebooks_sha256"))


ship(__name__)
