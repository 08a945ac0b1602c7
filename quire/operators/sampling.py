"""Deterministic sampling, splitting and pairing.

Randomness is a seeded SHA-256 ordering (:func:`quire.functions.ids.seeded_hash`),
stable across partitionings and equal in Spark and DuckDB.

Dense positions never use a global un-partitioned window (that funnels every row
into one task). :func:`dense_index` works in two passes instead: rows fall into
``16**digits`` buckets by the leading hex digits of their hash (uniform), get a
``row_number`` inside their bucket, and add their bucket's offset. The offset table
has at most ``16**digits`` rows (65,536 by default, about 1 MB): a proven bound, so it
is broadcast, and its running sum is one small task. At 10^11 rows a bucket holds
about 1.5 million rows, a sort one task spills comfortably.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.constants import CHARACTERISTICS
from quire.functions.ids import hash_int32, seeded_hash


def dense_index(df: DataFrame, key: str, seed=0, digits: int = 4, out: str = "idx") -> DataFrame:
    """Add ``out`` = 0-based position of each row in ``(sha256(seed || key), key)`` order,
    and ``_n`` = total row count."""
    h = seeded_hash(seed, key)
    # non-nullable bucket: no inferred IS NOT NULL filter re-hashing below the join, and a
    # NULL key is indexed (bucket "") instead of being dropped by the join
    x = df.select("*", h.alias("_h")).select("*", F.coalesce(F.substring("_h", 1, digits), F.lit("")).alias("_b"))
    x = x.select("*", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)).alias("_rn"))
    counts = x.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    # at most 16**digits rows: the one-task window over it is bounded
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"),
                            F.sum("_c").over(Window.partitionBy()).alias("_n"))
    j = x.join(F.broadcast(offsets), "_b")
    keep = [c for c in j.columns if c not in ("_h", "_b", "_rn", "_off", out)]
    return j.select(*keep, (F.col("_off") + F.col("_rn") - 1).cast("bigint").alias(out))


def _order_hash(key: str, seed):
    """Seeded hash that orders the rows; NULL keys come last (no hex digit is greater than ``~``)."""
    return F.coalesce(seeded_hash(seed, key), F.lit("~"))


def _edge(counts: DataFrame, order: list[str], k: int):
    """(values, rows before, rows at) of the first entry of ``counts`` (order.., c) whose running count reaches ``k``."""
    w = Window.orderBy(*order)
    up = counts.select(*order, "c", F.sum("c").over(w).alias("u")).where(F.col("u") >= k)
    r = up.agg(F.min(F.struct(*order, "u", "c")).alias("e")).first()["e"]
    return None if r is None else ([r[o] for o in order], r["u"] - r["c"], r["c"])


def seeded_cut(df: DataFrame, key: str, k: int, seed=0, digits: int = 4):
    """Where the first ``k`` rows in seeded order end: (hash, rows with a smaller hash, rows with this hash), or None with
    fewer rows than ``k``; and the row count.

    Only keys are read: hash buckets are counted (at most ``16**digits`` + 1 counts), the bucket that holds the ``k``-th
    row is found, and that bucket's distinct keys alone are ordered. Repeated keys are combined before any shuffle.
    """
    h = _order_hash(key, seed)
    x = df.select(F.substring(h, 1, digits).alias("b"), h.alias("h"))
    buckets = x.groupBy("b").agg(F.count(F.lit(1)).alias("c")).orderBy("b").collect()
    n, before = sum(r.c for r in buckets), 0
    for r in buckets:
        if before + r.c >= k:
            (cut,), less, at = _edge(x.where(F.col("b") == r.b).groupBy("h").agg(F.count(F.lit(1)).alias("c")), ["h"], k - before)
            return (cut, before + less, at), n
        before += r.c
    return None, n


def _first(df: DataFrame, key: str, k: int, seed):
    """(``df`` with a boolean ``_first``: the row is one of the first ``k`` in seeded order, row count). Rows are flagged in
    place. Of rows with the key at the cut, as many are first as fit, in the order of a hash of their content; of
    equal rows there, the right number."""
    cut, n = seeded_cut(df, key, k, seed)
    h = _order_hash(key, seed)
    if cut is None or k <= 0:
        return df.withColumn("_first", F.lit(False)), n
    last, before, at = cut
    if before + at == k:
        return df.withColumn("_first", h <= last), n
    # several rows have the key at the cut: the same again, over hashes of whole rows (maps as their entries)
    whole = F.xxhash64(*[F.to_json(F.struct(c)) if t.startswith("map") else F.col(c) for c, t in df.dtypes])
    here = df.where(h == last).select(F.shiftright(whole, 48).alias("b"), whole.alias("w"))
    left = k - before
    for r in here.groupBy("b").agg(F.count(F.lit(1)).alias("c")).orderBy("b").collect():  # at most 65,536 buckets
        if left <= r.c:
            (row,), less, same = _edge(here.where(F.col("b") == r.b).groupBy("w").agg(F.count(F.lit(1)).alias("c")), ["w"], left)
            left -= less
            break
        left -= r.c
    flagged = df.withColumn("_first", (h < last) | ((h == last) & ((whole < row) | ((whole == row) & F.lit(left == same)))))
    if left == same:
        return flagged, n
    # equal rows on both sides of the cut: one of them, as often as they are
    one = df.where((h == last) & (whole == row)).limit(1).withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(same))))
    return (flagged.where((h != last) | (whole != row))
            .unionByName(one.withColumn("_first", F.col("_i") <= left).drop("_i"))), n


def train_test_split(df: DataFrame, key: str, n_train: int = 1, seed=0, append: bool = False) -> DataFrame:
    """The first ``n_train`` rows in seeded order are train, the rest test; in
    append mode everything is test. Rows are flagged in place."""
    if append or n_train <= 0:
        return df.withColumn("split", F.lit("test"))
    first, n = _first(df, key, n_train, seed)
    return first.withColumn("split", F.when(F.col("_first") | F.lit(n <= n_train), "train").otherwise("test")).drop("_first")


def seeded_sample(df: DataFrame, key: str, k: int = 50, seed=0, strict: bool = False) -> DataFrame:
    """Exactly ``k`` rows without replacement (the first ``k`` in seeded order; NULL keys last), also where keys or
    whole rows repeat.

    With fewer than ``k`` rows nothing is selected (``strict`` raises instead), as the
    original does. Rows are compared with the seeded cut where they are, so ``k`` may be any
    size without a single-task top-k, and no row is shuffled.
    """
    first, n = _first(df, key, k, seed)
    if strict and n < k:
        raise ValueError(f"fewer rows than the sample size {k}")
    return first.where("_first").drop("_first")


def last_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """The last ``n`` rows in key order (a top-n: the limit is the feature)."""
    return df.orderBy(F.col(key).desc()).limit(n)


#: test rows that meet one copy of a train row
DRAWS_PER_COPY = 10_000


def few_shot_draw(test: DataFrame, train: DataFrame, key: str, k: int = 1, seed=0, payload: tuple[str, ...] = (),
                  draws_per_copy: int = DRAWS_PER_COPY) -> DataFrame:
    """For each test row, ``k`` distinct train rows: positions
    ``(h(test) + j) mod n`` for ``j < k`` in the dense train index. ``payload`` columns of the train row come along.

    ``n`` and the number of draws are scalar subqueries (computed once). The draw is an equi-join on the position and a
    salt: with few train rows each is copied as often as its draws ask for (at most one copy per ``draws_per_copy``
    draws), so one train row for all test rows is no hot key.
    """
    tr = dense_index(train.select(F.col(key).alias("train_id"), *payload), "train_id", seed).drop("_n")
    n = train.select(F.count(F.lit(1))).scalar()
    # one draw per distinct test id: repeated ids cannot inflate a per-example group downstream
    ids = test.select(key).distinct()
    copies = F.lit(1) + F.floor(F.try_divide(ids.select(F.count(F.lit(1)) * k).scalar(), n * draws_per_copy)).cast("bigint")
    salts = F.coalesce(copies, F.lit(1).cast("bigint"))
    tr = tr.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("_salt"))
    t = ids.select(key, hash_int32(seeded_hash(seed, key)).alias("_s"))
    t = t.select(key, F.explode(F.when(n > 0, F.sequence(F.lit(0), F.least(F.lit(k), n) - 1))).alias("shot"), "_s")
    t = t.withColumns({"idx": F.pmod(F.col("_s") + F.col("shot"), n), "_salt": F.pmod(F.xxhash64(key), salts)})
    return t.join(tr, ["idx", "_salt"]).select(key, F.col("shot").cast("int").alias("shot"), "train_id", *payload)


def ring_neighbours(df: DataFrame, key: str, seed=12345, offsets: tuple[int, ...] = (1, 2),
                    payload: tuple[str, ...] = ()) -> DataFrame:
    """After a seeded shuffle, row ``i`` is paired with rows ``(i + o) mod n``.

    One dense index, then each row is sent once per role to the position it serves
    (itself, and ``i - o`` for each offset) and grouped by that position: one shuffle,
    exactly ``1 + len(offsets)`` rows per group, no self-join. ``payload`` columns travel
    with the rows (``cand{o}_<col>`` for the candidates), so callers need no join back.
    """
    x = dense_index(df.select(key, *payload), key, seed)
    roles = (0, *offsets)
    targets = F.array(*[F.struct(F.lit(o).alias("o"), F.pmod(F.col("idx") - o, F.col("_n")).alias("t"))
                        for o in roles])
    rec = F.struct(F.col(key).alias("k"), *[F.col(c) for c in payload])
    e = x.select(rec.alias("_v"), F.explode(targets).alias("_r"))
    g = e.groupBy(F.col("_r.t").alias("idx")).agg(
        *[F.max(F.when(F.col("_r.o") == o, F.col("_v"))).alias(f"_v{o}") for o in roles])
    cols = [F.col("idx"), F.col("_v0.k").alias(key), *[F.col(f"_v0.{c}").alias(c) for c in payload]]
    for o in offsets:
        cols += [F.col(f"_v{o}.k").alias(f"cand{o}_id"), *[F.col(f"_v{o}.{c}").alias(f"cand{o}_{c}") for c in payload]]
    return g.select(*cols)


def refresh_subset(src: DataFrame, dst: DataFrame, key: str) -> DataFrame:
    """Rows of the small set replaced by their current version from ``src``;
    rows no longer in ``src`` are kept as they were."""
    fresh = src.join(dst.select(key), key, "left_semi")
    kept = dst.join(src.select(key), key, "left_anti")
    return fresh.unionByName(kept.select(*fresh.columns))


def reasoning_type_choice(tables: DataFrame, text: str, seed=0, names: list[str] = CHARACTERISTICS) -> DataFrame:
    """A seeded subset of 1..5 reasoning types per table and its numbered phrase
    ``1) a, 2) b.`` (names ranked by ``sha256(text || seed || name)``)."""
    n = F.lit(1) + F.pmod(hash_int32(seeded_hash(seed, text)), F.lit(len(names)))
    ranked = F.array_sort(F.array(*[F.struct(F.sha2(F.concat(F.col(text), F.lit(str(seed)), F.lit(nm)), 256).alias("h"),
                                             F.lit(nm).alias("name")) for nm in names]))
    chosen = F.slice(F.transform(ranked, lambda x: x["name"]), 1, n)
    phrase = F.concat(F.array_join(F.transform(chosen, lambda x, i: F.concat((i + 1).cast("string"), F.lit(") "), x)),
                                   ", "), F.lit("."))
    return tables.select("table_id", n.cast("int").alias("n_types"), chosen.alias("types"), phrase.alias("phrase"))
