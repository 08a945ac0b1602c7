"""Ordered work in ranges: hot groups, borders, ties and nulls, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import conversations as cv
from quire.operators import ranges as rg
from quire.operators import tables as tt


@pytest.fixture(autouse=True)
def many_partitions(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def turns(seed=1):
    """Conversations of 0 to 40 turns, one with over a third of all rows; repeated turns, NULL texts and roles."""
    r, out = random.Random(seed), []
    for c in range(60):
        for t in range(700 if c == 17 else r.randint(1, 40)):
            role = r.choice(["a", "b", None]) if c % 7 == 0 else r.choice("ab")
            out.append((c, t // 2 if c % 5 == 0 else t, role, None if r.random() < 0.1 else f"text {c} {t}\nx"))
    out += [(None, 0, "a", "null key"), (None, 1, "b", "second"), (900, 0, "a", None)]
    r.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(5)


def chats(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((t, x) for k, t, _, x in rows if k == c and x is not None)
        out[c] = "\n".join(x for _, x in own)
    return out


@pytest.mark.parametrize("chunk_bytes", [1, 200, 1 << 20])
def test_chat_text(spark, chunk_bytes):
    rows = turns()
    got = cv.chat_text(frame(spark, rows), chunk_bytes=chunk_bytes).collect()
    assert len(got) == len({r.conv_id for r in got}) and {r.conv_id: r.chat for r in got} == chats(rows)


def test_chunks_are_bounded_and_in_order(spark):
    rows = turns()
    c = cv.chat_chunks(frame(spark, rows), chunk_bytes=300)
    got = c.collect()
    want = {k: v for k, v in chats(rows).items()}
    joined = {}
    for r in sorted(got, key=lambda r: r.seq):
        joined.setdefault(r.conv_id, []).append(r.text)
    assert {k: "\n".join(v) for k, v in joined.items()} == {k: v for k, v in want.items() if v or k in joined}
    # a chunk closes at its first block of lines beyond the bound; here a block is one read of at most 4,096 lines
    hot = rg.text_chunks(frame(spark, rows), "conv_id", ["turn"], F.col("text"), chunk_bytes=300).where("key = 17")
    assert hot.count() > 3 and not hot.where("whole").count()


def test_hot_group_is_spread(spark):
    """A group with more than a third of all rows lies in many partitions, none with more than its share."""
    d = frame(spark, turns()).select(F.col("conv_id").alias("key"), "turn").repartitionByRange("key", "turn")
    n = [r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect()]
    assert len(n) >= 10 and max(n) < sum(n) / 5


def test_positions_and_lag(spark):
    rows = turns(2)
    got = sorted((tuple(r) for r in rg.ranged(frame(spark, rows), "conv_id", ["turn"], lag=["role", "text"]).collect()), key=repr)
    want = []
    key = lambda r: tuple((x is not None, x) for x in r[1:])  # noqa: E731  (NULLs first)
    for c in {r[0] for r in rows}:
        prev = (None, None)
        for i, r in enumerate(sorted((r for r in rows if r[0] == c), key=key), 1):
            want.append((*r, i, *prev))
            prev = r[2:4]
    assert got == sorted(want, key=repr)


def test_transition_violations(spark):
    rows = turns(3)
    allowed = spark.createDataFrame([("a", "b")], "src string, dst string")
    got = sorted(map(tuple, cv.transition_violations(frame(spark, rows), allowed).collect()), key=repr)
    want = []
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        own = sorted(own, key=lambda r: (r[1], r[2] is not None, r[2] or ""))
        want += [(c, y[1], x[2], y[2]) for x, y in zip(own, own[1:]) if x[2] is not None and (x[2], y[2]) != ("a", "b")]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("mode", ["plain", "indexed"])
def test_large_tables_equal_collected_ones(spark, mode):
    rows = [(t, i, ["h1", "h|2"], [f"c{i}", 'say "x"\nnew' if i % 3 else None]) for t in range(40) for i in range(400 if t == 5 else 1 + t % 9)]
    df = spark.createDataFrame(rows, "table_id int, row_idx int, header array<string>, cells array<string>")
    want = {tuple(r) for r in tt.render_tables(df, mode).collect()}
    for size in (1, 500, 1 << 20):
        assert {tuple(r) for r in tt.render_large_tables(df, mode, chunk_bytes=size).collect()} == want


def test_empty(spark):
    none = frame(spark, turns()).limit(0)
    assert cv.chat_text(none).count() == 0 and rg.ranged(none, "conv_id", ["turn"], lag=["role"]).count() == 0
