"""What large tables cost: shuffles of raw columns only, no text in one row, small batches in Python."""

import hashlib
import re
from itertools import groupby

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import completions as cp
from quire.operators import tables as tt
from quire.plans.q_prompts import x8_verification_prompts
from quire.sources import tables as tb

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_are_shuffled_once_by_raw_columns(spark):
    plan = _plan(tt.render_tables(tb.table_cells(spark, SF), "plain"))
    assert plan.count("Exchange hashpartitioning") == 1
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert "as string" not in below  # cells are rendered above the shuffle


def _orders(spark, path, n_tables, n_items):
    """lineitem and benchmark: tables of one to four lines, and an order without a key."""
    rows = [(t, 7 * t + i, i, i + 1, float(i), t + 0.5, "N") for t in range(n_tables) for i in range(1 + t % 4)] + [(None, 1, 1, 1, 1.0, 1.0, "N")]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string"
    li = spark.createDataFrame(rows, names).withColumn("l_shipdate", F.lit("1995-05-18").cast("timestamp_ntz"))
    li.coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(i, f"Is it {i} of {n_items}") for i in range(n_items)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_tables_asked_one_question_lie_together(spark, tmp_path):
    """Written prompts repeat a question's text side by side, where a file's blocks pack it; every table has its prompts."""
    df = x8_verification_prompts(spark, _orders(spark, tmp_path, 200, 5))
    got = df.select(F.spark_partition_id().alias("part"), "table_id", "candidate_answers_prompt", "question_prompt").collect()
    assert sorted(r.table_id for r in got) == list(range(200))
    for r in got:
        assert r.candidate_answers_prompt.endswith(f"Question: Is it {r.table_id % 5} of 5")
        assert r.question_prompt.count("|1995-05-18\n") == 1 + r.table_id % 4
    for _, rows in groupby(got, lambda r: r.part):
        questions = [r.table_id % 5 for r in rows]
        assert len([*groupby(questions)]) == len(set(questions))


def test_texts_of_all_tables_are_dealt_by_the_size_of_the_input(spark, tmp_path):
    """Partitions that are sorted in memory grow in number with the input, whatever the session's number is."""
    path = _orders(spark, tmp_path / "a", 200, 5)
    _orders(spark, tmp_path / "b", 200, 5)
    spark.read.parquet(f"{path}/lineitem.parquet").repartition(30).write.mode("append").parquet(f"{tmp_path}/b/lineitem.parquet")
    kept, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for name, n in (("a", "1"), ("a", "3"), ("b", "1")):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen += re.findall(r"Exchange hashpartitioning\(table_id#\d+L, (\d+)\)", _plan(x8_verification_prompts(spark, f"{tmp_path}/{name}")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    one, other, more = map(int, seen)
    assert one == other == tb.SPREAD * tb.table(spark, path, "lineitem").rdd.getNumPartitions() and more > one
    rows = [sorted(map(tuple, tb.table_cells(spark, path, spread=x).collect()), key=str) for x in (False, True)]
    assert rows[0] == rows[1] and len(rows[0]) == 501


@pytest.mark.parametrize("mode", ["plain", "indexed"])
def test_digests_equal_those_of_whole_texts(spark, mode):
    rows = [(t, i, ["h1", "h|2"], [f"c{i}é", 'say "x"\nnew' if i % 3 else None]) for t in range(30) for i in range(500 if t == 5 else 1 + t % 9)]
    rows += [(None, i, ["h"], ["z"]) for i in range(3)] + [(5, 7, ["h1", "h|2"], None)]
    df = spark.createDataFrame(rows, "table_id int, row_idx int, header array<string>, cells array<string>")
    for size in (1, 300, 1 << 20):
        whole = {(r.table_id, len(r.table), hashlib.sha256(r.table.encode()).hexdigest()) for r in tt.render_large_tables(df, mode, chunk_bytes=size).collect()}
        got = tt.digest_large_tables(tt.table_lines(df, chunk_bytes=size), mode)
        assert {tuple(r) for r in got.collect()} == whole and len(whole) == 31
        assert "collect_list" not in _plan(got)


def test_markdown_width_is_measured_once_a_column(spark):
    """Columns are measured outside the lambda over their cells: a table's cost grows with its rows, not their square."""
    df = spark.createDataFrame([(1, i, ["a"], [f"{i}.{'5' * (i % 4)}"]) for i in range(40)], "table_id int, row_idx int, header array<string>, cells array<string>")
    lines = tt.render_tables(df, "markdown").first().table.split("\n")
    assert len(lines) == 42 and len({len(x) for x in lines}) == 1 and len({x.index(".") for x in lines[2:]}) == 1
    c = F.array(F.struct(F.lit("a").alias("name"), F.array(F.lit("1.5")).alias("cells"), F.lit(True).alias("number")))
    shown = str(tt.markdown_aligned(c))
    assert shown.count("array_max") <= 4


def test_strip_equals_the_pattern(spark):
    texts = ["", " ", " a ", "\t\n\x0b\f\r a  ", "a \u0085", " a  ", "a\n ", "x \x1c", "  b\r\n", "é  ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(tx.strip_ws("t").alias("a"), F.regexp_replace("t", r"^\s+|\s+$", "").alias("b")).collect():
        assert r.a == r.b


def test_scorer_gets_one_call_at_a_time(spark):
    """Only the prompts of one call become Python strings, whatever the size of a batch."""
    import gc

    def held(prompts):
        n = sum(isinstance(x, pd.DataFrame) for x in gc.get_objects())
        return pd.Series([f"{len(prompts)} {n}"] * len(prompts))

    df = spark.range(95).coalesce(1).select("id", F.lit("p").alias("prompt"))
    got = cp.score_batches(df, held).collect()
    assert [r.id for r in got] == list(range(95))
    assert [r.reply for r in got] == ["10 0"] * 90 + ["5 0"] * 5
