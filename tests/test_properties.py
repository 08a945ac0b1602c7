"""Properties: round trips, agreement with plain Python on random input, skew."""

import statistics

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import scoring as sc
from quire.operators import tables as tt

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

cell = st.text(alphabet='abcXYZ019 .-:|"\n', min_size=1, max_size=6).map(str.strip).filter(lambda s: s != "")
table = st.integers(min_value=1, max_value=4).flatmap(
    lambda ncol: st.lists(st.lists(cell, min_size=ncol, max_size=ncol), min_size=1, max_size=5))


@SETTINGS
@given(tables=st.lists(table, min_size=1, max_size=4))
def test_render_then_parse_returns_the_rows(spark, tables):
    rows = [(t, i + 1, [f"c{j}" for j in range(len(r))], r) for t, tab in enumerate(tables) for i, r in enumerate(tab)]
    df = spark.createDataFrame(rows, "table_id int, row_idx int, header array<string>, cells array<string>")
    for mode in ("plain", "indexed"):
        back = tt.parse_tables(tt.render_tables(df, mode), "table").collect()
        skip = 1 if mode == "indexed" else 0  # the indexed form adds a leading index column
        got = sorted((r["table_id"], r["row_idx"], tuple(r["cells"][skip:])) for r in back)
        want = sorted((t, i, tuple(c)) for t, i, _, c in rows)
        assert got == want


@SETTINGS
@given(values=st.lists(st.one_of(st.integers(-20, 20).map(str), st.sampled_from([" 9.0", "x", "", " 7 ", "+3", "1e2"])),
                       min_size=1, max_size=30))
def test_score_parse_agrees_with_python_int(spark, values):
    def py(v):
        try:
            return int(v)
        except ValueError:
            return None
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(tx.parse_int("v")).collect()]
    assert got == [py(v) for v in values]


@SETTINGS
@given(scores=st.lists(st.integers(0, 10), min_size=1, max_size=60))
def test_run_statistics_agree_with_python_statistics(spark, scores):
    df = spark.createDataFrame([("r", s) for s in scores], "run string, accuracy int") \
              .withColumn("em_accuracy", sc.em_flag("accuracy"))
    r = sc.run_statistics(df, ["run"], digits=None).collect()[0]
    assert abs(r["mean"] - statistics.mean(scores)) < 1e-9
    assert r["median"] == statistics.median(scores)
    if len(scores) > 1:
        assert abs(r["stdev"] - statistics.stdev(scores)) < 1e-9
    assert r["max"] == max(scores) and r["min"] == min(scores)
    assert abs(r["em_accuracy"] - statistics.mean(1 if s > 8 else 0 for s in scores)) < 1e-12


def test_hot_table_is_rejected_not_collected(spark):
    # one table holds a third of all rows: the gate rejects it with a reason, the rest render
    hot = spark.range(0, 3000).select(F.lit(-1).alias("table_id"), (F.col("id") + 1).cast("int").alias("row_idx"))
    cold = spark.range(0, 6000).select((F.col("id") % 1000).cast("int").alias("table_id"),
                                       (F.col("id") / 1000 + 1).cast("int").alias("row_idx"))
    df = hot.unionByName(cold).select("table_id", "row_idx", F.array(F.lit("a")).alias("header"),
                                      F.array(F.col("row_idx").cast("string")).alias("cells"))
    gate = {r["table_id"]: r for r in tt.size_gate(df).collect()}
    assert gate[-1]["accepted"] is False and gate[-1]["reason"] == "rows 3000 > 11"
    texts = tt.render_tables(tt.gated(df), "plain")
    assert texts.count() == 1000 and texts.where("table_id = -1").count() == 0
    whole = tt.render_tables(df, "plain")  # without the gate every table is rendered
    assert whole.count() == 1001 and len(whole.where("table_id = -1").collect()[0]["table"].split("\n")) == 3002


def test_hot_run_statistics_exact(spark):
    hot = spark.range(0, 20000).select(F.lit("hot").alias("run"), (F.col("id") % 11).cast("int").alias("accuracy"))
    cold = spark.range(0, 30).select(F.lit("cold").alias("run"), (F.col("id") % 3).cast("int").alias("accuracy"))
    df = hot.unionByName(cold).withColumn("em_accuracy", sc.em_flag("accuracy"))
    st_ = {r["run"]: r for r in sc.run_statistics(df.repartition(7), ["run"]).collect()}
    assert st_["hot"]["n"] == 20000 and st_["hot"]["median"] == 5.0 and st_["cold"]["median"] == 1.0
