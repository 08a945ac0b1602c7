"""Samples of exact size, draws from few train rows, prompt keys, scorer accounts and isolated grid cells."""

from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.constants import NO_RESPONSE
from quire.operators import cells as cl
from quire.operators import completions as cp
from quire.operators import prompts as pr
from quire.operators import sampling as sm

REPEATED = ([(f"id{i}", f"row {i}") for i in range(19)] + [("hot", f"copy {i % 4}") for i in range(31)]
            + [(None, "null a"), (None, "null a"), (None, "null b")])


@pytest.mark.parametrize("k", [1, 5, 20, 49, 51, 52, 53])
def test_sample_has_exactly_k_rows(spark, k):
    """Repeated keys, repeated rows and NULL keys: k rows, each no more often than it is there; NULL keys come last."""
    df = spark.createDataFrame(REPEATED, "id string, v string")
    got = Counter(map(tuple, sm.seeded_sample(df.repartition(3), "id", k, seed=4).collect()))
    assert sum(got.values()) == k and not got - Counter(REPEATED)
    assert sum(n for (i, _), n in got.items() if i is None) == max(0, k - 50)
    again = Counter(map(tuple, sm.seeded_sample(df.repartition(7), "id", k, seed=4).collect()))
    assert got == again
    larger = Counter(map(tuple, sm.seeded_sample(df, "id", min(k + 1, 53), seed=4).collect()))
    assert not got - larger  # a smaller sample is part of a larger one
    split = Counter(r.split for r in sm.train_test_split(df, "id", n_train=k, seed=4).collect())
    assert split == Counter({"train": k, "test": 53 - k}) - Counter()


def test_sample_beyond_the_rows(spark):
    df = spark.createDataFrame(REPEATED, "id string, v string")
    assert sm.seeded_sample(df, "id", 54).count() == 0 and sm.seeded_sample(df, "id", 0).count() == 0
    assert sm.train_test_split(df, "id", n_train=54).where("split = 'train'").count() == 53
    assert sm.seeded_sample(df.limit(0), "id", 1).count() == 0
    with pytest.raises(ValueError):
        sm.seeded_sample(df, "id", 54, strict=True)


def test_draw_from_one_train_row_is_spread(spark):
    """One train row for all test rows: as many copies of it as the draws ask for, none with more than its share."""
    test = spark.range(4000).select(F.col("id").cast("string").alias("example_id"))
    train = spark.createDataFrame([("t", "question", "long text")], "example_id string, question string, documents string")
    d = sm.few_shot_draw(test, train, "example_id", k=2, payload=("question", "documents"), draws_per_copy=100)
    got = d.collect()
    assert len(got) == 4000 and {(r.shot, r.train_id, r.question, r.documents) for r in got} == {(0, "t", "question", "long text")}
    n = [r["count"] for r in d.select(F.pmod(F.xxhash64("example_id"), F.lit(81)).alias("salt")).groupBy("salt").count().collect()]
    assert len(n) == 81 and max(n) < 120
    assert sm.few_shot_draw(test, train.limit(0), "example_id", k=2).count() == 0


def examples(spark):
    rows = [(i, "train" if i < 3 else "test", f"q{i % 5}" if i != 7 else None, f"a{i}" if i else None, f"docs {i % 4}", f"|t{i}|" if i % 2 else None)
            for i in range(12)]
    return spark.createDataFrame(rows, "example_id int, split string, question string, ground_truth string, documents string, table string")


def test_grid_keys_stand_for_prompts(spark):
    """Two cells have one key exactly if their prompts are equal; keys differ between models."""
    ex = examples(spark)
    parts = pr.prompt_parts(ex)
    for k in (1, 2):
        full = {(r.example_id, r.reasoning_type, r.prompt_type): r.prompt for r in pr.text_prompts(ex, k=k).collect()}
        keys = {(r.example_id, r.reasoning_type, r.prompt_type): r.prompt_key for r in pr.grid_keys(parts, "m", k=k).collect()}
        assert set(keys) == set(full)
        cells = list(full)
        for a in cells:
            for b in cells:
                assert (keys[a] == keys[b]) == (full[a] == full[b])
        other = {r.prompt_key for r in pr.grid_keys(parts, "n", k=k).collect()}
        assert not (other & set(keys.values())) - {""}


def test_prompts_for_pending_cells_only(spark):
    ex = examples(spark)
    full = {(r.example_id, r.reasoning_type, r.prompt_type): r.prompt for r in pr.text_prompts(ex, k=2).collect()}
    some = sorted(full)[::3]
    cells = spark.createDataFrame(some, "example_id int, reasoning_type string, prompt_type string")
    got = {(r.example_id, r.reasoning_type, r.prompt_type): r.prompt for r in pr.prompts_for(ex, cells, k=2).collect()}
    assert got == {c: full[c] for c in some}


def test_lookup_reads_no_text(spark):
    """The plan of the pending lookup holds keys and ids, no text column of the examples."""
    parts = pr.prompt_parts(examples(spark))
    keys = pr.grid_keys(parts, "m")
    store = cp.reply_store(keys.limit(2).select("prompt_key", F.lit("r").alias("reply")))
    _, pending = cp.lookup(keys, store)
    plan = pending._jdf.queryExecution().optimizedPlan().toString()
    assert "documents" not in plan.replace("documents, AS", "") or "ReadSchema" not in plan
    assert not {"question", "ground_truth", "documents", "table"} & set(parts.columns)


def picky(prompts: pd.Series) -> pd.Series:
    if any("bad" in p for p in prompts):
        raise ValueError("refused: " + next(p for p in prompts if "bad" in p))
    if any("short" in p for p in prompts):
        return prompts.iloc[1:]
    return prompts.str.upper()


def test_scorer_accounts(spark):
    rows = [(i, {3: "bad 3", 17: "short", 25: "bad 25"}.get(i, f"p{i}")) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, prompt string").coalesce(1)
    fn = __import__("pyspark").cloudpickle  # the scorer travels by value, as a caller's own function would
    fn.register_pickle_by_value(__import__("sys").modules[__name__])
    scored = cp.score_batches(df, picky, accounts=True).cache()
    got = {r.id: r for r in scored.collect()}
    for i, p in rows:
        if i in (3, 17, 25):
            assert got[i].reply == NO_RESPONSE and got[i].error
        else:
            assert got[i].reply == p.upper() and got[i].error is None
    assert got[3].error == "ValueError: refused: bad 3" and "0 replies for 1 prompts" in got[17].error
    s = cp.scoring_summary(scored).first()
    assert (s.n_prompts, s.n_lost, s.n_retried) == (40, 3, 30) and s.reason.startswith("ValueError")
    assert all(got[i].calls == 1 for i in range(30, 40))  # a batch without a failure is one call
    assert cp.ensure_scored(scored) is scored


def test_broken_scorer_is_an_error(spark):
    def broken(prompts):
        raise KeyError("no such deployment")

    df = spark.range(300).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    with pytest.raises(Exception, match="no such deployment"):
        cp.score_batches(df, broken, give_up_after=50).collect()
    few = cp.score_batches(df.limit(5), broken, accounts=True).cache()
    assert few.where(F.col("reply") == NO_RESPONSE).count() == 5
    with pytest.raises(cp.ScorerError, match="any of 5"):
        cp.ensure_scored(few)


def test_cells_fail_alone_and_resume(spark, tmp_path):
    calls = Counter()

    def cell(name):
        def build():
            calls[name] += 1
            if name == "plan":
                raise LookupError("no such skill")
            d = spark.range(3).select(F.concat(F.lit(f"{name} "), F.col("id").cast("string")).alias("v"))
            return d.select(F.when(F.lit(name == "task") & (F.col("v") == "task 2"), F.raise_error(F.lit("cell broke"))).otherwise(F.col("v")).alias("v"))
        return build

    names = ["a", "task", "b/c, d", "plan", "e"]
    rows, errors = cl.run_cells(spark, {n: cell(n) for n in names}, str(tmp_path / "out"), "v string", parallel=3)
    assert {(r.cell, r.v) for r in rows.collect()} == {(n, f"{n} {i}") for n in ("a", "b/c, d", "e") for i in range(3)}
    assert {(r.cell, r.reason) for r in errors.collect()} == {("task", "cell broke"), ("plan", "no such skill")}
    cl.run_cells(spark, {n: cell(n) for n in names}, str(tmp_path / "out"), "v string")
    assert calls == Counter({"a": 1, "b/c, d": 1, "e": 1, "task": 2, "plan": 2})
    rows, errors = cl.run_cells(spark, {"plan": cell("plan")}, str(tmp_path / "none"), "v string")
    assert rows.count() == 0 and errors.count() == 1
