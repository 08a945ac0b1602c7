"""Registered queries and oracles: sources and sinks, projections, set operations
(S1-S4, S6-S11, P2, P3, P8, U1-U3, J2, F5, F6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.constants import MISSING_WORDS, PROMPT_TYPES, REASONING_TYPES
from quire.operators import characteristics as ch
from quire.operators import scoring as sc
from quire.operators import sampling as sm
from quire.plans.catalog import query
from quire.plans.fixture_sql import with_fixtures as W
from quire.plans.oracle import ORACLE
from quire.sources import collections as co
from quire.sources import files as fs
from quire.sources import tables as tb

RUN_ROOT = "eval_output"
SKIP_SUBSTRING = "src1"
INCLUDE_SUBSTRING = "few-shot"


def _runs(spark, d):
    """Run files as a folder holds them: one per context type, model (a corpus name) and prompt type."""
    docs = tb.table(spark, d, "documents")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    i = F.col("doc_id")
    runs = docs.select(pick(REASONING_TYPES, i).alias("reasoning_type"), F.col("source").alias("model"),
                       pick(PROMPT_TYPES, F.floor(i / 2)).alias("prompt_type")).distinct()
    return runs.select(fs.run_path(RUN_ROOT, F.lit("all"), F.lit("main")).alias("path"))


@query("s1_json_roundtrip")
def s1_json_roundtrip(spark, d):
    ex = tb.examples(spark, d).select(
        "question", "ground_truth", "documents", F.lit(None).cast("string").alias("table"),
        F.lit(None).cast("map<string,int>").alias("characteristic_breakdown"),
        F.col("validity_scalar").cast("int").alias("validity_scalar"),
        F.col("example_id").cast("string").alias("example_id"))
    path = fs.scratch_dir(spark, "examples")
    fs.write_json(ex, path)
    back = fs.read_json_dir(spark, path, fs.EXAMPLE_SCHEMA, multiline=False)
    return back.select(F.col("example_id").cast("bigint").alias("example_id"), "question", "ground_truth",
                       "validity_scalar")


@query("s4_merge")
def s4_merge(spark, d):
    """Examples, one JSON object each, merged into one ordered collection, and read back by position."""
    ex = tb.examples(spark, d).select("example_id", "question", "ground_truth", "validity_scalar")
    path = fs.scratch_dir(spark, "collection")
    co.write_collection(ex, path, ["example_id"])
    return co.read_collection(spark, path, "example_id bigint, question string, ground_truth string, validity_scalar bigint")


SEED_BATCH = 2000  # documents in one seed file: files of several splits, with quoted line breaks
SEED_SPLIT = "1m"


@query("s5_seed_tables")
def s5_seed_tables(spark, d):
    """Documents written as seed tables (one file per run of ids) and read by byte ranges."""
    docs = tb.table(spark, d, "documents").select("doc_id", "source", "text", F.floor(F.col("doc_id") / SEED_BATCH).alias("batch"))
    path = fs.scratch_dir(spark, "seed_tables")
    (docs.repartition("batch").sortWithinPartitions("batch", "doc_id").write.partitionBy("batch").option("header", True).option("sep", "#")
         .option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", SEED_SPLIT)
    try:
        t = fs.accepted_tables(fs.read_seed_tables(spark, path))
        t.schema
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    cell = lambda i: F.element_at("cells", i)
    return t.select(F.regexp_extract("table_id", "batch=([0-9]+)", 1).cast("bigint").alias("batch"), "row_idx",
                    cell(1).cast("bigint").alias("doc_id"), cell(2).alias("source"), cell(3).alias("text"),
                    F.array_join("header", ",").alias("header"))


@query("s2_tolerant_read")
def s2_tolerant_read(spark, d):
    path = fs.scratch_dir(spark, "raw")
    tb.raw_json(spark, d).select(F.col("raw").alias("value")).write.text(path)
    good, bad = fs.read_json_tolerant(spark, path, "k bigint", multiline=False, glob="*.txt")
    return good.select("k", F.lit(None).cast("string").alias("corrupt")).unionByName(
        bad.select(F.lit(None).cast("bigint").alias("k"), F.col(fs.CORRUPT).alias("corrupt")))


@query("s7_partitioned_runs")
def s7_partitioned_runs(spark, d):
    path = fs.scratch_dir(spark, "runs")
    ev = sc.parse_scores(tb.evaluations(spark, d))
    fs.write_parquet(ev, path, partition_by=["reasoning_type", "model", "prompt_type"])
    back = spark.read.parquet(path)  # partition discovery restores the run columns
    return back.select("example_id", "model", "prompt_type", "reasoning_type", "judge_raw", "accuracy", "em_accuracy")


@query("s9_tracker_csv")
def s9_tracker_csv(spark, d):
    ex = tb.examples(spark, d)
    blank = ex.select("example_id", F.lit(None).cast("int").alias("table_validity"),
                      F.lit(None).cast("int").alias("docs_validity"))
    labelled = blank.drop("table_validity").join(tb.tracker(spark, d), "example_id", "left")
    path = fs.scratch_dir(spark, "tracker")
    fs.write_csv(fs.tracker_for_write(labelled), path)
    back = fs.read_tracker(spark, path)
    return back.select(F.col("example_id").cast("bigint").alias("example_id"), "table_validity", "docs_validity")


@query("s8_keyed_upsert")
def s8_keyed_upsert(spark, d):
    old = tb.examples(spark, d).select("example_id", "question")
    new = sm.last_n(old, "example_id", 25).withColumn("question", F.concat(F.lit("v2: "), F.col("question")))
    return fs.upsert(old, new, "example_id")


@query("s11_path_params")
def s11_path_params(spark, d):
    return _runs(spark, d).select("path", *fs.run_params("path"))


@query("f6_skip_list")
def f6_skip_list(spark, d):
    return _runs(spark, d).where(F.col("path").contains(SKIP_SUBSTRING))


@query("f5_run_filter")
def f5_run_filter(spark, d):
    runs = _runs(spark, d)
    return fs.filter_runs(runs, skip=runs.where(F.col("path").contains(SKIP_SUBSTRING)))


@query("f5_run_filter_include")
def f5_run_filter_include(spark, d):
    """An include list wins over the skip list."""
    runs = _runs(spark, d)
    return fs.filter_runs(runs, skip=runs.where(F.col("path").contains(SKIP_SUBSTRING)),
                          include=runs.where(F.col("path").contains(INCLUDE_SUBSTRING)))


@query("p2_example_id_from_path")
def p2_example_id_from_path(spark, d):
    docs = tb.table(spark, d, "documents")
    path = F.concat(F.lit("data/raw_data/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/run_"),
                    F.col("doc_id").cast("string"), F.lit(".v4/full_log.json"))
    return docs.select("doc_id", fs.example_id_from_path(path).alias("example_id"))


@query("p3_drop_fields")
def p3_drop_fields(spark, d):
    return tb.examples(spark, d).drop("documents", "table", "not_a_field")


@query("p8_blank_tracker")
def p8_blank_tracker(spark, d):
    ex = tb.examples(spark, d)
    both = ex.where("split = 'train'").select("example_id").unionByName(ex.where("split = 'test'").select("example_id"))
    return both.select("example_id", F.lit(None).cast("int").alias("table_validity"),
                       F.lit(None).cast("int").alias("docs_validity"))


@query("u1_train_test_union")
def u1_train_test_union(spark, d):
    ex = tb.examples(spark, d).select("example_id", "split")
    return ex.where("split = 'train'").unionByName(ex.where("split = 'test'"))


@query("u2_log_collections")
def u2_log_collections(spark, d):
    ex = tb.examples(spark, d).select("example_id", "question")
    toy = sm.seeded_sample(ex, "example_id", k=50, seed=0)
    return ex.withColumn("collection", F.lit("main")).unionByName(toy.withColumn("collection", F.lit("toy")))


@query("u3_characteristic_names")
def u3_characteristic_names(spark, d):
    m = ch.scores_to_map(tb.characteristics(spark, d))
    return m.select(F.explode(F.map_keys("scores")).alias("characteristic")).distinct()


@query("j2_examples_tracker")
def j2_examples_tracker(spark, d):
    ex = tb.examples(spark, d).drop("human_validity")
    return ex.join(tb.tracker(spark, d), "example_id").select("example_id", "validity_scalar", "table_validity")


# ============================================================== oracle SQL
RUNS = ("runs", """SELECT DISTINCT 'eval_output/all/main/' || reasoning_type || '/' || model || '/' || prompt_type
                   || '_score.json' AS path, reasoning_type, model, prompt_type FROM (
  SELECT ['documents', 'table'][CAST(doc_id % 2 + 1 AS INTEGER)] AS reasoning_type, source AS model,
         ['zero-shot', 'zero-shot-CoT', 'few-shot', 'few-shot-CoT'][CAST((doc_id // 2) % 4 + 1 AS INTEGER)] AS prompt_type
  FROM documents) r""")

ORACLE["s1_json_roundtrip"] = W("examples") + """
SELECT example_id, question, ground_truth, CAST(validity_scalar AS INTEGER) AS validity_scalar FROM examples"""
ORACLE["s4_merge"] = W("examples") + """
SELECT row_number() OVER (ORDER BY example_id) - 1 AS position, example_id, question, ground_truth, CAST(validity_scalar AS BIGINT) AS validity_scalar
FROM examples"""
ORACLE["s5_seed_tables"] = f"""
SELECT doc_id // {SEED_BATCH} AS batch, CAST(row_number() OVER (PARTITION BY doc_id // {SEED_BATCH} ORDER BY doc_id) AS INTEGER) AS row_idx,
       doc_id, source, CASE WHEN text IN ('', {", ".join(f"'{w}'" for w in MISSING_WORDS)}) THEN NULL ELSE text END AS text,
       'doc_id,source,text' AS header
FROM documents"""
ORACLE["s2_tolerant_read"] = W("raw_json") + """
SELECT CASE WHEN json_valid(raw) THEN CAST(json_extract(raw, '$.k') AS BIGINT) END AS k,
       CASE WHEN NOT json_valid(raw) THEN raw END AS corrupt FROM raw_json"""
ORACLE["s7_partitioned_runs"] = W("scored") + """
SELECT example_id, model, prompt_type, reasoning_type, judge_raw, accuracy, em_accuracy FROM scored"""
ORACLE["s9_tracker_csv"] = W("examples", "tracker") + """
SELECT e.example_id, t.table_validity, CAST(NULL AS INTEGER) AS docs_validity
FROM examples e LEFT JOIN tracker t ON t.example_id = e.example_id"""
ORACLE["s8_keyed_upsert"] = W("examples") + """
SELECT example_id, CASE WHEN example_id IN (SELECT example_id FROM examples ORDER BY example_id DESC LIMIT 25)
                        THEN 'v2: ' || question ELSE question END AS question
FROM examples"""
ORACLE["s11_path_params"] = W(extra=[RUNS]) + "SELECT path, reasoning_type, model, prompt_type FROM runs"
ORACLE["f6_skip_list"] = W(extra=[RUNS]) + "SELECT path FROM runs WHERE contains(path, 'src1')"
ORACLE["f5_run_filter"] = W(extra=[RUNS]) + "SELECT path FROM runs WHERE NOT contains(path, 'src1')"
ORACLE["f5_run_filter_include"] = W(extra=[RUNS]) + "SELECT path FROM runs WHERE contains(path, 'few-shot')"
ORACLE["p2_example_id_from_path"] = """
SELECT doc_id, source || '_' || lang || '_run_' || CAST(doc_id AS VARCHAR) AS example_id FROM documents"""
ORACLE["p3_drop_fields"] = W("examples") + """
SELECT example_id, question, ground_truth, validity_scalar, human_validity, split FROM examples"""
ORACLE["p8_blank_tracker"] = W("examples") + """
SELECT example_id, CAST(NULL AS INTEGER) AS table_validity, CAST(NULL AS INTEGER) AS docs_validity FROM examples"""
ORACLE["u1_train_test_union"] = W("examples") + "SELECT example_id, split FROM examples"
ORACLE["u2_log_collections"] = W("examples") + """
SELECT example_id, question, 'main' AS collection FROM examples
UNION ALL
SELECT example_id, question, 'toy' FROM (
  SELECT example_id, question, row_number() OVER (ORDER BY sha256(concat('0', CAST(example_id AS VARCHAR))), example_id) AS r,
         count(*) OVER () AS n FROM examples) s
WHERE r <= 50 AND n >= 50"""
ORACLE["u3_characteristic_names"] = W("characteristics") + "SELECT DISTINCT characteristic FROM characteristics"
ORACLE["j2_examples_tracker"] = W("examples", "tracker") + """
SELECT e.example_id, e.validity_scalar, t.table_validity FROM examples e JOIN tracker t ON t.example_id = e.example_id"""


@query("s8_stream_append")
def s8_stream_append(spark, d):
    """Two deliveries of judge outputs through the incremental stream; the second one
    adds the table runs and re-delivers model_a zero-shot document scores, corrected."""
    from quire.streaming import current_evaluations, run_incremental_scoring

    src, table = fs.scratch_dir(spark, "judge-src"), fs.scratch_dir(spark, "judge-table")
    ev = tb.evaluations(spark, d)
    ev.where("reasoning_type = 'documents'").write.mode("append").json(src)
    run_incremental_scoring(spark, src, table)
    fix = ev.where("reasoning_type = 'documents' AND model = 'model_a' AND prompt_type = 'zero-shot'") \
            .withColumn("judge_raw", F.lit("10"))
    ev.where("reasoning_type = 'table'").unionByName(fix).write.mode("append").json(src)
    run_incremental_scoring(spark, src, table)
    return current_evaluations(spark, table).select(
        "example_id", "model", "prompt_type", "reasoning_type", "judge_raw", "accuracy", "em_accuracy")


ORACLE["s8_stream_append"] = W("scored") + """
SELECT example_id, model, prompt_type, reasoning_type,
       CASE WHEN fix THEN '10' ELSE judge_raw END AS judge_raw,
       CASE WHEN fix THEN 10 ELSE accuracy END AS accuracy,
       CASE WHEN fix THEN 1 ELSE em_accuracy END AS em_accuracy
FROM (SELECT *, reasoning_type = 'documents' AND model = 'model_a' AND prompt_type = 'zero-shot' AS fix FROM scored) s"""


@query("s10_rebuild_and_append")
def s10_rebuild_and_append(spark, d):
    """Rebuild the dataset (W1 split, overwrite), then append the last 25 examples, edited."""
    ex = tb.examples(spark, d).select("example_id", "question")
    path = fs.scratch_dir(spark, "dataset")
    fs.rebuild_dataset(ex, path, "example_id", n_train=1, seed=0)
    new = sm.last_n(ex, "example_id", 25).withColumn("question", F.concat(F.lit("v2: "), F.col("question")))
    fs.append_to_dataset(new, path, batch_id=1)
    return fs.read_dataset(spark, path, "example_id").select("split", "example_id", "question")


ORACLE["s10_rebuild_and_append"] = W("examples") + """
SELECT split, example_id, question FROM (
  SELECT CASE WHEN row_number() OVER (ORDER BY sha256(concat('0', CAST(example_id AS VARCHAR))), example_id) <= 1
              THEN 'train' ELSE 'test' END AS split, example_id, question
  FROM examples) base
WHERE NOT (split = 'test' AND example_id IN (SELECT example_id FROM examples ORDER BY example_id DESC LIMIT 25))
UNION ALL
SELECT 'test', example_id, 'v2: ' || question FROM (SELECT * FROM examples ORDER BY example_id DESC LIMIT 25) n"""
