"""Driver test tables and the fixture views that give them the benchmark's shapes.

Each view is a lazy DataFrame built with the DataFrame API. Literal grids (models,
prompt types, characteristics) are attached with ``explode`` of a literal array, a
generator: no join and no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.constants import CHARACTERISTICS, PROMPT_TYPES, REASONING_TYPES, TERMINATE

FIXTURE_MODELS = ["model_a", "model_b", "model_c"]
TABLE_COLUMNS = ["part", "supplier", "quantity", "price", "flag", "shipped"]
#: partitions that ``spread`` tables are dealt to, for each part of the input that Spark reads at once
SPREAD = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_rows(rows: list[tuple], names: list[str]):
    """An ``array<struct>`` literal of small config rows, built as one SQL expression
    (one call, rather than one per field)."""
    def val(v):
        return _sql_str(v) if isinstance(v, str) else repr(v)
    structs = ", ".join("named_struct(" + ", ".join(f"'{n}', {val(v)}" for n, v in zip(names, r)) + ")"
                        for r in rows)
    return F.expr(f"array({structs})")


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge scores: 3 models x 4 prompt types x 2 context types per example."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    grid = [(mi, m, pi, p, ri, r) for mi, m in enumerate(FIXTURE_MODELS) for pi, p in enumerate(PROMPT_TYPES)
            for ri, r in enumerate(REASONING_TYPES) if not (mi == 2 and pi == 3)]
    arr = literal_rows(grid, ["mi", "model", "pi", "prompt_type", "ri", "reasoning_type"])
    g = d.select("doc_id", "n_chars", F.explode(arr).alias("g"))
    n, i, mi, pi, ri = (F.col("n_chars"), F.col("doc_id"), F.col("g.mi"), F.col("g.pi"), F.col("g.ri"))
    raw = (F.when((n + i * 3 + mi + pi * 2 + ri) % 19 == 0, F.lit("No Response"))
           .when((n + i + mi * 3 + pi + ri) % 23 == 0, F.lit(" 9.0"))
           .otherwise(((i * 7 + n + mi * 3 + pi * 5 + ri * 2) % 11).cast("string")))
    return g.select(F.col("doc_id").alias("example_id"), F.col("g.model").alias("model"),
                    F.col("g.prompt_type").alias("prompt_type"),
                    F.col("g.reasoning_type").alias("reasoning_type"), raw.alias("judge_raw"))


def tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity tracker: example id -> human table-validity label (0/1; absent = unlabelled)."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("example_id"),
                                                 F.col("quality").alias("table_validity"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark examples with the tri-state human validity label and the split."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("human_validity"))
    n_items = b.agg(F.count("*")).scalar()  # every item is some document's question
    j = d.join(b, b.item_id == d.doc_id % n_items).join(lab, "doc_id", "left")
    return j.select(
        F.col("doc_id").alias("example_id"), "question",
        F.substring_index("text", "\n", -1).alias("ground_truth"), F.col("text").alias("documents"),
        (F.col("n_chars") % 6).alias("validity_scalar"), "human_validity",
        F.when(F.col("doc_id") % 10 < 2, "train").otherwise("test").alias("split"))


def characteristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form characteristic scores (0-2 for two names, 0-1 for three, ~3% missing)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    arr = literal_rows(list(enumerate(CHARACTERISTICS)), ["ci", "characteristic"])
    g = d.select("doc_id", "n_chars", F.explode(arr).alias("c"))
    ci = F.col("c.ci")
    return (g.where((F.col("n_chars") + ci) % 29 != 0)
             .select(F.col("doc_id").alias("example_id"), F.col("c.characteristic").alias("characteristic"),
                     ((F.col("doc_id") * (ci * 2 + 3) + F.col("n_chars")) % (ci % 2 + 2))
                     .cast("int").alias("score")))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses with zero, one or two answer markers."""
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn")
    ptype = (F.when(t % 4 == 0, "zero-shot").when(t % 4 == 1, "zero-shot-CoT")
             .when(t % 4 == 2, "few-shot").otherwise("few-shot-CoT"))
    text = F.col("text")
    resp = (F.when(t % 3 == 2, text)
            .when(t % 5 == 3, F.concat(text, F.lit("ANSWER: "), F.substring_index(text, "\n", 1),
                                       F.lit("ANSWER: "), F.lit("again")))
            .otherwise(F.concat(F.lit("Q: x A: "), text, F.lit("ANSWER: "), F.substring_index(text, "\n", 1))))
    return c.select((F.col("conv_id") * 100 + t).alias("example_id"), ptype.alias("prompt_type"),
                    resp.alias("model_response"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent conversations: some end with the termination mark, some hold nothing else, and in
    some a role speaks out of turn."""
    c, i, t = table(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn")
    last = t == F.max("turn").over(Window.partitionBy("conv_id"))
    return c.select("conv_id", "turn", F.when((i % 4 == 1) & (t % 4 == 1), "system").otherwise(F.col("role")).alias("role"),
                    F.when((i % 7 == 3) | ((i % 5 == 1) & last), TERMINATE).otherwise(F.col("text")).alias("text"))


def table_rows(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None, spread: bool = False) -> DataFrame:
    """Small tables: one per order; all rendered columns take part in the row order.

    ``ids`` (a one-column frame of table ids) restricts the tables before the row
    numbering, so only the needed orders are sorted. ``spread`` deals the tables to
    partitions whose number follows the input, not the session's: for whole texts of
    all tables, which are sorted several times and would be spilled each time.
    """
    li = table(spark, sf_dir, "lineitem")
    parts = SPREAD * li.rdd.getNumPartitions() if spread else 0
    if ids is not None:
        li = li.join(ids.select(ids.columns[0]).withColumnRenamed(ids.columns[0], "l_orderkey"), "l_orderkey",
                     "left_semi")
    li = li.select(F.col("l_orderkey").alias("table_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                   "l_returnflag", "l_shipdate")
    if parts:
        li = li.repartition(parts, "table_id")
    w = Window.partitionBy("table_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    # numbered before anything is rendered: only the raw columns are shuffled, and by the name that later steps group by
    li = li.select("*", F.row_number().over(w).cast("int").alias("row_idx"))
    return li.select(
        "table_id", "row_idx",
        F.col("l_partkey").cast("string").alias("part"), F.col("l_suppkey").cast("string").alias("supplier"),
        F.col("l_quantity").cast("int").cast("string").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("price"),
        F.col("l_returnflag").alias("flag"), F.col("l_shipdate").cast("date").cast("string").alias("shipped"))


def table_cells(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None, spread: bool = False) -> DataFrame:
    """table_rows in the engine's table form: ``(table_id, row_idx, header, cells)``."""
    tr = table_rows(spark, sf_dir, ids, spread)
    return tr.select("table_id", "row_idx",
                     F.array(*[F.lit(c) for c in TABLE_COLUMNS]).alias("header"),
                     F.array(*[F.col(c) for c in TABLE_COLUMNS]).alias("cells"))


def raw_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text; every 13th value is cut after 4 characters, every 17th holds two values and every
    19th has single quotes: malformed on purpose."""
    e, i, props = table(spark, sf_dir, "events"), F.col("event_id"), F.col("props")
    return e.select("event_id", F.when(i % 13 == 0, F.substring("props", 1, 4))
                    .when(i % 17 == 0, F.concat(props, F.lit(", "), props))
                    .when(i % 19 == 0, F.replace(props, F.lit('"'), F.lit("'"))).otherwise(props).alias("raw"))


def log_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sectioned text logs (cleaned form): ``**Header**`` line, body, blank line. Bodies hold bold
    lines that are no headers."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("log_id"), F.concat(
        F.lit("**Existing Table Info**\n"), F.lit("|a:|b|\n\n**Totals:**\n|1|2|"),
        F.lit("\n\n**Generated Edits Rationale**\n"), F.lit('{"lang": "'), F.col("lang"), F.lit('"}'),
        F.lit("\n\n**Resultant Generated Question**\n"), F.col("text"),
        F.lit("\n\n**a bold line**\nnot a section")).alias("log_text"))


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def generation_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation-log records (the fields the later stages read), one per example.

    Difficulty is the example's characteristic map as JSON text; the two judge scores
    are the raw replies of the ``model_a`` zero-shot runs for each context type.
    """
    ex = examples(spark, sf_dir)
    cm = characteristics(spark, sf_dir).groupBy("example_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("characteristic", "score")))).alias("_m"))
    ev = evaluations(spark, sf_dir).where((F.col("model") == "model_a") & (F.col("prompt_type") == "zero-shot"))
    scores = ev.groupBy("example_id").agg(
        F.max(F.when(F.col("reasoning_type") == "documents", F.col("judge_raw"))).alias("document_score"),
        F.max(F.when(F.col("reasoning_type") == "table", F.col("judge_raw"))).alias("table_score"))
    j = ex.join(cm, "example_id", "left").join(scores, "example_id", "left")
    return j.select("example_id", "question", F.col("ground_truth").alias("answer"), "documents",
                    F.to_json("_m").alias("difficulty_json"), "validity_scalar", "document_score", "table_score")


def examples_with_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples with their table: the indexed text of the table whose id is
    the example id (NULL when there is none)."""
    from quire.operators import tables as tt

    ex = examples(spark, sf_dir)
    # render only the tables some example points at: the rows are restricted to the
    # example ids before they are numbered and collected
    cells = table_cells(spark, sf_dir, ids=ex.select("example_id"))
    texts = tt.render_tables(cells, "indexed")
    return ex.join(texts.withColumnRenamed("table_id", "example_id"), "example_id", "left")
