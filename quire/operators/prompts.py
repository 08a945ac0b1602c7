"""Prompt rendering and experiment grids.

Grids over small config lists (context types x prompt types, skills x complexity x
domain) are ``explode``s of literal arrays: generators, no join. Few-shot examples
are drawn per test example (W4) and folded into one string per example with an
ordered ``collect_list`` whose size is the shot count ``k``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.constants import (AMBIGUITY_PROMPT, ANSWERABILITY_PROMPT, CANDIDATE_ANSWERS_PROMPT, COMPLEXITY_LEVELS,
                             CONTEXT_KEY, COT, DOMAINS, EDIT_APPLICATION_PROMPT, EDIT_PLAN_PROMPT, INPUT_KEY,
                             JUDGE_COMPRESS, JUDGE_NORM, JUDGE_SCALAR, QUESTION_PROMPT, OUTPUT_KEY, PROMPT_TYPES, PROMPTS, PROVIDERS, REASONING_TYPES,
                             REFINEMENT, SKILL_INSTRUCTION, SKILL_PREAMBLE)
from quire.functions.text import fill_template
from quire.operators.sampling import few_shot_draw


def context_for(reasoning_type: Column, documents: str = "documents", table: str = "table") -> Column:
    """The context column chosen by the reasoning type."""
    return F.when(reasoning_type == "table", F.col(table)).otherwise(F.col(documents))


def run_grid(df: DataFrame, reasoning_types: list[str] = REASONING_TYPES,
             prompt_types: list[str] = PROMPT_TYPES, models: list[str] | None = None) -> DataFrame:
    """Every row times every (reasoning type, prompt type) cell, and every model when given."""
    cells = F.array(*[F.struct(F.lit(r).alias("reasoning_type"), F.lit(p).alias("prompt_type"),
                               *([F.lit(m).alias("model")] if m is not None else []))
                      for m in (models or [None]) for r in reasoning_types for p in prompt_types])
    return df.select("*", F.explode(cells).alias("_g")).select("*", "_g.*").drop("_g")


def instruction_for(prompt_type: Column) -> Column:
    """Instruction by prompt type: ``zero`` types get the zero-shot text, ``few`` types the
    few-shot text (the chain-of-thought variants are not selected here)."""
    return (F.when(prompt_type.contains("zero"), F.lit(PROMPTS["zero-shot"]))
            .when(prompt_type.contains("few"), F.lit(PROMPTS["few-shot"])))


def shot_strings(test: DataFrame, train: DataFrame, k: int = 1, seed=0, key: str = "example_id") -> DataFrame:
    """W4 + example text: per test example, the few-shot block for each context type.

    ``(key, shots_documents, shots_table)`` with ``Context: c\\nQ: q\\nA: a\\n`` per shot.
    """
    j = few_shot_draw(test.select(key), train, key, k, seed, payload=("question", "ground_truth", "documents", "table"))

    def block(ctx: str) -> Column:
        return F.concat(F.lit(f"{CONTEXT_KEY} "), F.coalesce(F.col(ctx), F.lit("")), F.lit(f"\n{INPUT_KEY} "),
                        F.col("question"), F.lit(f"\n{OUTPUT_KEY} "), F.col("ground_truth"), F.lit("\n"))

    g = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("shot", block("documents").alias("d"),
                                                                 block("table").alias("t")))).alias("_s"))
    return g.select(key, F.array_join(F.transform("_s", lambda x: x["d"]), "").alias("shots_documents"),
                    F.array_join(F.transform("_s", lambda x: x["t"]), "").alias("shots_table"))


def _prompt_inputs(examples: DataFrame, k: int, seed, key: str, extra: tuple[str, ...] = (),
                   reasoning_types: list[str] = REASONING_TYPES, prompt_types: list[str] = PROMPT_TYPES) -> DataFrame:
    test = examples.where(F.col("split") == "test").select(key, "question", "documents", "table", *extra)
    if any("few" in p for p in prompt_types):
        train = examples.where(F.col("split") == "train")
        # join once per example, then fan out to the grid: the texts cross the shuffle once, not 8 times
        test = test.join(shot_strings(test, train, k, seed, key), key, "left")
    else:  # no few-shot cell: no draw, no join
        test = test.select("*", F.lit(None).cast("string").alias("shots_documents"),
                           F.lit(None).cast("string").alias("shots_table"))
    return _with_context(run_grid(test, reasoning_types, prompt_types), key, extra)


def _with_context(g: DataFrame, key: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Grid rows with their context and few-shot block."""
    rt, pt = F.col("reasoning_type"), F.col("prompt_type")
    return g.select(key, "reasoning_type", "prompt_type", "question", *extra,
                    F.coalesce(context_for(rt), F.lit("")).alias("context"),
                    F.when(pt.contains("few"), F.coalesce(
                        F.when(rt == "table", F.col("shots_table")).otherwise(F.col("shots_documents")), F.lit("")))
                    .otherwise(F.lit("")).alias("shots"))


def text_prompts(examples: DataFrame, k: int = 1, seed=0, key: str = "example_id",
                 extra: tuple[str, ...] = (), reasoning_types: list[str] = REASONING_TYPES,
                 prompt_types: list[str] = PROMPT_TYPES) -> DataFrame:
    """X1 (+P4, J7, W4): the text prompt of every test example for every grid cell.

    ``instruction\\n`` + few-shot block + ``Context: c\\nQ: q\\n`` + (CoT line) + ``A:``.
    ``extra`` example columns are carried along; the grid defaults to all cells.
    """
    return assemble_text_prompts(prompt_inputs(examples, k, seed, key, extra, reasoning_types, prompt_types),
                                 key, extra)


def prompt_inputs(examples: DataFrame, k: int = 1, seed=0, key: str = "example_id",
                  extra: tuple[str, ...] = (), reasoning_types: list[str] = REASONING_TYPES,
                  prompt_types: list[str] = PROMPT_TYPES) -> DataFrame:
    """Grid rows with the chosen context and few-shot block, before assembly."""
    return _prompt_inputs(examples, k, seed, key, extra, reasoning_types, prompt_types)


def assemble_text_prompts(inputs: DataFrame, key: str = "example_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """The X1 string from :func:`prompt_inputs` rows (one projection)."""
    pt = F.col("prompt_type")
    prompt = F.concat(instruction_for(pt), F.lit("\n"), F.col("shots"), F.lit(f"{CONTEXT_KEY} "), F.col("context"),
                      F.lit(f"\n{INPUT_KEY} "), F.col("question"), F.lit("\n"),
                      F.when(pt.contains("CoT"), F.lit(COT + "\n")).otherwise(F.lit("")), F.lit(OUTPUT_KEY))
    return inputs.select(key, "reasoning_type", "prompt_type", *extra, prompt.alias("prompt"))


def prompt_parts(examples: DataFrame, key: str = "example_id") -> DataFrame:
    """(key, split, q, a, d, t): SHA-256 of each example's question, answer, documents and table, stored. Texts are read
    here, once; :func:`grid_keys` works on these alone."""
    from quire.session import materialize

    part = lambda c: F.unhex(F.sha2(c, 256))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return materialize(examples.select(key, "split", part(F.col("question")).alias("q"), part(F.col("ground_truth")).alias("a"),
                                       part(empty("documents")).alias("d"), part(empty("table")).alias("t")), "prompt_parts")


def grid_keys(parts: DataFrame, model: str, k: int = 1, seed=0, key: str = "example_id",
              reasoning_types: list[str] = REASONING_TYPES, prompt_types: list[str] = PROMPT_TYPES) -> DataFrame:
    """(key, reasoning_type, prompt_type, prompt_key) of the text prompts of :func:`text_prompts`, without them.

    A prompt's key is the SHA-256 of the model, its instruction and the hashes of its parts, so equal prompts (of equal
    parts) have equal keys. Only hashes are joined and drawn."""
    test, train = parts.where("split = 'test'"), parts.where("split = 'train'")
    block = lambda c: F.concat(c, F.col("q"), F.col("a"))  # noqa: E731  (NULL, as the prompt's block, if a part is)
    if any("few" in p for p in prompt_types):
        shots = few_shot_draw(test.select(key), train, key, k, seed, payload=("q", "a", "d", "t")).groupBy(key).agg(
            F.array_sort(F.collect_list(F.struct("shot", block(F.col("d")).alias("bd"), block(F.col("t")).alias("bt")))).alias("_s"))
        test = test.join(shots, key, "left")
    else:
        test = test.withColumn("_s", F.lit(None).cast("array<struct<shot:int,bd:binary,bt:binary>>"))
    rt, pt = F.col("reasoning_type"), F.col("prompt_type")
    mine = F.filter(F.transform("_s", lambda x: F.when(rt == "table", x["bt"]).otherwise(x["bd"])), lambda b: b.isNotNull())
    drawn = F.when(pt.contains("few"), F.coalesce(F.array_join(F.transform(mine, F.hex), ""), F.lit(""))).otherwise(F.lit(""))
    cot = F.when(pt.contains("CoT"), F.lit(COT)).otherwise(F.lit(""))
    whole = F.concat(F.lit(model), F.lit("\u001f"), instruction_for(pt), F.lit("\u001f"), cot, F.lit("\u001f"), drawn, F.lit("\u001f"),
                     F.hex(F.when(rt == "table", F.col("t")).otherwise(F.col("d"))), F.hex("q"))
    return run_grid(test, reasoning_types, prompt_types).select(
        key, "reasoning_type", "prompt_type", F.coalesce(F.sha2(whole, 256), F.lit("")).alias("prompt_key"))


def prompts_for(examples: DataFrame, cells: DataFrame, k: int = 1, seed=0, key: str = "example_id") -> DataFrame:
    """The text prompts of the grid cells (key, reasoning_type, prompt_type) of ``cells`` only; examples without a cell are
    not read into prompts, and each example's texts are joined once."""
    asked = cells.groupBy(key).agg(F.collect_set(F.struct("reasoning_type", "prompt_type")).alias("_cells"))  # at most the grid
    test = examples.where("split = 'test'").select(key, "question", "documents", "table").join(asked, key)
    few = asked.where(F.exists("_cells", lambda c: c["prompt_type"].contains("few"))).select(key)
    test = test.join(shot_strings(few, examples.where("split = 'train'"), k, seed, key), key, "left")
    g = test.select("*", F.explode("_cells").alias("_g")).select("*", "_g.*")
    return assemble_text_prompts(_with_context(g, key), key)


def _msg(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_prompts(examples: DataFrame, k: int = 1, seed=0, key: str = "example_id") -> DataFrame:
    """The same prompts as chat messages ``array<struct<role, content>>``: the
    instruction as system message, few-shot triples (omitted for ``zero`` types), then
    context, question, CoT line for CoT types, and ``A:``."""
    test = examples.where(F.col("split") == "test")
    train = examples.where(F.col("split") == "train")
    draw = few_shot_draw(test.select(key), train, key, k, seed, payload=("question", "ground_truth", "documents", "table"))
    shots = draw.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("shot", "documents", "table", "question", "ground_truth"))).alias("_s"))
    g = run_grid(test.select(key, "question", "documents", "table").join(shots, key, "left"))
    rt, pt = F.col("reasoning_type"), F.col("prompt_type")

    def shot_msgs(s):
        ctx = F.when(rt == "table", s["table"]).otherwise(s["documents"])
        return F.array(_msg("human", F.concat(F.lit(f"{CONTEXT_KEY} "), F.coalesce(ctx, F.lit("")))),
                       _msg("human", F.concat(F.lit(f"{INPUT_KEY} "), s["question"])),
                       _msg("human", F.concat(F.lit(f"{OUTPUT_KEY} "), s["ground_truth"])))

    empty = F.array().cast("array<struct<role:string,content:string>>")
    examples_msgs = F.when(pt.contains("zero") | F.col("_s").isNull(), empty) \
                     .otherwise(F.flatten(F.transform("_s", shot_msgs)))
    tail = F.when(pt.contains("CoT"), F.array(_msg("human", F.lit(COT)), _msg("human", F.lit(OUTPUT_KEY)))) \
            .otherwise(F.array(_msg("human", F.lit(OUTPUT_KEY))))
    msgs = F.concat(F.array(_msg("system", instruction_for(pt))), examples_msgs,
                    F.array(_msg("human", F.concat(F.lit(f"{CONTEXT_KEY} "), F.coalesce(context_for(rt), F.lit("")))),
                            _msg("human", F.concat(F.lit(f"{INPUT_KEY} "), F.col("question")))), tail)
    return g.select(key, "reasoning_type", "prompt_type", msgs.alias("messages"))


def provider_for(model: Column, strict: bool = True) -> Column:
    """P5: provider by ordered substring test; an unknown model raises (or is NULL)."""
    expr = None
    for sub, prov in PROVIDERS:
        cond = model.contains(sub)
        expr = F.when(cond, F.lit(prov)) if expr is None else expr.when(cond, F.lit(prov))
    return expr.otherwise(F.raise_error(F.lit("Not a valid model.")) if strict else F.lit(None))


def judge_prompts(df: DataFrame, predicted: str, question: str, correct: str) -> DataFrame:
    """Compression, verdict and 0-10 scalar judge prompts per row."""
    return df.select("*",
                     fill_template(JUDGE_COMPRESS, question=F.col(question), predicted=F.col(predicted))
                     .alias("compression_prompt"),
                     fill_template(JUDGE_NORM, question=F.col(question), predicted=F.col(predicted),
                                   correct=F.col(correct)).alias("norm_prompt"),
                     fill_template(JUDGE_SCALAR, question=F.col(question), predicted=F.col(predicted),
                                   correct=F.col(correct)).alias("scalar_prompt"))


def verification_prompts(tables: DataFrame, keep: list[str], question: str = "question", answer: str = "answer",
                         summary: str = "summary", edits: str = "edits", final_table: str = "final_table",
                         demonstration: str = "demonstration", table: str = "table") -> DataFrame:
    """The prompts around one table of the generation workflow: question proposals, edit plan, edit
    application, answerability, candidate answers and ambiguity (over the proposed answer)."""
    c = F.col
    fill = lambda template, **s: fill_template(template, **{k: c(v) for k, v in s.items()})
    return tables.select(
        *keep, fill(QUESTION_PROMPT, seed_table=table).alias("question_prompt"),
        fill(EDIT_PLAN_PROMPT, edit_demonstration=demonstration, seed_table=table, seed_table_summary=summary).alias("edit_plan_prompt"),
        fill_template(EDIT_APPLICATION_PROMPT, edit_plan=c(edits), edit_number=F.lit("1"), edited_table=c(table)).alias("edit_application_prompt"),
        fill(ANSWERABILITY_PROMPT, seed_table_summary=summary, seed_table=table, actual_edits=edits, final_table=final_table,
             final_question=question, final_answer=answer).alias("answerability_prompt"),
        fill(CANDIDATE_ANSWERS_PROMPT, table=final_table, question=question).alias("candidate_answers_prompt"),
        fill(AMBIGUITY_PROMPT, question=question, solutions=answer).alias("ambiguity_prompt"))


def comparison_prompt(instruction: str, docs: list[Column], questions: list[Column]) -> Column:
    """Instruction, two comparison candidates, then the evaluated example."""
    def cand(d, q):
        return F.concat(F.lit("Comparison 1 Context: "), d, F.lit("\n\n'Comparison 1 Evaluation Question: "), q)
    ex = F.concat(F.lit("Evaluation Context: "), docs[0], F.lit("\n\n'Evaluation Question: "), questions[0])
    return F.concat(F.lit(instruction + "\n"), cand(docs[1], questions[1]), F.lit("\n"), cand(docs[2], questions[2]),
                    F.lit("\n"), ex, F.lit("\nNow generate the relative scoring for the final context:"))


def expand_skill_groups(groups: DataFrame, group: str = "skill_group", skills: str = "skills") -> DataFrame:
    """Groups of skills (an array column) to one row per skill, in group order."""
    return groups.select(group, F.posexplode(skills).alias("position", "description"))


def skill_grid(skills: DataFrame, skill: str = "description") -> DataFrame:
    """J8 + X17: skill x complexity x domain cells and their generation prompt."""
    cells = F.array(*[F.struct(F.lit(ci).alias("complexity_idx"), F.lit(c).alias("complexity"),
                               F.lit(di).alias("domain_idx"), F.lit(d).alias("domain"))
                      for ci, c in enumerate(COMPLEXITY_LEVELS) for di, d in enumerate(DOMAINS)])
    g = skills.select("*", F.explode(cells).alias("_g")).select("*", "_g.*").drop("_g")
    prompt = F.concat(F.lit(SKILL_PREAMBLE + "\n"), fill_template(
        SKILL_INSTRUCTION, skill=F.col(skill), complexity=F.col("complexity"), domain=F.col("domain")))
    return g.withColumn("prompt", prompt)


def refinement_prompt(problem: Column, feedback: Column) -> Column:
    """The refinement prompt for one generated problem and its critique."""
    return fill_template(REFINEMENT, problem=problem, feedback=feedback)


def _literal_tokens(s: str) -> int:
    """Token count of a fixed ASCII string (same rule as :func:`quire.functions.text.token_count`)."""
    import re
    return len(re.findall(r"\w+|[^\w\s]", s))


def prompt_token_stats(examples: DataFrame, k: int = 1, seed=0, key: str = "example_id") -> DataFrame:
    """A9 over the X1 prompts without building them.

    Every part of a text prompt is separated from the next by whitespace, so its token
    count is the sum of the parts' counts: each example's question, answer, documents
    and table are counted once, the few-shot block once per example, and the grid cells
    only add integers. Same figures as counting the rendered prompts, at a fraction of
    the text scanned.
    """
    from quire.functions.text import token_count
    from quire.session import materialize

    c_ctx, c_q, c_a = (_literal_tokens(x) for x in (CONTEXT_KEY, INPUT_KEY, OUTPUT_KEY))
    c_zero, c_few, c_cot = (_literal_tokens(PROMPTS["zero-shot"]), _literal_tokens(PROMPTS["few-shot"]),
                            _literal_tokens(COT))

    # texts are read and counted once; from here on there are ids and integers only
    counts = materialize(examples.select(
        key, "split", token_count("question").alias("tq"), token_count("ground_truth").alias("ta"),
        token_count(F.coalesce(F.col("documents"), F.lit(""))).alias("td"),
        token_count(F.coalesce(F.col("table"), F.lit(""))).alias("tt")), "token_counts")
    test = counts.where(F.col("split") == "test").drop("split")
    train = counts.where(F.col("split") == "train").drop("split").withColumnRenamed(key, "train_id")
    draw = few_shot_draw(test.select(key), train.select(F.col("train_id").alias(key)), key, k, seed)
    shot = F.lit(c_ctx + c_q + c_a) + F.col("tq") + F.col("ta")
    shots = draw.join(train, "train_id").groupBy(key).agg(F.sum(shot + F.col("td")).alias("sd"),
                                                          F.sum(shot + F.col("tt")).alias("st"))
    g = run_grid(test.join(shots, key, "left"))
    rt, pt = F.col("reasoning_type"), F.col("prompt_type")
    n = (F.when(pt.contains("zero"), F.lit(c_zero)).otherwise(F.lit(c_few))
         + F.when(pt.contains("few"), F.coalesce(F.when(rt == "table", F.col("st")).otherwise(F.col("sd")), F.lit(0)))
           .otherwise(F.lit(0))
         + F.lit(c_ctx) + F.when(rt == "table", F.col("tt")).otherwise(F.col("td")) + F.lit(c_q) + F.col("tq")
         + F.when(pt.contains("CoT"), F.lit(c_cot)).otherwise(F.lit(0)) + F.lit(c_a))
    p = g.select("reasoning_type", "prompt_type", n.alias("pt_"), F.col("ta"))
    return p.groupBy("reasoning_type", "prompt_type").agg(
        F.count(F.lit(1)).alias("n_prompts"), F.sum("pt_").cast("bigint").alias("total_prompt_tokens"),
        F.round(F.avg("pt_"), 6).alias("avg_prompt_tokens"), F.max("pt_").cast("bigint").alias("max_prompt_tokens"),
        F.sum("ta").cast("bigint").alias("total_answer_tokens"),
        F.round(F.sum("ta") / F.count(F.lit(1)), 6).alias("avg_answer_tokens"),
        F.max("ta").cast("bigint").alias("max_answer_tokens"))
