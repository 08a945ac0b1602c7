"""Registered queries and oracles: sampling, splitting, pairing, prompts, completions
(W1-W4, W6, W8, J9, J10, P4, P5, P7, X1, X2, X9, X10, X17, J7, J8, A9, J4, J5, J11, E1, Z1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.constants import COMPLEXITY_LEVELS, COT, DOMAINS, JUDGE_COMPRESS, JUDGE_NORM, JUDGE_SCALAR, PROMPTS
from quire.constants import (AMBIGUITY_PROMPT, ANSWERABILITY_PROMPT, CANDIDATE_ANSWERS_PROMPT, EDIT_APPLICATION_PROMPT,
                             EDIT_PLAN_PROMPT, QUESTION_PROMPT, SKILL_INSTRUCTION, SKILL_PREAMBLE)
from quire.functions.ids import content_id, seeded_hash
from quire.functions.text import answer_parts
from quire.operators import cells as cl
from quire.operators import completions as cp
from quire.operators import prompts as pr
from quire.operators import sampling as sm
from quire.operators import scoring as sc
from quire.operators import tables as tt
from quire.plans.catalog import query
from quire.plans.fixture_sql import with_fixtures as W
from quire.plans.oracle import ORACLE
from quire.plans.q_tables import INDEXED, PLAIN_HEAD, PLAIN_ROW, tokens
from quire.sources import files as fs
from quire.sources import tables as tb

COMPARE_INSTRUCTION = ("Score each characteristic of the final example 0, 1 or 2 relative to the two "
                       "comparison examples.")
MODEL = "model_a"
MODEL_FAMILIES = ["gpt-4o", "claude-3", "gemini-pro", "Gemini-Pro", "llama-3", "multiagent", "MultiAgent", "mystery"]


def _test(spark, d):
    return tb.examples(spark, d).where(F.col("split") == "test")


@query("w1_train_test_split")
def w1_train_test_split(spark, d):
    return sm.train_test_split(tb.examples(spark, d).select("example_id"), "example_id", n_train=1, seed=0)


@query("w2_seeded_sample")
def w2_seeded_sample(spark, d):
    return sm.seeded_sample(_test(spark, d).select("example_id"), "example_id", k=50, seed=0)


@query("w3_train_limit")
def w3_train_limit(spark, d):
    train = tb.examples(spark, d).where(F.col("split") == "train").select("example_id")
    return sm.seeded_sample(train, "example_id", k=20, seed=1)


@query("w4_few_shot_draw")
def w4_few_shot_draw(spark, d):
    ex = tb.examples(spark, d)
    return sm.few_shot_draw(ex.where("split = 'test'"), ex.where("split = 'train'"), "example_id", k=2, seed=0)


@query("w6_reasoning_types")
def w6_reasoning_types(spark, d):
    texts = tt.render_tables(tb.table_cells(spark, d), "indexed")
    return sm.reasoning_type_choice(texts, "table", seed=0).drop("types")


@query("w8_last_n")
def w8_last_n(spark, d):
    return sm.last_n(_test(spark, d).select("example_id", "question"), "example_id", 25)


@query("j9_ring_neighbours")
def j9_ring_neighbours(spark, d):
    return sm.ring_neighbours(_test(spark, d), "example_id", seed=12345).drop("idx")


@query("x10_comparison_prompt")
def x10_comparison_prompt(spark, d):
    t = _test(spark, d).select("example_id", "documents", "question")
    ring = sm.ring_neighbours(t, "example_id", seed=12345, payload=("documents", "question"))
    return ring.select("example_id", pr.comparison_prompt(
        COMPARE_INSTRUCTION, [F.col("documents"), F.col("cand1_documents"), F.col("cand2_documents")],
        [F.col("question"), F.col("cand1_question"), F.col("cand2_question")]).alias("prompt"))


@query("j10_refresh_subset")
def j10_refresh_subset(spark, d):
    ex = tb.examples(spark, d).select("example_id", "question", "ground_truth")
    toy = sm.seeded_sample(ex, "example_id", k=50, seed=0).withColumn("ground_truth", F.lit("stale"))
    return sm.refresh_subset(ex, toy, "example_id")


@query("p7_content_ids")
def p7_content_ids(spark, d):
    return tb.table(spark, d, "documents").select("doc_id", content_id("text").alias("content_id"),
                                                  seeded_hash(0, "text").alias("seed_hash"))


@query("p4_context_choice")
def p4_context_choice(spark, d):
    ex = pr.run_grid(tb.examples_with_tables(spark, d).select("example_id", "documents", "table"),
                     prompt_types=["zero-shot"])
    return ex.select("example_id", "reasoning_type",
                     F.length(pr.context_for(F.col("reasoning_type"))).cast("bigint").alias("context_chars"))


@query("x1_text_prompts")
def x1_text_prompts(spark, d):
    return pr.text_prompts(tb.examples_with_tables(spark, d), k=1, seed=0)


@query("a9_token_totals")
def a9_token_totals(spark, d):
    return pr.prompt_token_stats(tb.examples_with_tables(spark, d), k=1, seed=0)


@query("x2_chat_prompts")
def x2_chat_prompts(spark, d):
    c = pr.chat_prompts(tb.examples_with_tables(spark, d), k=1, seed=0)
    return c.select("example_id", "reasoning_type", "prompt_type", F.size("messages").alias("n_messages"),
                    F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])),
                                 "\n").alias("chat_text"))


@query("p5_provider_routing")
def p5_provider_routing(spark, d):
    # model names as runs carry them: a family and the corpus it was tuned on
    family = F.element_at(F.array(*map(F.lit, MODEL_FAMILIES)), (F.col("doc_id") % len(MODEL_FAMILIES) + 1).cast("int"))
    m = tb.table(spark, d, "documents").select(F.concat(family, F.lit("-"), F.col("source")).alias("model")).distinct()
    prov = pr.provider_for(F.col("model"), strict=False)
    return m.select("model", prov.alias("provider"),
                    F.when(prov.isNull(), F.lit("Not a valid model.")).alias("error"))


@query("e4_isolated_cells")
def e4_isolated_cells(spark, d):
    """One job per model family, counting the corpora it was tuned on; families without a provider fail alone."""
    docs = tb.table(spark, d, "documents").where(F.col("doc_id").isNotNull())

    def cell(family):
        model = F.concat(F.lit(family + "-"), F.col("source"))
        return lambda: docs.groupBy("source").agg(F.count("*").alias("n_docs")).select(
            "source", pr.provider_for(model).alias("provider"), "n_docs")

    rows, errors = cl.run_cells(spark, {f: cell(f) for f in MODEL_FAMILIES}, fs.scratch_dir(spark, "cells"),
                                "source string, provider string, n_docs bigint")
    return rows.withColumn("reason", F.lit(None).cast("string")).unionByName(
        errors.select("cell", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("provider"),
                      F.lit(None).cast("bigint").alias("n_docs"), "reason"))


def _answers(spark, d):
    r = tb.responses(spark, d)
    _, answer = answer_parts("model_response", "prompt_type")
    return r.select("example_id", answer.alias("predicted_answer"))


@query("x9_judge_prompts")
def x9_judge_prompts(spark, d):
    j = _answers(spark, d).join(tb.examples(spark, d).select("example_id", "question", "ground_truth"), "example_id")
    return pr.judge_prompts(j, "predicted_answer", "question", "ground_truth").drop(
        "predicted_answer", "question", "ground_truth")


@query("j5_evaluation_records")
def j5_evaluation_records(spark, d):
    verdicts = tb.table(spark, d, "conversations").where("role = 'assistant'").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("example_id"), F.col("text").alias("gpt_eval"))
    scores = sc.parse_scores(tb.evaluations(spark, d).where(
        "model = 'model_a' AND prompt_type = 'zero-shot' AND reasoning_type = 'documents'"))
    ex = tb.examples(spark, d).select("example_id", "question", F.col("ground_truth").alias("correct_answer"))
    j = _answers(spark, d).join(verdicts, "example_id").join(scores.select("example_id", "accuracy", "em_accuracy"),
                                                           "example_id").join(ex, "example_id")
    return j.select("example_id", "question", "predicted_answer", "correct_answer", "accuracy", "em_accuracy",
                    "gpt_eval")


@query("j4_outputs_by_key")
def j4_outputs_by_key(spark, d):
    outs = tb.table(spark, d, "conversations").select(F.col("conv_id").alias("example_id"), "turn",
                                                      F.col("text").alias("model_response"))
    meta = tb.examples(spark, d).select("example_id", "question", "ground_truth")
    return cp.key_outputs(outs, meta, "example_id", "turn").drop("turn")


def _keys_and_store(spark, d):
    """Prompt keys of the whole grid, and stored replies: the responses answered the zero-shot document prompts of
    their ids. Texts are hashed part by part; no prompt is built."""
    parts = pr.prompt_parts(tb.examples_with_tables(spark, d))
    keys = pr.grid_keys(parts, MODEL, k=1, seed=0)
    cell = pr.grid_keys(parts, MODEL, k=1, seed=0, reasoning_types=["documents"], prompt_types=["zero-shot"])
    replies = cell.join(tb.responses(spark, d).select("example_id", F.col("model_response").alias("reply")), "example_id")
    return keys, cp.reply_store(replies.select("prompt_key", "reply"))


@query("j11_completions_done")
def j11_completions_done(spark, d):
    done, _ = cp.lookup(*_keys_and_store(spark, d))
    return done.select("example_id", "reasoning_type", "prompt_type", "reply")


@query("j11_completions_pending")
def j11_completions_pending(spark, d):
    _, pending = cp.lookup(*_keys_and_store(spark, d))
    return pending.select("example_id", "reasoning_type", "prompt_type")


@query("e1_reply_fallback")
def e1_reply_fallback(spark, d):
    return cp.with_fallback(*_keys_and_store(spark, d)).select("example_id", "reasoning_type", "prompt_type", "reply")


def _pending_prompts(spark, d):
    _, pending = cp.lookup(*_keys_and_store(spark, d))
    return pr.prompts_for(tb.examples_with_tables(spark, d), pending, k=1, seed=0)


@query("z1_batch_scorer")
def z1_batch_scorer(spark, d):
    return cp.score_batches(_pending_prompts(spark, d))


@query("z1_failure_accounting")
def z1_failure_accounting(spark, d):
    """A scorer that refuses some prompts (whose length is a multiple of 7) and whole calls that hold one."""
    def picky(prompts):
        if any(len(p) % 7 == 0 for p in prompts):
            raise ValueError("refused")
        return prompts.str.len().astype(str)

    scored = cp.score_batches(_pending_prompts(spark, d), picky, accounts=True)
    return cp.scoring_summary(scored, "reasoning_type", "prompt_type").drop("n_retried")


@query("j8_skill_grid")
def j8_skill_grid(spark, d):
    skills = tb.table(spark, d, "benchmark").select("item_id", F.col("text").alias("description"))
    return pr.skill_grid(skills).select("item_id", "complexity_idx", "domain_idx", "prompt")


@query("j8_skill_groups")
def j8_skill_groups(spark, d):
    """Skills come in groups; every skill of every group meets every complexity and domain."""
    b = tb.table(spark, d, "benchmark")
    groups = b.groupBy((F.col("item_id") % 5).alias("skill_group")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"]).alias("skills"))
    skills = pr.expand_skill_groups(groups).select(
        (F.col("skill_group") + 5 * F.col("position")).alias("item_id"), "description")
    return pr.skill_grid(skills).select("item_id", "complexity_idx", "domain_idx", "prompt")


@query("j7_run_grid")
def j7_run_grid(spark, d):
    """The grid of runs with its model axis."""
    ex = _test(spark, d).select("example_id")
    return pr.run_grid(ex, models=tb.FIXTURE_MODELS)


@query("x8_verification_prompts")
def x8_verification_prompts(spark, d):
    """The generation workflow's prompts around every table, asked a benchmark question."""
    texts = tt.render_tables(tb.table_cells(spark, d, spread=True), "plain")
    b = tb.table(spark, d, "benchmark")
    n_items = b.agg(F.count("*")).scalar()
    t = texts.join(b.select("item_id", F.col("text").alias("question")), F.col("item_id") == F.col("table_id") % n_items)
    # four of the six prompts repeat the question: tables that are asked the same one lie together, so that files pack its text once a block
    t = t.sortWithinPartitions("item_id")
    t = t.withColumns({"answer": F.substring_index("question", " ", -1), "summary": F.concat(F.lit("order "), F.col("table_id").cast("string")),
                       "edits": F.concat(F.lit("edit_1: "), F.col("question")), "demonstration": F.lit("none"), "final_table": F.col("table")})
    return pr.verification_prompts(t, ["table_id"])


# ============================================================== oracle SQL
def q(s: str) -> str:
    return s.replace("'", "''")


H = "sha256(concat('{seed}', CAST({col} AS VARCHAR)))"
EXT = ("ext", f"SELECT e.*, t.t AS \"table\" FROM examples e LEFT JOIN (SELECT table_id, {INDEXED} AS t FROM table_rows "
              "GROUP BY table_id) t ON t.table_id = e.example_id")


def dense(src: str, key: str, seed, name: str) -> tuple[str, str]:
    return (name, f"SELECT {key}, row_number() OVER (ORDER BY {H.format(seed=seed, col=key)}, {key}) - 1 AS idx, "
                  f"count(*) OVER () AS n FROM ({src}) s")


def draw(k: int, seed) -> list[tuple[str, str]]:
    return [dense("SELECT example_id AS train_id FROM examples WHERE split = 'train'", "train_id", seed, "tr"),
            ("draw", f"""SELECT t.example_id, CAST(s.shot AS INTEGER) AS shot,
                 ((('0x' || substr({H.format(seed=seed, col='t.example_id')}, 1, 8))::BIGINT + s.shot)
                  % (SELECT count(*) FROM examples WHERE split = 'train')) AS idx
                 FROM examples t, (SELECT unnest(range(0, {k})) AS shot) s
                 WHERE t.split = 'test' AND s.shot < (SELECT count(*) FROM examples WHERE split = 'train')"""),
            ("shots", "SELECT d.example_id, d.shot, tr.train_id FROM draw d JOIN tr ON tr.idx = d.idx")]


ORACLE["w1_train_test_split"] = W("examples", extra=[dense("SELECT example_id FROM examples", "example_id", 0, "ix")]) + """
SELECT example_id, CASE WHEN idx < 1 THEN 'train' ELSE 'test' END AS split FROM ix"""
ORACLE["w2_seeded_sample"] = W("examples", extra=[dense(
    "SELECT example_id FROM examples WHERE split = 'test'", "example_id", 0, "ix")]) + """
SELECT example_id FROM ix WHERE idx < 50 AND n >= 50"""
ORACLE["w3_train_limit"] = W("examples", extra=[dense(
    "SELECT example_id FROM examples WHERE split = 'train'", "example_id", 1, "ix")]) + """
SELECT example_id FROM ix WHERE idx < 20 AND n >= 20"""
ORACLE["w4_few_shot_draw"] = W("examples", extra=draw(2, 0)) + "SELECT example_id, shot, train_id FROM shots"

NAMES = ["multi-hop", "temporal", "numeric", "information_aggregation", "soft_reasoning"]
NAME_VALUES = ", ".join(f"('{n}')" for n in NAMES)
ORACLE["w6_reasoning_types"] = W("table_rows", extra=[(
    "texts", f"SELECT table_id, {INDEXED} AS t FROM table_rows GROUP BY table_id"), (
    "nt", "SELECT table_id, t, 1 + (('0x' || substr(sha256(concat('0', t)), 1, 8))::BIGINT % 5) AS n FROM texts"), (
    "ranked", f"SELECT table_id, n, nm, row_number() OVER (PARTITION BY table_id ORDER BY sha256(concat(t, '0', nm))) AS r "
              f"FROM nt, (VALUES {NAME_VALUES}) v(nm)")]) + """
SELECT table_id, CAST(max(n) AS INTEGER) AS n_types,
       string_agg(CAST(r AS VARCHAR) || ') ' || nm, ', ' ORDER BY r) || '.' AS phrase
FROM ranked WHERE r <= n GROUP BY table_id"""

ORACLE["w8_last_n"] = W("examples") + """
SELECT example_id, question FROM examples WHERE split = 'test' ORDER BY example_id DESC LIMIT 25"""

RING = [dense("SELECT example_id FROM examples WHERE split = 'test'", "example_id", 12345, "ix"),
        ("ring", "SELECT a.example_id, b.example_id AS cand1_id, c.example_id AS cand2_id FROM ix a "
                 "JOIN ix b ON b.idx = (a.idx + 1) % a.n JOIN ix c ON c.idx = (a.idx + 2) % a.n")]
ORACLE["j9_ring_neighbours"] = W("examples", extra=RING) + "SELECT example_id, cand1_id, cand2_id FROM ring"
ORACLE["x10_comparison_prompt"] = W("examples", extra=RING) + f"""
SELECT r.example_id, '{q(COMPARE_INSTRUCTION)}' || chr(10)
       || 'Comparison 1 Context: ' || c1.documents || chr(10) || chr(10) || '''Comparison 1 Evaluation Question: ' || c1.question
       || chr(10) || 'Comparison 1 Context: ' || c2.documents || chr(10) || chr(10) || '''Comparison 1 Evaluation Question: ' || c2.question
       || chr(10) || 'Evaluation Context: ' || e.documents || chr(10) || chr(10) || '''Evaluation Question: ' || e.question
       || chr(10) || 'Now generate the relative scoring for the final context:' AS prompt
FROM ring r JOIN examples e ON e.example_id = r.example_id JOIN examples c1 ON c1.example_id = r.cand1_id
JOIN examples c2 ON c2.example_id = r.cand2_id"""

ORACLE["j10_refresh_subset"] = W("examples", extra=[dense("SELECT example_id FROM examples", "example_id", 0, "ix")]) + """
SELECT e.example_id, e.question, e.ground_truth FROM examples e JOIN ix ON ix.example_id = e.example_id
WHERE ix.idx < 50 AND ix.n >= 50"""

ORACLE["p7_content_ids"] = """
SELECT doc_id, substr(sha1(text), 1, 10) AS content_id, sha256(concat('0', text)) AS seed_hash FROM documents"""

ORACLE["p4_context_choice"] = W("examples", "table_rows", extra=[EXT]) + """
SELECT example_id, r.reasoning_type,
       length(CASE WHEN r.reasoning_type = 'table' THEN "table" ELSE documents END) AS context_chars
FROM ext, (VALUES ('documents'), ('table')) r(reasoning_type)"""

GRID = ", ".join(f"('{r}', '{p}')" for r in ["documents", "table"]
                 for p in ["zero-shot", "zero-shot-CoT", "few-shot", "few-shot-CoT"])
SHOT = ("'Context: ' || coalesce({ctx}, '') || chr(10) || 'Q: ' || x.question || chr(10) || 'A: ' || x.ground_truth "
        "|| chr(10)")
PROMPT_INPUTS = draw(1, 0) + [("sstr", f"""SELECT s.example_id,
        string_agg({SHOT.format(ctx='x.documents')}, '' ORDER BY s.shot) AS sd,
        string_agg({SHOT.format(ctx='x."table"')}, '' ORDER BY s.shot) AS st
        FROM shots s JOIN ext x ON x.example_id = s.train_id GROUP BY s.example_id"""), (
    "grid", f"""SELECT e.example_id, e.question, e.ground_truth, g.reasoning_type, g.prompt_type,
        coalesce(CASE WHEN g.reasoning_type = 'table' THEN e."table" ELSE e.documents END, '') AS context,
        CASE WHEN contains(g.prompt_type, 'few') THEN coalesce(CASE WHEN g.reasoning_type = 'table' THEN s.st
             ELSE s.sd END, '') ELSE '' END AS shots
        FROM ext e CROSS JOIN (VALUES {GRID}) g(reasoning_type, prompt_type)
        LEFT JOIN sstr s ON s.example_id = e.example_id WHERE e.split = 'test'"""), (
    "prompts", f"""SELECT example_id, reasoning_type, prompt_type, ground_truth,
        CASE WHEN contains(prompt_type, 'zero') THEN '{q(PROMPTS["zero-shot"])}' ELSE '{q(PROMPTS["few-shot"])}' END
        || chr(10) || shots || 'Context: ' || context || chr(10) || 'Q: ' || question || chr(10)
        || CASE WHEN contains(prompt_type, 'CoT') THEN '{q(COT)}' || chr(10) ELSE '' END || 'A:' AS prompt
        FROM grid""")]
PFIX = ("examples", "table_rows")
ORACLE["x1_text_prompts"] = W(*PFIX, extra=[EXT] + PROMPT_INPUTS) + """
SELECT example_id, reasoning_type, prompt_type, prompt FROM prompts"""

ORACLE["a9_token_totals"] = W(*PFIX, extra=[EXT] + PROMPT_INPUTS) + f"""
SELECT reasoning_type, prompt_type, count(*) AS n_prompts, CAST(sum({tokens('prompt')}) AS BIGINT) AS total_prompt_tokens,
       round(avg({tokens('prompt')}), 6) AS avg_prompt_tokens, max({tokens('prompt')}) AS max_prompt_tokens,
       CAST(sum({tokens('ground_truth')}) AS BIGINT) AS total_answer_tokens,
       round(sum({tokens('ground_truth')}) / count(*), 6) AS avg_answer_tokens,
       max({tokens('ground_truth')}) AS max_answer_tokens
FROM prompts GROUP BY reasoning_type, prompt_type"""

CHAT_SHOT = ("'human: Context: ' || coalesce({ctx}, '') || chr(10) || 'human: Q: ' || x.question || chr(10) "
             "|| 'human: A: ' || x.ground_truth")
ORACLE["x2_chat_prompts"] = W(*PFIX, extra=[EXT] + draw(1, 0) + [(
    "cshots", f"""SELECT s.example_id, count(*) AS k,
        string_agg({CHAT_SHOT.format(ctx='x.documents')}, chr(10) ORDER BY s.shot) AS sd,
        string_agg({CHAT_SHOT.format(ctx='x."table"')}, chr(10) ORDER BY s.shot) AS st
        FROM shots s JOIN ext x ON x.example_id = s.train_id GROUP BY s.example_id""")]) + f"""
SELECT e.example_id, g.reasoning_type, g.prompt_type,
       CAST(1 + CASE WHEN contains(g.prompt_type, 'zero') THEN 0 ELSE 3 * coalesce(c.k, 0) END + 2
            + CASE WHEN contains(g.prompt_type, 'CoT') THEN 2 ELSE 1 END AS INTEGER) AS n_messages,
       'system: ' || CASE WHEN contains(g.prompt_type, 'zero') THEN '{q(PROMPTS["zero-shot"])}'
                          ELSE '{q(PROMPTS["few-shot"])}' END || chr(10)
       || CASE WHEN contains(g.prompt_type, 'zero') OR c.k IS NULL THEN ''
               ELSE (CASE WHEN g.reasoning_type = 'table' THEN c.st ELSE c.sd END) || chr(10) END
       || 'human: Context: ' || coalesce(CASE WHEN g.reasoning_type = 'table' THEN e."table" ELSE e.documents END, '')
       || chr(10) || 'human: Q: ' || e.question || chr(10)
       || CASE WHEN contains(g.prompt_type, 'CoT') THEN 'human: {q(COT)}' || chr(10) ELSE '' END || 'human: A:' AS chat_text
FROM ext e CROSS JOIN (VALUES {GRID}) g(reasoning_type, prompt_type)
LEFT JOIN cshots c ON c.example_id = e.example_id WHERE e.split = 'test'"""

ORACLE["p5_provider_routing"] = f"""
SELECT model,
       CASE WHEN contains(model, 'gpt') THEN 'azure_openai' WHEN contains(model, 'claude') THEN 'anthropic'
            WHEN contains(model, 'gemini') THEN 'google' WHEN contains(model, 'llama') THEN 'replicate'
            WHEN contains(model, 'multiagent') THEN 'multiagent' END AS provider,
       CASE WHEN NOT (contains(model, 'gpt') OR contains(model, 'claude') OR contains(model, 'gemini')
                      OR contains(model, 'llama') OR contains(model, 'multiagent'))
            THEN 'Not a valid model.' END AS error
FROM (SELECT DISTINCT {MODEL_FAMILIES!r}[CAST(doc_id % {len(MODEL_FAMILIES)} + 1 AS INTEGER)] || '-' || source AS model FROM documents) m"""

_ROUTED = [("gpt", "azure_openai"), ("claude", "anthropic"), ("gemini", "google"), ("llama", "replicate"), ("multiagent", "multiagent")]
ORACLE["e4_isolated_cells"] = " UNION ALL ".join(
    f"SELECT '{f}' AS cell, source, '{next(p for s, p in _ROUTED if s in f)}' AS provider, count(*) AS n_docs, CAST(NULL AS VARCHAR) AS reason "
    "FROM documents WHERE doc_id IS NOT NULL GROUP BY source" if any(s in f for s, _ in _ROUTED) else
    f"SELECT '{f}', NULL, NULL, NULL, 'Not a valid model.'" for f in MODEL_FAMILIES)

ANSWERS = ("answers", """SELECT example_id, CASE WHEN contains(prompt_type, 'CoT') AND contains(model_response, 'ANSWER: ')
             THEN split_part(model_response, 'ANSWER: ', 2) ELSE model_response END AS predicted_answer FROM responses""")


def fill(template: str, **slots: str) -> str:
    out = f"'{q(template)}'"
    for k, v in slots.items():
        out = f"replace({out}, '{{{k}}}', {v})"
    return out


ORACLE["x9_judge_prompts"] = W("responses", "examples", extra=[ANSWERS]) + f"""
SELECT a.example_id,
       {fill(JUDGE_COMPRESS, question='e.question', predicted='a.predicted_answer')} AS compression_prompt,
       {fill(JUDGE_NORM, question='e.question', predicted='a.predicted_answer', correct='e.ground_truth')} AS norm_prompt,
       {fill(JUDGE_SCALAR, question='e.question', predicted='a.predicted_answer', correct='e.ground_truth')} AS scalar_prompt
FROM answers a JOIN examples e ON e.example_id = a.example_id"""

ORACLE["j5_evaluation_records"] = W("responses", "examples", "scored", extra=[ANSWERS]) + """
SELECT a.example_id, e.question, a.predicted_answer, e.ground_truth AS correct_answer, s.accuracy, s.em_accuracy,
       v.text AS gpt_eval
FROM answers a
JOIN (SELECT conv_id * 100 + turn AS example_id, text FROM conversations WHERE role = 'assistant') v
  ON v.example_id = a.example_id
JOIN (SELECT * FROM scored WHERE model = 'model_a' AND prompt_type = 'zero-shot' AND reasoning_type = 'documents') s
  ON s.example_id = a.example_id
JOIN examples e ON e.example_id = a.example_id"""

ORACLE["j4_outputs_by_key"] = W("examples") + """
SELECT o.example_id, o.model_response, e.question, e.ground_truth
FROM (SELECT conv_id AS example_id, arg_max(text, turn) AS model_response FROM conversations GROUP BY conv_id) o
JOIN examples e ON e.example_id = o.example_id"""

STORE = [("kp", "SELECT *, sha256('model_a' || chr(31) || prompt) AS prompt_key FROM prompts"),
         ("store", """SELECT k.prompt_key, max(r.model_response) AS reply FROM kp k JOIN responses r ON r.example_id = k.example_id
                     WHERE k.prompt_type = 'zero-shot' AND k.reasoning_type = 'documents' GROUP BY k.prompt_key""")]
SFIX = ("examples", "table_rows", "responses")
ORACLE["j11_completions_done"] = W(*SFIX, extra=[EXT] + PROMPT_INPUTS + STORE) + """
SELECT k.example_id, k.reasoning_type, k.prompt_type, s.reply FROM kp k JOIN store s ON s.prompt_key = k.prompt_key"""
ORACLE["j11_completions_pending"] = W(*SFIX, extra=[EXT] + PROMPT_INPUTS + STORE) + """
SELECT k.example_id, k.reasoning_type, k.prompt_type FROM kp k
WHERE k.prompt_key NOT IN (SELECT prompt_key FROM store)"""
ORACLE["e1_reply_fallback"] = W(*SFIX, extra=[EXT] + PROMPT_INPUTS + STORE) + """
SELECT k.example_id, k.reasoning_type, k.prompt_type, coalesce(s.reply, 'No Response') AS reply
FROM kp k LEFT JOIN store s ON s.prompt_key = k.prompt_key"""

CELLS = ", ".join(f"({ci}, '{q(c)}', {di}, '{q(dm)}')" for ci, c in enumerate(COMPLEXITY_LEVELS)
                  for di, dm in enumerate(DOMAINS))
ORACLE["j8_skill_grid"] = f"""
SELECT b.item_id, g.ci AS complexity_idx, g.di AS domain_idx,
       '{q(SKILL_PREAMBLE)}' || chr(10) || replace(replace(replace(replace(replace('{q(SKILL_INSTRUCTION)}',
       '{{{{', '{{'), '}}}}', '}}'), '{{skill}}', b.text), '{{complexity}}', g.c), '{{domain}}', g.d) AS prompt
FROM benchmark b CROSS JOIN (VALUES {CELLS}) g(ci, c, di, d)"""

# Z1 with the offline scorer: the reply quotes the prompt's question
ORACLE["z1_batch_scorer"] = W(*SFIX, extra=[EXT] + PROMPT_INPUTS + STORE) + """
SELECT k.example_id, k.reasoning_type, k.prompt_type,
       'ANSWER: ' || e.question AS reply
FROM kp k JOIN examples e ON e.example_id = k.example_id
WHERE k.prompt_key NOT IN (SELECT prompt_key FROM store)"""

ORACLE["z1_failure_accounting"] = W(*SFIX, extra=[EXT] + PROMPT_INPUTS + STORE) + """
SELECT reasoning_type, prompt_type, count(*) AS n_prompts, CAST(count(*) FILTER (WHERE length(prompt) % 7 = 0) AS BIGINT) AS n_lost,
       CASE WHEN count(*) FILTER (WHERE length(prompt) % 7 = 0) > 0 THEN 'ValueError: refused' END AS reason
FROM kp WHERE prompt_key NOT IN (SELECT prompt_key FROM store) GROUP BY reasoning_type, prompt_type"""

ORACLE["j8_skill_groups"] = ORACLE["j8_skill_grid"]
ORACLE["j7_run_grid"] = W("examples") + f"""
SELECT e.example_id, g.reasoning_type, g.prompt_type, m.model
FROM examples e CROSS JOIN (VALUES {GRID}) g(reasoning_type, prompt_type)
CROSS JOIN (VALUES ('model_a'), ('model_b'), ('model_c')) m(model) WHERE e.split = 'test'"""


def _slots(template: str, **slots: str) -> str:
    """A template with its braces unescaped and its slots replaced (no value here holds a slot)."""
    return fill(template.replace("{{", "{").replace("}}", "}"), **slots)


ORACLE["x8_verification_prompts"] = W("table_rows", extra=[("tq", f"""
  SELECT t.table_id, t.tab, b.text AS question, string_split(b.text, ' ')[-1] AS answer, 'order ' || CAST(t.table_id AS VARCHAR) AS summary
  FROM (SELECT table_id, '{PLAIN_HEAD}' || chr(10) || string_agg({PLAIN_ROW}, chr(10) ORDER BY row_idx) || chr(10) AS tab
        FROM table_rows GROUP BY table_id) t JOIN benchmark b ON b.item_id = t.table_id % (SELECT count(*) FROM benchmark)""")]) + f"""
SELECT table_id, {_slots(QUESTION_PROMPT, seed_table='tab')} AS question_prompt,
       {_slots(EDIT_PLAN_PROMPT, edit_demonstration="'none'", seed_table='tab', seed_table_summary='summary')} AS edit_plan_prompt,
       {_slots(EDIT_APPLICATION_PROMPT, edit_plan="'edit_1: ' || question", edit_number="'1'", edited_table='tab')} AS edit_application_prompt,
       {_slots(ANSWERABILITY_PROMPT, seed_table_summary='summary', seed_table='tab', actual_edits="'edit_1: ' || question",
               final_table='tab', final_question='question', final_answer='answer')} AS answerability_prompt,
       {_slots(CANDIDATE_ANSWERS_PROMPT, table='tab', question='question')} AS candidate_answers_prompt,
       {_slots(AMBIGUITY_PROMPT, question='question', solutions='answer')} AS ambiguity_prompt
FROM tq"""
