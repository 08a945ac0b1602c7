"""Registered queries and oracles: tables <-> text and text functions
(F3, F4, R1-R4, W5, W7, A10, A12, X3, X5, X6, X16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.constants import CONTEXTUAL_OUTLINE
from quire.functions import text as tx
from quire.functions import words as wd
from quire.operators import tables as tt
from quire.plans.catalog import query
from quire.plans.fixture_sql import with_fixtures as W
from quire.plans.oracle import ORACLE
from quire.sources import tables as tb


@query("f3_table_size_gate")
def f3_table_size_gate(spark, d):
    return tt.size_gate(tb.table_cells(spark, d))


@query("f4_letter_columns")
def f4_letter_columns(spark, d):
    return tt.letter_columns(tb.table_cells(spark, d))


@query("r1_plain_text")
def r1_plain_text(spark, d):
    return tt.render_tables(tb.table_cells(spark, d), "plain").withColumnRenamed("table", "table_text")


@query("r1_indexed_text")
def r1_indexed_text(spark, d):
    return tt.render_tables(tb.table_cells(spark, d), "indexed").withColumnRenamed("table", "table_text")


def _long_tables(spark, d):
    """One table per ship flag: a third of all rows and more in one table."""
    r = tb.table_cells(spark, d)
    return r.select(F.element_at("cells", 5).alias("table_id"), F.concat_ws("-", F.lpad("table_id", 12, "0"), F.lpad("row_idx", 6, "0")).alias("row_idx"), "header", "cells")


@query("r1_large_tables")
def r1_large_tables(spark, d):
    """Tables of hundreds of thousands of rows, numbered and rendered by ranges; digests of the texts."""
    lines = tt.table_lines(_long_tables(spark, d), chunk_bytes=1 << 20)
    out = [tt.digest_large_tables(lines, m).select("table_id", F.lit(m).alias("mode"), "chars", "text_sha256")
           for m in ("plain", "indexed")]
    return out[0].unionByName(out[1])


@query("r1_markdown_text")
def r1_markdown_text(spark, d):
    return tt.render_tables(tb.table_cells(spark, d), "markdown").withColumnRenamed("table", "table_text")


@query("r2_parse_roundtrip")
def r2_parse_roundtrip(spark, d):
    texts = tt.render_tables(tb.table_cells(spark, d), "indexed")
    return tt.to_long(tt.parse_tables(texts, "table"))


@query("r3_markdown_roundtrip")
def r3_markdown_roundtrip(spark, d):
    texts = tt.render_tables(tb.table_cells(spark, d), "markdown")
    return tt.to_long(tt.parse_markdown_tables(texts, "table"))


@query("r4_document_prompts")
def r4_document_prompts(spark, d):
    texts = tt.render_tables(tb.table_cells(spark, d), "indexed")
    return tt.document_prompts(texts, CONTEXTUAL_OUTLINE,
                               description=F.concat(F.lit("order "), F.col("table_id").cast("string")))


@query("w5_seeded_shuffle")
def w5_seeded_shuffle(spark, d):
    return tt.shuffle_positions(tb.table_cells(spark, d))


@query("a12_document_sets")
def a12_document_sets(spark, d):
    return tt.table_examples(tb.table_cells(spark, d)).select("table_id", "documents")


@query("a12_shuffled_document_sets")
def a12_shuffled_document_sets(spark, d):
    return tt.table_examples(tb.table_cells(spark, d), shuffle=True).select("table_id", "documents")


@query("a10_table_profile")
def a10_table_profile(spark, d):
    return tt.table_profile(tt.table_examples(tb.table_cells(spark, d)))


@query("x3_token_estimate")
def x3_token_estimate(spark, d):
    return tb.table(spark, d, "documents").select(
        "doc_id", tx.token_count("text").cast("bigint").alias("n_tokens"))


@query("x4_word_tokens")
def x4_word_tokens(spark, d):
    w = tb.table(spark, d, "documents").select("doc_id", wd.word_tokens("text").alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.sha2(F.array_join("w", " "), 256).alias("tokens_sha256"))


@query("x4_answer_totals")
def x4_answer_totals(spark, d):
    """Word tokens of the test answers: total, mean and largest, as the token report prints them."""
    a = tb.examples(spark, d).where("split = 'test'").select(wd.word_count("ground_truth").cast("bigint").alias("n"))
    return a.agg(F.sum("n").alias("total_tokens"), F.round(F.avg("n"), 6).alias("avg_tokens"), F.max("n").alias("max_tokens"))


@query("x5_answer_extraction")
def x5_answer_extraction(spark, d):
    r = tb.responses(spark, d)
    rationale, answer = tx.answer_parts("model_response", "prompt_type")
    return r.select("example_id", "prompt_type", rationale.alias("rationale"), answer.alias("predicted_answer"))


@query("x6_generated_text_cleanup")
def x6_generated_text_cleanup(spark, d):
    return tb.responses(spark, d).select("example_id", tx.after_last("model_response", "A:").alias("cleaned"))


@query("x16_html_escape")
def x16_html_escape(spark, d):
    return tb.table(spark, d, "documents").select("doc_id", tx.html_escape("text").alias("html"))


# ============================================================== oracle SQL
COLS = ["part", "supplier", "quantity", "price", "flag", "shipped"]
# white space as Unicode text has it, stated for the oracle's regex engine
BLANK = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN_RE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + BLANK + "]"


def tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{TOKEN_RE}'))"


ROWDOC = " || '; ' || ".join(f"'{c}: ' || {c}" for c in COLS)
INDEXED = ("'|index|" + "|".join(COLS) + "|' || chr(10) || string_agg('|' || CAST(row_idx AS VARCHAR) || '|' || "
           + " || '|' || ".join(COLS) + " || '|', chr(10) ORDER BY row_idx)")
HASH = "sha256(concat('123', CAST(table_id AS VARCHAR), CAST(row_idx AS VARCHAR)))"
DOCSET = "string_agg('Document ' || CAST(pos AS VARCHAR) || ': ' || doc, chr(10) || chr(10) ORDER BY pos)"
ROWS = ("shuf", f"SELECT table_id, row_idx, row_idx AS pos, {ROWDOC} AS doc FROM table_rows")
SHUF = ("shuf", f"SELECT table_id, row_idx, row_number() OVER (PARTITION BY table_id ORDER BY {HASH}, row_idx) "
                f"AS pos, {ROWDOC} AS doc FROM table_rows")

ORACLE["f3_table_size_gate"] = W("table_rows") + """
SELECT table_id, count(*) AS n_rows, CAST(6 AS BIGINT) AS n_cols, count(*) <= 11 AND 6 <= 7 AS accepted,
       CASE WHEN count(*) > 11 THEN 'rows ' || CAST(count(*) AS VARCHAR) || ' > 11' END AS reason
FROM table_rows GROUP BY table_id"""

ALPHA = " + ".join(f"(CASE WHEN bool_or(coalesce(regexp_matches({c}, '[A-Za-z]'), false)) THEN 1 ELSE 0 END)"
                   for c in COLS)
ORACLE["f4_letter_columns"] = W("table_rows") + f"""
SELECT table_id, n_alpha_cols, n_alpha_cols >= 2 AS passes
FROM (SELECT table_id, CAST({ALPHA} AS INTEGER) AS n_alpha_cols FROM table_rows GROUP BY table_id) x"""

PLAIN_HEAD = "|".join(COLS)
PLAIN_ROW = " || '|' || ".join(COLS)
ORACLE["r1_plain_text"] = W("table_rows") + f"""
SELECT table_id, '{PLAIN_HEAD}' || chr(10) || string_agg({PLAIN_ROW}, chr(10) ORDER BY row_idx) || chr(10) AS table_text
FROM table_rows GROUP BY table_id"""

ORACLE["r1_indexed_text"] = W("table_rows") + f"""
SELECT table_id, {INDEXED} AS table_text FROM table_rows GROUP BY table_id"""

ORACLE["r1_large_tables"] = W("table_rows", extra=[("lt", f"""
  SELECT flag, chr(10) || string_agg({PLAIN_ROW}, chr(10) ORDER BY k) || chr(10) AS plain,
         string_agg(chr(10) || '|' || CAST(n AS VARCHAR) || '|' || {PLAIN_ROW} || '|', '' ORDER BY k) AS indexed
  FROM (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY k) AS n FROM (
    SELECT *, lpad(CAST(table_id AS VARCHAR), 12, '0') || '-' || lpad(CAST(row_idx AS VARCHAR), 6, '0') AS k FROM table_rows))
  GROUP BY flag"""), ("lx", f"""
  SELECT flag AS table_id, 'plain' AS mode, '{PLAIN_HEAD}' || plain AS t FROM lt
  UNION ALL SELECT flag, 'indexed', '|index|{PLAIN_HEAD}|' || indexed FROM lt""")]) + """
SELECT table_id, mode, length(t) AS chars, sha256(t) AS text_sha256 FROM lx"""

# number columns (the index too) to the right, the others to the left; a width is the name's and two at least
_MD = [("''", "CAST(row_idx - 1 AS VARCHAR)", True)] + [(f"'{c}'", c, c not in ("flag", "shipped")) for c in COLS]
_WIDTHS = ", ".join(f"greatest(length({h}) + 2, max(length({x}))) AS w{i}" for i, (h, x, _) in enumerate(_MD))
_PAD = lambda x, i, right: f"{'lpad' if right else 'rpad'}({x}, CAST(w{i} AS INTEGER), ' ')"
_MD_LINE = lambda of: "'| ' || " + " || ' | ' || ".join(_PAD(of(h, x), i, r) for i, (h, x, r) in enumerate(_MD)) + " || ' |'"
_MD_RULER = "'|' || " + " || '|' || ".join(
    f"repeat('-', CAST(w{i} AS INTEGER) + 1) || ':'" if r else f"':' || repeat('-', CAST(w{i} AS INTEGER) + 1)" for i, (_, _, r) in enumerate(_MD)) + " || '|'"
ORACLE["r1_markdown_text"] = W("table_rows", extra=[("wd", f"SELECT table_id, {_WIDTHS} FROM table_rows GROUP BY table_id")]) + f"""
SELECT table_id, any_value({_MD_LINE(lambda h, x: h)}) || chr(10) || any_value({_MD_RULER}) || chr(10)
       || string_agg({_MD_LINE(lambda h, x: x)}, chr(10) ORDER BY row_idx) AS table_text
FROM table_rows JOIN wd USING (table_id) GROUP BY table_id"""

LONG = " UNION ALL ".join(
    ["SELECT table_id, row_idx, 1 AS col_idx, 'index' AS column_name, CAST(row_idx AS VARCHAR) AS value FROM table_rows"]
    + [f"SELECT table_id, row_idx, {i + 2}, '{c}', {c} FROM table_rows" for i, c in enumerate(COLS)])
ORACLE["r2_parse_roundtrip"] = W("table_rows") + LONG

LONG_MD = " UNION ALL ".join(
    ["SELECT table_id, row_idx, 1 AS col_idx, '' AS column_name, CAST(row_idx - 1 AS VARCHAR) AS value FROM table_rows"]
    + [f"SELECT table_id, row_idx, {i + 2}, '{c}', {c} FROM table_rows" for i, c in enumerate(COLS)])
ORACLE["r3_markdown_roundtrip"] = W("table_rows") + LONG_MD

OUTLINE_SQL = CONTEXTUAL_OUTLINE.replace("'", "''")
FAN = ("fan", "SELECT table_id, t, CAST(r.doc_row AS INTEGER) AS doc_row, "
              "CAST(1 + (('0x' || substr(sha256(concat('123', t, CAST(r.doc_row AS VARCHAR))), 1, 8))::BIGINT % 5) "
              "AS INTEGER) AS doc_len FROM texts, LATERAL (SELECT unnest(range(1, n + 1)) AS doc_row) r")
TEXTS = ("texts", f"SELECT table_id, count(*) AS n, {INDEXED} AS t FROM table_rows GROUP BY table_id")
ORACLE["r4_document_prompts"] = W("table_rows", extra=[TEXTS, FAN]) + f"""
SELECT table_id, doc_row, doc_len,
       replace(replace(replace(replace(replace(replace('{OUTLINE_SQL}', '{{table}}', t),
               '{{doc_row}}', CAST(doc_row AS VARCHAR)), '{{doc_len}}', CAST(doc_len AS VARCHAR)),
               '{{description}}', 'order ' || CAST(table_id AS VARCHAR)), '{{question}}', ''), '{{answer}}', '') AS prompt
FROM fan"""

ORACLE["w5_seeded_shuffle"] = W("table_rows") + f"""
SELECT table_id, CAST(row_number() OVER (PARTITION BY table_id ORDER BY {HASH}, row_idx) AS INTEGER) AS position,
       row_idx
FROM table_rows"""

ORACLE["a12_document_sets"] = W("table_rows", extra=[ROWS]) + f"""
SELECT table_id, {DOCSET} AS documents FROM shuf GROUP BY table_id"""
ORACLE["a12_shuffled_document_sets"] = W("table_rows", extra=[SHUF]) + f"""
SELECT table_id, {DOCSET} AS documents FROM shuf GROUP BY table_id"""

EX = ("ex", f"SELECT g.table_id, g.n, g.t, s.documents FROM (SELECT table_id, count(*) AS n, {INDEXED} AS t "
            f"FROM table_rows GROUP BY table_id) g JOIN (SELECT table_id, {DOCSET} AS documents FROM shuf "
            "GROUP BY table_id) s ON s.table_id = g.table_id")
ORACLE["a10_table_profile"] = W("table_rows", extra=[ROWS, EX]) + f"""
SELECT table_id, n AS num_rows, CAST(6 AS BIGINT) AS num_cols, {tokens('t')} AS num_tab_tokens,
       {tokens('documents')} AS num_doc_tokens, round({tokens('documents')} / n, 6) AS avg_doc_tokens,
       CAST(NULL AS VARCHAR) AS error
FROM ex"""

ORACLE["x3_token_estimate"] = f"SELECT doc_id, {tokens('text')} AS n_tokens FROM documents"

def words_sql(x: str) -> str:
    """The word rules in the oracle's regex engine: its own blank class, and ``\\1`` for a group."""
    for name, pattern, to in wd.RULES:
        if name == "one blank":
            pattern = f"[{BLANK}]+"
        for i in range(1, 10):
            to = to.replace(f"${i}", f"\\{i}")
        lit = lambda v: "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
        x = f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"
    return x


ORACLE["x4_word_tokens"] = f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array({words_sql('text')}, '[ \n]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, len(w) AS n_words, sha256(array_to_string(w, ' ')) AS tokens_sha256 FROM w"""
ORACLE["x4_answer_totals"] = W("examples") + f"""
SELECT CAST(sum(n) AS BIGINT) AS total_tokens, round(avg(n), 6) AS avg_tokens, max(n) AS max_tokens
FROM (SELECT len(list_filter(regexp_split_to_array({words_sql('ground_truth')}, '[ \n]+'), lambda x: x <> '')) AS n
      FROM examples WHERE split = 'test') a"""

ORACLE["x5_answer_extraction"] = W("responses") + """
SELECT example_id, prompt_type,
       CASE WHEN contains(prompt_type, 'CoT') AND contains(model_response, 'ANSWER: ')
            THEN split_part(model_response, 'ANSWER: ', 1) END AS rationale,
       CASE WHEN contains(prompt_type, 'CoT') AND contains(model_response, 'ANSWER: ')
            THEN split_part(model_response, 'ANSWER: ', 2) ELSE model_response END AS predicted_answer
FROM responses"""

ORACLE["x6_generated_text_cleanup"] = W("responses") + r"""
SELECT example_id, regexp_replace(string_split(model_response, 'A:')[-1], '^\s+|\s+$', '', 'g') AS cleaned
FROM responses"""

ORACLE["x16_html_escape"] = """
SELECT doc_id, replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
       '"', '&quot;'), '''', '&#x27;'), chr(10), '<br>') AS html
FROM documents"""


@query("a12_generated_document_sets")
def a12_generated_document_sets(spark, d):
    """Document sets written row by row through the batch writer (offline stand-in)."""
    from quire.operators.documents import generate_document_sets

    texts = tt.render_tables(tb.table_cells(spark, d), "indexed")
    return generate_document_sets(texts, description=F.concat(F.lit("order "), F.col("table_id").cast("string")))


ORACLE["a12_generated_document_sets"] = W("table_rows", extra=[TEXTS, (
    "rowdocs", """SELECT table_id, r.doc_row, split_part(t, chr(10), CAST(r.doc_row AS INTEGER) + 1) AS doc,
                  r.doc_row AS pos
                  FROM texts, LATERAL (SELECT unnest(range(1, n + 1)) AS doc_row) r""")]) + """
SELECT table_id, string_agg('Document ' || CAST(pos AS VARCHAR) || ': ' || doc, chr(10) || chr(10) ORDER BY pos) AS documents,
       count(*) AS n_documents, CAST(0 AS BIGINT) AS n_failed
FROM rowdocs GROUP BY table_id"""


@query("f8_example_table_profile")
def f8_example_table_profile(spark, d):
    """A10 over the examples themselves (their table text and documents); an example whose
    table is missing or does not parse keeps its row with ``error`` set (F8)."""
    ex = tb.examples_with_tables(spark, d).select(F.col("example_id"), "table", "documents")
    return tt.table_profile(ex, key="example_id")


ORACLE["f8_example_table_profile"] = W("examples", "table_rows", extra=[(
    "et", f"""SELECT e.example_id, e.documents, t.n, t.t FROM examples e
              LEFT JOIN (SELECT table_id, count(*) AS n, {INDEXED} AS t FROM table_rows GROUP BY table_id) t
              ON t.table_id = e.example_id""")]) + f"""
SELECT example_id, CASE WHEN t IS NOT NULL THEN n END AS num_rows,
       CASE WHEN t IS NOT NULL THEN CAST(6 AS BIGINT) END AS num_cols,
       CASE WHEN t IS NOT NULL THEN {tokens('t')} END AS num_tab_tokens,
       CASE WHEN t IS NOT NULL THEN {tokens('documents')} END AS num_doc_tokens,
       CASE WHEN t IS NOT NULL THEN round({tokens('documents')} / n, 6) END AS avg_doc_tokens,
       CASE WHEN t IS NULL THEN 'no table' END AS error
FROM et"""


@query("x8_table_summary_prompts")
def x8_table_summary_prompts(spark, d):
    """The table-summary prompt of every table, from its plain-text render."""
    from quire.constants import TABLE_SUMMARY_PROMPT

    texts = tt.render_tables(tb.table_cells(spark, d), "plain")
    return texts.select("table_id", tx.fill_template(TABLE_SUMMARY_PROMPT, seed_table=F.col("table")).alias("prompt"))


def _summary_sql() -> str:
    from quire.constants import TABLE_SUMMARY_PROMPT
    return TABLE_SUMMARY_PROMPT.replace("'", "''")


ORACLE["x8_table_summary_prompts"] = W("table_rows") + f"""
SELECT table_id, replace('{_summary_sql()}', '{{seed_table}}',
       '{PLAIN_HEAD}' || chr(10) || string_agg({PLAIN_ROW}, chr(10) ORDER BY row_idx) || chr(10)) AS prompt
FROM table_rows GROUP BY table_id"""
