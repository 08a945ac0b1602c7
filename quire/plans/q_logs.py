"""Registered queries and oracles: logs, JSON, characteristics replies, conversations
(A7, A14, A15, P1, R5, R6, X11-X15, N1-N5, E2, E3, Z2, Z3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.constants import BAR_TABLE_SECTION, HTML_HEAD, JSON_FENCED_SECTIONS, LOG_FIELDS, TABLE_MARKDOWN_SECTIONS
from quire.functions.text import md_header_fix, parse_int
from quire.operators import characteristics as ch
from quire.operators import conversations as cv
from quire.operators import jsonops as js
from quire.operators import logs as lg
from quire.operators import reports as rp
from quire.plans.catalog import query
from quire.plans.fixture_sql import with_fixtures as W
from quire.plans.oracle import ORACLE
from quire.sources import tables as tb

# every log field, in log order, and the record column that fills it
REPORT_FIELDS = list(zip(LOG_FIELDS, [
    "question", "difficulty_json", "answer", "answer", "question", "answer", "difficulty_json", "validity_scalar",
    "difficulty_json", "question", "validity_scalar", "question", "answer", "difficulty_json", "documents",
    "answer", "answer", "table_score", "table_score", "answer", "answer", "document_score", "document_score",
    "example_id"], strict=True))
BAD_HEADER = "**DOCUMENT Reasoning Results -- GPTEval Prediction Evaluation **"
GOOD_HEADER = "**DOCUMENT Reasoning Results -- GPTEval Prediction Evaluation**"
ALLOWED_TURNS = {"system": ["user"], "user": ["assistant"], "assistant": ["user"]}


def _report(spark, d):
    logs = tb.generation_logs(spark, d)
    return logs.select("example_id", lg.report_text([(k, F.col(c)) for k, c in REPORT_FIELDS]).alias("report"))


@query("a14_report_text")
def a14_report_text(spark, d):
    return _report(spark, d)


@query("x11_header_fix")
def x11_header_fix(spark, d):
    return _report(spark, d).select("example_id", md_header_fix("report").alias("log_text"))


@query("x12_header_normalize")
def x12_header_normalize(spark, d):
    return _report(spark, d).select(
        "example_id", lg.normalize_header(md_header_fix("report"), BAD_HEADER, GOOD_HEADER).alias("log_text"))


@query("x13_json_fence")
def x13_json_fence(spark, d):
    t = lg.normalize_header(md_header_fix(F.col("report")), BAD_HEADER, GOOD_HEADER)
    return lg.fence_json(_report(spark, d).select("example_id", t.alias("log_text")), "log_text")


@query("x15_clean_logs")
def x15_clean_logs(spark, d):
    """The whole cleanup chain X11 -> X15 over reports of all fields."""
    return lg.clean_logs(_report(spark, d).select("example_id", F.col("report").alias("log_text")), "log_text")


@query("x14_delete_section")
def x14_delete_section(spark, d):
    return lg.delete_section(tb.log_text(spark, d).select("log_id", "log_text"), "log_text", "Generated Edits Rationale")


@query("x15_table_section_strip")
def x15_table_section_strip(spark, d):
    return lg.strip_table_colons(tb.log_text(spark, d).select("log_id", "log_text"), "log_text", "Existing Table Info")


@query("r6_log_sections")
def r6_log_sections(spark, d):
    return lg.sections(tb.log_text(spark, d))


@query("a15_html_report")
def a15_html_report(spark, d):
    items = lg.sections(tb.log_text(spark, d))
    return lg.html_report(items, "log_id", "section_idx", "section", "body")


@query("p1_log_to_example")
def p1_log_to_example(spark, d):
    ex = tb.generation_logs(spark, d).select(
        "example_id", "question", F.col("answer").alias("ground_truth"), "validity_scalar",
        F.from_json("difficulty_json", "map<string,int>").alias("characteristic_breakdown"))
    return ex.select("example_id", "question", "ground_truth", "validity_scalar",
                     F.explode("characteristic_breakdown").alias("characteristic", "score"))


@query("a7_generation_score_stats")
def a7_generation_score_stats(spark, d):
    logs = tb.generation_logs(spark, d).select(parse_int("document_score").alias("document_scores"),
                                               parse_int("table_score").alias("table_scores"))
    return rp.generation_score_stats(logs, {"document_scores": "document_scores", "table_scores": "table_scores"})


@query("n1_is_json")
def n1_is_json(spark, d):
    return tb.raw_json(spark, d).select("event_id", js.is_json("raw").alias("is_json"))


@query("n2_json_fields")
def n2_json_fields(spark, d):
    return js.extract_fields(tb.raw_json(spark, d), "raw", "k bigint", ["event_id"])


@query("n2_json_quarantine")
def n2_json_quarantine(spark, d):
    return js.quarantine(tb.raw_json(spark, d), "raw", ["event_id"])


@query("n5_pretty_json")
def n5_pretty_json(spark, d):
    r = tb.raw_json(spark, d)
    return r.where(js.is_json("raw")).select("event_id", js.pretty_json("raw").alias("pretty"))


@query("n3_reply_scores")
def n3_reply_scores(spark, d):
    replies = ch.render_replies(tb.characteristics(spark, d))
    return ch.map_to_scores(ch.parse_replies(replies))


@query("n4_map_roundtrip")
def n4_map_roundtrip(spark, d):
    return ch.map_to_scores(ch.scores_to_map(tb.characteristics(spark, d)))


@query("e3_final_answer")
def e3_final_answer(spark, d):
    return cv.final_answers(tb.messages(spark, d))


@query("z2_chat_text")
def z2_chat_text(spark, d):
    return cv.chat_text(tb.messages(spark, d))


@query("z3_transition_violations")
def z3_transition_violations(spark, d):
    return cv.transition_violations(tb.messages(spark, d), cv.edges_from_map(spark, ALLOWED_TURNS))


@query("r5_flatten_batches")
def r5_flatten_batches(spark, d):
    # each message is a batch of outputs, one per line, wrapped one level deeper
    c = tb.table(spark, d, "conversations").select("conv_id", "turn", F.array(F.split("text", "\n")).alias("batches"))
    return cv.flatten_batches(c, "batches", ["conv_id", "turn"])


# ============================================================== oracle SQL
NL = "chr(10)"
LOGS = ("logs", """
SELECT e.example_id, e.question, e.ground_truth AS answer, e.documents, m.difficulty_json, e.validity_scalar,
       s.document_score, s.table_score
FROM examples e
LEFT JOIN (SELECT example_id, '{' || string_agg('"' || characteristic || '":' || CAST(score AS VARCHAR), ','
                  ORDER BY characteristic) || '}' AS difficulty_json
           FROM characteristics GROUP BY example_id) m ON m.example_id = e.example_id
LEFT JOIN (SELECT example_id, max(CASE WHEN reasoning_type = 'documents' THEN judge_raw END) AS document_score,
                  max(CASE WHEN reasoning_type = 'table' THEN judge_raw END) AS table_score
           FROM evaluations WHERE model = 'model_a' AND prompt_type = 'zero-shot' GROUP BY example_id) s
  ON s.example_id = e.example_id""")


def _report_sql() -> str:
    parts = [f"'**{k}**' || {NL} || {NL} || coalesce(CAST({c} AS VARCHAR), '')" for k, c in REPORT_FIELDS]
    return f"concat_ws({NL}, {', '.join(parts)})"


REPORT = ("rep", f"SELECT example_id, {_report_sql()} AS report FROM logs")
FIXED = ("fixed", r"SELECT example_id, regexp_replace(report, '(\*\*.*?\*\*)\n', chr(10) || '\1', 'g') AS log_text FROM rep")
LOGFIX = ("evaluations", "examples", "characteristics")

ORACLE["a14_report_text"] = W(*LOGFIX, extra=[LOGS, REPORT]) + "SELECT example_id, report FROM rep"
ORACLE["x11_header_fix"] = W(*LOGFIX, extra=[LOGS, REPORT, FIXED]) + "SELECT example_id, log_text FROM fixed"
NORM = ("norm", f"SELECT example_id, replace(log_text, '{BAD_HEADER}', '{GOOD_HEADER}') AS log_text FROM fixed")
ORACLE["x12_header_normalize"] = W(*LOGFIX, extra=[LOGS, REPORT, FIXED, NORM]) + "SELECT example_id, log_text FROM norm"

def _section_steps(src: str, edits: list[tuple[str, str, str]]) -> tuple[list[tuple[str, str]], str]:
    """CTEs that edit one section after the other by positions: (name, kind, cte). A body runs from its
    header line to the nearest blank line before a known header, or to the end."""
    ctes = []
    for name, kind, cte in edits:
        head = f"'**{name}**' || {NL}"
        ends = ", ".join(f"nullif(strpos(rest, {NL} || {NL} || '**{n.strip()}**'), 0)" for n in LOG_FIELDS)
        cut = f"""(SELECT *, coalesce(least({ends}), length(rest) + 1) AS e FROM (
                   SELECT example_id, log_text, strpos(log_text, {head}) AS hs, length({head}) AS hl,
                          substr(log_text, strpos(log_text, {head}) + length({head})) AS rest FROM {src}) p)"""
        before, body, after = "substr(log_text, 1, hs + hl - 1)", "substr(rest, 1, e - 1)", "substr(rest, e)"
        new = {
            "fence": f"CASE WHEN substr({body}, 1, 1) IN ('{{', '[') THEN {before} || '```json' || {NL} || {body} || {NL} || '```' || {after} ELSE log_text END",
            "delete": "substr(log_text, 1, hs - 1) || substr(rest, e + 2)",
            "colons": f"{before} || {NL} || replace({body}, ':', '') || {after}",
        }[kind]
        ctes.append((cte, f"SELECT example_id, CASE WHEN hs = 0 THEN log_text ELSE {new} END AS log_text FROM {cut} c"))
        src = cte
    return ctes, src


_FENCES = [(n, "fence", f"fence{i}") for i, n in enumerate(JSON_FENCED_SECTIONS)]
_STEPS, _LAST = _section_steps("norm", _FENCES)
ORACLE["x13_json_fence"] = W(*LOGFIX, extra=[LOGS, REPORT, FIXED, NORM] + _STEPS) + f"SELECT example_id, log_text FROM {_LAST}"
_STEPS, _LAST = _section_steps("norm", _FENCES + [(BAR_TABLE_SECTION, "delete", "nobar")]
                               + [(n, "colons", f"colons{i}") for i, n in enumerate(TABLE_MARKDOWN_SECTIONS)])
ORACLE["x15_clean_logs"] = W(*LOGFIX, extra=[LOGS, REPORT, FIXED, NORM] + _STEPS) + f"SELECT example_id, log_text FROM {_LAST}"

ORACLE["x14_delete_section"] = W("log_text") + f"""
SELECT log_id, substr(log_text, 1, s - 1) || substr(log_text, s + strpos(substr(log_text, s), {NL} || {NL} || '**Resultant Generated Question**') + 1) AS log_text
FROM (SELECT log_id, log_text, strpos(log_text, '**Generated Edits Rationale**') AS s FROM log_text) x"""

ORACLE["x15_table_section_strip"] = W("log_text") + f"""
SELECT log_id, '**Existing Table Info**' || {NL} || {NL}
       || replace(substr(log_text, 25, strpos(log_text, {NL} || {NL} || '**Generated Edits Rationale**') - 25), ':', '')
       || substr(log_text, strpos(log_text, {NL} || {NL} || '**Generated Edits Rationale**')) AS log_text
FROM log_text"""

ORACLE["r6_log_sections"] = W("log_text") + r"""
SELECT log_id, CAST(i AS INTEGER) AS section_idx,
       regexp_extract(piece, '^\*\*([^\n]*?)\*\*\n', 1) AS section,
       substr(piece, strpos(piece, chr(10)) + 1) AS body
FROM (SELECT log_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT log_id, string_split(
        regexp_replace(log_text, '\n\n(\*\*(Generated Edits Rationale|Resultant Generated Question)\*\*\n)', chr(1) || '\1', 'g'),
        chr(1)) AS p FROM log_text) a) b"""

ORACLE["p1_log_to_example"] = W("examples", "characteristics") + """
SELECT e.example_id, e.question, e.ground_truth, e.validity_scalar, c.characteristic, c.score
FROM examples e JOIN characteristics c ON c.example_id = e.example_id"""

ORACLE["a7_generation_score_stats"] = W(*LOGFIX, extra=[LOGS]) + r"""
SELECT kind, round(avg(score), 6) AS mean, min(score) AS min, max(score) AS max,
       round(stddev_samp(score), 6) AS stdev, count(*) AS n
FROM (SELECT 'document_scores' AS kind, CASE WHEN regexp_matches(document_score, '^\s*[+-]?[0-9]+\s*$')
             THEN TRY_CAST(trim(document_score) AS BIGINT) END AS score FROM logs
      UNION ALL
      SELECT 'table_scores', CASE WHEN regexp_matches(table_score, '^\s*[+-]?[0-9]+\s*$')
             THEN TRY_CAST(trim(table_score) AS BIGINT) END FROM logs) x
WHERE score IS NOT NULL GROUP BY kind"""

ORACLE["n1_is_json"] = W("raw_json") + "SELECT event_id, json_valid(raw) AS is_json FROM raw_json"
ORACLE["n2_json_fields"] = W("raw_json") + """
SELECT event_id, CAST(json_extract(raw, '$.k') AS BIGINT) AS k FROM raw_json WHERE json_valid(raw)"""
ORACLE["n2_json_quarantine"] = W("raw_json") + """
SELECT event_id, raw, 'malformed json' AS reason FROM raw_json WHERE NOT json_valid(raw)"""
ORACLE["n3_reply_scores"] = W("characteristics") + "SELECT example_id, characteristic, score FROM characteristics"
ORACLE["n4_map_roundtrip"] = ORACLE["n3_reply_scores"]

ORACLE["e3_final_answer"] = W("messages") + """
SELECT c.conv_id, coalesce(a.answer, 'I don''t know how to answer this question') AS answer
FROM (SELECT DISTINCT conv_id FROM messages) c
LEFT JOIN (SELECT conv_id, arg_max(text, turn) AS answer FROM messages WHERE text <> 'TERMINATE'
           GROUP BY conv_id) a ON a.conv_id = c.conv_id"""
ORACLE["z2_chat_text"] = W("messages") + f"SELECT conv_id, string_agg(text, {NL} ORDER BY turn) AS chat FROM messages GROUP BY conv_id"
ORACLE["z3_transition_violations"] = W("messages") + """
SELECT conv_id, turn, src, dst
FROM (SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS src, role AS dst
      FROM messages) t
WHERE src IS NOT NULL
  AND (src, dst) NOT IN (SELECT * FROM (VALUES ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) e(s, d))"""
ORACLE["r5_flatten_batches"] = """
SELECT conv_id, turn, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS position,
       unnest(string_split(text, chr(10))) AS value
FROM conversations"""

# Sections as in the R6 oracle, each escaped (JSON bodies inside <pre>), joined in section order
_HTML_HEAD_SQL = HTML_HEAD.replace("'", "''")


# the JSON bodies of the log fixture are {"lang": "<code>"}: their four-space pretty form
PRETTY_LANG = """('{' || chr(10) || '    "lang": ' || to_json(json_extract_string(body, '$.lang')) || chr(10) || '}')"""


def _esc(x: str) -> str:
    return (f"replace(replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
            f"'\"', '&quot;'), '''', '&#x27;'), chr(10), '<br>')")


ORACLE["a15_html_report"] = W("log_text", extra=[("secs", r"""
SELECT log_id, i, regexp_extract(piece, '^\*\*([^\n]*?)\*\*\n', 1) AS section,
       substr(piece, strpos(piece, chr(10)) + 1) AS body
FROM (SELECT log_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT log_id, string_split(
        regexp_replace(log_text, '\n\n(\*\*(Generated Edits Rationale|Resultant Generated Question)\*\*\n)', chr(1) || '\1', 'g'),
        chr(1)) AS p FROM log_text) a) b""")]) + f"""
SELECT log_id, '{_HTML_HEAD_SQL}' || string_agg('<div><strong>' || section || '</strong><p>'
       || CASE WHEN json_valid(body) THEN '<pre>' || {_esc(PRETTY_LANG)} || '</pre>' ELSE {_esc('body')} END
       || '</p></div>', '' ORDER BY i) || '</body></html>' AS html
FROM secs GROUP BY log_id"""

ORACLE["n5_pretty_json"] = W("raw_json") + """
SELECT event_id, '{' || chr(10) || '    "k": ' || CAST(CAST(json_extract(raw, '$.k') AS BIGINT) AS VARCHAR) || chr(10) || '}' AS pretty
FROM raw_json WHERE json_valid(raw)"""
