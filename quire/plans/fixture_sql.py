"""Fixture views as SQL common-table expressions, for the DuckDB oracle.

These restate the fixture definitions independently of the DataFrame code in
:mod:`quire.sources.tables`, so a mistake on either side shows up as a mismatch.
"""

FIXTURE_SQL = {
    "evaluations": """
SELECT d.doc_id AS example_id, m.model, p.prompt_type, r.reasoning_type,
       CASE WHEN (d.n_chars + d.doc_id * 3 + m.mi + p.pi * 2 + r.ri) % 19 = 0 THEN 'No Response'
            WHEN (d.n_chars + d.doc_id + m.mi * 3 + p.pi + r.ri) % 23 = 0 THEN ' 9.0'
            ELSE CAST((d.doc_id * 7 + d.n_chars + m.mi * 3 + p.pi * 5 + r.ri * 2) % 11 AS VARCHAR)
       END AS judge_raw
FROM documents d
CROSS JOIN (VALUES (0, 'model_a'), (1, 'model_b'), (2, 'model_c')) AS m(mi, model)
CROSS JOIN (VALUES (0, 'zero-shot'), (1, 'zero-shot-CoT'), (2, 'few-shot'), (3, 'few-shot-CoT')) AS p(pi, prompt_type)
CROSS JOIN (VALUES (0, 'documents'), (1, 'table')) AS r(ri, reasoning_type)
WHERE NOT (m.mi = 2 AND p.pi = 3)""",
    "scored": """
SELECT *, CASE WHEN accuracy IS NULL THEN NULL WHEN accuracy > 8 THEN 1 ELSE 0 END AS em_accuracy
FROM (SELECT *, CASE WHEN regexp_matches(judge_raw, '^\\s*[+-]?[0-9]+\\s*$')
                     THEN TRY_CAST(trim(judge_raw) AS BIGINT) END AS accuracy
      FROM evaluations) s""",
    "tracker": "SELECT doc_id AS example_id, quality AS table_validity FROM labels",
    "examples": """
SELECT d.doc_id AS example_id, b.text AS question, string_split(d.text, chr(10))[-1] AS ground_truth,
       d.text AS documents, d.n_chars % 6 AS validity_scalar, l.quality AS human_validity,
       CASE WHEN d.doc_id % 10 < 2 THEN 'train' ELSE 'test' END AS split
FROM documents d
JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "characteristics": """
SELECT d.doc_id AS example_id, c.characteristic,
       CAST((d.doc_id * (2 * c.ci + 3) + d.n_chars) % (2 + c.ci % 2) AS INTEGER) AS score
FROM documents d
CROSS JOIN (VALUES (0, 'multi-hop'), (1, 'temporal'), (2, 'numeric'), (3, 'information_aggregation'), (4, 'soft_reasoning')) AS c(ci, characteristic)
WHERE (d.n_chars + c.ci) % 29 <> 0""",
    "binned": """
SELECT ch.example_id, ch.characteristic, ch.score,
       CAST(CASE WHEN abs(k.n0 + k.n1 - k.n2) < abs(k.n1 + k.n2 - k.n0)
                 THEN (CASE WHEN ch.score < 2 THEN 0 ELSE 1 END)
                 ELSE (CASE WHEN ch.score > 0 THEN 1 ELSE 0 END) END AS INTEGER) AS level
FROM characteristics ch
JOIN (SELECT characteristic, count(*) FILTER (WHERE score = 0) AS n0,
             count(*) FILTER (WHERE score = 1) AS n1, count(*) FILTER (WHERE score = 2) AS n2
      FROM characteristics GROUP BY characteristic) k ON k.characteristic = ch.characteristic""",
    "responses": """
SELECT conv_id * 100 + turn AS example_id,
       CASE WHEN turn % 4 = 0 THEN 'zero-shot' WHEN turn % 4 = 1 THEN 'zero-shot-CoT'
            WHEN turn % 4 = 2 THEN 'few-shot' ELSE 'few-shot-CoT' END AS prompt_type,
       CASE WHEN turn % 3 = 2 THEN text
            WHEN turn % 5 = 3 THEN concat(text, 'ANSWER: ', string_split(text, chr(10))[1], 'ANSWER: ', 'again')
            ELSE concat('Q: x A: ', text, 'ANSWER: ', string_split(text, chr(10))[1]) END AS model_response
FROM conversations""",
    "messages": """
SELECT conv_id, turn, CASE WHEN conv_id % 4 = 1 AND turn % 4 = 1 THEN 'system' ELSE role END AS role,
       CASE WHEN conv_id % 7 = 3 OR (conv_id % 5 = 1 AND turn = max(turn) OVER (PARTITION BY conv_id)) THEN 'TERMINATE'
            ELSE text END AS text
FROM conversations""",
    "table_rows": """
SELECT l_orderkey AS table_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS row_idx,
       CAST(l_partkey AS VARCHAR) AS part, CAST(l_suppkey AS VARCHAR) AS supplier,
       CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS quantity,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS price,
       l_returnflag AS flag, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS shipped
FROM lineitem""",
    "raw_json": """
SELECT event_id, CASE WHEN event_id % 13 = 0 THEN substr(props, 1, 4) WHEN event_id % 17 = 0 THEN props || ', ' || props
                      WHEN event_id % 19 = 0 THEN replace(props, '"', '''') ELSE props END AS raw FROM events""",
    "log_text": """
SELECT doc_id AS log_id,
       concat('**Existing Table Info**\n', '|a:|b|\n\n**Totals:**\n|1|2|', '\n\n**Generated Edits Rationale**\n', '{"lang": "', lang, '"}',
              '\n\n**Resultant Generated Question**\n', text, '\n\n**a bold line**\nnot a section') AS log_text
FROM documents""",
}

# dependencies between fixture CTEs (emitted in this order)
FIXTURE_DEPS = {
    "scored": ["evaluations"],
    "binned": ["characteristics"],
}
FIXTURE_ORDER = ["evaluations", "scored", "tracker", "examples", "characteristics", "binned",
                 "responses", "messages", "table_rows", "raw_json", "log_text"]


#: expressions that several parts of an oracle read: computed once
SHARED = {"ext", "prompts", "kp", "store"}


def with_fixtures(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause holding the named fixtures (and their dependencies) plus extra CTEs."""
    need: set[str] = set()

    def add(n):
        if n in need:
            return
        for d in FIXTURE_DEPS.get(n, []):
            add(d)
        need.add(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({FIXTURE_SQL[n]}\n)" for n in FIXTURE_ORDER if n in need]
    ctes += [f"{n} AS {'MATERIALIZED ' if n in SHARED else ''}({sql}\n)" for n, sql in (extra or [])]
    return "WITH " + ",\n".join(ctes) + "\n" if ctes else ""
