"""DuckDB SQL for the queries that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op1_decontaminate"] = r"""
WITH words AS MATERIALIZED (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark WHERE item_id IS NOT NULL),
grams AS MATERIALIZED (
  SELECT DISTINCT id AS item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM words WHERE side = 1 AND len(w) > 0)),
lens AS (SELECT DISTINCT n FROM grams),
slots AS (
  SELECT id AS doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lens WHERE side = 0 AND len(w) >= n)),
hits AS MATERIALIZED (SELECT s.doc_id, s.i, s.n, g.item_id FROM slots s JOIN grams g ON s.n = g.n AND s.g = g.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.id AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM words d LEFT JOIN covered c ON c.doc_id = d.id LEFT JOIN items t ON t.doc_id = d.id WHERE d.side = 0
"""

ORACLE["op8_mix_sources"] = r"""
WITH sized AS MATERIALIZED (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
keyed AS (SELECT *, CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(size AS VARCHAR)), 1, 15)
                    AS BIGINT) AS u FROM sized),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
               (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source),
caps AS (SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS k FROM src),
levels AS (
  SELECT k, cap, weight,
         (sum(cap) OVER () / 3 - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
lev AS (SELECT coalesce(min(level) FILTER (WHERE level * weight <= cap), 0) AS level FROM
        (SELECT * FROM levels WHERE level * weight <= cap ORDER BY k LIMIT 1)),
targets AS (SELECT source, source_size,
                   CASE WHEN level * weight > cap THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target FROM caps, lev),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS whole FROM targets),
rests AS (SELECT *, greatest(target - whole * source_size, 0.0) AS rest FROM parts),
classes AS (SELECT k.source, length(bin(k.size)) AS w, sum(k.size) AS words, any_value(r.rest) AS rest
            FROM keyed k JOIN rests r ON k.source IS NOT DISTINCT FROM r.source WHERE k.size > 0 GROUP BY k.source, w),
fills AS (SELECT source, w, greatest(rest - coalesce(sum(words) OVER (PARTITION BY source ORDER BY w DESC
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0.0)
                 / sum(w * words) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM classes),
level_c AS (SELECT source, arg_max(c, w) AS c FROM fills WHERE c * w <= 1 GROUP BY source),
likely AS (
  SELECT k.*, r.source_size, r.target, r.whole, r.rest,
         CASE WHEN k.size > 0 THEN least(1.0, coalesce(l.c, 0.0) * length(bin(k.size))) ELSE 0.0 END AS p,
         (CAST(k.u >> 8 AS DOUBLE) + 0.5) / 4503599627370496.0 AS x
  FROM keyed k JOIN rests r ON k.source IS NOT DISTINCT FROM r.source LEFT JOIN level_c l ON k.source IS NOT DISTINCT FROM l.source),
odds AS (SELECT *, CASE WHEN p >= 1 THEN 0.0 WHEN p > 0 THEN (x / (1 - x)) / (p / (1 - p)) END AS odds_ratio FROM likely),
runs AS (
  SELECT *, coalesce(sum(CASE WHEN size > 0 THEN size END) OVER (PARTITION BY source ORDER BY size = 0, odds_ratio, u, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM odds)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN rest > 0 AND p > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM runs
"""

ORACLE["op6_url_filter"] = r"""
WITH RECURSIVE p AS MATERIALIZED (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
found AS (
  SELECT rest AS a_rest, url, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'),
           '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS link FROM p WHERE url IS NOT NULL AND html IS NOT NULL
  UNION ALL
  SELECT rest, url, regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'),
           '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM p WHERE url IS NOT NULL AND html IS NOT NULL),
targets AS (
  SELECT a_rest, CASE WHEN strpos(link, '://') > 0 THEN substr(link, strpos(link, '://') + 3)
                      WHEN starts_with(link, '//') THEN substr(link, 3)
                      WHEN starts_with(link, '/') THEN regexp_extract(a_rest, '^[^/?#]*') || link END AS b_rest
  FROM found WHERE link <> ''),
urls AS (SELECT DISTINCT rest FROM (SELECT rest FROM p UNION ALL SELECT b_rest FROM targets) WHERE rest IS NOT NULL),
split AS MATERIALIZED (
  SELECT rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '(?s)^[^?#]*(\?[^#]*)?', 1) AS q FROM urls),
rules(r_host, r_path, r_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT rest, arg_min(r_host || r_path, length(r_host || r_path) * -1) AS rule, arg_min(r_verdict, length(r_host || r_path) * -1) AS verdict
  FROM split JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY rest),
nodes AS MATERIALIZED (SELECT rest, host, path, CASE WHEN host <> '' THEN host || path || q END AS node FROM split),
edges AS (SELECT a.node AS a, b.node AS b FROM targets t JOIN nodes a ON t.a_rest = a.rest JOIN nodes b ON t.b_rest = b.rest
          WHERE a.node IS NOT NULL AND b.node IS NOT NULL AND a.node <> b.node),
both_ways AS MATERIALIZED (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
said AS (SELECT r.node, max(CASE WHEN t.verdict = 'allow' THEN 1 ELSE 0 END) AS allowed
         FROM reach r JOIN nodes n ON r.other = n.node JOIN best t ON n.rest = t.rest GROUP BY r.node)
SELECT p.page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, t.rule,
       coalesce(t.verdict, CASE WHEN s.allowed = 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN nodes n ON p.rest = n.rest LEFT JOIN best t ON p.rest = t.rest LEFT JOIN said s ON n.node = s.node
"""

_SECRET_KINDS = [
    ("assign", 0, r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 6, True),
    ("access", 1, r"(AKIA[A-Z0-9]+)", 1, 20, True),
    ("hex", 2, r"([0-9a-f]+)", 1, 24, True),
    ("pem", 3, r"(-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----)", 1, 1, False),
    ("forge", 4, r"(\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}))", 1, 1, False),
]
ORACLE["op7_secret_scan"] = "WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),\nm AS (\n" + "\nUNION ALL\n".join(
    f"""  SELECT r, '{k}' AS kind, {o} AS o, {str(b).lower()} AS base, unnest(range(1, len(hits) + 2)) AS i,
         unnest(hits) AS hit, unnest(groups) AS grp, unnest(pieces) AS piece, {n} AS least
  FROM (SELECT r, regexp_extract_all(text, '{p}') AS hits, regexp_extract_all(text, '{p}', {g}) AS groups,
               string_split_regex(text, '{p.replace("(AKIA", "(?:AKIA").replace("([", "(?:[").replace("(-----", "(?:-----").replace("(" + chr(92) + "b", "(?:" + chr(92) + "b")}') AS pieces FROM d)"""
    for k, o, p, g, n, b in _SECRET_KINDS) + r"""),
s AS (SELECT r, kind, o, base, length(hit) AS n, length(grp) >= least AS ok,
             sum(length(piece) + length(hit)) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM m WHERE hit IS NOT NULL),
a AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
             count(*) FILTER (WHERE kind = 'hex') AS n_hex,
             string_agg(kind || ':' || CAST(e - n AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY e - n, o) FILTER (WHERE base) AS base_spans,
             string_agg(kind || ':' || CAST(e - n AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY e - n, o) AS spans
      FROM s WHERE ok GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)
"""

ORACLE["op2_substring_dedup"] = r"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (
  SELECT r, doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS g
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13 AND doc_id IS NOT NULL)),
low AS (SELECT g, min(doc_id) AS low FROM win GROUP BY g),
gone AS MATERIALIZED (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (g) WHERE doc_id > low)),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM w),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""

ORACLE["op11_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, h AS text_sha256 FROM t
"""

#: one assignment of all parts to the entries of {book}
_ASSIGNED = """SELECT r, p, x, best.k AS k, best.d AS d FROM (
  SELECT r, p, any_value(x) AS x, min({{'d': d, 'k': k}}) AS best FROM (
    SELECT a.r, a.p, a.x, b.k, CAST(list_sum(list_transform(list_zip(a.x, b.c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT) AS d
    FROM parts a JOIN {book} b USING (p)) GROUP BY r, p)"""
#: the codebooks of the members in {members}; entries without members stay as in {book}
_UPDATED = """SELECT p, k, coalesce(m.c, b.c) AS c FROM {book} b LEFT JOIN (
  SELECT p, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
    SELECT p, k, i, sum(v) AS s, count(*) AS n FROM (SELECT p, k, unnest(x) AS v, unnest(range(len(x))) AS i FROM {members}) GROUP BY p, k, i)
  GROUP BY p, k) m USING (p, k)"""
ORACLE["op13_vector_codes"] = r"""
WITH raw AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(greatest(least(floor(256 * CAST(x AS DOUBLE)), 536870912), -536870912) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(embedding) % 16 = 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
kept AS MATERIALIZED (SELECT * FROM raw WHERE len(v) = (SELECT n FROM (SELECT len(v) AS n, count(*) AS c FROM raw GROUP BY 1) ORDER BY c DESC, n LIMIT 1)),
parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS x FROM (SELECT r, v, unnest(range(16)) AS p FROM kept)),
seeds AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS k FROM kept QUALIFY k < 64),
b0 AS MATERIALIZED (SELECT p, k, x AS c FROM parts JOIN seeds USING (r)),
m0 AS MATERIALIZED (""" + _ASSIGNED.format(book="b0") + """),
b1 AS MATERIALIZED (""" + _UPDATED.format(book="b0", members="m0") + """),
m1 AS MATERIALIZED (""" + _ASSIGNED.format(book="b1") + """),
b2 AS MATERIALIZED (""" + _UPDATED.format(book="b1", members="m1") + """),
m2 AS MATERIALIZED (""" + _ASSIGNED.format(book="b2") + """),
codes AS MATERIALIZED (SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM m2 GROUP BY r),
sha AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, k, i)) AS codebooks_sha256
        FROM (SELECT p, k, unnest(c) AS v, unnest(range(len(c))) AS i FROM b2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN codes USING (r), sha
"""
