"""SQL that says the same as a query, where SQL can."""

from __future__ import annotations

from .centroids import CLUSTERS, DIMS, ROUNDS, SCALE, SEED
from .chat import BODY, LEARNED, MARKS, OTHER_END, ROLE, ROLE_END
from .decontam import LONG, MASKS, PERCENT as LEAK_PERCENT, SHORT_MASK, SHORT_SPAN, SPAN, WINDOW as LEAK_WINDOW
from .licenses import LOWER, PERCENT as LICENSE_PERCENT, PHRASES, TEMPLATES, UPPER, template_tokens

WORD = r"[^\x20\x09-\x0D]+"

SUBSTRING = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
low AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN low USING (k), range(13) AS t(j) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone.p IS NULL) AS kept FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(root) FROM r WHERE r.doc_id = w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id)"""

_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PHRASES = ", ".join(f"('{label}', {phrase.split()})" for phrase, label in PHRASES)
_TEMPLATES = ", ".join(f"('{label}', {template_tokens(text)})" for label, text in TEMPLATES)

LICENSES = rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '{_TOKEN}') AS ws FROM d),
ph AS (SELECT * FROM (VALUES {_PHRASES}) AS v(label, p)),
places AS (SELECT doc_id, i - 1 AS i, label FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) JOIN ph ON ws[i] = p[1] WHERE ws[i:i + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
tp AS (SELECT * FROM (VALUES {_TEMPLATES}) AS v(label, tk)),
lines AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '{_TOKEN}')) AS tokens FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
hits AS (SELECT doc_id, label, len(list_intersect(tokens, tk)) / len(tk) AS c FROM lines, tp WHERE 100 * len(list_intersect(tokens, tk)) >= {LICENSE_PERCENT} * len(tk)),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS best FROM hits GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""



def _mask(number: int, mask: tuple[int, ...]) -> str:
    return f"concat_ws('|', {number}, " + ", ".join(f"coalesce(ws[i + {o}], '')" for o in mask) + ")"


def _seeds(kind: str, key: str, table: str) -> str:
    """Seeds of all masks at all positions; the short mask is for items of fewer than LONG words."""
    some = "" if kind == "d" else f" WHERE len(ws) < {LONG}"
    return f"""SELECT {key}, i, unnest([{", ".join(_mask(i, m) for i, m in enumerate(MASKS))}]) AS seed FROM (SELECT {key}, ws, unnest(range(1, len(ws) - {SPAN - 2})) AS i FROM {table})
    UNION ALL SELECT {key}, i, {_mask(len(MASKS), SHORT_MASK)} FROM (SELECT {key}, ws, unnest(range(1, len(ws) - {SHORT_SPAN - 2})) AS i FROM {table}{some})"""


LEAKS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS ws FROM documents),
b AS (SELECT item_id, ws FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS ws FROM benchmark) WHERE len(ws) >= {SPAN}),
ds AS ({_seeds("d", "doc_id", "d")}),
bs AS ({_seeds("b", "item_id", "b")}),
hit AS (SELECT DISTINCT doc_id, item_id, ds.i - bs.i AS shift FROM ds JOIN bs USING (seed)),
run AS (SELECT doc_id, item_id, shift, greatest(0, -shift) AS low, least(len(b.ws), len(d.ws) - shift) AS high, least({LEAK_WINDOW}, len(b.ws)) AS size, d.ws AS dw, b.ws AS bw FROM hit JOIN d USING (doc_id) JOIN b USING (item_id)),
eq AS (SELECT doc_id, item_id, shift, low, size, [CASE WHEN dw[k + shift + 1] = bw[k + 1] THEN 1 ELSE 0 END FOR k IN range(low, high)] AS e FROM run),
now AS (SELECT *, [list_sum(e[greatest(1, k - size + 1):k]) FOR k IN range(1, len(e) + 1)] AS nows FROM eq),
best AS (SELECT doc_id, item_id, shift, size, CAST(list_max(nows) AS BIGINT) AS n_equal, greatest(0, low + list_position(nows, list_max(nows)) - size) AS item_start FROM now),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, item_start, shift) AS rn FROM best WHERE 100 * n_equal >= {LEAK_PERCENT} * size)
SELECT doc_id, item_id, CAST(item_start + shift AS BIGINT) AS doc_start, CAST(item_start AS BIGINT) AS item_start, CAST(size AS BIGINT) AS n_window, n_equal, n_equal / size AS similarity FROM top WHERE rn = 1"""

def _rounds() -> str:
    """Rounds of assignment and new centroids, written out one after the other."""
    out = []
    for i in range(ROUNDS + 1):
        out.append(f"""d{i} AS (SELECT rn, c, list_sum([(q[j] - m[j]) * (q[j] - m[j]) FOR j IN range(1, {DIMS + 1})]) AS d FROM v, c{i}),
a{i} AS (SELECT rn, c, d FROM (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY d, c) AS k FROM d{i}) WHERE k = 1)""")
        if i < ROUNDS:
            out.append(f"""s{i} AS (SELECT c, j, sum(q[j]) AS s, count(*) AS n FROM a{i} JOIN v USING (rn), range(1, {DIMS + 1}) t(j) GROUP BY ALL),
n{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS m FROM s{i} GROUP BY c),
c{i + 1} AS (SELECT c{i}.c, coalesce(n{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN n{i} USING (c))""")
    return ",\n".join(out)


CENTROIDS = f"""
WITH v AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id, embedding) AS rn, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
    WHERE len(embedding) = {DIMS} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {DIMS}),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, q) - 1 AS INTEGER) AS c, q AS m FROM (SELECT q, sha256('{SEED}:' || vec_id) AS h FROM v) ORDER BY h, q LIMIT {CLUSTERS}),
{_rounds()},
i AS (SELECT c, CAST(sum(d) AS BIGINT) AS s FROM a{ROUNDS} GROUP BY c)
SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, s AS cluster_inertia, CAST((SELECT sum(s) FROM i) AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (rn) JOIN i USING (c) JOIN c{ROUNDS} USING (c)"""

_SAID = """t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, CAST(i AS BIGINT), CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i))"""
_ESCAPE = rf"'([<\[])(\\*{BODY})', '\1\\\2', 'g'"
_MARKS = "CASE role " + " ".join(f"WHEN '{r}' THEN {len(h) + len(t)}" for r, (h, t) in MARKS.items()) + f" ELSE {len(ROLE) + len(ROLE_END) + len(OTHER_END)} + length(regexp_replace(role, {_ESCAPE})) END"

CHAT = f"""
WITH {_SAID}
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{LEARNED}'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = '{LEARNED}'), '')) AS loss_sha256,
    CAST(sum(length(regexp_replace(text, {_ESCAPE})) + {_MARKS}) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS attachment_tokens
FROM t GROUP BY conv_id"""

ORACLES = {"op11_centroid_clustering": CENTROIDS, "op13_chat_format": CHAT, "op1_substring_dedup": SUBSTRING, "op4_jaccard_join": JACCARD, "op6_license_scan": LICENSES, "op10_decontamination": LEAKS}
