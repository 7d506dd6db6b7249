"""SQL twins of the registered queries, where SQL can express them.

The others learn a model, choose one of many right answers, or follow a tokenizer or hash that SQL lacks; tests hold
those against brute force, the libraries or held-out labels.
"""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least AS (SELECT h, min(doc_id) AS owner FROM windows GROUP BY h),
repeats AS (SELECT doc_id, i FROM windows JOIN least USING (h) WHERE owner < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM repeats CROSS JOIN range(0, 50) t(k)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS txt FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(removed.n, 0) AS n_removed, sha256(coalesce(kept.txt, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)"""

JACCARD = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
arcs AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
walk(node, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT a.v, w.root FROM walk w JOIN arcs a ON a.u = w.node)
SELECT doc_id, coalesce(sizes.n, 0) AS n_shingles, component_id
FROM d JOIN (SELECT node AS doc_id, min(root) AS component_id FROM walk GROUP BY node) USING (doc_id) LEFT JOIN sizes USING (doc_id)"""


HARD_NEGATIVES = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS s
  FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, s AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, s AS negative_score
FROM pos JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * s AND 100 * s <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, vec_id) <= 10"""

#: The cheapest edits by one step per row over the best (cost, audit) of each state; at most two inserted rows in a row are ever useful.
CONVERSATIONS = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
hashed AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(
    [CAST(('0x' || substr(hex(k), 2 * i - 1, 2)) AS BIGINT) FOR i IN range(1, octet_length(k) + 1)],
    lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)),
    CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS h FROM keyed),
spoiled AS (
  SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE h WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE h <> 0),
placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p FROM spoiled),
judged AS (
  SELECT *, substr(role, 1, 1) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS again FROM placed),
faults AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN again THEN 'd' WHEN substr(body, length(body), 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS f,
    lag(i) OVER (PARTITION BY conv_id ORDER BY p) AS before FROM judged),
figures AS (
  SELECT conv_id, max(p) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank,
    count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
hops(s0, s1, c, e, line) AS (
  VALUES (0, 0, 0, '', CAST([] AS VARCHAR[])), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
    (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:']),
    (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:']), (2, 2, 4, 'II', ['assistant:', 'user:']), (3, 3, 4, 'II', ['user:', 'assistant:'])),
steps(s1, s2, i, c, e) AS (
  VALUES (0, 0, NULL, 3, 'D'), (1, 1, NULL, 3, 'D'), (2, 2, NULL, 3, 'D'), (3, 3, NULL, 3, 'D'),
    (0, 2, NULL, 2, 'R'), (1, 2, NULL, 2, 'R'), (2, 3, NULL, 2, 'R'), (3, 2, NULL, 2, 'R'),
    (0, 1, 's', 0, 'K'), (0, 2, 'u', 0, 'K'), (1, 2, 'u', 0, 'K'), (2, 3, 'a', 0, 'K'), (3, 2, 'u', 0, 'K')),
walk(conv_id, p, s, best) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, {'c': 0, 'a': '', 'l': CAST([] AS VARCHAR[])} FROM figures
  UNION ALL
  SELECT w.conv_id, f.p, t.s2, min({'c': w.best.c + h.c + t.c + CAST(f.f = 't' AND t.e <> 'D' AS INTEGER), 'a': w.best.a || h.e || t.e,
    'l': w.best.l || h.line || CASE t.e WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text]
      ELSE [CASE t.s2 WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || f.text] END})
  FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.p = w.p + 1 JOIN hops h ON h.s0 = w.s
    JOIN steps t ON t.s1 = h.s1 AND (t.i IS NULL OR t.i = f.i) AND (t.e = 'D' OR f.f NOT IN ('b', 'd'))
  GROUP BY w.conv_id, f.p, t.s2),
ends AS (
  SELECT w.conv_id, min({'c': w.best.c + h.c, 'a': w.best.a || h.e, 'l': w.best.l || h.line}) AS best
  FROM walk w JOIN figures g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.n = w.p JOIN hops h ON h.s0 = w.s AND h.s1 IN (0, 3) GROUP BY w.conv_id)
SELECT c.conv_id, coalesce(g.gaps, 0) AS gaps, coalesce(g.blank, 0) AS blank, coalesce(g.duplicate, 0) AS duplicate, coalesce(g.truncated, 0) AS truncated,
  coalesce(g.illegal, 0) AS illegal, CAST(coalesce(e.best.c, 0) AS BIGINT) AS cost, coalesce(e.best.a, '') AS audit,
  sha256(coalesce(array_to_string(e.best.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN figures g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


def oracle() -> dict[str, str]:
    return {"op1_substring_dedup": SUBSTRING_DEDUP, "op7_jaccard": JACCARD, "op11_hard_negatives": HARD_NEGATIVES, "op13_conversations": CONVERSATIONS}
