"""SQL twins of the registered queries, written against the raw driver tables for DuckDB."""

from __future__ import annotations

from pagelake import constants as c
from pagelake.functions.text import BLANKS

PAT = r"[\p{L}\p{N}]+"
WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
TAGS = "('tag-quality','tag-toxic','tag-fr')"


def _strip(expr: str) -> str:
    chars = "||".join(f"chr({ord(ch)})" for ch in BLANKS)
    return f"trim({expr}, {chars})"


BASE = rf"""
docs AS (SELECT doc_id, text, lang, source, n_chars, CAST(substr(source, 4) AS INTEGER) AS pid FROM documents),
raw_pages AS (
  SELECT doc_id AS slide_id, 2 * pid + 2 AS version_id, doc_id + 1 AS page_no, doc_id, text AS native_text FROM docs
  UNION ALL
  SELECT -(2 * doc_id + 1), 2 * pid + 1, doc_id + 1 + CASE WHEN doc_id % 11 = 2 THEN 1000000000000 ELSE 0 END, doc_id,
         CASE WHEN doc_id % 9 = 1 THEN text || ' rev' ELSE text END
  FROM docs WHERE doc_id % 7 <> 0
  UNION ALL
  SELECT -(2 * item_id + 2), CAST(2 * (item_id % 20) + 1 AS INTEGER), 2000000000000 + item_id, item_id, text FROM benchmark),
slides AS (
  SELECT slide_id, version_id, page_no, doc_id, native_text, split_part(native_text, chr(10), 1) AS title,
         sha256(lower(regexp_replace(native_text, '{WS}', '', 'g'))) AS fingerprint
  FROM raw_pages),
lines AS (
  SELECT slide_id, version_id, n, line, contains(line, ' | ') AS is_row FROM (
    SELECT slide_id, version_id, unnest(string_split(native_text, chr(10))) AS line,
           unnest(range(1, len(string_split(native_text, chr(10))) + 1)) AS n FROM raw_pages)),
cells AS (
  SELECT slide_id, n, k, {_strip('cell')} AS cell FROM (
    SELECT slide_id, n, unnest(string_split(line, ' | ')) AS cell, unnest(range(1, len(string_split(line, ' | ')) + 1)) AS k
    FROM lines WHERE is_row)),
table_texts AS (
  SELECT slide_id, string_agg(cell, ' ' ORDER BY n, k) AS txt, count(*) AS n_cells FROM cells WHERE cell <> '' GROUP BY slide_id),
raw_elements AS (
  SELECT slide_id, version_id, 1 AS kind, n, 'textbox' AS element_type, {_strip('line')} AS txt, CAST(NULL AS VARCHAR) AS target
  FROM lines WHERE NOT is_row AND {_strip('line')} <> ''
  UNION ALL
  SELECT slide_id, version_id, 2, 0, 'table', txt, NULL FROM table_texts JOIN raw_pages USING (slide_id)
  UNION ALL
  SELECT slide_id, version_id, 3, 0, 'picture', NULL, '../media/image' || doc_id || '.png' FROM raw_pages WHERE doc_id % 13 = 0),
elements AS (
  SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY kind, n) - 1 AS element_index FROM raw_elements),
presentations AS (
  SELECT pid AS presentation_id, 'deck ' || pid AS title, CAST(pid % 3 AS BIGINT) AS owner_id,
         CASE WHEN pid % 4 = 3 THEN 'private' ELSE 'team' END AS visibility, pid % 10 = 9 AS deleted,
         2 * pid + 2 AS current_version_id, CASE WHEN pid % 3 < 2 THEN pid % 3 END AS folder_id, count(*) AS page_count
  FROM docs GROUP BY pid),
versions AS (
  SELECT version_id, (version_id - 1) // 2 AS presentation_id, CASE WHEN version_id % 2 = 1 THEN 1 ELSE 2 END AS version_no,
         count(*) AS page_count,
         (['UPLOADING','PARSING','PARSED','RENDERING','BASIC_READY','ENRICHED','READY','PARTIAL_FAILED'])[version_id % 8 + 1] AS status,
         'deck_' || version_id || '.pptx' AS original_filename
  FROM raw_pages GROUP BY version_id),
files AS (SELECT doc_id AS file_id, sha256(text) AS sha, pid AS presentation_id FROM docs),
slide_tags AS (
  SELECT doc_id AS slide_id, 'tag-quality' AS tag_id, 'manual' AS origin, CAST(NULL AS DOUBLE) AS confidence, true AS is_confirmed
  FROM labels WHERE quality = 1
  UNION ALL SELECT doc_id, 'tag-toxic', 'ai', 0.8, false FROM labels WHERE toxic = 1
  UNION ALL SELECT doc_id, 'tag-' || lang, 'ai', 0.9, false FROM docs),
tags AS (
  SELECT DISTINCT tag_id, substr(tag_id, 5) AS name,
         CASE WHEN tag_id IN ('tag-quality', 'tag-toxic') THEN 'review' ELSE 'language' END AS category,
         CASE WHEN tag_id = 'tag-quality' THEN 'manual' ELSE 'ai' END AS source, 'active' AS status FROM slide_tags),
favorites AS (
  SELECT user_id, event_id % (SELECT count(*) FROM docs) AS slide_id, min(ts) AS created_at
  FROM events WHERE event_type = 'click' GROUP BY ALL),
jobs AS (
  SELECT event_id AS job_id, CASE WHEN event_type = 'signup' THEN 'analyze_visual' ELSE 'parse_openxml' END AS job_type,
         CASE WHEN event_type = 'signup' THEN 'slide' ELSE 'version' END AS target_type,
         CASE WHEN event_type = 'signup' THEN user_id ELSE user_id % 40 + 1 END AS target_id,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'running' ELSE 'pending' END AS status,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS progress,
         CASE WHEN event_type = 'view' THEN 'PARSING' END AS stage, CASE WHEN event_type = 'error' THEN 'PARSE_ERROR' END AS error_code,
         ts AS created_at, CAST(round(value * 1000) AS BIGINT) AS took_ms
  FROM events),
queries AS (
  SELECT item_id AS query_id, text AS query, e.embedding, e.label FROM benchmark LEFT JOIN embeddings e ON e.vec_id = item_id
  UNION ALL
  SELECT -item_id - 1, coalesce(list_reverse_sort([{{'n': length(w), 'w': w}} for w in regexp_extract_all(text, '{PAT}')])[1].w, ''), NULL, NULL FROM benchmark)"""


def sql(body: str, *ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join([BASE.strip(), *ctes]) + "\n" + body


def scope(user: int | None = 0, historical: bool = False) -> str:
    seen = "" if user is None else f"AND (p.visibility = 'team' OR p.owner_id = {user})"
    on = "(s.version_id - 1) // 2 = p.presentation_id" if historical else "s.version_id = p.current_version_id"
    return f"""
scoped AS (
  SELECT s.slide_id, s.version_id, s.page_no, s.title, s.native_text, s.fingerprint, s.doc_id, p.presentation_id, p.title AS presentation_title
  FROM slides s JOIN presentations p ON {on} WHERE NOT p.deleted {seen})"""


INDEX = r"""
ai_text AS (
  SELECT slide_id, string_agg(name, ' ' ORDER BY name) AS ai_tags FROM slide_tags JOIN tags USING (tag_id) WHERE origin = 'ai' GROUP BY slide_id),
indexed AS (
  SELECT s.slide_id, concat_ws(chr(10), nullif(s.title, ''), nullif(s.native_text, ''), nullif(t.txt, ''), nullif(a.ai_tags, ''), s.presentation_title) AS index_text
  FROM scoped s LEFT JOIN table_texts t USING (slide_id) LEFT JOIN ai_text a USING (slide_id))"""

WORDS = rf"""
q_terms AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '{PAT}')) AS token FROM queries),
q_size AS (SELECT query_id, count(*) AS n FROM q_terms GROUP BY query_id)"""


def bm25(name: str, docs: str, keys: str) -> str:
    """CTEs scoring (query, doc) for docs(keys, txt) that hold all query tokens."""
    return rf"""
{name}_len AS (SELECT {keys}, len(regexp_extract_all(lower(coalesce(txt, '')), '{PAT}')) AS n_tokens FROM {docs}),
{name}_all AS (SELECT count(*) AS n_docs, avg(n_tokens) AS avg_tokens FROM {name}_len),
{name}_post AS (
  SELECT {keys}, token, count(*) AS tf FROM (SELECT {keys}, unnest(regexp_extract_all(lower(txt), '{PAT}')) AS token FROM {docs})
  WHERE token IN (SELECT token FROM q_terms) GROUP BY ALL),
{name}_df AS (SELECT token, count(*) AS df FROM {name}_post GROUP BY token),
{name}_scored AS (
  SELECT query_id, {keys},
         round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / avg_tokens))), 6) AS score, count(*) AS n_met
  FROM q_terms JOIN {name}_post USING (token) JOIN {name}_df USING (token) JOIN {name}_len USING ({keys}) CROSS JOIN {name}_all
  GROUP BY query_id, {keys}),
{name}_hits AS (SELECT s.* FROM {name}_scored s JOIN q_size USING (query_id) WHERE n_met = n)"""


def ranked(name: str, source: str, order: str, k: int = 100) -> str:
    return f"""
{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, slide_id) AS rank FROM {source}) WHERE rank <= {k})"""


TEXT = "page_docs AS (SELECT slide_id, index_text AS txt FROM indexed)," + bm25("page", "page_docs", "slide_id") + "," + ranked(
    "text_list", "page_hits", "score DESC"
)
ELEMENT_TEXT = (
    "elem_docs AS (SELECT slide_id, element_index, txt FROM elements WHERE slide_id IN (SELECT slide_id FROM scoped)),"
    + bm25("elem", "elem_docs", "slide_id, element_index")
    + ", elem_best AS (SELECT query_id, slide_id, max(score) AS score FROM elem_hits GROUP BY ALL),"
    + ranked("element_text_list", "elem_best", "score DESC")
)


def nearest(name: str, vectors: str, where: str, k: int = 100) -> str:
    return f"""
{name}_d AS (
  SELECT query_id, v.slide_id, min(round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6)) AS distance
  FROM queries q JOIN ({vectors}) v ON q.embedding IS NOT NULL {where} GROUP BY ALL),""" + ranked(f"{name}_list", f"{name}_d", "distance", k)


PAGE_VECTORS = "SELECT vec_id AS slide_id, embedding FROM embeddings"
ELEMENT_VECTORS = "SELECT vec_id % 100 AS slide_id, embedding FROM embeddings"
IN_SCOPE = "AND v.slide_id IN (SELECT slide_id FROM scoped)"


def vector_lists(filter_first: bool = True) -> str:
    if filter_first:
        return nearest("vector", PAGE_VECTORS, IN_SCOPE) + "," + nearest("element_vector", ELEMENT_VECTORS, IN_SCOPE)
    return ",".join(
        [
            nearest("vector_any", PAGE_VECTORS, ""),
            "vector_list AS (SELECT * FROM vector_any_list WHERE slide_id IN (SELECT slide_id FROM scoped))",
            nearest("element_vector_any", ELEMENT_VECTORS, ""),
            "element_vector_list AS (SELECT * FROM element_vector_any_list WHERE slide_id IN (SELECT slide_id FROM scoped))",
        ]
    )


FUSED = """
every_list AS (
  SELECT query_id, slide_id, 't' AS list, rank, 1.0 AS w FROM text_list
  UNION ALL SELECT query_id, slide_id, 'v', rank, 1.0 FROM vector_list
  UNION ALL SELECT query_id, slide_id, 'et', rank, 1.2 FROM element_text_list
  UNION ALL SELECT query_id, slide_id, 'ev', rank, 1.2 FROM element_vector_list),
fused AS (
  SELECT query_id, slide_id, sum(CAST(w AS DOUBLE) / (60.0 + rank)) AS rrf, max(CASE WHEN list = 't' THEN rank END) AS text_rank,
         max(CASE WHEN list = 'v' THEN rank END) AS vector_rank, max(CASE WHEN list = 'et' THEN rank END) AS element_text_rank,
         max(CASE WHEN list = 'ev' THEN rank END) AS element_vector_rank
  FROM every_list GROUP BY query_id, slide_id)"""


def bonuses(fav: str = "none", tags: bool = False, top: int = 24, source: str = "fused", queries: str = "queries") -> str:
    """CTE hits: fused candidates with bonuses, reasons and positions. fav: none, boost or only."""
    tag_join = (
        f"""LEFT JOIN (SELECT slide_id, bool_or(origin = 'manual') AS manual_tag, bool_or(origin = 'ai') AS ai_tag
            FROM slide_tags WHERE tag_id IN {TAGS} GROUP BY slide_id) g USING (slide_id)"""
        if tags
        else "LEFT JOIN (SELECT CAST(NULL AS BIGINT) AS slide_id, false AS manual_tag, false AS ai_tag) g USING (slide_id)"
    )
    keep = "WHERE favorite" if fav == "only" else ""
    gain = f"+ CASE WHEN favorite THEN {c.BONUS_FAVORITE} ELSE 0 END" if fav == "boost" else ""
    shown = "favorite" if fav == "boost" else "false"
    return f"""
flagged AS (
  SELECT f.*, s.version_id, s.presentation_id, s.presentation_title, s.page_no, s.title, lower({_strip("coalesce(q.query, '')")}) AS q,
         lower(coalesce(s.title, '')) AS lt, lower(coalesce(s.presentation_title, '')) AS lp,
         coalesce(g.manual_tag, false) AS manual_tag, coalesce(g.ai_tag, false) AS ai_tag,
         f.slide_id IN (SELECT slide_id FROM favorites WHERE user_id = 0) AS favorite
  FROM {source} f JOIN scoped s USING (slide_id) JOIN {queries} q USING (query_id) {tag_join}),
judged AS (
  SELECT *, q <> '' AND lt = q AS exact, q <> '' AND lt <> '' AND contains(lt, q) AND lt <> q AS part, q <> '' AND lp <> '' AND contains(lp, q) AS by_file
  FROM flagged {keep}),
totalled AS (
  SELECT *, round(rrf + CASE WHEN exact THEN 3.0 WHEN part THEN 1.5 ELSE 0 END + CASE WHEN by_file THEN 2.0 ELSE 0 END
         + CASE WHEN manual_tag THEN 2.5 ELSE 0 END + CASE WHEN ai_tag THEN 1.0 ELSE 0 END {gain}, 6) AS score,
         concat_ws('|', CASE WHEN text_rank IS NOT NULL THEN '{c.REASON_TEXT}' END, CASE WHEN vector_rank IS NOT NULL THEN '{c.REASON_VECTOR}' END,
           CASE WHEN element_text_rank IS NOT NULL OR element_vector_rank IS NOT NULL THEN '{c.REASON_ELEMENT}' END,
           CASE WHEN exact THEN '{c.REASON_TITLE_EXACT}' END, CASE WHEN part THEN '{c.REASON_TITLE_PART}' END,
           CASE WHEN by_file THEN '{c.REASON_FILE_TITLE}' END, CASE WHEN manual_tag THEN '{c.REASON_MANUAL_TAG}' END,
           CASE WHEN ai_tag AND NOT manual_tag THEN '{c.REASON_AI_TAG}' END, CASE WHEN {shown} THEN '{c.REASON_FAVORITE}' END) AS hit_reasons
  FROM judged),
hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slide_id) AS position FROM totalled) WHERE position <= {top})"""


HIT_COLS = (
    "query_id, position, slide_id, presentation_id, page_no, score, text_rank, vector_rank, element_text_rank, element_vector_rank, hit_reasons"
)


def search(body: str, *more: str, user: int | None = 0, historical=False, filter_first=True, queries: str | None = None, **bonus) -> str:
    words = WORDS if queries is None else WORDS.replace("FROM queries", f"FROM {queries}")
    vectors = vector_lists(filter_first)
    extra = []
    if queries is not None:
        vectors = vectors.replace("FROM queries q", f"FROM {queries} q")
        extra = [f"{queries} AS ({ASKED})"]
        bonus["queries"] = queries
    return sql(body, *extra, scope(user, historical), INDEX, words, TEXT, ELEMENT_TEXT, vectors, FUSED, bonuses(**bonus), *more)


ASKED = "SELECT query_id, query, embedding FROM queries WHERE query_id % 5 <> 4 AND query <> ''"


# --- duplicates -----------------------------------------------------------------------------


def signatures(source: str = "scoped") -> str:
    votes = ", ".join(
        f"sum(({half} >> {i}) & 1) AS b{base + i}" for half, base in (("hi", 32), ("lo", 0)) for i in range(32)
    )
    half = lambda base: " + ".join(f"CASE WHEN b{base + i} * 2 > n THEN {1 << i} ELSE 0 END" for i in range(32))
    return rf"""
sig_tokens AS (SELECT slide_id, regexp_extract_all(lower(native_text), '{PAT}') AS t FROM {source}),
sig_shingles AS (
  SELECT slide_id, md5(array_to_string(list_slice(t, i, i + 2), ' ')) AS h
  FROM (SELECT slide_id, t, unnest(range(1, greatest(len(t) - 2, 1) + 1)) AS i FROM sig_tokens WHERE len(t) > 0)),
sig_halves AS (SELECT slide_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS lo FROM sig_shingles),
sig_votes AS (SELECT slide_id, count(*) AS n, {votes} FROM sig_halves GROUP BY slide_id),
signed AS (SELECT slide_id, CAST({half(32)} AS BIGINT) AS hi, CAST({half(0)} AS BIGINT) AS lo FROM sig_votes)"""


def apart(a: str, b: str) -> str:
    return f"(bit_count(xor({a}.hi, {b}.hi)) + bit_count(xor({a}.lo, {b}.lo)))"


PAIRS = f"""
reps AS (SELECT hi, lo, min(slide_id) AS slide_id, count(*) AS copies FROM signed GROUP BY hi, lo),
pairs AS (
  SELECT a.slide_id AS slide_a, b.slide_id AS slide_b, {apart('a', 'b')} AS distance
  FROM reps a JOIN reps b ON a.slide_id < b.slide_id WHERE {apart('a', 'b')} <= 8)"""

CLUSTERS = f"""
arcs AS (SELECT slide_a AS u, slide_b AS v FROM pairs UNION SELECT slide_b, slide_a FROM pairs),
walk(node, root) AS (SELECT slide_id, slide_id FROM reps UNION SELECT a.v, w.root FROM walk w JOIN arcs a ON a.u = w.node),
roots AS (SELECT node, min(root) AS cluster_id FROM walk GROUP BY node),
members AS (
  SELECT s.slide_id, r.cluster_id, s.hi, s.lo FROM signed s JOIN reps p ON p.hi = s.hi AND p.lo = s.lo JOIN roots r ON r.node = p.slide_id),
sizes AS (SELECT cluster_id, count(*) AS cluster_size FROM members GROUP BY cluster_id HAVING count(*) >= 2),
clusters AS (
  SELECT m.slide_id, m.cluster_id, z.cluster_size, {apart('m', 'h')} AS distance
  FROM members m JOIN sizes z USING (cluster_id) JOIN signed h ON h.slide_id = m.cluster_id)"""

EXACT = f"""
bearing AS (SELECT * FROM scoped WHERE {_strip("coalesce(native_text, '')")} <> ''),
exact_groups AS (SELECT fingerprint, min(slide_id) AS group_id, count(*) AS group_size FROM bearing GROUP BY fingerprint HAVING count(*) >= 2)"""

GROUPS = """
all_groups AS (
  SELECT slide_id, 'exact' AS kind, group_id, group_size, CAST(NULL AS INTEGER) AS distance FROM bearing JOIN exact_groups USING (fingerprint)
  UNION ALL SELECT slide_id, 'similar', cluster_id, cluster_size, distance FROM clusters)"""


def dup(body: str) -> str:
    text = sql(body, scope(), signatures(), PAIRS, CLUSTERS, EXACT, GROUPS)
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


# --- analyses and OCR -----------------------------------------------------------------------

REPLIES = rf"""
words AS (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '{PAT}') AS t FROM docs),
analyses AS (
  SELECT doc_id AS slide_id, doc_id % 5 <> 3 AS ok, coalesce(t[1], 'none') AS w1, coalesce(t[2], 'none') AS w2, coalesce(t[3], 'none') AS w3, lang, source,
         CASE WHEN doc_id % 4 = 0 THEN 0.5 ELSE (doc_id % 9 + 1) / 10.0 END AS confidence
  FROM words),
named AS (
  SELECT slide_id, 0 AS position, '主题' AS category, w1 AS name, confidence FROM analyses WHERE ok
  UNION ALL SELECT slide_id, 0, '主题', w2, confidence FROM analyses WHERE ok
  UNION ALL SELECT slide_id, 1, '页面用途', w3, confidence FROM analyses WHERE ok
  UNION ALL SELECT slide_id, 2, '内容形态', lang, confidence FROM analyses WHERE ok
  UNION ALL SELECT slide_id, 4, '适用场景', source, confidence FROM analyses WHERE ok),
fresh_tags AS (
  SELECT 'tag-' || name AS tag_id, name, category FROM (
    SELECT *, row_number() OVER (PARTITION BY name ORDER BY position, slide_id, category) AS rn FROM named)
  WHERE rn = 1 AND name NOT IN (SELECT name FROM tags))"""

OCR = rf"""
ocr AS (
  SELECT doc_id AS slide_id, CASE WHEN doc_id % 4 = 3 THEN '' ELSE
    {_strip(r"regexp_replace(regexp_replace(regexp_replace(chr(10) || chr(10) || chr(10) || chr(10) || text || ' ' || chr(12288) || chr(10), '\n{3,}', chr(10) || chr(10), 'g'), '\r\n|[\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]', chr(10), 'g'), '[\t \x1F\p{Zs}]+(\n|$)', '\1', 'g')")} END AS md
  FROM docs)"""

BLOCKS = f"""
doc_lines AS (
  SELECT doc_id, n, line, contains(line, ' | ') AS is_row, (n - 1) // 8 + 1 AS page_no FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM docs)),
paras AS (
  SELECT doc_id, page_no, 0 AS kind, n, 0 AS k, {_strip('line')} AS txt FROM doc_lines WHERE NOT is_row
  UNION ALL
  SELECT doc_id, page_no, 1, n, k, {_strip('cell')} FROM (
    SELECT doc_id, page_no, n, unnest(string_split(line, ' | ')) AS cell, unnest(range(1, len(string_split(line, ' | ')) + 1)) AS k FROM doc_lines WHERE is_row)),
pack_pages AS (
  SELECT doc_id AS file_id, page_no, coalesce(string_agg(CASE WHEN txt <> '' THEN txt END, chr(10) ORDER BY kind, n, k), '') AS native_text,
         arg_min(CASE WHEN txt <> '' THEN txt END, CASE WHEN txt <> '' THEN kind * 1000000000000 + n * 1000000 + k END) AS title,
         count(*) FILTER (WHERE kind = 0) AS n_shapes, count(*) FILTER (WHERE kind = 1 AND txt <> '') AS n_cells
  FROM paras GROUP BY ALL)"""


def counts(gone: str, *names: str) -> str:
    dead_v = f"SELECT version_id FROM versions WHERE presentation_id IN ({gone})"
    dead_s = f"SELECT slide_id FROM slides WHERE version_id IN ({dead_v})"
    where = {
        "presentations": f"presentation_id NOT IN ({gone})",
        "versions": f"presentation_id NOT IN ({gone})",
        "slides": f"version_id NOT IN ({dead_v})",
        "slide_tags": f"slide_id NOT IN ({dead_s})",
        "favorites": f"slide_id NOT IN ({dead_s})",
        "jobs": f"NOT (target_type = 'version' AND target_id IN ({dead_v}))",
        "exact": f"from_slide_id NOT IN ({dead_s}) AND to_slide_id NOT IN ({dead_s})",
    }
    label = lambda n: "matches" if n == "exact" else n
    return " UNION ALL ".join(f"SELECT '{label(n)}' AS table_name, count(*) AS n FROM {n} WHERE {where[n]}" for n in names)


FIRSTS = """
firsts AS (
  SELECT * FROM (SELECT version_id, page_no, slide_id, fingerprint, row_number() OVER (PARTITION BY version_id, fingerprint ORDER BY page_no, slide_id) AS rn
    FROM slides) WHERE rn = 1),
exact AS (
  SELECT o.version_id AS from_version_id, n.version_id AS to_version_id, o.slide_id AS from_slide_id, n.slide_id AS to_slide_id,
         CASE WHEN o.page_no = n.page_no THEN 'unchanged' ELSE 'rearranged' END AS match_type, CAST(1.0 AS DOUBLE) AS score
  FROM firsts o JOIN firsts n ON o.fingerprint = n.fingerprint AND n.version_id = o.version_id + 1 AND o.version_id % 2 = 1)"""

#: The walk in page order: each leftover new page takes its nearest free old page, the lower one among equals.
WALK = f"""
old_rest AS (SELECT s.version_id + 1 AS pair, s.slide_id, s.page_no, g.hi, g.lo FROM slides s LEFT JOIN signed g USING (slide_id)
  WHERE s.version_id % 2 = 1 AND s.slide_id NOT IN (SELECT from_slide_id FROM exact)),
new_rest AS (SELECT s.version_id AS pair, s.slide_id, s.page_no, g.hi, g.lo FROM slides s LEFT JOIN signed g USING (slide_id)
  WHERE s.version_id % 2 = 0 AND s.slide_id NOT IN (SELECT to_slide_id FROM exact)),
near_all AS (
  SELECT n.pair, n.slide_id AS new_id, n.page_no AS new_page, o.slide_id AS old_id, {apart('n', 'o')} * 100000000000000 + o.page_no AS place
  FROM new_rest n JOIN old_rest o ON o.pair = n.pair AND {apart('n', 'o')} <= {c.NEAR_DISTANCE}),
near_nth AS (SELECT *, dense_rank() OVER (PARTITION BY pair ORDER BY new_page, new_id) AS nth FROM near_all),
last_nth AS (SELECT pair, max(nth) AS most FROM near_nth GROUP BY pair),
steps(pair, nth, used, place) AS (
  SELECT pair, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) FROM last_nth
  UNION ALL
  SELECT w.pair, w.nth + 1, list_append(w.used, arg_min(m.old_id, m.place)), min(m.place)
  FROM steps w JOIN last_nth l ON l.pair = w.pair AND w.nth < l.most
  LEFT JOIN near_nth m ON m.pair = w.pair AND m.nth = w.nth + 1 AND NOT list_contains(w.used, m.old_id)
  GROUP BY w.pair, w.nth, w.used),
modified AS (
  SELECT w.pair, w.used[len(w.used)] AS old_id, (SELECT min(m.new_id) FROM near_nth m WHERE m.pair = w.pair AND m.nth = w.nth) AS new_id,
         w.place // 100000000000000 AS distance
  FROM steps w WHERE w.place IS NOT NULL),
matched AS (
  SELECT * FROM exact
  UNION ALL SELECT pair - 1, pair, old_id, new_id, 'modified', 1.0 - distance / 64.0 FROM modified
  UNION ALL SELECT pair - 1, pair, NULL, slide_id, 'added', 0.0 FROM new_rest WHERE slide_id NOT IN (SELECT new_id FROM modified)
  UNION ALL SELECT pair - 1, pair, slide_id, NULL, 'deleted', 0.0 FROM old_rest WHERE slide_id NOT IN (SELECT old_id FROM modified))"""

SETS = """
sets AS (SELECT DISTINCT version_id, fingerprint FROM slides),
set_sizes AS (SELECT version_id, count(*) AS n FROM sets GROUP BY version_id),
common AS (
  SELECT a.version_id AS left_id, b.version_id AS right_id, count(*) AS n_common FROM sets a JOIN sets b USING (fingerprint) GROUP BY ALL),
jaccards AS (
  SELECT o.*, n_common / CAST(l.n + r.n - n_common AS DOUBLE) AS jaccard
  FROM common o JOIN set_sizes l ON l.version_id = left_id JOIN set_sizes r ON r.version_id = right_id)"""

RELEVANT = f"""
relevant AS (
  SELECT DISTINCT q.query_id, {_strip('s.title')} AS title
  FROM queries q JOIN embeddings e ON e.label = q.label JOIN slides s ON s.slide_id = e.vec_id),
shown AS (SELECT v.query_id, v.rank AS position, {_strip('s.title')} AS title FROM vector_list v JOIN slides s USING (slide_id)),
judged AS (
  SELECT s.query_id, s.position, s.title, CASE WHEN r.title IS NULL THEN 0 ELSE 1 END AS rel
  FROM shown s LEFT JOIN relevant r ON r.query_id = s.query_id AND r.title = s.title),
labelled AS (SELECT query_id, count(*) AS n_relevant FROM relevant GROUP BY query_id),
sums AS (
  SELECT query_id, sum(rel / CAST(position AS DOUBLE)) AS dcg, sum(rel / log2(position + 1.0)) AS dcg_log, sum(rel) AS n_rel,
         count(DISTINCT CASE WHEN rel = 1 THEN title END) AS n_titles
  FROM judged GROUP BY query_id),
ideal AS (
  SELECT n, sum(1.0 / i) OVER (ORDER BY n) AS idcg, sum(1.0 / log2(i + 1.0)) OVER (ORDER BY n) AS idcg_log
  FROM (SELECT unnest(range(1, 11)) AS n, unnest(range(1, 11)) AS i)),
evaluated AS (
  SELECT l.query_id, coalesce(n_titles, 0) / CAST(n_relevant AS DOUBLE) AS recall, coalesce(dcg / i.idcg, 0.0) AS ndcg,
         coalesce(dcg_log / j.idcg_log, 0.0) AS ndcg_log
  FROM labelled l LEFT JOIN sums s USING (query_id) LEFT JOIN ideal i ON i.n = n_rel LEFT JOIN ideal j ON j.n = least(n_relevant, 10))"""

LIVE_FILES = "live_files AS (SELECT f.* FROM files f JOIN presentations p USING (presentation_id) WHERE NOT p.deleted)"
BENCH_FILES = "bench_files AS (SELECT -item_id - 1 AS file_id, sha256(text) AS sha FROM benchmark)"
KEY = "job_type || ':' || target_id || ':' || substr(sha256(concat_ws('|', job_type, CAST(target_id AS VARCHAR), stage)), 1, 16)"


_LETTERS = "'abcdefghijklmnopqrstuvwxyz', '" + "".join(chr(0x4E00 + i) for i in range(26)) + "'"
#: Best paths from the end: ``s`` holds the scores of the next places, one place more each step; then the cuts from the start.
SEGMENTED = f"""
WITH RECURSIVE runs AS (SELECT item_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), {_LETTERS}) AS run FROM benchmark),
words AS (
  SELECT translate(w, {_LETTERS}) AS word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) AS w FROM benchmark) GROUP BY 1),
costs AS (SELECT word, length(word) AS l, ln(freq) - (SELECT ln(sum(freq)) FROM words) AS c FROM words),
places AS (SELECT item_id, run, unnest(range(1, length(run) + 1)) AS pos FROM runs),
arcs AS (
  SELECT item_id, pos, list({{'l': l, 'c': c}}) AS own
  FROM (SELECT p.*, n.l AS size, substr(run, pos, n.l) AS part FROM places p CROSS JOIN (SELECT DISTINCT l FROM costs) n WHERE pos + n.l - 1 <= length(run)) x
    JOIN costs ON word = part GROUP BY item_id, pos),
every_place AS (SELECT p.item_id, p.pos, coalesce(own, []) AS own FROM places p LEFT JOIN arcs a ON a.item_id = p.item_id AND a.pos = p.pos),
best(item_id, pos, s, l) AS (
  SELECT item_id, length(run) + 1, [CAST(0 AS DOUBLE)], CAST(0 AS BIGINT) FROM runs
  UNION ALL
  SELECT item_id, pos, list_prepend(x.s, s)[1:64], x.l FROM (
    SELECT b.item_id, e.pos, b.s, list_reverse_sort(list_append(
      [{{'s': round(o.c + b.s[o.l], 9), 'l': o.l}} FOR o IN e.own],
      {{'s': round(b.s[1] - (SELECT ln(sum(freq)) FROM words), 9), 'l': CAST(1 AS BIGINT)}}))[1] AS x
    FROM best b JOIN every_place e ON e.item_id = b.item_id AND e.pos = b.pos - 1)),
cuts(item_id, pos, l) AS (
  SELECT item_id, pos, l FROM best WHERE pos = 1 AND l > 0
  UNION ALL SELECT b.item_id, b.pos, b.l FROM cuts c JOIN best b ON b.item_id = c.item_id AND b.pos = c.pos + c.l AND b.l > 0)
SELECT r.item_id, count(c.pos) AS n_tokens, sha256(coalesce(string_agg(substr(r.run, c.pos, c.l), ' ' ORDER BY c.pos), '')) AS tokens_hash
FROM runs r LEFT JOIN cuts c ON c.item_id = r.item_id GROUP BY r.item_id"""


def oracle() -> dict[str, str]:
    out: dict[str, str] = {}
    out["fingerprint"] = sql("SELECT slide_id, fingerprint FROM slides")
    out["index_text"] = sql("SELECT slide_id, sha256(index_text) AS text_hash, length(index_text) AS n_chars FROM indexed", scope(None), INDEX)
    out["tokens_postings"] = sql(
        rf"SELECT token, slide_id, count(*) AS tf FROM (SELECT slide_id, unnest(regexp_extract_all(lower(native_text), '{PAT}')) AS token FROM scoped) GROUP BY ALL",
        scope(None),
    )
    out["corpus_totals"] = sql(
        f"SELECT count(*) AS n_docs, round(avg(len(regexp_extract_all(lower(index_text), '{PAT}'))), 6) AS avg_tokens FROM indexed", scope(), INDEX
    )
    out["reindex_all"] = sql("SELECT count(*) AS total, count(index_text) AS reindexed, CAST(0 AS BIGINT) AS to_embed FROM indexed", scope(None), INDEX)
    out["scoped_slides_user"] = sql("SELECT slide_id, version_id, presentation_id, presentation_title FROM scoped", scope())
    out["scoped_slides_historical"] = sql("SELECT slide_id, version_id, presentation_id, presentation_title FROM scoped", scope(0, True))
    out["tagged_slides"] = sql(f"SELECT slide_id, page_no FROM scoped WHERE slide_id IN (SELECT slide_id FROM slide_tags WHERE tag_id IN {TAGS})", scope())
    out["favorite_slides"] = sql("SELECT slide_id, title FROM scoped WHERE slide_id IN (SELECT slide_id FROM favorites WHERE user_id = 0)", scope(None))
    out["text_bearing_slides"] = sql(f"SELECT version_id, count(*) AS n FROM slides WHERE {_strip('native_text')} <> '' GROUP BY version_id")
    out["vector_distances"] = """
WITH head AS (SELECT label, arg_min(embedding, vec_id) AS head FROM embeddings GROUP BY label)
SELECT vec_id AS slide_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(head AS DOUBLE[])), 6) AS distance,
       round(CAST(embedding[1] AS DOUBLE), 7) AS first_value
FROM embeddings JOIN head USING (label)"""
    out["library_list"] = sql(
        """SELECT p.presentation_id, p.title, CASE WHEN owner_id < 2 THEN 'User ' || owner_id ELSE 'user' || owner_id END AS owner_name,
  v.status AS current_status,
  CASE WHEN v.status IN ('BASIC_READY','READY') THEN 'ready' WHEN v.status IN ('UPLOADING','PARSING','RENDERING','PARSED') THEN 'processing'
       WHEN v.status = 'PARTIAL_FAILED' THEN 'failed' ELSE 'other' END AS status_group,
  CASE WHEN v.status IN ('UPLOADING','PARSING','RENDERING','BASIC_READY') THEN j.progress END AS progress,
  CASE WHEN v.status IN ('UPLOADING','PARSING','RENDERING','BASIC_READY') THEN j.stage END AS stage, p.page_count
FROM presentations p JOIN versions v ON v.version_id = p.current_version_id
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY created_at DESC, job_id DESC) AS rn FROM jobs WHERE target_type = 'version') WHERE rn = 1) j
  ON j.target_id = p.current_version_id
WHERE NOT p.deleted AND (p.visibility = 'team' OR p.owner_id = 0)"""
    )
    out["browse_pages"] = sql(
        "SELECT slide_id, presentation_id, page_no FROM scoped ORDER BY presentation_id % 5 DESC, presentation_id, page_no, slide_id LIMIT 48 OFFSET 48", scope()
    )
    out["browse_pages_deep"] = sql(
        "SELECT position, slide_id, presentation_id, page_no FROM (SELECT *, row_number() OVER (ORDER BY presentation_id % 5 DESC, presentation_id, page_no, slide_id) AS position, "
        "count(*) OVER () // 3 // 48 AS screen FROM scoped) WHERE position > screen * 48 AND position <= screen * 48 + 48", scope()
    )
    out["presentation_versions_nested"] = sql(
        "SELECT presentation_id, string_agg(version_no || ':' || version_id || ':' || status, ',' ORDER BY version_no) AS versions FROM versions GROUP BY presentation_id"
    )
    out["extract_elements"] = sql("SELECT slide_id, element_index, element_type, md5(txt) AS text_hash, target AS image_target FROM elements")
    out["picture_parts"] = sql(
        "SELECT slide_id, 'ppt/media/image' || doc_id || '.png' AS part, 'ppt/media/image' || doc_id || '.png' AS resolved FROM raw_pages WHERE doc_id % 13 = 0"
    )
    out["recent_slides"] = sql("SELECT slide_id, presentation_id, page_no FROM scoped ORDER BY doc_id DESC, slide_id LIMIT 24", scope())
    out["favorites_list"] = sql("SELECT slide_id, page_no, title FROM slides JOIN favorites USING (slide_id) WHERE user_id = 0")
    out["text_recall"] = sql("SELECT query_id, slide_id, score, rank FROM text_list", scope(), INDEX, WORDS, TEXT)
    out["element_text_recall"] = sql("SELECT query_id, slide_id, score, rank FROM element_text_list", scope(), WORDS, ELEMENT_TEXT)
    cols = "SELECT query_id, slide_id, distance, rank FROM"
    out["vector_recall"] = sql(f"{cols} vector_list", scope(), vector_lists())
    out["vector_recall_postfilter"] = sql(f"{cols} vector_list", scope(), vector_lists(False))
    out["element_vector_recall"] = sql(f"{cols} element_vector_list", scope(), vector_lists())
    out["rrf_fuse"] = sql(
        "SELECT query_id, slide_id, round(rrf, 6) AS score, text_rank, vector_rank, element_text_rank, element_vector_rank FROM fused",
        scope(), INDEX, WORDS, TEXT, ELEMENT_TEXT, vector_lists(), FUSED,
    )
    shown = f"SELECT {HIT_COLS} FROM hits"
    out["hybrid_search"] = search(shown, fav="boost")
    out["hybrid_historical"] = search(shown, user=None, historical=True, filter_first=False)
    out["hybrid_tag_boost"] = search(shown, tags=True)
    out["hybrid_favorites"] = search(shown, fav="only")
    blank = "blank_q AS (SELECT query_id, '' AS query FROM queries)"
    start = """
first_pages AS (SELECT slide_id FROM scoped ORDER BY slide_id LIMIT 100),
listed AS (SELECT query_id, slide_id, CAST(0 AS DOUBLE) AS rrf, CAST(NULL AS BIGINT) AS text_rank, CAST(NULL AS BIGINT) AS vector_rank,
           CAST(NULL AS BIGINT) AS element_text_rank, CAST(NULL AS BIGINT) AS element_vector_rank FROM blank_q CROSS JOIN first_pages)"""
    out["hybrid_filter_only"] = sql(shown, scope(), blank, start, bonuses("boost", True, source="listed", queries="blank_q"))
    out["search_sorted_page"] = search(
        """SELECT query_id, sorted_position, slide_id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(title, ''), position) AS sorted_position FROM hits) WHERE sorted_position BETWEEN 11 AND 20""",
        top=20,
    )
    out["search_by_presentation"] = search(
        """SELECT query_id, presentation_id, file_rank, n_hits, slide_ids FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_position) AS file_rank FROM (
    SELECT query_id, presentation_id, min(position) AS first_position, count(*) AS n_hits, string_agg(CAST(slide_id AS VARCHAR), ',' ORDER BY position) AS slide_ids
    FROM hits GROUP BY query_id, presentation_id)) WHERE file_rank <= 20""",
        top=40,
    )
    out["tag_facets"] = search(
        """SELECT query_id, tag_id, name, category, count(DISTINCT slide_id) AS n_slides
FROM hits JOIN slide_tags USING (slide_id) JOIN tags USING (tag_id) GROUP BY ALL""",
        top=c.FACET_DEPTH,
    )
    out["compose_match"] = search(
        f"""SELECT q.query_id AS item_no, CASE WHEN q.query_id % 7 = 0 THEN '{c.UNNAMED_SECTION}' ELSE 'part ' || q.query_id END AS section,
  h.slide_id, h.presentation_title, h.page_no, coalesce(round(h.score, 4), 0.0) AS score, h.slide_id IS NOT NULL AS matched
FROM queries q LEFT JOIN hits h ON h.query_id = q.query_id AND h.position = 1""",
        top=1, queries="asked",
    )
    out["compose_totals"] = search(
        "SELECT count(*) AS page_count, count(h.slide_id) AS matched_count FROM queries q LEFT JOIN hits h ON h.query_id = q.query_id AND h.position = 1", top=1
    )
    out["signatures"] = sql("SELECT slide_id, printf('%08x%08x', hi, lo) AS signature FROM signed", scope(), signatures())
    out["duplicate_exact"] = sql("SELECT slide_id, group_id, group_size FROM bearing JOIN exact_groups USING (fingerprint)", scope(), EXACT)
    out["duplicate_similar_pairs"] = sql("SELECT slide_a, slide_b, distance FROM pairs", scope(), signatures(), PAIRS)
    out["duplicate_clusters"] = dup("SELECT slide_id, cluster_id, cluster_size, distance FROM clusters")
    out["duplicate_groups"] = dup(
        "SELECT slide_id, kind, group_id, group_size, distance, page_no, presentation_title FROM all_groups JOIN scoped USING (slide_id)"
    )
    out["duplicate_summary"] = dup("SELECT kind, count(DISTINCT group_id) AS groups, count(*) AS pages FROM all_groups GROUP BY kind")
    out["similar_slides"] = sql(
        f"""SELECT slide_id, other_id, distance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY distance, other_id) AS rank FROM (
    SELECT a.slide_id, b.slide_id AS other_id, CASE WHEN a.fingerprint = b.fingerprint THEN 0 ELSE {apart('x', 'y')} END AS distance
    FROM bearing a JOIN bearing b ON a.slide_id <> b.slide_id JOIN signed x ON x.slide_id = a.slide_id JOIN signed y ON y.slide_id = b.slide_id)
  WHERE distance <= 8) WHERE rank <= 10""",
        scope(), signatures(), EXACT,
    )
    out["suggest_versions"] = sql(
        """SELECT left_id AS version_id, p.presentation_id, p.title, round(jaccard, 3) AS similarity, v.page_count
FROM jaccards JOIN presentations p ON p.current_version_id = right_id JOIN versions v ON v.version_id = right_id
WHERE left_id % 2 = 1 AND NOT p.deleted AND jaccard >= 0.5""",
        SETS,
    )
    out["version_jaccard"] = sql(
        "SELECT left_id, right_id, n_common, round(jaccard, 6) AS jaccard FROM jaccards WHERE left_id % 2 = 1 AND right_id = left_id + 1", SETS
    )
    out["previous_version"] = sql("SELECT presentation_id, version_id - 1 AS from_version_id, version_id AS to_version_id FROM versions WHERE version_id % 2 = 0")
    out["match_versions_exact"] = sql("SELECT * FROM exact", FIRSTS)
    out["match_versions"] = sql(
        "SELECT from_version_id, to_version_id, from_slide_id, to_slide_id, match_type, CAST(score AS DOUBLE) AS score FROM matched", FIRSTS, signatures("slides"), WALK,
        recursive=True,
    )
    out["version_diff_summary"] = sql(
        "SELECT from_version_id, to_version_id, match_type, count(*) AS n FROM matched GROUP BY ALL", FIRSTS, signatures("slides"), WALK, recursive=True
    )
    out["file_dedup"] = sql(
        """SELECT i.file_id, v.file_id IS NOT NULL OR i.nth > 1 AS is_duplicate, i.first_id AS first_file_id, v.file_id AS existing_version_id, v.presentation_id AS existing_presentation_id
FROM (SELECT file_id, sha, row_number() OVER (PARTITION BY sha ORDER BY file_id) AS nth, min(file_id) OVER (PARTITION BY sha) AS first_id
      FROM (SELECT file_id, sha FROM files UNION ALL SELECT file_id, sha FROM bench_files)) i
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY file_id DESC) AS rn FROM live_files WHERE file_id IN (SELECT doc_id FROM docs WHERE lang = 'en')) WHERE rn = 1) v USING (sha)""",
        LIVE_FILES, BENCH_FILES,
    )
    out["sha_precheck"] = sql(
        """SELECT i.sha AS sha256, p.presentation_id IS NOT NULL AS exists, p.presentation_id, 'deck ' || p.presentation_id AS presentation_title
FROM (SELECT sha FROM files UNION SELECT sha FROM bench_files) i LEFT JOIN (SELECT sha, min(presentation_id) AS presentation_id FROM live_files GROUP BY sha) p USING (sha)""",
        LIVE_FILES, BENCH_FILES,
    )
    out["assign_versions"] = sql(
        """SELECT f.file_id, CASE WHEN f.file_id % 11 <> 0 THEN f.presentation_id END AS parent_presentation_id,
  CASE WHEN f.file_id % 11 = 0 THEN 1 WHEN NOT p.deleted THEN 2 + row_number() OVER (PARTITION BY f.presentation_id, f.file_id % 11 = 0 ORDER BY f.file_id) END AS version_no,
  CASE WHEN f.file_id % 11 = 0 THEN true WHEN p.deleted THEN false
       ELSE row_number() OVER (PARTITION BY f.presentation_id, f.file_id % 11 = 0 ORDER BY f.file_id DESC) = 1 END AS is_current,
  CASE WHEN f.file_id % 11 <> 0 AND p.deleted THEN 'INVALID_PARENT' END AS error
FROM files f JOIN presentations p USING (presentation_id)"""
    )
    out["detect_format"] = (
        "SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'pdf' WHEN 2 THEN 'ppt' WHEN 3 THEN 'pptx' END AS format FROM documents"
    )
    out["validate_sources"] = """
SELECT doc_id AS file_id, 'f' || doc_id || CASE doc_id % 6 WHEN 5 THEN '.key' WHEN 2 THEN '.PDF' WHEN 3 THEN '.ppt' ELSE '.pptx' END AS filename,
  CASE doc_id % 6 WHEN 2 THEN 'pdf' WHEN 3 THEN 'ppt' WHEN 4 THEN NULL ELSE 'pptx' END AS format,
  CASE doc_id % 6 WHEN 1 THEN 'CORRUPT_ZIP' WHEN 3 THEN 'INVALID_PPT' WHEN 4 THEN 'INVALID_ZIP' WHEN 5 THEN 'UNSUPPORTED_EXTENSION' END AS error
FROM documents"""
    out["parse_packages"] = sql(
        """SELECT file_id, 'success' AS parse_status, page_no, md5(title) AS title_hash, sha256(native_text) AS text_hash, CASE WHEN page_no = 1 THEN 'note ' || file_id ELSE '' END AS notes_text,
  n_shapes, n_cells, CASE WHEN page_no = 1 THEN 1 ELSE 0 END AS n_pictures, CASE WHEN page_no = 1 THEN 4 ELSE 1 END AS n_rels FROM pack_pages WHERE file_id % 17 NOT IN (3, 5)
UNION ALL SELECT doc_id, 'failed', NULL, NULL, NULL, NULL, NULL, 0, NULL, NULL FROM docs WHERE doc_id % 17 IN (3, 5)""",
        BLOCKS,
    )
    out["part_closure"] = sql(
        """SELECT file_id, 'ppt/slides/slide' || page_no || '.xml' AS page_part, CASE WHEN page_no = 1 THEN 13 WHEN has_one THEN 10 END AS n_parts
FROM (SELECT file_id, page_no, true AS has_one FROM pack_pages)""",
        BLOCKS,
    )
    out["structure_check"] = sql(
        "SELECT file_id, count(*) AS n_slides, CAST(0 AS BIGINT) AS dangling, CAST(0 AS BIGINT) AS bad_xml, count(*) = 1 AS passed FROM pack_pages GROUP BY file_id", BLOCKS
    )
    out["placeholder_pages"] = sql(
        "SELECT 2 * presentation_id + 1001 AS version_id, unnest(range(1, page_count + 1)) AS page_no, 'render_only' AS parse_status FROM presentations"
    )
    out["replace_pages"] = sql(
        "SELECT slide_id, version_id, page_no, CASE WHEN version_id % 3 = 0 THEN sha256(fingerprint) ELSE fingerprint END AS fingerprint FROM slides"
    )
    out["snapshot_merges"] = sql(
        "SELECT 1 AS snapshot, slide_id, version_id, page_no, fingerprint FROM slides UNION ALL "
        "SELECT 2, slide_id, version_id, page_no, CASE WHEN version_id % 3 = 0 THEN sha256(fingerprint) ELSE fingerprint END FROM slides"
    )
    out["bulk_generate"] = """
WITH pool AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS nth, count(*) OVER () AS size FROM documents)
SELECT nth + k * size AS slide_id, doc_id AS source_slide_id, nth + k * size AS page_no, lang FROM pool CROSS JOIN (SELECT unnest(range(0, 3)) AS k)"""
    out["normalize_analyses"] = sql(
        """SELECT slide_id, CASE WHEN ok THEN 'success' ELSE 'failed' END AS status, CASE WHEN ok THEN 'page ' || slide_id END AS summary,
  CASE WHEN ok THEN w1 || '|' || w2 END AS topics, CASE WHEN ok THEN w3 END AS page_purpose, CASE WHEN ok THEN '' END AS visual_styles,
  CASE WHEN ok THEN source END AS use_cases, CASE WHEN ok THEN CAST(confidence AS DOUBLE) END AS confidence FROM analyses""",
        REPLIES,
    )
    merged = """
all_names AS (SELECT name, tag_id FROM tags UNION ALL SELECT name, tag_id FROM fresh_tags),
kept AS (SELECT * FROM slide_tags WHERE NOT (origin = 'ai' AND NOT is_confirmed AND slide_id IN (SELECT slide_id FROM analyses WHERE ok))),
wanted AS (SELECT DISTINCT slide_id, tag_id, CAST(confidence AS DOUBLE) AS confidence FROM named JOIN all_names USING (name))"""
    out["merge_ai_tags"] = sql(
        """SELECT slide_id, tag_id, origin, confidence, is_confirmed FROM kept
UNION ALL SELECT w.slide_id, w.tag_id, 'ai', w.confidence, false FROM wanted w
WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.slide_id = w.slide_id AND k.tag_id = w.tag_id)""",
        REPLIES, merged,
    )
    out["created_ai_tags"] = sql("SELECT tag_id, name, category FROM fresh_tags", REPLIES)
    out["markdown_clean"] = sql("SELECT slide_id, md5(md) AS markdown_hash FROM ocr", OCR)
    out["merge_ocr"] = sql(
        "SELECT s.slide_id, md5(nullif(o.md, '')) AS markdown_hash, s.fingerprint FROM scoped s LEFT JOIN ocr o USING (slide_id)", scope(None), OCR
    )
    out["enrichment_progress"] = sql(
        "SELECT version_id, CAST(floor(count(nullif(o.md, '')) * 100 / count(*)) AS INTEGER) AS progress FROM scoped LEFT JOIN ocr o USING (slide_id) GROUP BY version_id",
        scope(None), OCR,
    )
    out["embed_incremental"] = sql(
        """SELECT s.slide_id, 'm1' AS model, sha256(concat_ws(chr(10), nullif(s.title, ''), nullif(s.native_text, ''), nullif(t.txt, ''))) AS source_hash,
  CASE WHEN length(concat_ws(chr(10), nullif(s.title, ''), nullif(s.native_text, ''), nullif(t.txt, ''))) % 2 = 1 THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN length(concat_ws(chr(10), nullif(s.title, ''), nullif(s.native_text, ''), nullif(t.txt, ''))) % 2 = 0 THEN CAST(64 AS BIGINT) END AS dim
FROM scoped s LEFT JOIN table_texts t USING (slide_id) JOIN docs d ON d.doc_id = s.slide_id WHERE d.lang <> 'en'""",
        scope(None),
    )
    out["element_embed"] = sql("SELECT slide_id, 'success' AS embedding_status, count(*) AS n FROM elements WHERE txt IS NOT NULL GROUP BY slide_id")
    out["readiness"] = sql(
        """SELECT version_id, count(*) AS pages, count(e.vec_id) AS embedded, count(a.slide_id) AS analysed
FROM slides s LEFT JOIN embeddings e ON e.vec_id = s.slide_id LEFT JOIN (SELECT slide_id FROM analyses WHERE ok) a ON a.slide_id = s.slide_id GROUP BY version_id""",
        REPLIES,
    )
    out["promote_status"] = sql(
        """SELECT version_id, CASE WHEN version_id % 2 = 0 THEN 'READY' WHEN status IN ('RENDERING','PARSED','UPLOADING') THEN 'BASIC_READY' ELSE status END AS status FROM versions"""
    )
    out["job_latest"] = sql(
        """SELECT target_type, target_id, job_id, status, progress FROM (
  SELECT *, row_number() OVER (PARTITION BY target_type, target_id ORDER BY created_at DESC, job_id DESC) AS rn FROM jobs) WHERE rn = 1"""
    )
    out["apply_summaries"] = sql(
        """SELECT slide_id, CASE WHEN l.quality = 1 THEN 'second ' || slide_id ELSE 'old' END AS ai_summary,
  CASE WHEN l.quality = 1 THEN 'success' WHEN l.quality IS NOT NULL THEN 'failed' ELSE 'none' END AS ai_status
FROM slides LEFT JOIN labels l ON l.doc_id = slide_id"""
    )
    out["merge_element_ocr"] = sql(
        rf"""SELECT slide_id, element_index, md5(body) AS text_hash, array_to_string(regexp_extract_all(lower(body), '{PAT}'), ' ') AS tokens
FROM (SELECT *, CASE WHEN element_type = 'picture' AND coalesce(txt, '') = '' THEN 'read ' || slide_id || ' twice' ELSE txt END AS body FROM elements)"""
    )
    nibble = lambda x: f"strpos('0123456789abcdef', substr({x}, i, 1)) - 1"
    digits_apart = lambda a, b: f"list_sum([bit_count(xor({nibble(a)}, {nibble(b)})) for i in range(1, 17)])"
    out["hex_distances"] = f"""
WITH d AS (SELECT doc_id, substr(sha256(text), 1, 16) AS a, substr(sha256(text), 17, 16) AS b, lang, lpad(lang, 16, '0') AS wide FROM documents)
SELECT doc_id, CAST({digits_apart('a', 'b')} AS INTEGER) AS halves,
  CASE WHEN regexp_full_match(lang, '[0-9a-f]{{1,16}}') THEN CAST({digits_apart('a', 'wide')} AS INTEGER) END AS odd FROM d"""
    out["titles_from_paths"] = sql("SELECT file_id, CAST(file_id AS VARCHAR) AS title FROM files")
    out["pages_of_version"] = sql("SELECT slide_id, page_no, title FROM slides WHERE version_id = 2")
    out["job_list"] = sql("SELECT job_id, target_id, error_code FROM jobs WHERE status = 'failed' ORDER BY created_at DESC, job_id LIMIT 100")
    out["job_targets"] = sql(
        """SELECT j.job_id, CASE WHEN target_type = 'version' THEN v.original_filename ELSE nullif(s.title, '') END AS target_name,
  coalesce(p.presentation_id, q.presentation_id) AS target_parent_id, coalesce(p.title, q.title) AS target_parent_name, s.page_no AS target_page_no
FROM jobs j LEFT JOIN versions v ON j.target_type = 'version' AND v.version_id = j.target_id LEFT JOIN presentations p ON p.presentation_id = v.presentation_id
LEFT JOIN slides s ON j.target_type = 'slide' AND s.slide_id = j.target_id LEFT JOIN presentations q ON q.presentation_id = (s.version_id - 1) // 2"""
    )
    out["job_durations"] = sql(
        """SELECT job_id, took_ms AS duration_ms,
  CASE WHEN took_ms < 1000 THEN took_ms || 'ms'
       WHEN took_ms < 10000 THEN (tenths // 10) || '.' || (tenths % 10) || 's'
       WHEN took_ms < 60000 THEN ((took_ms + 500) // 1000) || 's'
       WHEN (took_ms % 60000 + 500) // 1000 > 0 THEN (took_ms // 60000) || 'm ' || ((took_ms % 60000 + 500) // 1000) || 's'
       ELSE (took_ms // 60000) || 'm' END AS duration
FROM (SELECT job_id, CASE WHEN took_ms >= 0 THEN took_ms END AS took_ms,
  took_ms // 100 + CASE WHEN took_ms % 100 > 50 THEN 1 WHEN took_ms % 100 = 50
    AND CAST(took_ms / 1000.0 * 4503599627370496 AS HUGEINT) * 1000 >= CAST(took_ms AS HUGEINT) * 4503599627370496 THEN 1 ELSE 0 END AS tenths
  FROM (SELECT job_id, datediff('millisecond', created_at, created_at + to_milliseconds(took_ms)) AS took_ms FROM jobs))"""
    )
    out["job_upsert"] = sql(
        """SELECT idempotency_key, job_type, target_type, target_id, 'running' AS status, 50 AS progress FROM keyed WHERE status = 'running' GROUP BY ALL
UNION ALL
SELECT idempotency_key, job_type, target_type, target_id, 'pending', 0 FROM keyed WHERE idempotency_key NOT IN (SELECT idempotency_key FROM keyed WHERE status = 'running') GROUP BY ALL""",
        f"keyed AS (SELECT *, {KEY} AS idempotency_key FROM jobs)",
    )
    out["job_collapse"] = """
WITH log AS (SELECT CAST(user_id AS VARCHAR) AS k, CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'success' ELSE 'start' END AS e, ts, event_id FROM events),
last_any AS (SELECT k, e FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) AS rn FROM log) WHERE rn = 1),
last_end AS (SELECT k, e, ts FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) AS rn FROM log WHERE e <> 'start') WHERE rn = 1),
tries AS (SELECT *, coalesce(sum(CASE WHEN e = 'failure' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS try FROM log),
deciding AS (
  SELECT k, try FROM (
    SELECT t.k, t.try, row_number() OVER (PARTITION BY t.k ORDER BY (t.e <> 'start') DESC, t.ts DESC, t.event_id DESC) AS rn_end,
           row_number() OVER (PARTITION BY t.k ORDER BY t.ts DESC, t.event_id DESC) AS rn_any, a.e AS last_e, n.e AS end_e
    FROM tries t JOIN last_any a USING (k) LEFT JOIN last_end n USING (k))
  WHERE CASE WHEN end_e = 'success' OR last_e = 'failure' THEN rn_end ELSE rn_any END = 1),
runs AS (SELECT s.k, min(CASE WHEN s.try = d.try THEN s.ts END) AS opened, max(s.ts) AS latest FROM tries s JOIN deciding d ON s.k = d.k WHERE s.e = 'start' GROUP BY s.k)
SELECT a.k AS idempotency_key,
  CASE WHEN n.e = 'success' THEN 'success' WHEN a.e = 'start' THEN 'running' ELSE 'failed' END AS status,
  CASE WHEN n.e = 'success' THEN 100 ELSE 0 END AS progress, CASE WHEN n.e = 'failure' THEN 'E' END AS error_code,
  CASE WHEN n.e = 'success' OR a.e = 'failure' THEN epoch_us(n.ts) END AS finished_us, epoch_us(coalesce(r.opened, r.latest)) AS started_us
FROM last_any a LEFT JOIN last_end n USING (k) LEFT JOIN runs r USING (k)"""
    out["tag_lists"] = sql("SELECT slide_id, name, category, origin, is_confirmed FROM slide_tags JOIN tags USING (tag_id)")
    out["batch_tags"] = sql(
        """SELECT slide_id, tag_id, origin, is_confirmed FROM slide_tags
UNION ALL SELECT doc_id, 'tag-quality', 'manual', true FROM docs WHERE lang = 'fr' AND doc_id NOT IN (SELECT slide_id FROM slide_tags WHERE tag_id = 'tag-quality')"""
    )
    out["untag_pages"] = sql(
        "SELECT slide_id, tag_id FROM slide_tags WHERE NOT (tag_id = 'tag-toxic' AND slide_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 1))"
    )
    out["create_and_patch_tags"] = sql(
        """SELECT tag_id, name, category, source, CASE WHEN category = 'language' THEN 'disabled' ELSE status END AS status FROM tags
UNION ALL SELECT DISTINCT 'tag-' || source, source, 'source', 'manual', 'active' FROM docs WHERE source NOT IN (SELECT name FROM tags)"""
    )
    out["favorites_changed"] = sql(
        """SELECT user_id, slide_id, epoch_us(created_at) AS created_us FROM (
  SELECT * FROM favorites UNION ALL
  SELECT * FROM paged WHERE NOT EXISTS (SELECT 1 FROM favorites f WHERE f.user_id = paged.user_id AND f.slide_id = paged.slide_id)) a
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE event_type = 'view' AND e.user_id = a.user_id AND e.event_id % (SELECT count(*) FROM docs) = a.slide_id)""",
        "paged AS (SELECT user_id, event_id % (SELECT count(*) FROM docs) AS slide_id, min(ts) AS created_at FROM events WHERE event_type = 'purchase' GROUP BY ALL)",
    )
    out["soft_delete"] = sql(
        """SELECT presentation_id, CASE WHEN deleted THEN CAST(epoch(TIMESTAMP '2024-02-01') AS BIGINT)
  WHEN visibility = 'team' AND owner_id = 0 THEN CAST(epoch(TIMESTAMP '2024-03-01') AS BIGINT) END AS deleted_s FROM presentations"""
    )
    out["restore_files"] = sql("SELECT presentation_id, deleted AND owner_id <> 0 AS in_trash FROM presentations")
    out["hard_delete_cascade"] = sql(
        counts("SELECT presentation_id FROM presentations WHERE visibility = 'private'", "presentations", "versions", "slides", "slide_tags", "favorites", "jobs", "exact"),
        FIRSTS,
    )
    out["empty_trash"] = sql(counts("SELECT presentation_id FROM presentations WHERE deleted", "presentations", "versions", "slides", "slide_tags", "favorites"))
    out["folder_delete"] = sql("SELECT presentation_id, nullif(folder_id, 0) AS folder_id FROM presentations")
    out["set_current"] = sql("SELECT presentation_id, current_version_id - 1 AS current_version_id FROM presentations")
    out["patch_slides"] = sql(
        """SELECT slide_id, coalesce(CASE WHEN p.owner_id = 0 THEN (SELECT min('seen ' || quality) FROM labels WHERE doc_id = slide_id) END, 'none') AS user_note,
  CASE WHEN p.owner_id IS DISTINCT FROM 0 THEN s.title WHEN slide_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN NULL
  WHEN slide_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'good page ' || slide_id ELSE s.title END AS title, page_no
FROM slides s LEFT JOIN versions v USING (version_id) LEFT JOIN presentations p USING (presentation_id)"""
    )
    out["patch_files"] = sql(
        """SELECT presentation_id, CASE WHEN owner_id = 0 AND presentation_id % 2 = 0 THEN 'new ' || title ELSE title END AS title,
  CASE WHEN owner_id = 0 AND presentation_id % 2 = 0 THEN 'private' ELSE visibility END AS visibility FROM presentations"""
    )
    top10 = nearest("vector", PAGE_VECTORS, IN_SCOPE, 10)
    out["eval_recall_ndcg"] = sql("SELECT query_id, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg FROM evaluated", scope(), top10, RELEVANT)
    out["eval_standard"] = sql("SELECT query_id, round(recall, 6) AS recall, round(ndcg_log, 6) AS ndcg FROM evaluated", scope(), top10, RELEVANT)
    out["eval_means"] = sql(
        "SELECT count(*) AS queries_evaluated, round(avg(recall), 3) AS recall_mean, round(avg(ndcg), 3) AS ndcg_mean FROM evaluated", scope(), top10, RELEVANT
    )
    out["page_key_check"] = sql("SELECT version_id, page_no, count(*) AS n FROM slides GROUP BY ALL HAVING count(*) > 1")
    out["stream_ingest"] = sql(
        rf"""SELECT s.slide_id, s.fingerprint, len(regexp_extract_all(lower(concat_ws(chr(10), nullif(s.title, ''), nullif(s.native_text, ''), nullif(t.txt, ''))), '{PAT}')) AS n_tokens,
  coalesce(e.n, 0) AS n_elements
FROM slides s LEFT JOIN table_texts t USING (slide_id) LEFT JOIN (SELECT slide_id, count(*) AS n FROM elements GROUP BY slide_id) e USING (slide_id)
WHERE s.slide_id >= 0 OR s.slide_id % 2 <> 0"""
    )
    out["index_build"] = sql(
        f"""SELECT version_id, count(*) AS n_docs, sum(n) AS n_tokens, sum(n_distinct) AS n_postings
FROM (SELECT version_id, len(w) AS n, len(list_distinct(w)) AS n_distinct
  FROM (SELECT s.version_id, regexp_extract_all(lower(i.index_text), '{PAT}') AS w FROM indexed i JOIN scoped s USING (slide_id))) GROUP BY version_id""",
        scope(None, True), INDEX,
    )
    out["element_index_build"] = sql(
        f"""SELECT version_id, count(*) AS n_docs, sum(len(w)) AS n_tokens, nullif(sum(len(list_distinct(w))), 0) AS n_postings
FROM (SELECT e.version_id, regexp_extract_all(lower(coalesce(e.txt, '')), '{PAT}') AS w FROM elements e JOIN scoped s USING (slide_id)) GROUP BY version_id""",
        scope(None, True),
    )
    out["segmented_words"] = SEGMENTED
    out["stream_search"] = sql(
        "SELECT query_id, slide_id, score, rank FROM stream_list",
        scope(),
        """
stream_docs AS (
  SELECT s.slide_id, concat_ws(chr(10), nullif(s.title, ''), nullif(CASE WHEN s.version_id % 3 = 0 THEN s.title ELSE s.native_text END, ''),
    nullif(CASE WHEN s.version_id % 3 = 0 THEN f.txt ELSE t.txt END, '')) AS txt
  FROM scoped s LEFT JOIN table_texts t USING (slide_id)
    LEFT JOIN (SELECT slide_id, string_agg(cell, ' ' ORDER BY k) AS txt FROM cells WHERE cell <> '' AND n = 1 GROUP BY slide_id) f USING (slide_id)
  WHERE NOT (s.version_id % 3 = 0 AND s.slide_id % 7 = 3))""",
        WORDS,
        bm25("stream", "stream_docs", "slide_id"),
        ranked("stream_list", "stream_hits", "score DESC"),
    )
    out["stream_dedup"] = "SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM benchmark)"
    out["stream_job_state"] = sql(
        """SELECT target_type, target_id, job_id AS seq, status, progress
FROM (SELECT *, row_number() OVER (PARTITION BY target_type, target_id ORDER BY created_at DESC, job_id DESC) AS rn FROM jobs) WHERE rn = 1"""
    )
    return out
