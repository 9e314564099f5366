"""DuckDB SQL of the core's queries, for comparison.  DuckDB's regular expressions have no lookaround."""

from __future__ import annotations

from ledgerloom.config import EngineConfig
from ledgerloom.functions import rules
from ledgerloom.functions.text import CARRY, STOP

CONFIG = EngineConfig()
# what stands behind the texts of documents, by their number, so that rules find something
PERSONAL = ("my pan is ABCDE1234F", "aadhaar 2345 6789 0123", "account number is 601234567", "otp is 482913", "cvv 123", "mail a.b@c.org", "call +91 98765 43210", "pan abcde1234f", "18 months")
CLAIMS = ("You should buy it.", "Expected returns are high.", "It beats the market.", "There is no risk.", "Consider investing now.", "It is paid monthly.")


def planted(cases: tuple[str, ...], every: int) -> str:
    whens = " ".join(f"WHEN {i} THEN {quoted(c)}" for i, c in enumerate(cases))
    return f"(SELECT doc_id, concat_ws(' ', text, CASE doc_id % {every} {whens} END) AS text FROM documents)"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tokens(column: str) -> str:
    stop = ", ".join(map(quoted, STOP))
    return f"list_filter(regexp_extract_all(lower({column}), '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains([{stop}], t))"


def words(column: str) -> str:
    return rf"list_filter(regexp_split_to_array({column}, '[\s\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+'), lambda w: w <> '')"


def bm25(docs: str, key: str, text: str, questions: str, qkey: str, question: str) -> str:
    """CTEs up to ``scored`` (qid, key, score)."""
    k1, b = CONFIG.bm25_k1, CONFIG.bm25_b
    return f"""
toks AS (SELECT {key} AS key, coalesce({tokens(text)}, []) AS ts FROM {docs} WHERE {key} IS NOT NULL),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM toks),
postings AS (SELECT key, term, dl, count(*) AS tf FROM (SELECT key, len(ts) AS dl, unnest(ts) AS term FROM toks) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
qterms AS (SELECT qid, term, count(*) AS qtf FROM (SELECT {qkey} AS qid, unnest({tokens(question)}) AS term FROM {questions}) GROUP BY ALL),
scored AS (
  SELECT qid, key, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * ({k1}::DOUBLE + 1) / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * dl / avgdl))), 6) AS score
  FROM postings JOIN qterms USING (term) JOIN terms USING (term), stats GROUP BY qid, key
)"""


def case(column: str, table: rules.Rules) -> str:
    """The first rule that matches, as an expression; null for none."""
    parts = []
    for name, pattern in table:
        if name == "PHONE":
            pattern = r"(^|[^0-9])(?:\+?91[\s.-]?)?[6-9]\d{4}[\s.-]?\d{5}([^0-9]|$)"
        parts.append(f"WHEN regexp_matches({column}, {quoted(pattern)}) THEN {quoted(name)}")
    return f"CASE {' '.join(parts)} END"


def screen() -> str:
    q = "question"
    return f"""
WITH r AS (SELECT id, question, {case(q, rules.PII)} AS pii, {case(q, rules.ADVICE)} AS advice, {case(q, rules.OFF_TOPIC)} AS topic, {case(q, rules.SCHEMES)} AS scheme, regexp_matches({q}, {quoted(rules.IN_SCOPE)}) AS hint FROM in_scope)
SELECT id, (pii IS NULL AND advice IS NULL AND topic IS NULL AND hint) AS ok,
  CASE WHEN pii IS NOT NULL THEN 'refused_pii' WHEN advice IS NOT NULL THEN 'refused_advice' WHEN topic IS NOT NULL THEN 'off_topic' WHEN hint THEN 'answered' ELSE 'off_topic' END AS status,
  CASE WHEN pii IS NOT NULL THEN 'amc_overview' WHEN advice IS NOT NULL THEN coalesce(scheme, 'amc_overview') WHEN topic IS NOT NULL OR NOT hint THEN 'amc_overview' END AS link_scheme,
  CASE WHEN pii IS NOT NULL THEN 'pii:' || pii WHEN advice IS NOT NULL THEN 'advice:' || advice WHEN topic IS NOT NULL THEN 'off_topic:' || topic WHEN NOT hint THEN 'off_topic:no_hint' END AS rule
FROM r"""


def dense(narrowed: bool) -> str:
    pin = "WHERE c.label = q.label" if narrowed else ""
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT q.vec_id, c.vec_id AS other, round(list_cosine_similarity(q.e, c.e), 6) AS score FROM (SELECT * FROM v WHERE vec_id % 100 = 0) q, v c {pin}),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other) AS rank FROM s)
SELECT vec_id, other, score, rank::INTEGER AS rank FROM r WHERE rank <= 5"""


RETRIEVAL = f"""
WITH vec AS (SELECT vec_id, count(*) OVER () AS nv, label::VARCHAR AS doc_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
chunk_texts AS (SELECT coalesce(d.doc_id - 1, v.vec_id) AS key, v.doc_id, v.e, d.text FROM vec v LEFT JOIN documents d ON (d.doc_id - 1) % v.nv = v.vec_id),
asked AS (
  SELECT i.id || '-' || kind AS qid, i.question, CASE WHEN kind = 'pinned' THEN v.doc_id END AS pin, CASE WHEN kind = 'turned' THEN list_transform(v.e, lambda x: -x) ELSE v.e END AS e
  FROM in_scope i JOIN vec v ON (i.id - 1) % v.nv = v.vec_id, (VALUES ('plain'), ('pinned'), ('turned')) k(kind)
),
{bm25("chunk_texts", "key", "text", "asked", "qid", "question")},
cosines AS (SELECT a.qid, c.key, round(list_cosine_similarity(a.e, c.e), 6) AS cosine FROM asked a JOIN chunk_texts c ON a.pin IS NULL OR a.pin = c.doc_id),
semantic AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, key) AS place FROM cosines QUALIFY place <= 15),
modes AS (
  SELECT qid, any_value(pin) AS pin, max(cosine) AS best, count(key) AS found, CASE WHEN count(key) < 2 THEN 'dense' WHEN any_value(pin) IS NOT NULL THEN 'pinned' WHEN max(cosine) < 0.3 THEN 'lexical' ELSE 'hybrid' END AS strategy
  FROM asked LEFT JOIN semantic USING (qid) GROUP BY qid
),
words_of_all AS (  -- every chunk has a score, most of them zero
  SELECT m.qid, c.key, c.doc_id, coalesce(s.score, 0) AS bm25, row_number() OVER (PARTITION BY m.qid ORDER BY coalesce(s.score, 0) DESC, c.key) AS place
  FROM modes m JOIN chunk_texts c ON m.strategy IN ('lexical', 'hybrid') LEFT JOIN scored s ON s.qid = m.qid AND s.key = c.key QUALIFY place <= 15
),
pool AS (  -- pinned: what the vectors found; hybrid: that and the best by words
  SELECT qid, key FROM semantic JOIN modes USING (qid) WHERE strategy IN ('pinned', 'hybrid')
  UNION SELECT qid, key FROM words_of_all JOIN modes USING (qid) WHERE strategy = 'hybrid'
),
placed AS (SELECT p.qid, p.key, coalesce(s.score, 0) AS bm25, row_number() OVER (PARTITION BY p.qid ORDER BY coalesce(s.score, 0) DESC, p.key) AS word_place FROM pool p LEFT JOIN scored s ON s.qid = p.qid AND s.key = p.key),
fused AS (
  SELECT p.qid, p.key, bm25, word_place, coalesce(d.place, 0) AS vector_place, round(1 / (60 + word_place)::DOUBLE + 1 / (60 + coalesce(d.place, m.found + 60))::DOUBLE, 12) AS score
  FROM placed p JOIN modes m USING (qid) LEFT JOIN semantic d ON d.qid = p.qid AND d.key = p.key
),
listed AS (
  SELECT qid, key, score, bm25, word_place, vector_place, word_place AS tie FROM fused
  UNION ALL SELECT w.qid, w.key, w.bm25, w.bm25, w.place, coalesce(d.place, 0), w.place FROM words_of_all w JOIN modes m USING (qid) LEFT JOIN semantic d ON d.qid = w.qid AND d.key = w.key WHERE m.strategy = 'lexical'
  UNION ALL SELECT d.qid, d.key, d.cosine, 0, 0, d.place, d.place FROM semantic d JOIN modes m USING (qid) WHERE m.strategy = 'dense'
)"""


def windows(source: str, size: int, overlap: int) -> str:
    """Rows of ``source`` (with a list ``ws``) by window: ``win`` and ``part``."""
    stride = size - overlap
    return f"(SELECT * EXCLUDE (ws, win), win::INTEGER AS win, ws[win * {stride} + 1:win * {stride} + {size}] AS part FROM (SELECT *, unnest(range(0, greatest(0, ceil((len(ws) - {size}) / {stride}.0))::BIGINT + 1)) AS win FROM {source} WHERE len(ws) > 0))"


def numbers(column: str) -> str:
    carry = ", ".join(map(quoted, CARRY))
    return rf"list_distinct(list_transform(list_filter(regexp_extract_all({column}, '\d[\d,]*(?:\.\d+)?'), lambda n: length(n) > 1 OR list_contains([{carry}], n)), lambda n: replace(n, ',', '')))"


def sql() -> dict[str, str]:
    history = lambda n: f"SELECT user_id AS conv_id, event_id AS turn, count(*) OVER w AS n, coalesce(string_agg(CASE WHEN event_id % 2 = 0 THEN 'USER: ' ELSE 'ASSISTANT: ' END || event_type, chr(10)) OVER w, '') AS transcript FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    split = r"string_split(regexp_replace(trim(text, ' '), '([.!?])[\s\x{85}\x{a0}]+([A-Z0-9₹])', '\1' || chr(1) || '\2', 'g'), chr(1))"
    drop = " OR ".join(f"starts_with(lower(heading), {quoted(h)})" for h in rules.DROP_HEADINGS)
    return {
        "bm25_topk": f"WITH {bm25('documents', 'doc_id', 'text', 'in_scope', 'id', 'question')} SELECT qid AS item_id, key AS doc_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM scored) WHERE rank <= 5",
        "term_stats": f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents) GROUP BY term",
        "index_stats": f"SELECT count(*) AS n, round(avg(len(coalesce({tokens('text')}, []))), 6) AS avgdl FROM documents",
        "dense_topk": dense(False),
        "dense_topk_narrowed": dense(True),
        "vector_dq": "WITH p AS (SELECT chunk_index, CASE WHEN embedding IS NULL THEN 'null' WHEN len(embedding) <> 384 THEN 'length' WHEN len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'not finite' WHEN abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) >= 1e-4 THEN 'not unit' END AS problem FROM index_rows) SELECT chunk_index, problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY ALL",
        "vector_preview": "SELECT vec_id AS chunk_index, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS square, round(embedding[1]::DOUBLE, 6) AS first, round(list_min(embedding)::DOUBLE, 6) AS least, round(list_max(embedding)::DOUBLE, 6) AS largest FROM embeddings ORDER BY vec_id LIMIT 5",
        "hybrid_retrieve": f"{RETRIEVAL} SELECT l.qid, pos::INTEGER AS pos, l.key AS chunk_index, coalesce(m.pin, c.doc_id) AS doc_id, strategy, round(score, 6) AS score, round(bm25, 6) AS lexical_score, vector_place::INTEGER AS dense_rank, word_place::INTEGER AS lexical_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, tie, key) AS pos FROM listed QUALIFY pos <= 5) l JOIN modes m USING (qid) JOIN chunk_texts c USING (key)",
        "floor_rescue": f"""{RETRIEVAL},
winners AS (SELECT qid, max(bm25) FILTER (place = 1) AS s1, max(bm25) FILTER (place = 2) AS s2, max(doc_id) FILTER (place = 1) AS d1, max(doc_id) FILTER (place = 2) AS d2 FROM words_of_all JOIN modes USING (qid) WHERE strategy = 'lexical' GROUP BY qid)
SELECT qid, strategy, pin IS NULL AS floor_applied, found = 0 OR (pin IS NULL AND best < 0.2 AND NOT coalesce(s1 >= 3 AND (s1 >= 1.4 * coalesce(s2, 0) OR d1 = d2), false)) AS below_floor FROM modes LEFT JOIN winners USING (qid)""",
        "word_windows": f"SELECT doc_id, win, len(part)::INTEGER AS n_words, md5(array_to_string(part, ' ')) AS digest FROM {windows(f'(SELECT doc_id, {words("text")} AS ws FROM documents WHERE text IS NOT NULL)', CONFIG.chunk_size, CONFIG.chunk_overlap)}",
        "section_windows": f"SELECT w.doc_id, sec_ord, win, md5(array_to_string(part, ' ')) AS digest FROM {windows(f'(SELECT DISTINCT s.doc_id, sec_ord, {words("concat_ws(chr(32), s.text, array_to_string(s.tables, chr(10)))")} AS ws FROM sections s WHERE kept)', CONFIG.chunk_size, CONFIG.chunk_overlap)} w JOIN sources USING (doc_id)",
        "chunks_per_scheme": "SELECT coalesce(scheme, '') AS scheme, count(*) AS n FROM chunks GROUP BY ALL UNION ALL SELECT 'TOTAL', count(*) FROM chunks",
        "chunk_sizes": f"SELECT count(*) AS chunks, min(w)::INTEGER AS smallest, sum(w)::BIGINT // count(w) AS mean, max(w)::INTEGER AS largest, count(*) FILTER (w < 60) AS undersized, count(*) FILTER (w > 250) AS over_budget FROM (SELECT len({words('text')}) AS w FROM chunks)",
        "chunks_per_document": "SELECT doc_id, count(*) AS chunks, sum(n_words)::BIGINT AS words FROM chunks GROUP BY doc_id",
        "sections_per_page": f"SELECT doc_id, count(*) AS sections, count(*) FILTER (kept) AS kept, sum(CASE WHEN kept THEN len({words('concat_ws(chr(32), text, array_to_string(tables, chr(32)))')}) ELSE 0 END)::BIGINT AS words FROM (SELECT DISTINCT * FROM sections) GROUP BY doc_id",
        "dropped_sections": "SELECT scheme, array_to_string(list_sort(list(DISTINCT heading) FILTER (heading IS NOT NULL)), '; ') AS headings FROM sections JOIN sources USING (doc_id) WHERE NOT kept GROUP BY scheme",
        "dump_lines": "SELECT doc_id, chunk_index, '[' || lpad(chunk_index::VARCHAR, greatest(3, length(chunk_index::VARCHAR))::INTEGER, '0') || '] ' || coalesce(scheme, '') || ' | ' || coalesce(section, '') || ' | ' || substr(text, 1, 110) AS line FROM chunks",
        "review_dump": f"""
WITH s AS (SELECT DISTINCT doc_id, sec_ord, heading, kept, reason FROM sections),
n AS (SELECT count(*) AS chunks, coalesce(sum(n_words), 0)::BIGINT AS words, coalesce(sum(n_words)::BIGINT // nullif(count(n_words), 0), 0) AS mean, coalesce(min(n_words), 0) AS least, coalesce(max(n_words), 0) AS most FROM chunks),
m AS (SELECT count(*) AS sections, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS dropped FROM s)
SELECT 0 AS part, NULL::VARCHAR AS scheme, NULL::VARCHAR AS doc_id, NULL::INTEGER AS chunk_index,
  'Parameters   CHUNK_SIZE={CONFIG.chunk_size} words  CHUNK_OVERLAP={CONFIG.chunk_overlap} words  MIN_SIZE={CONFIG.min_size} words' || chr(10) || 'Chunks       ' || chunks || chr(10) || 'Words        ' || format('{{:,}}', words) || ' total, ' || mean || ' mean per chunk' || chr(10) || 'Range        ' || least || ' - ' || most || ' words' || chr(10) || 'Sections     ' || sections || ' found, ' || kept || ' kept, ' || dropped || ' dropped' AS entry FROM n, m
UNION ALL SELECT DISTINCT 1, coalesce(scheme, ''), doc_id, NULL, '  [' || coalesce(doc_id, '') || '] ' || coalesce(heading, '') || '  -> ' || coalesce(reason, '') FROM s LEFT JOIN sources USING (doc_id) WHERE NOT kept
UNION ALL SELECT 2, NULL, c.doc_id, NULL, 'SOURCE ' || coalesce(c.doc_id, '') || '  ' || coalesce(title, '?') || chr(10) || '  url        ' || coalesce(url, '?') || chr(10) || '  chunks     ' || n || chr(10) || '  words      ' || format('{{:,}}', w) FROM (SELECT doc_id, count(*) AS n, coalesce(sum(n_words), 0)::BIGINT AS w FROM chunks GROUP BY doc_id) c LEFT JOIN sources USING (doc_id)
UNION ALL SELECT 2, NULL, doc_id, chunk_index, '[' || lpad(chunk_index::VARCHAR, greatest(3, length(chunk_index::VARCHAR))::INTEGER, '0') || ']  ' || CASE WHEN section <> '' THEN section ELSE coalesce(title, '') END || chr(10)
  || '        chars=' || coalesce(format('{{:,}}', n_chars), '') || '  words=' || coalesce(n_words::VARCHAR, '') || '  source=' || coalesce(doc_id, '') || '  scheme=' || coalesce(scheme, '') || CASE WHEN len(warnings) > 0 THEN '  warnings=[' || array_to_string(warnings, '; ') || ']' ELSE '' END || chr(10) || chr(10)
  || '    ' || replace(coalesce(text, ''), chr(10), chr(10) || '    ') FROM chunks""",
        "section_rules": f"""
WITH s AS (SELECT DISTINCT doc_id, sec_ord, heading, text, tables, coalesce({drop}, false) AS gone FROM sections),
good AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: x <> '' AND NOT regexp_matches(x, {quoted(rules.JUNK_LINE)}) AND NOT regexp_matches(x, {quoted(rules.DROP_LINE)})) AS ls FROM s),
cut AS (SELECT *, list_position(list_transform(ls, lambda x: {" OR ".join(f"starts_with(lower(trim(x)), {quoted(m)})" for m in rules.STOP_AT)}), true) AS stop FROM good),
done AS (SELECT *, CASE WHEN gone THEN '' ELSE coalesce(trim(array_to_string(CASE WHEN stop > 0 THEN ls[1:stop - 1] ELSE ls END, chr(10)), ' '), '') END AS t, CASE WHEN gone THEN [] ELSE list_filter(coalesce(tables, []), lambda r: NOT regexp_matches(r, {quoted(rules.DROP_LINE)})) END AS tb FROM cut)
SELECT doc_id, sec_ord, NOT gone AND NOT (t = '' AND len(tb) = 0) AS kept, CASE WHEN gone THEN 'dropped section: ''' || heading || '''' WHEN t = '' AND len(tb) = 0 THEN 'empty after filtering' ELSE '' END AS reason, md5(t) AS digest, len(tb)::INTEGER AS n_tables FROM done""",
        "row_ids": "SELECT chunk_index, substr(sha256(concat_ws('|', url, section, text)), 1, 16) AS id FROM chunks",
        "duplicate_texts": "SELECT sha256(text) AS digest, min(doc_id) AS first_doc, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "index_latest": "SELECT id, chunk_index, doc_id, ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(ingested_at, '') DESC, chunk_index DESC, doc_id DESC) AS r FROM index_rows) WHERE r = 1",
        "pii_scan": f"SELECT * FROM (SELECT doc_id, {case('text', rules.PII)} AS rule FROM {planted(PERSONAL, 10)}) WHERE rule IS NOT NULL",
        "intent_classify": screen(),
        "scheme_detect": f"SELECT chunk_index, coalesce('scheme:' || {case('title', rules.SCHEMES)}, {case('title', rules.AMC)}, '') AS narrowed_by FROM chunks",
        "advice_scan": f"SELECT * FROM (SELECT doc_id, {case('text', rules.DRIFT)} AS rule FROM {planted(CLAIMS, 8)}) WHERE rule IS NOT NULL",
        "standalone_flag": f"SELECT id, coalesce(regexp_matches(question, {quoted(rules.STANDALONE)}), false) AS alone FROM in_scope",
        "sentence_cap": f"SELECT doc_id, md5(CASE WHEN len(ss) > 3 THEN array_to_string(ss[1:3], ' ') ELSE trim(text, ' ') END) AS digest FROM (SELECT doc_id, text, list_filter(list_transform({split}, lambda s: trim(s, ' ')), lambda s: s <> '') AS ss FROM documents WHERE text IS NOT NULL)",
        "number_tokens": f"SELECT doc_id, len(n)::INTEGER AS numbers, md5(array_to_string(list_sort(n), ' ')) AS digest FROM (SELECT doc_id, {numbers('text')} AS n FROM documents WHERE text IS NOT NULL)",
        "passages_grounded": f"WITH have AS (SELECT DISTINCT doc_id, unnest({numbers('text')}) AS n FROM chunks), need AS (SELECT id, doc_id, unnest({numbers('passage')}) AS n FROM in_scope), lack AS (SELECT DISTINCT id FROM need LEFT JOIN have USING (doc_id, n) WHERE have.n IS NULL) SELECT id, CASE WHEN passage IS NOT NULL THEN id NOT IN (SELECT id FROM lack) END AS grounded FROM in_scope",
        "citation_resolve": r"SELECT chunk_index, coalesce(list_filter(list_transform(regexp_extract_all(regexp_replace(draft, '【(\d+)】', '[\1]', 'g'), '\[(\d+)\]', 1), lambda x: x::INTEGER), lambda x: x BETWEEN 1 AND 2)[1], 1) AS cited, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(draft, '【(\d+)】', '[\1]', 'g'), '\[\d+\]', '', 'g'), '\s+\.', '.', 'g'), '\.\.($|[^.])', '.\1', 'g'), ' ')) AS digest FROM (SELECT chunk_index, text || ' 【' || chunk_index % 4 || '】 [1].' AS draft FROM chunks)",
        "history_window_3": history(3),
        "history_window_10": history(10),
        "private_turns": """
WITH t AS (SELECT user_id AS conv_id, event_id AS turn, event_id % 2 = 0 AS mine, CASE WHEN event_id % 7 = 0 THEN 'pan ABCDE1234F ' ELSE '' END || event_type AS content, CASE WHEN event_id % 5 = 0 THEN 'generation_error' WHEN event_id % 11 <> 0 THEN 'answered' END AS status FROM events),
u AS (SELECT *, CASE WHEN mine THEN NOT contains(content, 'ABCDE1234F') ELSE coalesce(status = 'answered', false) END AS usable FROM t),
k AS (SELECT conv_id, turn, CASE WHEN mine THEN 'USER: ' ELSE 'ASSISTANT: ' END || content AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM u WHERE usable),
b AS (SELECT conv_id, turn, coalesce(sum(usable::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM u)
SELECT b.conv_id, b.turn, count(k.line) AS n, coalesce(string_agg(k.line, chr(10) ORDER BY place), '') AS transcript FROM b LEFT JOIN k ON k.conv_id = b.conv_id AND k.place BETWEEN b.seen - 3 AND b.seen GROUP BY b.conv_id, b.turn""",
        "allowlist": "SELECT chunk_index, url FROM chunks WHERE url IN (SELECT url FROM sources WHERE allowed AND url IS NOT NULL)",
        "source_urls": r"SELECT doc_id, CASE WHEN regexp_matches(url, '(?i)^https?://[^/]+') THEN 'https://' || lower(regexp_extract(url, '(?i)^https?://([^/]+)', 1)) || regexp_replace(regexp_replace(url, '(?i)^https?://[^/]+', ''), '/+$', '') ELSE url END AS url FROM sources",
        "registry_lines": "SELECT doc_id, '| ' || coalesce(doc_id, '') || ' | ' || coalesce(scheme, '') || ' | ' || coalesce(title, '') || ' | ' || coalesce(url, '') || ' | ' || coalesce(allowed::VARCHAR, '') || ' |' AS line FROM sources",
        "page_titles": r"SELECT doc_id, any_value(title) AS title FROM (SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)(</h1>|\n)', 1), '<[^>]+>', ' ', 'g'), '&nbsp;', chr(160)), '&amp;', '&'), '&#8377;', '₹'), '&ndash;', '–'), '[\s\x{a0}]+', ' ', 'g')) AS title FROM html_pages WHERE html LIKE '%<h1%') GROUP BY doc_id",
        "recall_metrics": f"""
WITH {bm25('chunks', 'chunk_index', 'text', 'in_scope', 'id', 'question')},
hits AS (SELECT * FROM (SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS pos FROM scored) WHERE pos <= 5),
got AS (SELECT h.qid, list(c.doc_id ORDER BY pos) AS docs, lower(string_agg(c.text, ' ' ORDER BY pos)) AS texts FROM hits h JOIN chunks c ON c.chunk_index = h.key GROUP BY h.qid),
flat AS (SELECT qid, docs, replace(trim(regexp_replace(texts, '[\\s\\x{{a0}}]+', ' ', 'g')), ',', '') AS texts FROM got)
SELECT count(*) AS questions, count(*) FILTER (list_contains(docs, doc_id)) AS recalled, count(*) FILTER (docs[1] = doc_id) AS first,
  count(*) FILTER (grounding IS NOT NULL AND contains(texts, replace(trim(regexp_replace(lower(grounding), '[\\s\\x{{a0}}]+', ' ', 'g')), ',', ''))) AS grounded, count(grounding) AS with_grounding
FROM in_scope LEFT JOIN flat ON qid = id""",
    }
