"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

# --- op7: quality rules ----------------------------------------------------------------------

SQL["op7_line_frequency"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, text FROM d
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1
), reps AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM twice) GROUP BY 1
), ln AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d
), lw AS (
  SELECT doc_id, source, text, line, k,
    list_filter(regexp_split_to_array(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM ln
), lines AS (
  SELECT doc_id, source, text, line, k, array_to_string(ws, ' ') AS norm, len(ws) AS n FROM lw WHERE len(ws) > 0
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY 1
), hosts AS (
  SELECT source, count(DISTINCT text) AS n FROM d GROUP BY 1
), frequent AS (
  SELECT source, norm FROM lines JOIN hosts USING (source) GROUP BY source, norm, hosts.n
  HAVING count(DISTINCT text) >= 10 AND (count(DISTINCT text) > 0.1 * hosts.n OR count(DISTINCT text) >= 100)
), hit AS (
  SELECT doc_id, k, n FROM lines JOIN frequent USING (source, norm)
), gone AS (
  SELECT doc_id, sum(n) AS n, count(*) AS lines FROM hit GROUP BY 1
), rest AS (
  SELECT ln.doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (h.k IS NULL), '') AS kept_text
  FROM ln LEFT JOIN (SELECT DISTINCT doc_id, k FROM hit) h USING (doc_id, k) GROUP BY 1
), base AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(reps.n, 0)::BIGINT AS n_repeat_words,
    coalesce(gone.n, 0)::BIGINT AS boilerplate_words, coalesce(gone.lines, 0)::BIGINT AS n_removed_lines, sha256(kept_text) AS kept_sha256
  FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN reps USING (doc_id) LEFT JOIN gone USING (doc_id) JOIN rest USING (doc_id)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
)
SELECT *, NOT base_failed AND n_words - boilerplate_words >= 20
  AND n_words - boilerplate_words >= 0.3 * n_words AS kept
FROM judged
"""

# --- op8: url filters ------------------------------------------------------------------------

SQL["op8_redirect_equivalence"] = r"""
WITH RECURSIVE rules(verdict, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), tags AS (
  SELECT url, unnest(list_concat(
    list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\brel\s*=\s*["'']?\s*canonical\b')),
    list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\bhttp-equiv\s*=\s*["'']?\s*refresh\b'))
  )) AS tag FROM pages WHERE contains(url, '://')
), links AS (
  SELECT url, trim(CASE WHEN lower(tag) LIKE '<link%'
    THEN trim(regexp_extract(tag, '(?is)\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '"''')
    ELSE regexp_extract(tag, '(?is)\burl\s*=\s*[''"]?([^''">\s]+)', 1) END) AS link FROM tags
), based AS (
  SELECT *, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme, lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)) AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM links WHERE link <> ''
), edges AS (
  SELECT DISTINCT url AS src, CASE
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN link LIKE '//%' THEN scheme || ':' || link
    WHEN link LIKE '/%' THEN scheme || '://' || host || link
    WHEN link LIKE '?%' OR link LIKE '#%' THEN scheme || '://' || host || path || link
    ELSE scheme || '://' || host || coalesce(nullif(regexp_extract(path, '(?s)^(.*/)', 1), ''), '/') || link END AS dst
  FROM based
), urls AS (
  SELECT DISTINCT url FROM (SELECT url FROM pages WHERE url IS NOT NULL UNION ALL SELECT src FROM edges UNION ALL SELECT dst FROM edges)
), parts AS (
  SELECT url, lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)) AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)) || regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS node
  FROM urls
), told AS (
  SELECT url, host, path, node, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY ALL
), near AS (
  SELECT a.node AS u, b.node AS v FROM edges JOIN parts a ON a.url = src JOIN parts b ON b.url = dst
), both_ways AS (
  SELECT u, v FROM near UNION SELECT v, u FROM near
), reach AS (
  SELECT u, u AS v FROM both_ways UNION SELECT reach.u, both_ways.v FROM reach JOIN both_ways ON reach.v = both_ways.u
), spread AS (
  SELECT u AS node, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict
  FROM reach JOIN told ON told.node = reach.v AND told.verdict IS NOT NULL GROUP BY u
)
SELECT page_id, coalesce(told.host, '') AS host, coalesce(told.path, '') AS path, told.rule,
  coalesce(told.verdict, CASE WHEN contains(pages.url, '://') THEN spread.verdict END, 'allow') AS verdict
FROM pages LEFT JOIN told USING (url) LEFT JOIN spread USING (node)
"""

# --- op3: near duplicates --------------------------------------------------------------------

SQL["op3_setsketch_neardup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY 1
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), root AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN root USING (doc_id) LEFT JOIN n USING (doc_id)
"""

# --- op9: exact top-k ------------------------------------------------------------------------

SQL["op9_threshold_top_k"] = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

# --- op10: repeated passages -----------------------------------------------------------------

SQL["op10_maximal_repeats"] = """
WITH d AS (
  SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents
), win AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s
  FROM (SELECT doc_id, h, unnest(generate_series(0, len(h) // 2 - 100)) AS p FROM d WHERE len(h) >= 200)
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM win) WHERE k > 1
), begun AS (
  SELECT doc_id, p, p - max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM later
), runs AS (
  SELECT doc_id, p, sum(CASE WHEN gap IS NULL OR gap > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM begun
), spans AS (
  SELECT doc_id, r, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY ALL
), kept AS (
  SELECT doc_id, r, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY r) AS next FROM spans
), cut AS (
  SELECT d.doc_id, count(r)::BIGINT AS n_spans, coalesce(sum(b - a), 0)::BIGINT AS n_removed,
    CASE WHEN count(r) = 0 THEN any_value(h) ELSE substr(any_value(h), 1, 2 * min(a)::BIGINT) || string_agg(
      CASE WHEN next IS NULL THEN substr(h, 2 * b + 1) ELSE substr(h, 2 * b + 1, 2 * (next - b)) END, '' ORDER BY r) END AS left_hex,
    any_value(len(h) // 2)::BIGINT AS n_bytes
  FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id
)
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(left_hex)) AS kept_sha256 FROM cut
"""

# --- op12: conversation repair ---------------------------------------------------------------

# An inserted turn never pays: deleting the pair of turns that holds it (and a leading system turn that would be
# left alone) costs 4 at most, against 5. So edits are keep, rerole and delete.
SQL["op12_audit_repair"] = r"""
WITH RECURSIVE crc(b, v, k) AS (
  SELECT b, b::BIGINT, 0 FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM crc WHERE k < 8
), codes AS (
  SELECT list(v ORDER BY b) AS c FROM crc WHERE k = 8
), hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda a, x: xor(a // 256, codes.c[xor(a % 256, x) + 1])), 4294967295) % 20 AS d
  FROM conversations, codes
), damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE d <> 0
), laid AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS bare FROM damaged
), judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM laid
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM judged GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, state, best.cost, best.audit, best.lines FROM (
    SELECT conv_id, i, state, arg_min({cost: cost, audit: audit, lines: lines}, {cost: cost, audit: audit}) AS best FROM (
      SELECT j.conv_id, j.i, e.b AS state, w.cost + e.c + CASE WHEN e.l <> 'D' AND coalesce(j.fault, '') = 'truncated' THEN 5 ELSE 0 END AS cost,
        w.audit || e.l AS audit,
        CASE e.l WHEN 'D' THEN w.lines WHEN 'K' THEN w.lines || [j.role || ':' || j.text]
          ELSE w.lines || [CASE e.b WHEN 2 THEN 'user:' ELSE 'assistant:' END || j.text] END AS lines
      FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
      JOIN (VALUES (0, 0, 'D', 2, ''), (1, 1, 'D', 2, ''), (2, 2, 'D', 2, ''), (3, 3, 'D', 2, ''),
        (0, 1, 'K', 0, 's'), (0, 2, 'K', 0, 'u'), (1, 2, 'K', 0, 'u'), (3, 2, 'K', 0, 'u'), (2, 3, 'K', 0, 'a'),
        (0, 2, 'R', 1, ''), (1, 2, 'R', 1, ''), (3, 2, 'R', 1, ''), (2, 3, 'R', 1, '')) e(a, b, l, c, ini)
      ON e.a = w.state AND (e.l <> 'K' OR e.ini = j.ini) AND (e.l = 'D' OR coalesce(j.fault, 'truncated') = 'truncated')
    ) GROUP BY conv_id, i, state)
), ended AS (
  SELECT conv_id, arg_min({cost: cost, audit: audit, lines: lines}, {cost: cost, audit: audit}) AS best
  FROM walk JOIN (SELECT conv_id AS c, max(i) AS n FROM judged GROUP BY 1) ON c IS NOT DISTINCT FROM conv_id AND i = n
  WHERE state IN (0, 3) GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
