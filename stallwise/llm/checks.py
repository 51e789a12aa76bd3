"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

MINHASH = rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
                 FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM words WHERE len(w) > 0) x),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
              JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
              GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
    reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d
    JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) c ON c.a = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id"""

DECONTAMINATION = rf"""WITH docs AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    items AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    windows AS (SELECT DISTINCT item_id, n, array_to_string(w[j : j + n - 1], ' ') AS words
                FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS j
                      FROM (SELECT item_id, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0) i) x),
    places AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS words
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                     FROM docs, (SELECT DISTINCT n FROM windows) s WHERE len(w) >= n) x),
    hits AS (SELECT doc_id, i, p.n, CAST(item_id AS VARCHAR) AS item FROM places p JOIN windows v ON v.n = p.n AND v.words = p.words),
    hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) h GROUP BY doc_id),
    found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
              FROM (SELECT DISTINCT doc_id, item FROM hits) h GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
    FROM docs d LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id"""

FILL_IN_MIDDLE = """WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h
                FROM documents),
    numbers AS (SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS h1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS h2,
                       CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4 FROM hashed),
    cut AS (SELECT *, least(h1, h2) AS low, greatest(h1, h2) AS high,
                   CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
                        WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
    parts AS (SELECT *, substr(t, 1, low) AS p, substr(t, low + 1, high - low) AS m, substr(t, high + 1) AS s FROM cut)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                  ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts"""
