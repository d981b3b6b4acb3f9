"""DuckDB SQL of the operators that SQL can express exactly, over the same tables. Brute force by joins; ids are unique there."""

from __future__ import annotations

OP1 = r"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, md5(array_to_string(w[k:k + 1], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS k FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(s, '' ORDER BY s)) AS class FROM shingles GROUP BY doc_id),
leads AS (SELECT class, min(doc_id) AS doc_id FROM sets GROUP BY class),
few AS (SELECT s.doc_id, s.s, z.n FROM shingles s JOIN leads USING (doc_id) JOIN sizes z USING (doc_id)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM few a JOIN few b ON a.s = b.s AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT s.doc_id, l.doc_id FROM sets s JOIN leads l USING (class) WHERE s.doc_id <> l.doc_id UNION SELECT l.doc_id, s.doc_id FROM sets s JOIN leads l USING (class) WHERE s.doc_id <> l.doc_id),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, least(d.doc_id, l.low) AS component_id, d.doc_id = least(d.doc_id, l.low) AS kept
FROM words d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id
"""

OP4 = r"""
WITH words AS (SELECT doc_id, text, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
items AS (SELECT DISTINCT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS part FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
texts AS (SELECT DISTINCT text, w FROM words),
runs AS (SELECT text, n, k, array_to_string(w[k:k + n - 1], ' ') AS part FROM (SELECT text, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM texts, lengths WHERE len(w) >= n)),
hits AS (SELECT r.text, r.n, r.k, i.item_id FROM runs r JOIN windows i ON i.n = r.n AND i.part = r.part),
hit AS (SELECT text, count(DISTINCT p) AS n_hit FROM (SELECT text, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT text, n, k FROM hits)) GROUP BY text),
found AS (SELECT text, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY text)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(f.n_items, 0)::BIGINT AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM words d LEFT JOIN hit h ON d.text = h.text LEFT JOIN found f ON d.text = f.text
"""

OP6 = r"""
WITH RECURSIVE vecs AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
usable AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM vecs WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(e.vec_id, l.low) AS component_id, e.vec_id = least(e.vec_id, l.low) AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
"""

OP9 = r"""
WITH words AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
runs AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 19], ' ')) AS part FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM words WHERE len(w) >= 20)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id, k) AS place FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS p FROM firsts WHERE place > 1),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (SELECT a.doc_id, string_agg(a.w[a.p], ' ' ORDER BY a.p) AS t FROM places a ANTI JOIN gone g ON a.doc_id = g.doc_id AND a.p = g.p GROUP BY a.doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(l.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words d LEFT JOIN lost l ON l.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
