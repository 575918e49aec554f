"""DuckDB SQL for the operators whose results SQL can express."""

from __future__ import annotations

#: Words are runs of other characters than six white-space ones; five of them an n-gram, and fewer one shorter n-gram.
_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

NGRAM_JACCARD_JOIN = f"""WITH RECURSIVE
w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 5 * k >= 4 * (a.n + b.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.x, r.c FROM r JOIN l ON l.y = r.doc_id),
c AS (SELECT doc_id, min(c) AS class_id FROM r GROUP BY 1),
m AS (SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY 1),
o AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) END AS copy_id FROM w)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, copy_id FROM c JOIN o USING (doc_id) LEFT JOIN m USING (doc_id)"""

SUFFIX_DEDUP = """WITH
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM d),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN 2 * (i + 100) <= length(h) THEN md5(substr(h, 2 * i + 1, 200)) END AS t FROM p),
f AS (SELECT doc_id, i, byte, t IS NOT NULL AND row_number() OVER (PARTITION BY t ORDER BY doc_id, i) > 1 AS dup FROM s),
g AS (SELECT doc_id, i, byte, bool_or(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS opens FROM g),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY 1)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)"""

EXACT_DEDUP = """WITH
d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (w ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)"""

ORACLE_SQL = {"op4_suffix_dedup": SUFFIX_DEDUP, "op9_ngram_jaccard_join": NGRAM_JACCARD_JOIN, "op13_exact_dedup": EXACT_DEDUP}
