"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""

_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS d FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY n, d) AS top FROM q)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to FROM m
"""

_NEAR = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 3], ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 3, 1) + 1)) AS i FROM w WHERE len(t) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
both AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, both.y FROM r JOIN both ON r.b = both.x)
SELECT a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id, a = min(b) AS kept FROM r LEFT JOIN n ON n.doc_id = a GROUP BY a
""".replace("both", "links")

ORACLES: dict[str, str] = {"op2_warc_zstd": _WARC, "op5_minhash": _NEAR}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Base columns of the licence scan: places where a phrase's words stand consecutively.
_LICENCE_BASE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS t FROM documents),
h AS (SELECT doc_id, t, list_filter(range(len(t)), lambda i: t[i + 1] = 'cc' AND t[i + 2] = 'by') AS a,
      list_filter(range(len(t)), lambda i: t[i + 1] = 'general' AND t[i + 2] = 'public' AND t[i + 3] = 'license') AS b,
      list_filter(range(len(t)), lambda i: t[i + 1] = 'all' AND t[i + 2] = 'rights' AND t[i + 3] = 'reserved') AS c FROM w)
SELECT doc_id, len(t) AS n_words, len(a) + len(b) + len(c) AS n_base, list_min(a || b || c) AS first_word, list_max(a || b || c) AS last_word,
       concat_ws(',', CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END) AS base_labels FROM h
"""

_QUALITY_BASE = """
WITH w AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
g AS (SELECT doc_id, i, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - 1)) AS i FROM w WHERE len(t) > 2)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
p AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) AS s(o) WHERE r.n > 1 GROUP BY doc_id),
c AS (SELECT doc_id, len(t) AS n_words, length(array_to_string(t, '')) AS word_chars, length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM w)
SELECT c.doc_id, n_words, word_chars, n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
       n_words < 50 OR 100 * coalesce(p.n, 0) > 50 * n_words AS base_failed FROM c LEFT JOIN p USING (doc_id)
"""

#: Targets: sources that stop are the first ones by cap over weight; the rest share one level.
_MIX_TARGETS = """
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
a AS (SELECT source, sum(size)::BIGINT AS n FROM s GROUP BY source),
b AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM a),
c AS (SELECT *, (sum(n) OVER () - coalesce(sum(3.0 * n) OVER (ORDER BY 3.0 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(w) OVER (ORDER BY 3.0 * n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM b),
d AS (SELECT arg_min(level, 3.0 * n / w) AS level FROM c WHERE level * w <= 3.0 * n),
t AS (SELECT source, n, least(3.0 * n, coalesce(d.level, 0) * w) AS target FROM c, d)
SELECT doc_id, size::BIGINT AS size, t.n AS source_size, round(target, 4) AS target FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
"""

_LINES = """
WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
y AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS own FROM x),
u AS (SELECT doc_id, i, own, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM y WHERE own <> ''),
w AS (SELECT doc_id, k, own || chr(10) || lead(own, 1) OVER o || chr(10) || lead(own, 2) OVER o AS g FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS r FROM w WHERE g IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, k + o AS k FROM f, (VALUES (0), (1), (2)) AS s(o) WHERE r > 1),
z AS (SELECT y.doc_id, y.i, y.line, max(u.k) OVER (PARTITION BY y.doc_id ORDER BY y.i) AS k FROM y LEFT JOIN u USING (doc_id, i)),
n AS (SELECT z.doc_id, string_agg(z.line, chr(10) ORDER BY z.i) FILTER (WHERE gone.k IS NULL) AS text FROM z LEFT JOIN gone USING (doc_id, k) GROUP BY z.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(n.text, '') END AS text, CASE WHEN d.text IS NOT NULL THEN length(d.text) - length(coalesce(n.text, '')) ELSE 0 END AS n_removed
FROM documents d LEFT JOIN n USING (doc_id)
"""

_EDITED = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first(t) OVER (ORDER BY doc_id)) AS after, length(t) // 2 AS half FROM d)
SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - half) || left(after, half)) AS edited_sha256 FROM n
"""

_BYTES = """
SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents
"""

ORACLES |= {
    "op7_line_dedup": _LINES,
    "license_base": _LICENCE_BASE,
    "quality_base": _QUALITY_BASE,
    "mix_targets": _MIX_TARGETS,
    "fingerprint_edits": _EDITED,
    "decoded_bytes": _BYTES,
}
