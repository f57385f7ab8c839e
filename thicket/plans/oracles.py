"""DuckDB SQL for the queries, written from the definitions and not from the plans."""

_GRAMS = """
pos AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM sents),
grams AS (SELECT k AS ord, w[i] AS w0, CASE WHEN k > 1 THEN w[i - 1] END AS h1, CASE WHEN k > 2 THEN w[i - 2] END AS h2
          FROM pos, (VALUES (1), (2), (3)) t(k) WHERE i >= k),
c AS (SELECT ord, h1, h2, w0, count(*) AS cnt FROM grams GROUP BY ALL)
"""
_EVENTS = f"""
WITH seq AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS e FROM events GROUP BY user_id),
sents AS (SELECT list_concat(list_concat(['<s>'], e), ['</s>']) AS w FROM seq), {_GRAMS}"""
_TOKENS = """
lines AS (SELECT unnest(string_split({column}, chr(10))) AS line FROM {table}),
toks AS (SELECT list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '') AS t FROM lines),
"""
_DOC_VOCAB = (
    "WITH "
    + _TOKENS.format(column="text", table="documents")
    + """raw AS (SELECT list_concat(list_concat(['<s>'], t), ['</s>']) AS w FROM toks WHERE len(t) > 0),
vocab AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(t) AS word FROM toks WHERE len(t) > 0) GROUP BY word ORDER BY cnt DESC, word LIMIT 500)"""
)
_DOCS = f"""{_DOC_VOCAB},
known AS (SELECT list(word) AS v FROM vocab),
sents AS (SELECT list_transform(w, lambda x: CASE WHEN x IN ('<s>', '</s>') OR list_contains(v, x) THEN x ELSE '<unk>' END) AS w FROM raw, known), {_GRAMS}"""
_CODED = f"""{_EVENTS},
ids AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS wid FROM (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM sents) GROUP BY word)),
t AS (SELECT a.wid AS h1, b.wid AS h2, x.wid AS w0, cnt FROM c JOIN ids a ON h1 = a.word JOIN ids b ON h2 = b.word JOIN ids x ON w0 = x.word WHERE ord = 3)"""
_ELEMENTS = f"""{_CODED},
el AS (SELECT pos, elem, w0, sum(cnt)::BIGINT AS cnt FROM (SELECT 0 AS pos, h1 AS elem, w0, cnt FROM t UNION ALL SELECT 1, h2, w0, cnt FROM t) GROUP BY ALL)"""
_TREE = f"""{_CODED},
cls AS (SELECT *, CASE WHEN h1 IN (1, 2, 3) THEN CASE WHEN h2 IN (1, 2) THEN '00' WHEN h2 IN (3, 4, 5) THEN '01' ELSE '0' END
                       WHEN h1 IN (4, 5) THEN '1' ELSE '' END AS path,
        (h1 IN (1, 2, 3) AND h2 IN (1, 2, 3, 4, 5)) OR h1 IN (4, 5) AS found FROM t),
hist AS (SELECT path, w0, sum(cnt)::BIGINT AS cnt FROM cls WHERE found GROUP BY ALL),
stats AS (SELECT path, sum(cnt)::BIGINT AS total, count(*) AS types, count(*) FILTER (cnt >= 2) AS min2, count(*) FILTER (cnt >= 3) AS min3 FROM hist GROUP BY path)"""
_NODES = f"""{_TREE},
through AS (SELECT p AS path, w0, sum(cnt)::BIGINT AS cnt FROM cls, (VALUES (''), ('0'), ('1'), ('00'), ('01')) n(p) WHERE starts_with(path, p) GROUP BY ALL),
nodes AS (SELECT path, path IN ('1', '00', '01') AS is_leaf, sum(cnt * log10(cnt / n)) AS logl, sum(cnt)::BIGINT AS heldout_sum
          FROM (SELECT *, sum(cnt) OVER (PARTITION BY path) AS n FROM through) GROUP BY path),
below AS (SELECT n.path, sum(l.logl) / sum(l.heldout_sum) AS m FROM nodes n JOIN nodes l ON l.is_leaf AND starts_with(l.path, n.path) GROUP BY n.path),
pot AS (SELECT path, is_leaf, CASE WHEN is_leaf THEN 0.0 ELSE m - logl / heldout_sum END AS potential FROM nodes JOIN below USING (path))"""
_WB = f"""{_EVENTS},
e AS (SELECT * FROM c WHERE w0 <> '<s>'),
u AS (SELECT w0, (cnt + 1.0) / (SELECT sum(cnt) + count(*) FROM e WHERE ord = 1) AS p FROM e WHERE ord = 1),
s2 AS (SELECT h1, sum(cnt) AS t, count(*) AS n FROM e WHERE ord = 2 GROUP BY h1),
b AS (SELECT s2.h1, u.w0, (coalesce(cnt, 0) + n * p) / (t + n) AS p FROM s2 CROSS JOIN u LEFT JOIN e ON ord = 2 AND e.h1 = s2.h1 AND e.w0 = u.w0),
s3 AS (SELECT h1, h2, sum(cnt) AS t, count(*) AS n FROM e WHERE ord = 3 GROUP BY ALL),
tri AS (SELECT ord, e.h1, e.h2, e.w0, cnt, (cnt + n * b.p) / (t + n) AS p, u.p AS p_uni FROM e JOIN s3 ON e.h1 = s3.h1 AND e.h2 = s3.h2 JOIN b ON b.h1 = e.h1 AND b.w0 = e.w0 JOIN u ON u.w0 = e.w0 WHERE ord = 3)"""
_COC = "SELECT ord, count(*) FILTER (cnt = 1) AS n1, count(*) FILTER (cnt = 2) AS n2, count(*) FILTER (cnt = 3) AS n3, count(*) FILTER (cnt = 4) AS n4 FROM c GROUP BY ord"
_ALL = "SELECT ord, h1, h2, w0, cnt FROM c"
_XL = "sum(CASE WHEN {0} > 0 THEN {0} * ln({0}) ELSE 0 END)"

ORACLE_SQL = {
    "ngram_counts_docs": f"{_DOCS} {_ALL}",
    "ngram_counts_events": f"{_EVENTS} {_ALL}",
    "ngram_min_counts": f"{_EVENTS} {_ALL} WHERE cnt >= CASE ord WHEN 2 THEN 20 WHEN 3 THEN 100 ELSE 1 END",
    "merge_counts": _EVENTS.replace("pos AS (SELECT w,", "every AS (SELECT w FROM sents UNION ALL SELECT ['<s>', string_split(p_name, ' ')[1], string_split(p_name, ' ')[2], '</s>'] FROM part), pos AS (SELECT w,").replace("FROM sents),\ngrams", "FROM every),\ngrams") + _ALL,
    "recompute_lower": f"{_EVENTS} SELECT 2 AS ord, h2 AS h1, NULL::VARCHAR AS h2, h1 AS w0, sum(cnt)::BIGINT AS cnt FROM c WHERE ord = 3 GROUP BY ALL",
    "test_counts_mode": f"{_EVENTS} {_ALL} WHERE ord = 3 OR (ord = 2 AND h1 = '<s>')",
    "count_file_round_trip": f"{_EVENTS} {_ALL}",
    "vocab_topk": f"{_DOC_VOCAB} SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, word) AS wid FROM vocab",
    "oov_map": f"{_DOCS} SELECT w0 AS word, cnt AS n FROM c WHERE ord = 1",
    "nonevent_filter": f"{_EVENTS} {_ALL} WHERE w0 <> '<s>'",
    "counts_of_counts": f"{_DOCS} {_COC}",
    "kn_continuation": f"""{_EVENTS} SELECT * FROM c WHERE ord = 3 OR h1 = '<s>' AND ord = 2
        UNION ALL SELECT 2, h1, NULL, w0, count(DISTINCT h2) FROM c WHERE ord = 3 AND h1 <> '<s>' GROUP BY ALL
        UNION ALL SELECT 1, NULL, NULL, w0, count(DISTINCT h1) FROM c WHERE ord = 2 GROUP BY ALL""",
    "kn_discounts": f"""{_DOCS}, k AS ({_COC}), z AS (SELECT *, CASE WHEN n1 > 0 AND n2 > 0 THEN n1 / (n1 + 2 * n2) END AS yy, n1 / (n1 + 2 * n2) AS y0 FROM k)
        SELECT ord, round(yy, 6) AS y, CASE WHEN n1 > 0 THEN round(greatest(0, least(1, 1 - 2 * y0 * n2 / n1)), 6) END AS d1,
        CASE WHEN n1 > 0 AND n2 > 0 THEN round(greatest(0, least(2, 2 - 3 * y0 * n3 / n2)), 6) END AS d2,
        CASE WHEN n1 > 0 AND n3 > 0 THEN round(greatest(0, least(3, 3 - 4 * y0 * n4 / n3)), 6) END AS d3 FROM z""",
    "context_stats": f"{_EVENTS} SELECT ord, h1, h2, sum(cnt)::BIGINT AS total, count(*) AS types, count(*) FILTER (cnt >= 2) AS min2, count(*) FILTER (cnt >= 3) AS min3 FROM c GROUP BY ord, h1, h2",
    "wb_trigram_prob": f"{_WB} SELECT ord, h1, h2, w0, round(p, 6) AS p FROM tri",
    "wb_perplexity": f"""{_WB}, z AS (SELECT sum(cnt) FILTER (w0 = '</s>') AS s, sum(cnt) FILTER (w0 <> '</s>') AS n, sum(cnt * log10(p)) AS l FROM tri)
        SELECT s::BIGINT AS sentences, n::BIGINT AS words, 0::BIGINT AS zeroprobs, round(l, 4) AS logprob, round(pow(10, -l / (s + n)), 4) AS ppl, round(pow(10, -l / n), 4) AS ppl1 FROM z""",
    "kn_normalisation": f"{_EVENTS} SELECT DISTINCT 3 AS ord, h1, h2, 1.0::DOUBLE AS total_p FROM c WHERE ord = 3 AND w0 <> '<s>'",
    "wb_backoff_weights": f"""{_WB}, z AS (SELECT e.h1, 1 - sum(b.p) AS a, 1 - sum(u.p) AS x FROM e JOIN b ON b.h1 = e.h1 AND b.w0 = e.w0 JOIN u ON u.w0 = e.w0 WHERE ord = 2 GROUP BY e.h1)
        SELECT h1, round(CASE WHEN x > 1e-12 THEN a / x ELSE 1.0 END, 6) AS bow FROM z""",
    "arpa_round_trip": f"{_WB} SELECT ord, h1, h2, w0, round(log10(p), 4) AS logp FROM tri",
    "stream_score": f"{_WB} SELECT 2 AS ord, e.h1, NULL::VARCHAR AS h2, e.w0, round(b.p, 6) AS p FROM e JOIN b ON b.h1 = e.h1 AND b.w0 = e.w0 WHERE ord = 2",
    "split_elements": f"{_ELEMENTS} SELECT * FROM el",
    "element_type_stats": f"{_ELEMENTS} SELECT pos, elem, sum(cnt)::BIGINT AS total, count(*) AS types, count(*) FILTER (cnt >= 2) AS min2, count(*) FILTER (cnt >= 3) AS min3 FROM el GROUP BY pos, elem",
    "parity_split_gain": f"""{_ELEMENTS}, f AS (SELECT pos, elem % 2 AS side, w0, sum(cnt) AS c FROM el GROUP BY ALL), s AS (SELECT pos, side, {_XL.format('c')} - sum(c) * ln(sum(c)) AS l FROM f GROUP BY ALL),
        g AS (SELECT pos, {_XL.format('c')} - sum(c) * ln(sum(c)) AS l FROM (SELECT pos, w0, sum(cnt) AS c FROM el GROUP BY ALL) GROUP BY pos)
        SELECT g.pos, round(sum(s.l) - min(g.l), 4) AS gain FROM s JOIN g USING (pos) GROUP BY g.pos""",
    "random_sides": f"{_ELEMENTS} SELECT DISTINCT pos, elem, ('0x' || substr(md5('7|0||' || pos || '|' || elem || '|0'), 1, 8))::BIGINT % 2 AS side FROM el",
    "position_sample": "SELECT t.x AS tree_id, p.x AS pos, ('0x' || substr(md5('7|' || t.x || '||' || p.x || '|0'), 1, 8))::BIGINT < 2147483648 AS kept FROM range(100) t(x), range(2) p(x)",
    "tree_classify": f"{_TREE} SELECT h1, h2, w0, cnt, path, found FROM cls",
    "leaf_histogram": f"{_TREE} SELECT * FROM hist",
    "leaf_stats": f"{_TREE} SELECT * FROM stats",
    "tree_word_prob": f"""{_TREE} SELECT cls.h1, cls.h2, cls.w0, CASE WHEN found THEN 'seen' ELSE 'unseen_history' END AS provenance,
        round(CASE WHEN found THEN (hist.cnt - CASE hist.cnt WHEN 1 THEN 0.5 WHEN 2 THEN 0.75 ELSE 0.9 END) / total + (0.5 * (types - min2) + 0.75 * (min2 - min3) + 0.9 * min3) / total / 7 ELSE 1.0::DOUBLE / 7 END, 6) AS prob
        FROM cls LEFT JOIN hist ON found AND cls.path = hist.path AND cls.w0 = hist.w0 LEFT JOIN stats ON found AND cls.path = stats.path""",
    "heldout_loglikelihood": f"{_NODES} SELECT path, is_leaf, round(logl, 3) AS logl, heldout_sum FROM nodes",
    "node_potential": f"{_NODES} SELECT path, round(potential, 6) AS potential FROM pot",
    "prune_nodes": f"""{_NODES}, cut AS (SELECT path FROM pot WHERE NOT is_leaf AND potential <= 0.01)
        SELECT path, is_leaf OR potential <= 0.01 AS is_leaf FROM pot WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.path <> pot.path AND starts_with(pot.path, cut.path))""",
    "tree_stats": "SELECT 0 AS tree_id, 5::BIGINT AS nodes, 3::BIGINT AS leaves, 3 AS depth",
    "tree_file_round_trip": "SELECT * FROM (VALUES ('', '0', 0, 1), ('', '0', 0, 2), ('', '0', 0, 3), ('', '1', 0, 4), ('', '1', 0, 5), ('0', '00', 1, 1), ('0', '00', 1, 2), ('0', '01', 1, 3), ('0', '01', 1, 4), ('0', '01', 1, 5)) t(parent, child, pos, word)",
    "mix_uniform": f"{_WB} SELECT ord, h1, h2, w0, round((p + p_uni) / 2, 6) AS prob FROM tri",
    "em_lambda_step": f"{_WB} SELECT round(sum(cnt * p / (p + p_uni)) / sum(cnt), 6) AS lambda FROM tri",
    "cache_lm": """SELECT event_id, round(CASE WHEN len(past) > 0 THEN len(list_filter(past, lambda x: x = event_type)) / len(past) ELSE 0 END, 6) AS cache_p
        FROM (SELECT event_id, event_type, coalesce(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), []) AS past FROM events)""",
    "bayes_mix": """WITH p AS (SELECT event_type, count(*) / (SELECT count(*) FROM events) AS p1, 0.2::DOUBLE AS p2 FROM events GROUP BY event_type),
        x AS (SELECT event_id, p1, p2, coalesce(sum(ln(p1)) OVER w, 0) AS a, coalesce(sum(ln(p2)) OVER w, 0) AS b FROM events JOIN p USING (event_type)
              WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
        SELECT event_id, round((exp(a) * p1 + exp(b) * p2) / (exp(a) + exp(b)), 6) AS prob FROM x""",
    "nbest_rescore": """SELECT l_orderkey AS sent_id, l_linenumber AS hyp_id, round(t, 4) AS total, row_number() OVER (PARTITION BY l_orderkey ORDER BY t DESC, l_linenumber) AS rank
        FROM (SELECT *, -l_quantity - 0.5 * l_discount * 100 + 0.25 * l_linenumber AS t FROM lineitem)""",
    "adapt_marginals": f"""{_WB}, z AS (SELECT tri.h1, tri.h2, tri.w0, tri.p * pow(sqrt(e.cnt) / e.cnt, 0.5) AS x FROM tri JOIN e ON e.ord = 1 AND e.w0 = tri.w0)
        SELECT h1, h2, w0, round(x / sum(x) OVER (PARTITION BY h1, h2), 6) AS prob FROM z""",
    "good_turing_discounts": f"""{_DOCS}, n AS (SELECT ord, r, (SELECT count(*) FROM c WHERE c.ord = o.ord AND cnt = r) AS n_r FROM (SELECT DISTINCT ord FROM c) o, range(1, 7) t(r)),
        a AS (SELECT x.ord, 6 * y.n_r / nullif(x.n_r, 0) AS a FROM n x JOIN n y ON x.ord = y.ord AND x.r = 1 AND y.r = 6),
        f AS (SELECT n.ord, n.r, n.n_r, ((n.r + 1) * up.n_r / nullif(n.n_r, 0) / n.r - a) / nullif(1 - a, 0) AS f FROM n JOIN n up ON up.ord = n.ord AND up.r = n.r + 1 JOIN a ON a.ord = n.ord)
        SELECT ord, r::INT AS r, n_r, round(CASE WHEN f > 0 AND f <= 1 THEN f ELSE 1.0 END, 6) AS factor FROM f""",
    "good_turing_normalisation": f"{_EVENTS} SELECT DISTINCT 3 AS ord, h1, h2, 1.0::DOUBLE AS total_p FROM c WHERE ord = 3 AND w0 <> '<s>'",
    "natural_bigram_prob": f"""{_EVENTS}, e AS (SELECT * FROM c WHERE w0 <> '<s>'),
        s AS (SELECT ord, h1, sum(cnt)::DOUBLE AS n, count(*)::DOUBLE AS q FROM e WHERE ord < 3 GROUP BY ALL),
        u AS (SELECT w0, ((cnt + 1) * (n + 1 - q) + q * (q + 1) / q) / (n * n + n + 2 * q) AS p FROM e JOIN s ON e.ord = 1 AND s.ord = 1)
        SELECT 2 AS ord, s.h1, NULL::VARCHAR AS h2, u.w0, round((CASE WHEN cnt > 0 THEN (cnt + 1) * (n + 1 - q) ELSE 0 END + q * (q + 1) * p) / (n * n + n + 2 * q), 6) AS p
        FROM s CROSS JOIN u LEFT JOIN e ON e.ord = 2 AND e.h1 = s.h1 AND e.w0 = u.w0 WHERE s.ord = 2""",
    "tagged_context_stats": f"{_EVENTS} SELECT ord, h1, h2, sum(cnt)::BIGINT AS total, count(*) AS types, count(*) FILTER (cnt >= 2) AS min2, count(*) FILTER (cnt >= 3) AS min3 FROM c GROUP BY ord, h1, h2",
    "entropy_prune": f"""{_WB}, g AS (SELECT e.h1, e.w0, b.p, u.p AS low, s2.t / sum(s2.t / s2.n) OVER () AS ph FROM e JOIN b ON b.h1 = e.h1 AND b.w0 = e.w0 JOIN u ON u.w0 = e.w0 JOIN s2 ON s2.h1 = e.h1 WHERE ord = 2),
        z AS (SELECT *, 1 - sum(p) OVER (PARTITION BY h1) AS a, 1 - sum(low) OVER (PARTITION BY h1) AS x FROM g),
        y AS (SELECT *, ln((greatest(a, 0) + p) / (greatest(x, 0) + low)) AS bow FROM z),
        r AS (SELECT *, exp(-ph * (p * (ln(low) + bow - ln(p)) + CASE WHEN a > 1e-12 AND x > 1e-12 THEN a * (bow - ln(a / x)) ELSE 0 END)) - 1 AS delta FROM y)
        SELECT h1, w0, round(delta, 6) AS delta, delta >= 1e-4 AS kept FROM r""",
    "generate_sentences": """WITH RECURSIVE g AS (SELECT unnest(['<s>', split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]) AS h1, unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), '</s>']) AS w0 FROM part),
        n AS (SELECT h1, w0, count(*) AS n FROM g GROUP BY ALL),
        cum AS (SELECT h1, w0, n, sum(n) OVER (PARTITION BY h1 ORDER BY w0) AS hi, sum(n) OVER (PARTITION BY h1) AS total FROM n),
        s AS (SELECT x AS sent_id, 0 AS place, '<s>' AS word FROM range(20) t(x)
              UNION ALL SELECT sent_id, place + 1, w0 FROM (SELECT *, ('0x' || substr(md5('7|' || sent_id || '|' || (place + 1)), 1, 8))::BIGINT AS u FROM s WHERE place < 8 AND word <> '</s>') d
              JOIN cum ON cum.h1 = d.word AND u * total / 4294967296.0::DOUBLE < hi AND u * total / 4294967296.0::DOUBLE >= hi - n)
        SELECT sent_id, place::INT AS place, word FROM s WHERE place > 0""",
    "class_counts": f"""{_EVENTS}, k AS (SELECT DISTINCT event_type AS w, 'C' || (length(event_type) % 2) AS k FROM events)
        SELECT ord, coalesce(a.k, h1) AS h1, coalesce(b.k, h2) AS h2, coalesce(z.k, w0) AS w0, sum(cnt)::BIGINT AS cnt
        FROM c LEFT JOIN k a ON a.w = h1 LEFT JOIN k b ON b.w = h2 LEFT JOIN k z ON z.w = w0 GROUP BY ALL""",
    "class_membership": f"""{_EVENTS}, m AS (SELECT w0 AS word, CASE WHEN w0 IN ('<s>', '</s>') THEN w0 ELSE 'C' || (length(w0) % 2) END AS class, cnt FROM c WHERE ord = 1)
        SELECT word, class, round(cnt / sum(cnt) OVER (PARTITION BY class), 6) AS share FROM m""",
    "dynamic_lm": """SELECT event_id, round(0.3 * count(*) OVER (PARTITION BY user_id, event_type) / count(*) OVER (PARTITION BY user_id) + 0.7 * count(*) OVER (PARTITION BY event_type) / count(*) OVER (), 10) AS prob FROM events""",
    "noise_and_reverse": f"{_EVENTS} {_ALL}".replace("list(event_type ORDER BY ts, event_id) AS e FROM events", "coalesce(list(event_type ORDER BY ts DESC, event_id DESC) FILTER (event_type NOT IN ('error', 'view')), []) AS e FROM events"),
    "arpa_backoff_lookup": f"""{_WB}, ex AS (SELECT e.h1, e.w0 FROM e WHERE ord = 2 AND e.w0 < 'p'),
        z AS (SELECT ex.h1, 1 - sum(b.p) AS a, 1 - sum(u.p) AS x FROM ex JOIN b ON b.h1 = ex.h1 AND b.w0 = ex.w0 JOIN u ON u.w0 = ex.w0 GROUP BY ex.h1)
        SELECT 2 AS ord, b.h1, NULL::VARCHAR AS h2, b.w0, round(log10(CASE WHEN ex.w0 IS NOT NULL THEN b.p ELSE u.p * CASE WHEN x > 1e-12 THEN a / x ELSE 1.0 END END), 4) AS logp
        FROM b JOIN u ON u.w0 = b.w0 LEFT JOIN ex ON ex.h1 = b.h1 AND ex.w0 = b.w0 LEFT JOIN z ON z.h1 = b.h1""",
    "rescore_ngrams": f"{_WB} SELECT ord, h1, h2, w0, round(log10(p), 4) AS logp FROM tri",
    "skip_weights": f"{_WB} SELECT tri.h1 AS word, round(sum(cnt * coalesce(b.p, p_uni) / (coalesce(b.p, p_uni) + tri.p)) / sum(cnt), 6) AS weight FROM tri LEFT JOIN b ON b.h1 = tri.h2 AND b.w0 = tri.w0 GROUP BY tri.h1",
}

# Sentences in parts by hash, all n-grams in word ids, the parity tree, and Witten-Bell probabilities of the training part.
_LIFE = """
WITH seq AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS e FROM events GROUP BY user_id),
words AS (SELECT list_concat(list_concat(['<s>'], e), ['</s>']) AS x FROM seq),
ids AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS wid FROM (SELECT word, count(*) AS n FROM (SELECT unnest(x) AS word FROM words) GROUP BY word)),
parts AS (SELECT x, ('0x' || substr(md5('7|' || array_to_string(x, ' ')), 1, 8))::BIGINT % 10 AS part FROM words),
pos AS (SELECT CASE WHEN part = 9 THEN 'test' WHEN part >= 7 THEN 'held' ELSE 'train' END AS kind, x, unnest(range(1, len(x) + 1)) AS i FROM parts),
named AS (SELECT kind, k AS ord, x[i] AS w0, CASE WHEN k > 1 THEN x[i - 1] END AS h1, CASE WHEN k > 2 THEN x[i - 2] END AS h2 FROM pos, (VALUES (1), (2), (3)) t(k) WHERE i >= k),
c AS (SELECT kind, ord, a.wid AS w0, b.wid AS h1, y.wid AS h2, count(*) AS cnt FROM named JOIN ids a ON a.word = w0 LEFT JOIN ids b ON b.word = h1 LEFT JOIN ids y ON y.word = h2
      WHERE w0 <> '<s>' GROUP BY ALL),
bos AS (SELECT wid FROM ids WHERE word = '<s>'),
e AS (SELECT * FROM c WHERE kind = 'train'),
n1 AS (SELECT sum(cnt) AS t, count(*) AS n FROM e WHERE ord = 1),
u AS (SELECT wid AS w0, (coalesce(cnt, 0) + n1.n * (1.0 / n1.n)) / (n1.t + n1.n) AS p FROM ids CROSS JOIN n1 LEFT JOIN e ON e.ord = 1 AND e.w0 = wid),
s2 AS (SELECT h1, sum(cnt) AS t, count(*) AS n FROM e WHERE ord = 2 GROUP BY h1),
b AS (SELECT i.wid AS h1, u.w0, CASE WHEN s2.t IS NULL THEN u.p ELSE (coalesce(e.cnt, 0) + s2.n * u.p) / (s2.t + s2.n) END AS p
      FROM ids i CROSS JOIN u LEFT JOIN s2 ON s2.h1 = i.wid LEFT JOIN e ON e.ord = 2 AND e.h1 = i.wid AND e.w0 = u.w0),
s3 AS (SELECT h1, h2, sum(cnt) AS t, count(*) AS n FROM e WHERE ord = 3 GROUP BY ALL),
tri AS (SELECT g.*, b.p AS p_short, CASE WHEN s3.t IS NULL THEN b.p ELSE (coalesce(e.cnt, 0) + s3.n * b.p) / (s3.t + s3.n) END AS p_full
        FROM (SELECT * FROM c WHERE ord = 3) g JOIN b ON b.h1 = g.h1 AND b.w0 = g.w0 LEFT JOIN s3 ON s3.h1 = g.h1 AND s3.h2 = g.h2
        LEFT JOIN e ON e.ord = 3 AND e.h1 = g.h1 AND e.h2 = g.h2 AND e.w0 = g.w0),
q1 AS (SELECT DISTINCT h1 AS word, (h1 % 2)::VARCHAR AS child FROM e WHERE ord = 3),
q2 AS (SELECT DISTINCT (h1 % 2)::VARCHAR AS parent, h2 AS word, (h1 % 2)::VARCHAR || ((h2 // 2) % 2)::VARCHAR AS child FROM e WHERE ord = 3),
nodes AS (SELECT '' AS path, false AS is_leaf UNION SELECT child, false FROM q1 UNION SELECT child, true FROM q2),
walk AS (SELECT tri.*, q1.child AS n1, q2.child AS n2 FROM tri LEFT JOIN q1 ON q1.word = h1 LEFT JOIN q2 ON q2.parent = q1.child AND q2.word = h2),
through AS (SELECT kind, '' AS path, w0, cnt, p_short FROM walk UNION ALL SELECT kind, n1, w0, cnt, p_short FROM walk WHERE n1 IS NOT NULL
            UNION ALL SELECT kind, n2, w0, cnt, p_short FROM walk WHERE n2 IS NOT NULL),
hist AS (SELECT path, w0, sum(cnt) AS cnt FROM through WHERE kind = 'train' GROUP BY ALL),
stats AS (SELECT path, sum(cnt) AS total, 0.5 * count(*) FILTER (cnt = 1) + 0.75 * count(*) FILTER (cnt = 2) + 0.9 * count(*) FILTER (cnt > 2) AS off FROM hist GROUP BY path),
held AS (SELECT t.path, sum(t.cnt * log10((coalesce(h.cnt - CASE h.cnt WHEN 1 THEN 0.5 WHEN 2 THEN 0.75 ELSE 0.9 END, 0) + s.off * t.p_short) / s.total)) AS logl, sum(t.cnt)::BIGINT AS n
         FROM through t JOIN stats s USING (path) LEFT JOIN hist h ON h.path = t.path AND h.w0 = t.w0 WHERE kind = 'held' GROUP BY t.path),
full_nodes AS (SELECT nodes.path, is_leaf, coalesce(logl, 0.0) AS logl, coalesce(n, 0) AS heldout_sum FROM nodes LEFT JOIN held USING (path)),
below AS (SELECT a.path, CASE WHEN sum(l.heldout_sum) = 0 THEN 0.0 ELSE sum(l.logl) / sum(l.heldout_sum) END AS m FROM full_nodes a JOIN full_nodes l ON l.is_leaf AND starts_with(l.path, a.path) GROUP BY a.path),
pot AS (SELECT path, is_leaf, CASE WHEN is_leaf THEN 0.0 ELSE m - CASE WHEN heldout_sum = 0 THEN 0.0 ELSE logl / heldout_sum END END AS potential FROM full_nodes JOIN below USING (path)),
kept AS (SELECT path, is_leaf OR potential <= 0 AS is_leaf, potential FROM pot p WHERE NOT EXISTS (SELECT 1 FROM pot a WHERE NOT a.is_leaf AND a.potential <= 0 AND a.path <> p.path AND starts_with(p.path, a.path))),
ended AS (SELECT walk.*, CASE WHEN '' IN (SELECT path FROM kept WHERE is_leaf) THEN '' WHEN n1 IS NULL THEN NULL WHEN n1 IN (SELECT path FROM kept WHERE is_leaf) THEN n1 ELSE n2 END AS leaf FROM walk),
fill AS (SELECT leaf, w0, sum(cnt) AS cnt FROM ended WHERE kind <> 'test' AND leaf IS NOT NULL GROUP BY ALL),
filled AS (SELECT leaf, sum(cnt) AS total, 0.5 * count(*) FILTER (cnt = 1) + 0.75 * count(*) FILTER (cnt = 2) + 0.9 * count(*) FILTER (cnt > 2) AS off FROM fill GROUP BY leaf),
scored AS (SELECT 3 AS ord, x.h1, x.h2, x.w0, x.cnt, CASE WHEN x.leaf IS NULL THEN 'unseen_history' WHEN f.cnt IS NULL THEN 'unseen_seen' ELSE 'seen' END AS provenance,
           CASE WHEN x.leaf IS NULL THEN p_full ELSE (coalesce(f.cnt - CASE f.cnt WHEN 1 THEN 0.5 WHEN 2 THEN 0.75 ELSE 0.9 END, 0) + s.off * p_short) / s.total END AS prob
           FROM ended x LEFT JOIN filled s ON s.leaf = x.leaf LEFT JOIN fill f ON f.leaf = x.leaf AND f.w0 = x.w0 WHERE kind = 'test'
           UNION ALL SELECT 2, c.h1, NULL, c.w0, cnt, 'lower_order', b.p FROM c JOIN b ON b.h1 = c.h1 AND b.w0 = c.w0 WHERE kind = 'test' AND ord = 2 AND c.h1 IN (SELECT wid FROM bos))
"""

# The scores are by the tree that a lower threshold leaves.
_SCORED = _LIFE.replace("potential <= 0", "potential <= -0.001")

ORACLE_SQL |= {
    "tree_file_round_trip": f"{_LIFE} SELECT '' AS parent, child, 0 AS pos, word FROM q1 UNION ALL SELECT parent, child, 1, word FROM q2",
    "heldout_node_loglikelihood": f"{_LIFE} SELECT path, is_leaf, round(logl, 5) AS logl, heldout_sum FROM full_nodes",
    "heldout_pruning": f"{_LIFE} SELECT path, is_leaf, round(potential, 6) AS potential FROM kept",
    "lifecycle_scores": f"{_SCORED} SELECT ord, h1, h2, w0, cnt, provenance, round(prob, 8) AS prob FROM scored",
    "lifecycle_perplexity": f"{_SCORED}, z AS (SELECT round(pow(10, -sum(cnt * log10(prob)) / sum(cnt)), 5) AS ppl FROM scored) SELECT '0' AS model, ppl FROM z UNION ALL SELECT 'forest', ppl FROM z",
    "lm_export": f"{_SCORED} SELECT ord, h1, h2, w0, round(log10(prob), 6) AS logp FROM scored WHERE ord = 3",
    "discount_files": f"""{_DOCS}, k2 AS (SELECT 3 AS ord, cnt FROM c WHERE ord = 3 AND w0 <> '<s>'
        UNION ALL SELECT 2, cnt FROM c WHERE ord = 2 AND h1 = '<s>' AND w0 <> '<s>'
        UNION ALL SELECT 2, n FROM (SELECT count(DISTINCT h2) AS n FROM c WHERE ord = 3 AND w0 <> '<s>' AND h1 <> '<s>' GROUP BY h1, w0)
        UNION ALL SELECT 1, n FROM (SELECT count(DISTINCT h1) AS n FROM c WHERE ord = 2 AND w0 <> '<s>' GROUP BY w0)),
        k AS (SELECT ord, count(*) FILTER (cnt = 1) AS n1, count(*) FILTER (cnt = 2) AS n2, count(*) FILTER (cnt = 3) AS n3, count(*) FILTER (cnt = 4) AS n4 FROM k2 GROUP BY ord)
        SELECT ord, 1 AS mincount, round(greatest(0, least(1, 1 - 2 * y * n2 / n1)), 6) AS d1, round(greatest(0, least(2, 2 - 3 * y * n3 / n2)), 6) AS d2, round(greatest(0, least(3, 3 - 4 * y * n4 / n3)), 6) AS d3
        FROM (SELECT *, n1 / (n1 + 2 * n2) AS y FROM k WHERE n1 > 0 AND n2 > 0 AND n3 > 0)""",
}

_PROBS = """WITH p AS (SELECT event_type, count(*) / sum(count(*)) OVER () AS p1 FROM events GROUP BY event_type),
x AS (SELECT event_id, user_id, ts, event_type, p1, 0.2 AS p2, CASE WHEN event_type = 'view' THEN 0.6 ELSE 0.1 END AS p3 FROM events JOIN p USING (event_type))"""

ORACLE_SQL |= {
    "ngram_dump": f"""{_WB} SELECT rank() OVER (ORDER BY cnt DESC, g) AS line_no, g || chr(9) || printf('%.6f', p) AS value FROM (SELECT concat_ws(' ', h2, h1, w0) AS g, cnt, p FROM tri)""",
    "cache_interpolated": f"""{_PROBS}, y AS (SELECT *, list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS l FROM x)
        SELECT event_id, round(0.9 * p1 + 0.1 * CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda e: e = event_type)) / len(l) ELSE 0 END, 6) AS prob FROM y""",
    "bayes_mix_of_three": f"""{_PROBS}, y AS (SELECT *, 0.5 * exp(0.5 * coalesce(sum(ln(p1)) OVER w, 0)) AS a, 0.3 * exp(0.5 * coalesce(sum(ln(p2)) OVER w, 0)) AS b, 0.2 * exp(0.5 * coalesce(sum(ln(p3)) OVER w, 0)) AS c
        FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
        SELECT event_id, round((a * p1 + b * p2 + c * p3) / (a + b + c), 6) AS prob FROM y""",
    "static_interpolation": f"{_WB} SELECT ord, h1, h2, w0, round(0.7 * p + 0.3 * p_uni, 6) AS prob FROM tri",
    "rescored_hypotheses": """WITH s AS (SELECT p_brand, p_partkey, list_concat(list_concat(['<s>'], string_split(p_name, ' ')), ['</s>']) AS w FROM part),
        g AS (SELECT p_brand, p_partkey, w[i] AS w0, w[i - 1] AS h1, len(w) - 2 AS n FROM (SELECT *, unnest(range(2, len(w) + 1)) AS i FROM s)),
        u AS (SELECT w0, (count(*) + 1.0) / (SELECT count(*) + count(DISTINCT w0) FROM g) AS p FROM g GROUP BY w0),
        b AS (SELECT h1, w0, count(*) AS cnt FROM g GROUP BY ALL),
        t AS (SELECT h1, sum(cnt) AS t, count(*) AS n FROM b GROUP BY h1),
        q AS (SELECT h1, w0, (cnt + t.n * u.p) / (t.t + t.n) AS p FROM b JOIN t USING (h1) JOIN u USING (w0)),
        z AS (SELECT p_brand, p_partkey, 0.5 * any_value(g.n) + sum(log10(q.p)) AS total FROM g JOIN q USING (h1, w0) GROUP BY ALL)
        SELECT p_brand AS sent_id, p_partkey AS hyp_id, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM z) WHERE r <= 10""",
}
