"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP1 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS key FROM p),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY key) AS n FROM k) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM d, (SELECT unnest(generate_series(0, 34)) AS j)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i FROM w),
kept AS (SELECT words.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY words.i) AS kept
         FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY words.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS k FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 85 * (na.n + nb.n - x)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS r FROM w UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = w.doc_id AS kept
FROM w JOIN c ON c.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

OP7 = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS id, vec_id AS r FROM v UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, component_id = v.vec_id AS kept
FROM v JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

OP9 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bi AS (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS i FROM b WHERE len(ws) > 0),
bk AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS key FROM bi),
lens AS (SELECT DISTINCT n FROM bk),
di AS (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM w, lens WHERE len(ws) >= n),
dk AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS key FROM di),
hits AS (SELECT doc_id, item_id, dk.i, dk.n FROM dk JOIN bk ON dk.n = bk.n AND dk.key = bk.key),
spots AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS i FROM hits),
nh AS (SELECT doc_id, count(*) AS n_hit FROM spots GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN nh ON w.doc_id = nh.doc_id LEFT JOIN ni ON w.doc_id = ni.doc_id
"""

#: Unsigned crc32 of a document's decimal id, bit by bit.
CRC = "xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_concat([ascii(c)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END, 4294967295::BIGINT), 4294967295)"


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(({x})::VARCHAR) || ':' || {x} END"


OP12 = f"""
WITH RECURSIVE v AS (SELECT *, {" || ".join(f"({_field(c)})" for c in ("doc_id", "source", "lang", "n_chars"))} AS head,
  CASE WHEN {CRC} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS tampered FROM documents),
leaves AS (SELECT doc_id, lang, sha256(head || {_field("text")}) AS leaf, sha256(head || {_field("tampered")}) AS claimed,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM v),
nodes AS (SELECT lang, 0 AS level, i, n, leaf AS h FROM leaves
  UNION ALL SELECT lang, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, level, n, i // 8),
subroots AS (SELECT lang, level AS depth, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
above AS (SELECT 0 AS level, i, n, subroot AS h FROM subroots
  UNION ALL SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM above WHERE n > 1 GROUP BY level, n, i // 8),
root AS (SELECT level AS depth, h AS root FROM above WHERE n = 1),
runs AS (SELECT lang, level, i // 8 AS run, string_agg(h, '' ORDER BY i) AS digests FROM nodes WHERE n > 1 GROUP BY ALL),
top_runs AS (SELECT level, i // 8 AS run, string_agg(h, '' ORDER BY i) AS digests FROM above WHERE n > 1 GROUP BY ALL),
path AS (SELECT doc_id, lang, leaf, claimed AS fold, '' AS proof, i, 0 AS level FROM leaves
  UNION ALL SELECT doc_id, lang, leaf, sha256(l || fold || r), proof || l || r, i // 8, level + 1
  FROM (SELECT p.*, substr(digests, 1, 64 * (i % 8)) AS l, substr(digests, 64 * (i % 8) + 65) AS r FROM path p JOIN runs ON runs.lang IS NOT DISTINCT FROM p.lang AND runs.level = p.level AND run = i // 8)),
outer_path AS (SELECT doc_id, leaf, subroot, fold, proof, s.i AS i, 0 AS level FROM path JOIN subroots s ON s.lang IS NOT DISTINCT FROM path.lang AND s.depth = path.level
  UNION ALL SELECT doc_id, leaf, subroot, sha256(l || fold || r), proof || l || r, i // 8, level + 1
  FROM (SELECT p.*, substr(digests, 1, 64 * (i % 8)) AS l, substr(digests, 64 * (i % 8) + 65) AS r FROM outer_path p JOIN top_runs ON top_runs.level = p.level AND run = i // 8))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM outer_path JOIN root ON depth = level
"""

OP13 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {CRC} AS h FROM documents),
e AS (SELECT *, len(ws) AS n, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
u AS (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM f WHERE n > 0),
w AS (SELECT doc_id, n, i, ws[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM u),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM m),
t AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM t GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(start + period, start + length - 1)) AS i FROM runs),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS kept FROM w ANTI JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS place FROM runs),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN best ON best.doc_id = d.doc_id AND place = 1 LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

SQL: dict[str, str] = {"op1_substring_dedup": OP1, "op6_near_dedup": OP6, "op7_embedding_dedup": OP7, "op9_decontamination": OP9, "op12_manifest": OP12, "op13_periodic_runs": OP13}
