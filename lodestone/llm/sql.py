"""DuckDB SQL for the training-data queries that SQL can express, each a plain statement of the whole result."""

WORD = r"[^\x20\x09-\x0D]+"

MET = """ln(sum(pow(p, a))) - a * sum(pow(p, a) * ln(p)) / sum(pow(p, a)) <= 0.95 * ln(max(s)) + 1e-12 AS level,
  pow(min(p), a - 1) / sum(pow(p, a)) <= 2.0 + 1e-12 AS light, pow(max(p), a - 1) / sum(pow(p, a)) <= 2.0 + 1e-12 AS heavy"""

MIX = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce(source, '') AS source, md5(coalesce(text, '')) AS digest,
         greatest(1, len(regexp_extract_all(coalesce(text, ''), '{WORD}')))::BIGINT AS tokens
  FROM documents),
shares AS (SELECT source, sum(tokens)::BIGINT AS total FROM sized GROUP BY source),
whole AS (SELECT sum(total)::BIGINT AS t, count(*) AS s FROM shares),
parts AS (SELECT total::DOUBLE / t AS p, s FROM shares, whole),
ends AS (SELECT a, {MET} FROM parts, (VALUES (0::DOUBLE), (16::DOUBLE)) AS v(a) GROUP BY a),
halved AS (
  SELECT 0 AS step, 0::DOUBLE AS low, 16::DOUBLE AS high
  UNION ALL
  SELECT step + 1, CASE WHEN level AND light THEN low ELSE a END, CASE WHEN level AND light THEN a ELSE high END
  FROM (SELECT step, low, high, a, {MET} FROM (SELECT step, low, high, (low + high) / 2 AS a FROM halved WHERE step < 20), parts GROUP BY step, low, high, a)),
flat AS (
  SELECT CASE WHEN (SELECT level AND light FROM ends WHERE a = 0) THEN 0::DOUBLE WHEN NOT (SELECT level AND light FROM ends WHERE a = 16) THEN 16::DOUBLE
              ELSE (SELECT high FROM halved WHERE step = 20) END AS a),
sharp AS (
  SELECT 0 AS step, 1::DOUBLE AS low, a AS high FROM flat
  UNION ALL
  SELECT step + 1, CASE WHEN heavy THEN a ELSE low END, CASE WHEN heavy THEN high ELSE a END
  FROM (SELECT step, low, high, a, {MET} FROM (SELECT step, low, high, (low + high) / 2 AS a FROM sharp WHERE step < 20), parts GROUP BY step, low, high, a)),
chosen AS (SELECT CASE WHEN f.a > 1 AND NOT f.heavy THEN (SELECT low FROM sharp WHERE step = 20) ELSE f.a END AS a FROM (SELECT a, {MET} FROM flat, parts GROUP BY a) f),
state AS (SELECT a, {MET} FROM chosen, parts GROUP BY a),
weights AS (SELECT source, total, a, level, light AND heavy AS within, pow(total::DOUBLE, a) / sum(pow(total::DOUBLE, a)) OVER () AS weight FROM shares, state),
plan AS (SELECT source, total, a, level, within, weight, floor(weight * t)::BIGINT AS quota, greatest(1, (t + 32767) // 32768) AS blocks FROM weights, whole),
epochs AS (SELECT *, unnest(generate_series(0, (quota - 1) // total)) AS epoch FROM plan WHERE quota > 0),
keyed AS (SELECT doc_id, source, tokens, epoch, total, weight, quota, blocks, a, level, within, md5('17:' || epoch || ':' || coalesce(doc_id::VARCHAR, '') || ':' || digest) AS key FROM sized JOIN epochs USING (source)),
placed AS (SELECT *, (epoch * total + sum(tokens) OVER (PARTITION BY source, epoch ORDER BY key ROWS UNBOUNDED PRECEDING) - tokens)::BIGINT AS start,
                  (epoch * total + sum(tokens) OVER (PARTITION BY source, epoch ORDER BY key))::BIGINT AS stop FROM keyed),
drawn AS (SELECT *, (start * blocks // quota)::BIGINT AS block FROM placed WHERE stop <= quota)
SELECT doc_id, source, tokens, epoch::BIGINT AS epoch, start, block,
       row_number() OVER (PARTITION BY block ORDER BY md5('block:' || key), source, start)::BIGINT AS place, round(weight, 9) AS weight,
       round(a, 9) AS exponent, level AS entropy_met, within AS repeats_met
FROM drawn
"""

COMPONENTS = rf"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
links AS (
  SELECT p.doc_id AS a, q.doc_id AS b
  FROM shared JOIN sizes m ON m.r = x JOIN sizes n ON n.r = y JOIN words p ON p.r = x JOIN words q ON q.r = y
  WHERE 100 * i >= 75 * (m.n + n.n - i)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS other FROM ways UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON reach.other = ways.a),
roots AS (SELECT doc_id, min(other) AS root FROM reach GROUP BY doc_id)
SELECT words.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(words.doc_id, coalesce(root, words.doc_id)) AS component_id
FROM words LEFT JOIN sizes USING (r) LEFT JOIN roots ON roots.doc_id = words.doc_id
"""

EXACT = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM t JOIN g USING (text)"""

#: n-gram counts of all lengths, then cuts, cover and rank.
COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
spots AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM worded),
total AS (SELECT lang, count(*) AS n FROM spots GROUP BY lang),
grams AS (SELECT lang, list_slice(ws, i, i + size - 1) AS p, count(*) AS f FROM spots, (VALUES (1), (2), (3), (4)) AS v(size) WHERE i + size - 1 <= len(ws) GROUP BY ALL),
often AS (SELECT * FROM grams WHERE f >= 30),
cuts AS (SELECT lang, p, f, unnest(range(1, len(p))) AS k FROM often WHERE len(p) > 1),
scores AS (SELECT c.lang, c.p, c.f AS a, k, l.f AS l, r.f AS r, CAST(2000000 * c.f::HUGEINT // (l.f + r.f) AS BIGINT) AS score
  FROM cuts c JOIN often l ON l.lang = c.lang AND l.p = list_slice(c.p, 1, k) JOIN often r ON r.lang = c.lang AND r.p = list_slice(c.p, k + 1, len(c.p))),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, f, p, unnest(range(1, len(p) - size + 2)) AS i, size FROM often, (VALUES (2), (3)) AS v(size) WHERE len(p) > size),
cover AS (SELECT lang, list_slice(p, i, i + size - 1) AS p, max(f) AS f FROM inner_parts GROUP BY ALL),
free AS (SELECT b.* FROM best b LEFT JOIN cover c ON c.lang = b.lang AND c.p = b.p WHERE c.f IS NULL OR 100 * c.f < 80 * b.a),
named AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM free)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE C) AS rank, phrase, a, l, r, n, score FROM named JOIN total USING (lang)
QUALIFY rank <= 2000"""

AUDIT = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
m AS (
  SELECT t.doc_id, part, CAST(len(ws) < 200 AS INT) AS a, CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT) AS b,
    CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS INT) AS c, CAST(regexp_matches(text, '[#$%&*|]') AS INT) AS d,
    CAST(t.doc_id > min(t.doc_id) OVER (PARTITION BY text) AS INT) AS e, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM t LEFT JOIN labels USING (doc_id)),
masks AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(f, b)),
steps AS (
  SELECT v.f || w.f || x.f || y.f || z.f AS filter_order, s AS step, CASE s WHEN 1 THEN v.b WHEN 2 THEN w.b WHEN 3 THEN x.b WHEN 4 THEN y.b ELSE z.b END AS own,
    CASE s WHEN 1 THEN 0 WHEN 2 THEN v.b WHEN 3 THEN v.b + w.b WHEN 4 THEN v.b + w.b + x.b ELSE v.b + w.b + x.b + y.b END AS prior
  FROM letters v, letters w, letters x, letters y, letters z, range(1, 6) AS r(s) WHERE v.b + w.b + x.b + y.b + z.b = 31 AND v.b | w.b | x.b | y.b | z.b = 31),
cells AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN mask & (prior | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & prior = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & prior <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & prior = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & prior = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM masks, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM cells"""
