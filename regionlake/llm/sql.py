"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

WORDS = r"""
worded AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents)"""

SHINGLES = WORDS + r""",
shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM worded)"""

NGRAM_JACCARD = "WITH RECURSIVE" + SHINGLES + r""",
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
linked AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE k >= 0.8 * (p.n + q.n - k)),
reach(node, goal) AS (
  SELECT doc_id, doc_id FROM worded UNION SELECT node, y FROM reach JOIN linked ON x = goal),
class AS (SELECT node, min(goal) AS class_id FROM reach GROUP BY node),
copies AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS copy_id,
    CASE WHEN len(w) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY text) END AS n_copies
  FROM worded),
links AS (
  SELECT x, count(DISTINCT b.text) FILTER (WHERE b.text <> a.text) AS n_links, count(*) AS n_linked_docs
  FROM linked JOIN worded a ON a.doc_id = x JOIN worded b ON b.doc_id = y GROUP BY x)
SELECT c.doc_id, copy_id, n_copies, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_linked_docs, 0) AS n_linked_docs
FROM copies c JOIN class ON node = c.doc_id LEFT JOIN links ON x = c.doc_id"""

HOST_RULES = "WITH" + WORDS + r""",
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM worded)),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1)
  GROUP BY doc_id),
lined AS (
  SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
counted AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(x.text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(x.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM documents d JOIN worded x ON x.doc_id = d.doc_id JOIN lined y ON y.doc_id = d.doc_id
    LEFT JOIN repeats r ON r.doc_id = d.doc_id),
based AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted),
judged AS (
  SELECT *, base_failed OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words
    OR word_chars > 15 * n_words AS failed
  FROM based),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE failed) AS f FROM judged WHERE source IS NOT NULL GROUP BY source),
sums AS (
  SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(f) AS DOUBLE) AS f, CAST(sum(n * n) AS DOUBLE) AS nn, sum(f * f / n) AS ff
  FROM hosts),
moments AS (SELECT *, f / n AS m, ff - f * f / n AS spread, n - nn / n - (k - 1) AS room FROM sums),
fitted AS (
  SELECT m, least(0.999::DOUBLE, greatest(1 / (n + 1), CASE WHEN m > 0 AND m < 1 AND room > 0
    THEN (spread / (m * (1 - m)) - (k - 1)) / room ELSE 0 END)) AS inside FROM moments),
sized AS (SELECT m, (1 - inside) / inside AS k FROM fitted),
bad AS (SELECT source FROM hosts, sized WHERE (f + m * k) / (n + k) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed,
  b.source IS NOT NULL AS host_failed, NOT base_failed AND b.source IS NULL AS kept
FROM judged j LEFT JOIN bad b ON b.source = j.source"""

LINE_DEDUP = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (
  SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, raw, lower(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line
  FROM (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM split)),
firsts AS (
  SELECT line, min((doc_id, line_no)) AS first, length(line) AS n FROM lines WHERE line <> '' GROUP BY line),
halves AS (
  SELECT line, first, n, m, n - m AS shorter, unnest([left(line, m // 2), right(line, m - m // 2)]) AS half, unnest([1, 2]) AS side
  FROM (SELECT *, unnest([n, n - 1]) AS m FROM firsts WHERE n >= 20)),
near AS (
  SELECT DISTINCT a.line FROM halves a JOIN halves b ON a.half = b.half AND a.side = b.side AND a.m = b.m
  WHERE b.first < a.first AND abs(a.n - b.n) <= 1 AND levenshtein(a.line, b.line) <= 1),
verdict AS (
  SELECT l.doc_id, l.line_no, raw, l.line <> '' AS worded, l.line <> '' AND (l.doc_id, l.line_no) <> f.first AS again,
    l.line <> '' AND (l.doc_id, l.line_no) = f.first AND k.line IS NOT NULL AS near
  FROM lines l LEFT JOIN firsts f ON f.line = l.line LEFT JOIN near k ON k.line = l.line)
SELECT doc_id, count(*) FILTER (WHERE worded AND NOT again AND NOT near) AS n_lines, count(*) FILTER (WHERE again OR near) AS n_removed,
  count(*) FILTER (WHERE near) AS n_near,
  coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (WHERE NOT coalesce(again, false) AND NOT coalesce(near, false)), '') AS text
FROM verdict GROUP BY doc_id"""

DECONTAMINATION = "WITH" + r"""
sides AS (
  SELECT false AS item, doc_id AS id, lower(coalesce(text, '')) AS text FROM documents
  UNION ALL SELECT true, item_id, lower(coalesce(text, '')) FROM benchmark),
worded AS (
  SELECT item, id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM sides),
grams AS (
  SELECT DISTINCT item, id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM worded, range(1, 6) r(k) WHERE len(w) >= k AND (k = 5 OR NOT item OR len(w) = k)),
items AS (SELECT id, k, s, count(*) OVER (PARTITION BY id) AS n_item FROM grams WHERE item),
shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, any_value(n_item) AS n_item
  FROM items i JOIN grams d ON NOT d.item AND d.k = i.k AND d.s = i.s GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM shared WHERE n_shared / n_item >= 0.8"""

PARETO_MIX = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size::HUGEINT * size) AS DOUBLE) AS squares,
    [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM sizes GROUP BY source),
ratios AS (SELECT *, 3 * source_size / w AS ratio FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0)) / (
    sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM ratios WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, squares, least(3.0::DOUBLE * source_size, w * (SELECT max(level) FROM levels WHERE ratio >= level)) AS target
  FROM levels),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
drawn AS (
  SELECT doc_id, s.source, size, source_size, target, whole, greatest(target - whole * source_size, 0) AS need, squares,
    (CAST('0x' || substr(md5('mix:' || doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496 AS u
  FROM sizes s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source),
odds AS (
  SELECT *, least(1.0::DOUBLE, greatest(CASE WHEN squares > 0 THEN need / squares * size ELSE 0 END, 1e-12::DOUBLE)) AS f FROM drawn),
placed AS (
  SELECT *, CASE WHEN f >= 1 THEN 0 ELSE CAST(floor((ln(u / (1 - u) * (1 - f) / f) + 128) / 256 * 4503599627370496) AS BIGINT) END AS place
  FROM odds),
ranked AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up_to,
    sum(size) OVER (PARTITION BY source, place) AS alike
  FROM placed)
SELECT doc_id, source, size, source_size, target,
  CAST(whole AS BIGINT) + CASE WHEN need > 0 AND up_to - alike / 2 <= need THEN 1 ELSE 0 END AS copies,
  size * (CAST(whole AS BIGINT) + CASE WHEN need > 0 AND up_to - alike / 2 <= need THEN 1 ELSE 0 END) AS taken
FROM ranked"""

SUBSTRING_DEDUP = r"""
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
pieces AS (SELECT doc_id, n, lo, substr(h, 2 * lo + 1, 2 * (1024 + 49)) AS h FROM (
  SELECT doc_id, n, h, unnest(range(0, n, 1024)) AS lo FROM bytes)),
windows AS (SELECT doc_id, lo + i AS i, substr(h, 2 * i + 1, 100) AS s FROM (
  SELECT doc_id, lo, h, unnest(range(0, least(1024, n - lo - 49))) AS i FROM pieces)),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
again AS (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE first < doc_id),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (
    SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
      SELECT doc_id, i, CASE WHEN i - 50 <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM again))
  GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM (
    SELECT doc_id, a, b FROM runs UNION ALL SELECT doc_id, -1, 0 FROM bytes)),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * g.a + 1, 2 * (coalesce(g.b, n) - g.a)), '' ORDER BY g.a) AS h
  FROM gaps g JOIN bytes USING (doc_id) GROUP BY doc_id),
removed AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(kept.h)) AS kept_sha256
FROM bytes JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM worded, range(1, 4) r(k) WHERE len(w) >= k)
  GROUP BY lang, k, phrase HAVING count(*) >= 10),
found AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
cuts AS (
  SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS lhs, array_to_string(w[cut + 1:], ' ') AS rhs
  FROM found, range(1, 3) r(cut) WHERE cut < k),
scored AS (
  SELECT c.lang, c.k, c.phrase, a, cut, p.f AS l, q.f AS r, CAST((1000000::HUGEINT * a * a) // (p.f::HUGEINT * q.f) AS BIGINT) AS score
  FROM cuts c JOIN counts p ON p.lang = c.lang AND p.phrase = lhs JOIN counts q ON q.lang = c.lang AND q.phrase = rhs),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM found WHERE k = 3)
  GROUP BY lang, phrase),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
  FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000"""

HARD_NEGATIVES = r"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5"""
