"""DuckDB SQL for the text queries that SQL can express, written from the definitions."""

from kinweave.llm.license_scan import rules as license_rules

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SPACES}'), lambda x: x <> '')"


QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {words('t')} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
windows AS (SELECT r, s, array_to_string(list_slice(ws, s, s + 4), ' ') AS x FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS s FROM w)),
twice AS (SELECT r, s FROM windows QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
reps AS (SELECT r, sum(least(5, coalesce(next - s, 5))) AS n FROM (SELECT r, s, lead(s) OVER (PARTITION BY r ORDER BY s) AS next FROM twice) GROUP BY r),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{SPACES}', '', 'g'))::BIGINT AS word_chars,
  length(t)::BIGINT - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS n_upper
  FROM w LEFT JOIN reps USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 2 * n_upper > word_chars OR 2 * n_dup_lines > n_lines
       OR word_chars > 25 * n_words OR 2 * word_chars < 3 * n_words) AS kept FROM b
"""

LINES = f"""
WITH l AS (SELECT doc_id, no, line FROM (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
  WHERE regexp_matches(line, '{WORD}')),
k AS (SELECT row_number() OVER () AS c, *, len(ws) AS n FROM (
  SELECT line, min((doc_id, no)) AS first, list_distinct({words('line')}) AS ws FROM l GROUP BY line)),
t AS (SELECT c, n, unnest(ws) AS w FROM k),
p AS (SELECT c, n, w FROM (SELECT c, n, w, row_number() OVER (PARTITION BY c ORDER BY df, w) AS i
  FROM t JOIN (SELECT w, count(*) AS df FROM t GROUP BY w) USING (w)) WHERE i <= n - (n * 4 + 4) // 5 + 1),
pairs AS (SELECT DISTINCT a.c AS a, b.c AS b FROM p a JOIN p b ON a.w = b.w AND a.c <> b.c AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4),
common AS (SELECT y.c, x.n AS n, y.n AS m, len(list_intersect(x.ws, y.ws)) AS i FROM pairs JOIN k x ON x.c = a JOIN k y ON y.c = b WHERE x.first < y.first),
matched AS (SELECT DISTINCT c FROM common WHERE 5 * i >= 4 * (n + m - i)),
g AS (SELECT doc_id, no, m.c IS NOT NULL OR (doc_id, no) <> k.first AS gone FROM l JOIN k USING (line) LEFT JOIN matched m ON m.c = k.c)
SELECT d.doc_id, count(no) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  coalesce(string_agg(no::VARCHAR, ',' ORDER BY no) FILTER (WHERE gone), '') AS removed
FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id
"""

PASSAGES = f"""
WITH d AS (SELECT doc_id, text, {words("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
t AS (SELECT text, min(doc_id) AS id, any_value(ws) AS ws FROM d GROUP BY text),
windows AS (SELECT id, s, array_to_string(list_slice(ws, s + 1, s + 50), ' ') AS x FROM (SELECT id, ws, unnest(range(0, len(ws) - 49)) AS s FROM t)),
twice AS (SELECT id, s FROM windows QUALIFY count(*) OVER (PARTITION BY x) > 1),
parts AS (SELECT id, s, sum(new) OVER (PARTITION BY id ORDER BY s) AS part FROM (
  SELECT id, s, (s > lag(s, 1, -100) OVER (PARTITION BY id ORDER BY s) + 50)::INT AS new FROM twice))
SELECT id AS doc_id, min(s)::BIGINT AS start, (max(s) - min(s) + 50)::BIGINT AS length, NULL::BIGINT AS copy_of FROM parts GROUP BY id, part
UNION ALL
SELECT d.doc_id, 0, len(d.ws), t.id FROM d JOIN t USING (text) WHERE d.doc_id <> t.id AND len(d.ws) >= 50
"""



def licenses(rules: list[tuple]) -> str:
    """The rule table is the query's parameter; everything else is said again here."""
    quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    rows = ", ".join(f"({', '.join(map(quote, r))})" for r in rules)
    separators = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    count = "(length({0}) - length(replace({0}, ' ', '')))"
    return f"""
WITH rules(rule, label, priority, weight, keyword, before, after) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{separators}'), lambda x: x <> '') AS ws FROM documents),
h AS (SELECT r, i, ws[i + 1] AS keyword,
  ' ' || list_aggregate(list_transform(list_slice(ws, greatest(i - 15, 1), i), lambda x: x || ' '), 'string_agg', '') AS lw,
  ' ' || list_aggregate(list_transform(list_slice(ws, i + 2, i + 17), lambda x: x || ' '), 'string_agg', '') AS rw
  FROM (SELECT r, ws, unnest(range(len(ws))) AS i FROM d) WHERE ws[i + 1] IN (SELECT keyword FROM rules)),
m AS (SELECT r, i, rule, label, priority, weight, regexp_extract(coalesce(lw, ' '), before) AS x, regexp_extract(coalesce(rw, ' '), after) AS y FROM h JOIN rules USING (keyword)),
e AS (SELECT r, rule, label, priority, weight, i - {count.format('x')} + 1 AS a, i + {count.format('y')} AS b FROM m WHERE x <> '' AND y <> ''),
kept AS (SELECT * FROM e WHERE priority = 0 OR NOT EXISTS (SELECT 1 FROM e AS o WHERE o.r = e.r AND o.priority >= e.priority AND o.priority > 0
  AND o.a <= e.a AND o.b >= e.b AND (o.a < e.a OR o.b > e.b OR o.priority > e.priority OR o.rule < e.rule))),
g AS (SELECT r, count(*) FILTER (WHERE priority = 0) AS n_base, min(a) FILTER (WHERE priority = 0) AS first_word, max(a) FILTER (WHERE priority = 0) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE priority = 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS score FROM kept GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN g USING (r)
"""


CRC = """list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x))), lambda c, x:
  list_reduce(list_concat([xor(c, x)], range(8)), lambda a, i: xor(a >> 1, (a & 1) * 3988292384)))"""

TRIE = f"""
WITH own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, xor({CRC}, 4294967295) % 6 AS h FROM own),
s AS (SELECT h.conv_id, list_concat(coalesce(b.ts[:h], []), coalesce(h.ts[h + 1:], [])) AS ts FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS d FROM s),
n AS (SELECT ts[:d] AS k, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d > 0 THEN length(any_value(ts[d].t)) ELSE 0 END AS size,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = len(ts)), '')) AS ends_sha256 FROM p GROUP BY ts[:d], d),
kids AS (SELECT k[:depth - 1] AS k, depth - 1 AS depth, count(*) AS n FROM n WHERE depth > 0 GROUP BY ALL),
full_n AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM n LEFT JOIN kids USING (k, depth)),
up AS (SELECT k[:a] AS k, a AS depth, sum((n_convs - 1) * size) AS saved, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS a FROM full_n) GROUP BY ALL)
SELECT f.conv_id, f.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, up.n_leaves, up.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_n f JOIN up USING (k, depth) LEFT JOIN n q ON f.depth > 0 AND q.depth = f.depth - 1 AND q.k = f.k[:f.depth - 1]
"""

NEGATIVES = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT r, anchor_id, other, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, other_id, other) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.r, p.other ORDER BY s.score DESC, s.other_id, s.other)::INT AS rank,
  s.other_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.r = p.r AND NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY rank <= 5
"""


ORACLES = {"op2_license_scan": licenses(license_rules()), "op10_quality_rules": QUALITY, "op5_line_dedup": LINES, "op3_suffix_array_dedup": PASSAGES,
           "op12_hard_negatives": NEGATIVES, "op13_conversation_prefix_trie": TRIE}
