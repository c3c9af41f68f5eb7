"""What DuckDB can state of the operators' results, from the contracts alone."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def crc32(text: str) -> str:
    """The crc32 of an ASCII text: eight shifts for each of its characters."""
    shifts = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x // 2, 3988292384 * (x % 2)))"
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all({text}, '.'), lambda c: ord(c)::BIGINT)), "
            f"lambda a, b: {shifts}), 4294967295)")


SUBSTRING = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {WORDS} AS words FROM documents),
starts AS (SELECT row, unnest(range(1, len(words) - 33)) AS p, words FROM docs WHERE len(words) >= 35),
windows AS (SELECT row, p, hash(words[p:p + 34]) AS h, words[p:p + 34] AS w FROM starts),
repeated AS (SELECT row, p FROM (SELECT row, p, count(*) OVER (PARTITION BY h, w) AS n FROM windows) WHERE n > 1),
gone AS (SELECT row, unnest(range(p, p + 35)) AS k FROM repeated),
cut AS (SELECT row, list(DISTINCT k) AS ks, count(DISTINCT k) AS n FROM gone GROUP BY row),
words AS (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM docs),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY k) AS text FROM words ANTI JOIN (SELECT DISTINCT row, k FROM gone) g USING (row, k) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(cut.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN cut USING (row) LEFT JOIN kept USING (row)
"""

NEAR = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS row, doc_id, {WORDS.replace('coalesce(text', 'coalesce(' + LOWERED.format('text'))} AS words FROM documents),
shingles AS (
  SELECT row, unnest(list_distinct(list_transform(range(1, greatest(len(words) - 3, 2)), lambda p: words[p:p + 4]))) AS s FROM docs WHERE len(words) > 0),
sizes AS (SELECT row, count(*) AS n FROM shingles GROUP BY row),
pairs AS (SELECT a.row AS a, b.row AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.row <> b.row GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.row = a JOIN sizes y ON y.row = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach(row, other) AS (SELECT row, row FROM docs UNION SELECT reach.row, b FROM reach JOIN links ON links.a = reach.other),
parts AS (SELECT reach.row, min(d.doc_id) AS component_id FROM reach JOIN docs d ON d.row = reach.other GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM docs JOIN parts USING (row) LEFT JOIN sizes USING (row)
"""

RULES = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, {WORDS} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT row, unnest(range(1, len(words) - 6)) AS p, words FROM docs WHERE len(words) >= 8),
repeated AS (SELECT row, p FROM (SELECT row, p, count(*) OVER (PARTITION BY row, words[p:p + 7]) AS n FROM windows) WHERE n > 1),
covered AS (SELECT row, count(DISTINCT k) AS n FROM (SELECT row, unnest(range(p, p + 8)) AS k FROM repeated) GROUP BY row),
counts AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, list_sum(list_transform(words, lambda w: length(w)))::BIGINT AS chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(list_zip(words, words[2:]), lambda x: x[1] = x[2])) AS n_stutter,
    length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-zß-öø-ÿ]', '', 'g')) AS n_lower
  FROM docs LEFT JOIN covered USING (row))
SELECT doc_id, n_words, coalesce(chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 4 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 10 * n_stutter > 3 * n_words
    OR n_upper > n_lower OR coalesce(chars, 0) NOT BETWEEN 2 * n_words AND 20 * n_words) AS kept
FROM counts
"""

TERMS = r"regexp_extract_all(coalesce(" + LOWERED.format("text") + r", ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {TERMS} AS terms FROM documents),
items AS (SELECT row_number() OVER () AS item, item_id, {TERMS} AS terms FROM benchmark),
totals AS (SELECT count(*)::BIGINT AS n, sum(len(terms))::BIGINT AS l FROM docs WHERE len(terms) > 0),
tf AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) GROUP BY row, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, totals),
m AS (SELECT row, doc_id, 50 + (50 * len(terms) * n) // l AS m FROM docs, totals WHERE len(terms) > 0),
asked AS (SELECT DISTINCT item, item_id, unnest(terms) AS term FROM items),
scores AS (
  SELECT item, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN m USING (row) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 50
"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM (
    SELECT doc_id, source, {_leaf('text')} AS leaf,
      CASE WHEN {crc32('doc_id::VARCHAR')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS shown FROM documents)),
up(source, level, pos, digest, n) AS (
  SELECT source, 0, pos, leaf, n FROM leaves
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY source, level, pos // 3, n),
subroots AS (SELECT source, level AS height, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top(level, pos, digest, n) AS (
  SELECT 0, pos, subroot, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY level, pos // 3, n),
root AS (SELECT digest AS root FROM top WHERE n = 1),
places AS (
  SELECT l.source, l.pos AS leaf_pos, u.level AS step, l.pos // (3 ** u.level)::BIGINT AS p, 0 AS above
  FROM leaves l JOIN (SELECT DISTINCT source, level FROM up WHERE n > 1) u ON l.source IS NOT DISTINCT FROM u.source
  UNION ALL
  SELECT l.source, l.pos, s.height + t.level, s.pos // (3 ** t.level)::BIGINT, 1
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source CROSS JOIN (SELECT DISTINCT level FROM top WHERE n > 1) t),
nodes AS (
  SELECT source, level AS step, pos, digest, 0 AS above FROM up WHERE n > 1
  UNION ALL
  SELECT s.source, s.height + t.level, t.pos, t.digest, 1 FROM top t CROSS JOIN subroots s WHERE t.n > 1),
steps AS (
  SELECT k.source, k.leaf_pos, k.step, coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos < k.p), '') AS before,
    coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos > k.p), '') AS after
  FROM places k JOIN nodes x ON x.source IS NOT DISTINCT FROM k.source AND x.step = k.step AND x.above = k.above AND x.pos // 3 = k.p // 3 GROUP BY ALL),
proofs AS (SELECT source, leaf_pos, string_agg(before || after, '' ORDER BY step) AS proof FROM steps GROUP BY source, leaf_pos),
fold(source, pos, step, digest) AS (
  SELECT source, pos, 0, shown FROM leaves
  UNION ALL
  SELECT f.source, f.pos, f.step + 1, sha256(s.before || f.digest || s.after)
  FROM fold f JOIN steps s ON s.source IS NOT DISTINCT FROM f.source AND s.leaf_pos = f.pos AND s.step = f.step),
reached AS (SELECT source, pos, arg_max(digest, step) AS folded FROM fold GROUP BY source, pos)
SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.folded AS folded_root, f.folded = r.root AS verified
FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source CROSS JOIN root r
LEFT JOIN proofs p ON p.source IS NOT DISTINCT FROM l.source AND p.leaf_pos = l.pos
JOIN reached f ON f.source IS NOT DISTINCT FROM l.source AND f.pos = l.pos
"""
