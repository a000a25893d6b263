"""SQL counterparts of the training-data queries, where SQL can express them."""

STATEMENTS: dict[str, str] = {}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

STATEMENTS["op5_decontaminate"] = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, {_WORDS.format('text')} AS w FROM documents
), b AS (
  SELECT item_id::varchar AS item, {_WORDS.format('text')} AS w FROM benchmark
  WHERE item_id IS NOT NULL AND text IS NOT NULL
), win AS MATERIALIZED (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0
), grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM d, (SELECT DISTINCT n FROM win) AS sizes, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS u(i)
), hit AS MATERIALIZED (
  SELECT doc_id, n, i, item FROM grams JOIN win USING (n, s)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

STATEMENTS["op10_jaccard"] = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS u(i) WHERE len(w) > 0
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b
  WHERE 100 * k >= 90 * (x.n + y.n - k)
), reach(doc_id, node) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.node
)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.node) AS component_id
FROM reach AS r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

# CRC-32 of a value's text, bit by bit: a byte is mixed in, then eight shifts (marked -1) follow.
_CRC32 = """(xor(list_reduce(
    [4294967295::bigint] || flatten(list_transform(range(0, strlen({0}::varchar)),
      lambda i: [('0x' || hex(encode({0}::varchar))[2 * i + 1:2 * i + 2])::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END
  ), 4294967295))"""
_FRAMED = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FRAMED.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"

STATEMENTS["op11_merkle"] = f"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, lang, {_LEAF.format("n_chars")} AS leaf,
    CASE WHEN {_CRC32.format("doc_id")} % 7 = 0 THEN {_LEAF.format("(n_chars::hugeint + 1)")} END AS checked
  FROM documents
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs
), low(lang, level, pos, n, h) AS (
  SELECT lang, 0, pos, count(*) OVER (PARTITION BY lang), leaf FROM placed
  UNION ALL
  SELECT lang, any_value(level) + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos))
  FROM low WHERE n > 1 GROUP BY lang, pos // 2
), subroots AS MATERIALIZED (
  SELECT lang, h, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos FROM low WHERE n = 1
), high(level, pos, n, h) AS (
  SELECT 0, pos, count(*) OVER (), h FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos))
  FROM high WHERE n > 1 GROUP BY pos // 2
), steps AS (
  SELECT p.doc_id, p.leaf, false AS top, l.level, b.h AS other, (p.pos >> l.level) % 2 = 1 AS odd
  FROM placed AS p
  JOIN (SELECT DISTINCT lang, level FROM low WHERE n > 1) AS l ON l.lang IS NOT DISTINCT FROM p.lang
  LEFT JOIN low AS b ON b.lang IS NOT DISTINCT FROM p.lang AND b.level = l.level
    AND b.pos = xor(p.pos >> l.level, 1)
  UNION ALL
  SELECT p.doc_id, p.leaf, true, l.level, b.h, (s.pos >> l.level) % 2 = 1
  FROM placed AS p JOIN subroots AS s ON s.lang IS NOT DISTINCT FROM p.lang
  CROSS JOIN (SELECT DISTINCT level FROM high WHERE n > 1) AS l
  LEFT JOIN high AS b ON b.level = l.level AND b.pos = xor(s.pos >> l.level, 1)
), ways AS (
  SELECT doc_id, leaf, string_agg(other, '' ORDER BY top, level) AS proof,
    list(CASE WHEN other IS NULL THEN '=' WHEN odd THEN '<' || other ELSE '>' || other END ORDER BY top, level) AS way
  FROM steps GROUP BY doc_id, leaf
), folded AS (
  SELECT p.doc_id, p.leaf, s.h AS subroot, sha256(coalesce(w.proof, '')) AS proof_sha256,
    list_reduce([coalesce(p.checked, p.leaf)] || coalesce(w.way, []), lambda a, x: sha256(
      CASE x[1] WHEN '=' THEN a WHEN '<' THEN x[2:] || a ELSE a || x[2:] END)) AS folded_root
  FROM placed AS p JOIN subroots AS s ON s.lang IS NOT DISTINCT FROM p.lang
  LEFT JOIN ways AS w ON w.doc_id IS NOT DISTINCT FROM p.doc_id AND w.leaf = p.leaf
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM folded, (SELECT h AS root FROM high WHERE n = 1)
"""

_SPACED = r"[^\x20\x09-\x0D]+"
_TOKENS = (
    r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    r"|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"
)

STATEMENTS["op12_trie"] = f"""
WITH placed AS MATERIALIZED (
  SELECT conv_id, sha256(strlen(role)::varchar || ':' || role || text) AS x,
    len(regexp_extract_all(text, '{_SPACED}')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
  WHERE conv_id IS NOT NULL
), convs AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC32.format("conv_id")} % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM placed)
), turns AS (
  SELECT c.conv_id, 0 AS own, p.pos, x, words FROM convs AS c JOIN placed AS p ON p.conv_id = c.base AND p.pos < h
  UNION ALL
  SELECT conv_id, 1, pos, x, words FROM convs JOIN placed USING (conv_id) WHERE pos >= h
), lists AS MATERIALIZED (
  SELECT c.conv_id, coalesce(xs, []) AS xs, coalesce(ws, []) AS ws
  FROM convs AS c LEFT JOIN (
    SELECT conv_id, list(x ORDER BY own, pos) AS xs, list(words ORDER BY own, pos) AS ws FROM turns GROUP BY conv_id
  ) AS t ON t.conv_id = c.conv_id
), prefixes AS MATERIALIZED (
  SELECT conv_id, d, len(xs) AS size, sha256(array_to_string(xs[1:d], ' ')) AS node,
    CASE WHEN d > 0 THEN sha256(array_to_string(xs[1:d - 1], ' ')) END AS up, coalesce(ws[d], 0) AS words
  FROM lists, unnest(range(0, len(xs) + 1)) AS u(d)
), nodes AS MATERIALIZED (
  SELECT d, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (WHERE d = size), '')) AS ends_sha256
  FROM prefixes GROUP BY d, node
), children AS (
  SELECT d - 1 AS d, up AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), whole AS MATERIALIZED (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes AS n LEFT JOIN children USING (d, node)
), below AS (
  SELECT p.d, p.node, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves,
    sum((w.n_convs - 1) * w.words)::bigint AS saved_tokens
  FROM whole AS w JOIN prefixes AS p ON p.conv_id = w.conv_id AND p.d <= w.d GROUP BY ALL
)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens,
  w.ends_sha256
FROM whole AS w JOIN below AS b ON b.d = w.d AND b.node = w.node
LEFT JOIN whole AS p ON p.d = w.d - 1 AND p.node = w.up
"""

STATEMENTS["op13_quality_rules"] = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w,
    regexp_extract_all(coalesce(text, ''), '{_TOKENS}') AS tokens
  FROM documents
), hashes AS MATERIALIZED (
  SELECT token, {_CRC32.format('token')} AS h FROM (SELECT DISTINCT unnest(tokens) AS token FROM d)
), placed AS MATERIALIZED (
  SELECT row, doc_id, i, h FROM (
    SELECT row, doc_id, i, tokens[i] AS token FROM d, unnest(range(1, len(tokens) + 1)) AS u(i)
  ) JOIN hashes USING (token)
), windows AS (
  SELECT row, i, array_to_string(w[i:i + 2], ' ') AS s
  FROM d, unnest(range(1, greatest(len(w) - 2, 0) + 1)) AS u(i)
), twice AS (
  SELECT row, i FROM windows JOIN (SELECT row, s FROM windows GROUP BY ALL HAVING count(*) > 1) USING (row, s)
), covered AS (
  SELECT row, count(DISTINCT p) AS n_repeat_words FROM twice, unnest(range(i, i + 3)) AS u(p) GROUP BY row
), lines AS (
  SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM d, unnest(string_split(t, chr(10))) AS u(line) WHERE regexp_matches(line, '{_SPACED}') GROUP BY row
), base AS (
  SELECT row, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN lines USING (row) LEFT JOIN covered USING (row)
), grams AS MATERIALIZED (
  SELECT row, doc_id, h % 10000 AS g FROM placed
  UNION ALL
  SELECT a.row, a.doc_id, (a.h * 31 + b.h) % 10000 FROM placed AS a JOIN placed AS b ON b.row = a.row AND b.i = a.i + 1
), trusted AS (
  SELECT DISTINCT doc_id FROM labels WHERE quality = 1
), counts AS (
  SELECT b.g, coalesce(r.n, 0) AS r, coalesce(t.n, 0) AS t
  FROM range(10000) AS b(g)
  LEFT JOIN (SELECT g, count(*) AS n FROM grams GROUP BY g) AS r ON r.g = b.g
  LEFT JOIN (SELECT g, count(*) AS n FROM grams SEMI JOIN trusted USING (doc_id) GROUP BY g) AS t ON t.g = b.g
), ratios AS (
  SELECT g, CASE WHEN ts = 0 THEN 0 ELSE ln(((t + 1) / (ts + 10000)) / ((r + 1) / (rs + 10000))) END AS x
  FROM counts, (SELECT sum(r)::double AS rs, sum(t)::double AS ts FROM counts)
), scores AS (
  SELECT row, avg(x) AS score FROM grams JOIN ratios USING (g) GROUP BY row
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(score, 0) >= -0.3 AS kept
FROM base LEFT JOIN scores USING (row)
"""
