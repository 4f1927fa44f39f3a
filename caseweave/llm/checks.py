"""SQL for DuckDB that gives the rows of a query, where that is possible."""

#: All pairs that share a shingle, then everything that can be reached over links.
NEAR_DEDUP = r"""
WITH RECURSIVE own AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM own
), long AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS x, any_value(b.n) AS y, count(*) AS n
  FROM long a JOIN long b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared WHERE 100 * n >= 80 * (x + y - n)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.other
), least_of AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT s.doc_id, len(s.s) AS n_shingles, l.component_id, l.component_id = s.doc_id AS kept
FROM sets s JOIN least_of l USING (doc_id)
"""

#: The CRC-32 of a text whose code points are below 256, as one number; ``{text}`` stands for it, ``crc.t`` for the table of bytes.
_CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
)"""


def _crc32(text: str) -> str:
    codes = f"flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [ord(ch)] ELSE [192 + (ord(ch) >> 6), 128 + (ord(ch) & 63)] END))"
    steps = f"list_reduce(list_concat([4294967295], list_transform({codes}, lambda b: b::BIGINT)), lambda c, b: xor(c >> 8, crc.t[1 + (xor(c, b) & 255)]))"
    return f"xor({steps}, 4294967295)"


#: Near words by equal (before, after) parts around one letter, or equality after a letter is taken out.
SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+'),
    lambda r: translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS run FROM documents
), counted AS (
  SELECT d, run, count(*) AS n FROM runs GROUP BY ALL
), drawn AS (
  SELECT run, n, {_crc32("d || ':' || run")} AS h FROM counted, crc
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
    sum(n)::BIGINT AS n FROM drawn GROUP BY 1 HAVING sum(n) >= 3 AND length(word) >= 5
), parts AS (
  SELECT word, substr(word, 1, i) || '$' || substr(word, i + 2) AS p, substr(word, 1, i) || substr(word, i + 2) AS less
  FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word AS a, b.word AS b FROM parts a JOIN parts b ON a.p = b.p AND a.word <> b.word
  UNION SELECT word, less FROM parts WHERE less IN (SELECT word FROM words)
  UNION SELECT less, word FROM parts WHERE less IN (SELECT word FROM words)
), best AS (
  SELECT a, count(*) AS n_near, arg_max(b, (n, -place)) AS b, max(n) AS b_n
  FROM near JOIN (SELECT word, n, row_number() OVER (ORDER BY word) AS place FROM words) w ON w.word = b GROUP BY a
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN b_n >= 2 * n THEN b END AS form,
    CASE WHEN b_n >= 2 * n THEN b_n END AS form_n
  FROM words LEFT JOIN best ON a = word
), way AS (
  SELECT word, word AS at_, form AS next FROM forms
  UNION ALL SELECT way.word, way.next, f.form FROM way JOIN forms f ON f.word = way.next
)
SELECT f.word, f.form, way.at_ AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN way ON way.word = f.word AND way.next IS NULL
"""

#: The same hashes, bins and draws in lists, over texts and edited texts alike.
FINGERPRINTS = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), paired AS (
  SELECT doc_id, text, length(text) AS n, length(text) // 3 AS third, coalesce(lead(doc_id) OVER d, first_value(doc_id) OVER d) AS next_id,
    coalesce(lead(text) OVER d, first_value(text) OVER d) AS next_text
  FROM docs WINDOW d AS (ORDER BY doc_id DESC)
), changed AS (
  SELECT *, substr(text, 1, n - third) || substr(next_text, 1, third) AS edited FROM paired
), texts AS (
  SELECT DISTINCT text FROM changed UNION SELECT edited FROM changed
), words AS (
  SELECT text, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM texts
), hashed AS (
  SELECT text, len(w) AS n, list_sort(list_concat(
    CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' ')))
      WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END,
    list_transform(range(256), lambda b: printf('%02xg', b)))) AS s
  FROM words
), entries AS (
  SELECT text, unnest(s) AS x FROM hashed WHERE n > 0
), bins AS (
  SELECT text, instr('0123456789abcdef', x[1]) * 16 + instr('0123456789abcdef', x[2]) - 17 AS b, min(x) AS x FROM entries GROUP BY ALL
), filled AS (
  SELECT text, list(CASE WHEN length(x) = 32 THEN x END ORDER BY b) AS v FROM bins GROUP BY text
), probes AS (
  SELECT list_transform(range(256), lambda i: list_transform(range(16), lambda t:
    instr('0123456789abcdef', md5(i || ':' || t)[1]) * 16 + instr('0123456789abcdef', md5(i || ':' || t)[2]) - 17)) AS p
), empties AS (
  SELECT text, unnest(list_filter(range(256), lambda i: v[i + 1] IS NULL)) AS i FROM filled
), lent AS (
  SELECT e.text, e.i, list_filter(list_transform(p[e.i + 1], lambda q: v[q + 1]), lambda x: x IS NOT NULL)[1] AS x
  FROM empties e JOIN filled f ON e.text = f.text, probes
), late AS (
  SELECT l.text, l.i, min(md5(l.i || '/' || b.b) || b.x)[33:64] AS x
  FROM lent l JOIN bins b ON b.text = l.text AND length(b.x) = 32 WHERE l.x IS NULL GROUP BY ALL
), borrowed AS (
  SELECT text, i, x FROM lent WHERE x IS NOT NULL UNION ALL SELECT text, i, x FROM late
), digits AS (
  SELECT text, b AS i, x[32] AS digit FROM bins WHERE length(x) = 32
  UNION ALL SELECT text, i, md5(x || ':' || i)[32] FROM borrowed
), prints AS (
  SELECT text, string_agg(digit, '' ORDER BY i) AS f FROM digits GROUP BY text
), named AS (
  SELECT c.doc_id, c.n, sha256(c.edited) AS edited_sha256, coalesce(a.f, '') AS fingerprint,
    coalesce(e.f, '') AS edited_fingerprint, coalesce(x.f, '') AS next_fingerprint
  FROM changed c LEFT JOIN prints a ON a.text = c.text LEFT JOIN prints e ON e.text = c.edited LEFT JOIN prints x ON x.text = c.next_text
), counted AS (
  SELECT *, len(list_filter(range(1, 257), lambda i: fingerprint[i] = edited_fingerprint[i])) AS m,
    len(list_filter(range(1, 257), lambda i: fingerprint[i] = next_fingerprint[i])) AS o FROM named
)
SELECT doc_id, n AS n_chars, edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN fingerprint = '' OR edited_fingerprint = '' THEN (fingerprint = edited_fingerprint)::DOUBLE ELSE greatest(0.0::DOUBLE, (m - 16) / 240.0::DOUBLE) END AS near_edited,
  CASE WHEN fingerprint = '' OR next_fingerprint = '' THEN (fingerprint = next_fingerprint)::DOUBLE ELSE greatest(0.0::DOUBLE, (o - 16) / 240.0::DOUBLE) END AS near_next
FROM counted
"""

#: A prefix is the sequence of 64 hex digits per turn; a node's subtree is every node that begins with it.
PREFIX_TRIE = f"""
WITH {_CRC_TABLE}, turns AS (
  SELECT conv_id, coalesce(text, '') AS text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), plan AS (
  SELECT c, c - c % 5 AS base, {_crc32("c::VARCHAR")} % 9 AS h, n FROM (SELECT conv_id AS c, count(*) AS n FROM turns GROUP BY 1), crc
), sized AS (
  SELECT p.c, p.base, p.h, p.n, least(p.h, coalesce(b.n, 0)) AS taken FROM plan p LEFT JOIN plan b ON b.c = p.base
), rebuilt AS (
  SELECT c, p AS d, t, text FROM sized JOIN turns ON conv_id = base AND p <= taken
  UNION ALL SELECT c, p - h + taken, t, text FROM sized JOIN turns ON conv_id = c AND p > h
), keyed AS (
  SELECT c, d, text, string_agg(t, '') OVER (PARTITION BY c ORDER BY d) AS key FROM rebuilt
  UNION ALL SELECT c, 0, '', '' FROM sized
), nodes AS (
  SELECT key, d AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(strlen(text)) AS saved
  FROM keyed GROUP BY ALL
), ends AS (
  SELECT key, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM keyed
  WHERE d = (SELECT taken + greatest(n - h, 0) FROM sized WHERE sized.c = keyed.c) GROUP BY key
), children AS (
  SELECT left(key, 64 * (depth - 1)::INT) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), full_nodes AS (
  SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (key)
), totals AS (
  SELECT left(key, 64 * up) AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1))::INT AS up FROM full_nodes) GROUP BY 1
)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, t.n_leaves, t.saved_tokens,
  sha256(coalesce(e.ids, '')) AS ends_sha256
FROM full_nodes f JOIN totals t USING (key) LEFT JOIN ends e USING (key)
LEFT JOIN full_nodes p ON f.depth > 0 AND p.key = left(f.key, 64 * (f.depth - 1)::INT)
"""
