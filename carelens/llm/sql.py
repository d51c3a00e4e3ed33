"""DuckDB SQL that gives the same rows as the registered queries, where SQL can."""

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '')"

OP1 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS w
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY w) < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM hit),
per AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
                CASE WHEN gone IS NULL THEN words
                     ELSE list_filter(words, lambda x, j: NOT list_contains(gone, j)) END AS k
         FROM d LEFT JOIN per USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
       sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept
"""

OP2 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {WORDS} AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)),
                              lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS lines
           FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) FROM rep)
        GROUP BY doc_id),
l0 AS (SELECT doc_id, source, unnest(lines) AS line FROM d),
l1 AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'),
                                                  '[^\p{{L}}0]+', ' ', 'g')) AS norm,
              len(list_filter(regexp_split_to_array(line, '[ \x09-\x0D]+'), lambda x: x <> '')) AS w
       FROM l0),
l2 AS (SELECT doc_id, source, md5(norm)[1:16] AS h, w FROM l1 WHERE norm <> ''),
l3 AS (SELECT l2.doc_id, l2.source, h, w, md5(text) AS whole FROM l2 JOIN documents USING (doc_id)),
c1 AS (SELECT source, h, whole, min(doc_id) AS first_id FROM l3 GROUP BY 1, 2, 3),
hosts AS (SELECT source, count(DISTINCT md5(text)) AS docs FROM documents GROUP BY 1),
c2 AS (SELECT source, h, count(*) AS n, arg_min(whole, first_id) AS first FROM c1 GROUP BY 1, 2),
common AS (SELECT c2.source, h, first FROM c2 JOIN hosts ON c2.source IS NOT DISTINCT FROM hosts.source
           WHERE n > 20 AND n * 100 > docs * 2),
lost AS (SELECT l3.doc_id, sum(w) AS lost FROM l3 JOIN common c
         ON l3.source IS NOT DISTINCT FROM c.source AND l3.h = c.h AND whole <> first GROUP BY 1),
fig AS (SELECT d.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
               length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
               len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
               len(words) - coalesce(lost, 0) AS n_kept_words
        FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id)),
base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM fig)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
       n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       n_kept_words::BIGINT AS n_kept_words,
       NOT base_failed AND n_kept_words >= 20 AND n_kept_words * 100 >= n_words * 10 AS kept
FROM base
"""

# crc32 by its table; words hold no code point above U+00FF, so UTF-8 is one byte or 195 and one
OP11 = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1
              THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS tab FROM range(256) t(i)),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
hashed AS (SELECT w, xor(list_reduce(list_concat([4294967295], flatten(list_transform(
                  string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''),
                  lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
                                 ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
                  lambda h, b: xor(h // 256, tab[xor(h % 256, b) + 1])), 4294967295) AS h
           FROM runs, crc),
words AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2)
                      ELSE w END AS word FROM hashed),
v AS (SELECT word, count(*) AS n FROM words WHERE length(word) >= 7 GROUP BY 1 HAVING count(*) >= 2),
holes AS (SELECT DISTINCT word, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b
          FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
shorter AS (SELECT DISTINCT h.word AS longer, v.word FROM holes h JOIN v ON v.word = h.a || h.b),
near AS (SELECT x.word, y.word AS other FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.b = y.b
         WHERE x.word <> y.word
         UNION ALL SELECT longer, word FROM shorter UNION ALL SELECT word, longer FROM shorter),
best AS (SELECT near.word, count(*) AS n_near, arg_min(other, (-o.n, other)) AS form, max(o.n) AS form_n
         FROM near JOIN v o ON o.word = other GROUP BY 1),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * v.n THEN form END AS form,
                  CASE WHEN form_n >= 10 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS here FROM formed
         UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.here WHERE f.form IS NOT NULL),
roots AS (SELECT walk.word, here AS root FROM walk JOIN formed f ON f.word = walk.here WHERE f.form IS NULL)
SELECT word, n::BIGINT AS n, form, root, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM formed JOIN roots USING (word)
"""

OP12 = r"""
WITH terms(tab, id, row, t) AS (
  SELECT 'd', doc_id, row, unnest(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+'))
  FROM (SELECT *, row_number() OVER () AS row FROM documents)
  UNION ALL
  SELECT 'q', item_id, row, unnest(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+'))
  FROM (SELECT *, row_number() OVER () AS row FROM benchmark)),
low AS (SELECT tab, id, row, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM terms),
tf AS (SELECT tab, id, row, t, count(*) AS tf FROM low GROUP BY ALL),
total AS (SELECT count(DISTINCT row) AS nd, count(*) AS len FROM low WHERE tab = 'd'),
weight AS (SELECT t, floor(1000 * ln((2 * max(nd) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
           FROM tf, total WHERE tab = 'd' GROUP BY t),
docs AS (SELECT row, max(id) AS doc_id, (25 + (75 * sum(tf) * max(nd)) // max(len))::BIGINT AS m
         FROM tf, total WHERE tab = 'd' GROUP BY row),
scored AS (SELECT q.id AS item_id, q.row AS item, d.row,
                  sum(q.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * m)))::BIGINT AS score, max(doc_id) AS doc_id
           FROM tf q JOIN tf d ON q.tab = 'q' AND d.tab = 'd' AND q.t = d.t JOIN weight ON weight.t = q.t
           JOIN docs ON docs.row = d.row GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank
           FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def _letters(word: str) -> str:
    """The word in either case, A-Z only."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Kind, RE2 expression, group, least length of the group: the rules of operator 13 in SQL.
SECRETS = (
    ("assign", "(" + "|".join(map(_letters, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
     r"[\"\x27]?\x20*[:=]\x20*[\"\x27]?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 0, 1),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("google", "AIza[A-Za-z0-9_-]+", 0, 39),
    ("stripe", "[rs]k_(live|test)_[A-Za-z0-9]+", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 36),
    ("bearer", _letters("authorization") + r"\x20*[:=]\x20*[\"\x27]?" + _letters("bearer")
     + r"\x20+([A-Za-z0-9._~+/=-]+)", 1, 16),
    ("url_login", r"://[A-Za-z0-9._%-]+:([^\x00-\x20@/:]+)@", 1, 4),
)


def _secret_sql(rule: int) -> str:
    kind, pattern, group, least = SECRETS[rule]
    return rf"""
  SELECT row, {rule} AS rule, '{kind}' AS kind, list_sum(list_transform(gaps[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s, length(hits[i]) AS size
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
          SELECT row, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits,
                 regexp_extract_all(t, '{pattern}', {group}) AS part FROM d))
  WHERE length(part[i]) >= {least}"""


OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(map(_secret_sql, range(len(SECRETS))))}),
named AS (SELECT *, kind || ':' || s::BIGINT || ':' || (s + size)::BIGINT AS span FROM found),
per AS (SELECT row, string_agg(span, ',' ORDER BY s, rule) AS spans,
               string_agg(span, ',' ORDER BY s, rule) FILTER (rule < 3) AS base,
               count(*) FILTER (rule = 0) AS n_assign, count(*) FILTER (rule = 1) AS n_access,
               count(*) FILTER (rule = 2) AS n_hex FROM named GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (row)
"""
