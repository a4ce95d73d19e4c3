"""SQL (DuckDB) for the registered queries that SQL can express over whole tables."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUFFIX_ARRAY_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS h FROM d, unnest(range(0, length(x) // 2 - 199)) AS t(i)),
starts AS (SELECT doc_id, i FROM win SEMI JOIN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) USING (h)),
runs AS (SELECT doc_id, i, sum(CASE WHEN i - before > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM starts)),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM runs GROUP BY doc_id, run),
cuts AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM spans),
parts AS (SELECT doc_id, string_agg(substr(x, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS head, max(hi) AS last,
  sum(hi - lo) AS gone, count(*) AS n FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN parts USING (doc_id)"""

MINHASH_NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) AS w
  FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS h FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_in JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT ways.b, reach.c FROM reach JOIN ways ON ways.a = reach.doc_id)
SELECT doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id, min(c) = doc_id AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id"""

SUFFIX_TREE_DEDUP = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
win AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 12], ' ')) AS h FROM d, unnest(range(1, len(w) - 11)) AS t(k)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, k + j AS p FROM win JOIN least USING (h), unnest(range(0, 13)) AS u(j) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS s, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p)
  GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

#: CRC-32 over lists of byte values, by the table of its polynomial.
_CRC = """crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _crc32(codes: str) -> str:
    step = f"list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))"
    return f"xor({step}, 4294967295)"


_UTF8 = "flatten(list_transform(string_split(s, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT] ELSE [195, ord(ch)::BIGINT - 64] END))"

SPELLING_VARIANTS = f"""
WITH RECURSIVE {_CRC},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
  '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
one AS (SELECT run, concat(doc_id, ':', run) AS s, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY ALL),
summed AS (SELECT run, k, {_crc32(_UTF8)} AS h FROM one, crc),
cut AS (SELECT k, CASE WHEN h % 199 = 0
    THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM summed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
gaps AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS gap,
  substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM places),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.word <> b.word
  UNION SELECT gaps.word, words.word, words.n FROM gaps JOIN words ON gaps.less = words.word
  UNION SELECT words.word, gaps.word, gaps.n FROM gaps JOIN words ON gaps.less = words.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, struct_pack(less := -near_n, near := near)) AS near, max(near_n) AS near_n
  FROM pairs GROUP BY word),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form,
  CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
walk(word, here) AS (SELECT word, word FROM words
  UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.here WHERE form IS NOT NULL),
ends AS (SELECT walk.word, here AS root FROM walk JOIN formed ON formed.word = walk.here WHERE form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed JOIN ends USING (word)"""

CONVERSATION_TRIE = f"""
WITH {_CRC},
turns AS (SELECT conv_id AS c, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS k,
  len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS w,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {_crc32("list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: ord(ch)::BIGINT)")} % 4 AS h
  FROM (SELECT DISTINCT c FROM turns), crc),
parts AS (SELECT c, 1 AS p, i, k, w FROM turns JOIN convs USING (c) WHERE i > h
  UNION ALL SELECT convs.c, 0, i, k, w FROM convs JOIN turns ON turns.c = convs.c - ((convs.c % 20) + 20) % 20 WHERE i <= h),
rows AS (SELECT c, k, w, row_number() OVER o AS d, string_agg(k, '') OVER o AS path FROM parts WINDOW o AS (PARTITION BY c ORDER BY p, i)),
members AS (SELECT c, d, path, path[:-65] AS above, w FROM rows UNION ALL SELECT c, 0, '', NULL, 0 FROM convs),
lengths AS (SELECT c, max(d) AS d FROM members GROUP BY c),
nodes AS (SELECT path, min(c) AS conv_id, any_value(d) AS depth, any_value(above) AS above, count(*) AS n_convs,
  (count(*) - 1) * any_value(w) AS saved FROM members GROUP BY path),
ends AS (SELECT path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM members JOIN lengths USING (c, d) GROUP BY path),
kids AS (SELECT above AS path, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above),
below AS (SELECT a.path, sum(b.saved) AS saved_tokens, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves
  FROM nodes a JOIN nodes b ON starts_with(b.path, a.path) LEFT JOIN kids ON kids.path = b.path GROUP BY a.path)
SELECT nodes.conv_id, CAST(nodes.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(nodes.n_convs AS BIGINT) AS n_convs,
  CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes JOIN below ON below.path = nodes.path LEFT JOIN nodes up ON up.path = nodes.above
LEFT JOIN kids ON kids.path = nodes.path LEFT JOIN ends ON ends.path = nodes.path"""

ORACLES = {
    "op12_spelling_variants": SPELLING_VARIANTS,
    "op13_conversation_trie": CONVERSATION_TRIE,
    "op4_suffix_array_dedup": SUFFIX_ARRAY_DEDUP,
    "op6_minhash_near_dedup": MINHASH_NEAR_DEDUP,
    "op8_suffix_tree_dedup": SUFFIX_TREE_DEDUP,
}
