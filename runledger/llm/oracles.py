"""SQL texts for the queries that SQL can express, from what each result is, not from how it is computed."""

from __future__ import annotations

#: Checksum of UTF-8 bytes: the reflected polynomial 0xEDB88320 (3988292384), one bit at a time. Fixed value of the checksum.
_BYTES = "list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
_EIGHT = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"


def _crc32(text: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {_BYTES.format(text=text)}), lambda c, b: {_EIGHT}), 4294967295)"


_LOWERED = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce({x}, ''), '[^\x20\x09-\x0D]+')"


def similar_sets(k: int, percent: int, more: str = "") -> str:
    """Documents with equal shares of k-word shingles, and the smallest document that links lead to."""
    words = _WORDS.format(x=_LOWERED.format(x="text"))
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, {words} AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= {percent} * (s.n + t.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, y FROM reached r JOIN ways ON x = r.other)
SELECT r.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(other) AS component_id{more}
FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id"""


SPELLINGS = rf"""
WITH RECURSIVE
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{6,}}')) AS raw FROM documents),
lowered AS (SELECT doc_id, {_LOWERED.format(x="raw")} AS run, count(*) AS times FROM runs GROUP BY ALL),
summed AS (SELECT run, times, {_crc32("(doc_id::VARCHAR || ':' || run)")} AS h FROM lowered),
spelt AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM summed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
holes AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS hole FROM words),
cut AS (SELECT word, n, hole, substr(word, 1, hole - 1) || substr(word, hole + 1) AS rest FROM holes),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.hole = b.hole AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, any_value(n) AS n, count(*) AS n_near, arg_min(other, {{'a': -other_n, 'b': other}}) AS best, max(other_n) AS best_n FROM near GROUP BY word),
forms AS (
  SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * words.n THEN best END AS form, CASE WHEN best_n >= 5 * words.n THEN best_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
paths(word, stop) AS (
  SELECT word, word FROM forms UNION ALL SELECT p.word, f.form FROM paths p JOIN forms f ON f.word = p.stop WHERE f.form IS NOT NULL)
SELECT f.word, f.form, p.stop AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN paths p ON p.word = f.word JOIN forms g ON g.word = p.stop AND g.form IS NULL"""

TRIE = rf"""
WITH
told AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS first_id, {_crc32("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM told)),
lists AS (SELECT conv_id, list(said ORDER BY place) AS turns FROM told GROUP BY conv_id),
rebuilt AS (
  SELECT i.conv_id, list_concat(coalesce(f.turns, [])[:h], o.turns[h + 1:]) AS path
  FROM ids i JOIN lists o ON o.conv_id = i.conv_id LEFT JOIN lists f ON f.conv_id = i.first_id),
steps AS (
  SELECT conv_id, d AS depth, path[:d] AS node, d = len(path) AS ends FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE len({_WORDS.format(x="node[depth].text")}) END AS saved
  FROM steps GROUP BY depth, node),
counted AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n
  LEFT JOIN (SELECT node[:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1) c ON c.node = n.node),
above AS (
  SELECT node, unnest(range(0, depth + 1)) AS up, n_children, saved FROM counted),
sums AS (
  SELECT node[:up] AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY 1)
SELECT c.conv_id, c.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
FROM counted c JOIN sums s ON s.node = c.node LEFT JOIN nodes p ON c.depth > 0 AND p.node = c.node[:c.depth - 1]"""


REPEATED_WORDS = rf"""
WITH words AS (SELECT doc_id, {_WORDS.format(x="text")} AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words)),
firsts AS (SELECT g, min(doc_id) AS first_id FROM windows GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM windows JOIN firsts USING (g) WHERE first_id < doc_id),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id LEFT JOIN removed r ON r.doc_id = w.doc_id"""

_ITEM_WORDS = r"regexp_extract_all(coalesce({x}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LEAKS = rf"""
WITH items AS (SELECT item_id::VARCHAR AS item_id, {_ITEM_WORDS.format(x=_LOWERED.format(x="text"))} AS w FROM benchmark),
known AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(len(w), 10) AS n FROM items WHERE len(w) > 0))),
words AS (SELECT doc_id, {_ITEM_WORDS.format(x=_LOWERED.format(x="text"))} AS w FROM documents),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM known))),
met AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN known k ON k.g = p.g AND k.n = p.n),
hits AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS i FROM met) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items,
  sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM words w LEFT JOIN hits h ON h.doc_id = w.doc_id LEFT JOIN named m ON m.doc_id = w.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": similar_sets(3, 90),
        "op9_decontamination": LEAKS,
        "op10_substring_dedup": REPEATED_WORDS,
        "op11_spelling_variants": SPELLINGS,
        "op12_prefix_trie": TRIE,
        "op13_minhash_dedup": similar_sets(2, 80, ", min(other) = r.doc_id AS kept"),
    }
