"""DuckDB SQL for the training-data queries that SQL can express, written from the contracts.

The classifiers (5, 8), tokenized packing (4), licence rules (2) and the patterns with checks of op6 have none; tests
compare them with brute force, exact round trips or held-out accuracy.
"""

from __future__ import annotations

from . import quality_rules as Q

_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1 = f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(x="coalesce(text, '')")} AS w FROM documents),
s AS (SELECT r, doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS id, count(*) AS copies FROM s GROUP BY 1),
g AS (SELECT id, len(s) AS n, unnest(s) AS gram FROM classes),
shared AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.id <> b.id GROUP BY 1, 2, 3, 4),
linked AS (SELECT a, b FROM shared WHERE c >= 0.8 * (na + nb - c) - 1e-6),
reach AS (SELECT a, b FROM linked UNION SELECT reach.a, linked.b FROM reach JOIN linked ON reach.b = linked.a),
low AS (SELECT a, min(least(a, b)) AS component FROM reach GROUP BY 1),
deg AS (SELECT a, sum(c.copies) AS links FROM linked JOIN classes c ON c.id = linked.b GROUP BY 1)
SELECT s.doc_id, coalesce(low.component, c.id) AS class_id, c.id AS copy_id, c.copies AS n_copies, CAST(coalesce(deg.links, 0) + c.copies - 1 AS BIGINT) AS n_links
FROM s JOIN classes c ON c.s = list_sort(s.s) LEFT JOIN low ON low.a = c.id LEFT JOIN deg ON deg.a = c.id
UNION ALL SELECT doc_id, doc_id, doc_id, 1, 0 FROM w WHERE len(w) = 0"""

OP3 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), f AS (SELECT *, sha1(b) AS h FROM p), g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM f),
d AS (SELECT *, CAST(CAST(unhex(h) AS BIT) AS VARCHAR) AS bits FROM g)
SELECT page_id, octet_length(b) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER)
  + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER) + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""

_JS = "CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) / 2 ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) / 2 ELSE 0 END"
_CLASS = " + ".join(f"({_JS.format(p=f'r.{c}', q=f'(m.{c} / m.total)')})" for c in Q.CLASSES)
OP7 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, lang, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
grams AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
m0 AS (SELECT w.r, doc_id, lang, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, length(t) AS chars, len(regexp_extract_all(t, '[A-Z]')) * 1e0 AS upper, len(regexp_extract_all(t, '[0-9]')) * 1e0 AS digit, len(regexp_extract_all(t, '[.,;:!?''"()-]')) * 1e0 AS punct,
  (octet_length(encode(t)) - length(t)) * 1e0 AS wide FROM w LEFT JOIN rep USING (r)),
m1 AS (SELECT *, (chars - word_chars) * 1e0 AS blank, n_symbols * 1e0 AS symbol, greatest(word_chars - upper - digit - punct - n_symbols - wide, 0) * 1e0 AS lower FROM m0),
m AS (SELECT *, lower + upper + digit + blank + punct + symbol + wide AS total FROM m1),
l AS (SELECT lang, sum(chars) AS chars, sum(n_words) AS words, sum(total) AS total, {", ".join(f"sum({c}) AS {c}" for c in Q.CLASSES)} FROM m WHERE lang IS NOT NULL GROUP BY 1),
refs AS (SELECT lang, {", ".join(f"{c} / total AS {c}" for c in Q.CLASSES)} FROM l WHERE chars >= {Q.MIN_LANGUAGE_CHARS}), sized AS (SELECT lang, words FROM l WHERE words >= {Q.MIN_LANGUAGE_WORDS}),
tok AS (SELECT r, lang, unnest(regexp_extract_all(lower(t), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')) AS word FROM d JOIN sized USING (lang)),
common AS (SELECT lang, word, n * 1e0 / words AS p FROM (SELECT lang, word, count(*) AS n FROM tok GROUP BY 1, 2) JOIN sized USING (lang) WHERE n * 1e0 / words >= {Q.COMMON_SHARE}),
shares AS (SELECT lang, sum(p) AS p_common FROM common GROUP BY 1),
hist AS (SELECT r, s.lang, word, p, least(count(*) * 1e0 / greatest(n_words, 1), 1e0) AS q FROM tok s JOIN common USING (lang, word) JOIN m USING (r) GROUP BY r, s.lang, word, p, n_words),
seen AS (SELECT r, sum({_JS.format(p="p", q="q")}) AS seen, sum(p) AS p_seen, sum(q) AS q_seen FROM hist GROUP BY 1),
j AS (SELECT m.doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.n_words < 50 OR 100 * m.n_repeat_words > 50 * m.n_words AS base_failed,
  CASE WHEN r.lang IS NOT NULL AND m.chars >= {Q.MIN_CHARS} THEN sqrt(least(greatest({_CLASS}, 0), 1)) END AS class_distance,
  CASE WHEN s.lang IS NOT NULL AND m.n_words >= {Q.MIN_WORDS} THEN sqrt(least(greatest(coalesce(seen, 0) + (p_common - coalesce(p_seen, 0)) / 2 + {_JS.format(p="greatest(1 - p_common, 0)", q="greatest(1 - coalesce(q_seen, 0), 0)")}, 0), 1)) END AS word_distance
  FROM m LEFT JOIN refs r USING (lang) LEFT JOIN shares s ON s.lang = m.lang LEFT JOIN seen ON seen.r = m.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance,
  NOT base_failed AND NOT (coalesce(class_distance, 0) > {Q.MAX_CLASS_DISTANCE} OR coalesce(word_distance, 0) > {Q.MAX_WORD_DISTANCE}) AS kept FROM j"""

OP9 = f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(x="coalesce(text, '')")} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(x="coalesce(text, '')")} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, i, p.n, item FROM places p JOIN win ON win.n = p.n AND win.g = p.g),
found AS (SELECT r, string_agg(item, ',' ORDER BY item) AS items, count(*) AS n_items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY 1),
covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN found USING (r) LEFT JOIN covered USING (r)"""

_KEY = _LOWER.format(x="regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', '')")
OP10 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS line FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
k AS (SELECT *, {_KEY} AS key FROM l),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
j AS (SELECT k.*, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY r, doc_id"""

OP11 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(x="coalesce(text, '')")} AS w FROM documents),
sized AS (SELECT r, doc_id, w, len(w) AS n FROM d WHERE len(w) > 0), total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS l FROM sized),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM sized) GROUP BY 1, 2),
i AS (SELECT row_number() OVER () AS i, item_id, {_WORDS.format(x="coalesce(text, '')")} AS w FROM benchmark), q AS (SELECT DISTINCT i, item_id, t FROM (SELECT i, item_id, unnest(w) AS t FROM i)),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tf WHERE t IN (SELECT t FROM q) GROUP BY 1), total),
parts AS (SELECT r, tf.t, weights.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // l))) AS part FROM tf JOIN weights USING (t) JOIN sized USING (r), total),
s AS (SELECT i, item_id, r, CAST(sum(part) AS BIGINT) AS score FROM q JOIN parts USING (t) GROUP BY 1, 2, 3 HAVING sum(part) > 0),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN sized USING (r))
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10"""

_P = "(1 + (1000000000::HUGEINT * ({c} + 1)) // {d})"
_F = "(({p} - {q}) * ({p} - {q})) // {q}"
OP12 = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format(x="coalesce(text, '')")} AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d), groups AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3), own AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
cells AS (SELECT g.lang, g.source, k.term, coalesce(own.n, 0) AS c, k.n AS c_lang FROM groups g JOIN kept k USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = k.term),
totals AS (SELECT lang, source, sum(c) + count(*) AS d, sum(c_lang) + count(*) AS d_lang FROM cells GROUP BY 1, 2),
p AS (SELECT lang, source, term, c, {_P.format(c="c", d="d")} AS p, {_P.format(c="c_lang", d="d_lang")} AS q FROM cells JOIN totals USING (lang, source)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum({_F.format(p="a.p", q="b.p")}) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, {_F.format(p="p", q="q")} AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""

ORACLE_SQL = {"op11_lexical_search": OP11, "op12_source_audit": OP12, "op1_ngram_jaccard_join": OP1, "op3_warc": OP3, "op7_quality_rules": OP7, "op9_decontamination": OP9, "op10_line_dedup": OP10}
