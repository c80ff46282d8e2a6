"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from tallyframe.llm import licenses

ORACLES: dict[str, str] = {}

ORACLES["op2"] = r"""
WITH s AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS h
  FROM documents),
a AS (SELECT sk, sum(size)::BIGINT AS source_size FROM s GROUP BY sk),
b AS (SELECT *, (1 + (row_number() OVER (ORDER BY sk) - 1) % 3)::DOUBLE AS w FROM a),
c AS (SELECT *, sum(source_size) OVER ()::DOUBLE AS t,
    coalesce(sum(source_size) OVER (ORDER BY source_size / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS used,
    sum(w) OVER (ORDER BY source_size / w, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM b),
d AS (SELECT *, 3 * source_size::DOUBLE * w_left <= w * (t - 3 * used) AS capped FROM c),
e AS (SELECT sk, source_size, t, w, capped,
    sum(CASE WHEN capped THEN source_size ELSE 0 END) OVER ()::DOUBLE AS used,
    sum(CASE WHEN capped THEN 0.0::DOUBLE ELSE w END) OVER () AS w_left
  FROM d),
shares AS (SELECT sk, source_size, CASE WHEN capped THEN 3 * source_size::DOUBLE ELSE (t - 3 * used) * w / w_left END AS target FROM e),
placed AS (SELECT doc_id, sk, h, size, source_size, target,
    sum(size) OVER (PARTITION BY sk ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto,
    row_number() OVER (PARTITION BY sk ORDER BY h, doc_id NULLS FIRST, size) AS k
  FROM s JOIN shares USING (sk)),
copies AS (SELECT p.*, (r.e * source_size + upto) / target AS finish
  FROM placed p, (SELECT unnest([0, 1, 2]) AS e) r WHERE size > 0 AND target > 0),
queue AS (SELECT sk, k, size, sum(size) OVER (ORDER BY finish, sk, upto ROWS UNBOUNDED PRECEDING) AS total FROM copies),
took AS (SELECT sk, k, sum(size)::BIGINT AS taken FROM queue WHERE total <= (SELECT sum(source_size) FROM a) GROUP BY sk, k)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM placed LEFT JOIN took USING (sk, k)
"""

ORACLES["op3"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS body FROM documents),
l AS (SELECT DISTINCT r, coalesce('=' || source, '') AS site, trim(line) AS line
  FROM (SELECT r, source, unnest(body) AS line FROM d) WHERE trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''),
n AS (SELECT coalesce('=' || source, '') AS site, count(*) AS total FROM documents GROUP BY 1),
b AS (SELECT site, line FROM (SELECT site, line, count(*) AS pages FROM l GROUP BY ALL) JOIN n USING (site)
  WHERE pages >= 3 AND pages > 0.08::DOUBLE * total),
bad AS (SELECT coalesce('=' || source, '') AS site, r, i FROM
    (SELECT r, source, unnest(body) AS line, generate_subscripts(body, 1) AS i FROM d) x
  WHERE EXISTS (SELECT 1 FROM b WHERE b.site = coalesce('=' || x.source, '') AND b.line = trim(x.line))),
gone AS (SELECT r, list(i) AS places FROM bad GROUP BY r)
SELECT doc_id, source,
  CASE WHEN places IS NULL THEN text ELSE array_to_string(
    list_transform(list_filter(list_zip(body, range(1, len(body) + 1)), lambda x: NOT list_contains(places, x[2])), lambda x: x[1]), chr(10)) END AS text,
  coalesce(len(body), 0)::BIGINT AS n_lines, coalesce(len(places), 0)::BIGINT AS n_dropped
FROM d LEFT JOIN gone USING (r)
"""

ORACLES["op10"] = r"""
WITH fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper_, 'abcdefghijklmnopqrstuvwxyz' AS lower_),
d AS (SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, upper_, lower_), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents, fold),
i AS (SELECT row_number() OVER () AS k, item_id,
    coalesce(regexp_extract_all(translate(text, upper_, lower_), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark, fold),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[j:j + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS j FROM i WHERE len(w) > 0)),
g AS (SELECT r, j, n, array_to_string(w[j:j + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
m AS (SELECT r, j, g.n, item_id FROM g JOIN p ON g.n = p.n AND g.g = p.g),
h AS (SELECT r, count(DISTINCT x)::BIGINT AS n_hit FROM (SELECT r, unnest(range(j, j + n)) AS x FROM m) GROUP BY r),
t AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

#: Exact neighbours: equal to the operator's rows as long as its recall is whole.
ORACLES["op6"] = r"""
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: Near words by deletion neighbourhoods, the checksum by its table of 256 remainders.
ORACLES["op12"] = r"""
WITH RECURSIVE tbl AS (SELECT list(t ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) r(i))),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]{5,}')) AS run FROM documents),
per AS (SELECT id, run, count(*) AS k FROM runs GROUP BY ALL),
bytes AS (SELECT *, flatten(list_transform(string_split(id || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM per),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes, tbl),
words AS (SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
holes AS (SELECT DISTINCT word, n, left(word, i - 1) || chr(1) || substring(word, i + 1) AS marked, left(word, i - 1) || substring(word, i + 1) AS hole
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word AS word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.marked = b.marked AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.hole = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.hole = b.word),
best AS (SELECT word, count(*)::BIGINT AS n_near, first(other ORDER BY m DESC, other) AS form, first(m ORDER BY m DESC, other) AS form_n FROM near GROUP BY word),
forms AS (SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END::BIGINT AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.next = f.word)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON f.word = c.word AND c.next IS NULL
"""

ORACLES["op13"] = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, sum(len(w))::BIGINT AS n FROM cut GROUP BY lang),
f AS (SELECT lang, phrase, size, count(*)::BIGINT AS f
  FROM (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
    FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM cut, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size))
  GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
k AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.x JOIN f y ON y.lang = k.lang AND y.phrase = k.y),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE size = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN words USING (lang) QUALIFY rank <= 2000
"""


def _values(x: object) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)


#: The rules' signatures as a table of values; the suppression of one detection by another as a condition on pairs of them.
ORACLES["op11"] = r"""
WITH rules(rule, label, word, pattern, priority, sure, base) AS (VALUES
  {rules}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
t AS (SELECT *, ' ' || array_to_string(w, '  ') || ' ' AS body FROM d),
m AS (SELECT r, rule, label, priority, sure, base, list_transform(regexp_extract_all(body, pattern), lambda x: len(regexp_extract_all(x, '[^ ]+'))) AS inside,
    list_transform(regexp_split_to_array(body, pattern), lambda x: len(regexp_extract_all(x, '[^ ]+'))) AS before
  FROM t JOIN rules ON contains(body, word) WHERE regexp_matches(body, pattern)),
h AS (SELECT r, rule, label, priority, sure, base, list_sum(before[1:i]) + coalesce(list_sum(inside[1:i - 1]), 0) AS s, list_sum(before[1:i]) + list_sum(inside[1:i]) AS e
  FROM (SELECT *, unnest(range(1, len(inside) + 1)) AS i FROM m)),
kept AS (SELECT * FROM h WHERE base OR NOT EXISTS (SELECT 1 FROM h o WHERE o.r = h.r AND o.s <= h.s AND o.e >= h.e
    AND (o.priority > h.priority OR o.priority = h.priority AND (o.e - o.s > h.e - h.s OR o.e - o.s = h.e - h.s AND o.rule < h.rule)))),
l AS (SELECT r, label, max(sure) AS sure FROM kept GROUP BY r, label),
a AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels, 1 - list_reduce(list_prepend(1::DOUBLE, list(1 - sure ORDER BY label)), lambda x, y: x * y) AS score FROM l GROUP BY r),
b AS (SELECT r, count(*)::BIGINT AS n_base, min(s)::BIGINT AS first_word, max(s)::BIGINT AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM kept WHERE base GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN a USING (r) LEFT JOIN b USING (r)
""".replace(
    "{rules}",
    ",\n  ".join(f"({', '.join(map(_values, (i, x.label, x.literal, x.expression, *x.strength, x.base)))})" for i, x in enumerate(licenses.rules())),
)
