"""DuckDB SQL for the queries that SQL can express, over the same whole tables."""

from __future__ import annotations

from weftline.llm.leaks import EXAMPLES, MOST_OWNERS, MOST_REPOSITORIES
from weftline.llm.licenses import PHRASES, TEMPLATES, LicenseScan
from weftline.llm.quality import REFERENCES

WORD = r"[^\x20\x09-\x0D]+"

#: Vectors are compared pair by pair; components are followed along the links.
EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
  r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
  c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists."""
    one = "CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / (z[1] + z[2])) ELSE 0 END"
    terms = f"list_transform(list_zip({p}, {q}), lambda z: {one.format(x='z[1]')} + {one.format(x='z[2]')})"
    return f"sqrt(greatest(0, list_sum({terms}) / 2))"


def _quality() -> str:
    chars = "CASE lang " + " ".join(f"WHEN '{n}' THEN {list(r.chars)}" for n, r in REFERENCES.items()) + " END"
    names = "CASE lang " + " ".join(f"WHEN '{n}' THEN {list(r.words)}" for n, r in REFERENCES.items()) + " END"
    shares = "CASE lang " + " ".join(f"WHEN '{n}' THEN {[*r.words.values(), 1 - sum(r.words.values())]}" for n, r in REFERENCES.items()) + " END"
    return f"""WITH t AS (SELECT doc_id, lang, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '{WORD}') AS w FROM documents),
  win AS (SELECT doc_id, unnest(generate_series(1, len(w) - 4)) AS i, w FROM t WHERE len(w) >= 5), g AS (SELECT doc_id, i, w[i:i+4] AS words FROM win),
  often AS (SELECT doc_id, words FROM g GROUP BY 1, 2 HAVING count(*) > 1), inside AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g JOIN often USING (doc_id, words), range(5) r(k) GROUP BY 1),
  lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS l FROM t),
  b AS (SELECT t.*, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(COALESCE(n, 0) AS BIGINT) AS n_repeat_words FROM t JOIN lines USING (doc_id) LEFT JOIN inside USING (doc_id)),
  h AS (SELECT *, [length(text) - word_chars, length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')), length(text) - length(regexp_replace(text, '\\p{{Nd}}', '', 'g')), length(text) - length(regexp_replace(text, '[^\\P{{P}}#*%&]', '', 'g')), n_symbols] AS c,
    list_transform({names}, lambda x: len(list_filter(list_transform(w, lambda y: lower(y)), lambda y: y = x)) / greatest(n_words, 1)) AS s FROM b),
  d AS (SELECT *, CASE WHEN length(text) >= 100 THEN {_distance("list_append(list_transform(c, lambda x: x / length(text)), greatest(0, (length(text) - list_sum(c)) / length(text)))", chars)} END AS by_char, CASE WHEN n_words >= 30 THEN {_distance("list_append(s, greatest(0, 1 - list_sum(s)))", shares)} END AS by_word, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM h)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND COALESCE(by_char, 0) <= 0.17 AND COALESCE(by_word, 0) <= 0.33 AS kept FROM d"""


#: The checksum's table is made by its rule.
SHARDS = """WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
  d AS (SELECT doc_id, source, COALESCE('=' || source, '') AS stratum, CAST(strlen(COALESCE(text, '')) + 16 AS BIGINT) AS size, hex(encode(COALESCE(text, ''))) AS h FROM documents),
  c AS (SELECT doc_id, size, stratum, CAST(xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS BIGINT) AS text_crc32 FROM d, crc), s AS (SELECT *, md5(concat_ws('|', '17', doc_id, text_crc32)) AS key FROM c),
  f AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id, text_crc32, size) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS share FROM s),
  p AS (SELECT *, row_number() OVER (ORDER BY share, stratum) - 1 AS pos, count(*) OVER () AS n FROM f)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(pos * 40 // n AS INTEGER) AS shard, CAST(pos - ((pos * 40 // n) * n + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p"""

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WARC = f"""WITH p AS (SELECT page_id, COALESCE(html, '') AS html, sha1(COALESCE(html, '')) AS h FROM pages), m AS (SELECT html, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('{BASE32}', CAST((CAST('0x' || substr(h, CAST(k * 5 // 4 + 1 AS BIGINT), 2) || '0' AS BIGINT) >> CAST(7 - k * 5 % 4 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN m USING (html)"""

#: Documents of equal favour have one expected number of copies; the common factor is that of the first favour, from the
#: greatest down, whose documents aren't full.
MIXING = f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
  k AS (SELECT *, md5('17|' || COALESCE(CAST(doc_id AS VARCHAR), '') || '|' || size) AS key, CASE WHEN size BETWEEN 50 AND 5000 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS favour FROM d),
  u AS (SELECT *, (CAST('0x' || substr(key, 1, 13) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM k),
  s AS (SELECT source, sum(size)::DOUBLE AS total, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM u GROUP BY 1), w AS (SELECT *, CAST([3, 1, 2][(n - 1) % 3 + 1] AS DOUBLE) AS weight, 2 * total AS full_size FROM s),
  lv AS (SELECT *, (1.5::DOUBLE * sum(total) OVER () - COALESCE(sum(full_size) OVER (ORDER BY full_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY full_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
  t AS (SELECT source, total, least(full_size, COALESCE((SELECT arg_min(level, full_size / weight) FROM lv WHERE level * weight <= full_size) * weight, full_size)) AS target FROM lv),
  f AS (SELECT source, favour, sum(size)::DOUBLE AS words FROM u GROUP BY 1, 2),
  fs AS (SELECT f.source, f.favour, (t.target - COALESCE(sum(2 * words) OVER (PARTITION BY f.source ORDER BY favour DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(favour * words) OVER (PARTITION BY f.source ORDER BY favour DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM f JOIN t ON f.source IS NOT DISTINCT FROM t.source),
  sc AS (SELECT source, arg_max(scale, favour) AS scale FROM fs WHERE scale * favour <= 2 * (1 + 1e-12::DOUBLE) GROUP BY 1),
  x AS (SELECT u.*, t.total, t.target, t.target / t.total AS ratio, least(2.0::DOUBLE, COALESCE(sc.scale * u.favour, 2.0::DOUBLE)) AS expected FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source LEFT JOIN sc ON sc.source IS NOT DISTINCT FROM u.source),
  o AS (SELECT *, floor(expected) AS whole, least(greatest(u, 1e-9), 1 - 1e-9::DOUBLE) AS pu, least(greatest(expected - floor(expected), 1e-9), 1 - 1e-9::DOUBLE) AS pe, least(greatest(ratio - floor(ratio), 1e-9), 1 - 1e-9::DOUBLE) AS pr FROM x),
  r AS (SELECT *, pu / (1 - pu) / (pe / (1 - pe)) * (pr / (1 - pr)) AS rank FROM o), q AS (SELECT *, rank / (1 + rank) AS place, target - sum(whole * size) OVER (PARTITION BY source) AS budget FROM r),
  z AS (SELECT *, sum(CASE WHEN whole < 2 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY place, key) - size / 2.0::DOUBLE AS middle FROM q)
SELECT doc_id, size, CAST(total AS BIGINT) AS source_size, target, CAST((whole + CASE WHEN whole < 2 AND middle <= budget THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM z"""


def _licenses() -> str:
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    places = ["CASE WHEN len(w) >= {n} THEN list_filter(range(0, len(w) - {n} + 1), lambda i: {c}) ELSE [] END".format(n=len(p.split()), c=" AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split()))) for p, _ in PHRASES]
    templates = ", ".join(f"('{label}', {sorted(set(sentence.split()))})" for label, sentence in TEMPLATES)
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES))
    every = " || ".join(f"p{k}" for k in range(len(PHRASES)))
    return f"""WITH d AS (SELECT doc_id, {lower} AS t, regexp_extract_all({lower}, '{words}') AS w FROM documents), tpl(label, want) AS (VALUES {templates}),
  s AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM d), lines AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM s),
  h AS (SELECT doc_id, list_distinct(regexp_extract_all(array_to_string(l[k:k + {LicenseScan.lines - 1}], ' '), '{words}')) AS have FROM lines),
  m AS (SELECT doc_id, label, len(list_intersect(have, want)) / len(want) AS c FROM h, tpl WHERE len(list_intersect(have, want)) >= 0.8 * len(want) - 1e-9),
  f AS (SELECT doc_id, list(DISTINCT label) AS found, max(c) AS best FROM m GROUP BY 1),
  p AS (SELECT doc_id, len(w) AS n, {", ".join(f"{c} AS p{k}" for k, c in enumerate(places))} FROM d),
  b AS (SELECT *, {every} AS pos, list_sort(list_distinct(list_filter([{base}], lambda x: x IS NOT NULL))) AS bl FROM p)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(pos) AS BIGINT) AS n_base, CAST(list_min(pos) AS BIGINT) AS first_word, CAST(list_max(pos) AS BIGINT) AS last_word, array_to_string(bl, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(bl, COALESCE(found, [])))), ',') AS labels, CAST(COALESCE(best, CASE WHEN len(pos) > 0 THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS score FROM b LEFT JOIN f USING (doc_id)"""


#: One checksum per distinct word.
IMPORTANCE = r"""WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
  d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  b AS (SELECT unnest(regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
  dw AS (SELECT doc_id, unnest(w) AS word FROM d), dc AS (SELECT doc_id, word, count(*) AS n FROM dw GROUP BY 1, 2), words AS (SELECT word FROM dc UNION SELECT word FROM b),
  h AS (SELECT word, hex(encode(word)) AS h FROM words),
  k AS (SELECT word, CAST(xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]))) AS BIGINT) % 10000 AS bucket FROM h, crc),
  s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM dc JOIN k USING (word) GROUP BY 1), t AS (SELECT bucket, count(*)::DOUBLE AS t FROM b JOIN k USING (word) GROUP BY 1),
  g AS (SELECT r.range AS bucket, COALESCE(s, 0) AS s, COALESCE(t, 0) AS t FROM range(10000) r LEFT JOIN s ON s.bucket = r.range LEFT JOIN t ON t.bucket = r.range),
  gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM g),
  m AS (SELECT doc_id, sum(n) AS n, sum(n * gain) AS total FROM dc JOIN k USING (word) JOIN gain USING (bucket) GROUP BY 1),
  x AS (SELECT d.doc_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_features, CAST(COALESCE(floor(total::DOUBLE / n::DOUBLE), 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT)::DOUBLE AS h FROM d LEFT JOIN m USING (doc_id)),
  y AS (SELECT doc_id, n_features, weight, CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
  r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM r"""

#: Every node is a list of turns; what lies below it is found by cutting the lists of all nodes.
TRIE = """WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
  o AS (SELECT conv_id, list({'role': COALESCE(role, ''), 'text': COALESCE(text, '')} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
  h AS (SELECT conv_id, turns, hex(encode(CAST(conv_id AS VARCHAR))) AS h FROM o),
  c AS (SELECT conv_id, turns, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]))) % 6 AS h FROM h, crc),
  r AS (SELECT c.conv_id, list_concat(COALESCE(b.turns[:c.h], []), c.turns[c.h + 1:]) AS path FROM c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 100),
  p AS (SELECT conv_id, unnest(range(0, len(path) + 1)) AS depth, path FROM r),
  n AS (SELECT CASE WHEN depth = 0 THEN '' ELSE CAST(path[:depth] AS VARCHAR) END AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(path[:depth]) AS path, sha256(COALESCE(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(path) = depth), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
  q AS (SELECT *, CASE WHEN depth = 1 THEN '' WHEN depth > 1 THEN CAST(path[:depth - 1] AS VARCHAR) END AS parent, CASE WHEN depth > 0 THEN length(path[depth].text) ELSE 0 END AS tokens FROM n),
  kids AS (SELECT parent AS node, count(*) AS n FROM q WHERE depth > 0 GROUP BY 1),
  w AS (SELECT q.*, COALESCE(kids.n, 0) AS n_children FROM q LEFT JOIN kids USING (node)),
  up AS (SELECT unnest(range(0, depth + 1)) AS d, path, tokens, n_convs, n_children FROM w),
  sub AS (SELECT CASE WHEN d = 0 THEN '' ELSE CAST(path[:d] AS VARCHAR) END AS node, sum((n_convs - 1) * tokens) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves FROM up GROUP BY 1)
SELECT w.conv_id, w.depth, q.conv_id AS parent_conv_id, w.n_convs, CAST(w.n_children AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, w.ends_sha256 FROM w JOIN sub USING (node) LEFT JOIN q ON q.node = w.parent"""


def _places(kind: str, pattern: str, value: str = "m") -> str:
    """Rows doc_id, kind, s, e, value of all matches of a pattern without groups: matches are put between two marks and cut apart."""
    return f"""SELECT doc_id, '{kind}' AS kind, s, s + length(m) AS e, m, {value} AS value FROM (SELECT doc_id, length(array_to_string(list_transform(parts[:k], lambda x: replace(x, chr(2), '')), '')) AS s, string_split(parts[k + 1], chr(2))[1] AS m
    FROM (SELECT doc_id, parts, unnest(range(1, len(parts))) AS k FROM (SELECT doc_id, string_split(regexp_replace(text, '({pattern})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM d)))"""


def _secrets() -> str:
    word = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    front = f"""(?:{word('password')}|{word('passwd')}|{word('secret')}|{word('token')}|{word('api')}_?{word('key')})["'']? *[:=] *["'']?"""
    bits = "list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: -(length(value) - length(replace(value, c, ''))) / length(value) * log2((length(value) - length(replace(value, c, ''))) / length(value))))"
    plain = " AND ".join(f"NOT contains(lower(value), '{x}')" for x in EXAMPLES)
    return f"""WITH d AS (SELECT doc_id, COALESCE(source, '') AS owner, COALESCE(lang, '') AS repository, COALESCE(text, '') AS text FROM documents),
  assign AS ({_places('assign', front + '[A-Za-z0-9+/_.=-]+', f"regexp_replace(m, '^{front}', '')")}), access AS ({_places('access', 'AKIA[A-Z0-9]{16,}')}), hex AS ({_places('hex', '[0-9a-f]{24,}')}), loose AS ({_places('loose', '[A-Za-z0-9_-]{20,}')}),
  every AS (SELECT *, 1 AS k, length(value) >= 6 AS base FROM assign UNION ALL SELECT *, 2, length(m) >= 20 FROM access UNION ALL SELECT *, 3, length(m) >= 24 FROM hex UNION ALL SELECT *, 4, false FROM loose WHERE length(m) >= 20),
  looks AS (SELECT DISTINCT doc_id, e - length(value) AS s, e, value FROM every WHERE (k IN (1, 4) OR base) AND length(value) >= 16 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND {plain} AND {bits} >= 3.0),
  held AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT owner || '|' || repository) AS repositories FROM looks JOIN d USING (doc_id) GROUP BY 1),
  judged AS (SELECT doc_id, s, e, owners <= {MOST_OWNERS} AND repositories <= {MOST_REPOSITORIES} AS live FROM looks JOIN held USING (value)),
  spans AS (SELECT doc_id, kind, k, s, e FROM every WHERE base UNION ALL SELECT doc_id, 'live', 4, s, e FROM judged WHERE live),
  b AS (SELECT doc_id, count(*) FILTER (WHERE k = 1) AS n1, count(*) FILTER (WHERE k = 2) AS n2, count(*) FILTER (WHERE k = 3) AS n3, count(*) FILTER (WHERE k = 4) AS n4, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (WHERE k < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM spans GROUP BY 1),
  c AS (SELECT doc_id, count(*) FILTER (WHERE NOT live) AS n FROM judged GROUP BY 1)
SELECT d.doc_id, COALESCE(n1, 0) AS n_assign, COALESCE(n2, 0) AS n_access, COALESCE(n3, 0) AS n_hex, sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans, COALESCE(n4, 0) AS n_live, COALESCE(c.n, 0) AS n_copied FROM d LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)"""


SQL = {
    "op2_embeddings": EMBEDDINGS,
    "op3_quality": _quality(),
    "op5_sharding": SHARDS,
    "op6_warc": WARC,
    "op8_mixing": MIXING,
    "op9_licenses": _licenses(),
    "op11_importance": IMPORTANCE,
    "op12_trie": TRIE,
    "op13_secrets": _secrets(),
}
