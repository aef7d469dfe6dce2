"""DuckDB SQL for the queries of this subpackage.

op1 and op2 (connected components, byte strings) and op5 (page markup) are held against brute-force versions in tests instead.
"""

from __future__ import annotations

from tidemark.llm.license_scan import TEMPLATES
from tidemark.llm.quality import CLASSES, COMMON_WORDS, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_COMMON, MIN_WORDS, SYMBOLS

SHARD_BYTES = 64 << 20

_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all(" + _LOW.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hash(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 15))::BIGINT"


def _quality() -> str:
    count = lambda p: f"len(regexp_extract_all(t, {_q(p)}))"
    classes = ", ".join([*[count(p) for p in CLASSES.values()], count(SYMBOLS), count(r"[\x20\x09-\x0D]")])
    lists = " ".join(f"WHEN {_q(k)} THEN [{', '.join(map(_q, v))}]" for k, v in COMMON_WORDS.items())
    langs = ", ".join(map(_q, COMMON_WORDS))
    n, m = len(CLASSES) + 3, max(map(len, COMMON_WORDS.values())) + 1
    sums = lambda c, k: "[" + ", ".join(f"sum({c}[{i}])" for i in range(1, k + 1)) + "]"

    def distance(p: str, q: str) -> str:
        term = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END"
        x, y = f"({p}[i] / list_sum({p}))", f"({q}[i] / list_sum({q}))"
        return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {term(x, y)} + {term(y, x)})) / 2, 0)) END"

    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, CASE WHEN lang IN ({langs}) THEN lang ELSE '' END AS lang FROM documents),
 l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
 g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))),
 r AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM g, range(0, 3) AS k(o) WHERE c > 1 GROUP BY 1),
 h AS (SELECT doc_id, lang, w, t, [{classes}] AS a, CASE lang {lists} END AS words FROM d),
 i AS (SELECT doc_id, lang, list_transform(list_concat(a, [length(t) - list_sum(a)]), lambda x: x::DOUBLE) AS chars, list_transform(words, lambda x: len(list_filter(w, lambda y: y = x))) AS c, len(w) AS n FROM h),
 j AS (SELECT doc_id, lang, chars, list_transform(list_concat(c, [n - list_sum(c)]), lambda x: x::DOUBLE) AS common FROM i),
 b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, {_q(SYMBOLS)}))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(t) AS n_chars FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
 e AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
 f AS (SELECT lang, {sums("chars", n)} AS rc, {sums("common", m)} AS rw FROM j JOIN e USING (doc_id) WHERE NOT base_failed GROUP BY 1),
 s AS (SELECT j.doc_id, {distance("chars", "rc")} AS cd, CASE WHEN j.lang <> '' THEN {distance("common", "rw")} END AS wd FROM j LEFT JOIN f ON j.lang = f.lang)
 SELECT e.* EXCLUDE (n_chars), NOT base_failed AND NOT ((n_chars >= {MIN_CHARS} AND coalesce(cd, 0) > {MAX_CLASS_DISTANCE}) OR (n_words >= {MIN_COMMON} AND coalesce(wd, 0) > {MAX_WORD_DISTANCE})) AS kept FROM e JOIN s USING (doc_id)"""


def _decontamination() -> str:
    return rf"""WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
 i AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
 p AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
 m AS (SELECT doc_id, k, p.n, item_id FROM p JOIN i ON p.x = i.x AND p.n = i.n),
 h AS (SELECT doc_id, count(DISTINCT o) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS o FROM m) GROUP BY 1),
 t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY 1)
 SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


def _licenses() -> str:
    quoted = lambda x: f"[{', '.join(map(_q, x))}]"
    sets = ", ".join(f"({_q(label)}, {quoted(text.split())}, {quoted(marks)})" for label, text, marks in TEMPLATES)
    # Every run of words half as long again as a template, in each document that holds the marks at all, is held against it.
    return rf"""WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
 p AS (SELECT doc_id, i - 1 AS i, CASE w[i] WHEN 'cc' THEN 'cc-by' WHEN 'general' THEN 'gpl' ELSE 'reserved' END AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
  WHERE (w[i] = 'cc' AND w[i + 1] = 'by') OR (w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') OR (w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved')),
 b AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY 1),
 k AS (SELECT label, list_distinct(words) AS words, marks, ((len(words) * 3 + 1) // 2)::INT AS m FROM (VALUES {sets}) AS v(label, words, marks)),
 l AS (SELECT doc_id, label, words, marks, list_distinct(w[i:i + m - 1]) AS s FROM (SELECT doc_id, w, label, words, marks, m, unnest(range(1, len(w) + 1)) AS i FROM d, k WHERE list_has_all(w, marks))),
 m AS (SELECT doc_id, label, len(list_intersect(s, words))::DOUBLE / len(words) AS c FROM l WHERE list_has_all(s, marks) AND 5 * len(list_intersect(s, words)) >= 4 * len(words)),
 u AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM p UNION SELECT doc_id, label FROM m) GROUP BY 1),
 s AS (SELECT doc_id, max(c) AS c FROM m GROUP BY 1)
 SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(u.labels, '') AS labels, greatest(coalesce(c, 0.0), CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
 FROM d LEFT JOIN b USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN s USING (doc_id)"""


MIXING = rf"""WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY 1),
 c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
 v AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
 t AS (SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM v),
 r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, {_hash("'mix-1:' || CAST(doc_id AS VARCHAR)")} / 1152921504606846976.0::DOUBLE AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
 SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r"""

LINES = rf"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents),
 k AS (SELECT doc_id, i, line, trim({_LOW.format("line")}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
 c AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
 m AS (SELECT doc_id, i, line, keep IS NOT NULL AND doc_id <> keep AS gone FROM k LEFT JOIN c ON k.key = c.key)
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY 1"""


def shards(limit: int) -> str:
    return rf"""WITH d AS (SELECT doc_id, {_hash("CAST(doc_id AS VARCHAR)")} AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents),
 l AS (SELECT doc_id, n_bytes, h, k::INT AS depth, (h >> (60 - k)::INT)::BIGINT AS prefix FROM d, range(0, 41) AS r(k)),
 b AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM l GROUP BY 1, 2 HAVING sum(n_bytes) <= {limit} OR min(h) = max(h))
 SELECT doc_id, n_bytes, l.depth, l.prefix, shard_bytes, shard_docs FROM l JOIN b ON l.depth = b.depth AND l.prefix = b.prefix QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l.depth) = 1"""


URLS = rf"""WITH p AS (SELECT page_id, url, epoch_us(TIMESTAMP '2024-01-01') // 86400000000 + page_id * 7919 % 366 AS day, regexp_replace(regexp_extract({_LOW.format("url")}, '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1), '[.]+$', '') AS host FROM pages),
 s AS (SELECT page_id, url, day, host, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS key FROM p WHERE host <> ''),
 h AS (SELECT DISTINCT key, {_hash("key")} AS k FROM s WHERE contains(key, '.')),
 e AS (SELECT key, k, epoch_us(TIMESTAMP '2024-01-01') // 86400000000 AS base, (k >> 8) AS f, (k >> 20) % 200 + 1 AS n FROM h WHERE k % 3 = 0),
 r AS (SELECT key, 'block' AS list, 'add' AS action, base + f % 366 AS moment FROM e UNION ALL SELECT key, 'block', 'remove', base + (f + n) % 366 FROM e
  UNION ALL SELECT key, 'allow', 'add', base + (f + 20) % 366 FROM e WHERE k % 2 = 0 UNION ALL SELECT key, 'allow', 'remove', base + (f + 50) % 366 FROM e WHERE k % 2 = 0),
 g AS (SELECT key, list, moment, max(action) AS action FROM r GROUP BY 1, 2, 3), v AS (SELECT *, lead(moment) OVER (PARTITION BY key, list ORDER BY moment) AS until FROM g),
 m AS (SELECT page_id, s.key, list FROM s JOIN v ON s.key = v.key AND action = 'add' AND day >= moment AND (until IS NULL OR day < until) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(s.key) DESC, list) = 1)
 SELECT p.page_id, url, host, key AS matched, list, CASE WHEN list = 'block' THEN 'block' ELSE 'keep' END AS verdict FROM p LEFT JOIN m USING (page_id)"""


AUDIT = rf"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
 e AS (SELECT t, min(doc_id) AS first FROM t GROUP BY 1),
 g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
 d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * len(regexp_extract_all(t.t, '[A-Z]')) > 2 * length(t.t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t.t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
  FROM t JOIN e ON t.t = e.t LEFT JOIN g USING (doc_id)),
 c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY 1, 2),
 o AS (SELECT '' AS o UNION ALL SELECT o || f FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS l(f) WHERE NOT contains(o, f)),
 s AS (SELECT o AS filter_order, k::INT AS step, o[k] AS f, o[1:k - 1] AS before FROM o, range(1, 6) AS r(k) WHERE length(o) = 5),
 r AS (SELECT part, filter_order, step, f, sum(n) FILTER (translate(fails, before || f, '') = fails)::BIGINT AS kept, sum(n) FILTER (contains(fails, f) AND translate(fails, before, '') = fails)::BIGINT AS removed,
  sum(n) FILTER (contains(fails, f) AND translate(fails, before, '') <> fails)::BIGINT AS redundant, sum(n) FILTER (fails = f)::BIGINT AS unique_fails,
  sum(good) FILTER (contains(fails, f) AND translate(fails, before, '') = fails)::BIGINT AS good_lost, sum(toxic) FILTER (contains(fails, f) AND translate(fails, before, '') = fails)::BIGINT AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4)
 SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
 coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley FROM r"""


_CRC = "xor(4294967295, list_reduce(list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: ascii(CAST(conv_id AS VARCHAR)[i])::BIGINT), lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295))"
TRIE = rf"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
 s AS (SELECT conv_id, count(*) AS own FROM t GROUP BY 1),
 c AS (SELECT s.conv_id, {_CRC.replace("conv_id", "s.conv_id")} % 6 AS h, s.conv_id - s.conv_id % 100 AS base, coalesce(b.own, 0) AS there FROM s LEFT JOIN s AS b ON b.conv_id = s.conv_id - s.conv_id % 100),
 r AS (SELECT c.conv_id, pos AS d, role, text FROM c JOIN t ON t.conv_id = base AND pos <= h UNION ALL SELECT conv_id, pos - h + least(h, there), role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
 p AS (SELECT conv_id, d, length(text) AS chars, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM s),
 k AS (SELECT path, d, min(conv_id) AS node, count(*) AS n, max(chars) AS chars FROM p GROUP BY 1, 2),
 m AS (SELECT p.conv_id, p.d, node, n, k.chars, p.d = max(p.d) OVER (PARTITION BY p.conv_id) AS last FROM p JOIN k USING (path, d)),
 u AS (SELECT v.node, v.d, v.n, v.chars, o.node AS parent FROM m AS v LEFT JOIN m AS o ON o.conv_id = v.conv_id AND o.d = v.d - 1 WHERE v.conv_id = v.node),
 f AS (SELECT parent AS node, d - 1 AS d, count(*) AS children FROM u WHERE d > 0 GROUP BY 1, 2),
 w AS (SELECT u.*, coalesce(children, 0) AS children FROM u LEFT JOIN f USING (node, d)),
 a AS (SELECT m.node, m.d, count(*) FILTER (children = 0) AS leaves, sum((w.n - 1) * w.chars)::BIGINT AS saved FROM w JOIN m ON m.conv_id = w.node AND m.d <= w.d GROUP BY 1, 2),
 e AS (SELECT node, d, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM m WHERE last GROUP BY 1, 2)
 SELECT node AS conv_id, d::BIGINT AS depth, parent::BIGINT AS parent_conv_id, n AS n_convs, children AS n_children, leaves AS n_leaves, saved AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
 FROM w JOIN a USING (node, d) LEFT JOIN e USING (node, d)"""

SQL: dict[str, str] = {
    "op3_quality_rules": _quality(),
    "op4_benchmark_decontamination": _decontamination(),
    "op6_license_scans": _licenses(),
    "op7_mixing_sources": MIXING,
    "op8_url_filters": URLS,
    "op9_line_dedup": LINES,
    "op10_sharding": shards(SHARD_BYTES),
    "op11_conversation_prefix_trie": TRIE,
    "op13_filter_interaction_audit": AUDIT,
}
