"""DuckDB SQL for the queries whose whole result SQL can express."""

from __future__ import annotations

from risklane.llm import quality

# Every node with all nodes reachable from it; links hold both directions.
REACH = """r(k, j) AS (SELECT k, k FROM n UNION SELECT r.k, l.b FROM r JOIN l ON l.a = r.j)"""


def quality_sql() -> str:
    """The same counts and rules; the threshold table is read from ``quality.RULES``."""
    stops = ", ".join(f"'{form}'" for form in quality.stop_forms())
    columns = {rule.metric for rule in quality.RULES}
    assert columns <= {"n_words", "mean_word_chars", "symbol_ratio", "mark_ratio", "stop_ratio", "dup_line_ratio"}

    def test(rule: quality.Rule) -> str:
        parts = [f"{rule.metric} >= {rule.least}"] if rule.least is not None else []
        parts += [f"{rule.metric} <= {rule.most}"] if rule.most is not None else []
        return f"coalesce({' AND '.join(parts)}, false)"

    failed = ", ".join(f"CASE WHEN NOT {test(rule)} THEN '{rule.name}' END" for rule in quality.RULES)
    verdict = " AND ".join(test(rule) for rule in quality.RULES)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT k, unnest(words) AS a, generate_subscripts(words, 1) AS i, words FROM w),
g AS (SELECT k, i, a || ' ' || words[i + 1] || ' ' || words[i + 2] AS v FROM p WHERE i + 2 <= len(words)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, v) AS n FROM g) WHERE n > 1),
c AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY k),
m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
             len(regexp_extract_all(text, '[!?~^=_]')) AS n_marks, len(lines) AS n_lines,
             len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS n_stop
      FROM w LEFT JOIN c USING (k)),
q AS (SELECT *, word_chars / nullif(n_words, 0)::DOUBLE AS mean_word_chars,
             n_symbols / nullif(word_chars, 0)::DOUBLE AS symbol_ratio, n_marks / nullif(word_chars, 0)::DOUBLE AS mark_ratio,
             n_stop / nullif(n_words, 0)::DOUBLE AS stop_ratio, n_dup_lines / nullif(n_lines, 0)::DOUBLE AS dup_line_ratio,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND {verdict} AS kept, round(mean_word_chars, 6) AS mean_word_chars,
       round(symbol_ratio, 6) AS symbol_ratio, round(mark_ratio, 6) AS mark_ratio, round(stop_ratio, 6) AS stop_ratio,
       round(dup_line_ratio, 6) AS dup_line_ratio, concat_ws(',', {failed}) AS failed
FROM q"""


NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT k, doc_id FROM w),
p AS (SELECT k, len(w) AS size, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
s AS (SELECT DISTINCT k, x FROM (SELECT k, size, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' '
    || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS x FROM p WINDOW o AS (PARTITION BY k ORDER BY i)) WHERE i <= size - 4
    UNION ALL SELECT k, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
z AS (SELECT k, count(*) AS size FROM s GROUP BY k),
c AS (SELECT a.k AS a, b.k AS b, count(*) AS m FROM s a JOIN s b ON a.x = b.x AND a.k <> b.k GROUP BY a.k, b.k),
l AS (SELECT a, b FROM c JOIN z p ON p.k = a JOIN z q ON q.k = b WHERE 100 * m >= 75 * (p.size + q.size - m)),
{REACH},
m AS (SELECT r.k, min(n.doc_id) AS least FROM r JOIN n ON n.k = r.j GROUP BY r.k)
SELECT doc_id, coalesce(size, 0)::BIGINT AS n_shingles, least AS component_id, doc_id IS NOT DISTINCT FROM least AS kept
FROM n JOIN m USING (k) LEFT JOIN z USING (k)"""


NEAR_VECTORS = f"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT k, vec_id, v, coalesce(len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0, false) AS ok FROM e),
u AS (SELECT k, v, len(v) AS size FROM n WHERE ok),
l AS (SELECT a.k AS a, b.k AS b FROM u a JOIN u b ON a.size = b.size AND a.k <> b.k
    AND CASE WHEN a.size = b.size THEN list_cosine_similarity(a.v, b.v) END >= 0.95),
{REACH},
m AS (SELECT r.k, min(n.vec_id) AS least FROM r JOIN n ON n.k = r.j GROUP BY r.k),
h AS (SELECT a AS k, count(*) AS links FROM l GROUP BY a)
SELECT vec_id, coalesce(links, 0)::BIGINT AS n_links, least AS component_id, vec_id IS NOT DISTINCT FROM least AS kept
FROM n JOIN m USING (k) LEFT JOIN h USING (k)"""


REVISITS = r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS u,
    md5(coalesce(html, '')) AS tag, strlen(coalesce(html, '')) AS size, CAST(page_id % 28 + 1 AS VARCHAR) AS day FROM pages),
c AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS kept FROM p),
k AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS key FROM c),
v AS (SELECT page_id * 2 + 1 AS record_id, key, page_id * 10 + 20 AS "at", CASE WHEN page_id % 4 = 0 THEN tag
    WHEN page_id % 4 = 1 THEN 'W/' || tag WHEN page_id % 8 = 2 THEN 'other' END AS tag,
    CASE WHEN page_id % 4 = 3 THEN day END AS day FROM k),
f AS (SELECT page_id * 2 AS record_id, key, page_id * 10 AS "at", tag, day, size FROM k WHERE page_id % 11 <> 10),
j AS (SELECT v.record_id, any_value(v.key) AS key, any_value(v."at") AS "at", any_value(v.tag) AS tag, any_value(v.day) AS day,
    arg_max(f, f.record_id) AS s FROM v LEFT JOIN f ON f.key = v.key AND f."at" < v."at" GROUP BY v.record_id),
o AS (SELECT *, CASE WHEN s.record_id IS NULL THEN 'no_response' WHEN tag IS NULL AND day IS NULL THEN 'no_validator'
    WHEN tag IS NOT NULL AND regexp_replace(tag, '^W/', '') = s.tag THEN 'resolved'
    WHEN tag IS NULL AND day = s.day THEN 'resolved' ELSE 'changed' END AS outcome FROM j)
SELECT record_id, key AS canonical_url, "at", outcome, CASE WHEN outcome = 'resolved' THEN s.record_id END AS response_id,
    CASE WHEN outcome = 'resolved' THEN s."at" END AS response_at, CASE WHEN outcome = 'resolved' THEN
    'age: 5' || chr(10) || 'cache-control: max-age=90' || chr(10) || 'content-length: ' || s.size || chr(10) || 'etag: '
    || coalesce(tag, s.tag) || chr(10) || 'last-modified: ' || coalesce(day, s.day) END AS headers
FROM o"""


def crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text, bit by bit."""
    bits = f"list_transform(range(8 * strlen({text})), lambda i: CASE WHEN i % 8 = 0 THEN ascii(({text})[i // 8 + 1]) ELSE 0 END::BIGINT)"
    step = "xor(xor(c, b) >> 1, CASE WHEN xor(c, b) % 2 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: {step}), 4294967295::BIGINT)"


def merkle_sql() -> str:
    """Level by level: a tree of one source after the other, the tree over their subroots, and every way up."""
    def leaf(text: str) -> str:
        fields = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(fields)})"

    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, source, {leaf('text')} AS leaf,
  {leaf(f"(CASE WHEN {crc32('doc_id::VARCHAR')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS now FROM documents),
o AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, count(*) OVER (PARTITION BY source) AS n,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t(tree, level, pos, n, hash) AS (SELECT tree, 0, pos, n, leaf FROM o UNION ALL
  SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY tree, level, pos // 3, n),
s AS (SELECT tree, tree - 1 AS pos, count(*) OVER () AS n, hash FROM t WHERE n = 1),
u(level, pos, n, hash) AS (SELECT 1000, pos, n, hash FROM s UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 3, n),
w AS (SELECT tree, level, pos, n, hash, pos // 3 AS run FROM t WHERE n > 1),
v AS (SELECT level, pos, n, hash, pos // 3 AS run FROM u WHERE n > 1),
ways AS (SELECT o.k, w.level, string_agg(w.hash, '' ORDER BY w.pos) FILTER (WHERE w.pos < me.pos) AS before,
    string_agg(w.hash, '' ORDER BY w.pos) FILTER (WHERE w.pos > me.pos) AS after
  FROM o JOIN w me ON me.tree = o.tree AND me.pos = o.pos // (3 ** me.level)::BIGINT
  JOIN w ON w.tree = me.tree AND w.level = me.level AND w.run = me.run GROUP BY o.k, w.level
  UNION ALL SELECT o.k, v.level, string_agg(v.hash, '' ORDER BY v.pos) FILTER (WHERE v.pos < me.pos),
    string_agg(v.hash, '' ORDER BY v.pos) FILTER (WHERE v.pos > me.pos)
  FROM o JOIN v me ON me.pos = (o.tree - 1) // (3 ** (me.level - 1000))::BIGINT
  JOIN v ON v.level = me.level AND v.run = me.run GROUP BY o.k, v.level),
steps AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY level) AS step, coalesce(before, '') AS before, coalesce(after, '') AS after FROM ways),
f(k, step, hash) AS (SELECT k, 0, now FROM o UNION ALL
  SELECT f.k, f.step + 1, sha256(before || hash || after) FROM f JOIN steps ON steps.k = f.k AND steps.step = f.step + 1),
back AS (SELECT k, arg_max(hash, step) AS folded_root FROM f GROUP BY k),
p AS (SELECT k, string_agg(before || after, '' ORDER BY step) AS proof FROM steps GROUP BY k)
SELECT doc_id, leaf, s.hash AS subroot, r.hash AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root,
  folded_root = r.hash AS verified
FROM o JOIN s USING (tree) JOIN (SELECT hash FROM u WHERE n = 1) r ON true JOIN back USING (k) LEFT JOIN p USING (k)"""
