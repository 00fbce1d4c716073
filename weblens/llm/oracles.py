"""DuckDB SQL for the queries of this subpackage that SQL can express over whole tables."""

from weblens.llm.common import LOWER, UPPER
from weblens.llm.merkle import CUT, LEAF
from weblens.llm.mixing import ROWS, SUBS

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

MIX = rf"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
c AS (SELECT *, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)) AS class, coalesce(CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % (SELECT CAST(greatest({SUBS}, pow(2, ceil(log2(ceil(count(*) / {ROWS}.0))))) AS BIGINT) FROM s) AS INTEGER), 0) AS sub FROM s),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS weight FROM src),
f AS (SELECT *, source_size * CAST(2 AS DOUBLE) AS cap, source_size * CAST(2 AS DOUBLE) / weight AS full_at, CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS total FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY full_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY full_at, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER (ORDER BY full_at, source IS NULL, source) AS place FROM f),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, place) FROM l WHERE level <= full_at), full_at) * weight) AS target FROM l),
r AS (SELECT doc_id, c.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY c.source ORDER BY class, sub, size, doc_id NULLS FIRST) AS k,
  CAST(CAST('0x' || substr(md5(concat('7:', CASE WHEN c.source IS NULL THEN 'n' ELSE 's' END, coalesce(c.source, ''))), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE) AS u
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, CAST(least(floor(rate * k + u) - floor(rate * (k - 1) + u), 2) AS BIGINT) AS copies FROM r)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM n
"""

LINES = f"""
WITH u AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {WHITE}), '{UPPER}', '{LOWER}') AS key FROM u),
c AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, coalesce(holder <> doc_id, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

CHATS = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
e AS (SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')) + 20 AS shown FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(shown) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

MERKLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_text FROM d),
e AS (SELECT *, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM n),
x AS (SELECT doc_id, 1 AS kind, text FROM e UNION ALL SELECT doc_id, 2, edited FROM e UNION ALL SELECT doc_id, 3, next_text FROM e),
t AS (SELECT doc_id, kind, list_transform(string_split(text, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{LEAF}'), lambda y: md5(y))) AS tree FROM x),
p AS (SELECT doc_id, kind, tree, list_transform(tree, lambda p: md5(coalesce(array_to_string(p, ''), ''))) AS pars, list_transform(tree, lambda p: md5(coalesce(array_to_string(p, ''), ''))[1:8] || '=' || coalesce(array_to_string(list_transform(p, lambda y: y[1:8]), ' '), '')) AS shown FROM t),
z AS (SELECT *, list_concat([0], list_filter(range(1, len(pars) + 1), lambda i: pars[i][1] = '{CUT}' OR i = len(pars))) AS ends FROM p),
f AS (SELECT doc_id, kind, list_distinct(list_transform(flatten(tree), lambda y: y[1:8])) AS leaves,
  md5(array_to_string(list_transform(range(2, len(ends) + 1), lambda i: md5(array_to_string(pars[ends[i - 1] + 1:ends[i]], ''))), '')) AS root,
  array_to_string(list_transform(range(2, len(ends) + 1), lambda i: md5(array_to_string(pars[ends[i - 1] + 1:ends[i]], ''))[1:8] || ';' || array_to_string(shown[ends[i - 1] + 1:ends[i]], '|')), '/') AS body FROM z),
g AS (SELECT a.doc_id, concat(a.root, ':', a.body) AS fingerprint, concat(b.root, ':', b.body) AS edited_fingerprint,
  CASE WHEN a.root = b.root THEN 1.0 WHEN len(a.leaves) + len(b.leaves) = 0 THEN 0.0 ELSE CAST(2 AS DOUBLE) * len(list_intersect(a.leaves, b.leaves)) / (len(a.leaves) + len(b.leaves)) END AS near_edited,
  CASE WHEN a.root = c.root THEN 1.0 WHEN len(a.leaves) + len(c.leaves) = 0 THEN 0.0 ELSE CAST(2 AS DOUBLE) * len(list_intersect(a.leaves, c.leaves)) / (len(a.leaves) + len(c.leaves)) END AS near_next
  FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.kind = 1 AND b.kind = 2 JOIN f c ON a.doc_id = c.doc_id AND c.kind = 3)
SELECT e.doc_id, length(e.text) AS n_chars, sha256(e.edited) AS edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next FROM e JOIN g USING (doc_id)
"""

EXACT = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, arg_min(doc_id, (-chars, doc_id)) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)
"""

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 80 * (x.n + y.n - common)),
ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS least FROM documents UNION SELECT ways.b, r.least FROM r JOIN ways ON r.doc_id = ways.a AND r.least < ways.b),
c AS (SELECT doc_id, min(least) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8: of each byte, then eight steps (-1) of the reversed polynomial 0xEDB88320."""
    code = f"hex(encode({text}))"
    steps = f"flatten(list_transform(range(length({code}) // 2), lambda i: [CAST(CAST('0x' || substr({code}, 2 * i + 1, 2) AS INTEGER) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"


RUNS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
a AS (SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
w AS (SELECT doc_id, unnest(range(n)) AS i, unnest(CASE WHEN a IS NULL THEN words ELSE list_transform(range(n), lambda i: words[CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS BIGINT) + 1]) END) AS word FROM p),
k AS (SELECT doc_id, i, word, dense_rank() OVER (ORDER BY doc_id, word) AS key FROM w),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS lag FROM k x JOIN k y ON x.key = y.key AND x.i < y.i),
g AS (SELECT doc_id, lag, i, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS g FROM e),
s AS (SELECT doc_id, lag, min(i) AS start, count(*) + lag AS length FROM g GROUP BY doc_id, lag, g),
r AS (SELECT doc_id, start, length, min(lag) AS period FROM s WHERE length >= greatest(12, 2 * lag) GROUP BY doc_id, start, length),
t AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'s': start, 'l': length, 'p': period}}, (-length, start, period)) AS b,
  string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS shown FROM r GROUP BY doc_id),
x AS (SELECT doc_id, unnest(range(CAST(start + period AS BIGINT), CAST(start + length AS BIGINT))) AS i FROM r),
c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.l AS BIGINT) AS length, CAST(b.p AS BIGINT) AS period, CAST(1000 * b.l // b.p AS BIGINT) AS exponent_milli,
  sha256(coalesce(shown, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)
"""

SPELLING = f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, {_crc32("concat(doc_id, ':', run)")} AS h FROM c),
v AS (SELECT CASE WHEN h % 31 = 0 THEN concat(left(run, CAST(h % length(run) AS BIGINT)), substr(run, CAST(h % length(run) AS BIGINT) + 2)) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, n, k, concat(left(word, k), substr(word, k + 2)) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS k FROM w)),
p AS (SELECT x.word, y.word AS other, y.n AS m FROM d x JOIN d y ON x.rest = y.rest AND x.k = y.k AND x.word <> y.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
g AS (SELECT word, count(*) AS n_near, arg_min({{'w': other, 'n': m}}, (-m, other)) AS b FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 10 * w.n THEN b.w END AS form, CASE WHEN b.n >= 10 * w.n THEN b.n END AS form_n FROM w LEFT JOIN g USING (word)),
t AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT t.word, f.form FROM t JOIN f ON t.at = f.word WHERE f.form IS NOT NULL),
e AS (SELECT t.word, t.at AS root FROM t JOIN f ON t.at = f.word WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM f LEFT JOIN e USING (word)
"""

#: The others, token counts, packing and language and toxicity models, are beyond SQL; the tests hold them against
#: the libraries, exact round trips, plain kernels and sets, and held-out labels.
ORACLES: dict[str, str] = {
    "op2_source_mixing": MIX,
    "op3_line_dedup": LINES,
    "op4_minhash_near_dedup": NEAR,
    "op5_chat_formatting": CHATS,
    "op7_merkle_fingerprints": MERKLE,
    "op9_exact_dedup": EXACT,
    "op12_periodic_runs": RUNS,
    "op13_spelling_variants": SPELLING,
}
