"""DuckDB SQL of the operators' queries that SQL can express: secret spans with
ownership (3), n-gram Jaccard components (6), quality rules with line frequency
(9), containment of benchmark items (10), the Merkle manifest (11) and vector
codes (12)."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def _windows(k):
    return f"list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))"


# ------------------------------------------------------------------ secrets
_ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""")
_KINDS = (("assign", _ASSIGN, 1, 12), ("access", "AKIA[A-Z0-9]{14,}", 0, 18), ("hex", "[0-9a-f]{16,}", 0, 16),
          ("owned", "[A-Za-z0-9+/_-]{20,}", 0, 20))


def _matches(nth, kind, pattern, group, least):
    mixed = ("AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')"
             if kind == "owned" else "")
    return f"""
  SELECT rid, source, lang, {nth} AS nth, '{kind}' AS kind, stop - length(hit) AS start, stop, value
  FROM (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) AS stop
        FROM (SELECT rid, source, lang, unnest(range(len(hits))) AS i, unnest(hits) AS hit,
                     unnest(vals) AS value, unnest(gaps[1:len(hits)]) AS gap
              FROM (SELECT rid, source, lang, string_split_regex(t, '{pattern}') AS gaps,
                           regexp_extract_all(t, '{pattern}', 0) AS hits,
                           regexp_extract_all(t, '{pattern}', {group}) AS vals FROM docs) a) b) c
  WHERE length(value) >= {least} {mixed}"""


SECRETS = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_matches(i, *k) for i, k in enumerate(_KINDS))}),
owners AS (SELECT value, count(DISTINCT coalesce('+' || source, '')) AS owners, count(*) AS repos
           FROM (SELECT DISTINCT value, s.source, doc_id FROM spans s JOIN docs d ON s.rid = d.rid) q GROUP BY value),
judged AS (
  SELECT * FROM (
    SELECT s.*, CASE WHEN owners >= 3 OR repos >= 10 THEN 'example' WHEN owners = 1 THEN 'live' ELSE 'shared' END AS verdict
    FROM spans s JOIN owners o ON s.value = o.value) q WHERE nth < 3 OR verdict <> 'example'),
kept AS (
  SELECT * FROM judged j WHERE nth < 3 OR NOT EXISTS (
    SELECT 1 FROM judged b WHERE b.rid = j.rid AND b.nth < 3 AND b.start < j.stop AND j.start < b.stop)),
by_doc AS (
  SELECT rid, count(*) FILTER (nth = 0) AS n_assign, count(*) FILTER (nth = 1) AS n_access,
         count(*) FILTER (nth = 2) AS n_hex, count(*) FILTER (nth = 3) AS n_owned,
         count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'shared') AS n_shared,
         count(*) FILTER (verdict = 'example') AS n_example,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth) AS spans,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth) FILTER (nth < 3) AS base
  FROM kept GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned,
       coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared, coalesce(n_example, 0) AS n_example
FROM docs d LEFT JOIN by_doc b ON d.rid = b.rid"""

# ------------------------------------------------------------------ n-gram Jaccard
JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS.format(FOLDED)} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_sort(list_distinct({_windows(5)})) END AS s FROM words),
keyed AS (SELECT doc_id, s, len(s) AS n, md5(array_to_string(s, chr(10))) AS cls FROM sets),
classes AS (SELECT cls, min(doc_id) AS class_id, any_value(n) AS n, any_value(s) AS s FROM keyed WHERE n > 0 GROUP BY cls),
shingles AS (SELECT class_id, n, unnest(s) AS x FROM classes),
links AS (
  SELECT a.class_id AS a, b.class_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.class_id < b.class_id
  GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least_id AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, coalesce(c.class_id, k.doc_id) AS class_id,
       least(coalesce(l.b, c.class_id, k.doc_id), coalesce(c.class_id, k.doc_id)) AS component_id
FROM keyed k LEFT JOIN classes c ON k.cls = c.cls AND k.n > 0 LEFT JOIN least_id l ON l.a = c.class_id"""

# ------------------------------------------------------------------ quality rules
_LINE_WORDS = WORDS.format(f"translate(line, '{UPPER}0123456789', '{LOWER}0000000000')")
QUALITY = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
                     {WORDS.format("coalesce(text, '')")} AS w FROM documents),
wins AS (SELECT rid, unnest({_windows(3)}) AS g, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3),
often AS (SELECT rid, g FROM wins GROUP BY rid, g HAVING count(*) > 1),
repeats AS (
  SELECT rid, count(DISTINCT i + j) AS n_repeat_words
  FROM (SELECT x.rid, x.i, unnest([0, 1, 2]) AS j FROM wins x JOIN often o ON x.rid = o.rid AND x.g = o.g) q GROUP BY rid),
lines AS (SELECT rid, doc_id, source, line, {_LINE_WORDS} AS lw
          FROM (SELECT rid, doc_id, source, unnest(string_split(t, chr(10))) AS line FROM docs) q),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE len(lw) > 0 GROUP BY rid),
held AS (SELECT rid, doc_id, source, array_to_string(lw, ' ') AS x, sum(len(lw)) AS n
         FROM lines WHERE len(lw) > 0 GROUP BY rid, doc_id, source, x),
hosts AS (SELECT source, count(*) AS docs FROM docs GROUP BY source),
frequent AS (
  SELECT h.source, h.x, min(h.doc_id) AS first_id FROM held h JOIN hosts s ON h.source IS NOT DISTINCT FROM s.source
  GROUP BY h.source, h.x, s.docs HAVING count(*) > 3 AND count(*) > s.docs * 0.01),
removed AS (
  SELECT h.rid, CAST(sum(h.n) AS BIGINT) AS n_removed_words
  FROM held h JOIN frequent f ON h.source IS NOT DISTINCT FROM f.source AND h.x = f.x
  WHERE h.doc_id IS DISTINCT FROM f.first_id GROUP BY h.rid),
counts AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_removed_words, 0) AS n_removed_words
  FROM docs d LEFT JOIN repeats p ON d.rid = p.rid LEFT JOIN dups u ON d.rid = u.rid LEFT JOIN removed m ON d.rid = m.rid)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND n_words - n_removed_words >= 0.5 * n_words AS kept
FROM counts"""

# ------------------------------------------------------------------ containment
CONTAINED = f"""
WITH items AS (SELECT *, least(len(w), 5) AS k
               FROM (SELECT row_number() OVER () AS item, item_id, {WORDS.format(FOLDED)} AS w FROM benchmark) q
               WHERE len(w) > 0),
item_sets AS (SELECT DISTINCT item, item_id, k, unnest({_windows("k")}) AS x FROM items),
sizes AS (SELECT item, count(*) AS n_item FROM item_sets GROUP BY item),
docs AS (SELECT DISTINCT doc_id, text, {WORDS.format(FOLDED)} AS w FROM documents),
doc_sets AS (SELECT DISTINCT doc_id, k, unnest({_windows("k")}) AS x
             FROM docs, (SELECT DISTINCT k FROM items) ks WHERE len(w) >= k),
shared AS (SELECT doc_id, item, item_id, count(*) AS n_shared
           FROM doc_sets d JOIN item_sets i ON d.k = i.k AND d.x = i.x GROUP BY doc_id, item, item_id)
SELECT doc_id, item_id, CAST(n_item AS INTEGER) AS n_item, n_shared, n_shared / n_item AS containment
FROM shared s JOIN sizes z ON s.item = z.item WHERE 100 * n_shared >= 75 * n_item"""

# ------------------------------------------------------------------ Merkle manifest
def _field(c):
    return f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')"
def _leaf(n):
    return "sha256(" + " || ".join(_field(c) for c in ("CAST(doc_id AS VARCHAR)","source","lang",n,"text")) + ")"
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda a, b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, b)),
    CAST(4294967295 AS BIGINT)))"""
def _tree(src, out):
    """Nodes (g, level, p, h) above the rows (g, p, h) of ``src``."""
    return f"""{out}(g, level, p, h, n) AS (
  SELECT g, 0, p, h, count(*) OVER (PARTITION BY g) FROM {src}
  UNION ALL
  SELECT g, level + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), any_value((n + 1) // 2)
  FROM {out} WHERE n > 1 GROUP BY g, level, p // 2)"""
MERKLE = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('+' || lang, '') AS g, {_leaf('CAST(n_chars AS VARCHAR)')} AS leaf,
         CASE WHEN {_CRC} % 7 = 0 THEN {_leaf('CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR)')} ELSE {_leaf('CAST(n_chars AS VARCHAR)')} END AS told
  FROM documents),
placed AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM docs),
{_tree('placed', 'low')},
subroots AS (SELECT '' AS g, g AS grp, h, row_number() OVER (ORDER BY encode(g)) - 1 AS p FROM low WHERE n = 1),
{_tree('subroots', 'high')},
root AS (SELECT h AS root FROM high WHERE n = 1),
side AS (
  SELECT g, level, p, n, coalesce(lag(h) OVER w, '') AS prior, coalesce(lead(h) OVER w, '') AS later
  FROM (SELECT *, p // 2 AS run FROM low) q WHERE n > 1 WINDOW w AS (PARTITION BY g, level, run ORDER BY p)),
high_side AS (
  SELECT level, p, coalesce(lag(h) OVER w, '') AS prior, coalesce(lead(h) OVER w, '') AS later
  FROM (SELECT *, p // 2 AS run FROM high) q WHERE n > 1 WINDOW w AS (PARTITION BY level, run ORDER BY p)),
steps AS (
  SELECT rid, level, prior, later FROM placed JOIN side s ON placed.g = s.g AND placed.p >> s.level = s.p
  UNION ALL
  SELECT rid, 1000 + level, prior, later FROM placed JOIN subroots u ON placed.g = u.grp JOIN high_side s ON u.p >> s.level = s.p),
paths AS (SELECT rid, list({{'b': prior, 'a': later}} ORDER BY level) AS path FROM steps GROUP BY rid),
folded(rid, path, acc) AS (
  SELECT rid, path, told FROM (SELECT placed.rid, coalesce(path, []) AS path, told FROM placed LEFT JOIN paths ON placed.rid = paths.rid) q
  UNION ALL
  SELECT rid, path[2:], sha256(path[1].b || acc || path[1].a) FROM folded WHERE len(path) > 0)
SELECT doc_id, leaf, u.h AS subroot, root,
       sha256(coalesce(array_to_string(list_transform(path, lambda x: x.b || x.a), ''), '')) AS proof_sha256,
       acc AS folded_root, acc = root AS verified
FROM placed JOIN subroots u ON placed.g = u.grp CROSS JOIN root LEFT JOIN paths ON placed.rid = paths.rid
JOIN (SELECT rid, acc FROM folded WHERE len(path) = 0) f ON f.rid = placed.rid"""

# ------------------------------------------------------------------ vector codes
def _assign(book):
    return f"""
  SELECT rid, part, v, m // 64 AS dist, m % 64 AS code FROM (
    SELECT p.rid, p.part, any_value(p.v) AS v,
           min(64 * list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) + c.entry) AS m
    FROM pieces p JOIN {book} c ON p.part = c.part GROUP BY p.rid, p.part) q"""
def _refit(book, coded):
    return f"""
  SELECT c.part, c.entry, coalesce(s.v, c.v) AS v FROM {book} c LEFT JOIN (
    SELECT part, code, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS v FROM (
      SELECT part, code, i, sum(v[i]) AS total, count(*) AS n FROM {coded}, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM pieces))) AS i) k
      GROUP BY part, code, i) t GROUP BY part, code) s ON c.part = s.part AND c.entry = s.code"""
CODES = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rid, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS (
  SELECT rid, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS v
  FROM kept, (SELECT unnest(range(16)) AS part) q),
book0 AS (SELECT part, rid AS entry, v FROM pieces WHERE rid < 64),
coded0 AS MATERIALIZED ({_assign('book0')}),
book1 AS MATERIALIZED ({_refit('book0', 'coded0')}),
coded1 AS MATERIALIZED ({_assign('book1')}),
book2 AS MATERIALIZED ({_refit('book1', 'coded1')}),
coded2 AS MATERIALIZED ({_assign('book2')}),
said AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2),
codes AS (SELECT rid, string_agg(lower(printf('%02x', code)), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM coded2 GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN codes ON kept.rid = codes.rid CROSS JOIN said"""

ORACLE = {"op3_ownership_scan": SECRETS, "op6_ngram_jaccard": JACCARD, "op9_line_frequency": QUALITY,
          "op10_containment_search": CONTAINED, "op11_slot_pivot": MERKLE, "op12_hadamard_codes": CODES}
