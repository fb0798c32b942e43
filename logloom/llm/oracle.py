"""The operators that SQL can express, as SQL for DuckDB."""

from __future__ import annotations

from .decontam import LOWER, UPPER

_SPACED = r"'[^\x20\x09-\x0D]+'"
_BARE = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

_NEAR = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_FOLDED}, {_SPACED}) AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM d
), e AS (SELECT doc_id, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)
), linked AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM s
  UNION SELECT r.x, t.b FROM reach r JOIN linked t ON t.a = r.y
), c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN c ON c.x = s.doc_id
"""

_CONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_FOLDED}, {_BARE}) AS w FROM documents
), i AS (
  SELECT DISTINCT item_id, regexp_extract_all({_FOLDED}, {_BARE}) AS w FROM benchmark
), win AS (
  SELECT item_id, len(w) AS n, unnest(CASE WHEN len(w) <= 13 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')) END) AS t
  FROM i WHERE len(w) > 0
), sized AS (SELECT DISTINCT item_id, least(n, 13) AS n, t FROM win
), place AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS spot FROM d
), hit AS (
  SELECT doc_id, item_id, spot, sized.n FROM place
  JOIN (SELECT DISTINCT n FROM sized) k ON spot + k.n - 1 <= len(w)
  JOIN sized ON sized.n = k.n AND sized.t = array_to_string(w[spot:spot + k.n - 1], ' ')
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(spot, spot + n)) AS p FROM hit) GROUP BY 1
), named AS (
  SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hit GROUP BY 1
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM v
  UNION SELECT r.x, l.b FROM reach r JOIN l ON l.a = r.y
), c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.x = vec_id LEFT JOIN n ON n.a = vec_id
"""

_REPEATS = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents
), win AS (
  SELECT doc_id, spot, md5(array_to_string(w[spot:spot + 34], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS spot FROM d WHERE len(w) >= 35)
), rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(spot, spot + 35)) AS p FROM win SEMI JOIN rep USING (h)
), word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p)
  GROUP BY doc_id
), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_MIX = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_SPACED}))::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source IS NULL, source) AS place
  FROM d GROUP BY source
), w AS (SELECT *, ((place - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS top FROM s
), o AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(top) OVER before, 0) AS amount,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights
  FROM w WINDOW before AS (ORDER BY top / weight, place
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lev AS (
  SELECT arg_min(amount / weights, (top / weight, place))
    FILTER (weight * (amount / weights) <= top) AS level FROM o
), t AS (
  SELECT source, source_size, least(coalesce(weight * level, top), top) AS target FROM w, lev
), p AS (
  SELECT d.*, source_size, target, round(target)::BIGINT AS words,
    coalesce(sum(size) OVER (PARTITION BY d.source
      ORDER BY md5(concat_ws(':', doc_id::VARCHAR, size::VARCHAR)), doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END * size
    + greatest(least(words - CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END
      * source_size - start, size), 0))::BIGINT AS taken
FROM p
"""

# The CRC-32 of decimals, byte by byte and bit by bit, and prefixes as lists of turns.
_TRIE = """
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 100 AS base, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, len(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda r, bit: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM turns)
), mixed AS (
  SELECT v.c, t.pos, 0 AS own, t.role, t.text FROM convs v JOIN turns t ON t.c = v.base AND t.pos <= v.h
  UNION ALL
  SELECT v.c, t.pos, 1, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c AND t.pos > v.h
), numbered AS (
  SELECT c, row_number() OVER w AS depth, text, list({'r': role, 't': text}) OVER w AS prefix
  FROM mixed WINDOW w AS (PARTITION BY c ORDER BY own, pos ROWS UNBOUNDED PRECEDING)
), named AS (
  SELECT *, min(c) OVER (PARTITION BY prefix) AS name, depth = max(depth) OVER (PARTITION BY c) AS ends FROM numbered
  UNION ALL
  SELECT c, 0, '', NULL, (SELECT min(c) FROM convs), c NOT IN (SELECT c FROM mixed) FROM convs
), nodes AS (
  SELECT name, depth, count(*) AS n_convs, CASE WHEN depth > 0 THEN (count(*) - 1) * any_value(length(text)) ELSE 0 END AS tokens,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM named GROUP BY name, depth
), linked AS (
  SELECT n.*, p.name AS parent FROM nodes n LEFT JOIN named p ON p.c = n.name AND p.depth = n.depth - 1
), children AS (SELECT parent AS name, depth - 1 AS depth, count(*) AS n FROM linked WHERE depth > 0 GROUP BY ALL
), totals AS (
  SELECT p.name, p.depth, sum(n.tokens) AS tokens, count(*) FILTER (k.n IS NULL) AS leaves
  FROM nodes n LEFT JOIN children k USING (name, depth) JOIN named p ON p.c = n.name AND p.depth <= n.depth GROUP BY p.name, p.depth
)
SELECT l.name AS conv_id, l.depth, l.parent AS parent_conv_id, l.n_convs, coalesce(k.n, 0) AS n_children,
  t.leaves AS n_leaves, t.tokens::BIGINT AS saved_tokens, l.ends_sha256
FROM linked l JOIN totals t USING (name, depth) LEFT JOIN children k USING (name, depth)
"""

ORACLES = {
    "op1_minhash_odd_sketch": _NEAR,
    "op2_prefix_decontamination": _CONTAMINATION,
    "op5_metric_range_join": _VECTORS,
    "op7_seed_and_extend": _REPEATS,
    "op8_curriculum_mix": _MIX,
    "op12_prefix_trie": _TRIE,
}
